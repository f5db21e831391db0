"""Schemas of volumes, checks of their rows, and the configuration of a run.

A volume in relational form has a row for each voxel: ``volume_id``, the
coordinates ``z y x`` and a value or label. Label 0 is background; a null label
is one to ignore. In blocked form a row holds a block of voxels as bytes.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AXES = ("z", "y", "x")

_ID, _PLACE = "volume_id string", "z int, y int, x int"
#: Schemas as DDL, as readers and Python workers take them.
VOXELS = f"{_ID}, {_PLACE}, value double"
LABELS = f"{_ID}, {_PLACE}, label int"
BLOCKS = f"{_ID}, origin struct<z:int,y:int,x:int>, shape struct<z:int,y:int,x:int>, dtype string, data binary"
PAIRS = "pair_id string, t int, p int, n long"
INSTANCES = f"{_ID}, label int, n_vox long"


def label_checks(labels: DataFrame, column: str = "label") -> DataFrame:
    """One row: whether the column is of an integer type, has no negative value, and whether its labels are 1..n without gaps."""
    whole = isinstance(labels.schema[column].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    c = F.col(column)
    return labels.agg(
        F.lit(whole).alias("is_integer"),
        (F.coalesce(F.min(c), F.lit(0)) >= 0).alias("non_negative"),
        (F.count_distinct(F.when(c != 0, c)) == F.coalesce(F.max(F.when(c != 0, c)), F.lit(0))).alias("sequential"),
    )


def require_labels(labels: DataFrame, column: str = "label") -> DataFrame:
    """The frame itself; raises ValueError unless the column is integer and non-negative."""
    row = label_checks(labels, column).first()
    if not row.is_integer:
        raise ValueError(f"{column} must be of an integer type")
    if not row.non_negative:
        raise ValueError(f"{column} must be non-negative")
    return labels


@dataclass(frozen=True)
class Config:
    """Settings of a segmentation run; checked when made."""

    tile: int = 64
    keep: int = 32
    step: int = 32
    low: float = -5.0
    high: float = 20.0
    h: float = 0.1
    background: float = 0.2
    confidence: float = 0.5
    min_size: int = 9
    smoothing: bool = True
    simple: bool = False
    tta: bool = False
    upsampling: tuple[float, float, float] = (1.0, 1.0, 1.0)
    trials: int = 300
    seed: int = 0

    def __post_init__(self):
        wrong = [
            what
            for bad, what in (
                (self.tile < 1 or self.keep < 1 or self.step < 1, "tile, keep and step must be positive"),
                (self.tile % 32 != 0, "tile must be divisible by 32"),
                (self.keep > self.tile, "keep must not exceed tile"),
                (self.step > self.keep, "step must not exceed keep"),
                (self.low >= self.high, "low must be below high"),
                (not 0 <= self.background <= 1, "background must be in [0, 1]"),
                (not 0 <= self.confidence <= 1, "confidence must be in [0, 1]"),
                (self.h < 0, "h must not be negative"),
                (self.min_size < 0, "min_size must not be negative"),
                (any(f <= 0 for f in self.upsampling), "upsampling factors must be positive"),
                (self.trials < 1, "trials must be positive"),
            )
            if bad
        ]
        if wrong:
            raise ValueError("; ".join(wrong))

    @property
    def large(self) -> bool:
        """Whether tiles are larger than is advisable."""
        return self.tile > 192

    def override(self, **given: object) -> Config:
        """A copy with the settings that are not None; texts are read as the field's type ("false", "no", "0" are false)."""
        known = {f.name: getattr(self, f.name) for f in fields(self)}
        unknown = given.keys() - known.keys()
        if unknown:
            raise ValueError(f"no such setting: {', '.join(sorted(unknown))}")
        return replace(self, **{k: _read(v, known[k]) for k, v in given.items() if v is not None})

    @classmethod
    def from_sections(cls, sections: dict[str, dict[str, object]]) -> Config:
        """From a nested mapping as configuration files have it; section names do not matter."""
        flat = {k: v for section in sections.values() for k, v in section.items()}
        return cls().override(**flat)


def _read(value: object, like: object) -> object:
    if not isinstance(value, str):
        return tuple(value) if isinstance(value, list) else value
    if isinstance(like, bool):
        return value.strip().lower() not in ("", "0", "false", "no", "off")
    if isinstance(like, tuple):
        return tuple(float(x) for x in value.split(","))
    return type(like)(value)
