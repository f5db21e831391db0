"""Tiled inference: pad, cut tiles, predict each, put them together, crop, rescale.

A model is any function from a batch of tiles (n, side, side, side) to
predictions of the same shape. It runs in Arrow-batched workers on tiles as
arrays; padding, tiling and overlap-add are relational.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import AXES, Config
from . import geometry as G
from . import normalize as N

Model = Callable[[np.ndarray], np.ndarray]
TILE = ("tz", "ty", "tx")
PLACE = ("iz", "iy", "ix")
PLANES = ((1, 2), (2, 3), (1, 3))


def assemble(tiled: DataFrame, tile: int) -> DataFrame:
    """A row for each tile, with its values as an array, z slowest; tiles are whole, so an array has tile**3 values."""
    rank = (F.col("iz") * tile + F.col("iy")) * tile + F.col("ix")
    got = tiled.groupBy("volume_id", *TILE).agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "value"))).alias("c"))
    return got.select("volume_id", *TILE, F.transform("c", lambda c: c.value).alias("data"))


def predict(tiles: DataFrame, model: Model, tile: int, tta: bool = False, low: float = -5.0, high: float = 20.0) -> DataFrame:
    """Runs the model on each tile; with tta the average over quarter turns in all planes.

    Turns by 90 and 270 degrees in mirrored planes repeat one another, so four
    predictions in one plane, weighted 1 2 2 2, stand for seven. A tile whose
    plain prediction never leaves the background is not turned.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["data"].to_numpy()).reshape(-1, tile, tile, tile) if len(b) else np.zeros((0, tile, tile, tile))
            yield b.assign(data=list(tta_predict(model, x, low, high).reshape(len(b), -1)) if tta else list(np.asarray(model(x), float).reshape(len(b), -1)))

    schema = T.StructType([f if f.name != "data" else T.StructField("data", T.ArrayType(T.DoubleType())) for f in tiles.schema.fields])
    return tiles.mapInPandas(run, schema)


def tta_predict(model: Model, x: np.ndarray, low: float, high: float) -> np.ndarray:
    plain = np.asarray(model(x), float)
    edge = 5 if x.shape[1] > 10 else 0
    core = plain[:, edge : x.shape[1] - edge, edge : x.shape[1] - edge, edge : x.shape[1] - edge]
    on = core.reshape(len(x), -1).max(axis=1, initial=-np.inf) > low + 0.01 * (high - low)
    out = plain.copy()
    if on.any():
        total = plain[on].copy()
        for k in (1, 2, 3):
            turned = np.rot90(x[on], k, (2, 3))
            total += 2 * np.rot90(np.asarray(model(turned), float), -k, (2, 3))
        out[on] = total / 7
    return out


def tta_rows(voxels: DataFrame, shape: tuple[int, int, int], model: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The same average for a model that is itself a map of volumes in relational form: four runs, turned back, weighted 1 2 2 2 of 7."""
    if shape[1] != shape[2]:
        raise ValueError("the plane of turns must be square")
    parts = None
    for k, w in ((0, 1), (1, 2), (2, 2), (3, 2)):
        out = G.rot90(model(G.rot90(voxels, ("y", "x"), k, shape)), ("y", "x"), -k, shape).withColumn("_w", F.lit(float(w)))
        parts = out if parts is None else parts.unionByName(out)
    return parts.groupBy("volume_id", *AXES).agg((F.sum(F.col("value") * F.col("_w")) / 7).alias("value"))


def scatter(tiles: DataFrame, tile: int) -> DataFrame:
    """Tiles with arrays back to voxels with their places in the volume."""
    margin_free = tiles.select("volume_id", *TILE, *[c for c in ("oz", "oy", "ox") if c in tiles.columns], F.posexplode("data").alias("r", "value"))
    r = F.col("r")
    places = {"iz": F.floor(r / (tile * tile)), "iy": F.floor(r / tile) % tile, "ix": r % tile}
    return margin_free.withColumns({k: v.cast("int") for k, v in places.items()}).drop("r")


def sliding_window(voxels: DataFrame, shape: tuple[int, int, int], model: Model, config: Config, feathered: bool = True, patch_norm: bool = False) -> DataFrame:
    """The predicted heat map in [0, 1] of each volume.

    Volumes are padded by reflection so that kept centres cover them; tiles
    are cut, predicted, and averaged with weights that fall to their borders
    (or over kept centres); the padding is cropped and values are rescaled
    from (low, high). NaN counts as low.
    """
    tile, keep, step = config.tile, config.keep, config.step
    v = voxels
    before = after = (0, 0, 0)
    if tuple(shape) != (tile,) * 3:
        total = [G.padding_for(n, step, keep, tile) + tile for n in shape]
        before = tuple(t // 2 for t in total)
        after = tuple(t - b for t, b in zip(total, before))
        v = G.pad(v, shape, before, after, "reflect")
    size = tuple(n + b + a for n, b, a in zip(shape, before, after))
    if size == (tile,) * 3:
        tiled = v.withColumns({f"t{a}": F.lit(0) for a in AXES} | {f"i{a}": F.col(a) for a in AXES})
    else:
        tiled = G.extract_tiles(v, size, tile, keep, step)
    if patch_norm:
        tiled = G.tile_norm(tiled)
    done = scatter(predict(assemble(tiled, tile), model, tile, config.tta, config.low, config.high), tile)
    margin = (tile - keep) // 2
    if size == (tile,) * 3:
        joined = done.withColumns({a: F.col(f"i{a}") for a in AXES}).groupBy("volume_id", *AXES).agg(F.first("value").alias("value"))
    else:
        placed = done.withColumns({a: (F.col(f"i{a}") + F.greatest(F.col(f"t{a}") - margin, F.lit(0))).cast("int") for a in AXES})
        joined = G.overlap_add(placed, tile) if feathered else G.centre_average(placed, keep)
    out = G.crop(joined, before, tuple(n + b for n, b in zip(shape, before)))
    return N.rescale_const(out, config.low, config.high)


def masked_mse(rows: DataFrame, group: str | None = None) -> DataFrame:
    """Mean over all voxels of the squared difference of o and l where mask holds; what is masked out, or has no label, counts as 0."""
    d = F.coalesce(F.when(F.col("mask"), F.pow(F.col("o") - F.col("l"), 2)), F.lit(0.0))
    return rows.groupBy(*([group] if group else [])).agg(F.avg(d).alias("mse"))
