"""Queries by name, each with the SQL it is held against where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded as the SQL rounds them, and no negative zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def plain(df: DataFrame) -> DataFrame:
    """Column order of voxels: volume_id, z, y, x, then the rest."""
    first = [c for c in ("volume_id", "z", "y", "x") if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def drawn(*keys: str) -> str:
    """SQL of a number in [0, 1) that depends on the keys (SQL expressions) alone: the first 52 bits of their MD5."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"
