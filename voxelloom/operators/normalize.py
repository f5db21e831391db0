"""Intensity normalisation by statistics of each volume.

Statistics are one aggregation for each volume and are joined back; they are a
row for each volume, so Spark sends them to the voxels by broadcast when they are
small enough and by a shuffle when not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

def _with(voxels: DataFrame, *aggregates, group: str = "volume_id") -> DataFrame:
    return voxels.join(voxels.groupBy(group).agg(*aggregates), group)


def percentile_bounds(voxels: DataFrame, low: float, high: float, group: str = "volume_id") -> DataFrame:
    """Adds lo and hi, exact percentiles (linear between ranks) of each volume.

    An exact percentile counts distinct values, which partial aggregation
    makes small for images of few grey levels.
    """
    q = F.expr(f"percentile(value, array({low / 100}d, {high / 100}d))")
    return _with(voxels, q.alias("_q"), group=group).withColumns({"lo": F.col("_q")[0], "hi": F.col("_q")[1]}).drop("_q")


def clip_norm(voxels: DataFrame, low: float = 1.0, high: float = 99.0, clip: bool = True, group: str = "volume_id") -> DataFrame:
    """Clips to percentiles and scales to [0, 1]; a constant volume stays as it is after clipping."""
    v = voxels
    if clip:
        v = percentile_bounds(v, low, high, group).withColumn("value", S.clip(F.col("value"), F.col("lo"), F.col("hi"))).drop("lo", "hi")
    v = _with(v, F.min("value").alias("_a"), F.max("value").alias("_b"), group=group)
    a, b = F.col("_a"), F.col("_b")
    return v.withColumn("value", F.when(b > a, (F.col("value") - a) / (b - a)).otherwise(b)).drop("_a", "_b")


def preprocess(
    voxels: DataFrame, low: float = 96, high: float = 99.9, clip: bool = False, normalize: bool = True, moments: bool = False, scale: float = 2.0, group: str = "volume_id"
) -> DataFrame:
    """Clips, standardises by moments, scales to [0, 1] and then to [-scale / 2, scale / 2], each if asked for."""
    v = voxels
    if clip:
        v = percentile_bounds(v, low, high, group).withColumn("value", S.clip(F.col("value"), F.col("lo"), F.col("hi"))).drop("lo", "hi")
    if moments:
        v = zscore(v, group)
    if normalize:
        v = clip_norm(v, clip=False, group=group).withColumn("value", F.col("value") * F.lit(scale) - F.lit(scale / 2))
    return v


def zscore(voxels: DataFrame, group: str = "volume_id") -> DataFrame:
    """Minus the mean, by the standard deviation of the population; by the mean alone where that is 0."""
    v = _with(voxels, F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"), group=group)
    s = F.col("_s")
    return v.withColumn("value", F.when(s > 0, (F.col("value") - F.col("_m")) / s).otherwise(F.col("value") - F.col("_m"))).drop("_m", "_s")


def rescale_const(voxels: DataFrame, low: float = -5.0, high: float = 20.0, group: str = "volume_id") -> DataFrame:
    """(value - low) / (high - low); 0 throughout a constant volume. NaN counts as low."""
    v = voxels.withColumn("value", S.nan_to(F.col("value").cast("double"), low))
    v = _with(v, F.min("value").alias("_a"), F.max("value").alias("_b"), group=group)
    return v.withColumn("value", F.when(F.col("_b") > F.col("_a"), S.rescale(F.col("value"), low, high)).otherwise(F.lit(0.0))).drop("_a", "_b")


def binarize_midrange(voxels: DataFrame, group: str = "volume_id") -> DataFrame:
    """Whether each value is over the middle of its volume's range, as mask."""
    v = _with(voxels, F.min("value").alias("_a"), F.max("value").alias("_b"), group=group)
    return v.withColumn("mask", F.col("value") > (F.col("_a") + F.col("_b")) / 2).drop("_a", "_b")


def stats(voxels: DataFrame, group: str = "volume_id") -> DataFrame:
    """Minimum, maximum, sum, mean, standard deviation, median, count and non-zero count of each volume."""
    return voxels.groupBy(group).agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.sum("value").alias("sum"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.expr("percentile(value, 0.5d)").alias("median"),
        F.count("value").alias("n"),
        F.count_if(F.col("value") != 0).alias("n_nonzero"),
    )


def range_ok(voxels: DataFrame, group: str = "volume_id") -> DataFrame:
    """Whether each volume spans exactly [0, 1]."""
    return voxels.groupBy(group).agg(((F.min("value") == 0) & (F.max("value") == 1)).alias("ok"))
