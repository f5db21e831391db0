"""Neighbourhood operators on voxels in relational form.

They go along one axis at a time, by a window over each line of voxels, whose
frame is no wider than the stencil: there are as many lines as voxels over
their length, so no partition grows with the volume, and a row carries its
neighbours, never its line. Volumes must be dense along their axes. Votes and
shifted sums are sent to where they go and are aggregated there.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_divide
from ..model import AXES


def _line(axis: str) -> Window:
    return Window.partitionBy("volume_id", *[a for a in AXES if a != axis]).orderBy(axis)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def correlate(voxels: DataFrame, axis: str, size: int, weights: Sequence[float], value: str = "value", out: str | None = None) -> DataFrame:
    """Weighted sum of a voxel's neighbours along an axis, mirrored at the edges with the edge repeated.

    The frame of each voxel holds its neighbours in order, so that a mirrored
    place is an index into it; volumes must be dense along the axis.
    """
    r = len(weights) // 2
    near = F.collect_list(value).over(_line(axis).rowsBetween(-r, r))
    c = F.col(axis)
    first = F.greatest(c - r, F.lit(0))
    total = None
    for k, w in zip(range(-r, r + 1), weights):
        if w == 0:
            continue
        q = F.pmod(c + k, F.lit(2 * size))
        at = F.when(q < size, q).otherwise(F.lit(2 * size - 1) - q) - first
        term = F.get(F.col("_near"), at.cast("int")) * F.lit(float(w))
        total = term if total is None else total + term
    return voxels.withColumn("_near", near).withColumn(out or value, total).drop("_near")


def gaussian(voxels: DataFrame, shape: Sequence[int], sigma: float) -> DataFrame:
    out = voxels
    w = gaussian_weights(sigma)
    for a, n in zip(AXES, shape):
        if n > 1:
            out = correlate(out, a, n, w)
    return out


def smooth_threshold(voxels: DataFrame, shape: Sequence[int], threshold: float = 0.4, times: int = 2, sigma: float = 1.0) -> DataFrame:
    """Smooths a mask (value 0 or 1) and thresholds it, repeatedly: specks go."""
    out = voxels
    for _ in range(times):
        out = gaussian(out, shape, sigma).withColumn("value", F.when(F.col("value") > threshold, 1.0).otherwise(0.0))
    return out


def masks(voxels: DataFrame, shape: Sequence[int], sigma: float = 3.0, threshold: float = 0.4) -> DataFrame:
    """Masks from images: over the middle of the volume's range, smoothed and thresholded again. A constant volume is empty."""
    from .normalize import binarize_midrange

    m = binarize_midrange(voxels).withColumn("value", F.col("mask").cast("double")).drop("mask")
    return gaussian(m, shape, sigma).withColumn("mask", F.col("value") > threshold).drop("value")


def sobel(voxels: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Adds gz, gy, gx: differences along an axis, smoothed by 1 2 1 along the others."""
    out = voxels
    for axis in AXES:
        name = f"g{axis}"
        out = out.withColumn(name, F.col("value"))
        for a, n in zip(AXES, shape):
            out = correlate(out, a, n, [-1, 0, 1] if a == axis else [1, 2, 1], name)
    return out


def _extreme(voxels: DataFrame, value: str, side: int, greatest: bool) -> DataFrame:
    """The largest (least) value in a cube of the side around each voxel, as ``_e``; what is outside the volume does not count."""
    f = F.max if greatest else F.min
    out = voxels.withColumn("_e", F.col(value))
    for a in AXES:
        out = out.withColumn("_e", f("_e").over(_line(a).rangeBetween(-side, side)))
    return out


def local_maxima(voxels: DataFrame, half: int) -> DataFrame:
    """Voxels whose value is the largest within ``half`` of them along each axis, and positive; ties all count."""
    return _extreme(voxels, "value", half, True).filter((F.col("value") == F.col("_e")) & (F.col("value") > 0)).drop("_e")


def local_minima(voxels: DataFrame, half: int) -> DataFrame:
    """Foreground voxels (value > 0) whose value is least within ``half``; background counts as infinite."""
    v = voxels.withColumn("_v", F.when(F.col("value") > 0, F.col("value")).otherwise(F.lit(float("inf"))))
    return _extreme(v, "_v", half, False).filter((F.col("_v") == F.col("_e")) & (F.col("value") > 0)).drop("_e", "_v")


def shifted_sum(voxels: DataFrame, kernel: Sequence[tuple], size: Sequence[int], where: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Sum of neighbours by (dz, dy, dx, weight), zero outside: each voxel is sent to where it is needed, and sums are made before the shuffle as well.

    Weights are numbers or columns. Where ``where`` does not hold a voxel keeps
    its value. Columns of ``keep`` are the same in all of a volume, and stay.
    """
    offsets = F.array(*[F.struct(F.lit(a).alias("z"), F.lit(b).alias("y"), F.lit(c).alias("x"), (w if isinstance(w, Column) else F.lit(float(w))).alias("w")) for a, b, c, w in kernel if isinstance(w, Column) or w])
    if where is not None:
        offsets = F.when(where, offsets).otherwise(F.array(F.struct(F.lit(0).alias("z"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(1.0).alias("w"))))
    sent = voxels.select("volume_id", *AXES, "value", *keep, F.explode(offsets).alias("o"))
    to = sent.select("volume_id", *[(F.col(a) - F.col(f"o.{a}")).alias(a) for a in AXES], *keep, (F.col("value") * F.col("o.w")).alias("value"))
    for a, n in zip(AXES, size):
        to = to.filter((F.col(a) >= 0) & (F.col(a) < n))
    return to.groupBy("volume_id", *AXES, *keep).agg(F.sum("value").alias("value"))


PLANES = [("z", "y"), ("z", "x"), ("y", "x")]


def motion_kernel(angle: float, plane: tuple[str, str] = ("y", "x"), side: int = 3) -> list[tuple[int, int, int, float]]:
    """Weights of a blur in the direction of an angle (degrees) within a plane, its first axis being that of 0 degrees: length of the offset's components along it, normalised; the centre has none."""
    r = side // 2
    along = dict.fromkeys(AXES, 0.0)
    along[plane[0]], along[plane[1]] = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    d = [along[a] for a in AXES]
    found = [(z, y, x, math.sqrt((d[0] * z) ** 2 + (d[1] * y) ** 2 + (d[2] * x) ** 2)) for z in range(-r, r + 1) for y in range(-r, r + 1) for x in range(-r, r + 1)]
    return _normal(found)


def motion_kernel_2d(side: int = 3) -> list[tuple[int, int, int, float]]:
    """Weights for images of one layer: the distance from the centre, which a turn by any angle leaves as it is."""
    r = side // 2
    return _normal([(0, y, x, math.hypot(y, x)) for y in range(-r, r + 1) for x in range(-r, r + 1)])


def _normal(kernel: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    total = sum(w for *_, w in kernel)
    return [(z, y, x, w / total) for z, y, x, w in kernel]


def neighbours(step: int = 1) -> list[tuple[int, int, int]]:
    """The 26 offsets, z slowest."""
    s = (-step, 0, step)
    return [(z, y, x) for z in s for y in s for x in s if (z, y, x) != (0, 0, 0)]


SINK = 255


def steepest_descent(voxels: DataFrame, step: int = 1) -> DataFrame:
    """Adds direction: the number (in neighbours()) of the steepest way down, the first of equal ones, SINK where there is none.

    Three passes give each voxel its neighbours along x, those of these along
    y, and those along z; volumes must be dense.
    """
    near = F.col("value")
    out = voxels.select("volume_id", *AXES, "value")
    for a in reversed(AXES):
        line = _line(a)
        sides = [F.first("_near").over(line.rangeBetween(k, k)) for k in (-step, 0, step)]
        out = out.withColumn("_near", near).withColumn("_near", F.struct(*[x.alias(n) for x, n in zip(sides, "abc")]))
        near = F.col("_near")
    name = {-step: "a", 0: "b", step: "c"}
    options = []
    for k, (z, y, x) in enumerate(neighbours(step)):
        value = F.col(f"_near.{name[z]}.{name[y]}.{name[x]}")
        slope = (F.col("value") - value) / math.sqrt(z * z + y * y + x * x)
        options.append(F.when(slope > 0, F.struct(slope.alias("s"), F.lit(-k).alias("k"))))
    best = F.array_max(F.array(*options))
    return out.withColumn("direction", F.coalesce(-best["k"], F.lit(SINK)).cast("int")).drop("_near")


def _votes(voxels: DataFrame, shape: Sequence[int], radii: Sequence[float]) -> DataFrame:
    """(volume_id, r, z, y, x, value): votes of each radius, 0 where there are none; gradients are worked out once for all."""
    g = sobel(voxels, shape)
    norm = F.sqrt(F.col("gz") ** 2 + F.col("gy") ** 2 + F.col("gx") ** 2)
    on = g.withColumn("_n", norm).filter(F.col("_n") > 1e-8)
    vote = lambda s, r: F.struct(F.lit(float(r)).alias("r"), *[F.rint(F.col(a) + s * r * F.col(f"g{a}") / F.col("_n")).cast("int").alias(a) for a in AXES], F.lit(s).alias("w"))
    cast = on.select("volume_id", F.explode(F.array(*[vote(s, r) for r in radii for s in (1, -1)])).alias("v")).select("volume_id", "v.*")
    for a, n in zip(AXES, shape):
        cast = cast.filter((F.col(a) >= 0) & (F.col(a) < n))
    votes = cast.groupBy("volume_id", "r", *AXES).agg(F.sum("w").cast("double").alias("value"))
    grid = voxels.select("volume_id", F.explode(F.array(*[F.lit(float(r)) for r in radii])).alias("r"), *AXES)
    return grid.join(votes, ["volume_id", "r", *AXES], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def symmetry_votes(voxels: DataFrame, shape: Sequence[int], radius: float = 5) -> DataFrame:
    """Votes for centres of symmetry: +1 a radius along each gradient, -1 a radius against it; halves are rounded to even."""
    return _votes(voxels, shape, [radius]).drop("r")


def multi_scale_symmetry(voxels: DataFrame, shape: Sequence[int], background: float = 0.05, radii: Sequence[float] = (7, 9, 11, 13), sigma: float = 0.5) -> DataFrame:
    """Smoothed votes of several radii, each scaled to [0, 1] within its volume, averaged; 0 where the voxel is background."""
    keyed = _votes(voxels, shape, radii).withColumn("_id", F.col("volume_id")).withColumn("volume_id", F.concat_ws("/", "volume_id", "r"))
    smooth = gaussian(keyed, shape, sigma)
    ends = smooth.groupBy("volume_id").agg(F.min("value").alias("_a"), F.max("value").alias("_b"))
    scaled = smooth.join(ends, "volume_id").withColumn("value", safe_divide(F.col("value") - F.col("_a"), F.col("_b") - F.col("_a")))
    mean = scaled.groupBy(F.col("_id").alias("volume_id"), *AXES).agg(F.avg("value").alias("sym"))
    both = voxels.join(mean, ["volume_id", *AXES])
    return both.withColumn("value", F.when(F.col("value") > background, F.col("sym")).otherwise(F.lit(0.0))).drop("sym")


def total_variation(voxels: DataFrame) -> DataFrame:
    """Mean absolute difference to the next voxel, along each axis and summed."""
    diffs = [F.avg(F.abs(F.col(f"_{a}") - F.col("value"))) for a in AXES]
    out = voxels
    for a in AXES:
        out = out.withColumn(f"_{a}", F.lead("value").over(_line(a)))
    return out.groupBy("volume_id").agg((F.coalesce(diffs[0], F.lit(0.0)) + F.coalesce(diffs[1], F.lit(0.0)) + F.coalesce(diffs[2], F.lit(0.0))).alias("tv"))


def pool(voxels: DataFrame, side: int, how: str = "max") -> DataFrame:
    """Maximum or average over blocks."""
    f = {"max": F.max, "avg": F.avg}[how]
    return voxels.groupBy("volume_id", *[F.floor(F.col(a) / side).cast("int").alias(a) for a in AXES]).agg(f("value").alias("value"))


def patchify(voxels: DataFrame, side: int) -> DataFrame:
    """Blocks as arrays, z slowest: (volume_id, pz, py, px, patch)."""
    rank = F.col("z") % side * (side * side) + F.col("y") % side * side + F.col("x") % side
    cells = voxels.select("volume_id", *[F.floor(F.col(a) / side).cast("int").alias(f"p{a}") for a in AXES], F.struct(rank.alias("r"), "value").alias("c"))
    made = cells.groupBy("volume_id", "pz", "py", "px").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return made.select("volume_id", "pz", "py", "px", F.transform("c", lambda c: c.value).alias("patch"))


def shift(voxels: DataFrame, by: Sequence[int], shape: Sequence[int]) -> DataFrame:
    """Moves voxels; what leaves the volume is lost, what is empty then is 0."""
    moved = voxels.withColumns({a: F.col(a) + d for a, d in zip(AXES, by)}).select("volume_id", *AXES, F.col("value").alias("_v"))
    return voxels.select("volume_id", *AXES).join(moved, ["volume_id", *AXES], "left").select("volume_id", *AXES, F.coalesce("_v", F.lit(0.0)).alias("value"))


def axial_blur(voxels: DataFrame, shape: Sequence[int], sigma: float = 4.0) -> DataFrame:
    """A shift along the line of sight, as a blur."""
    return gaussian(voxels, shape, sigma)


def defocus(voxels: DataFrame, shape: Sequence[int], sigma: float = 6.0) -> DataFrame:
    """A focus out of place: a strong blur."""
    return gaussian(voxels, shape, sigma)


def synthetic_cell(spark: SparkSession, side: int = 128, sigma: float = 0.8) -> DataFrame:
    """An image of a cell, one layer: an ellipse of 0.6 with a round core of 1, slightly smoothed."""
    at = lambda c: F.col(c) * (2.0 / (side - 1)) - 1
    inside = lambda a, b: (at("x") / a) ** 2 + (at("y") / b) ** 2 < 1
    cells = spark.range(side * side).select(F.lit("cell").alias("volume_id"), F.lit(0).alias("z"), F.floor(F.col("id") / side).cast("int").alias("y"), (F.col("id") % side).cast("int").alias("x"))
    drawn = cells.withColumn("value", F.when(inside(0.2, 0.2), 1.0).when(inside(0.6, 0.4), 0.6).otherwise(0.0))
    return gaussian(drawn, (1, side, side), sigma)


def spherical(voxels: DataFrame, shape: Sequence[int], sigma: float = 4.0) -> DataFrame:
    """A spherical aberration: the image, with its smoothed edges added and sharp edges taken off, clipped to [0, 1]."""
    g = sobel(voxels, shape)
    edge = g.withColumn("_img", F.col("value")).withColumn("value", F.sqrt(F.col("gz") ** 2 + F.col("gy") ** 2 + F.col("gx") ** 2)).drop("gz", "gy", "gx")
    edge = edge.withColumn("_edge", F.col("value"))
    blurred = gaussian(edge, shape, sigma)
    v = F.col("_img") + 0.8 * F.col("value") - 0.3 * F.col("_edge")
    return blurred.withColumn("value", F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))).drop("_img", "_edge")
