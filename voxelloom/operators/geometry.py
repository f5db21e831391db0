"""Padding, tiling, overlap-add, isometries and resampling, as maps of coordinates.

All of these send a voxel to the places where it is needed and work out the
new coordinates there; none needs a join of coordinates with coordinates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import AXES

Shape = tuple[int, int, int]


def padding_for(size: int, step: int, keep: int, tile: int) -> int:
    """Voxels to add along an axis so that kept centres of tiles cover it."""
    return size % step + 2 * (tile - keep)


def pad(voxels: DataFrame, shape: Shape, before: Shape, after: Shape, mode: str = "reflect", fill: float | None = None) -> DataFrame:
    """Pads each volume; the old voxel (0, 0, 0) comes to ``before``.

    ``reflect`` mirrors without repeating the edge, as far as it takes (any
    width); ``constant`` puts ``fill``. Each voxel is sent to all places whose
    mirror image it is, so nothing is joined.
    """
    kept = [c for c in voxels.columns if c not in AXES]
    out = voxels
    if mode == "constant":
        grid = out.select("volume_id").distinct()
        for a, n, b, e in zip(AXES, shape, before, after):
            out = out.withColumn(a, F.col(a) + b)
            grid = grid.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(n + b + e - 1))))
        value = [c for c in kept if c != "volume_id"]
        joined = grid.join(out, ["volume_id", *AXES], "left")
        return joined.select(*[F.coalesce(F.col(c), F.lit(fill).cast(voxels.schema[c].dataType)).alias(c) if c in value else F.col(c) for c in voxels.columns])
    for a, n, b, e in zip(AXES, shape, before, after):
        total, c = n + b + e, F.col(a)
        if n == 1:
            out = out.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
            continue
        period = 2 * (n - 1)
        # Places q in the padded axis with the mirror image c: q - b is c or -c, modulo the period.
        one = F.sequence(F.pmod(c + b, F.lit(period)), F.lit(total + period), F.lit(period))
        two = F.sequence(F.pmod(F.lit(b) - c, F.lit(period)), F.lit(total + period), F.lit(period))
        places = F.filter(F.array_union(one, two), lambda q: q < total)
        out = out.withColumn(a, F.explode(places.cast("array<int>")))
    return out.select(*voxels.columns)


def crop(voxels: DataFrame, low: Shape, high: Shape) -> DataFrame:
    """Voxels with low <= coordinate < high, shifted so that low is the origin."""
    out = voxels
    for a, lo, hi in zip(AXES, low, high):
        out = out.filter((F.col(a) >= lo) & (F.col(a) < hi))
    return out.withColumns({a: (F.col(a) - lo).cast("int") for a, lo in zip(AXES, low)})


def crop_around(voxels: DataFrame, centre: Shape, half: Shape) -> DataFrame:
    """The box [centre - half, centre + half) along each axis."""
    return crop(voxels, tuple(c - h for c, h in zip(centre, half)), tuple(c + h for c, h in zip(centre, half)))


def crops_around(voxels: DataFrame, centres: DataFrame, half: int) -> DataFrame:
    """A crop for each of many centres (volume_id, crop_id, cz, cy, cx); equal joins on coarse boxes, not a range join."""
    size = 2 * half
    boxes = centres
    for a in AXES:
        first = F.floor((F.col(f"c{a}") - half) / size).cast("int")
        boxes = boxes.withColumn(f"_b{a}", F.explode(F.array(first, first + 1)))
    cells = voxels.withColumns({f"_b{a}": F.floor(F.col(a) / size).cast("int") for a in AXES})
    joined = cells.join(boxes, ["volume_id", *[f"_b{a}" for a in AXES]])
    for a in AXES:
        d = F.col(a) - F.col(f"c{a}") + half
        joined = joined.filter((d >= 0) & (d < size))
    return joined.select("volume_id", "crop_id", *[(F.col(a) - F.col(f"c{a}") + half).cast("int").alias(a) for a in AXES], *[c for c in voxels.columns if c not in (*AXES, "volume_id")])


# ---- tiles


def tile_starts(size: int, keep: int, step: int, offset: int = 0) -> list[int]:
    return list(range(offset, size - keep + 1, step))


def tiles(spark: SparkSession, shape: Shape, keep: int, step: int, offset: int = 0) -> DataFrame:
    """(tile_id, tz, ty, tx): where the kept centre of each tile starts. tile_id counts x fastest."""
    counts = [len(tile_starts(n, keep, step, offset)) for n in shape]
    nz, ny, nx = counts
    i = F.col("id")
    return spark.range(nz * ny * nx).select(
        i.alias("tile_id"),
        (F.floor(i / (ny * nx)) * step + offset).cast("int").alias("tz"),
        (F.floor(i / nx) % ny * step + offset).cast("int").alias("ty"),
        (i % nx * step + offset).cast("int").alias("tx"),
    )


def _hits(a: str, n: int, keep: int, step: int, tile: int, offset: int) -> Column:
    """Starts of the centres of tiles along an axis that hold a coordinate.

    A tile begins a margin before its centre, though not before 0, and must end within the axis.
    """
    margin = (tile - keep) // 2
    starts = [s for s in tile_starts(n, keep, step, offset) if max(0, s - margin) + tile <= n]
    c = F.col(a)
    clamped = [s for s in starts if s < margin]
    found = F.filter(F.array(*[F.lit(s) for s in clamped]).cast("array<int>"), lambda s: c < tile)
    regular = [s for s in starts if s >= margin]
    if not regular:
        return found
    low = F.greatest(F.ceil((c + (margin - tile + 1 - regular[0])) / step), F.lit(0))
    high = F.least(F.floor((c + (margin - regular[0])) / step), F.lit(len(regular) - 1))
    more = F.when(low <= high, F.transform(F.sequence(low, high), lambda k: (k * step + regular[0]).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.concat(found, more)


def extract_tiles(voxels: DataFrame, shape: Shape, tile: int, keep: int, step: int, offset: int = 0) -> DataFrame:
    """Every voxel of every whole tile: tz ty tx (start of its centre), iz iy ix (place within it). Tiles that stick out are left out."""
    out, margin = voxels, (tile - keep) // 2
    for a, n in zip(AXES, shape):
        out = out.withColumn(f"t{a}", F.explode(_hits(a, n, keep, step, tile, offset)))
    return out.withColumns({f"i{a}": (F.col(a) - F.greatest(F.col(f"t{a}") - margin, F.lit(0))).cast("int") for a in AXES})


def feather(i: Sequence[Column], tile: int) -> Column:
    """Weight of a place in a tile: its distance to the tile's border layer, by the largest such distance."""
    most = (tile - 1) // 2
    d = F.least(*[F.least(c, F.lit(tile - 1) - c) for c in i])
    return d / F.lit(float(most)) if most else F.lit(0.0)


def overlap_add(tiled: DataFrame, tile: int, value: str = "value") -> DataFrame:
    """Weighted average of the tiles that hold a voxel; 0 where all weights are 0."""
    w = feather([F.col(f"i{a}") for a in AXES], tile)
    total, weight = F.sum(w * F.col(value)), F.sum(w)
    return tiled.groupBy("volume_id", *AXES).agg(F.when(weight > 0, total / weight).otherwise(F.lit(0.0)).alias("value"))


def centre_average(tiled: DataFrame, keep: int, value: str = "value") -> DataFrame:
    """Average over the kept centres of the tiles that hold a voxel; voxels in no centre are left out."""
    inside = [(F.col(a) >= F.col(f"t{a}")) & (F.col(a) < F.col(f"t{a}") + keep) for a in AXES]
    return tiled.filter(inside[0] & inside[1] & inside[2]).groupBy("volume_id", *AXES).agg(F.avg(value).alias("value"))


def tile_norm(tiled: DataFrame, low: float = 1.0, high: float = 99.9) -> DataFrame:
    """Percentile normalisation within each tile."""
    from .normalize import clip_norm

    named = tiled.withColumn("_tile", F.concat_ws("/", "volume_id", "tz", "ty", "tx"))
    return clip_norm(named, low, high, group="_tile").drop("_tile")


# ---- isometries


def rot90(voxels: DataFrame, plane: tuple[str, str], k: int, shape: Shape) -> DataFrame:
    """Quarter turns in a plane of axes, k times, as arrays are turned from the first axis to the second."""
    a, b = plane
    n = dict(zip(AXES, shape))
    i, j = F.col(a), F.col(b)
    k %= 4
    new = {0: (i, j), 1: (F.lit(n[b] - 1) - j, i), 2: (F.lit(n[a] - 1) - i, F.lit(n[b] - 1) - j), 3: (j, F.lit(n[a] - 1) - i)}[k]
    return voxels.withColumns({a: new[0].cast("int"), b: new[1].cast("int")})


def flip(voxels: DataFrame, axes: Sequence[str], shape: Shape) -> DataFrame:
    n = dict(zip(AXES, shape))
    return voxels.withColumns({a: (F.lit(n[a] - 1) - F.col(a)).cast("int") for a in axes})


#: The turns that augmentation draws from: none, and one to three quarter turns in each plane.
TURNS = [(None, 0)] + [(p, k) for p in (("y", "x"), ("z", "x"), ("z", "y")) for k in (1, 2, 3)]


def random_isometry(voxels: DataFrame, shape: Shape, seed: int, flips: bool = True) -> DataFrame:
    """Turns and flips each volume at random by its id and the seed; columns other than coordinates move along.

    Adds ``turn`` (place in TURNS) and ``flipped`` (axes). Volumes must be
    cubes if turns are to keep their shape.
    """
    from .sampling import below

    draw = lambda n, salt: below(n, "volume_id", F.lit(seed), F.lit(salt))
    out = voxels.withColumn("turn", draw(len(TURNS), 0))
    n = dict(zip(AXES, shape))
    new = {a: F.col(a) for a in AXES}
    for t, (plane, k) in enumerate(TURNS):
        if plane is None:
            continue
        a, b = plane
        i, j = F.col(a), F.col(b)
        to = {1: (n[b] - 1 - j, i), 2: (n[a] - 1 - i, n[b] - 1 - j), 3: (j, n[a] - 1 - i)}[k]
        for c, x in zip((a, b), to):
            new[c] = F.when(F.col("turn") == t, x).otherwise(new[c])
    out = out.withColumns({a: new[a].cast("int") for a in AXES})
    if not flips:
        return out
    on = {a: draw(2, s) == 1 for s, a in enumerate(AXES, 1)}
    out = out.withColumn("flipped", F.array_compact(F.array(*[F.when(on[a], F.lit(a)) for a in AXES])))
    return out.withColumns({a: F.when(on[a], F.lit(n[a] - 1) - F.col(a)).otherwise(F.col(a)).cast("int") for a in AXES})


# ---- resampling


def resize_nearest(voxels: DataFrame, shape: Shape, to: Shape) -> DataFrame:
    """Each new voxel gets the value of the old one that its centre falls in.

    Old voxels are sent to the new places they fill, so this works without a join.
    """
    out = voxels
    for a, n, m in zip(AXES, shape, to):
        c = F.col(a)
        # New q has its centre at (q + 1/2) n / m; in whole numbers, (2 q + 1) n // (2 m) == c.
        low = F.greatest(F.ceil((c * (2 * m) - n) / (2 * n)), F.lit(0))
        high = F.least(F.ceil(((c + 1) * (2 * m) - n) / (2 * n)) - 1, F.lit(m - 1))
        out = out.withColumn(f"_{a}", F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")))
    for a in AXES:
        out = out.withColumn(a, F.explode(F.col(f"_{a}").cast("array<int>"))).drop(f"_{a}")
    return out


def resize_linear(voxels: DataFrame, shape: Shape, to: Shape) -> DataFrame:
    """Separable linear interpolation at the new centres, edges extended; one axis after another, each a sum over contributions."""
    out = voxels
    for a, n, m in zip(AXES, shape, to):
        if n == m:
            continue
        c = F.col(a)
        at = _centre(n, m)
        reach = int(m / n) + 2
        first = F.floor((c - 0.5) * m / n - 0.5).cast("int") - 1
        near = F.sequence(F.greatest(first, F.lit(0)), F.least(first + 2 * reach + 4, F.lit(m - 1)))
        places = F.filter(near, _within_one(at, c))
        moved = out.withColumn("_q", F.explode(places)).withColumn("_w", 1 - F.abs(at(F.col("_q")) - c))
        keys = ["volume_id", *[F.col("_q").cast("int").alias(a) if x == a else F.col(x) for x in AXES]]
        out = moved.groupBy(*keys).agg(F.sum(F.col("value") * F.col("_w")).alias("value"))
    return out


def _centre(n: int, m: int) -> Callable[[Column], Column]:
    """Where the centre of new place q of m lies among n old ones, kept within them."""
    return lambda q: F.least(F.greatest((q + 0.5) * n / m - 0.5, F.lit(0.0)), F.lit(float(n - 1)))


def _within_one(at: Callable[[Column], Column], c: Column) -> Callable[[Column], Column]:
    return lambda q: F.abs(at(q) - c) < 1
