"""Normalisation, geometry, stencils, whole-volume operators, layers, files, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..model import AXES, Config
from ..operators import geometry as G
from ..operators import inference as I
from ..operators import layers as Y
from ..operators import normalize as N
from ..operators import sampling as R
from ..operators import stencil as K
from ..operators import volume_udf as U
from ..sources import files
from .registry import drawn, plain, query, rounded
from .volumes import LA_SQL, SHAPE, V1_SQL, V2_SQL, la, sql_grid, table, v1, v2

_V2 = f"WITH {V2_SQL}"
_V1 = f"WITH {V1_SQL}"

# ---- normalisation

_NORM = "round(CASE WHEN b > a THEN (value - a) / (b - a) ELSE b END, 6) + 0.0 AS value"


def _clipped(low: float, high: float) -> str:
    return f"""{_V2}, q AS (SELECT volume_id, quantile_cont(value, {low}) AS lo, quantile_cont(value, {high}) AS hi FROM v GROUP BY volume_id),
        k AS (SELECT volume_id, z, y, x, least(greatest(value, lo), hi) AS value FROM v JOIN q USING (volume_id)),
        r AS (SELECT volume_id, min(value) AS a, max(value) AS b FROM k GROUP BY volume_id)"""


@query(f"{_clipped(0.01, 0.999)} SELECT volume_id, z, y, x, {_NORM} FROM k JOIN r USING (volume_id)")
def clip_norm_01(spark, sf):
    return plain(rounded(N.clip_norm(v2(spark, sf), 1.0, 99.9), "value"))


@query(f"""{_V2}, r AS (SELECT volume_id, min(value) AS a, max(value) AS b FROM v GROUP BY volume_id)
    SELECT volume_id, z, y, x, round(2 * (CASE WHEN b > a THEN (value - a) / (b - a) ELSE b END) - 1, 6) + 0.0 AS value FROM v JOIN r USING (volume_id)""")
def preprocess_pm1(spark, sf):
    return plain(rounded(N.preprocess(v2(spark, sf)), "value"))


@query(f"{_V2}, r AS (SELECT volume_id, avg(value) AS m, stddev_pop(value) AS s FROM v GROUP BY volume_id) SELECT volume_id, z, y, x, round(CASE WHEN s > 0 THEN (value - m) / s ELSE value - m END, 6) + 0.0 AS value FROM v JOIN r USING (volume_id)")
def zscore(spark, sf):
    return plain(rounded(N.zscore(v2(spark, sf)), "value"))


@query(f"""{_V2}, n AS (SELECT volume_id, z, y, x, CASE WHEN (z + y + x) % 7 = 0 THEN -5.0 ELSE value * 10 END AS value FROM v), r AS (SELECT volume_id, min(value) AS a, max(value) AS b FROM n GROUP BY volume_id)
    SELECT volume_id, z, y, x, round(CASE WHEN b > a THEN (value + 5) / 25 ELSE 0.0 END, 6) + 0.0 AS value FROM n JOIN r USING (volume_id)""")
def rescale_const(spark, sf):
    """NaN (here where z + y + x is a multiple of seven) counts as the low value."""
    v = v2(spark, sf).withColumn("value", F.when((F.col("z") + F.col("y") + F.col("x")) % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value") * 10))
    return plain(rounded(N.rescale_const(v), "value"))


@query(f"{_V2}, r AS (SELECT volume_id, (min(value) + max(value)) / 2 AS m FROM v GROUP BY volume_id) SELECT volume_id, z, y, x, value > m AS mask FROM v JOIN r USING (volume_id)")
def binarize_midrange(spark, sf):
    return plain(N.binarize_midrange(v2(spark, sf)).drop("value"))


@query(f"""{_V2} SELECT volume_id, round(min(value), 6) AS min, round(max(value), 6) AS max, round(sum(value), 6) AS sum, round(avg(value), 6) AS mean,
    round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS median, count(*) AS n, count(*) FILTER (value <> 0) AS n_nonzero FROM v GROUP BY volume_id""")
def volume_stats(spark, sf):
    return rounded(N.stats(v2(spark, sf)), "min", "max", "sum", "mean", "std", "median")


@query(f"{_V2} SELECT volume_id, min(value) = 0 AND max(value) = 1 AS ok FROM v GROUP BY volume_id")
def range_check(spark, sf):
    return N.range_ok(v2(spark, sf))


@query(f"{_V2} SELECT volume_id, z, y, x, round(least(greatest(value, -0.1), 0.1), 6) + 0.0 AS value FROM v WHERE value > -0.2")
def threshold_clip(spark, sf):
    v = v2(spark, sf).filter("value > -0.2")
    return plain(rounded(v.withColumn("value", S.clip(F.col("value"), F.lit(-0.1), F.lit(0.1))), "value"))


@query("SELECT p_partkey, round(CASE WHEN abs(p_size - 10) > 1e-10 THEN p_retailprice / (p_size - 10) ELSE 0.0 END, 6) + 0.0 AS q FROM part")
def safe_divide(spark, sf):
    p = table(spark, sf, "part")
    return rounded(p.select("p_partkey", S.safe_divide(F.col("p_retailprice"), (F.col("p_size") - 10).cast("double")).alias("q")), "q")


@query("SELECT vec_id, len(list_filter(embedding, lambda v: v > 0.3)) > 0 AS found FROM embeddings")
def any_nonzero(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", S.has_nonzero(F.transform("embedding", lambda v: (v > 0.3).cast("int"))).alias("found"))


# ---- geometry


def _pad_sql(mode: str) -> str:
    nz, ny, nx = (n + b + a for n, b, a in zip(SHAPE, (10, 3, 0), (9, 20, 5)))
    source = ", ".join(f"{n - 1} - abs({n - 1} - ((({a} - {b}) % {2 * (n - 1)}) + {2 * (n - 1)}) % {2 * (n - 1)}) AS s{a}" for a, n, b in zip(AXES, SHAPE, (10, 3, 0)))
    grid = f"{_V1}, {sql_grid((nz, ny, nx), 'w')}"
    if mode == "reflect":
        return f"{grid}, s AS (SELECT *, {source} FROM w) SELECT volume_id, s.z, s.y, s.x, value FROM s JOIN v ON v.z = sz AND v.y = sy AND v.x = sx"
    return f"{grid} SELECT 'v1' AS volume_id, w.z, w.y, w.x, coalesce(value, -100.0) AS value FROM w LEFT JOIN v ON v.z = w.z - 10 AND v.y = w.y - 3 AND v.x = w.x"


@query(_pad_sql("reflect"))
def pad_reflect(spark, sf):
    return plain(G.pad(v1(spark, sf), SHAPE, (10, 3, 0), (9, 20, 5)))


@query(_pad_sql("constant"))
def pad_constant(spark, sf):
    return plain(G.pad(v1(spark, sf), SHAPE, (10, 3, 0), (9, 20, 5), "constant", -100.0))


@query("SELECT p_partkey, CAST(p_size * 7 % 32 + 2 * (64 - 32) AS INTEGER) AS pad FROM part")
def compute_padding(spark, sf):
    size = F.col("p_size") * 7
    return table(spark, sf, "part").select("p_partkey", (size % 32 + G.padding_for(0, 32, 32, 64)).cast("int").alias("pad"))


_STARTS = "(SELECT unnest(range(0, 97, 16))) AS a(tz), (SELECT unnest(range(0, 33, 16))) AS b(ty), (SELECT unnest(range(0, 65, 16))) AS c(tx)"


@query(f"SELECT row_number() OVER (ORDER BY tz, ty, tx) - 1 AS tile_id, CAST(tz AS INTEGER) AS tz, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx FROM {_STARTS}")
def tile_enumerate(spark, sf):
    return G.tiles(spark, (128, 64, 96), 32, 16)


TILE, KEEP, STEP = 8, 4, 4
_AXIS = lambda a, n: f"(SELECT CAST(unnest(range(0, {n - KEEP + 1}, {STEP})) AS INTEGER) AS t{a}) AS s{a}"
_TILED = f"""{_V1}, tiled AS (SELECT volume_id, z, y, x, value, tz, ty, tx, {', '.join(f'CAST({a} - greatest(t{a} - 2, 0) AS INTEGER) AS i{a}' for a in AXES)}
    FROM v, {', '.join(_AXIS(a, n) for a, n in zip(AXES, SHAPE))}
    WHERE {' AND '.join(f'greatest(t{a} - 2, 0) + {TILE} <= {n} AND {a} >= greatest(t{a} - 2, 0) AND {a} < greatest(t{a} - 2, 0) + {TILE}' for a, n in zip(AXES, SHAPE))})"""
_WEIGHT = "least(iz, 7 - iz, iy, 7 - iy, ix, 7 - ix) / 3.0::DOUBLE"


def _tiled(spark, sf):
    return G.extract_tiles(v1(spark, sf), SHAPE, TILE, KEEP, STEP)


@query(f"{_TILED} SELECT volume_id, z, y, x, value, tz, ty, tx, iz, iy, ix FROM tiled")
def tile_extract(spark, sf):
    return plain(_tiled(spark, sf))


@query(f"WITH {sql_grid((8, 8, 8), 'w')} SELECT z AS iz, y AS iy, x AS ix, round(least(z, 7 - z, y, 7 - y, x, 7 - x) / 3.0::DOUBLE, 6) AS w FROM w")
def feather_weights(spark, sf):
    from .volumes import grid

    g = grid(spark, (8, 8, 8)).select(*[F.col(a).alias(f"i{a}") for a in AXES])
    return rounded(g.withColumn("w", G.feather([F.col(f"i{a}") for a in AXES], 8)), "w")


_PREDICTED = "value + tz + 2 * ty"


@query(f"""{_TILED}, w AS (SELECT *, {_WEIGHT} AS w, {_PREDICTED} AS p FROM tiled)
    SELECT volume_id, z, y, x, round(CASE WHEN sum(w) > 0 THEN sum(w * p) / sum(w) ELSE 0.0 END, 6) AS value FROM w GROUP BY ALL""")
def overlap_add(spark, sf):
    t = _tiled(spark, sf).withColumn("value", F.expr(_PREDICTED))
    return rounded(G.overlap_add(t, TILE), "value")


@query(f"""{_TILED} SELECT volume_id, z, y, x, round(avg({_PREDICTED}), 6) AS value FROM tiled
    WHERE {' AND '.join(f'{a} >= t{a} AND {a} < t{a} + {KEEP}' for a in AXES)} GROUP BY ALL""")
def center_keep(spark, sf):
    t = _tiled(spark, sf).withColumn("value", F.expr(_PREDICTED))
    return rounded(G.centre_average(t, KEEP), "value")


@query(f"""{_TILED}, q AS (SELECT tz, ty, tx, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.999) AS hi FROM tiled GROUP BY ALL),
    k AS (SELECT *, least(greatest(value, lo), hi) AS c FROM tiled JOIN q USING (tz, ty, tx)), r AS (SELECT tz, ty, tx, min(c) AS a, max(c) AS b FROM k GROUP BY ALL)
    SELECT volume_id, z, y, x, tz, ty, tx, iz, iy, ix, round(CASE WHEN b > a THEN (c - a) / (b - a) ELSE b END, 6) AS value FROM k JOIN r USING (tz, ty, tx)""")
def tile_normalize(spark, sf):
    return plain(rounded(G.tile_norm(_tiled(spark, sf)), "value"))


def _turn(plane, k):
    def run(spark, sf):
        return plain(G.rot90(v1(spark, sf), plane, k, SHAPE))

    a, b = plane
    n = dict(zip(AXES, SHAPE))
    # out[i, j] = v[source], as arrays are turned
    source = {1: (f"v.{a} = w.{b}", f"v.{b} = {n[b] - 1} - w.{a}"), 2: (f"v.{a} = {n[a] - 1} - w.{a}", f"v.{b} = {n[b] - 1} - w.{b}"), 3: (f"v.{a} = {n[a] - 1} - w.{b}", f"v.{b} = w.{a}")}[k]
    size = dict(n)
    if k % 2:
        size[a], size[b] = n[b], n[a]
    other = next(c for c in AXES if c not in plane)
    run.__name__ = f"rot90_{a}{b}_{k}"
    shape = tuple(size[c] for c in AXES)
    query(f"{_V1}, {sql_grid(shape, 'w')} SELECT volume_id, w.z, w.y, w.x, value FROM w JOIN v ON v.{other} = w.{other} AND {source[0]} AND {source[1]}")(run)


for _plane, _k in G.TURNS[1:]:
    _turn(_plane, _k)


@query(f"{_V1} SELECT volume_id, 7 - z AS z, y, 15 - x AS x, value FROM v")
def flip_axes(spark, sf):
    return plain(G.flip(v1(spark, sf), ["z", "x"], SHAPE))


def _isometry_sql() -> str:
    """Each new voxel's source: flips are undone, then the turn, by where the turned array has its cells from."""
    source = {1: "{b}, 3 - {a}", 2: "3 - {a}, 3 - {b}", 3: "3 - {b}, {a}"}
    cases: dict[str, list[str]] = {a: [] for a in AXES}
    for t, (a, b, k) in enumerate([(a, b, k) for a, b in (("y", "x"), ("z", "x"), ("z", "y")) for k in (1, 2, 3)], 1):
        for axis, place in zip((a, b), source[k].format(a=f"f{a}", b=f"f{b}").split(", ")):
            cases[axis].append(f"WHEN {t} THEN {place}")
    draws = ", ".join([f"floor({drawn('volume_id', '11', '0')} * 10)::INTEGER AS turn"] + [f"floor({drawn('volume_id', '11', str(k))} * 2) = 1 AS on{a}" for k, a in enumerate(AXES, 1)])
    flips = ", ".join(f"CASE WHEN on{a} THEN 3 - w.{a} ELSE w.{a} END AS f{a}" for a in AXES)
    back = ", ".join(f"CASE turn {' '.join(cases[a])} ELSE f{a} END AS s{a}" for a in AXES)
    return f"""{_V2}, {sql_grid((4, 4, 4), 'w')}, d AS (SELECT volume_id, {draws} FROM (SELECT DISTINCT volume_id FROM v)), f AS (SELECT *, {flips} FROM d, w), q AS (SELECT *, {back} FROM f)
        SELECT q.volume_id, q.z, q.y, q.x, value, turn, {' || '.join(f"CASE WHEN on{a} THEN '{a}' ELSE '' END" for a in AXES)} AS flipped
        FROM q JOIN v ON v.volume_id = q.volume_id AND v.z = sz AND v.y = sy AND v.x = sx"""


@query(_isometry_sql())
def random_isometry(spark, sf):
    return G.random_isometry(v2(spark, sf), (4, 4, 4), 11).withColumn("flipped", F.array_join("flipped", ""))


@query(f"{_V1} SELECT volume_id, z, y, x, round((value * (x + 1) + 2 * value * (y + 1) + 2 * value * (16 - x) + 2 * value * (16 - y)) / 7, 6) AS value FROM v")
def tta_average(spark, sf):
    """Averaged over turns: a model that weighs values by their column."""
    return rounded(I.tta_rows(v1(spark, sf), SHAPE, lambda v: v.withColumn("value", F.col("value") * (F.col("x") + 1))), "value")


@query(f"""{_V1}, {sql_grid((6, 20, 12), 'w')} SELECT volume_id, w.z, w.y, w.x, value FROM w
    JOIN v ON v.z = (2 * w.z + 1) * 8 // 12 AND v.y = (2 * w.y + 1) * 16 // 40 AND v.x = (2 * w.x + 1) * 16 // 24""")
def resize_nearest(spark, sf):
    return plain(G.resize_nearest(v1(spark, sf), SHAPE, (6, 20, 12)))


def _linear_sql() -> str:
    at = lambda a, n, m: f"least(greatest((w.{a} + 0.5::DOUBLE) * {n} / {m} - 0.5, 0), {n - 1})"
    d = {a: f"abs({at(a, n, m)} - v.{a})" for a, n, m in zip(AXES, SHAPE, (6, 20, 12))}
    weight = " * ".join(f"(1 - {x})" for x in d.values())
    return f"""{_V1}, {sql_grid((6, 20, 12), 'w')} SELECT volume_id, w.z, w.y, w.x, round(sum(value * {weight}), 6) AS value FROM w, v
        WHERE {' AND '.join(f'{x} < 1' for x in d.values())} GROUP BY ALL"""


@query(_linear_sql())
def resize_linear(spark, sf):
    return plain(rounded(G.resize_linear(v1(spark, sf), SHAPE, (6, 20, 12)), "value"))


@query(f"{_V1} SELECT volume_id, z - 2 AS z, y - 4 AS y, x - 5 AS x, value FROM v WHERE z >= 2 AND z < 6 AND y >= 4 AND y < 12 AND x >= 5 AND x < 11")
def crop_center(spark, sf):
    return plain(G.crop_around(v1(spark, sf), (4, 8, 8), (2, 4, 3)))


_CENTRES = [(0, 2, 5, 5), (1, 4, 8, 8), (2, 7, 15, 0), (3, 3, 9, 12)]


@query(f"""{_V1}, c(crop_id, cz, cy, cx) AS (VALUES {', '.join(map(str, _CENTRES))})
    SELECT volume_id, CAST(crop_id AS INTEGER) AS crop_id, {', '.join(f'CAST({a} - c{a} + 3 AS INTEGER) AS {a}' for a in AXES)}, value FROM v, c WHERE {' AND '.join(f'{a} >= c{a} - 3 AND {a} < c{a} + 3' for a in AXES)}""")
def crops_many(spark, sf):
    centres = spark.createDataFrame([("v1", *c) for c in _CENTRES], "volume_id string, crop_id int, cz int, cy int, cx int")
    return G.crops_around(v1(spark, sf), centres, 3)


# ---- stencils


def _weights(weights) -> str:
    """A table (k, w) of weights: given ones, or those of a Gaussian of a width, cut off at four of them."""
    if isinstance(weights, float):
        r = int(4 * weights + 0.5)
        return f"(SELECT k, exp(-0.5 * k * k / {weights * weights}::DOUBLE) / sum(exp(-0.5 * k * k / {weights * weights}::DOUBLE)) OVER () AS w FROM (SELECT unnest(range({-r}, {r + 1})) AS k)) AS k_"
    return f"(VALUES {', '.join(f'({k - len(weights) // 2}, {float(w)!r}::DOUBLE)' for k, w in enumerate(weights))}) AS k_(k, w)"


def _pass(src: str, out: str, axis: str, weights, value: str = "value", shape=SHAPE) -> str:
    """A CTE that correlates a column along an axis, mirrored with the edge repeated."""
    n = dict(zip(AXES, shape))[axis]
    m = f"(({src}.{axis} + k) % {2 * n} + {2 * n}) % {2 * n}"
    others = " AND ".join(f"q.{a} = {src}.{a}" for a in AXES if a != axis)
    return f"""{out} AS (SELECT {src}.z, {src}.y, {src}.x, sum(q.{value} * w) AS {value} FROM {src}, {_weights(weights)}, {src} AS q
        WHERE {others} AND q.{axis} = CASE WHEN {m} < {n} THEN {m} ELSE {2 * n - 1} - {m} END GROUP BY {src}.z, {src}.y, {src}.x)"""


def _passes(src: str, steps, value: str = "value") -> tuple[str, str]:
    """CTEs of several passes, and the name of the last."""
    parts, at = [], src
    for k, (axis, weights) in enumerate(steps):
        name = f"{src}_{value}_{k}"
        parts.append(_pass(at, name, axis, weights, value))
        at = name
    return ", ".join(parts), at


_SMOOTH, _LAST = _passes("v", [(a, 1.0) for a in AXES])


@query(f"{_V1}, {_SMOOTH} SELECT 'v1' AS volume_id, z, y, x, round(value, 6) AS value FROM {_LAST}")
def gauss_smooth(spark, sf):
    return plain(rounded(K.gaussian(v1(spark, sf), SHAPE, 1.0), "value"))


def _twice() -> str:
    one, a = _passes("m0", [(c, 1.0) for c in AXES])
    two, b = _passes("m1", [(c, 1.0) for c in AXES])
    return f"""WITH {LA_SQL}, m0 AS (SELECT z, y, x, CASE WHEN label > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS value FROM la), {one},
        m1 AS (SELECT z, y, x, CASE WHEN value > 0.4 THEN 1.0::DOUBLE ELSE 0.0 END AS value FROM {a}), {two}
        SELECT 'v1' AS volume_id, z, y, x, CASE WHEN value > 0.4 THEN 1.0::DOUBLE ELSE 0.0 END AS value FROM {b}"""


@query(_twice())
def twice_smooth_threshold(spark, sf):
    mask = la(spark, sf).select("volume_id", *AXES, F.when(F.col("label") > 0, 1.0).otherwise(0.0).alias("value"))
    return plain(K.smooth_threshold(mask, SHAPE))


def _masks_sql() -> str:
    more, last = _passes("b", [(a, 3.0) for a in AXES])
    return f"""{_V1}, b AS (SELECT z, y, x, CASE WHEN value > (SELECT (min(value) + max(value)) / 2 FROM v) THEN 1.0::DOUBLE ELSE 0.0 END AS value FROM v), {more}
        SELECT 'v1' AS volume_id, z, y, x, value > 0.4 AS mask FROM {last}"""


@query(_masks_sql())
def mask_images(spark, sf):
    return plain(K.masks(v1(spark, sf), SHAPE))


def _sobel_sql(of: str = "v") -> tuple[str, str]:
    parts, tables = [], []
    for axis in AXES:
        # each axis starts from a copy of the values under its own name
        parts.append(f"s{axis} AS (SELECT z, y, x, value AS g{axis} FROM {of})")
        more, last = _passes(f"s{axis}", [(a, [-1, 0, 1] if a == axis else [1, 2, 1]) for a in AXES], f"g{axis}")
        parts.append(more)
        tables.append(last)
    return ", ".join(parts), f"{tables[0]} JOIN {tables[1]} USING (z, y, x) JOIN {tables[2]} USING (z, y, x)"


_SOBEL, _GRADIENT = _sobel_sql()


@query(f"{_V1}, {_SOBEL} SELECT 'v1' AS volume_id, z, y, x, value, gz, gy, gx FROM v JOIN {_GRADIENT.replace(' JOIN', ' USING (z, y, x) JOIN', 1)}")
def sobel(spark, sf):
    return plain(K.sobel(v1(spark, sf), SHAPE))


_WINDOW = lambda f, a, v: f"{f}({v}) OVER (PARTITION BY {', '.join(c for c in AXES if c != a)} ORDER BY {a} RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


def _extreme_sql(f: str, value: str, keep: str) -> str:
    return f"""{_V1}, e0 AS (SELECT z, y, x, value, {value} AS u, {value} AS e FROM v), e1 AS (SELECT * REPLACE ({_WINDOW(f, 'z', 'e')} AS e) FROM e0),
        e2 AS (SELECT * REPLACE ({_WINDOW(f, 'y', 'e')} AS e) FROM e1), e3 AS (SELECT * REPLACE ({_WINDOW(f, 'x', 'e')} AS e) FROM e2)
        SELECT 'v1' AS volume_id, z, y, x, value FROM e3 WHERE u = e AND {keep}"""


@query(_extreme_sql("max", "value", "value > 0"))
def nms_max(spark, sf):
    return plain(K.local_maxima(v1(spark, sf), 2))


@query(_extreme_sql("min", "CASE WHEN value > 0 THEN value ELSE 'inf'::DOUBLE END", "value > 0"))
def nms_min(spark, sf):
    return plain(K.local_minima(v1(spark, sf), 2))


_CUBE = ", ".join(f"(SELECT unnest([-1, 0, 1]) AS d{a})" for a in AXES)


@query(f"""{_V1}, o AS (SELECT *, sqrt((cos(radians(30)) * dy) ** 2 + (sin(radians(30)) * dx) ** 2) AS w FROM {_CUBE}), k AS (SELECT dz, dy, dx, w / (SELECT sum(w) FROM o) AS w FROM o WHERE w > 0)
    SELECT 'v1' AS volume_id, v.z, v.y, v.x, round(sum(n.value * w), 6) AS value FROM v, k, v AS n WHERE n.z = v.z + dz AND n.y = v.y + dy AND n.x = v.x + dx GROUP BY ALL""")
def motion_blur(spark, sf):
    return plain(rounded(K.shifted_sum(v1(spark, sf), K.motion_kernel(30.0), SHAPE), "value"))


def _blur_sql() -> str:
    along = {"z": "CASE WHEN plane < 2 THEN cos(radians(angle)) ELSE 0 END", "y": "CASE plane WHEN 0 THEN sin(radians(angle)) WHEN 2 THEN cos(radians(angle)) ELSE 0 END", "x": "CASE WHEN plane > 0 THEN sin(radians(angle)) ELSE 0 END"}
    return f"""{_V2}, d AS (SELECT volume_id, {drawn('volume_id', '4', "'blur'")} < 0.2 AS hit, 1 + floor({drawn('volume_id', '4', "'angle'")} * 59)::INTEGER AS angle,
            floor({drawn('volume_id', '4', "'plane'")} * 3)::INTEGER AS plane FROM (SELECT DISTINCT volume_id FROM v)),
        o AS (SELECT volume_id, dz, dy, dx, sqrt({' + '.join(f'(({w}) * d{a}) ** 2' for a, w in along.items())}) AS w FROM d, {_CUBE} WHERE hit),
        k AS (SELECT volume_id, dz, dy, dx, w / sum(w) OVER (PARTITION BY volume_id) AS w FROM o),
        b AS (SELECT v.volume_id, v.z, v.y, v.x, sum(n.value * w) AS value FROM v JOIN k USING (volume_id) JOIN v AS n ON n.volume_id = v.volume_id AND n.z = v.z + dz AND n.y = v.y + dy AND n.x = v.x + dx GROUP BY ALL)
        SELECT v.volume_id, v.z, v.y, v.x, round(CASE WHEN hit THEN b.value ELSE v.value END, 6) + 0.0 AS value, CASE WHEN hit THEN angle END AS blur, CASE WHEN hit THEN plane END AS plane
        FROM v JOIN d USING (volume_id) LEFT JOIN b ON b.volume_id = v.volume_id AND b.z = v.z AND b.y = v.y AND b.x = v.x"""


@query(_blur_sql())
def motion_blur_augment(spark, sf):
    return plain(rounded(R.motion_blur(v2(spark, sf), (4, 4, 4), 4), "value"))


@query(f"""{_V1}, {_SOBEL}, gr AS (SELECT z, y, x, gz, gy, gx, sqrt(gz * gz + gy * gy + gx * gx) AS n FROM {_GRADIENT.replace(' JOIN', ' JOIN', 1)}),
    s(s) AS (VALUES (1), (-1)), c AS (SELECT s, {', '.join(f'CAST(round_even({a} + s * 5.0::DOUBLE * g{a} / n, 0) AS INTEGER) AS {a}' for a in AXES)} FROM gr, s WHERE n > 1e-8),
    t AS (SELECT z, y, x, CAST(sum(s) AS DOUBLE) AS value FROM c GROUP BY ALL)
    SELECT 'v1' AS volume_id, z, y, x, coalesce(value, 0.0) AS value FROM g LEFT JOIN t USING (z, y, x)""")
def vote_map(spark, sf):
    return plain(K.symmetry_votes(v1(spark, sf), SHAPE, 5))


def _symmetry_sql() -> str:
    parts, scaled = [], []
    for r in (7, 9, 11, 13):
        parts.append(f"""c{r} AS (SELECT s, {', '.join(f'CAST(round_even({a} + s * {r}.0::DOUBLE * g{a} / n, 0) AS INTEGER) AS {a}' for a in AXES)} FROM gr, s WHERE n > 1e-8),
            t{r} AS (SELECT g.z, g.y, g.x, coalesce(value, 0.0) AS value FROM g LEFT JOIN (SELECT z, y, x, CAST(sum(s) AS DOUBLE) AS value FROM c{r} GROUP BY ALL) USING (z, y, x))""")
        more, last = _passes(f"t{r}", [(a, 0.5) for a in AXES])
        parts.append(more)
        scaled.append(f"SELECT z, y, x, (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS value FROM {last}")
    return f"""{_V1}, {_SOBEL}, gr AS (SELECT z, y, x, gz, gy, gx, sqrt(gz * gz + gy * gy + gx * gx) AS n FROM {_GRADIENT}), s(s) AS (VALUES (1), (-1)), {', '.join(parts)},
        a AS (SELECT z, y, x, avg(value) AS sym FROM ({' UNION ALL '.join(scaled)}) GROUP BY ALL)
        SELECT volume_id, z, y, x, round(CASE WHEN value > 0.05 THEN sym ELSE 0.0 END, 6) AS value FROM v JOIN a USING (z, y, x)"""


@query(_symmetry_sql())
def multi_scale_symmetry(spark, sf):
    return plain(rounded(K.multi_scale_symmetry(v1(spark, sf), SHAPE), "value"))


@query(f"""{_V2}, d AS (SELECT volume_id, {', '.join(f'abs(lead(value) OVER (PARTITION BY volume_id, {", ".join(b for b in AXES if b != a)} ORDER BY {a}) - value) AS d{a}' for a in AXES)} FROM v)
    SELECT volume_id, round(avg(dz) + avg(dy) + avg(dx), 6) AS tv FROM d GROUP BY volume_id""")
def total_variation(spark, sf):
    return rounded(K.total_variation(v2(spark, sf)), "tv")


@query(f"{_V1} SELECT volume_id, z // 2 AS z, y // 2 AS y, x // 2 AS x, max(value) AS value FROM v GROUP BY ALL")
def max_pool(spark, sf):
    return K.pool(v1(spark, sf), 2)


@query(f"{_V1} SELECT volume_id, z // 4 AS z, y // 4 AS y, x // 4 AS x, round(avg(value), 6) AS value FROM v GROUP BY ALL")
def avg_pool(spark, sf):
    return rounded(K.pool(v1(spark, sf), 4, "avg"), "value")


@query(f"{_V1} SELECT volume_id, z // 2 AS pz, y // 2 AS py, x // 2 AS px, array_to_string(list(CAST(value AS BIGINT) ORDER BY z, y, x), ' ') AS patch FROM v GROUP BY ALL")
def patchify(spark, sf):
    p = K.patchify(v1(spark, sf), 2)
    return p.withColumn("patch", F.array_join(F.transform("patch", lambda v: v.cast("long").cast("string")), " "))


@query(f"{_V1} SELECT 'v1' AS volume_id, g.z, g.y, g.x, coalesce(value, 0.0) AS value FROM g LEFT JOIN v ON v.z = g.z AND v.y = g.y - 5 AND v.x = g.x - 3")
def lateral_shift(spark, sf):
    return plain(K.shift(v1(spark, sf), (0, 5, 3), SHAPE))


_NORM1 = f"""{_V1}, q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM v), c AS (SELECT z, y, x, least(greatest(value, lo), hi) AS value FROM v, q),
    u AS (SELECT z, y, x, (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS value FROM c)"""
_SOBEL_U, _GRADIENT_U = _sobel_sql("u")
_EDGES, _LAST_EDGE = _passes("e", [(a, 4.0) for a in AXES])


@query(f"""{_NORM1}, {_SOBEL_U}, e AS (SELECT z, y, x, sqrt(gz * gz + gy * gy + gx * gx) AS value FROM {_GRADIENT_U}), {_EDGES}
    SELECT 'v1' AS volume_id, z, y, x, round(least(greatest(u.value + 0.8 * b.value - 0.3 * e.value, 0.0), 1.0), 6) + 0.0 AS value FROM u JOIN e USING (z, y, x) JOIN {_LAST_EDGE} AS b USING (z, y, x)""")
def spherical_aberration(spark, sf):
    return plain(rounded(K.spherical(N.clip_norm(v1(spark, sf)), SHAPE), "value"))


_CELL_SMOOTH = ", ".join(_pass(a, b, c, 0.8, shape=(1, 128, 128)) for a, b, c in (("cell", "cell_y", "y"), ("cell_y", "cell_x", "x")))


@query(f"""WITH cell AS (SELECT 0 AS z, y, x, CASE WHEN (u / 0.2) ** 2 + (w / 0.2) ** 2 < 1 THEN 1.0::DOUBLE WHEN (u / 0.6) ** 2 + (w / 0.4) ** 2 < 1 THEN 0.6 ELSE 0.0 END AS value
    FROM (SELECT CAST(i // 128 AS INTEGER) AS y, CAST(i % 128 AS INTEGER) AS x, -1 + 2 * (i % 128) / 127.0::DOUBLE AS u, -1 + 2 * (i // 128) / 127.0::DOUBLE AS w FROM (SELECT unnest(range(16384)) AS i))), {_CELL_SMOOTH}
    SELECT 'cell' AS volume_id, z, y, x, round(value, 6) AS value FROM cell_x""")
def synthetic_cell(spark, sf):
    return plain(rounded(K.synthetic_cell(spark), "value"))


@query(f"{_NORM1}, {_passes('u', [(a, 6.0) for a in AXES])[0]} SELECT 'v1' AS volume_id, z, y, x, round(value, 6) AS value FROM {_passes('u', [(a, 6.0) for a in AXES])[1]}")
def defocus(spark, sf):
    return plain(rounded(K.defocus(N.clip_norm(v1(spark, sf)), SHAPE), "value"))


# ---- distances and floods


@query(f"""WITH {LA_SQL}, b AS (SELECT z, y, x FROM la WHERE label = 0)
    SELECT 'v1' AS volume_id, la.z, la.y, la.x, round(CASE WHEN label = 0 THEN 0.0 ELSE sqrt(min((la.z - b.z) ** 2 + (la.y - b.y) ** 2 + (la.x - b.x) ** 2)) END, 6) AS value
    FROM la, b GROUP BY la.z, la.y, la.x, label""")
def edt_box(spark, sf):
    mask = la(spark, sf).select("volume_id", *AXES, F.col("label").cast("double").alias("value"))
    return rounded(U.distances(mask), "value")


def _bodies(spark, sf):
    """Eight boxes of V1's grid, one in each octant, with one in the last that is a voxel thick."""
    lab = la(spark, sf)
    octant = 1 + F.floor(F.col("z") / 4) + 2 * F.floor(F.col("y") / 8) + 4 * F.floor(F.col("x") / 8)
    inside = F.col("y").between(1, 6) | F.col("y").between(9, 14)
    inside &= F.col("x").between(1, 6) | F.col("x").between(9, 14)
    thick = F.when(octant == 8, F.col("z") == 5).otherwise(F.lit(True))
    return lab.withColumn("label", F.when(inside & thick, octant).otherwise(0).cast("int"))


_BODIES = f"""WITH {sql_grid()}, lab AS (SELECT *, CASE WHEN ok AND (octant < 8 OR z = 5) THEN octant ELSE 0 END AS label FROM (
    SELECT z, y, x, 1 + z // 4 + 2 * (y // 8) + 4 * (x // 8) AS octant, {' AND '.join(f'({a} BETWEEN 1 AND 6 OR {a} BETWEEN 9 AND 14)' for a in 'yx')} AS ok FROM g))"""


def _heat_sql() -> str:
    """CTEs up to ``heat`` (label, z, y, x, heat): each body in its box with a margin of one, smoothed and thresholded twice, distances by brute force."""
    places = ", ".join(AXES)
    box = ", ".join(f"min({a}) - 1 AS o{a}, max({a}) - min({a}) + 3 AS n{a}" for a in AXES)
    axes = ", ".join(f"(SELECT unnest(range(0, 8)) AS {a})" for a in AXES)
    inside = " AND ".join(f"{a} < n{a}" for a in AXES)
    parts = [
        f"bb AS (SELECT label, {box} FROM lab WHERE label > 0 GROUP BY label)",
        f"""m0 AS (SELECT bb.*, p.z, p.y, p.x, CASE WHEN lab.label = bb.label THEN 1.0::DOUBLE ELSE 0.0 END AS value
            FROM bb JOIN (SELECT * FROM {axes}) AS p ON {inside} LEFT JOIN lab ON {' AND '.join(f'lab.{a} = p.{a} + o{a}' for a in AXES)})""",
    ]
    at, keep = "m0", "label, oz, nz, oy, ny, ox, nx"
    for turn in range(2):
        for a in AXES:
            m = f"((c.{a} + k) % (2 * c.n{a}) + 2 * c.n{a}) % (2 * c.n{a})"
            others = " AND ".join(f"q.{b} = c.{b}" for b in AXES if b != a)
            out = f"m{turn}{a}"
            parts.append(f"""{out} AS (SELECT {', '.join('c.' + x for x in keep.split(', '))}, c.z, c.y, c.x, sum(q.value * w) AS value FROM {at} AS c, {_weights(1.0)}, {at} AS q
                WHERE q.label = c.label AND {others} AND q.{a} = CASE WHEN {m} < c.n{a} THEN {m} ELSE 2 * c.n{a} - 1 - {m} END GROUP BY ALL)""")
            at = out
        parts.append(f"t{turn} AS MATERIALIZED (SELECT {keep}, {places}, CASE WHEN value > 0.4 THEN 1.0::DOUBLE ELSE 0.0 END AS value FROM {at})")
        at = f"t{turn}"
    ends = ", ".join(f"max({a}) - min({a}) AS e{a}" for a in AXES)
    least = "least(ez, ey, ex)"
    wide = ", ".join(f"(SELECT unnest(range(-1, 9)) AS {a})" for a in AXES)
    parts += [
        "left_ AS (SELECT label FROM t1 GROUP BY label HAVING max(value) > 0)",
        f"body AS MATERIALIZED (SELECT {keep}, {places} FROM t1 WHERE value > 0 UNION ALL SELECT {keep}, {places} FROM m0 WHERE value > 0 AND label NOT IN (SELECT label FROM left_))",
        f"ext AS (SELECT label, {ends} FROM body GROUP BY label)",
        f"""flat AS (SELECT label, CASE WHEN {least} > 1 THEN 'none' WHEN (ez = {least})::INT + (ey = {least})::INT + (ex = {least})::INT > 1 THEN 'z'
            WHEN ez = {least} THEN 'z' WHEN ey = {least} THEN 'y' ELSE 'x' END AS axis FROM ext)""",
        f"""out_ AS MATERIALIZED (SELECT bb.label, p.* FROM bb JOIN (SELECT * FROM {wide}) AS p ON {' AND '.join(f'p.{a} <= n{a}' for a in AXES)} ANTI JOIN body USING (label, z, y, x))""",
        f"""dist AS (SELECT b.label, b.z + oz AS z, b.y + oy AS y, b.x + ox AS x, sqrt(min({' + '.join(f'(b.{a} - o.{a}) ** 2' for a in AXES)})) AS d
            FROM body AS b JOIN flat USING (label) JOIN out_ AS o ON o.label = b.label AND (axis = 'none' OR axis = 'z' AND o.z = b.z OR axis = 'y' AND o.y = b.y OR axis = 'x' AND o.x = b.x) GROUP BY ALL)""",
        """heat AS (SELECT label, z, y, x, CASE WHEN max(d) OVER l = min(d) OVER l THEN 20.0 ELSE -2 + (d - min(d) OVER l) / (max(d) OVER l - min(d) OVER l) * 22 END AS heat
            FROM dist WINDOW l AS (PARTITION BY label))""",
    ]
    return f"{_BODIES}, {', '.join(parts)}"


@query(f"{_heat_sql()} SELECT 'v1' AS volume_id, CAST(label AS INTEGER) AS label, CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(heat, 6) + 0.0 AS heat FROM heat")
def shape_to_edt(spark, sf):
    return rounded(U.heat_parts(_bodies(spark, sf)), "heat")


@query(f"""{_heat_sql()}, best AS (SELECT z, y, x, arg_max(heat, label) AS heat FROM heat GROUP BY ALL)
    SELECT 'v1' AS volume_id, z, y, x, CAST(label AS INTEGER) AS label, round(coalesce(heat, -5.0), 6) + 0.0 AS heat FROM lab LEFT JOIN best USING (z, y, x)""")
def heatmap_labels(spark, sf):
    return plain(rounded(U.heatmap(_bodies(spark, sf).drop("value")), "heat"))


def _smooth_unit(spark, sf):
    return N.clip_norm(K.gaussian(v1(spark, sf), SHAPE, 1.0), clip=False)


_SMOOTH_UNIT = f"{_SMOOTH}, u AS (SELECT z, y, x, (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS value FROM {_LAST})"


@query()
def hdome_seeds(spark, sf):
    return U.dome_seed_labels(_smooth_unit(spark, sf), 0.2)


@query(f"""WITH RECURSIVE {V1_SQL}, {_SMOOTH_UNIT}, m AS MATERIALIZED (SELECT z, y, x, z * 256 + y * 16 + x AS id FROM u WHERE value > 0.7),
    e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM m AS a JOIN m AS b ON abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1),
    r(a, b) AS (SELECT id, id FROM m UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    k AS (SELECT id, dense_rank() OVER (ORDER BY root) AS label FROM (SELECT b AS id, min(a) AS root FROM r GROUP BY b))
    SELECT 'v1' AS volume_id, z, y, x, round(value, 6) AS value, CAST(coalesce(label, 0) AS INTEGER) AS label FROM u LEFT JOIN k ON k.id = z * 256 + y * 16 + x""")
def simple_seeds(spark, sf):
    from ..operators.labels import simple_seeds as seeds

    return plain(rounded(seeds(_smooth_unit(spark, sf), 0.7), "value"))


@query()
def watershed(spark, sf):
    u = _smooth_unit(spark, sf)
    seeds = U.dome_seed_labels(u, 0.2)
    return U.watershed(u.join(seeds, ["volume_id", *AXES]), 0.3)


@query()
def watershed_inference(spark, sf):
    return U.segment_volumes(N.clip_norm(v1(spark, sf)), h=0.2, background=0.3, confidence=0.5)


@query()
def watershed_symmetry(spark, sf):
    """The same with seeds from symmetry votes."""
    return U.segment_volumes(N.clip_norm(v1(spark, sf)), h=0.2, background=0.3, confidence=0.5, sym=True)


@query(f"{_V1} SELECT volume_id, z, y, x, round((value + 5) / 25, 6) AS value FROM v")
def sliding_window(spark, sf):
    """The whole inference with a model that gives back what it gets."""
    return plain(rounded(I.sliding_window(v1(spark, sf), SHAPE, lambda x: x, Config(tile=32, keep=16, step=16)), "value"))


@query()
def resize_cubic(spark, sf):
    return U.resize_volumes(v1(spark, sf), (6, 20, 12))


def _spectrum_sql() -> str:
    """The discrete Fourier transform by its sums, over the half of the frequencies along x that a real volume needs."""
    turn = "2 * pi() * (kz * z / 8.0::DOUBLE + ky * y / 16.0::DOUBLE + kx * x / 16.0::DOUBLE)"
    return f"""{_NORM1}, k AS (SELECT kz, ky, kx, CASE WHEN kz < 4 THEN kz ELSE kz - 8 END / 8.0::DOUBLE AS fz, CASE WHEN ky < 8 THEN ky ELSE ky - 16 END / 16.0::DOUBLE AS fy, kx / 16.0::DOUBLE AS fx
            FROM (SELECT unnest(range(8)) AS kz), (SELECT unnest(range(16)) AS ky), (SELECT unnest(range(9)) AS kx)),
        p AS (SELECT *, 2 * tanh(0.1) * fz + 2 * tanh(0.2) * (2 * rr - 1) + 2 * tanh(0.05) * (6 * rr * rr - 6 * rr + 1) AS phase FROM (SELECT *, fz * fz + fy * fy + fx * fx AS rr FROM k)),
        f AS (SELECT kz, ky, kx, phase, sum(value * cos({turn})) AS re, -sum(value * sin({turn})) AS im FROM p, u GROUP BY ALL),
        t AS (SELECT kz, ky, kx, re * cos(phase) - im * sin(phase) AS re, re * sin(phase) + im * cos(phase) AS im FROM f)
        SELECT 'v1' AS volume_id, z, y, x, round(sum(CASE WHEN kx IN (0, 8) THEN 1 ELSE 2 END * (re * cos({turn}) - im * sin({turn}))) / 2048, 6) + 0.0 AS value FROM t, g GROUP BY ALL"""


@query(_spectrum_sql())
def zernike_filter(spark, sf):
    """Tilt, defocus and spherical phases on the spectrum of each volume."""
    return plain(rounded(U.map_volumes(N.clip_norm(v1(spark, sf)), lambda a: Y.zernike_filter(a, {3: 0.1, 4: 0.2, 12: 0.05})), "value"))


@query(f"WITH {LA_SQL} SELECT volume_id, count(DISTINCT CASE WHEN label <> 0 THEN label END) AS n_instances FROM la GROUP BY volume_id")
def label_files(spark, sf):
    """Written as a file for each volume, with the count of what the file holds."""
    from ..operators.labels import shared_folder

    return files.write_volumes(la(spark, sf), shared_folder(spark, "label-files"), "label").select("volume_id", "n_instances")


# ---- layers


@query("SELECT vec_id, round(CASE WHEN n > 1e-20 THEN n / (1 + n) / sqrt(n) ELSE 0.0 END * CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS first, round(n / (1 + n), 6) AS length FROM (SELECT *, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS n FROM embeddings)")
def squash_vec(spark, sf):
    v = table(spark, sf, "embeddings").withColumn("s", S.squash(F.col("embedding")))
    length = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x))
    return rounded(v.select("vec_id", F.col("s")[0].alias("first"), length.alias("length")), "first", "length")


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT vec_id, exp(x - max(x) OVER (PARTITION BY vec_id)) AS u FROM e),
    p AS (SELECT vec_id, u / sum(u) OVER (PARTITION BY vec_id) AS p FROM m) SELECT vec_id, round(-sum(p * log2(p + 1e-12)), 6) AS bits FROM p GROUP BY vec_id""")
def entropy_bits(spark, sf):
    p = S.softmax(F.transform("embedding", lambda x: x.cast("double")))
    return rounded(table(spark, sf, "embeddings").select("vec_id", S.entropy_bits(p).alias("bits")), "bits")


_STEPS = "WITH s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS value, unnest(range(64)) AS i FROM embeddings)"


def _steps(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("value"))


@query(f"{_STEPS} SELECT vec_id, i, round(sum(value) OVER w, 6) + 0.0 AS cumsum, round(max(value) OVER w, 6) + 0.0 AS row_max FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY i)")
def gate_cumsum(spark, sf):
    out = Y.row_max(Y.cumsum(_steps(spark, sf), "vec_id", "i", "value"), "vec_id", "i", "value")
    return rounded(out.drop("value"), "cumsum", "row_max")


@query(f"{_STEPS} SELECT vec_id, i, round(sum(least(value, 0) - ln(1 + exp(-abs(value)))) OVER (PARTITION BY vec_id ORDER BY i), 6) + 0.0 AS log_f FROM s")
def forget_gates(spark, sf):
    return rounded(Y.log_sigmoid_gates(_steps(spark, sf), "vec_id", "i", "value").drop("value"), "log_f")


@query(f"""{_STEPS} SELECT vec_id, i, round(0.1 * coalesce(lag(value, 3) OVER w, 0) + 0.2 * coalesce(lag(value, 2) OVER w, 0) + 0.3 * coalesce(lag(value, 1) OVER w, 0) + 0.4 * value, 6) + 0.0 AS conv
    FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY i)""")
def causal_conv(spark, sf):
    return rounded(Y.causal_conv(_steps(spark, sf), "vec_id", "i", "value", [0.1, 0.2, 0.3, 0.4]).drop("value"), "conv")


@query(f"{_STEPS} SELECT vec_id, i, round((value - avg(value) OVER w) / sqrt(var_pop(value) OVER w + 1e-5), 6) + 0.0 AS norm FROM s WINDOW w AS (PARTITION BY vec_id)")
def layer_norm(spark, sf):
    return rounded(Y.layer_norm(_steps(spark, sf), "vec_id", "value").drop("value"), "norm")


@query(f"{_STEPS} SELECT vec_id, i, round(greatest(1.5 * value / sqrt(avg(value * value) OVER (PARTITION BY vec_id, i // 16) + 1e-6) + 0.1, -0.5), 6) + 0.0 AS frn FROM s")
def filter_response_norm(spark, sf):
    rows = _steps(spark, sf).withColumn("c", F.floor(F.col("i") / 16))
    return rounded(Y.filter_response_norm(rows, ["vec_id", "c"], "value", 1.5, 0.1, -0.5).drop("value", "c"), "frn")


@query(f"{_STEPS}, y AS (SELECT *, value / sqrt(avg(value * value) OVER (PARTITION BY vec_id) + 1e-6) AS y FROM s) SELECT vec_id, i, round(y * tanh(ln(1 + exp(y))), 6) + 0.0 AS frn_mish FROM y")
def mish_response_norm(spark, sf):
    return rounded(Y.mish_response_norm(_steps(spark, sf), ["vec_id"], "value").drop("value"), "frn_mish")


def _routing_sql(iterations: int = 3) -> str:
    parts = ["""e AS (SELECT vec_id AS item, CAST(i // 4 % 4 AS INTEGER) AS child, CAST(i // 16 AS INTEGER) AS parent, i % 4 AS d, CAST(e AS DOUBLE) AS x
        FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(64)) AS i FROM embeddings))""", "l0 AS (SELECT DISTINCT item, child, parent, 0.0::DOUBLE AS logit FROM e)"]  # fmt: skip
    for k in range(iterations):
        parts.append(f"""c{k} AS (SELECT item, child, parent, exp(logit) / sum(exp(logit)) OVER (PARTITION BY item, child) AS c FROM l{k}),
            s{k} AS (SELECT item, parent, d, sum(c * x) AS s FROM e JOIN c{k} USING (item, child, parent) GROUP BY ALL),
            p{k} AS (SELECT item, parent, d, CASE WHEN n > 1e-20 THEN s * n / (1 + n) / sqrt(n) ELSE 0.0 END AS pose FROM (SELECT *, sum(s * s) OVER (PARTITION BY item, parent) AS n FROM s{k})),
            l{k + 1} AS (SELECT item, child, parent, any_value(logit) + sum(x * pose) AS logit FROM l{k} JOIN e USING (item, child, parent) JOIN p{k} USING (item, parent, d) GROUP BY item, child, parent)""")
    columns = ", ".join(f"round(max(pose) FILTER (d = {j}), 6) + 0.0 AS p{j}" for j in range(4))
    return f"WITH {', '.join(parts)} SELECT item, parent, {columns} FROM p{iterations - 1} GROUP BY item, parent"


@query(_routing_sql())
def capsule_routing(spark, sf):
    e = table(spark, sf, "embeddings")
    votes = e.select(F.col("vec_id").alias("item"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.transform(F.slice("embedding", k * 4 + 1, 4), lambda x: x.cast("double")))).alias("k", "vote"))
    found = Y.route(votes.select("item", (F.col("k") % 4).alias("child"), F.floor(F.col("k") / 4).cast("int").alias("parent"), "vote"))
    return rounded(found.select("item", "parent", *[F.col("pose")[j].alias(f"p{j}") for j in range(4)]), *[f"p{j}" for j in range(4)])


@query(f"{_STEPS}, h AS (SELECT *, i // 16 AS head FROM s) SELECT vec_id, i, round((value - avg(value) OVER w) / sqrt(var_pop(value) OVER w + 1e-5), 6) + 0.0 AS norm FROM h WINDOW w AS (PARTITION BY vec_id, head)")
def multi_head_norm(spark, sf):
    rows = _steps(spark, sf).withColumn("head", F.floor(F.col("i") / 16))
    return rounded(Y.multi_head_norm(rows, ["vec_id"], "head", "value").drop("value", "head"), "norm")


@query(f"{_STEPS} SELECT vec_id, i, round(value + CASE WHEN {drawn('vec_id', '6', chr(39) + 'path' + chr(39))} >= 0.25 THEN value * value / 0.75 ELSE 0.0 END, 6) + 0.0 AS dropped FROM s")
def drop_path(spark, sf):
    rows = _steps(spark, sf).withColumn("r", F.col("value") * F.col("value"))
    return rounded(Y.drop_path(rows, "vec_id", "value", "r", 0.25, 6).drop("value", "r"), "dropped")


@query(f"{_STEPS} SELECT vec_id, i, CAST(63 - i AS INTEGER) AS turn FROM s")
def traverse_backwards(spark, sf):
    return Y.traverse(_steps(spark, sf), "vec_id", "i", True).drop("value")


@query(f"{_STEPS} SELECT vec_id, i, round(greatest(value / sqrt(value * value + 1e-6), 0.0), 6) + 0.0 AS frn FROM s")
def filter_response_norm_1d(spark, sf):
    return rounded(Y.filter_response_norm(_steps(spark, sf), [], "value").drop("value"), "frn")


@query("SELECT l_returnflag, round(avg(CASE WHEN l_linestatus = 'O' THEN (l_extendedprice / 1000 - l_quantity) ** 2 ELSE 0.0 END), 4) AS mse FROM lineitem GROUP BY l_returnflag")
def masked_mse(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_linestatus") == "O").alias("mask"), (F.col("l_extendedprice") / 1000).alias("o"), F.col("l_quantity").alias("l"))
    return rounded(I.masked_mse(rows, "l_returnflag"), "mse", digits=4)


# ---- files, splits, sampling


_NAMES = """WITH f AS (SELECT CASE p_partkey % 4 WHEN 0 THEN p_partkey // 4 || 'img.tif' WHEN 1 THEN 'label_' || p_partkey // 4 || '.npy' WHEN 2 THEN 'integer' || (p_partkey // 8) || '_' || p_partkey || '.npy' ELSE 'notes.txt' END AS name FROM part),
    n AS (SELECT DISTINCT name, CAST(coalesce(nullif(regexp_extract(name, '[0-9]+'), ''), '-1') AS INTEGER) AS number,
        CASE WHEN name LIKE 'integer%' THEN 'integer' WHEN name LIKE 'label%' THEN 'label' WHEN name LIKE '%.tif' THEN 'image' END AS role FROM f)"""


def _names(spark, sf):
    k = F.col("p_partkey")
    q = lambda n: F.floor(k / n).cast("string")
    name = F.when(k % 4 == 0, F.concat(q(4), F.lit("img.tif"))).when(k % 4 == 1, F.concat(F.lit("label_"), q(4), F.lit(".npy"))).when(k % 4 == 2, F.concat(F.lit("integer"), q(8), F.lit("_"), k.cast("string"), F.lit(".npy"))).otherwise("notes.txt")
    return files.named(table(spark, sf, "part").select(name.alias("name")).distinct())


@query(f"{_NAMES} SELECT name, regexp_replace(name, '\\.[^.]*$', '') AS stem, number, role FROM n")
def files_roles(spark, sf):
    return _names(spark, sf)


@query(f"""{_NAMES} SELECT i.number, i.name AS image, l.name AS label, t.name AS integer FROM n AS i JOIN n AS l ON l.role = 'label' AND l.number = i.number
    LEFT JOIN (SELECT number, min(name) AS name FROM n WHERE role = 'integer' GROUP BY number) AS t ON t.number = i.number WHERE i.role = 'image'""")
def files_left_first(spark, sf):
    return files.pair_by_number(_names(spark, sf))


def _pair_sql(extra: str) -> str:
    return f"""{_NAMES}, i AS (SELECT name, number, row_number() OVER (ORDER BY name) AS rank FROM n WHERE contains(name, 'img')),
        l AS (SELECT name, number, row_number() OVER (ORDER BY name) AS rank FROM n WHERE role = 'label')
        SELECT CAST(rank AS INTEGER) AS rank, i.name AS image, l.name AS label FROM i JOIN l USING (rank) {extra}"""


@query(_pair_sql(""))
def files_by_position(spark, sf):
    n = _names(spark, sf)
    images, labels = files.split_by_word(n.filter("role IN ('image', 'label')"))
    return files.pair_by_position(images, labels)


@query(_pair_sql("WHERE i.number = l.number"))
def files_pair(spark, sf):
    images, labels = files.split_by_word(_names(spark, sf).filter("role IN ('image', 'label')"))
    return files.pair_by_position(images, labels, True)


@query("SELECT p_partkey, round(p_retailprice / 7, 2) AS factor, replace(printf('%.2f', p_size / 4.0), '.', 'p') AS name FROM part")
def factor_names(spark, sf):
    p = table(spark, sf, "part")
    parsed = files.factors(p.select("p_partkey", "p_size", "p_retailprice", F.concat(F.lit("["), (F.col("p_retailprice") / 7).cast("string"), F.lit(", 1.0]")).alias("text")))
    return parsed.select("p_partkey", F.col("factors")[0].alias("factor"), S.factor_name((F.col("p_size") / 4).cast("double")).alias("name"))


@query("SELECT n_nationkey AS ordinal, n_name, CASE WHEN n_nationkey % 5 = 0 THEN 'val' WHEN n_nationkey % 7 = 3 THEN 'inference' ELSE 'train' END AS role FROM nation")
def train_val_test_split(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("ordinal"), "n_name")
    o = F.col("ordinal")
    held = n.select(o, F.when(o % 5 == 0, "val").when(o % 7 == 3, "inference").alias("role")).filter("role IS NOT NULL")
    return R.split(n, held).select("ordinal", "n_name", "role")


@query("SELECT n_nationkey AS ordinal, n_name FROM nation WHERE NOT (n_nationkey % 5 = 0 OR n_nationkey % 7 = 3)")
def split_anti(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("ordinal"), "n_name")
    return R.train_part(n, n.filter("ordinal % 5 = 0"), n.filter("ordinal % 7 = 3"))


@query("SELECT pick, n_nationkey AS ordinal, n_name FROM nation JOIN (VALUES (0, 7), (1, 3), (2, 7), (3, 20)) AS w(pick, ordinal) ON ordinal = n_nationkey")
def split_picks(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("ordinal"), "n_name")
    return R.picks(n, [7, 3, 7, 20], spark).select("pick", "ordinal", "n_name")


@query("SELECT vec_id, label FROM embeddings ORDER BY md5(concat_ws('|', vec_id, 5)), vec_id LIMIT 16")
def sample_minibatch(spark, sf):
    return R.minibatch(table(spark, sf, "embeddings").select("vec_id", "label"), 16, 5, "vec_id")


def _centres_sql() -> str:
    def extreme(f: str, value: str, kind: str) -> str:
        window = lambda a, v: f"{f}({v}) OVER (PARTITION BY {', '.join(c for c in AXES if c != a)} ORDER BY {a} RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
        return f"""{kind}0 AS (SELECT z, y, x, value, {value} AS u, {value} AS e FROM la), {kind}1 AS (SELECT * REPLACE ({window('z', 'e')} AS e) FROM {kind}0),
            {kind}2 AS (SELECT * REPLACE ({window('y', 'e')} AS e) FROM {kind}1), {kind}3 AS (SELECT * REPLACE ({window('x', 'e')} AS e) FROM {kind}2)"""

    hard = lambda kind: f"SELECT 'v1', '{kind}', z, y, x FROM {kind}3 WHERE u = e AND value > 0"
    medians = ", ".join(f"CAST(trunc(quantile_cont({a}, 0.5)) AS INTEGER) AS {a}" for a in AXES)
    key = lambda salt: drawn("volume_id", "draw", "1", f"'{salt}'")
    place = []
    for a, n in zip(AXES, SHAPE):
        move, free = f"floor({key('j' + a)} * 5) - 2", f"floor({key('u' + a)} * {max(n - 6, 1)}) + 3"
        place.append(f"CAST(least(greatest(coalesce({a} + {move}, {free}), {min(3, n // 2)}), {max(n - 3, n // 2)}) AS INTEGER) AS c{a}")
    return f"""WITH {LA_SQL}, {extreme('max', 'value', 'background')}, {extreme('min', "CASE WHEN value > 0 THEN value ELSE 'inf'::DOUBLE END", 'foreground')},
        c(volume_id, kind, z, y, x) AS (SELECT 'v1', 'instance', {medians} FROM la WHERE label > 0 GROUP BY label UNION ALL {hard('background')} UNION ALL {hard('foreground')}),
        d AS (SELECT *, CASE WHEN w < 0.5 THEN 'instance' WHEN w < 0.8 THEN 'uniform' WHEN w < 0.9 THEN 'background' ELSE 'foreground' END AS kind
              FROM (SELECT volume_id, draw, {key('kind')} AS w FROM (SELECT 'v1' AS volume_id, CAST(unnest(range(20)) AS INTEGER) AS draw))),
        m AS (SELECT d.volume_id, draw, d.kind, z, y, x, row_number() OVER (PARTITION BY d.volume_id, draw ORDER BY md5(concat_ws('|', d.volume_id, draw, 1, z, y, x))) AS r
              FROM d LEFT JOIN c ON c.volume_id = d.volume_id AND c.kind = d.kind)
        SELECT volume_id, draw, CASE WHEN z IS NULL THEN 'uniform' ELSE kind END AS kind, {', '.join(place)} FROM m WHERE r = 1"""


@query(_centres_sql())
def crop_centres(spark, sf):
    rows = la(spark, sf)
    from ..operators.labels import medians

    inst = medians(rows).select("volume_id", F.lit("instance").alias("kind"), *AXES)
    hard = lambda f, k: f(rows.select("volume_id", *AXES, "value"), 2).select("volume_id", F.lit(k).alias("kind"), *AXES)
    return R.crop_centres(inst.unionByName(hard(K.local_maxima, "background")).unionByName(hard(K.local_minima, "foreground")), 20, 3, SHAPE, 1)


def _noise_sql() -> str:
    place = ("volume_id", "z", "y", "x", "3")
    noise = f"sqrt(-2 * ln(1 - {drawn(*place, chr(39) + 'a' + chr(39))})) * cos({drawn(*place, chr(39) + 'b' + chr(39))} * 2 * pi())"
    hit = drawn("volume_id", "3", "'noise'")
    return f"""{_clipped(0.01, 0.99)}, u AS (SELECT volume_id, z, y, x, CASE WHEN b > a THEN (value - a) / (b - a) ELSE b END AS value FROM k JOIN r USING (volume_id))
        SELECT volume_id, z, y, x, round(CASE WHEN {hit} < 0.2 THEN least(greatest(value + 0.3 * {noise}, 0.0), 1.0) ELSE value END, 6) + 0.0 AS value FROM u"""


@query(_noise_sql())
def gaussian_noise(spark, sf):
    return plain(rounded(R.add_noise(N.clip_norm(v2(spark, sf)), 3), "value"))


@query(f"""WITH {LA_SQL}, d AS (SELECT DISTINCT volume_id, label FROM la WHERE label <> 0), p AS (SELECT volume_id, count(*) AS n, arg_min(label, md5(concat_ws('|', volume_id, label, 2))) AS pick FROM d GROUP BY volume_id)
    SELECT volume_id, z, y, x, value, label, CASE WHEN n > 1 AND label = pick THEN value ELSE -5.0 END AS cue FROM la JOIN p USING (volume_id)""")
def label_cue(spark, sf):
    return plain(R.cue(la(spark, sf), 2, 1.0))


@query(f"""{_V2}, {sql_grid((1, 4, 4), 'w')}, d AS (SELECT volume_id, floor({drawn('volume_id', '3')} * 4)::INTEGER AS k FROM (SELECT DISTINCT volume_id FROM v))
    SELECT d.volume_id, w.z, w.y, w.x, value, 4 AS side, k * 90 AS angle FROM d, w, v WHERE v.volume_id = d.volume_id AND v.z = 0
    AND v.y = CASE k WHEN 0 THEN w.y WHEN 1 THEN w.x WHEN 2 THEN 3 - w.y ELSE 3 - w.x END AND v.x = CASE k WHEN 0 THEN w.x WHEN 1 THEN 3 - w.y WHEN 2 THEN 3 - w.x ELSE w.y END""")
def rotate_2d(spark, sf):
    return plain(R.rotate_crops(v2(spark, sf).filter("z = 0").withColumn("side", F.lit(4)), 3))


@query()
def tune_grid(spark, sf):
    """Trials of segmentation settings, scored by accuracy against the segmentation by the first."""
    u = N.clip_norm(v1(spark, sf))
    truth = U.segment_volumes(u, h=0.2, background=0.3)
    trials = R.grid(spark, {"h": [0.1, 0.2, 0.3], "background": [0.2, 0.3], "confidence": [0.5, 0.7]})
    return rounded(R.tune_segmentation(u.join(truth, ["volume_id", *AXES]), trials), "score")


@query("""SELECT CAST(i AS BIGINT) AS trial_id, round(0.15 + 0.01 * floor(H * 36), 9) AS h, round(0.05 + 0.01 * floor(B * 21), 9) AS background, round(0.2 + 0.01 * floor(C * 56), 9) AS confidence,
    floor(S * 2) = 0 AS smoothing, floor(T * 2) = 0 AS simple FROM (SELECT unnest(range(300)) AS i)"""
    .replace("floor(H", f"floor({drawn('i', '9', chr(39) + 'h' + chr(39))}").replace("floor(B", f"floor({drawn('i', '9', chr(39) + 'background' + chr(39))}")
    .replace("floor(C", f"floor({drawn('i', '9', chr(39) + 'confidence' + chr(39))}").replace("floor(S", f"floor({drawn('i', '9', chr(39) + 'smoothing' + chr(39))}")
    .replace("floor(T", f"floor({drawn('i', '9', chr(39) + 'simple' + chr(39))}"))
def trial_draws(spark, sf):
    """The trials of a search, drawn by their numbers."""
    return R.random_trials(spark, 300, 9)
