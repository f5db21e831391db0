"""Overlaps, matches, tracking, label tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..model import label_checks
from ..operators import labels as L
from ..operators import matching as M
from .registry import plain, query, rounded
from .volumes import LA_SQL, LD_SQL, V1_SQL, la, ld, table, v1

THRESHOLDS = [0.6, 0.7, 0.8, 0.9]
RATIOS = ("precision", "recall", "accuracy", "f1", "mean_true_score", "mean_matched_score", "panoptic_quality")

_OVER = f"WITH {LD_SQL}, o AS (SELECT t, p, count(*) AS n FROM ld GROUP BY t, p)"
_M = "*, CAST(sum(n) OVER (PARTITION BY t) AS BIGINT) AS t_total, CAST(sum(n) OVER (PARTITION BY p) AS BIGINT) AS p_total"


@query(f"{_OVER} SELECT t, p, n FROM o")
def overlap_counts(spark, sf):
    return M.overlap(ld(spark, sf))


@query(f"{_OVER} SELECT {_M} FROM o")
def overlap_marginals(spark, sf):
    return M.marginals(M.overlap(ld(spark, sf))).select("t", "p", "n", "t_total", "p_total")


def _score(criterion):
    return lambda spark, sf: rounded(M.scores(M.overlap(ld(spark, sf)), criterion).select("t", "p", "n", "score"), "score")


for _name, _sql in (("iou", "n / (t_total + p_total - n)"), ("iot", "n / t_total"), ("iop", "n / p_total")):
    _f = _score(_name)
    _f.__name__ = f"overlap_{_name}"
    query(f"{_OVER} SELECT t, p, n, round({_sql}, 6) AS score FROM (SELECT {_M} FROM o)")(_f)

_THR = "(VALUES (0.6::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) AS h(thresh)"


def _ratios(digits: int = 6) -> str:
    r = lambda e, n: f"round({e}, {digits}) AS {n}"
    return ", ".join(
        [
            r("CASE WHEN tp > 0 THEN tp / (tp + fp) ELSE 0.0 END", "precision"),
            r("CASE WHEN tp > 0 THEN tp / (tp + fn) ELSE 0.0 END", "recall"),
            r("CASE WHEN tp > 0 THEN tp / (tp + fp + fn) ELSE 0.0 END", "accuracy"),
            r("CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END", "f1"),
            r("CASE WHEN n_true > 0 THEN score_sum / n_true ELSE 0.0 END", "mean_true_score"),
            r("CASE WHEN tp > 0 THEN score_sum / tp ELSE 0.0 END", "mean_matched_score"),
            r("CASE WHEN tp + fp + fn > 0 THEN score_sum / (tp + fp / 2 + fn / 2) ELSE 0.0 END", "panoptic_quality"),
        ]
    )


def _match_sql(pair: str = "") -> str:
    """CTEs up to ``stats``: pair, thresh, n_true, n_pred, tp, fp, fn, score_sum."""
    k = f"{pair}, " if pair else ""
    return f"""WITH {LD_SQL}, o AS (SELECT {k}t, p, count(*) AS n FROM ld GROUP BY {k}t, p),
        s AS (SELECT {k}t, p, n / (sum(n) OVER (PARTITION BY {k}t) + sum(n) OVER (PARTITION BY {k}p) - n) AS score FROM o),
        c AS (SELECT {k}count(DISTINCT CASE WHEN t <> 0 THEN t END) AS n_true, count(DISTINCT CASE WHEN p <> 0 THEN p END) AS n_pred FROM o {f'GROUP BY {pair}' if pair else ''}),
        m AS (SELECT {k}thresh, count(*) AS tp, sum(score) AS score_sum FROM s, {_THR} WHERE t <> 0 AND p <> 0 AND score >= thresh GROUP BY {k}thresh),
        stats AS (SELECT {'c.' + pair + ', ' if pair else ''}h.thresh, n_true, n_pred, coalesce(tp, 0) AS tp, n_pred - coalesce(tp, 0) AS fp, n_true - coalesce(tp, 0) AS fn, coalesce(score_sum, 0.0) AS score_sum
                  FROM c CROSS JOIN {_THR} LEFT JOIN m ON m.thresh = h.thresh {f'AND m.{pair} = c.{pair}' if pair else ''})"""


@query(f"{_match_sql()} SELECT thresh, n_true, n_pred, tp, fp, fn, {_ratios()} FROM stats")
def match_stats_thr(spark, sf):
    return rounded(M.match(ld(spark, sf), THRESHOLDS), *RATIOS)


@query(f"{_match_sql('pair_id')} SELECT pair_id, thresh, n_true, n_pred, tp, fp, fn, {_ratios()} FROM stats")
def match_stats_pairs(spark, sf):
    return rounded(M.match(ld(spark, sf), THRESHOLDS, pair=["pair_id"]), *RATIOS)


_SUMS = "CAST(sum(n_true) AS BIGINT) AS n_true, CAST(sum(n_pred) AS BIGINT) AS n_pred, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn"


@query(f"""{_match_sql('pair_id')}, total AS (SELECT thresh, {_SUMS}, sum(score_sum) AS score_sum FROM stats GROUP BY thresh)
    SELECT thresh, n_true, n_pred, tp, fp, fn, {_ratios()}, 'iou' AS criterion, false AS by_image FROM total""")
def match_dataset_micro(spark, sf):
    return rounded(M.match_dataset(ld(spark, sf), THRESHOLDS, ["pair_id"]), *RATIOS)


@query(f"""{_match_sql('pair_id')}, r AS (SELECT *, {_ratios(15)} FROM stats)
    SELECT thresh, {_SUMS}, {', '.join(f'round(avg({c}), 6) AS {c}' for c in RATIOS)} FROM r GROUP BY thresh""")
def match_dataset_macro(spark, sf):
    return rounded(M.match_dataset(ld(spark, sf), THRESHOLDS, ["pair_id"], by_image=True), *RATIOS)


@query(f"""{_match_sql('pair_id')}, r AS (SELECT *, {_ratios(15)} FROM stats) SELECT thresh,
    {', '.join(f'round({f}({c}), 6) AS {c}_{n}' for c in ('accuracy', 'f1', 'panoptic_quality') for f, n in (('avg', 'mean'), ('stddev_pop', 'std')))} FROM r GROUP BY thresh""")
def match_spread(spark, sf):
    out = M.spread(M.match(ld(spark, sf), THRESHOLDS, pair=["pair_id"]))
    return rounded(out, *[c for c in out.columns if c != "thresh"])


@query(f"{_match_sql('pair_id')}, r AS (SELECT *, {_ratios(15)} FROM stats) SELECT pair_id, round(avg(accuracy), 6) AS mean_accuracy FROM r GROUP BY pair_id")
def map_mean(spark, sf):
    return rounded(M.mean_accuracy(M.match(ld(spark, sf), THRESHOLDS, pair=["pair_id"]), ["pair_id"]), "mean_accuracy")


def _assignment_sql(levels: list[float], score: str, pair: str = "") -> str:
    """CTEs up to ``best``: the best assignment of eight true labels to eight predicted ones, by the sets of predicted labels that are taken.

    After true label i, ``l{i}`` has for each set (a number of eight bits) the
    largest count of qualifying pairs, and of these the largest score.
    """
    k = f"{pair}, " if pair else ""
    on = f"USING ({pair})" if pair else "ON true"
    grouped = f"GROUP BY {pair}" if pair else ""
    head = f"""WITH {LD_SQL}, o AS (SELECT {k}t, p, count(*) AS n FROM ld GROUP BY {k}t, p),
        s AS (SELECT {k}t, p, {score} AS score FROM (SELECT *, sum(n) OVER (PARTITION BY {k}t) AS a, sum(n) OVER (PARTITION BY {k}p) AS b FROM o)),
        c AS (SELECT {k}count(DISTINCT CASE WHEN t <> 0 THEN t END) AS n_true, count(DISTINCT CASE WHEN p <> 0 THEN p END) AS n_pred FROM o {grouped}),
        h(thresh) AS (VALUES {', '.join(f'({x}::DOUBLE)' for x in levels)}),
        l0 AS (SELECT {k}thresh, n_true, n_pred, 0 AS taken, 0.0::DOUBLE AS gain, 0 AS tp, 0.0::DOUBLE AS score_sum, '' AS pairs FROM c, h)"""
    for i in range(1, 9):
        head += f""", l{i} AS MATERIALIZED (SELECT {k}thresh, n_true, n_pred, taken, max(gain) AS gain, arg_max(tp, gain) AS tp, arg_max(score_sum, gain) AS score_sum, arg_max(pairs, gain) AS pairs FROM (
            SELECT * FROM l{i - 1} UNION ALL
            SELECT {'l.' + k if k else ''}thresh, n_true, n_pred, taken | (1 << (p - 1)), gain + CASE WHEN score >= thresh THEN 1 ELSE 0 END + score / (2 * least(n_true, n_pred)),
                   tp + CASE WHEN score >= thresh THEN 1 ELSE 0 END, score_sum + CASE WHEN score >= thresh THEN score ELSE 0.0 END, pairs || ',' || t || ':' || p
            FROM l{i - 1} AS l JOIN s {on} WHERE t = {i} AND p > 0 AND (taken & (1 << (p - 1))) = 0) GROUP BY {k}thresh, n_true, n_pred, taken)"""
    return f"""{head}, best AS (SELECT {k}thresh, n_true, n_pred, arg_max(tp, gain) AS tp, arg_max(score_sum, gain) AS score_sum, arg_max(pairs, gain) AS pairs FROM l8 GROUP BY {k}thresh, n_true, n_pred),
        stats AS (SELECT *, n_pred - tp AS fp, n_true - tp AS fn FROM best)"""


_IOU = "n / (a + b - n)"
_COUNTED = "n_true, n_pred, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn"


@query(f"{_assignment_sql([0.1, 0.2, 0.3, 0.4, 0.5], _IOU, 'pair_id')} SELECT pair_id, thresh, {_COUNTED}, {_ratios()} FROM stats")
def match_low_thr(spark, sf):
    """Thresholds that need an assignment."""
    return rounded(M.match(ld(spark, sf), [0.1, 0.2, 0.3, 0.4, 0.5], pair=["pair_id"]), *RATIOS)


@query(f"{_assignment_sql([0.3, 0.6], 'n / a')} SELECT thresh, {_COUNTED}, {_ratios()} FROM stats")
def match_iot_assigned(spark, sf):
    return rounded(M.match(ld(spark, sf), [0.3, 0.6], "iot"), *RATIOS)


@query(f"""{_assignment_sql([0.6], _IOU, 'pair_id')}, e AS (SELECT pair_id, unnest(string_split(pairs[2:], ',')) AS e FROM best),
    m AS (SELECT pair_id, CAST(split_part(e, ':', 1) AS INTEGER) AS t, CAST(split_part(e, ':', 2) AS INTEGER) AS p FROM e),
    r AS (SELECT pair_id, t, p, score, row_number() OVER (PARTITION BY pair_id ORDER BY t) - 1 AS k FROM m JOIN s USING (pair_id, t, p)),
    q AS (SELECT pair_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS tps FROM r WHERE score >= 0.6 GROUP BY pair_id)
    SELECT pair_id, t, p, round(score, 6) AS score, coalesce(tps, '') AS tps FROM r LEFT JOIN q USING (pair_id)""")
def report_matches(spark, sf):
    """All assigned pairs in the order of t, a row for each, and the places of those that reach the threshold."""
    found = M.report_matches(ld(spark, sf), 0.6, pair=["pair_id"])
    each = F.explode(F.arrays_zip("matched_pairs", "matched_scores")).alias("m")
    rows = found.select("pair_id", F.array_join(F.transform("matched_tps", lambda k: k.cast("string")), ",").alias("tps"), each)
    return rounded(rows.select("pair_id", "m.matched_pairs.t", "m.matched_pairs.p", F.col("m.matched_scores").alias("score"), "tps"), "score")


def _frames(spark, sf):
    """Ten frames of LA, each moved by a step along x, its labels renamed."""
    base = la(spark, sf).select("z", "y", "x", "label")
    t = F.col("t")
    frames = base.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return frames.select(F.lit("s").alias("seq_id"), t.alias("t"), "z", "y", F.pmod(F.col("x") + t, F.lit(16)).alias("x"), F.when(F.col("label") > 0, (F.col("label") * 3 + t) % 8 + 1).otherwise(0).cast("int").alias("label"))


@query(f"""WITH {LA_SQL} SELECT 's' AS seq_id, CAST(t AS INTEGER) AS t, label, track FROM (
    SELECT DISTINCT t, CAST((label * 3 + t) % 8 + 1 AS INTEGER) AS label, CAST((label * 3) % 8 + 1 AS INTEGER) AS track FROM la, (SELECT unnest(range(10)) AS t) WHERE label > 0)""")
def track_frames(spark, sf):
    """Instances that move by a voxel a frame keep the label that they have in the first."""
    return M.track(_frames(spark, sf))


# ---- label tables


@query(f"""WITH {LA_SQL}, w AS (SELECT volume_id, z, y, x, label * 3 AS label FROM la)
    SELECT volume_id, z, y, x, CAST(CASE WHEN label = 0 THEN 0 ELSE d END AS INTEGER) AS label FROM w JOIN (
    SELECT label, dense_rank() OVER (ORDER BY CASE WHEN label = 0 THEN 0 ELSE 1 END, label) - 1 AS d FROM (SELECT DISTINCT label FROM w UNION SELECT 0)) USING (label)""")
def relabel_sequential(spark, sf):
    w = la(spark, sf).select("volume_id", "z", "y", "x", (F.col("label") * 3).alias("label"))
    return plain(L.relabel(w))


@query("""SELECT CAST(row_number() OVER (ORDER BY k) + 4 AS INTEGER) AS new, CAST(k AS INTEGER) AS label
    FROM (SELECT DISTINCT p_size * 7 % 101 AS k FROM part) WHERE k <> 0""")
def forward_map(spark, sf):
    return L.label_map(table(spark, sf, "part").select((F.col("p_size") * 7 % 101).cast("int").alias("label")), 5, None)


@query("""SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS label, CAST(k AS INTEGER) AS old
    FROM (SELECT DISTINCT p_size * 7 % 101 AS k FROM part) WHERE k <> 0""")
def inverse_map(spark, sf):
    return L.inverse_map(L.label_map(table(spark, sf, "part").select((F.col("p_size") * 7 % 101).cast("int").alias("label")), 1, None))


_STAT = "SELECT volume_id, label, count(*) AS n_vox, max(value) AS peak FROM la WHERE label <> 0 GROUP BY ALL"


@query(f"""WITH {LA_SQL}, i AS ({_STAT}), m AS (SELECT avg(peak) AS mid FROM i),
    k AS (SELECT label, row_number() OVER (ORDER BY label) AS new FROM i, m WHERE n_vox > 60 AND peak > mid)
    SELECT volume_id, z, y, x, value, CAST(coalesce(new, 0) AS INTEGER) AS label FROM la LEFT JOIN k USING (label)""")
def instance_filter_renumber(spark, sf):
    """Instances of more than 60 voxels whose peak is over the mean of peaks: values are taken relative to it."""
    rows = la(spark, sf)
    mid = rows.filter("label <> 0").groupBy("label").agg(F.max("value").alias("p")).agg(F.avg("p").alias("_mid"))
    relative = rows.crossJoin(F.broadcast(mid)).withColumn("_over", F.col("value") - F.col("_mid"))  # one row
    return plain(L.filter_instances(relative, 60, 0.0, "_over").drop("_over", "_mid"))


@query(f"WITH {LA_SQL} SELECT volume_id, label, count(*) AS n_vox, {', '.join(f'{f}({a}) AS {a}_{f}' for a in 'zyx' for f in ('min', 'max'))} FROM la WHERE label <> 0 GROUP BY ALL")
def instance_bbox(spark, sf):
    return L.boxes(la(spark, sf))


@query(f"WITH {LA_SQL} SELECT volume_id, label, {', '.join(f'CAST(trunc(quantile_cont({a}, 0.5)) AS INTEGER) AS {a}' for a in 'zyx')} FROM la WHERE label <> 0 GROUP BY ALL")
def instance_median(spark, sf):
    return L.medians(la(spark, sf))


@query(f"WITH {LA_SQL} SELECT volume_id, count(DISTINCT CASE WHEN label <> 0 THEN label END) AS n_instances FROM la GROUP BY volume_id")
def n_instances(spark, sf):
    return L.counts(la(spark, sf))


@query("SELECT CAST(sum(m) AS BIGINT) AS n_objects FROM (SELECT p_brand, max(p_size) AS m FROM part GROUP BY p_brand)")
def distinct_objects(spark, sf):
    return L.total_objects(table(spark, sf, "part").select(F.col("p_brand").alias("volume_id"), F.col("p_size").alias("label")))


@query(f"""WITH {LA_SQL}, d AS (SELECT DISTINCT label FROM la WHERE label <> 0),
    a AS (SELECT label, row_number() OVER (ORDER BY label) AS k FROM d), b AS (SELECT label AS new, row_number() OVER (ORDER BY md5(concat_ws('|', label, 7)), label) AS k FROM d),
    m AS (SELECT label, new FROM a JOIN b USING (k))
    SELECT volume_id, z, y, x, CAST(coalesce(new, 0) AS INTEGER) AS label FROM la LEFT JOIN m USING (label)""")
def shuffle_labels(spark, sf):
    return L.shuffle_labels(la(spark, sf).drop("value"), 7)


@query(f"WITH {LA_SQL} SELECT true AS is_integer, min(label) >= 0 AS non_negative, count(DISTINCT CASE WHEN label <> 0 THEN label END) = max(label) AS sequential FROM la")
def label_validation(spark, sf):
    return label_checks(la(spark, sf))


@query(f"""WITH {LA_SQL}, m AS (SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c'), (5, 'e'), (8, 'h')) AS t(label, name))
    SELECT volume_id, z, y, x, coalesce(name, 'none') AS name FROM la LEFT JOIN m USING (label)""")
def label_lookup(spark, sf):
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (5, "e"), (8, "h")], "label int, name string")
    return la(spark, sf).join(F.broadcast(names), "label", "left").select("volume_id", "z", "y", "x", F.coalesce("name", F.lit("none")).alias("name"))


@query(f"""WITH {LA_SQL}, lb AS (SELECT g.z, g.y, g.x, coalesce(la.label, 0) AS label FROM g LEFT JOIN la ON la.z = g.z AND la.y = g.y AND la.x = g.x - 1)
    SELECT la.label AS t, lb.label AS p, count(*) AS n FROM la JOIN lb USING (z, y, x) GROUP BY ALL""")
def voxel_align(spark, sf):
    a = la(spark, sf).select("volume_id", "z", "y", "x", "label")
    moved = a.select("volume_id", "z", "y", (F.col("x") + 1).alias("x"), F.col("label").alias("m"))
    b = a.join(moved, ["volume_id", "z", "y", "x"], "left").select("volume_id", "z", "y", "x", F.coalesce("m", F.lit(0)).alias("label"))
    return M.overlap(M.align(a, b))


# ---- components and basins


@query(f"""WITH RECURSIVE {LA_SQL}, m AS MATERIALIZED (SELECT z, y, x, z * 256 + y * 16 + x AS id FROM la WHERE value * 2048 > 1.05 * (SELECT sum(value) FROM v)),
    e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM m AS a JOIN m AS b ON abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1),
    r(a, b) AS (SELECT id, id FROM m UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    c AS MATERIALIZED (SELECT b AS id, min(a) AS root FROM r GROUP BY b),
    k AS MATERIALIZED (SELECT id, dense_rank() OVER (ORDER BY root) AS label FROM c)
    SELECT 'v1' AS volume_id, z, y, x, CAST(coalesce(label, 0) AS INTEGER) AS label FROM g LEFT JOIN k ON k.id = g.z * 256 + g.y * 16 + g.x""")
def components(spark, sf):
    v = v1(spark, sf)
    total = v.agg(F.sum("value").alias("_t"))
    mask = v.crossJoin(F.broadcast(total)).withColumn("value", F.when(F.col("value") * 2048 > 1.05 * F.col("_t"), 1.0).otherwise(0.0)).drop("_t")
    return plain(L.components(mask).drop("value"))


def _unit(spark, sf):
    """V1 scaled to [0, 1], with seeds: the voxels over 0.9, numbered by place."""
    v = v1(spark, sf)
    top = v.agg(F.max("value").alias("_b"))
    u = v.crossJoin(F.broadcast(top)).withColumn("value", S.safe_divide(F.col("value"), F.col("_b"))).drop("_b")
    place = 1 + F.col("z") * 256 + F.col("y") * 16 + F.col("x")
    return u.withColumn("label", F.when(F.col("value") > 0.9, place).otherwise(0).cast("int"))


_UNIT = V1_SQL + ", u AS (SELECT z, y, x, value / (SELECT max(value) FROM v) AS value FROM v), us AS (SELECT *, CASE WHEN value > 0.9 THEN 1 + z * 256 + y * 16 + x ELSE 0 END AS label FROM u)"


def offsets_sql(step: int = 1) -> str:
    """The 26 offsets, numbered with z slowest, and their lengths."""
    return f"""SELECT row_number() OVER (ORDER BY dz, dy, dx) - 1 AS k, dz, dy, dx, sqrt(dz * dz + dy * dy + dx * dx) AS d
        FROM (SELECT unnest([-{step}, 0, {step}]) AS dz), (SELECT unnest([-{step}, 0, {step}]) AS dy), (SELECT unnest([-{step}, 0, {step}]) AS dx) WHERE dz <> 0 OR dy <> 0 OR dx <> 0"""


@query(f"""WITH RECURSIVE {_UNIT}, o(k, dz, dy, dx, d) AS ({offsets_sql()}),
    s AS (SELECT c.z, c.y, c.x, o.k, n.z AS nz, n.y AS ny, n.x AS nx, ((1 - c.value) - (1 - n.value)) / o.d AS slope
          FROM u AS c, o, u AS n WHERE n.z = c.z + o.dz AND n.y = c.y + o.dy AND n.x = c.x + o.dx),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY z, y, x ORDER BY slope DESC, k) AS r FROM s) WHERE r = 1 AND slope > 0),
    w(z, y, x, cz, cy, cx, step) AS (SELECT z, y, x, z, y, x, 0 FROM us UNION ALL
        SELECT w.z, w.y, w.x, b.nz, b.ny, b.nx, step + 1 FROM w JOIN b ON b.z = w.cz AND b.y = w.cy AND b.x = w.cx JOIN us ON us.z = w.cz AND us.y = w.cy AND us.x = w.cx
        WHERE us.label = 0 AND us.value >= 0.2 AND step < 600),
    l AS (SELECT z, y, x, cz, cy, cx FROM (SELECT *, row_number() OVER (PARTITION BY z, y, x ORDER BY step DESC) AS r FROM w) WHERE r = 1)
    SELECT 'v1' AS volume_id, l.z, l.y, l.x, CAST(us.label AS INTEGER) AS label FROM l JOIN us ON us.z = l.cz AND us.y = l.cy AND us.x = l.cx""")
def rainfall_labels(spark, sf):
    return plain(L.rainfall(_unit(spark, sf), 0.2).drop("value"))


@query(f"""WITH {_UNIT}, o(k, dz, dy, dx, d) AS ({offsets_sql()}),
    s AS (SELECT c.z, c.y, c.x, o.k, (c.value - n.value) / o.d AS slope FROM v AS c, o, v AS n WHERE n.z = c.z + o.dz AND n.y = c.y + o.dy AND n.x = c.x + o.dx),
    b AS (SELECT *, row_number() OVER (PARTITION BY z, y, x ORDER BY slope DESC, k) AS r FROM s)
    SELECT 'v1' AS volume_id, z, y, x, CAST(CASE WHEN slope > 0 THEN k ELSE 255 END AS INTEGER) AS direction FROM b WHERE r = 1""")
def steepest_descent(spark, sf):
    from ..operators.stencil import steepest_descent as down

    return plain(down(v1(spark, sf)).drop("value"))


@query(f"""WITH {_UNIT}, o(k, dz, dy, dx, d) AS ({offsets_sql(3)}),
    s AS (SELECT c.z, c.y, c.x, o.k, (c.value - n.value) / o.d AS slope FROM v AS c, o, v AS n WHERE n.z = c.z + o.dz AND n.y = c.y + o.dy AND n.x = c.x + o.dx),
    b AS (SELECT *, row_number() OVER (PARTITION BY z, y, x ORDER BY slope DESC, k) AS r FROM s)
    SELECT 'v1' AS volume_id, z, y, x, CAST(CASE WHEN slope > 0 THEN k ELSE 255 END AS INTEGER) AS direction FROM b WHERE r = 1""")
def steepest_descent_stride3(spark, sf):
    from ..operators.stencil import steepest_descent as down

    return plain(down(v1(spark, sf), 3).drop("value"))
