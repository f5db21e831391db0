"""Instance matching: overlaps of two labelings, scores, matches and their statistics.

Overlaps are sparse: a row (pair, t, p, n) for each pair of labels that meet,
by a partially aggregated count, so what is shuffled is label pairs, not voxels.
Everything after it works on these few rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

STATISTICS = ("n_true", "n_pred", "tp", "fp", "fn", "precision", "recall", "accuracy", "f1", "mean_true_score", "mean_matched_score", "panoptic_quality")


def align(true: DataFrame, pred: DataFrame, keys: Sequence[str] = ("volume_id", "z", "y", "x")) -> DataFrame:
    """Two labelings of the same voxels side by side, as t and p; voxels that only one of them has are left out."""
    a = true.select(*keys, F.col("label").alias("t"))
    return a.join(pred.select(*keys, F.col("label").alias("p")), list(keys))


def overlap(rows: DataFrame, pair: Sequence[str] = ()) -> DataFrame:
    """How many rows have labels (t, p), for each pair of labelings; rows with a null label are left out."""
    return rows.filter("t IS NOT NULL AND p IS NOT NULL").groupBy(*pair, "t", "p").agg(F.count("*").alias("n"))


def marginals(overlaps: DataFrame, pair: Sequence[str] = ()) -> DataFrame:
    """Adds t_total and p_total, the sizes of both labels; background counts.

    Sums over the overlaps are joined back, as a window over a label that most
    others overlap, such as background, would be one task.
    """
    t = overlaps.groupBy(*pair, "t").agg(F.sum("n").alias("t_total"))
    p = overlaps.groupBy(*pair, "p").agg(F.sum("n").alias("p_total"))
    return overlaps.join(t, [*pair, "t"]).join(p, [*pair, "p"])


def scores(overlaps: DataFrame, criterion: str = "iou", pair: Sequence[str] = ()) -> DataFrame:
    """Adds score, by a criterion of CRITERIA."""
    f = S.CRITERIA[criterion]
    return marginals(overlaps, pair).withColumn("score", f(F.col("n"), F.col("t_total"), F.col("p_total")))


def _counts(overlaps: DataFrame, pair: Sequence[str]) -> DataFrame:
    """Instances on both sides, background left out; a row for each pair that has any voxel."""
    return overlaps.groupBy(*pair).agg(
        F.count_distinct(F.when(F.col("t") != 0, F.col("t"))).alias("n_true"),
        F.count_distinct(F.when(F.col("p") != 0, F.col("p"))).alias("n_pred"),
    )


def statistics(found: DataFrame) -> DataFrame:
    """Adds the ratios to rows that have n_true, n_pred, tp and score_sum."""
    tp, fp, fn = F.col("tp"), F.col("n_pred") - F.col("tp"), F.col("n_true") - F.col("tp")
    total = F.col("score_sum")
    return found.select(
        *[c for c in found.columns if c not in ("score_sum", "n_true", "n_pred", "tp")],
        "n_true",
        "n_pred",
        "tp",
        fp.alias("fp"),
        fn.alias("fn"),
        S.precision(tp, fp, fn).alias("precision"),
        S.recall(tp, fp, fn).alias("recall"),
        S.accuracy(tp, fp, fn).alias("accuracy"),
        S.f1(tp, fp, fn).alias("f1"),
        S.safe_divide(total, F.col("n_true").cast("double")).alias("mean_true_score"),
        S.safe_divide(total, tp.cast("double")).alias("mean_matched_score"),
        S.panoptic_quality(total, tp, fp, fn).alias("panoptic_quality"),
    )


def match(rows: DataFrame, thresholds: Sequence[float], criterion: str = "iou", pair: Sequence[str] = ()) -> DataFrame:
    """Statistics of the matching at each threshold.

    With IoU and a threshold over one half no label can qualify twice, so the
    qualifying overlaps are the matching, in plain SQL. Otherwise the matching
    with the most qualifying pairs, and of these the largest score, is found
    by assignment over the overlaps of each pair of labelings.
    """
    over = overlap(rows, pair)
    scored = scores(over, criterion, pair).filter("t <> 0 AND p <> 0")
    levels = [float(t or 0) for t in thresholds]
    sizes = _counts(over, pair)
    easy = [t for t in levels if criterion == "iou" and t > 0.5]
    hard = [t for t in levels if t not in easy]
    parts = []
    if easy:
        # A row of sums for all thresholds at once: one pass over the overlaps, no cross product.
        sums = [x for k, t in enumerate(easy) for x in (F.sum(F.when(F.col("score") >= t, 1).otherwise(0)).alias(f"tp{k}"), F.sum(F.when(F.col("score") >= t, F.col("score")).otherwise(0.0)).alias(f"s{k}"))]
        parts.append(_unfold(sizes, scored.groupBy(*pair).agg(*sums), easy, pair))
    if hard:
        found = assigned(over, criterion, hard, pair)
        sums = [x for k, t in enumerate(hard) for x in (F.sum(F.when((F.col("thresh") == t) & F.col("is_match"), 1).otherwise(0)).alias(f"tp{k}"), F.sum(F.when((F.col("thresh") == t) & F.col("is_match"), F.col("score")).otherwise(0.0)).alias(f"s{k}"))]
        parts.append(_unfold(sizes, found.groupBy(*pair).agg(*sums), hard, pair))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return statistics(out)


def _unfold(sizes: DataFrame, sums: DataFrame, levels: Sequence[float], pair: Sequence[str]) -> DataFrame:
    both = sizes.join(sums, list(pair), "left") if pair else sizes.crossJoin(sums)  # without pairs both are one row
    each = F.array(*[F.struct(F.lit(t).alias("thresh"), F.coalesce(f"tp{k}", F.lit(0)).cast("long").alias("tp"), F.coalesce(f"s{k}", F.lit(0.0)).alias("score_sum")) for k, t in enumerate(levels)])
    return both.select(*pair, "n_true", "n_pred", F.explode(each).alias("e")).select(*pair, "e.thresh", "n_true", "n_pred", "e.tp", "e.score_sum")


# ---- assignment


def assign(rows: Sequence[int], columns: Sequence[int], costs: Sequence[float], n: int, m: int) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, each row and column in one at most; what is not listed costs nothing, as does a row alone.

    Rows come one after the other; each takes the shortest augmenting path over
    the listed costs (Dijkstra's algorithm with potentials), which ends at a
    free column or at a row that is better off alone. So work and memory go
    with the listed costs near a row, not with rows times columns.
    """
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, c in zip(rows, columns, costs):
        near[i].append((j, c))
    u, v = [0.0] * n, [0.0] * m
    of_row, of_column = [-1] * n, [-1] * m
    for start in range(n):
        u[start] = min([0.0] + [c - v[j] for j, c in near[start]])
        dist: dict[int, float] = {}  # of columns, from the start
        came: dict[int, int] = {}  # the row that a column was reached from
        done: dict[int, float] = {}
        heap: list[tuple[float, int]] = []
        reached = [(start, 0.0)]
        end_row, end = start, -u[start]  # the best row to end at so far
        end_column = -1
        i, d = start, 0.0
        while True:
            for j, c in near[i]:
                to = d + c - u[i] - v[j]
                if j not in done and to < dist.get(j, math.inf):
                    dist[j], came[j] = to, i
                    heapq.heappush(heap, (to, j))
            while heap and (heap[0][1] in done or heap[0][0] > dist[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= end:
                break
            d, j = heapq.heappop(heap)
            if of_column[j] < 0:
                end_column, end = j, d
                break
            done[j] = d
            i = of_column[j]
            reached.append((i, d))
            if d - u[i] < end:
                end_row, end = i, d - u[i]
        for i, d in reached:
            u[i] += end - d
        for j, d in done.items():
            v[j] -= end - d
        if end_column < 0:
            # The row that ends the path stays alone; its column goes to the row before.
            end_column, of_row[end_row] = of_row[end_row], -1
            if end_row == start:
                continue
        j = end_column
        while j >= 0:
            i = came[j]
            of_column[j], of_row[i], j = i, j, of_row[i]
            if i == start:
                break
    return [(i, j) for i, j in enumerate(of_row) if j >= 0]


def best_pairs(frame: pd.DataFrame, n_matched: int, thresholds: Sequence[float], every: bool = False) -> pd.DataFrame:
    """Assigned pairs of one pair of labelings, from its scored overlaps.

    The cost of a pair is -[score >= threshold] - score / (2 n), n being the
    smaller number of instances, so the count of qualifying pairs comes first.
    With a threshold of zero or with ``every`` labels that are left over are
    paired as well, in their order, with score 0; the frame names all labels
    then, those without an overlap by rows where the other label is -1.
    """
    inner = frame[(frame.t >= 0) & (frame.p >= 0)]
    ts, t_at = np.unique(inner.t.values, return_inverse=True)
    ps, p_at = np.unique(inner.p.values, return_inverse=True)
    score = inner.score.values
    of = dict(zip(zip(t_at.tolist(), p_at.tolist()), score.tolist()))
    rows = []
    for thr in thresholds:
        cost = -(score >= thr).astype(float) - score / (2 * max(n_matched, 1))
        found = assign(t_at.tolist(), p_at.tolist(), cost.tolist(), len(ts), len(ps))
        pairs = [(int(ts[a]), int(ps[b]), of[a, b]) for a, b in found]
        if every or thr <= 0:
            left = [sorted(set(frame[c][frame[c] >= 0].tolist()) - {x[k] for x in pairs}) for k, c in enumerate(("t", "p"))]
            pairs += [(int(a), int(b), 0.0) for a, b in zip(*left)]
        rows += [(thr, a, b, s, bool(s >= thr)) for a, b, s in sorted(pairs)]
    return pd.DataFrame(rows, columns=["thresh", "t", "p", "score", "is_match"])


def assigned(over: DataFrame, criterion: str, thresholds: Sequence[float], pair: Sequence[str] = (), every: bool = False) -> DataFrame:
    """(pair, thresh, t, p, score, is_match) of the optimal assignment; a pair of labelings is a group.

    What a group holds is its overlapping label pairs, so its size goes with the
    number of instances of one volume, not with its voxels.
    """
    keys = list(pair)
    levels = [float(x) for x in thresholds]
    sizes = _counts(over, pair)
    table = scores(over, criterion, pair).filter("t <> 0 AND p <> 0").select(*keys, "t", "p", "score")
    if every or min(levels) <= 0:
        none = F.lit(-1).alias
        alone = over.filter("t <> 0").select(*keys, "t", none("p")).unionByName(over.filter("p <> 0").select(*keys, none("t"), "p")).distinct()
        table = table.unionByName(alone.withColumn("score", F.lit(-1.0)))
    if keys:
        table = table.join(sizes, keys)
    else:
        table = table.crossJoin(sizes)  # one row
    table = table.withColumn("n_matched", F.least("n_true", "n_pred").cast("int")).withColumn("one", F.lit(1))
    schema = ", ".join([f"{k} {over.schema[k].dataType.simpleString()}" for k in keys] + ["thresh double", "t int", "p int", "score double", "is_match boolean"])

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        out = best_pairs(frame, int(frame.n_matched.iloc[0]), levels, every)
        for k in reversed(keys):
            out.insert(0, k, frame[k].iloc[0])
        return out

    return table.groupBy(*(keys or ["one"])).applyInPandas(solve, schema)


def report_matches(rows: DataFrame, thresh: float = 0.5, criterion: str = "iou", pair: Sequence[str] = ()) -> DataFrame:
    """Matched pairs of labels with their scores and whether they reach the threshold, as arrays in the order of t."""
    found = assigned(overlap(rows, pair), criterion, [thresh], pair, every=True)
    listed = F.array_sort(F.collect_list(F.struct("t", "p", "score", "is_match")))
    return found.groupBy(*pair).agg(listed.alias("m")).select(
        *pair,
        F.transform("m", lambda x: F.struct(x.t.alias("t"), x.p.alias("p"))).alias("matched_pairs"),
        F.transform("m", lambda x: x.score).alias("matched_scores"),
        F.filter(F.transform("m", lambda x, i: F.when(x.is_match, i)), lambda i: i.isNotNull()).alias("matched_tps"),
    )


# ---- datasets


def match_dataset(rows: DataFrame, thresholds: Sequence[float], pair: Sequence[str], criterion: str = "iou", by_image: bool = False) -> DataFrame:
    """Statistics over many pairs: of the sums of their counts, or the averages of their statistics."""
    each = match(rows, thresholds, criterion, pair)
    if by_image:
        return each.groupBy("thresh").agg(
            *[F.sum(c).alias(c) for c in ("n_true", "n_pred", "tp", "fp", "fn")],
            *[F.avg(c).alias(c) for c in ("precision", "recall", "accuracy", "f1", "mean_true_score", "mean_matched_score", "panoptic_quality")],
        )
    total = each.groupBy("thresh").agg(
        F.sum("n_true").alias("n_true"), F.sum("n_pred").alias("n_pred"), F.sum("tp").alias("tp"), F.sum(F.col("mean_true_score") * F.col("n_true")).alias("score_sum")
    )
    return statistics(total).withColumns({"criterion": F.lit(criterion), "by_image": F.lit(False)})


def spread(each: DataFrame, columns: Sequence[str] = ("accuracy", "f1", "panoptic_quality")) -> DataFrame:
    """Mean and standard deviation of statistics over pairs, at each threshold."""
    return each.groupBy("thresh").agg(*[f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def mean_accuracy(each: DataFrame, pair: Sequence[str] = ()) -> DataFrame:
    """Accuracy averaged over thresholds."""
    return each.groupBy(*pair).agg(F.avg("accuracy").alias("mean_accuracy"))


# ---- tracking


def track(frames: DataFrame, thresh: float = 1e-10, criterion: str = "iou", seq: str = "seq_id") -> DataFrame:
    """Labels that follow instances from frame to frame.

    frames: seq_id, t (frame), z, y, x, label. Frame 0 keeps its labels; an
    instance matched to one of the frame before takes its label, others get
    the next free ones in the order of their labels. Overlaps of neighbouring
    frames are counted first, by all executors; only the fold over these
    small tables goes sequence by sequence. Returns (seq_id, t, label, track).
    """
    at = [seq, "z", "y", "x"]
    now = frames.select(*at, "t", F.col("label").alias("p"))
    was = frames.select(*at, (F.col("t") + 1).alias("t"), F.col("label").alias("q"))
    pair = [seq, "t"]
    over = overlap(now.join(was, [*at, "t"]).withColumnRenamed("t", "frame").withColumnRenamed("q", "t"), [seq, "frame"])
    scored = scores(over, criterion, [seq, "frame"]).filter("t <> 0 AND p <> 0").select(seq, "frame", "t", "p", "score")
    present = frames.filter("label <> 0").select(*pair, "label").distinct()
    listed = scored.select(F.col(seq), "frame", "t", "p", "score").unionByName(
        present.select(F.col(seq), F.col("t").alias("frame"), F.lit(-1).alias("t"), F.col("label").alias("p"), F.lit(-1.0).alias("score"))
    )

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        names: dict[int, int] = {}
        out, following = [], 1
        first = True
        for t in sorted(frame.frame.unique()):
            part = frame[frame.frame == t]
            labels = sorted(part.p[part.t == -1])
            pairs = part[part.t != -1]
            if first:
                new = {x: x for x in labels}
                following = max(labels, default=0) + 1
                first = False
            else:
                found = {}
                if len(pairs):
                    n = min(pairs.t.nunique(), len(labels))
                    best = best_pairs(pairs, n, [thresh])
                    found = {r.p: names[r.t] for r in best.itertuples() if r.is_match and r.t in names}
                new = {}
                for x in labels:
                    if x in found:
                        new[x] = found[x]
                    else:
                        new[x] = following
                        following += 1
            out += [(int(t), x, y) for x, y in new.items()]
            names = new
        got = pd.DataFrame(out, columns=["t", "label", "track"])
        got.insert(0, seq, frame[seq].iloc[0])
        return got

    kind = frames.schema[seq].dataType.simpleString()
    return listed.groupBy(seq).applyInPandas(fold, f"{seq} {kind}, t int, label int, track int")

