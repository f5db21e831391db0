import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelloom.operators import labels as L
from voxelloom.operators import matching as M

PAIR = "t int, p int"


def test_closed_form_overlap(spark):
    rows = spark.createDataFrame(list(zip([0, 0, 1, 1, 2, 2], [0, 1, 1, 1, 0, 2])), PAIR)
    over = M.overlap(rows)
    assert {tuple(r) for r in over.collect()} == {(0, 0, 1), (0, 1, 1), (1, 1, 2), (2, 0, 1), (2, 2, 1)}
    iou = {(r.t, r.p): r.score for r in M.scores(over).collect()}
    assert iou[1, 1] == pytest.approx(2 / 3) and iou[2, 2] == pytest.approx(1 / 2)
    got = {r.thresh: r for r in M.match(rows, [0.5, 0.6]).collect()}
    assert (got[0.6].tp, got[0.6].fp, got[0.6].fn) == (1, 1, 1) and got[0.6].accuracy == got[0.6].panoptic_quality == pytest.approx(1 / 3)
    assert (got[0.5].tp, got[0.5].fp, got[0.5].fn) == (2, 0, 0) and got[0.5].panoptic_quality == pytest.approx(7 / 12)


def test_tie_at_one_half(spark):
    rows = spark.createDataFrame([(1, 1 + k // 5) for k in range(10)], PAIR)
    row = M.match(rows, [0.5]).first()
    assert (row.n_true, row.n_pred, row.tp) == (1, 2, 1)


def test_empty_sides_and_itself(spark):
    none = M.match(spark.createDataFrame([(0, 0), (0, 3)], PAIR), [0.3, 0.7]).collect()
    assert all((r.tp, r.fp, r.fn, r.precision, r.panoptic_quality) == (0, 1, 0, 0.0, 0.0) for r in none)
    same = M.match(spark.createDataFrame([(k % 5, k % 5) for k in range(50)], PAIR), [0.3, 0.9]).collect()
    assert all((r.tp, r.fp, r.fn, r.f1, r.panoptic_quality) == (4, 0, 0, 1.0, 1.0) for r in same)


def brute(score, thr, n):
    nt, np_ = score.shape
    best = None
    small = min(nt, np_)
    for a in itertools.permutations(range(max(nt, np_)), small):
        pairs = [(k, x) if nt <= np_ else (x, k) for k, x in enumerate(a)]
        value = sum((score[i, j] >= thr) + score[i, j] / (2 * n) for i, j in pairs)
        best = value if best is None else max(best, value)
    return best


def test_assignment_is_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, m = rng.integers(1, 6, 2)
        s = np.round(rng.random((n, m)) * (rng.random((n, m)) < 0.6), 2)
        thr = float(rng.choice([0.2, 0.5]))
        k = min(n, m)
        frame = pd.DataFrame([(i + 1, j + 1, s[i, j]) for i in range(n) for j in range(m) if s[i, j] > 0], columns=["t", "p", "score"])
        got = M.best_pairs(frame, k, [thr]) if len(frame) else pd.DataFrame(columns=["score", "is_match"])
        value = got.is_match.sum() + got.score.sum() / (2 * k)
        assert value == pytest.approx(brute(s, thr, k))


def test_report_names_original_labels(spark):
    rows = spark.createDataFrame([(5, 9)] * 4 + [(7, 3)] * 2 + [(7, 0)] * 6, PAIR)
    r = M.report_matches(rows, 0.5).first()
    assert [tuple(x) for x in r.matched_pairs] == [(5, 9), (7, 3)] and r.matched_scores == [1.0, 0.25] and r.matched_tps == [0]


def test_tracks_follow_and_are_not_revived(spark):
    boxes = {0: {1: (0, 4), 2: (6, 10)}, 1: {8: (0, 4)}, 2: {3: (0, 4), 4: (6, 10)}}
    rows = [("s", t, 0, 0, x, lab) for t, found in boxes.items() for lab, (a, b) in found.items() for x in range(a, b)]
    got = {(r.t, r.label): r.track for r in M.track(spark.createDataFrame(rows, "seq_id string, t int, z int, y int, x int, label int")).collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (1, 8): 1, (2, 3): 1, (2, 4): 3}


def test_relabel_and_its_inverse(spark):
    values = [1, 1, 5, 5, 8, 99, 42]
    rows = spark.createDataFrame([("v", 0, 0, k, x) for k, x in enumerate(values)], "volume_id string, z int, y int, x int, label int")
    assert [r.label for r in L.relabel(rows).orderBy("x").collect()] == [1, 1, 2, 2, 3, 5, 4]
    five = L.label_map(rows, 5)
    new = L.apply_map(rows, five)
    assert [r.label for r in new.orderBy("x").collect()] == [5, 5, 6, 6, 7, 9, 8]
    back = L.apply_map(new, L.inverse_map(five).withColumnRenamed("old", "new"))
    assert [r.label for r in back.orderBy("x").collect()] == values
    with pytest.raises(ValueError):
        L.label_map(rows, 0)
    shuffled = L.shuffle_labels(rows, 3)
    assert sorted({r.label for r in shuffled.collect()}) == sorted(set(values))


def test_components_are_a_flood(spark):
    from voxelloom.operators.volume_udf import label_faces

    rng = random.Random(6)
    a = np.array([[[rng.random() < 0.45 for _ in range(7)] for _ in range(6)] for _ in range(5)])
    rows = [("v", z, y, x, float(a[z, y, x])) for z in range(5) for y in range(6) for x in range(7)]
    got = np.zeros(a.shape, int)
    for r in L.components(spark.createDataFrame(rows, "volume_id string, z int, y int, x int, value double")).collect():
        got[r.z, r.y, r.x] = r.label
    assert (got == label_faces(a)).all()


def test_many_labels_in_one_chain():
    n = 20_000
    at = np.arange(n)
    pairs = pd.DataFrame({"t": np.concatenate([at, at[:-1]]) + 1, "p": np.concatenate([at, at[1:]]) + 1, "score": np.concatenate([np.full(n, 0.3), np.full(n - 1, 0.35)])})
    got = M.best_pairs(pairs, n, [0.2])
    assert got.is_match.sum() == n and got.score.sum() == pytest.approx(0.3 * n)


def test_report_pairs_all_labels(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (0, 4), (0, 5), (3, 0)], PAIR)
    got = M.report_matches(rows, 0.5).first()
    assert [(x.t, x.p) for x in got.matched_pairs] == [(1, 1), (2, 4), (3, 5)] and got.matched_scores == [1.0, 0.0, 0.0] and got.matched_tps == [0]
    zero = M.match(rows, [0.0]).first()
    assert (zero.tp, zero.fp, zero.fn) == (3, 0, 0)


def test_label_map_without_a_group_is_dense(spark):
    labels = spark.range(5000).select((F.col("id") * 7 % 5003).cast("int").alias("label"))
    got = sorted((r.label, r.new) for r in L.label_map(labels, 3, None).collect())
    want = sorted({int(k) * 7 % 5003 for k in range(5000)} - {0})
    assert got == [(x, k + 3) for k, x in enumerate(want)]
