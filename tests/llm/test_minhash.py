import random

import numpy as np
import pytest

from voxelloom.llm import minhash as m
from voxelloom.llm import shingles as s
from voxelloom.llm.decontaminate import words_of

DOC = "doc_id long, text string"


def shingle_set(text):
    w = words_of((text or "").encode())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({(len(w), *w)} if w else set())


def brute(docs):
    """Least doc_id of the component of each document, links being equality and Jaccard of 0.8 or more."""
    sets = [shingle_set(t) for _, t in docs]
    top = list(range(len(docs)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            same = (docs[a][1] or "") == (docs[b][1] or "") or (sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
            if same and find(a) != find(b):
                top[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least.setdefault(find(k), []).append(i)
    return {i: min(least[find(k)]) for k, (i, _) in enumerate(docs)}


def say(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))


def near(rng, text, changes):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = "zz" + str(rng.randrange(10**6))
    return " ".join(w)


def test_shingles_are_those_of_the_words():
    rng = random.Random(0)
    texts = ["", "a", "a b c d", "A b, c d", "a b c d e", " ".join(["x"] * 50), say(rng, 200), "é " * 7, "...", "a b c d f"]
    owner, h, n = s.counted(*s.shingles([t.encode() for t in texts]))
    by = [set(h[owner == k].tolist()) for k in range(len(texts))]
    assert [len(x) for x in by] == [len(shingle_set(t)) for t in texts]
    assert by[2] == by[3] and not by[2] & by[9]
    assert n[owner == 5].tolist() == [46]


def test_signature_estimates_probability_jaccard():
    rng = random.Random(1)
    h = np.array([rng.getrandbits(64) for _ in range(60)], np.uint64)
    wa, wb = np.array([rng.choice([1.0, 2.0, 5.0]) for _ in range(40)]), np.array([rng.choice([1.0, 3.0]) for _ in range(40)])
    a, b = dict(zip(h[:40].tolist(), wa)), dict(zip(h[20:].tolist(), wb))
    want = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a | b) for d in a.keys() & b.keys())
    sign = m.prob_minhash(np.repeat([0, 1], 40), np.concatenate([h[:40], h[20:]]), np.concatenate([wa, wb]), 2, 20_000)
    assert abs((sign[0] == sign[1]).mean() - want) < 0.015
    # early termination changes nothing: a set's signature is the same beside others
    alone = m.prob_minhash(np.zeros(40, int), h[:40], wa, 1, 20_000)
    assert (alone[0] == sign[0]).all()


@pytest.mark.parametrize("options", [{}, {"block": 4, "splits": 2}, {"block": 3, "splits": 0}, {"block_shingles": 150, "splits": 1}])
def test_classes_are_brute_force(spark, options):
    rng = random.Random(5)
    docs = []
    for g in range(6):
        base = say(rng, 120)
        docs += [near(rng, base, rng.choice([0, 1, 1, 2, 3, 6, 12])) for _ in range(12)]
    shared = say(rng, 90)
    docs += [shared + " " + say(rng, 60) for _ in range(15)]
    docs += [say(rng, 30) for _ in range(10)] + ["", None, "one two", "One, two!", "one two three", "x " * 300, "x " * 400, "..", "long " * 40_000]
    docs = [(k * 2 + 1, t) for k, t in enumerate(docs)]
    rng.shuffle(docs)
    got = {r.doc_id: r for r in m.report(spark.createDataFrame(docs, DOC), **options).collect()}
    assert {i: r.class_id for i, r in got.items()} == brute(docs)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())
    kept = {r.doc_id for r in m.drop_near_copies(spark.createDataFrame(docs, DOC), **options).collect()}
    assert kept == {i for i, r in got.items() if r.kept}


@pytest.mark.parametrize("splits", [0, 1, 3])
def test_all_pairs_of_a_large_mixed_bucket_are_linked(spark, splits):
    rng = random.Random(17)
    base = say(rng, 60)
    docs = [(k, near(rng, base, rng.choice([0, 1, 2, 2, 3]))) for k in range(60)]
    options = {"bands": 3, "rows": 1, "block": 6}
    buckets = [set(x) for x in m.batch_bands([t.encode() for _, t in docs], 3, 1)]
    sets = [shingle_set(t) for _, t in docs]
    top = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if buckets[a] & buckets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((top[a], top[b]))
                top = [x if c == y else c for c in top]
    got = {r.doc_id: r.class_id for r in m.report(spark.createDataFrame(docs, DOC), splits=splits, **options).collect()}
    assert [got[k] for k in range(len(docs))] == top and 3 < len(set(top)) < 50


def test_near_copies_with_repeated_lines(spark):
    rng = random.Random(23)
    docs = []
    for k in range(25):
        w = say(rng, 120).split()
        w[0] = f"first{k}"
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:-8] + w[60:80] * rng.choice([5, 50, 300])))]
    want = brute(docs)
    assert all(want[2 * k + 1] == 2 * k for k in range(25))
    assert {r.doc_id: r.class_id for r in m.report(spark.createDataFrame(docs, DOC)).collect()} == want


def test_linking_pairs_are_brute_force():
    rng = random.Random(3)
    for _ in range(50):
        sets = [np.array(sorted(rng.sample(range(12), rng.randrange(1, 12))), np.int64) for _ in range(rng.randrange(2, 9))]
        classes = [rng.randrange(4) for _ in sets]
        found = m.linking_pairs(sets, classes, 4, 5)
        near = {(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
        assert set(found) <= near

        def groups(pairs):
            top = dict.fromkeys(classes)
            top = {c: c for c in top}
            for i, j in pairs:
                a, b = top[classes[i]], top[classes[j]]
                top = {c: b if t == a else t for c, t in top.items()}
            return {frozenset(c for c in top if top[c] == t) for t in top.values()}

        assert groups(found) == groups(near)


def test_a_large_group_makes_few_pairs(spark):
    rng = random.Random(9)
    base = say(rng, 200)
    docs = [(k, near(rng, base, 2)) for k in range(200)] + [(1000 + k, say(rng, 50)) for k in range(20)]
    got = {r.doc_id: (r.class_id, r.class_size) for r in m.report(spark.createDataFrame(docs, DOC)).collect()}
    assert {got[k] for k in range(200)} == {(0, 200)} and got[1003] == (1003, 1)


def test_nulls_repeated_rows_and_empty_table(spark):
    assert m.report(spark.createDataFrame([], DOC)).count() == 0
    docs = [(None, "a b c"), (None, "a b c"), (4, "a b c"), (4, "a b c"), (None, "alone here")]
    got = sorted((tuple(r) for r in m.report(spark.createDataFrame(docs, DOC)).collect()), key=repr)
    assert [g[:3] for g in got] == [(4, 4, 4), (4, 4, 4), (None, 4, 4), (None, 4, 4), (None, None, 1)]
    extra = spark.createDataFrame([(1, "a b", 3, "t")], DOC + ", class_id long, tid string")
    assert tuple(m.drop_near_copies(extra).first()) == (1, "a b", 3, "t")


def test_internal_names_as_input_columns(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, text, "x", 5), (2, text + " end", "y", 6), (3, "other", "z", 7)], "doc_id long, text string, _tid string, _HEAD int")
    got = m.drop_near_copies(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(1, text, "x", 5), (3, "other", "z", 7)]
