import hashlib
import random

from voxelloom.llm import exact_dedup as e

DOC = "doc_id long, text string"


def brute(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(t or "", []).append(i)
    return {(i, max(g := groups[t or ""]), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in docs}


def test_report_is_brute_force(spark):
    rng = random.Random(1)
    stems = ["", "x", "a" * 63, "a" * 64, "a" * 65, "b" * 575, "b" * 576, "b" * 577, "é" * 2000, "c" * 40_000]
    docs = [(k, rng.choice(stems) + rng.choice(["", "1", "2"])) for k in range(150)] + [(900, None), (901, ""), (902, "\x00"), (903, "a" * 64 + "\x00")]
    rng.shuffle(docs)
    got = [tuple(r) for r in e.report(spark.createDataFrame(docs, DOC)).collect()]
    assert len(got) == len(docs) and set(got) == brute(docs)


def test_short_digits_go_through_many_levels(spark):
    docs = [(k, "ab" * (k % 7) + "c" * (k % 3)) for k in range(60)]
    got = e.exact_groups(spark.createDataFrame(docs, DOC), first=1, second=1).collect()
    want = {(i, k, n, b) for i, k, n, b, _ in brute(docs)}
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == want and {r.doc_id: r.text for r in got} == dict(docs)


def test_ties_nulls_and_clashing_names(spark):
    docs = [(1, "t", 5), (1, "t", 5), (None, "t", 6), (None, "u", 7), (None, "u", 7)]
    got = e.exact_groups(spark.createDataFrame(docs, DOC + ", kept long")).collect()
    assert len(got) == 5 and sum(r.kept for r in got) == 2
    assert {(r.text, r.keep_id, r.group_size) for r in got} == {("t", 1, 3), ("u", None, 2)}
    one = e.drop_copies(spark.createDataFrame(docs, DOC + ", kept long"))
    assert sorted(map(tuple, one.collect()), key=repr) == [(1, "t", 5), (None, "u", 7)]


def test_empty_table(spark):
    assert e.report(spark.createDataFrame([], DOC)).count() == 0


def test_internal_names_as_input_columns(spark):
    schema = "doc_id long, text string, _text string, _row int, _digit string, _GROUP int, _own__text int"
    rows = [(k, t, f"t{k}", k, "d", 7, k) for k, t in enumerate(["a" * 70, "a" * 70, "b", None, ""])]
    docs = spark.createDataFrame(rows, schema)
    got = e.exact_groups(docs)
    assert got.columns == [*docs.columns, "keep_id", "group_size", "kept"]
    assert {tuple(r)[:7]: (r.keep_id, r.group_size, r.kept) for r in got.collect()} == dict(zip(rows, [(1, 2, False), (1, 2, True), (2, 1, True), (4, 2, False), (4, 2, True)]))
    kept = e.drop_copies(docs)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == {rows[1], rows[2], rows[4]}
