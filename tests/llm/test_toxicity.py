import random

import numpy as np

from voxelloom.llm import toxicity as t

DOC = "doc_id long, text string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_edit_distance():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    terms = sorted({word(rng.randrange(3, 9)) for _ in range(25)})
    automaton = t.LexiconAutomaton(terms, fuzzy=5)
    for _ in range(3000):
        w = word(rng.randrange(1, 10))
        exact = w in terms
        near = [x for x in terms if len(x) >= 5 and distance(w, x) == 1]
        got = automaton.look(w)
        if exact:
            assert got == (terms.index(w), 0)
        elif near:
            assert got and got[1] == 1 and terms[got[0]] in near
        else:
            assert got is None


def test_beginnings_of_words():
    automaton = t.LexiconAutomaton(["abcdef*", "xyzzy"])
    assert automaton.look("abcdefgh") == (0, 0) and automaton.look("abcdef") == (0, 0) and automaton.look("abcde") is None
    assert automaton.look("xyzy") == (1, 1) and automaton.look("xyzzyx") == (1, 1) and automaton.look("xyzzyxx") is None


def test_quotation_is_not_abuse():
    s = t.Scorer(t.Model(["idiot"], [5.0], [0.0] * 10))
    abuse, quoted, miss = s.features("you are an idiot , truly"), s.features('he said "what an idiot" to them'), s.features("1d1ot idioot")
    assert abuse[2] > 0 and abuse[4] == 0 and abuse[5] > 0
    assert quoted[4] > 0 and quoted[2] == 0
    assert miss[3] > 0 and s.features("")[1:] == [0.0] * 9


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    got = t.report(docs, labels).join(labels, "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == t.crc_held_out(r.doc_id) for r in got)
    right = sum(r.predicted == r.toxic for r in out) / len(out)
    clean = [r.predicted for r in out if not r.toxic]
    assert right > 0.9 and np.mean(clean) < 0.03


def test_held_out_labels_are_not_learned(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{x}.parquet") for x in ("documents", "labels"))
    flipped = labels.withColumn("toxic", t.F.when(t.held_out(t.F.col("doc_id")), 1 - t.F.col("toxic")).otherwise(t.F.col("toxic")))
    assert t.train(docs, labels) == t.train(docs, flipped)


def test_a_text_that_does_not_fit_is_passed_over(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    ids = [r.doc_id for r in labels.filter(~t.held_out(t.F.col("doc_id"))).orderBy(t.F.xxhash64("doc_id")).collect()]
    long = {ids[0]: "a " * 600, ids[5]: "b " * 450}  # the first never fits, the other not beside the rest
    docs = spark.createDataFrame([(k, long.get(k, "some words")) for k in range(60) for _ in range(2)], DOC)
    got = t.training_rows(docs, labels, most_bytes=900)
    assert got == [("some words", k % 2) for k in ids if k not in long]


def test_nulls_ties_empty_and_clashing_names(spark):
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(40)] + [(None, 1), (3, None), (5, 1)], "doc_id long, toxic int")
    rows = [(k, "bad fellow " + "x " * k if k % 2 else "fine day " * k, 9.0) for k in range(40)] + [(None, "bad fellow", 1.0), (1, None, 1.0), (1, "", 1.0), (7, "w " * 200_000, None)]
    docs = spark.createDataFrame(rows, DOC + ", score double")
    got = t.report(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    by = {(r.doc_id, r.score) for r in got if r.doc_id == 1}
    assert len(by) <= 2
    kept = t.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} <= {9.0, 1.0, None}
    assert t.report(spark.createDataFrame([], DOC), labels).count() == 0
    assert t.report(docs.select("doc_id", "text"), labels.limit(0)).filter("predicted = 1").count() == 0
