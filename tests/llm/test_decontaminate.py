import hashlib
import random
import re

import pytest

from voxelloom.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC = "doc_id long, text string"
ITEM = "item_id long, text string"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    out = []
    for i, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            v = words(t)
            n = min(window, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            for k in range(len(w) - n + 1) if v else ():
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found.add(item)
        ids = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), ids, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_words_are_those_of_the_pattern():
    for text in ("Ünï x-Y_z 12a", "", "A\x00b\x7fC", "日本 語", "É" * 3):
        assert [x.decode() for x in d.words_of(text.encode())] == words(text)


@pytest.mark.parametrize("block", [500_000, 20])
def test_report_is_brute_force(spark, block):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(k, say(rng.choice([2, 3, 5, 12, 13, 14, 30]))) for k in range(12)] + [(90, None), (91, ""), (92, "..."), (7, "a b a b")]
    docs = [(k, say(rng.choice([0, 1, 4, 13, 40, 200])) + rng.choice(["", " " + items[k % 12][1].upper()])) for k in range(40)]
    docs += [(500, None), (501, ""), (502, "Q" * 100_000), (None, items[0][1]), (3, items[1][1]), (3, items[1][1])]
    found = d.find_hits(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), block_words=block)
    got = {(r.doc_id, r.n_words, sum(b - a for a, b in r.hit_spans), tuple(r.hit_items)) for r in found.collect()}
    want = brute(docs, items)
    assert {(x[0], x[1], x[2], len(x[3])) for x in got} == {x[:4] for x in want}
    if block > 100:
        rep = d.report(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM))
        assert sorted((tuple(r) for r in rep.collect()), key=repr) == want


def test_long_text_and_one_long_item(spark):
    item = " ".join(f"w{k}" for k in range(3000))
    docs = [(1, "x " * 200_000 + item + " y" * 10), (2, "x " * 20)]
    rows = {r.doc_id: r for r in d.report(spark.createDataFrame(docs, DOC), spark.createDataFrame([(5, item)], ITEM)).collect()}
    assert (rows[1].n_words, rows[1].n_hit, rows[1].contaminated) == (203_010, 3000, False) and rows[2].n_hit == 0


def test_empty_tables_and_other_columns(spark):
    none, items = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a b")], ITEM)
    assert d.report(none, items).count() == 0
    docs = spark.createDataFrame([(1, "a b", 7, 9)], "doc_id long, text string, n_words long, item_id long")
    assert [tuple(r) for r in d.report(docs, spark.createDataFrame([], ITEM)).collect()] == [(1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)]
    row = d.find_hits(docs, items).first()
    assert row.n_words == 2 and row.item_id == 9 and row.hit_items == [1]


def test_removal_takes_out_spans_only(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(1, f"Before it. {item.upper()}! After it, " + "more " * 30, 5), (2, item, 1), (3, None, None), (4, "clean text", 10), (5, " ".join(item.split()[:12]), 0)]
    got = {r.doc_id: r for r in d.remove_hits(spark.createDataFrame(docs, DOC + ", n_chars long"), spark.createDataFrame([(1, item)], ITEM)).collect()}
    assert got[1].text == "Before it. ! After it, " + "more " * 30 and got[1].n_chars == len(got[1].text)
    assert 2 not in got and got[3].text is None and tuple(got[4]) == docs[3] and tuple(got[5]) == docs[4]
