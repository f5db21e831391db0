import random
import zlib

import numpy as np
import pytest

import corpus_pipeline as pipeline
from voxelloom.llm import pieces
from voxelloom.llm.queries import tokenizer_path


def say(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    items = [(k, say(rng, 20)) for k in range(5)]
    docs, labels = [], []
    for k in range(300):
        text = say(rng, 60)
        toxic = k % 10 == 0
        if toxic:
            w = text.split()
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["scoundrel", "villainous", "rotter"])
            text = " ".join(w)
        docs.append((k, text))
        if k % 2 == 0:
            labels.append((k, 1, int(toxic)))
    clean = [d for d in docs if d[0] % 10]
    docs += [(1000 + k, clean[k][1]) for k in range(20)]  # exact copies
    near = []
    for k in range(20, 40):
        w = clean[k][1].split()
        w[30] = "zzzz"
        near.append((1100 + k, " ".join(w)))
    docs += near
    docs += [(1200 + k, f"{say(rng, 40)} {items[k][1]} {say(rng, 40)}") for k in range(5)] + [(1300, items[0][1])]
    docs += [(1400, None), (1401, "")]
    root = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, dict(docs), dict(items)


def test_every_decision_takes_effect(spark, corpus, tmp_path):
    root, docs, items = corpus
    frame = spark.read.parquet(f"{root}/documents.parquet")
    columns, after = frame.columns, []
    for k, (_, work) in enumerate(pipeline.STAGES):
        work(spark, frame, root).write.parquet(f"{tmp_path}/{k}")
        frame = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert frame.columns == columns
            after.append({r.doc_id: r.text for r in frame.collect()})
    toxic = {i for i in range(0, 300, 10)}
    left = docs.keys() - toxic
    assert after[0].keys() == left and all(after[0][i] == docs[i] for i in left)
    # of equal texts the largest doc_id stays
    last = {}
    for i in sorted(left):
        last[docs[i] or ""] = i
    assert after[1].keys() == set(last.values())
    # near copies: the smaller doc_id stays
    assert after[2].keys() == {i for i in after[1] if not 1120 <= i < 1140}
    assert 1300 not in after[3] and after[3].keys() == after[2].keys() - {1300}
    for i, text in after[3].items():
        if 1200 <= i < 1205:
            item = items[i - 1200]
            assert item not in text and text == docs[i].replace(item, "")
        else:
            assert text == docs[i]
    v = pieces.load(tokenizer_path("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in frame.collect()}
    assert rows.keys() == after[3].keys()
    for i, text in after[3].items():
        ids = v.model.encode(text or "")
        assert np.frombuffer(bytes(rows[i].ids), "<u4").tolist() == ids and rows[i].round_trip
        assert rows[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and len(rows[i].samples) == (2 if text else 0)


def test_last_stage_keeps_sampled_ids(spark):
    v = pieces.load(tokenizer_path("piece_bpe_32k.model"))
    docs = spark.createDataFrame([(1, "a few words here"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pipeline.encode(spark, docs, "").collect()}
    assert {v.decode(np.frombuffer(s.ids, "<u4").tolist()) for s in got[1].samples} == {"a few words here"} and len({s.ids for s in got[1].samples}) == 2
    assert got[2].samples == [] and got[2].n_ids == 0


def test_run_is_its_stages(spark, corpus):
    root, docs, _ = corpus
    got = pipeline.run(spark, root)
    assert len({r.doc_id for r in got.collect()}) == len(docs) - 30 - 20 - 20 - 1 - 1  # toxic, copies, near copies, one of the empty texts, the item itself


def test_empty_tables(spark, corpus, tmp_path):
    root, _, _ = corpus
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{root}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
