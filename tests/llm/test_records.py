import random
import zlib

import numpy as np
import pytest

from voxelloom.llm import records as r
from voxelloom.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
DOC = "doc_id long, text string"


def brute(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for i, text in sorted(docs):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_crc32c_and_frames():
    assert r.crc32c([b"123456789", b"", b"\x00" * 32]).tolist() == [0xE3069283, 0, 0x8A9136AA]
    payloads = [bytes(range(256)) * 5, b"", b"x", b"abcdefgh"]
    framed = r.frame(payloads)
    assert r.unframe(framed) == payloads
    # the known frame of an empty record
    assert framed[1][:8] == bytes(8) and len(framed[1]) == 16
    with pytest.raises(ValueError):
        r.unframe([framed[0][:20] + b"!" + framed[0][21:]])


TEXTS = ["", None, " ", "\n\n", "It's 12 o'clock, don't!", "<|endoftext|> a<|startoftext|>b <|x|>", "Ünï cödé é é", "日本語 😀\tx\x1fy\x85z", "a" * 5000, "w " * 9000, "İΣ ΑΣ ς", "x́\ńy"]


@pytest.mark.parametrize("task_docs, shard_bytes", [(8_000, 1 << 20), (7, 1 << 20), (20, 100)])
def test_round_trip_is_the_library(spark, tmp_path, task_docs, shard_bytes):
    docs = [(k * 3, t) for k, t in enumerate(TEXTS)] + [(1000 + k, f"number {k} of many, {'very ' * k}") for k in range(40)]
    root = str(tmp_path / "shards")
    got = r.round_trip(spark.createDataFrame(docs, DOC), PATH, root, task_docs=task_docs, shard_bytes=shard_bytes)
    assert sorted(map(tuple, got.collect())) == brute(docs)


def test_round_trip_of_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(map(tuple, r.round_trip(docs, PATH).collect())) == brute([(d.doc_id, d.text) for d in docs.collect()])


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def ours(texts):
    return [np.frombuffer(x, "<u2").tolist() for x in r.TextEncoder(PATH)(texts)]


def test_ids_of_every_letter_before_every_sign():
    signs = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalpha()]
    letters = [chr(c) for c in range(0x80, 0x30000) if chr(c).isalpha() and not 0x3400 < c < 0xD7A4 and c < 0x20000] + [chr(c) for c in (0x3400, 0x4E00, 0x9FFF, 0xAC00, 0xD7A3, 0x20000)]
    texts = [f"a{c}( {c}' x{c}1 ({c} {c}́, {c}̸=" for c in letters]
    assert ours(texts) == library(texts)
    few = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()] + list("क़İŉǅΣẞÅﬁ")
    texts = ["".join(f"{c}{s}{d} " for s in signs) for c in few for d in ("", "s", c, "́")]
    assert ours(texts) == library(texts)


def test_ids_of_random_texts():
    rng = random.Random(3)
    parts = ["'s", "'t", "'re", "'", "''", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "|>", "a", "Bc", "É", "é", "É", "́", "H̱", "क़", "가", "가", "日本", "12", "½", "²", "_", "-", ".", "̸", "=", "‍", " ", " ", "\x0b", "\t", "\r", " ", " ", "\n", "İ", "ǅ", "ß", "ẞ", "ͅ", "ª", "Σ", "\x1f", "\x85", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(6000)]
    assert ours(texts) == library(texts)


def test_what_is_kept_changes_nothing(monkeypatch):
    rng = random.Random(4)
    batches = [["".join(rng.choice("abcDE' .\né") for _ in range(200)) for _ in range(5)] for _ in range(12)]
    monkeypatch.setattr(r, "KEPT_LETTERS", 300)
    small, want = r.TextEncoder(PATH), [library(b) for b in batches]
    assert [[np.frombuffer(x, "<u2").tolist() for x in small(b)] for b in batches] == want
    monkeypatch.setattr(r, "CHARS", 150)
    assert ours(batches[0]) == want[0]
    real = np.unique
    monkeypatch.setattr(np, "unique", lambda x, **k: real(x & np.uint64(3) if x.dtype == np.uint64 else x, **k))
    assert ours(batches[0]) == want[0]


def test_long_strings_without_spaces():
    text = "".join(random.Random(5).choice("abcdefgh日本語,.é") for _ in range(300_000))
    assert ours([text, text[:1000]]) == library([text, text[:1000]])


def test_index_reads_any_order(spark, tmp_path):
    docs = [(k, f"text {k}") for k in range(20)] + [(None, "no id")]
    root = str(tmp_path / "s")
    manifest = r.write_texts(spark.createDataFrame(docs, DOC).coalesce(1), PATH, root).collect()
    assert sum(m.records for m in manifest) == 21
    at, where = [], r.qualified(spark, root)
    for m in manifest:
        at += r.read_records(where, m.part, m.turn, list(range(m.records))[::-1])[::-1]
    assert [r.doc_id_of(p) for p in at] == [None, *range(20)]
    last = manifest[-1]
    assert r.doc_id_of(r.read_records(where, last.part, last.turn, [last.records - 1, 0])[0]) == 19


def test_nulls_repeated_rows_and_empty_table(spark):
    assert r.round_trip(spark.createDataFrame([], DOC), PATH).count() == 0
    docs = [(5, "same text"), (5, "same text"), (5, None), (None, "of none"), (None, None)]
    got = [tuple(x) for x in r.round_trip(spark.createDataFrame([(*d, "extra") for d in docs], DOC + ", ids string"), PATH, task_docs=2).collect()]
    assert sorted([g[0] or -1 for g in got]) == [-1, -1, 5, 5, 5] and sorted(g[2] for g in got if g[0]) == [1, 3, 3]
    by_start = sorted(got, key=lambda g: g[1])
    assert [g[0] for g in by_start] == [None, None, 5, 5, 5] and [g[1] for g in by_start] == np.cumsum([0] + [g[2] for g in by_start[:-1]]).tolist()
