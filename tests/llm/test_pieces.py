import collections
import itertools
import math
import random
import time
import zlib

import numpy as np
import pytest

from voxelloom.llm import pieces, sampling, token_counts
from voxelloom.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
DOC = "doc_id long, text string"
ODD = ["", "a", " ", "  ", "\n", " a", "a ", "a\n b", "Hello   world\nfoo\tbar ", "日本語 😀 x\n\n\ny", "\x00 q", "a" * 300, "émü ñ ça"]


def segmentations(word, vocabulary):
    if not word:
        yield [], 0.0
    for k in range(1, min(len(word), vocabulary.longest) + 1):
        if word[:k] in vocabulary.score:
            for rest, p in segmentations(word[k:], vocabulary):
                yield [vocabulary.ids[word[:k]], *rest], vocabulary.score[word[:k]] + p


def probabilities(text, vocabulary):
    ways = {}
    for parts in itertools.product(*[list(segmentations(w, vocabulary)) for w in pieces.pre_tokens(text)]):
        ways[tuple(sum((p[0] for p in parts), []))] = math.exp(sum(p[1] for p in parts))
    total = sum(ways.values())
    return {k: v / total for k, v in ways.items()}


def viterbi(word, v):
    best = [(0.0, 0)] + [None] * len(word)
    for i in range(1, len(word) + 1):
        ways = [(best[i - k][0] + v.score[word[i - k : i]], best[i - k][1] + 1) for k in range(1, min(v.longest, i) + 1) if word[i - k : i] in v.score]
        if word[i - 1] not in v.score:
            n = len(word[i - 1].encode())
            ways.append((best[i - 1][0] + n * v.byte_score, best[i - 1][1] + n))
        best[i] = max(ways, key=lambda x: x[0])
    return best[-1][1]


def test_encoding_is_the_library_and_decodes():
    s, v = sampling.Sampler(PATH), pieces.load(PATH)
    for t, e in zip(ODD, s.encode(ODD)):
        ids = np.frombuffer(e, "<u4").tolist()
        assert ids == v.model.encode(t) and v.decode(ids) == t


def test_samples_follow_plackett_luce():
    v, text, n = pieces.load(PATH), "an ab", 20_000
    p = probabilities(text, v)
    got = sampling.Sampler(PATH, 3)([text] * n, np.arange(n))
    order = [collections.Counter(tuple(r[k]["ids"].tolist()) for r in got) for k in range(3)]
    second, third = collections.Counter(), collections.Counter()
    for a, b, c in itertools.permutations(p, 3):
        third[c] += p[a] * p[b] / (1 - p[a]) * p[c] / (1 - p[a] - p[b])
    for a, b in itertools.permutations(p, 2):
        second[b] += p[a] * p[b] / (1 - p[a])
    for want, seen in zip((p, second, third), order):
        assert all(abs(seen[k] / n - want[k]) < 0.015 for k in p)
    for r in got[:500]:
        assert len({tuple(x["ids"].tolist()) for x in r}) == 3 and r[0]["perturbed"] > r[1]["perturbed"] > r[2]["perturbed"]
        assert all(abs(x["log_prob"] - math.log(p[tuple(x["ids"].tolist())])) < 1e-9 for x in r)
    # inclusion scores make weighted sums unbiased
    mean = np.mean([sum(math.exp(x["log_prob"]) / x["inclusion"] * len(x["ids"]) for x in r) for r in got])
    assert abs(mean - sum(q * len(k) for k, q in p.items())) < 0.05


def test_all_segmentations_where_there_are_few():
    v = pieces.load(PATH)
    p = probabilities("a", v)
    rows = sampling.Sampler(PATH, 50)(["a"], np.array([3]))[0]
    assert {tuple(r["ids"].tolist()) for r in rows} == set(p) and all(r["inclusion"] == 1 for r in rows)


def test_samples_do_not_depend_on_the_batch():
    rng = random.Random(7)
    texts = ODD + [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(40)) for _ in range(20)]
    keys = np.arange(len(texts))
    s = sampling.Sampler(PATH, 3)
    show = lambda rows: [(r["ids"].tolist(), round(r["perturbed"], 9), round(r["inclusion"], 9)) for r in rows]
    together = [show(r) for r in s(texts, keys)]
    assert together == [show(s([x], keys[k : k + 1])[0]) for k, x in enumerate(texts)]
    v = pieces.load(PATH)
    for t, rows in zip(texts, together):
        assert len({tuple(r[0]) for r in rows}) == len(rows) and all(v.decode(r[0]) == t for r in rows)


def test_samples_keep_their_ids(spark):
    v = pieces.load(PATH)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, None)]
    docs = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r for r in sampling.encode_and_sample(docs, PATH).collect()}
    short = {r.doc_id: r for r in sampling.report(docs, PATH).collect()}
    for k, t in rows:
        assert np.frombuffer(got[k].ids, "<u4").tolist() == v.model.encode(t or "") and bool(got[k].samples) == bool(t)
        ways = [np.frombuffer(s.ids, "<u4").tolist() for s in got[k].samples]
        assert all(v.decode(w) == t for w in ways) and len({tuple(w) for w in ways}) == len(ways)
        own = sampling.Sampler(PATH)([t or ""], np.array([k or 0]))[0]
        assert ways == [s["ids"].tolist() for s in own]
        assert [tuple(s) for s in short[k].samples] == [(len(w), zlib.crc32(s.ids), s.log_prob, s.perturbed, s.inclusion) for w, s in zip(ways, got[k].samples)]


def test_decode_gives_the_texts_back(spark):
    rows = [(k, t) for k, t in enumerate(ODD + ["word " * 5000])] + [(None, None)]
    made = sampling.encode_and_sample(spark.createDataFrame(rows, DOC), PATH)
    got = sampling.decode(made, PATH, text="Text")
    assert got.columns == ["doc_id", "ids", "round_trip", "samples", "Text"]
    assert {r.doc_id: r.Text for r in got.collect()} == {k: t or "" for k, t in rows}
    each = made.filter("doc_id IS NOT NULL").select("doc_id", sampling.F.explode("samples.ids").alias("way"))
    assert all(r.again == rows[r.doc_id][1] for r in sampling.decode(each, PATH, "way", "again").collect())
    assert sampling.decode(spark.createDataFrame([(None,)], "ids binary"), PATH).first().text is None


def test_counts_are_viterbi(monkeypatch):
    v = pieces.load(PATH)
    trie = token_counts.ForwardTrie(v)
    words = {w for t in ODD for w in pieces.pre_tokens(t)} | {"▁hello", "hello", "▁hell", "xqzxqz", "▁" * 40, "😀é"}
    assert all(trie.insert(w) == viterbi(w, v) for w in words)
    monkeypatch.setattr(token_counts, "NODES", 5)
    small = token_counts.ForwardTrie(v)
    assert [small.counts([w]) for w in words] == [viterbi(w, v) for w in words]


def test_long_pre_tokens_are_counted_without_nodes():
    v, rng = pieces.load(PATH), random.Random(12)
    trie = token_counts.ForwardTrie(v)
    for w in ["".join(rng.choice("abtheñ日😀▁") for _ in range(n)) for n in (1, 7, 60, 400)]:
        assert trie.long(w) == trie.insert(w) == viterbi(w, v)
    n = len(trie.parent)
    assert trie.counts(["x" * 300_000]) > 0 and len(trie.parent) == n


def test_shared_prefixes_are_worked_out_once():
    trie = token_counts.ForwardTrie(pieces.load(PATH))
    trie.insert("▁interest")
    n = len(trie.parent)
    trie.insert("▁interesting")
    trie.insert("▁inter")
    assert len(trie.parent) == n + 3


@pytest.mark.parametrize("module", [sampling, token_counts])
def test_nulls_repeated_rows_and_empty_table(spark, module):
    assert module.report(spark.createDataFrame([], DOC), PATH).count() == 0
    rows = [(1, "same text", 5), (1, "same text", 5), (None, None, 6), (2, "", 7), (3, "word " * 20_000 + "w" * 3000, 8)]
    got = module.report(spark.createDataFrame(rows, DOC + ", n_tokens long"), PATH).collect()
    assert len(got) == 5 and got[0] == got[1]
    if module is sampling:
        assert got[2].n_ids == 0 and got[2].samples == [] and got[2].round_trip and len(got[4].samples) == 2
        want = pieces.load(PATH).model.encode("same text")
        assert got[0].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
    else:
        assert got[2].n_tokens == got[3].n_pre_tokens == 0 and got[4].n_pre_tokens == 20_001


def shown(rows):
    return [(r["ids"].tolist(), r["log_prob"], r["perturbed"], r["inclusion"]) for r in rows]


def test_what_is_kept_changes_nothing(monkeypatch):
    rng = random.Random(8)
    batches = [[" ".join("".join(rng.choice("abcdeé日\n") for _ in range(rng.randrange(1, 9))) for _ in range(60)) for _ in range(5)] + ODD for _ in range(12)]
    whole, small = sampling.Sampler(PATH, 3), sampling.Sampler(PATH, 3)
    small.words.most = 3000
    sizes = []
    for batch in batches:
        keys = np.arange(len(batch))
        assert [shown(r) for r in whole(batch, keys)] == [shown(r) for r in small(batch, keys)]
        assert whole.encode(batch) == small.encode(batch)
        sizes.append(small.words.piece.n)
    assert max(sizes) < whole.words.piece.n and any(b < a for a, b in zip(sizes, sizes[1:]))


def test_equal_hashes_of_unequal_words(monkeypatch):
    batch = ODD + ["one two three on tw"]
    want = [shown(r) for r in sampling.Sampler(PATH)(batch, np.arange(len(batch)))]
    encoded = sampling.Sampler(PATH).encode(batch)
    s, real = sampling.Sampler(PATH), np.unique
    monkeypatch.setattr(sampling.np, "unique", lambda x, **k: real(x & np.uint64(3) if x.dtype == np.uint64 else x, **k))
    assert s.encode(batch) == encoded and [shown(r) for r in s(batch, np.arange(len(batch)))] == want


def test_long_pre_tokens():
    rng = random.Random(9)
    s, v = sampling.Sampler(PATH), pieces.load(PATH)
    text = "".join(rng.choice("abcdefghéñ日本語テ") for _ in range(80_000))
    s(["warm up"], np.array([1]))
    begun = time.perf_counter()
    rows = s([text], np.array([5]))[0]
    took = time.perf_counter() - begun
    assert len(rows) == 2 and all(v.decode(r["ids"].tolist()) == text for r in rows) and rows[0]["perturbed"] > rows[1]["perturbed"]
    assert took < 5
    # The same walk step by step as for many at once.
    short = [text[:200]] * 30
    assert shown(s(short[:1], np.array([5]))[0]) == shown(s(short, np.full(30, 5))[0])


def test_pre_tokens_at_once_are_those_one_by_one():
    rng = random.Random(10)
    batch = ODD + ["".join(rng.choice("ab \n▁é😀") for _ in range(rng.randrange(30))) for _ in range(300)]
    letters, starts, many = sampling.letters_of(batch)
    text = letters.astype("<u4").tobytes().decode("utf-32-le")
    ends = [*starts.tolist()[1:], len(text)]
    want = [pieces.pre_tokens(t) for t in batch]
    assert [text[a:b] for a, b in zip(starts.tolist(), ends)] == sum(want, []) and many.tolist() == list(map(len, want))


def test_trie_leads_to_all_pieces_and_nowhere_else():
    v, table = pieces.load(PATH), sampling._table(PATH)

    def found(p):
        state = 0
        for c in p:
            to = table.base[state] + table.code[ord(c)]
            if table.parent[to] != state:
                return None
            state = to
        return table.ids[state]

    begun = {p[:k] for p in v.ids for k in range(1, len(p) + 1)}
    assert all(found(p) == v.ids.get(p, -1) for p in begun)
    rng, letters = random.Random(13), sorted({c for p in v.ids for c in p}) + ["๛", "\U0010ffff"]
    others = {p + rng.choice(letters) for p in begun for _ in range(3)} - begun
    assert len(others) > 100_000 and all(found(p) is None for p in others)


def test_pre_tokens_share_calls_of_the_library(monkeypatch):
    v, rng, seen = pieces.load(PATH), random.Random(14), []
    words = sorted({w for t in ODD for w in pieces.pre_tokens(t)} | {"".join(rng.choice("abeé▁日😀\x00\t") for _ in range(rng.randrange(1, 12))) for _ in range(500)})
    words = [x for w in words for x in pieces.pre_tokens(w)] + ["\n"] * 40

    class Library:
        def encode(self, texts, **more):
            seen.extend(texts)
            return real.encode(texts, **more)

    real = v.model
    monkeypatch.setattr(v, "model", Library())
    ids, sizes = v.encode_chunks(words)
    assert len(seen) <= len(words) / 16 + 1
    ends = np.cumsum(sizes).tolist()
    for w, a, b in zip(words, [0, *ends], ends):
        # Behind a letter, and a line feed that keeps it apart, a pre-token has the ids that it has in a text.
        assert ids[a:b].tolist() == real.encode("x\n" + w.replace("▁", " "))[len(real.encode("x\n")) :]
    assert [x.tolist() for x in v.encode_chunks([])] == [[], []]


def test_sums_with_and_without_logs(monkeypatch):
    rng, table = random.Random(15), sampling._table(PATH)
    words = ["".join(rng.choice("abtheñ日😀▁\x01\U0001fae8") for _ in range(rng.choice([1, 2, 5, 9, 30, 50, 90]))) for _ in range(300)]

    def made(batch):
        return sampling.lattice(sampling.code_points(batch), np.array(list(map(len, batch))), table)

    both, alone = made(words), [made([w]) for w in words]
    for name in ("piece", "step", "upto"):  # what is beside a pre-token does not count
        assert (getattr(both, name) == np.concatenate([getattr(x, name) for x in alone])).all()
    logs = []
    monkeypatch.setattr(sampling, "_backward", lambda *a, f=sampling._backward: logs.append(len(a[4])) or f(*a))
    made(words)
    assert 0 < logs.pop() < sum(map(len, words))
    monkeypatch.setattr(sampling, "LEAST", 0.0)
    slow = made(words)
    assert logs == [sum(map(len, words))] and (slow.piece == both.piece).all() and (slow.first == both.first).all()
    assert np.abs(slow.step - both.step).max() <= 64 and np.abs(slow.upto - both.upto).max() < 1e-6
    assert (both.upto[both.first[1:] - 1] == sampling.OVER).all()


def test_pre_tokens_are_kept_from_their_second_batch_on(monkeypatch):
    s, rng, made = sampling.Sampler(PATH), random.Random(16), []
    encode = s.words.encode
    s.words.encode = lambda words: made.append(set(words)) or encode(words)
    odd = ["".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(600)]
    for k in range(6):
        batch = ["every batch has these " + " ".join(odd[100 * k : 100 * k + 100])]
        rows = s(batch, np.array([k]))
        assert shown(rows[0]) == shown(sampling.Sampler(PATH)(batch, np.array([k]))[0])
    often = {"▁" + w for w in "every batch has these".split()}
    assert often <= made[0] and often <= made[1] and not any(often & m for m in made[2:])
    assert len(set().union(*made)) == 604 and s.words.lasting == len(s.words.keys) == 4
    assert s.words.size.n == 104 and s.words.first.n == s.words.letters.n + 1 and s.words.piece.n == s.words.first.data[-1]
    # Hashes of strings that came once are forgotten when there are too many.
    monkeypatch.setattr("voxelloom.llm.kept.ONCE_MOST", 150)
    for k in range(3):
        s([" ".join("ijkl"[k] + w for w in odd[:100])], np.array([0]))
        assert s.words.n_once <= 150 and int(s.words.once.sum()) <= 150
