"""Toxicity: a lexicon caught by Levenshtein automata, with scores of the context.

The lexicon is learned from labelled documents: words, and word beginnings,
that toxic documents have and others have not. The Levenshtein automata of its
terms are run against the terms' trie, as one automaton whose states are sets
of (trie node, edits left) and whose transitions are worked out when first
needed; so a word is looked up in one pass, misspelled or not.

Every occurrence is weighed by its context window: inside quotation marks, or
after a verb of reporting, it counts as a quotation, and next to a word of
address as abuse. Sums and rates of these go into a logistic regression.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from array import array
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import resident, shield, texts, with_arrow

#: Labelled documents that the model is fitted on, at most, and bytes of text in all of them together.
SAMPLE_DOCS = 6000
SAMPLE_BYTES = 32 << 20
#: Terms of the lexicon, at most; lift and toxic documents that a term needs at least.
TERMS, LIFT, SUPPORT = 400, 25.0, 5
#: Lengths of word beginnings that can be terms; one edit is allowed in terms of so many letters.
STEM = range(4, 10)
FUZZY = 5
#: Words on either side of a term that are looked at.
CONTEXT = 6
THRESHOLD = 0.7
CACHE_ENTRIES = 300_000

# Verbs of reporting and words of address, in the four languages of the tables.
REPORTING = "said says wrote quoted called sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()
ADDRESS = "you your you're youre du dich dein ihr euch tu toi ton vous votre tú usted vosotros tus".split()

_WORD = re.compile(r"[^\W_]+|[\"“”„«»]")
_QUOTES = frozenset('"“”„«»')
# Digits and signs that stand for letters.
_LEET = str.maketrans("013457@$", "oleastas")


class LexiconAutomaton:
    """Terms with one edit allowed (insertion, deletion, substitution) in the longer ones.

    Looks a word up: (term, edits) of the best match or None. Terms that end in
    ``*`` match the beginnings of words, without edits; others match whole words.
    """

    def __init__(self, terms: list[str], fuzzy: int = FUZZY):
        self.terms = terms
        self.fuzzy = fuzzy
        self.child: list[dict[str, int]] = [{}]
        self.whole: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.deep: list[bool] = [False]
        for k, term in enumerate(terms):
            stem = term.endswith("*")
            letters = term.rstrip("*")
            at = 0
            for c in letters:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.whole.append(-1)
                    self.stem.append(-1)
                    self.deep.append(False)
                at = self.child[at][c]
            (self.stem if stem else self.whole)[at] = k
        self._reach()
        self.start = self._close(frozenset([(0, 0)]))
        self.moves: dict[tuple[frozenset, str], frozenset] = {}
        self.ids: dict[frozenset, int] = {}

    def _reach(self) -> None:
        """Which nodes lead to a whole term that is long enough for an edit."""
        order, depth = [0], {0: 0}
        for n in order:
            for c in self.child[n].values():
                depth[c] = depth[n] + 1
                order.append(c)
        self.long = [depth[n] >= self.fuzzy for n in range(len(self.child))]  # whether a term that ends here may have an edit
        for n in reversed(order):
            self.deep[n] = self.whole[n] >= 0 and self.long[n] or any(self.deep[c] for c in self.child[n].values())

    def _close(self, states: frozenset) -> frozenset:
        """Adds what a deletion reaches: a letter of the term that the word lacks."""
        out = set(states)
        for node, edits in states:
            if edits == 0:
                out.update((c, 1) for c in self.child[node].values() if self.deep[c])
        return frozenset(out)

    def step(self, states: frozenset, letter: str) -> frozenset:
        key = (states, letter)
        found = self.moves.get(key)
        if found is None:
            out = set()
            for node, edits in states:
                to = self.child[node].get(letter)
                if to is not None and (edits == 0 or self.deep[to]):
                    out.add((to, edits))
                if edits == 0:
                    if self.deep[node]:
                        out.add((node, 1))  # insertion
                    out.update((c, 1) for c in self.child[node].values() if c != to and self.deep[c])  # substitution
            found = self.moves[key] = self._close(frozenset(out)) if out else frozenset()
            if len(self.moves) > 200_000:
                self.moves = {}
        return found

    def look(self, word: str) -> tuple[int, int] | None:
        states, stem = self.start, None
        for c in word:
            states = self.step(states, c)
            if not states:
                return stem
            for node, edits in states:
                if not edits and self.stem[node] >= 0:
                    stem = (self.stem[node], 0)
        best = min(((e, self.whole[n]) for n, e in states if self.whole[n] >= 0 and (e == 0 or self.long[n])), default=None)
        return (best[1], best[0]) if best and (best[0] == 0 or not stem) else stem


@dataclass
class Model:
    """Terms with their weights, and the coefficients of the regression."""

    terms: list[str]
    weights: list[float]
    coefficients: list[float] = field(default_factory=list)
    context: int = CONTEXT


class Scorer:
    """Features and scores of texts under a model; keeps the look-ups of a bounded number of words."""

    def __init__(self, model: Model):
        self.model = model
        self.automaton = LexiconAutomaton(model.terms)
        self.kept: dict[str, tuple[int, int] | None] = {}
        self.side = {w: 1 for w in ADDRESS} | {w: 2 for w in REPORTING}

    def _look(self, word: str) -> tuple[int, int] | None:
        found = self.automaton.look(word)
        if found is None and not word.isalpha() and any(c.isalpha() for c in word):
            plain = self.automaton.look(word.translate(_LEET))
            found = (plain[0], 1) if plain else None
        if len(word) <= 32:
            if len(self.kept) > CACHE_ENTRIES:
                self.kept.clear()
            self.kept[word] = found
        return found

    def features(self, text: str) -> list[float]:
        words = _WORD.findall(text.lower())
        hits = []
        kept, missing = self.kept, object()
        for w in set(words):
            found = kept.get(w, missing)
            if found is missing:
                found = self._look(w)
            if found:
                hits.append(w)
        open_, exact, fuzzy, quoted, aimed, best = False, 0.0, 0.0, 0.0, 0.0, 0.0
        n, distinct = 0, set()
        if hits:
            marked = set(hits)
            for i, w in enumerate(words):
                if w in _QUOTES:
                    open_ = not open_
                elif w in marked:
                    term, edits = kept.get(w) or self._look(w)
                    weight = self.model.weights[term]
                    window = words[max(0, i - self.model.context) : i + self.model.context + 1]
                    sides = {self.side.get(x, 0) for x in window}
                    if open_ and _QUOTES.intersection(words[i + 1 : i + 1 + 4 * self.model.context]) or 2 in sides:
                        quoted += weight
                    elif edits:
                        fuzzy += weight
                    else:
                        exact += weight
                        best = max(best, weight)
                    aimed += weight * (1 in sides)
                    distinct.add(term)
                    n += 1
        rate = (exact + fuzzy) / math.sqrt(len(words) + 10)
        return [1.0, best, math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(aimed), math.log1p(len(distinct)), rate, float(n > 0), math.log1p(len(words)) * (n > 0)]

    def scores(self, batch: list[str]) -> np.ndarray:
        x = np.array([self.features(t) for t in batch], float).reshape(len(batch), -1)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.model.coefficients), -30, 30)))


def _terms_of(text: str) -> set[str]:
    found = set()
    for w in set(_WORD.findall(text.lower())):
        if len(w) > 2:
            found.add(w)
            found.update(w[:k] + "*" for k in STEM if len(w) > k)
    return found


def candidate_terms(rows: list[tuple[str, int]], support: int = SUPPORT) -> tuple[list[str], list[np.ndarray]]:
    """The terms that enough toxic rows have, and the numbers of those that each row has.

    Most terms occur once; they are first counted in buckets by hash, and only
    those of buckets that reach the support are then counted one by one.
    """
    mask = (1 << 22) - 1
    bucket = array("I", bytes(4 << 22))
    toxic_rows = [text for text, toxic in rows if toxic]
    for text in toxic_rows:
        for t in _terms_of(text):
            bucket[hash(t) & mask] += 1
    seen: Counter = Counter()
    for text in toxic_rows:
        seen.update([t for t in _terms_of(text) if bucket[hash(t) & mask] >= support])
    names = sorted(t for t, n in seen.items() if n >= support)
    del seen, bucket
    number = dict(zip(names, range(len(names))))
    return names, [np.array(sorted(number[t] for t in _terms_of(text) if t in number), np.int32) for text, _ in rows]


def learn_lexicon(names: list[str], found: list[np.ndarray], labels: list[int], terms: int = TERMS, lift: float = LIFT, support: int = SUPPORT) -> tuple[list[str], list[float]]:
    """Terms that toxic rows have so many times as often as others, the strongest first, and their log lifts.

    names and found: the candidate terms, and the numbers of those of each row. A word beginning that says no more
    than a longer term with as many rows gives way to it. With few rows the
    lift that a term without any clean row can reach is enough.
    """
    size = [labels.count(0), labels.count(1)]
    none = [np.zeros(0, np.int32)]
    many = [np.bincount(np.concatenate(none + [f for f, y in zip(found, labels) if y == k]), minlength=len(names)).tolist() for k in (0, 1)]
    count = tuple(dict(zip(names, n)) for n in many)
    if not size[0] or not size[1]:
        return [], []
    least = min(lift, support * size[0] / size[1] / 2)
    scored = []
    for term, n in count[1].items():
        ratio = (n / size[1]) / ((count[0][term] + 1) / size[0])
        if n >= support and ratio >= least and n > 2 * count[0][term] * size[1] / size[0]:
            scored.append((ratio, term))
    chosen: list[str] = []
    weights: list[float] = []
    whole: dict[str, int] = {}  # beginnings of the whole words chosen, with the rows of the most frequent one
    for ratio, term in sorted(scored, key=lambda x: (-x[0], x[1].endswith("*"), -len(x[1]), x[1])):
        letters = term.rstrip("*")
        if whole.get(letters, 0) >= count[1][term]:
            continue
        chosen.append(term)
        weights.append(math.log(ratio))
        if not term.endswith("*"):
            for k in range(1, len(term)):
                whole[term[:k]] = max(whole.get(term[:k], 0), count[1][term])
        if len(chosen) == terms:
            break
    return chosen, weights


def _regress(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method."""
    b = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (p - y) + penalty @ b
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, grad)
        b -= move
        if np.abs(move).max() < 1e-8:
            break
    return b


def fit(rows: list[tuple[str, int]], folds: int = 4) -> Model:
    """Learns the lexicon, and the regression on features of texts that the lexicon has not seen (by cross-fitting)."""
    labels = [toxic for _, toxic in rows]
    names, found = candidate_terms(rows)
    terms, weights = learn_lexicon(names, found, labels)
    xs, ys = [], []
    for k in range(folds):
        part = [i for i in range(len(rows)) if i % folds != k]
        scorer = Scorer(Model(*learn_lexicon(names, [found[i] for i in part], [labels[i] for i in part])))
        for i in range(k, len(rows), folds):
            xs.append(scorer.features(rows[i][0]))
            ys.append(labels[i])
    if not xs or len(set(ys)) < 2:
        share = (sum(ys) + 0.5) / (len(ys) + 1.0)
        return Model(terms, weights, [math.log(share / (1 - share))] + [0.0] * 9)
    return Model(terms, weights, _regress(np.array(xs), np.array(ys, float)).tolist())


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """At most ``most`` labelled documents that are not held out, a third of them toxic where there are so many.

    Rows are taken in the order of a hash of doc_id, so the sample is the same
    each time. Labels and documents without an id, and null labels, are passed over,
    and so is a text that does not fit into what is left of ``most_bytes``.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id"))).withColumn("turn", F.xxhash64("doc_id"))
    picked = known.filter("toxic = 1").orderBy("turn", "doc_id").limit(most // 3).unionByName(known.filter("toxic = 0").orderBy("turn", "doc_id").limit(most - most // 3))
    ids = [(r.doc_id, r.toxic, r.turn) for r in picked.collect()]  # at most ``most`` rows
    toxic = {i: t for i, t, _ in ids}
    if not toxic:
        return []
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in toxic], "doc_id long"))
    found: dict[int, str] = {}
    room = most_bytes
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(wanted, "doc_id", "left_semi")
    size = F.octet_length("text")
    got = got.filter(size <= most_bytes)  # what can not fit does not come to the driver
    for r in got.withColumns({"turn": F.xxhash64("doc_id"), "size": size}).orderBy("turn", "text").toLocalIterator():
        if r.doc_id not in found and r["size"] <= room:
            room -= r["size"]
            found[r.doc_id] = r.text
    return [(found[i], toxic[i]) for i, _, _ in sorted(ids, key=lambda x: (x[2], x[0])) if i in found]


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS) -> Model:
    return fit(training_rows(docs, labels, most))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= 0.7) by the whole text.

    Null counts as empty; an empty text gets the score of a text without terms.
    Equal texts get equal scores. Columns named score or predicted are replaced.
    """
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def start():
        scorer = resident(("scorer", name), lambda: Scorer(sent.value))

        def run(text):
            s = scorer.scores(texts(text))
            return [pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))]

        return run

    return with_arrow(docs, ["text"], [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], start)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    scored = score(docs.select(F.col("doc_id"), "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that are not predicted to be toxic, with the columns of docs."""
    safe, back = shield(docs, ["score", "predicted"])
    return score(safe, train(docs, labels)).filter("predicted = 0").select(*back)


def crc_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
