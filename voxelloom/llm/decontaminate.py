"""Benchmark decontamination with a generalised suffix automaton.

The items' word sequences go into one automaton. A document is streamed
through it word by word, which yields at each word the longest run of words,
ending there, that some item has; where that run covers a window (``WINDOW``
consecutive words of an item, or a shorter item as a whole) the window's words
are hit.

The automaton is built on the driver from at most ``BLOCK_WORDS`` words of
items, so what is broadcast is bounded; a larger benchmark is worked through
in blocks of that size, each document against every block.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, raw, shield, with_arrow

WINDOW = 13
#: Words of one automaton: about 300 bytes of Python each, so 150 MB at most.
BLOCK_WORDS = 500_000
#: A document is contaminated when hit words are at least one in so many.
COVERAGE = 20
#: A document of which so large a part is hit goes when spans are removed.
DROP_COVERAGE = 0.5

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, with A-Z lowered."""
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """All runs of words of all items; ``need`` and ``found`` say what a match reports."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(i, w) for i, w in items if w]
        for _, words in items:
            self._insert(words)
        self._report(items)

    def _state(self, length: int, link: int, edges: dict[bytes, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, parent: int, word: bytes, child: int) -> int:
        """A copy of child that holds its runs up to parent's length and one word."""
        copy = self._state(self.length[parent] + 1, self.link[child], dict(self.next[child]))
        self.link[child] = copy
        while parent >= 0 and self.next[parent].get(word) == child:
            self.next[parent][word] = copy
            parent = self.link[parent]
        return copy

    def _insert(self, words: list[bytes]) -> None:
        last = 0
        for w in words:
            there = self.next[last].get(w)
            if there is not None:
                last = there if self.length[there] == self.length[last] + 1 else self._split(last, w, there)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
            last = new

    def _report(self, items: list[tuple[object, list[bytes]]]) -> None:
        size, k = len(self.next), self.window
        self.whole: dict[int, set] = {}  # state of a short item: the items that it is
        self.holds: dict[int, set] = {}  # state of a window: the items that hold it
        for item, words in items:
            if len(words) < k:
                state = 0
                for w in words:
                    state = self.next[state][w]
                self.whole.setdefault(state, set()).add(item)
                continue
            for _, state, length in self.match(words):
                if length >= k:
                    self.holds.setdefault(self.anchor(state), set()).add(item)
        never = 1 << 60
        self.need = [never] * size
        for state in sorted(range(1, size), key=self.length.__getitem__):
            self.need[state] = min(
                self.need[self.link[state]],
                self.length[state] if state in self.whole else never,
                k if self.length[state] >= k else never,
            )

    def anchor(self, state: int) -> int:
        """The state of the last ``window`` words of a match that is as long at least."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def match(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """For each word: its place, the state, and the length of the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        for i, w in enumerate(words):
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nxt[state].get(w)
            if to is None:
                n = 0
            else:
                state = to
                n += 1
            yield i, state, n

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans of places, merged and half-open, and the items whose windows occur."""
        nxt, link, length, need = self.next, self.link, self.length, self.need
        state = n = 0
        ends = []
        for i, w in enumerate(words):
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nxt[state].get(w)
            if to is None:
                n = 0
            else:
                state = to
                n += 1
                if n >= need[state]:
                    ends.append((i, state, n))
        spans: list[tuple[int, int]] = []
        items: set = set()
        for i, state, n in ends:
            longest = 0
            if n >= self.window:
                longest = self.window
                items |= self.holds[self.anchor(state)]
            while state:
                if length[state] <= n and state in self.whole:
                    longest = max(longest, length[state])
                    items |= self.whole[state]
                state = link[state]
            start = i + 1 - longest
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, i + 1))
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks_of(benchmark: DataFrame, window: int, block_words: int) -> Iterator[SuffixAutomaton]:
    """Automata of at most block_words words each (a single longer item makes a block of its own)."""
    block: list[tuple[object, list[bytes]]] = []
    size = 0
    for item, text in benchmark.select("item_id", F.col("text").cast("binary")).toLocalIterator():
        words = words_of(bytes(text or b""))
        if block and size + len(words) > block_words:
            yield SuffixAutomaton(block, window)
            block, size = [], 0
        block.append((item, words))
        size += len(words)
    yield SuffixAutomaton(block, window)


_SPAN = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def find_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, cut: bool = False
) -> DataFrame:
    """Adds n_words, hit_spans (places of words, merged, half-open) and hit_items to each document.

    With ``cut`` the hit spans are taken out of the texts as well, by the pass
    that finds the last of them; null texts stay null.

    Null and empty texts have no words and no hits; items without words are
    passed over; items of equal text are all reported. Every row gets its own
    result, repeated rows too. Result columns replace input columns of the
    same name, other columns stay. An empty table on either side is fine.
    """
    spark = docs.sparkSession
    key = T.StructType([*benchmark.select("item_id").schema.fields])[0].dataType
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", _SPAN),
        T.StructField("hit_items", T.ArrayType(key)),
    ]
    out, scratch = docs, None
    blocks = blocks_of(benchmark, window, block_words)
    block, k = next(blocks), 0
    while block is not None:
        sent, block = spark.sparkContext.broadcast(block), next(blocks, None)
        cuts = cut and block is None
        inputs = ["text"] if not k else ["text", "hit_spans", "hit_items"]

        def start(sent=sent, cuts=cuts):
            gsa = sent.value

            def run(text, old_spans=None, old_items=None):
                n, spans, items = [], [], []
                before = zip(old_spans.to_pylist(), old_items.to_pylist()) if old_spans else None
                for t in raw(text):
                    words = words_of(t)
                    found, ids = gsa.scan(words)
                    if before:
                        was, had = next(before)
                        found = merged(found + [(x["begin"], x["end"]) for x in was])
                        ids = ids | set(had)
                    n.append(len(words))
                    spans.append([{"begin": a, "end": b} for a, b in found])
                    items.append(sorted(ids, key=lambda x: (x is not None, x)))
                made = [pa.array(n, pa.int64()), pa.array(spans, span_kind), pa.array(items, item_kind)]
                if cuts:
                    left = [t if not x else cut_words(t.encode(), [(y["begin"], y["end"]) for y in x]).decode() for t, x in zip(text.to_pylist(), spans)]
                    made.append(pa.array(left, pa.string()))
                return made

            return run

        from pyspark.sql.pandas.types import to_arrow_type

        span_kind, item_kind = to_arrow_type(_SPAN), to_arrow_type(T.ArrayType(key))
        if k:  # one automaton at a time in a worker
            scratch = scratch or Scratch(spark, "decontaminate")
            out = scratch.write(out, f"block{k}")
            if k > 1:
                scratch.drop(f"block{k - 1}")
        out = with_arrow(out, inputs, fields + ([T.StructField("text", T.StringType())] if cuts else []), start)
        k += 1
    return out


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from each span's first word to its last."""
    places = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    out.append(text[at:])
    return b"".join(out)


def remove_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    drop_coverage: float = DROP_COVERAGE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Takes hit spans out of the texts; drops documents of which at least drop_coverage is hit.

    Columns stay as they are (n_chars is set anew where a text changes), and
    null texts stay null. Spans are those of the text as given: what comes
    together where a span was is not searched again.
    """
    safe, back = shield(docs, ["n_words", "hit_spans", "hit_items"])
    found = find_hits(safe, benchmark, window, block_words, cut=True)
    hit = F.expr("aggregate(hit_spans, 0L, (s, x) -> s + x.end - x.begin)")
    cut = found.filter((hit == 0) | (hit < drop_coverage * F.col("n_words")))
    if "n_chars" in docs.columns:
        changed = F.size("hit_spans") > 0
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cut.select(*back)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The figures of each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_hits(docs.select("doc_id", "text"), benchmark, window)
    ids = F.array_join(F.array_sort(F.transform("hit_items", lambda x: x.cast("string"))), ",")
    n_hit = F.expr("aggregate(hit_spans, 0L, (s, x) -> s + x.end - x.begin)")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "hit_items", ids.alias("ids")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.col("ids").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (COVERAGE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
