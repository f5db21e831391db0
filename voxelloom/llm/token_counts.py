"""Token counts by dynamic programming over a trie of pre-tokens.

Distinct pre-tokens are inserted in a trie. A node stands for a prefix; its
forward score is the best log probability of a segmentation of that prefix
into pieces, and its count the number of tokens of that segmentation. Both are
worked out once, when the node is made, from the nodes above it: a trie of
reversed pieces says which pieces end there. A pre-token's count is that of
its last node; a document's is the sum over its pre-tokens.

Each worker has a trie of its own, which its tasks share, emptied when it has NODES nodes. That costs
time only: counts depend on the vocabulary alone.
"""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import doc_texts, resident, texts, with_arrow
from .pieces import Pieces, load, pre_tokens

#: Nodes of a trie, about 250 bytes each; and pre-tokens whose counts are kept.
NODES = 600_000
KEPT = 300_000
#: Longer pre-tokens, in characters, are no part of the trie.
LONG = 2000


class ForwardTrie:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        # Reversed pieces: child by letter, and the score of the piece that ends there.
        self.rev_child: list[dict[str, int]] = [{}]
        self.rev_score: list[float | None] = [None]
        for piece, score in pieces.score.items():
            at = 0
            for c in reversed(piece):
                if c not in self.rev_child[at]:
                    self.rev_child[at][c] = len(self.rev_child)
                    self.rev_child.append({})
                    self.rev_score.append(None)
                at = self.rev_child[at][c]
            self.rev_score[at] = score
        self.kept: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # node << 21 | letter
        self.parent, self.letter = [0], [""]
        self.score, self.count = [0.0], [0]

    def _add(self, node: int, letter: str) -> int:
        """A new node below node: the best over all pieces that end with letter."""
        parent, letters, scores = self.parent, self.letter, self.score
        best = count = None
        above, c, rev = node, letter, 0
        while True:
            rev = self.rev_child[rev].get(c)
            if rev is None:
                break
            own = self.rev_score[rev]
            if own is not None and (best is None or scores[above] + own > best):
                best, count = scores[above] + own, self.count[above] + 1
            if not above:
                break
            c, above = letters[above], parent[above]
        n = len(letter.encode("utf-8", "replace"))
        if best is None or letter not in self.pieces.score and scores[node] + n * self.pieces.byte_score > best:
            best, count = scores[node] + n * self.pieces.byte_score, self.count[node] + n
        new = len(parent)
        parent.append(node)
        letters.append(letter)
        scores.append(best)
        self.count.append(count)
        self.child[node << 21 | ord(letter)] = new
        return new

    def insert(self, word: str) -> int:
        """Tokens of the best segmentation of word; of equal scores the one whose last piece is shortest."""
        node, child = 0, self.child
        for c in word:
            to = child.get(node << 21 | ord(c))
            node = self._add(node, c) if to is None else to
        return self.count[node]

    def long(self, word: str) -> int:
        """The same for a long word, which shares little: by its places in turn, without nodes."""
        scores, counts = array("d", [0.0]), array("q", [0])
        for i, letter in enumerate(word):
            best = count = None
            rev, k = 0, i
            while k >= 0:
                rev = self.rev_child[rev].get(word[k])
                if rev is None:
                    break
                own = self.rev_score[rev]
                if own is not None and (best is None or scores[k] + own > best):
                    best, count = scores[k] + own, counts[k] + 1
                k -= 1
            n = len(letter.encode("utf-8", "replace"))
            if best is None or letter not in self.pieces.score and scores[i] + n * self.pieces.byte_score > best:
                best, count = scores[i] + n * self.pieces.byte_score, counts[i] + n
            scores.append(best)
            counts.append(count)
        return counts[-1]

    def counts(self, words: list[str]) -> int:
        kept = self.kept
        total = 0
        for w in words:
            n = kept.get(w)
            if n is None:
                n = self.insert(w) if len(w) <= LONG else self.long(w)
                if len(w) <= 64:
                    kept[w] = n
                if len(self.parent) > NODES:
                    self.clear()
            total += n
        if len(kept) > KEPT:
            kept.clear()
        return total


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Adds n_pre_tokens and n_tokens. Null counts as empty: none of either. Columns of these names are replaced."""

    def start():
        trie = resident(("trie", path), lambda: ForwardTrie(load(path)))

        def run(text):
            split = [pre_tokens(t) for t in texts(text)]
            return [pa.array([len(x) for x in split], pa.int64()), pa.array([trie.counts(x) for x in split], pa.int64())]

        return run

    return with_arrow(docs, ["text"], [T.StructField("n_pre_tokens", T.LongType()), T.StructField("n_tokens", T.LongType())], start)


def report(docs: DataFrame, path: str) -> DataFrame:
    return count_tokens(doc_texts(docs), path).select("doc_id", "n_pre_tokens", "n_tokens")
