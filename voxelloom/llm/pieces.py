"""The pieces of a SentencePiece vocabulary as a unigram model, and how texts fall into pre-tokens.

Vocabularies of the BPE kind have merge ranks where unigram ones have log
probabilities; a piece of rank r gets the log of 1 / (r + OFFSET), normalised.
A character that no piece is falls back to its UTF-8 bytes.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np

SPACE = "▁"
#: Zipf-Mandelbrot offset of the rule above.
OFFSET = 10.0
#: Added to the least score for each byte of a character without a piece.
BYTE_PENALTY = -3.0
#: Pre-tokens in a call of the library.
TOGETHER = 16

# No piece but runs of SPACE has a SPACE behind another character, and none has a line feed;
# so texts fall apart before runs of spaces and around line feeds.
_PRE = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens in order; their concatenation is the text with SPACE for spaces and one more in front. None for an empty text."""
    return _PRE.findall(SPACE + text.replace(" ", SPACE)) if text else []


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        special = [self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) for i in range(n)]
        self.byte_ids = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        rank = np.arange(n) - sum(special) + OFFSET
        logp = -np.log(np.maximum(rank, OFFSET))
        logp -= np.log(np.exp(logp[[not s for s in special]]).sum())
        self.score = {p: float(logp[i]) for i, p in enumerate(names) if not special[i]}
        self.ids = {p: i for i, p in enumerate(names) if not special[i]}
        self.byte_score = min(self.score.values()) + BYTE_PENALTY
        self.longest = max(map(len, self.score))
        self.as_bytes = [bytes([self.byte_ids.index(i)]) if self.model.is_byte(i) else b"" if s else p.replace(SPACE, " ").encode() for i, (p, s) in enumerate(zip(names, special))]

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of pre-tokens, one after the other, and how many each has."""
        # No piece has a line feed, so pre-tokens are encoded TOGETHER at once, a line feed in front of each. The library sets a
        # space in front of all; it and the line feeds are taken off. Those that are line feeds themselves are left empty here.
        plain = ["" if c == "\n" else c for c in chunks]
        joined = ["\n" + "\n".join(plain[k : k + TOGETHER]).replace(SPACE, " ") for k in range(0, len(plain), TOGETHER)]
        found = self.model.encode(joined, num_threads=1)
        ids = np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found)))
        lead = np.cumsum([0] + [len(x) for x in found[:-1]])
        ids = np.delete(ids, lead) if len(found) else ids
        feed = np.flatnonzero(ids == self.byte_ids[0x0A])
        sizes = np.diff(feed, append=len(ids)) - 1
        alone = np.fromiter((c == "\n" for c in chunks), bool, len(chunks))
        keep = np.ones(len(ids), bool)
        keep[feed[~alone]] = False
        return ids[keep], sizes + alone

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space in front."""
        return b"".join(map(self.as_bytes.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(2)
def load(path: str) -> Pieces:
    return Pieces(path)
