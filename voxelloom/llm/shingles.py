"""Word shingles of texts as 64-bit hashes, for a batch of texts at once in NumPy."""

from __future__ import annotations

import numpy as np

#: Words of a shingle.
WIDTH = 5
#: Bytes of text worked on at once; a longer text is worked on alone.
CHUNK = 1 << 20

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_PRIME = 0x100000001B3
_INVERSE = pow(_PRIME, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(256, dtype=np.uint64))
_PLACE = mix(np.arange(1000, 1000 + 64, dtype=np.uint64)) | np.uint64(1)


class _Powers:
    """Powers of the multiplier and of its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            full = np.full(max(n, CHUNK + 4096), _PRIME, np.uint64)
            full[0] = 1
            self.up = np.cumprod(full, dtype=np.uint64)
            full[1:] = np.uint64(_INVERSE)
            self.down = np.cumprod(full, dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


def word_hashes(folded: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a text whose other characters are spaces."""
    data = np.frombuffer(folded, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = data != 32
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _POWERS.to(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:], dtype=np.uint64)
    return starts, mix((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(np.uint64))


def shingles(batch: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The text's number and the hash of each shingle, in order; a text of fewer words, but some, is one shingle."""
    folded = [t.translate(_FOLD) for t in batch]
    sizes = np.fromiter((len(t) + 1 for t in folded), np.int64, len(folded))
    begins = np.cumsum(sizes) - sizes
    starts, words = word_hashes(b" ".join(folded))
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner = np.searchsorted(begins, starts, "right") - 1
    many = np.bincount(owner, minlength=len(batch))
    out_owner, out = [], []
    n = len(words) - width + 1
    if n > 0:
        h = np.zeros(n, np.uint64)
        for j in range(width):
            h += words[j : j + n] * _PLACE[j]
        whole = owner[:n] == owner[width - 1 :]
        out_owner.append(owner[:n][whole])
        out.append(mix(h[whole]))
    short = np.flatnonzero((many > 0) & (many < width))
    if len(short):
        first = np.searchsorted(owner, short)
        h = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            on = many[short] > j
            h[on] += words[first[on] + j] * _PLACE[j]
        out_owner.append(short)
        out.append(mix(h ^ many[short].astype(np.uint64)))
    owner, h = np.concatenate(out_owner), np.concatenate(out)
    if len(short):
        order = np.argsort(owner, kind="stable")
        owner, h = owner[order], h[order]
    return owner, h


def counted(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) in that order, and how often each occurs."""
    if not len(h):
        return owner, h, np.zeros(0, np.int64)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.append(at, len(h)))


def chunks(batch: list[bytes], most: int = CHUNK):
    """Runs of the batch of about ``most`` bytes."""
    run: list[bytes] = []
    held = 0
    for t in batch:
        if run and held + len(t) > most:
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t) + 1
    if run:
        yield run
