"""Encodings of strings that recur, kept by a worker within a bound.

Texts are handled as arrays of code points. Strings in them are looked up all
at once, by hashes of their letters, and the letters are compared; those that
are not known yet are encoded together. Most strings of a corpus come once, so
one is kept when it comes for the second time; before that, it is there for
its own batch. What is kept never changes a result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .shingles import mix

_U = np.uint64
#: Gives the ids of strings, one after the other, and how many each has.
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
#: Bits of hashes by which strings that have come once are known, a byte for each value; and how many such strings until that begins anew.
ONCE_BITS = 22
ONCE_MOST = 1 << 21


def code_points(texts: list[str]) -> np.ndarray:
    """The code points of texts, one after the other."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def as_text(letters: np.ndarray) -> str:
    return letters.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def runs(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... (count of them) for each pair, one after the other."""
    ends = np.cumsum(count)
    return np.repeat(begin - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


class Column:
    """An array that grows."""

    def __init__(self, kind):
        self.all, self.n = np.empty(1 << 12, kind), 0

    @property
    def data(self) -> np.ndarray:
        return self.all[: self.n]

    def add(self, more: np.ndarray) -> None:
        end = self.n + len(more)
        if end > len(self.all):
            grown = np.empty(max(end, len(self.all) * 3 // 2), self.all.dtype)
            grown[: self.n] = self.data
            self.all = grown
        self.all[self.n : end] = more
        self.n = end


class Kept:
    """Strings by number, with their letters and ids.

    Subclasses keep more of each string: they extend ``clear``, ``cut``, ``held``,
    ``make`` and ``taken``, which give and take what is added by ``extend``.
    Strings from number ``lasting`` on go with the next call.
    """

    def __init__(self, encode: Encode, most: int, ids_kind=np.uint32):
        self.encode, self.most, self.ids_kind = encode, most, ids_kind
        self.once, self.n_once = np.zeros(1 << ONCE_BITS, bool), 0
        self.clear()

    def clear(self) -> None:
        self.keys, self.of_key = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.key, self.begin, self.size, self.ids_begin = Column(np.uint64), Column(np.int64), Column(np.int64), Column(np.int64)
        self.ids_size, self.used = Column(np.int32), Column(np.int32)
        self.letters, self.ids = Column(np.uint32), Column(self.ids_kind)
        self.lasting = 0

    def cut(self, strings: int, letters: int, ids: int) -> None:
        """Only so many strings stay, which have so many letters and ids."""
        for column in (self.key, self.begin, self.size, self.ids_begin, self.ids_size, self.used):
            column.n = strings
        self.letters.n, self.ids.n = letters, ids

    def held(self) -> int:
        """What ``most`` bounds: here, letters."""
        return self.letters.n

    def make(self, letters: np.ndarray, sizes: np.ndarray) -> object:
        """What a subclass keeps of new strings."""

    def taken(self, which: np.ndarray) -> object:
        """The same of strings that are there."""

    def extend(self, more: object) -> None:
        """Keeps it; called before the strings themselves are added."""

    def _add(self, key: np.ndarray, letters: np.ndarray, sizes: np.ndarray, ids: np.ndarray, ids_sizes: np.ndarray, more: object, lasting: int) -> None:
        """Strings, of which the first ``lasting`` stay; these have ascending keys that are not there yet."""
        if lasting:
            at = np.searchsorted(self.keys, key[:lasting])
            self.keys = np.insert(self.keys, at, key[:lasting])
            self.of_key = np.insert(self.of_key, at, np.arange(self.lasting, self.lasting + lasting, dtype=np.int32))
            self.lasting += lasting
        self.extend(more)
        self.key.add(key)
        self.begin.add(self.letters.n + np.cumsum(sizes) - sizes)
        self.size.add(sizes)
        self.ids_begin.add(self.ids.n + np.cumsum(ids_sizes) - ids_sizes)
        self.ids_size.add(ids_sizes)
        self.used.add(np.zeros(len(sizes), np.int32))
        self.letters.add(letters)
        self.ids.add(ids)

    def _shrink(self) -> None:
        """Keeps what was used in more than one batch since the last time, or nothing if that is too much as well."""
        keep = np.flatnonzero(self.used.data > 1)
        keep = keep[np.argsort(self.key.data[keep], kind="stable")]
        begin, size, ids_size = self.begin.data[keep], self.size.data[keep], self.ids_size.data[keep]
        again = (self.key.data[keep], self.letters.data[runs(begin, size)], size, self.ids.data[runs(self.ids_begin.data[keep], ids_size)], ids_size, self.taken(keep), len(keep))
        self.clear()
        self._add(*again)
        if self.held() > self.most * 3 // 4:
            self.clear()

    def _new(self, key: np.ndarray, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray, lasting: int = 0) -> np.ndarray:
        own = letters[runs(starts, sizes)]
        ends = np.cumsum(sizes).tolist()
        joined = as_text(own)
        ids, ids_sizes = self.encode([joined[a:b] for a, b in zip([0, *ends], ends)])
        made = np.arange(self.size.n, self.size.n + len(sizes))
        self._add(key, own, sizes, ids, ids_sizes, self.make(own, sizes), lasting)
        return made

    def __call__(self, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each string of some letters, none of them empty. Numbers hold until the next call."""
        if self.size.n > self.lasting:
            self.cut(self.lasting, int(self.begin.data[self.lasting]), int(self.ids_begin.data[self.lasting]))
        if self.held() > self.most:
            self._shrink()
        if not len(starts):
            return np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        own = letters if int(ends[-1]) == len(letters) else letters[runs(starts, sizes)]
        weight = mix(np.arange(int(sizes.max()), dtype=np.uint64)) | _U(1)
        offset = np.arange(len(own)) - np.repeat(ends - sizes, sizes)
        key = mix(np.add.reduceat(own.astype(np.uint64) * weight[offset], ends - sizes) ^ sizes.astype(np.uint64))
        distinct, sample, inverse = np.unique(key, return_index=True, return_inverse=True)
        number = np.full(len(distinct), -1, np.int64)
        at = np.searchsorted(self.keys, distinct)
        there = np.flatnonzero(np.append(self.keys, _U(0))[at] == distinct)
        there = there[at[there] < len(self.keys)]
        number[there] = self.of_key[at[there]]
        new = np.flatnonzero(number < 0)
        if len(new):
            bits = distinct[new] & _U((1 << ONCE_BITS) - 1)
            again = self.once[bits]
            self.n_once += len(new) - int(again.sum())
            if self.n_once > ONCE_MOST:
                self.once[:], self.n_once = False, len(new)
            self.once[bits] = True
            new = np.append(new[again], new[~again])
            number[new] = self._new(distinct[new], letters, starts[sample[new]], sizes[sample[new]], int(again.sum()))
        out = number[inverse]
        # Equal hashes of unequal letters: such strings get numbers of their own.
        same = self.size.data[out] == sizes
        fit, long = out[same], sizes[same]
        alike = self.letters.data[runs(self.begin.data[fit], long)] == (own if same.all() else letters[runs(starts[same], long)])
        same[same] = np.logical_and.reduceat(alike, np.cumsum(long) - long) if len(fit) else True
        for k in np.flatnonzero(~same).tolist():
            out[k] = self._new(key[k : k + 1], letters, starts[k : k + 1], sizes[k : k + 1])[0]
        number[inverse] = out
        self.used.data[number] += 1
        return out

    def encoded(self, number: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs of strings that end at ``ends``, one after the other; where each run's ids begin, and the end."""
        size = self.ids_size.data[number].astype(np.int64)
        cut = np.append(0, np.cumsum(size))[np.append(0, ends)]
        return self.ids.data[runs(self.ids_begin.data[number], size)], cut
