"""SentencePiece encoding and decoding, and sampled segmentations by Gumbel top-k.

A text's lattice is the chain of the lattices of its pre-tokens. Within these,
backward sums give each edge (a piece at a place) its probability given that
the place is reached, so a segmentation is a walk and the top of the tree of
all walks has mass one.

Distinct segmentations are drawn without replacement by a perturbed A* search.
A region of the tree is a walk up to some place and a set of edges that may
not follow there; its perturbed maximum is a Gumbel variable located at its log
mass and truncated at that of the region it was split from. The region with
the largest maximum is taken from the agenda, a walk is drawn in it, and what
remains of the region is split along that walk: one region for each place, of
the walks that leave it there. Walks come out in the order of their perturbed
log probabilities; the next maximum on the agenda is the threshold by which
the inclusion score 1 - exp(-exp(log p - threshold)) is given.

All draws come from a hash of the row's key, the walk's number and the place,
and log probabilities are added up as whole numbers, so that results do not
depend on how rows are dealt out. A batch of texts is worked on at once in
NumPy. A worker keeps the encodings and lattices of pre-tokens, those that
recur for longest, within a bound; what it keeps never changes a result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import resident, texts, with_arrow
from .kept import Column as KeptColumn
from .kept import Kept, code_points, runs
from .pieces import SPACE, Pieces, load
from .shingles import mix

#: Segmentations drawn for each text.
SAMPLES = 2
#: Characters worked on at once (a longer text alone).
CHARS = 150_000
#: Edges of the lattices that a worker keeps, some 20 bytes each with all that goes with them.
KEPT_EDGES = 4_500_000
#: Rounds over fewer places or walks than this are done one by one: long pre-tokens take many rounds.
FEW = 24
#: Log probabilities are kept in units of 2**-UNIT.
UNIT = 36
#: Pre-tokens whose every segmentation has a greater log probability than this are summed up without logs.
LEAST = -600.0
#: More than any sum of probabilities.
OVER = 2.0

_U = np.uint64


def _times(n: int, factor: int) -> np.uint64:
    return _U(n * factor & 0xFFFFFFFFFFFFFFFF)


def _uniform(key: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each key."""
    return ((mix(key) >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _units(logp: np.ndarray) -> np.ndarray:
    return np.rint(logp * float(1 << UNIT)).astype(np.int64)


class _Table:
    """The trie of all pieces as a double array: a state is a slot, and its child by a letter is at ``base`` + the letter's code if that slot's ``parent`` is the state.

    The root is slot 0; ``ids`` has the piece that ends in a state, or -1.
    """

    def __init__(self, pieces: Pieces):
        self.longest = pieces.longest
        children: dict[str, list[str]] = {"": []}
        for p in pieces.ids:
            for k in range(1, len(p) + 1):
                if p[:k] not in children:
                    children[p[:k]] = []
                    children[p[: k - 1]].append(p[k - 1])
        uses = Counter(chain.from_iterable(children.values()))
        code = {c: k + 1 for k, c in enumerate(sorted(uses, key=lambda c: (-uses[c], c)))}
        # By code point; 0 is that of letters that no piece has.
        self.code = np.zeros(0x110000, np.int16 if len(code) < 1 << 15 else np.int32)
        self.code[list(map(ord, code))] = list(code.values())
        self.base, self.parent, self.ids = _placed(children, code, pieces.ids)
        # By id: score, characters and bytes; the last entry is for -1, a character without a piece (its score is by its bytes).
        n = pieces.model.get_piece_size()
        self.byte_score = pieces.byte_score
        self.score = np.full(n + 1, pieces.byte_score)
        self.chars = np.ones(n + 1, np.int64)
        for p, i in pieces.ids.items():
            self.score[i], self.chars[i] = pieces.score[p], len(p)
        self.least = float(self.score.min())
        self.bytes = np.frombuffer(b"".join(pieces.as_bytes), np.uint8)
        self.byte_size = np.fromiter(map(len, pieces.as_bytes), np.int64, n)
        self.byte_begin = np.cumsum(self.byte_size) - self.byte_size


def _placed(children: dict[str, list[str]], code: dict[str, int], ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, parent and ids of the slots; states of many children are placed first, those of one child fill gaps."""
    most = len(code) + 1
    free = np.ones(2 * (most + len(children)), bool)
    free[:most] = False  # those of the root's children, and none that would take a base below 0
    where = {"": 0}
    inner = sorted((p for p, c in children.items() if p and c), key=lambda p: (-len(children[p]), p))
    several = [p for p in inner if len(children[p]) > 1]
    for k, p in enumerate(several):
        if k % 256 == 0:
            gaps, begin = np.flatnonzero(free), 0
        codes = np.array([code[c] for c in children[p]])
        for step in count(begin, 64):
            if step >= len(gaps) or gaps[min(step + 64, len(gaps)) - 1] + most > len(free):
                free = np.append(free, np.ones(64 * most, bool))
                gaps = np.flatnonzero(free)
            tried = gaps[step : step + 64] - codes[0]
            fits = np.flatnonzero((tried >= 0) & free[tried[:, None] + codes].all(axis=1))
            if len(fits):
                where[p], begin = int(tried[fits[0]]), step
                free[where[p] + codes] = False
                break
    where.update((p, g - code[children[p][0]]) for p, g in zip(inner[len(several) :], np.flatnonzero(free).tolist()))
    size = max(where.values()) + most
    base, parent, found, slot = np.zeros(size, np.int64), np.full(size, -1), np.full(size, -1, np.int32), {"": 0}
    for p in sorted(where, key=len):
        base[slot[p]] = where[p]
        for c in children[p]:
            slot[p + c] = to = where[p] + code[c]
            parent[to], found[to] = slot[p], ids.get(p + c, -1)
    return base, parent, found


@lru_cache(2)
def _table(path: str) -> _Table:
    return _Table(load(path))


def letters_of(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of texts with SPACE for spaces and one more in front, where pre-tokens begin, and how many pre-tokens each text has.

    The pre-tokens are those of ``pieces.pre_tokens``: an empty text has none.
    """
    letters = code_points([" " + t for t in batch if t])
    if not len(letters):
        return letters, np.zeros(0, np.int64), np.zeros(len(batch), np.int64)
    letters = np.where(letters == 0x20, np.uint32(ord(SPACE)), letters)
    space, feed = letters == ord(SPACE), letters == 0x0A
    begin = feed.copy()
    begin[1:] |= feed[:-1] | (space[1:] & ~space[:-1])
    sizes = np.fromiter((len(t) + 1 if t else 0 for t in batch), np.int64, len(batch))
    firsts = np.cumsum(sizes) - sizes
    begin[firsts[sizes > 0]] = True
    starts = np.flatnonzero(begin)
    return letters, starts, np.searchsorted(starts, firsts + sizes) - np.searchsorted(starts, firsts)


@dataclass(slots=True)
class Lattice:
    """Edges of pre-tokens one after the other, sorted by the place (character) they start at, long pieces first.

    An edge ends as many places on as its piece has characters.
    """

    first: np.ndarray  # first edge of each place, and an entry more
    piece: np.ndarray  # id, or -1 for a character that falls back to bytes
    step: np.ndarray  # log probability given the place, in units of 2**-UNIT
    upto: np.ndarray  # sum of probabilities, given the place, of its edges up to and with this one; OVER for the last of them


def _width(letters: np.ndarray) -> np.ndarray:
    """Bytes of each character in UTF-8."""
    return 1 + (letters > 0x7F).astype(np.int64) + (letters > 0x7FF) + (letters > 0xFFFF)


def lattice(letters: np.ndarray, sizes: np.ndarray, table: _Table) -> Lattice:
    """The lattices of pre-tokens of these sizes; what one gets does not depend on the others."""
    n = len(letters)
    far = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
    # Codes with a 0, which no piece has, behind each pre-token; where each place's is.
    spot = np.arange(n) + np.repeat(np.arange(len(sizes)), sizes)
    code = np.zeros(n + len(sizes), np.int64)
    code[spot] = table.code[letters]
    # The state of the letters from a place on, a letter more each round, while a piece begins so.
    place, state = np.arange(n), np.zeros(n, np.int64)
    made = np.zeros(n, np.int64)  # edges of each place so far
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k in range(table.longest):
        to = table.base[state] + code[spot + k]
        there = np.flatnonzero(table.parent[to] == state)
        if not len(there) and k:
            break
        place, spot, state = place[there], spot[there], to[there]
        piece = table.ids[state]
        whole = np.flatnonzero(piece >= 0)
        src = place[whole]
        if k == 0:
            odd = np.ones(n, bool)
            odd[src] = False
            odd = np.flatnonzero(odd)
            found.append((odd, np.full(len(odd), -1, np.int32), made[odd]))
            made[odd] = 1
        found.append((src, piece[whole], made[src]))
        made[src] += 1
    first = np.zeros(n + 1, np.int64)
    np.cumsum(made, out=first[1:])
    piece = np.empty(int(first[-1]), np.int32)
    edges = []
    for src, ids, rank in found:
        e = first[src + 1] - 1 - rank
        piece[e] = ids
        edges.append(e)
    value = table.score[piece]
    worst = np.full(n, table.least)
    if len(odd):
        value[edges[0]] *= _width(letters[odd])
        worst[odd] = np.minimum(value[edges[0]], table.least)
    start = np.repeat(np.arange(n), made)
    chars = table.chars[piece]
    # Sums of probabilities, but for pre-tokens whose sums may be too small for a number: these take logs.
    ends = np.cumsum(sizes)
    deep = np.repeat(np.add.reduceat(worst, ends - sizes) < LEAST, sizes) if n else np.zeros(0, bool)
    p, step = _ways(first, made, start, chars, value, np.where(deep, 0, far))
    if deep.any():
        some = np.flatnonzero(deep[start])
        of, ways = (np.cumsum(deep) - 1)[start[some]], value[some]
        back = _backward(np.append(0, np.cumsum(made[deep])), of, chars[some], ways, far[deep])
        step[some] = ways - back[of]
        p[some] = np.exp(step[some])
    upto, held = np.empty(len(piece), np.float32), np.zeros(n)
    for (src, _, _), e in zip(reversed(found), reversed(edges)):
        held[src] += p[e]
        upto[e] = held[src]
    upto[first[1:] - 1] = OVER
    return Lattice(first, piece, _units(step), upto)


def _ways(first: np.ndarray, made: np.ndarray, start: np.ndarray, chars: np.ndarray, value: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The probability of each edge given its place, and its log, where the place is ``far`` from the end of its pre-token; nothing for edges of places that are 0 from it.

    All places that are as far from the ends of their pre-tokens at once.
    """
    n = len(far)
    places = np.argsort(far.astype(np.uint16), kind="stable")
    bounds = np.append(0, np.cumsum(np.bincount(far, minlength=1)))
    # Places by their rank in that order, and the end of each pre-token as a rank more, from which there is one way.
    rank = np.empty(n + 1, np.int64)
    rank[places], rank[n] = np.arange(n), n
    count = made[places]
    cut = np.append(0, np.cumsum(count))
    by_rank = runs(first[places], count)
    from_ = start[by_rank]
    size = chars[by_rank]
    to = rank[np.where(far[from_] > size, from_ + size, n)]
    way = np.exp(value[by_rank])
    total = np.ones(n + 1)
    for a, b in zip(bounds[1:-1].tolist(), bounds[2:].tolist()):
        if a < b:
            low, high = cut[a], cut[b]
            way[low:high] *= total[to[low:high]]
            total[a:b] = np.add.reduceat(way[low:high], cut[a:b] - low)
    way /= total[rank[from_]]
    p = np.empty(len(way))
    p[by_rank] = way
    return p, np.log(p)


def _backward(first: np.ndarray, start: np.ndarray, chars: np.ndarray, value: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The log of the sum over all ways from each place; adds to each edge's value what follows it.

    All places that are as far from the ends of their pre-tokens at once.
    """
    n = len(far)
    back = np.zeros(n)
    most = int(far.max()) if n else 0
    places = np.argsort(far.astype(np.uint16) if most < 1 << 16 else far, kind="stable")
    bounds = np.cumsum(np.bincount(far, minlength=most + 1)).tolist()
    left = far[start] - chars  # characters that follow the edge in its pre-token
    a = 0
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a < FEW:
            break
        p = places[a:b]
        count = first[p + 1] - first[p]
        cut = np.cumsum(count) - count
        e = runs(first[p], count)
        v = value[e]
        more = np.flatnonzero(left[e] > 0)
        inner = e[more]
        v[more] += back[start[inner] + chars[inner]]
        value[e] = v
        top = np.maximum.reduceat(v, cut)
        v -= np.repeat(top, count)
        back[p] = top + np.log(np.add.reduceat(np.exp(v), cut))
    else:
        return back
    rest = places[a:]
    for p, low, high in zip(rest.tolist(), first[rest].tolist(), first[rest + 1].tolist()):
        v = value[low:high].tolist()
        for k, (size, after) in enumerate(zip(chars[low:high].tolist(), left[low:high].tolist())):
            if after:
                v[k] += float(back[p + size])
        value[low:high] = v
        top = max(v)
        back[p] = top + math.log(sum(math.exp(x - top) for x in v))
    return back


class Words(Kept):
    """Encodings and lattices of pre-tokens by number."""

    def __init__(self, pieces: Pieces, table: _Table, most: int = KEPT_EDGES):
        self.table = table
        super().__init__(pieces.encode_chunks, most)

    def clear(self) -> None:
        super().clear()
        self.first, self.step = KeptColumn(np.int64), KeptColumn(np.int64)
        self.piece, self.upto = KeptColumn(np.int32), KeptColumn(np.float32)
        self.first.add(np.zeros(1, np.int64))

    def cut(self, strings: int, letters: int, ids: int) -> None:
        super().cut(strings, letters, ids)
        self.first.n = letters + 1
        self.piece.n = self.step.n = self.upto.n = int(self.first.data[-1])

    def held(self) -> int:
        """Edges."""
        return self.piece.n

    def make(self, letters: np.ndarray, sizes: np.ndarray) -> Lattice:
        return lattice(letters, sizes, self.table)

    def taken(self, which: np.ndarray) -> Lattice:
        first, size = self.first.data, self.size.data[which]
        places = runs(self.begin.data[which], size)
        count = first[places + 1] - first[places]
        edges = runs(first[places], count)
        return Lattice(np.append(0, np.cumsum(count)), self.piece.data[edges], self.step.data[edges], self.upto.data[edges])

    def extend(self, more: Lattice) -> None:
        self.first.add(more.first[1:] + self.piece.n)
        self.piece.add(more.piece)
        self.step.add(more.step)
        self.upto.add(more.upto)


@dataclass(slots=True)
class _Walk:
    """A walk of each text, one after the other, and the regions that were split off along it."""

    edges: np.ndarray
    place: np.ndarray  # where each edge starts
    word: np.ndarray  # the pre-token of the batch that it is in
    steps: np.ndarray  # log probability given the place, in units of 2**-UNIT
    cut: np.ndarray  # where each text's edges begin, and the end
    own: np.ndarray  # edges that each text's walk shares with the walk that it left
    barred: np.ndarray  # edges that do not follow there, filled up with -1
    free: np.ndarray  # the maximum of the region that leaves each edge, before truncation; -inf if taken
    live: np.ndarray
    perturbed: np.ndarray
    log_prob: np.ndarray
    best: np.ndarray  # largest maximum of a region of each text, and the edge that it leaves
    where: np.ndarray


class Sampler:
    def __init__(self, path: str, samples: int = SAMPLES):
        self.pieces, self.table, self.samples = load(path), _table(path), samples
        self.words = Words(self.pieces, self.table)
        self.byte_ids = np.array(self.pieces.byte_ids, np.uint32)

    def split(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pre-tokens of texts, and how many each text has."""
        letters, starts, many = letters_of(batch)
        return self.words(letters, starts, np.diff(starts, append=len(letters))), many

    # ---- the library's encoding

    def decoded(self, ids: np.ndarray, cut: np.ndarray) -> list[bytes]:
        """The bytes of the pieces of each text's ids, with the space in front."""
        size = self.table.byte_size[ids]
        data = self.table.bytes[runs(self.table.byte_begin[ids], size)].tobytes()
        ends = np.append(0, np.cumsum(size))[cut].tolist()
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def encode(self, batch: list[str]) -> list[bytes]:
        """The library's ids of texts."""
        word, many = self.split(batch)
        ids, cut = self.words.encoded(word, np.cumsum(many))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:])]

    # ---- sampling

    def ids(self, edges: np.ndarray, place: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of walks one after the other, and where each walk's begin and end."""
        piece = self.words.piece.data[edges]
        odd = np.flatnonzero(piece < 0)
        if not len(odd):
            return piece.astype("<u4"), cut
        letters = [list(chr(c).encode("utf-8", "surrogatepass")) for c in self.words.letters.data[place[odd]].tolist()]
        count = np.ones(len(edges), np.int64)
        count[odd] = list(map(len, letters))
        ends = np.append(0, np.cumsum(count))
        out = np.repeat(piece, count).astype("<u4")
        out[runs(ends[odd], count[odd])] = self.byte_ids[list(chain.from_iterable(letters))]
        return out, ends[cut]

    def __call__(self, batch: list[str], keys: np.ndarray) -> list[list[dict]]:
        """Samples of each text, best first: ids, log_prob, perturbed and inclusion."""
        out: list[list[dict]] = [[] for _ in batch]
        for walk, (ids, cut), inclusion in self.draw(*self.split(batch), keys):
            for t in np.flatnonzero(walk.live).tolist():
                out[t].append({"ids": ids[cut[t] : cut[t + 1]], "log_prob": float(walk.log_prob[t]), "perturbed": float(walk.perturbed[t]), "inclusion": float(inclusion[t])})
        return out

    def draw(self, word: np.ndarray, many: np.ndarray, keys: np.ndarray) -> list[tuple[_Walk, tuple[np.ndarray, np.ndarray], np.ndarray]]:
        """The walks of texts of ``many`` pre-tokens each, best first: a walk of each text, its ids and its inclusion score."""
        n = len(many)
        if not len(word):
            return []
        owner = np.repeat(np.arange(n), many)
        inside = np.arange(len(word)) - (np.cumsum(many) - many)[owner]
        text_key = mix(keys.astype(np.uint64))
        live = many > 0
        score = np.where(live, -np.log(-np.log(_uniform(text_key ^ _U(0xA5A5)))), -np.inf)
        source, leave = np.full(n, -1), np.zeros(n, np.int64)
        agenda: list[_Walk] = []
        while live.any() and len(agenda) < self.samples:
            agenda.append(self._walk(agenda, live, score, source, leave, word, many, owner, inside, text_key))
            # The region with the largest maximum is next.
            score = np.full(n, -np.inf)
            for k, a in enumerate(agenda):
                on = a.best > score
                score[on], source[on], leave[on] = a.best[on], k, a.where[on]
            live = np.isfinite(score)
        with np.errstate(over="ignore"):
            scores = [np.where(live, -np.expm1(-np.exp(a.log_prob - np.where(live, score, 0.0))), 1.0) for a in agenda]
        return [(a, self.ids(a.edges, a.place, a.cut), s) for a, s in zip(agenda, scores)]

    def _walk(self, agenda, live, score, source, leave, word, many, owner, inside, text_key) -> _Walk:
        n, turn = len(live), len(agenda)
        first, piece, step, chars = self.words.first.data, self.words.piece.data, self.words.step.data, self.table.chars
        word_end = np.cumsum(many)
        resume_word, resume_place, taken_step = word_end - many, np.full(n, -1), np.zeros(n, np.int64)
        own = np.zeros(n, np.int64)
        barred = np.full((n, turn), -1)
        taken = np.full(n, -1)
        shared = []  # what texts keep of the walks that they leave: whose, and where that is
        for k, a in enumerate(agenda):
            t = np.flatnonzero(live & (source == k))
            at = leave[t]
            spot = a.cut[t] + at
            own[t], resume_word[t], resume_place[t], barred[t, 0] = at, a.word[spot], a.place[spot], a.edges[spot]
            again = at == a.own[t]
            barred[t[again], 1 : 1 + a.barred.shape[1]] = a.barred[t[again]]
            a.free[spot] = -np.inf
            shared.append((a, t, runs(a.cut[t], at)))
        on = np.flatnonzero(live & (source >= 0) & (turn > 0))
        rest = np.zeros(len(on))
        if len(on):
            low, high = first[resume_place[on]], first[resume_place[on] + 1]
            option = low[:, None] + np.arange(int((high - low).max()))[None, :]
            allowed = (option < high[:, None]) & ~(option[:, :, None] == barred[on][:, None, :]).any(axis=2)
            said = step[np.where(allowed, option, low[:, None])]
            p = np.where(allowed, np.exp(said / float(1 << UNIT)), 0.0)
            mass = np.cumsum(p, axis=1)
            u = _uniform(text_key[on] ^ _times(turn + 1, 0xBEEF)) * mass[:, -1]
            final = p.shape[1] - 1 - np.argmax(p[:, ::-1] > 0, axis=1)
            pick = np.minimum((mass <= u[:, None]).sum(axis=1), final)
            taken[on] = low + pick
            taken_step[on] = said[np.arange(len(on)), pick]
            p[np.arange(len(on)), pick] = 0.0
            rest = p.sum(axis=1)
        # The rest is drawn: of the word that the walk leaves in, what follows; then whole words.
        occ = np.flatnonzero(live[owner] & (np.arange(len(owner)) >= resume_word[owner]))
        begin = self.words.begin.data[word[occ]]
        end = begin + self.words.size.data[word[occ]]
        part = np.flatnonzero((resume_place[owner[occ]] >= 0) & (occ == resume_word[owner[occ]]))
        whose = owner[occ[part]]
        begin[part] = resume_place[whose] + chars[piece[taken[whose]]]
        key = mix(text_key + _times(turn + 1, 0x9E3779B97F4A7C15))[owner[occ]] + inside[occ].astype(np.uint64) * _U(0xBF58476D1CE4E5B9)
        drawn, drawn_place, count = self._draw(begin, end, key)
        per_text = np.bincount(owner[occ], weights=count, minlength=n).astype(np.int64)
        size = own + (taken >= 0) + per_text
        cut = np.append(0, np.cumsum(size))
        edges, place, words, steps = (np.empty(int(cut[-1]), np.int64) for _ in range(4))
        for a, t, old in shared:
            to = runs(cut[t], own[t])
            edges[to], place[to], words[to], steps[to] = a.edges[old], a.place[old], a.word[old], a.steps[old]
        spot = cut[on] + own[on]
        edges[spot], place[spot], words[spot], steps[spot] = taken[on], resume_place[on], resume_word[on], taken_step[on]
        to = runs(cut[:-1] + own + (taken >= 0), per_text)
        edges[to], place[to], words[to] = drawn, drawn_place, np.repeat(occ, count)
        steps[to] = step[drawn]
        # Regions along the walk, from the edge on that it does not share.
        run = np.append(0, np.cumsum(steps))  # whole numbers: what comes before a text in the batch goes without a trace
        begins = run[cut[:-1]]
        log_prob = (run[cut[1:]] - begins) / float(1 << UNIT)
        new = runs(cut[:-1] + own, size - own)
        text = np.repeat(np.arange(n), size - own)
        with np.errstate(divide="ignore"):
            mass = (run[new] - begins[text]) / float(1 << UNIT)
            other = np.log(-np.expm1(steps[new] / float(1 << UNIT)))
            other[np.searchsorted(new, spot)] = np.log(rest)
            u = _uniform(mix(text_key + _times(turn + 1, 0x94D049BB133111EB))[text] + (new - cut[text]).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        free = np.full(len(edges), -np.inf)
        # Gumbel variables before truncation; truncation keeps their order within a text, so it waits until one is taken.
        free[new] = mass + other - np.log(-np.log(u))
        made = _Walk(edges, place, words, steps, cut, own, barred, free, live.copy(), score.copy(), log_prob, np.zeros(0), np.zeros(0, np.int64))
        for a in [*agenda, made]:
            self._best(a)
        return made

    def _draw(self, place: np.ndarray, stop: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Walks from places to stops, drawn by keys: edges, where they start, and how many each walk has."""
        first, upto, piece, chars = self.words.first.data, self.words.upto.data, self.words.piece.data, self.table.chars
        n = len(place)
        count = np.zeros(n, np.int64)
        on = np.flatnonzero(place < stop)
        at, stop, key = place[on], stop[on], key[on]
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        tails: list[tuple[int, list[int], list[int]]] = []
        while len(on):
            if len(on) < FEW and len(steps) > FEW:
                for i, p, end, own in zip(on.tolist(), at.tolist(), stop.tolist(), key):
                    e, passed = self._draw_one(p, end, own, len(steps))
                    tails.append((i, e, passed))
                    count[i] += len(e)
                break
            u = _uniform(key + _times(len(steps) + 1, 0xD1342543DE82EF95))
            e = first[at]
            more = np.flatnonzero(u >= upto[e])
            while len(more):
                e[more] += 1
                more = more[u[more] >= upto[e[more]]]
            steps.append((on, e, at))
            count[on] += 1
            at = at + chars[piece[e]]
            more = np.flatnonzero(at < stop)
            on, at, stop, key = on[more], at[more], stop[more], key[more]
        begin = np.cumsum(count) - count
        edges, places = np.empty(int(count.sum()), np.int64), np.empty(int(count.sum()), np.int64)
        for k, (who, e, at) in enumerate(steps):
            spot = begin[who] + k
            edges[spot], places[spot] = e, at
        for i, e, at in tails:
            spot = slice(begin[i] + len(steps), begin[i] + count[i])
            edges[spot], places[spot] = e, at
        return edges, places, count

    def _draw_one(self, place: int, stop: int, key: np.uint64, step: int) -> tuple[list[int], list[int]]:
        """What _draw does from a step on, for one long walk."""
        first, upto, piece, chars = self.words.first.data, self.words.upto.data, self.words.piece.data, self.table.chars
        edges, places = [], []
        block: list[float] = []
        while place < stop:
            if not block:
                turns = np.arange(step + len(edges) + 1, step + len(edges) + 513, dtype=np.uint64) * _U(0xD1342543DE82EF95)
                block = _uniform(key + turns).tolist()[::-1]
            u, e = block.pop(), int(first[place])
            while u >= upto[e]:
                e += 1
            edges.append(e)
            places.append(place)
            place += int(chars[piece[e]])
        return edges, places

    def _best(self, a: _Walk) -> None:
        """The largest region of each text along a walk: its truncated maximum, and the edge that it leaves."""
        cut, free = a.cut, a.free
        n = len(cut) - 1
        a.best, a.where = np.full(n, -np.inf), np.zeros(n, np.int64)
        some = np.flatnonzero(np.diff(cut) > 0)
        if len(some):
            a.best[some] = np.maximum.reduceat(free, cut[:-1][some])
            hit = np.flatnonzero(free == np.repeat(a.best, np.diff(cut)))[::-1]
            text = np.searchsorted(cut, hit, "right") - 1
            a.where[text] = hit - cut[text]
        on = np.isfinite(a.best)
        a.best[on] = -np.logaddexp(-a.perturbed[on], -a.best[on])


def sampler_of(path: str, samples: int) -> Sampler:
    """That of this process, so that a worker's tasks share what it keeps."""
    return resident(("sampler", path, samples), lambda: Sampler(path, samples))


_SAMPLE = T.StructType([T.StructField("ids", T.BinaryType())] + [T.StructField(n, T.DoubleType()) for n in ("log_prob", "perturbed", "inclusion")])


def _binary(ids: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Runs of ids as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])


def _columns(sampler: Sampler, keys: Sequence[int | None], batch: list[str], kind: pa.DataType) -> list[pa.Array]:
    """ids, round_trip and samples of some texts."""
    word, many = sampler.split(batch)
    ids, cut = sampler.words.encoded(word, np.cumsum(many))
    same = [got == (b" " + t.encode() if t else b"") for got, t in zip(sampler.decoded(ids, cut), batch)]
    drawn = sampler.draw(word, many, np.array([k or 0 for k in keys], np.int64))
    of, parts = [], []
    for walk, (walk_ids, walk_cut), inclusion in drawn:
        t = np.flatnonzero(walk.live)
        fields = [_binary(walk_ids, walk_cut).take(pa.array(t)), *(pa.array(x[t]) for x in (walk.log_prob, walk.perturbed, inclusion))]
        parts.append(pa.StructArray.from_arrays(fields, fields=list(kind.value_type)))
        of.append(t)
    text = np.concatenate(of) if of else np.zeros(0, np.int64)
    ends = np.append(0, np.cumsum(np.bincount(text, minlength=len(batch)))).astype(np.int32)
    rows = pa.concat_arrays(parts).take(pa.array(np.argsort(text, kind="stable"))) if parts else pa.array([], kind.value_type)
    return [_binary(ids, cut), pa.array(same, pa.bool_()), pa.ListArray.from_arrays(pa.array(ends), rows, type=kind)]


def encode_and_sample(docs: DataFrame, path: str, key: str = "doc_id", samples: int = SAMPLES) -> DataFrame:
    """Adds ids, round_trip and samples, each with its ids; all ids are little-endian 32-bit integers.

    ids are those of the library for the whole text; round_trip says whether
    decoding them gives the text back (it does not where a text has U+2581).
    A text with fewer segmentations than ``samples`` gets all of them, each
    with inclusion 1; an empty or null text has no ids and no samples. Draws
    depend on the key (null: as 0), so rows of equal key and text get equal
    samples. Columns of the names above are replaced.
    """
    fields = [
        T.StructField("ids", T.BinaryType()),
        T.StructField("round_trip", T.BooleanType()),
        T.StructField("samples", T.ArrayType(_SAMPLE)),
    ]
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(T.ArrayType(_SAMPLE))

    def start():
        sampler = sampler_of(path, samples)

        def run(key, text):
            keys, all_texts = key.to_pylist(), texts(text)
            parts, at = [], 0
            while at < len(all_texts):
                to, held = at, 0
                while to < len(all_texts) and (to == at or held + len(all_texts[to]) <= CHARS):
                    held += len(all_texts[to])
                    to += 1
                parts.append(_columns(sampler, keys[at:to], all_texts[at:to], kind))
                at = to
            return [pa.concat_arrays(x) for x in zip(*parts)]

        return run

    return with_arrow(docs, [key, "text"], fields, start)


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Adds the text of a column of ids, little-endian 32-bit integers, as the library decodes them; null for null.

    A column of that name is replaced.
    """

    def start():
        model = load(path).model

        def run(column):
            return [pa.array([None if x is None else model.decode(np.frombuffer(x, "<u4").tolist()) if x else "" for x in column.to_pylist()], pa.string())]

        return run

    return with_arrow(rows, [ids], [T.StructField(text, T.StringType())], start)


def digests(ids: Column) -> list[Column]:
    """n_ids and ids_crc32 of a column of ids."""
    return [(F.octet_length(ids) / 4).cast("long").alias("n_ids"), F.crc32(ids).alias("ids_crc32")]


def report(docs: DataFrame, path: str) -> DataFrame:
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    short = F.transform("samples", lambda s: F.struct(*digests(s["ids"]), s["log_prob"].alias("log_prob"), s["perturbed"].alias("perturbed"), s["inclusion"].alias("inclusion")))
    return encode_and_sample(narrow, path).select("doc_id", *digests(F.col("ids")), "round_trip", short.alias("samples"))
