"""Main text of web pages by minimum-cut labelling of text blocks.

A page becomes a list of text blocks. A classifier gives each block the
log-odds of its being content: a logistic regression on what its text is like,
which elements it lies in, and the words of their class and id names. The
log-odds are capacities to the terminals. Smoothness edges join neighbouring
blocks and blocks of one parent, the stronger the nearer their elements are in
the tree. The minimum cut separates content from boilerplate: a block that
says little by itself goes with those around it.

The regression is fitted on a bounded sample of pages. Their labels are weak
ones, of blocks in elements that HTML itself means for content or for what is
not, so every block is shown twice, the second time without its elements: names
and texts get weights of their own, which hold where pages have no such
elements. What a sample does not show keeps its prior weight.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts, with_arrow

#: Pages that the regression is fitted on, at most; pages that must show a name's word before it has a weight of its own.
SAMPLE_PAGES = 400
WORD_PAGES = 5
#: Capacity of the edge between neighbours that are next to one another in the tree, and between blocks of one parent; by each step
#: further apart in the tree an edge keeps this share, and it keeps less between blocks that the markup does not treat alike.
ADJACENT, SIBLING, STEP, UNLIKE = 1.2, 0.8, 0.5, 0.4
#: Share of an edge that is lost between text and links.
LINKS = 0.2
#: Capacities to the terminals are this at most, less than the edges of a block among its like: none is beyond what those around it say.
MOST = 3.0
#: A form, or an element whose name may say boilerplate, does not say so when it holds this share of the page's words outside links.
WRAPPER = 0.5
#: The log of a block's words counts up to here.
LONG = 3.5
#: Steps in the tree, and open elements, that are looked at.
NEAR, DEEP = 6, 512

# Element names by their part in HTML.
RAW = "script style textarea title noscript iframe noembed noframes xmp".split()
SKIPPED = "head template svg math object select datalist button canvas audio video dialog map".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BLOCK = (
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul"
).split()
HEADING = "h1 h2 h3 h4 h5 h6".split()
BOILERPLATE_ELEMENT = "nav footer aside form menu".split()
BOILERPLATE_ROLE = "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split()
# Words of class and id names that speak for boilerplate, and for content.
BOILERPLATE_NAME = (
    "ad ads adv advert adverts advertisement advertising adbox adslot affiliate alert alerts announcement announcements banner billboard breadcrumb breadcrumbs captcha comment "
    "commentlist comments consent cookie cookies copyright discussion disqus disclaimer donate feedback footer footnav form gdpr header hidden "
    "legal login masthead menu menus message messages modal nav navbar navigation newsletter notice notices notification overlay pager "
    "pagination paywall poll popular popup print promo promos promoted promotion recommended register related replies reply respond responses "
    "rightcol search share sharing shoutbox sidebar sidebars signin signup skip social sponsor sponsored subscribe subscription suggested survey "
    "tags teaser toolbar topbar tracking trending warning widget widgets"
).split()
# Of those, the ones that hold for an article element inside them, too.
BOILERPLATE_ALWAYS = "comment commentlist comments discussion disqus related recommended replies reply respond responses sidebar teaser widget widgets".split()
# Of those, the ones that hold however much they contain.
BOILERPLATE_TALK = "comment commentlist comments discussion disqus replies reply respond responses".split()
# Words by which a name tells a state of the page, not what an element is.
STATE_NAME = "active allow allowed closed disabled enabled free has is no not off on open opened with without".split()
# Of those, the ones that parts of an article may have as well.
BOILERPLATE_OR_NOT = (
    "alert alerts announcement announcements copyright disclaimer feedback header hidden legal message messages notice notices notification "
    "overlay poll popular print register survey tags tracking warning"
).split()
CONTENT_NAME_WORDS = "article articlebody body content entry main post prose story text".split()

_RAW, _SKIPPED, _VOID, _BLOCK = frozenset(RAW), frozenset(SKIPPED), frozenset(VOID), frozenset(BLOCK)
_HEADING, _BOIL, _ROLE = frozenset(HEADING), frozenset(BOILERPLATE_ELEMENT), frozenset(BOILERPLATE_ROLE)
_BAD, _GOOD, _HARD, _DOUBT = frozenset(BOILERPLATE_NAME), frozenset(CONTENT_NAME_WORDS), frozenset(BOILERPLATE_ALWAYS), frozenset(BOILERPLATE_OR_NOT)
_TALK, _STATE = frozenset(BOILERPLATE_TALK), frozenset(STATE_NAME)
_PLAIN = frozenset(["html", "body", "main"])

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    # Quotes hold a value only behind "="; one that is never closed is a character of a value without quotes.
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]++)?+)?+)*+)(?:>|\Z)",
    re.S,
)
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Which open elements a start tag closes, and where the search for them stops.
_ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}


#: What elements say, a bit each.
ARTICLE, NAV, FOOTER, ASIDE, HEADER, MENU, HARD, FORM, SOFT, GOOD = (1 << k for k in range(10))
_ELEMENT_BIT = {"nav": NAV, "footer": FOOTER, "aside": ASIDE, "menu": MENU}
_ROLE_BIT = {"navigation": NAV, "contentinfo": FOOTER, "complementary": ASIDE, "banner": HEADER, "search": FORM, "form": FORM}
_NONE_WORDS: frozenset[str] = frozenset()


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    linked: int  # characters inside links
    path: tuple[int, ...]  # numbers of the element that holds it and of those above, some of them
    says: int  # bits of what the elements around it say
    words: frozenset[str]  # of their names
    maybe: tuple[tuple[int, int], ...]  # elements around it, by number, that say so only if they don't hold most of the page


class _Open:
    """An open element: its name, number, and what it and those around it say."""

    __slots__ = ("name", "number", "path", "says", "words", "maybe", "skipped")

    def __init__(self, name: str, number: int, around: _Open | None, attributes: str):
        self.name, self.number = name, number
        if around is None:
            self.path, self.says, self.words, self.maybe, self.skipped = (number,), 0, _NONE_WORDS, (), False
            return
        self.path = (number, *around.path[:NEAR])
        self.says, self.words, self.maybe, self.skipped = around.says, around.words, around.maybe, around.skipped or name in _SKIPPED
        article = name in ("article", "main")
        if article:
            self.says |= ARTICLE
        elif name in _ELEMENT_BIT:
            self.says |= _ELEMENT_BIT[name]
        elif name == "header" and not self.says & ARTICLE:
            self.says |= HEADER
        elif name == "form":
            self._perhaps(FORM)
        if attributes and not attributes.isspace():
            self._attributes(attributes, article)

    def _perhaps(self, bit: int, unless_large: bool = True) -> None:
        if not unless_large:
            self.says |= bit
        elif len(self.maybe) < DEEP:
            self.maybe = (*self.maybe, (self.number, bit))

    def _attributes(self, attributes: str, article: bool) -> None:
        for key, a, b, c in _ATTR.findall(attributes):
            key = key.lower()
            value = a or b or c
            if key in ("class", "id") and self.name not in _PLAIN:
                words = set()
                for one in value.split():
                    own = {w.lower() for w in _NAME.findall(one)}
                    if not own & _STATE:
                        words |= own
                        words.add(one.lower())
                if article:
                    words &= _HARD
                if self.says & ARTICLE or words & _GOOD:
                    words.discard("header")  # of an article: its headline
                if words & _HARD:
                    self._perhaps(HARD, not self.says & ARTICLE and not words & _TALK)
                elif words & _BAD:
                    self._perhaps(SOFT, not self.says & ARTICLE or not words & (_BAD - _DOUBT))
                elif words & _GOOD:
                    self.says |= GOOD
                if words and len(self.words) < DEEP:
                    self.words = self.words | words
            elif key == "role" and value.lower() in ("main", "article"):
                self.says |= ARTICLE
            elif key == "role" and value.lower() in _ROLE:
                bit = _ROLE_BIT.get(value.lower(), MENU)
                if bit == FORM:
                    self._perhaps(FORM)
                else:
                    self.says |= bit
            elif key == "aria-hidden" and value.lower() == "true":
                self.says |= MENU
            elif key == "hidden" or key == "style" and _NONE.search(value):
                self.skipped = True
            elif key == "itemprop" and value.lower() == "articlebody":
                self.says |= ARTICLE


class _Stack:
    """The open elements, with what is needed to close some without a look at all."""

    def __init__(self):
        self.all = [_Open("", 0, None, "")]
        self.blocks = [0]  # places of the block elements, and of the root
        self.open: dict[str, int] = defaultdict(int)
        self.inline: list[dict[str, int]] = [defaultdict(int)]  # open inline elements by name, inside each of the block elements
        self.made = 0

    def push(self, name: str, attributes: str) -> None:
        self.made += 1
        self.all.append(_Open(name, self.made, self.all[-1], attributes))
        self.open[name] += 1
        if name in _BLOCK:
            self.blocks.append(len(self.all) - 1)
            self.inline.append(defaultdict(int))
        else:
            self.inline[-1][name] += 1

    def pop_to(self, place: int) -> None:
        while len(self.all) > place:
            e = self.all.pop()
            self.open[e.name] -= 1
            if self.blocks[-1] == len(self.all):
                self.blocks.pop()
                self.inline.pop()
            else:
                self.inline[-1][e.name] -= 1

    def close(self, name: str) -> None:
        """An end tag: of a block element or one that is left out, whatever is open inside; of an inline one, only within its block."""
        if name in _BLOCK:
            if self.open[name]:
                self.pop_to(next(k for k in reversed(self.blocks) if self.all[k].name == name))
        elif self.inline[-1][name] or name in _SKIPPED and self.open[name]:
            self.pop_to(next(k for k in range(len(self.all) - 1, 0, -1) if self.all[k].name == name))

    def before(self, name: str) -> None:
        """Closes what a start tag of a block element closes."""
        if name in _ENDS:
            ends, stop = _ENDS[name]
            if any(self.open[x] for x in ends):
                for k in self.blocks[:-DEEP:-1]:
                    if self.all[k].name in stop:
                        break
                    if self.all[k].name in ends:
                        self.pop_to(k)
                        if name != "tr":
                            break
        elif name == "body" and self.open["head"]:
            for k in range(len(self.all) - 1, max(0, len(self.all) - DEEP), -1):
                if self.all[k].name == "head":
                    self.pop_to(k)
                    break
        if name not in ("html", "body") and self.all[self.blocks[-1]].name == "p":
            self.pop_to(self.blocks[-1])


@dataclass
class Seen:
    """What a page has besides text blocks: its title (the first) and where its links lead."""

    title: str | None = None
    links: list[str] = field(default_factory=list)


def blocks(html: str, seen: Seen | None = None) -> list[Block]:
    """The text blocks of a page, in order, white space inside each made one space; no block is empty. Adds to ``seen``."""
    out: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            parts.clear()
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                own = stack.all[stack.blocks[-1]]
                out.append(Block(text, own.name, min(linked, len(text)), own.path, own.says, own.words, own.maybe))
        linked = 0

    def text_of(begin: int, end: int) -> None:
        nonlocal linked
        if begin < end and not stack.all[-1].skipped:
            part = html[begin:end]
            parts.append(part)
            if stack.open["a"]:
                linked += len(part.strip())

    while m := _TAG.search(html, at):
        text_of(at, m.start())
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
        elif m[1]:
            if name in _BLOCK and (stack.open[name] or name == "p"):
                flush()
            stack.close(name)
        elif name in _RAW:
            at = _after_raw(html, name, at, seen)
        else:
            if name in _BLOCK:
                flush()
                stack.before(name)
            if name not in _VOID and not (m[3].endswith("/") and name in _SKIPPED):
                stack.push(name, m[3])
                if seen and name == "a":
                    seen.links += _link(m[3])
    text_of(at, len(html))
    flush()
    return out


def plain_text(html: str, seen: Seen | None = None) -> list[str]:
    """The texts of all blocks, in order, without what the elements around them say; adds to ``seen``.

    Open elements are not kept, but for one that is left out and what is in it.
    A hidden element that needs no end tag is left to ``blocks``.
    """
    out: list[str] = []
    parts: list[str] = []
    hidden, depth, at, begun = "", 0, 0, len(seen.links) if seen else 0

    def flush() -> None:
        raw = "".join(parts)
        parts.clear()
        text = " ".join((unescape(raw) if "&" in raw else raw).split())
        if text:
            out.append(text)

    search = _TAG.search
    while m := search(html, at):
        if not hidden and at < m.start():
            parts.append(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if hidden and (hidden != "head" or name != "body"):
            if name in _RAW and not m[1]:
                at = _after_raw(html, name, at, seen)
            elif name == hidden:
                depth += -1 if m[1] else 1
                hidden = hidden if depth else ""
            elif name == "a" and seen and not m[1]:
                seen.links += _link(m[3])
            continue
        hidden = ""
        if name == "br":
            parts.append(" ")
        elif m[1]:
            if name in _BLOCK and parts:
                flush()
        elif name in _RAW:
            at = _after_raw(html, name, at, seen)
        else:
            if name in _BLOCK and parts:
                flush()
            if name in _VOID:
                continue
            attributes = m[3]
            if name in _SKIPPED:
                hidden, depth = ("", 0) if attributes.endswith("/") else (name, 1)
            elif _MAY_HIDE.search(attributes) and _Open(name, 0, _ROOT, attributes).skipped:
                if name in _LOOSE:
                    if seen:
                        del seen.links[begun:]
                    return [b.text for b in blocks(html, seen)]
                hidden, depth = name, 1
            if seen and name == "a":
                seen.links += _link(attributes)
    if not hidden:
        parts.append(html[at:])
    flush()
    return out


def _after_raw(html: str, name: str, at: int, seen: Seen | None) -> int:
    """Where the raw text of an element ends; its title is taken down."""
    close = _CLOSE[name].search(html, at)
    if seen and name == "title" and seen.title is None:
        seen.title = " ".join(unescape(html[at : close.start() if close else len(html)]).split())
    return close.end() if close else len(html)


def _link(attributes: str) -> list[str]:
    """Where an element leads, if it does."""
    return [unescape(x or y or z) for key, x, y, z in _ATTR.findall(attributes) if key.lower() == "href"][:1]


_ROOT = _Open("", 0, None, "")
_MAY_HIDE = re.compile(r"hidden|style", re.I)
#: Elements that may end without an end tag.
_LOOSE = frozenset([*_ENDS, "p", "html", "body", "optgroup", "thead", "tbody", "tfoot"])


# ---- the classifier

#: Features and the weights that they have before any page is seen.
PRIOR = {
    "one": -1.0, "length": 0.6, "links": -4.0, "sentence": 0.6, "heading": 0.6, "cell": -0.5, "paragraph": 0.8,
    "article": 2.5, "nav": -9.0, "footer": -9.0, "aside": -9.0, "header": -7.0, "menu": -9.0, "hard": -11.0, "form": -9.0, "soft": -9.0, "good": 1.0,
}
_BITS = {"article": ARTICLE, "nav": NAV, "footer": FOOTER, "aside": ASIDE, "header": HEADER, "menu": MENU, "hard": HARD, "form": FORM, "soft": SOFT, "good": GOOD}
_TEXT = len(PRIOR) - len(_BITS)
#: Elements that make a weak label: content, and not.
_MEANT, _NOT_MEANT = ARTICLE, NAV | FOOTER | ASIDE | HEADER | MENU | HARD


@dataclass
class Model:
    weights: list[float] = field(default_factory=lambda: list(PRIOR.values()))
    words: dict[str, float] = field(default_factory=dict)  # of names


def said(found: list[Block]) -> list[int]:
    """What the elements around each block say.

    Of forms and names those that hold most of the words are taken to be around
    it all: of the words of articles, or of all words where a page has none.
    """
    plain = [b.text.count(" ") + 1 if b.linked < len(b.text) // 2 and not b.says & _NOT_MEANT else 0 for b in found]
    inside = [n if b.says & ARTICLE else 0 for b, n in zip(found, plain)]
    plain = inside if any(inside) else plain
    held: Counter = Counter()
    for b, n in zip(found, plain):
        if n:
            for number, _ in b.maybe:
                held[number] += n
    most = WRAPPER * sum(plain)
    out = []
    for b in found:
        bits = b.says
        for number, bit in b.maybe:
            if held[number] < most or not most:
                bits |= bit
        out.append(bits)
    return out


def features(b: Block, bits: int) -> list[float]:
    text = [
        1.0,
        min(LONG, math.log1p(b.text.count(" ") + 1)),
        b.linked / len(b.text),
        float(b.text[-1] in ".!?…\"”»"),
        float(b.tag in _HEADING),
        float(b.tag in ("li", "td", "th", "dt", "dd", "option")),
        float(b.tag in ("p", "blockquote", "pre")),
    ]
    return text + [float(bits & bit > 0) for bit in _BITS.values()]


def log_odds(found: list[Block], model: Model) -> list[float]:
    if not found:
        return []
    x = np.array([features(b, bits) for b, bits in zip(found, said(found))])
    out = x @ np.array(model.weights)
    if model.words:
        out += [sum(model.words.get(w, 0.0) for w in b.words) for b in found]
    return np.clip(out, -MOST, MOST).tolist()


def fit(pages: list[str], strength: float = 0.05) -> Model:
    """The maximum a posteriori of the weights, given blocks with weak labels; strength, for each block, holds them to their priors.

    Weights keep the signs of their priors: a sample of few kinds of pages must not turn over what an element means.
    """
    rows, labels, names, seen = [], [], [], Counter()
    for page in pages:
        found = blocks(page)
        of_page = set()
        for b, bits in zip(found, said(found)):
            if bool(bits & _MEANT) != bool(bits & _NOT_MEANT):
                rows.append(features(b, bits))
                labels.append(float(bits & _MEANT > 0))
                names.append(b.words)
                of_page |= b.words
        seen.update(of_page)
    if len(set(labels)) < 2:
        return Model()
    words = sorted(w for w, n in seen.items() if n >= WORD_PAGES and w not in _BAD | _GOOD)
    number = {w: k + len(PRIOR) for k, w in enumerate(words)}
    x = np.zeros((2 * len(rows), len(PRIOR) + len(words)))
    for k, (row, own) in enumerate(zip(rows, names)):
        x[k, : len(row)] = row
        for w in own:
            if w in number:
                x[k, number[w]] = 1.0
    # Each block again without what elements say.
    x[len(rows) :] = x[: len(rows)]
    x[len(rows) :, _TEXT : len(PRIOR)] = 0.0
    y = np.array(labels * 2)
    prior = np.array([*PRIOR.values(), *[0.0] * len(words)])
    w, hold = prior.copy(), strength * len(x)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold * np.eye(len(w)), x.T @ (p - y) + hold * (w - prior))
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    w = np.where(w * prior < 0, 0.0, w)
    return Model(w[: len(PRIOR)].tolist(), dict(zip(words, w[len(PRIOR) :].tolist())))


# ---- the cut


def min_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least energy: a node whose unary is positive pays it when it is not chosen, a negative one when it is, and an edge its weight when its ends differ.

    Positive costs are capacities from the source, negative ones to the sink.
    Flow is sent in rounds, each along all shortest paths that are left, until
    none is; chosen are the nodes that the source still reaches. Of equal cuts
    that with the fewest chosen nodes is taken.
    """
    n, eps = len(unary), 1e-9
    near: list[dict[int, float]] = [{} for _ in range(n)]  # room from a node to another
    for a, b, w in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    supply, demand = [max(0.0, u) for u in unary], [max(0.0, -u) for u in unary]
    while True:
        level = [0 if x > eps else -1 for x in supply]
        order = [i for i in range(n) if not level[i]]
        reached = False
        for i in order:
            reached = reached or demand[i] > eps
            for j, room in near[i].items():
                if room > eps and level[j] < 0:
                    level[j] = level[i] + 1
                    order.append(j)
        if not reached:
            return [x >= 0 for x in level]
        todo = [list(near[i]) for i in range(n)]  # neighbours that a path may still be tried by in this round
        for start in range(n):
            path = [start]
            while path and supply[start] > eps:
                i = path[-1]
                if demand[i] > eps:
                    sent = min(supply[start], demand[i], *[near[a][b] for a, b in zip(path, path[1:])])
                    supply[start] -= sent
                    demand[i] -= sent
                    full = len(path)
                    for k in range(len(path) - 2, -1, -1):
                        a, b = path[k], path[k + 1]
                        near[a][b] -= sent
                        near[b][a] += sent
                        if near[a][b] <= eps:
                            full = k + 1
                    del path[full:]
                    continue
                while todo[i] and not (level[todo[i][-1]] == level[i] + 1 and near[i][todo[i][-1]] > eps):
                    todo[i].pop()
                if todo[i]:
                    path.append(todo[i][-1])
                else:
                    path.pop()
                    if path:
                        todo[path[-1]].pop()


def distance(a: Block, b: Block) -> int:
    """Steps in the tree between the elements of two blocks; NEAR + 1 where they are further apart."""
    up = {number: k for k, number in enumerate(a.path)}
    return min((k + up[number] for k, number in enumerate(b.path) if number in up), default=NEAR + 1)


def edges_of(found: list[Block]) -> list[tuple[int, int, float]]:
    """The smoothness edges: neighbours by their distance in the tree, and the next block of one parent that the markup treats alike."""
    out: list[tuple[int, int, float]] = []
    last: dict[tuple, int] = {}
    share = [b.linked / len(b.text) for b in found]
    for i, b in enumerate(found):
        like = (b.tag, b.says, b.maybe)
        if i:
            a = found[i - 1]
            near = STEP ** max(0, distance(a, b) - 2) * (1.0 if like == (a.tag, a.says, a.maybe) else UNLIKE)
            out.append((i - 1, i, ADJACENT * near * (1 - LINKS * abs(share[i] - share[i - 1]))))
        parent = (b.path[1] if len(b.path) > 1 else 0, *like)
        if parent in last:
            out.append((last[parent], i, SIBLING * (1 - LINKS * abs(share[i] - share[last[parent]]))))
        last[parent] = i
    return out


def choose(found: list[Block], model: Model) -> list[bool]:
    """Which blocks are content."""
    return min_cut(log_odds(found, model), edges_of(found))


def main_text(html: str, model: Model | None = None) -> str:
    found = blocks(html)
    return "\n\n".join(b.text for b, on in zip(found, choose(found, model or Model())) if on)


def train(pages: DataFrame, most: int = SAMPLE_PAGES) -> Model:
    """Fits the classifier on at most ``most`` pages, taken by a hash of page_id so that the sample is the same each time."""
    picked = pages.select("page_id").filter("page_id IS NOT NULL").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(most)
    sample = pages.join(F.broadcast(picked), "page_id", "left_semi").select(F.coalesce("html", F.lit("")).alias("html"), F.xxhash64("page_id").alias("turn"))
    return fit([r.html for r in sample.orderBy("turn", "html").limit(most).toLocalIterator()])


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """Adds text, the main text of html, and n_chars, its code points.

    Null counts as an empty page; a page without content has an empty text.
    Columns named text or n_chars are replaced, others pass through.
    """

    def start():
        def run(html):
            found = [main_text(h, model) for h in texts(html)]
            return [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]

        return run

    return with_arrow(pages, ["html"], [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], start)


def report(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html"), train(pages)).select("page_id", "url", "text", "n_chars")
