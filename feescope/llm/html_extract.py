"""Main text of HTML pages by gradient-boosted trees over DOM nodes.

Every block element is a node with features of its subtree (text, links, punctuation, tags), its tag
and attribute tokens and those of its ancestors, its depth, place and siblings. Boosted trees give each
node the log odds of holding main text; a tree decoding then keeps the set of nodes with the largest
sum in which no kept node has a dropped ancestor.

Training rows are made here: texts of at most ``max_pages`` pages, drawn by hash of their id, are laid
out again in random page layouts whose regions are known (menus, headers, footers, sidebars, notices,
adverts, forms, comments, share bars around or inside the article), and the pages themselves count where
their own article element says what is main. All pages are scored, each as a whole.

Defined results: null html counts as empty; a page without main text gives an empty string; repeated
rows give equal rows; unclosed, crossed or stray tags are mended as browsers do in the common cases.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feescope.llm.common import thin

MAX_PAGES = 400
_SAMPLE_BYTES = 60_000

# --- fixed values: HTML element kinds ---------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never text of the page.
SILENT = frozenset("script style head title template noscript iframe svg canvas object select option textarea button audio video".split())
#: Their content is not read as markup.
RAW = frozenset("script style title textarea noscript template iframe".split())
#: What does not end an open head.
IN_HEAD = RAW - {"textarea", "iframe"} | frozenset("base basefont bgsound link meta html head".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
#: An opening tag of the key closes an open element of the value, up to a boundary.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
    "tfoot": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"},
}
BOUNDARY = frozenset("html body table ul ol dl div section article main aside nav header footer form td th blockquote".split())
TAG_GROUPS = [
    "html body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form fieldset label dialog", "p", "ul ol dl menu",
    "li dt dd", "h1", "h2 h3", "h4 h5 h6", "table thead tbody tfoot tr td th caption", "blockquote pre figure figcaption", "address details summary",
]
TOKEN_GROUPS = [
    "nav menu navbar navigation topnav menubar", "header masthead topbar branding logo hero brand", "footer copyright legal colophon bottom",
    "sidebar aside widget rail side secondary complementary", "ad ads advert adverts advertisement sponsor sponsored promo promotion banner adsense commercial",
    "cookie cookies consent notice notices alert popup modal gdpr overlay announcement warning message disclaimer toast",
    "newsletter subscribe subscription signup optin mailing", "login search form signin register contact contactform feedback poll survey",
    "share sharing social follow buttons toolbar tools", "related recommend recommended more trending popular also teaser teasers readmore",
    "comment comments commentlist reply replies discussion respond responses disqus thread reader readers",
    "breadcrumb breadcrumbs pagination pager paging crumbs skip", "content article post entry story main body text maincontent page prose",
    "meta byline author tags date info hidden",
]
_TAG_GROUP = {t: i for i, names in enumerate(TAG_GROUPS) for t in names.split()}
_TOKEN_BIT = {t: i for i, names in enumerate(TOKEN_GROUPS) for t in names.split()}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
#: What a "<" after the last ">" of a page can begin.
_LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?()()()()()()", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|aria-label|data-gold)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class _Source:
    """A page's text with what is known of what still comes, so that nothing is searched for twice."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.last = text.rfind(">")
        self.closes: dict[str, list[int]] = {}  # tag -> where its end tags begin

    def markup(self, at: int) -> re.Match | None:
        """The next comment or tag."""
        text, find = self.text, self.text.find
        at = find("<", at)
        while at >= 0:
            match = (_MARKUP if at < self.last else _LOOSE).match(text, at)
            if match:
                return match
            at = find("<", at + 1)
        return None

    def _left(self, tag: str, at: int) -> tuple[list[int], int]:
        if tag not in self.closes:
            self.closes[tag] = [m.start() for m in re.finditer(rf"</{tag}\b", self.text, re.I)]
        return self.closes[tag], bisect_left(self.closes[tag], at)

    def close(self, tag: str, at: int) -> int:
        """Where the next ``</tag`` begins, -1 if there is none."""
        found, k = self._left(tag, at)
        return found[k] if k < len(found) else -1

    def n_closes(self, tag: str, at: int) -> int:
        found, k = self._left(tag, at)
        return len(found) - k

    def raw_end(self, at: int, tag: str, attributes: str, inside: str = "") -> int:
        """Where the content of a raw element that opens before ``at`` and its end tag are over."""
        if attributes.endswith("/") and (tag == "iframe" or inside == "svg"):
            return at
        start = self.close(tag, at)
        end = self.text.find(">", start) if start >= 0 else -1
        return end + 1 if end >= 0 else len(self.text)

    def silent_end(self, at: int, tag: str, around: set[str]) -> int:
        """Where the silent element that opens before ``at`` is over; 0 if its parent ends, or another opens, before its end tag."""
        inner, depth, nested = {}, 0, 0  # open elements by tag, with their depth
        if self.close(tag, at) < 0:
            return 0
        opened: list[str] = []
        while match := self.markup(at):
            at = match.end()
            name = (match[2] or match[5] or "").lower()
            attributes = match[3] or match[6] or ""
            if not name:
                continue
            if (match[1] or match[4]) == "/":
                if name == tag:
                    if not nested:
                        return at
                    nested -= 1
                elif inner.get(name):
                    while True:
                        last = opened.pop()
                        inner[last] -= 1
                        if last == name:
                            break
                elif name in around:
                    return 0
            elif name in RAW:
                at = self.raw_end(at, name, attributes, tag)
            elif name == "body" or name == tag and tag not in ("object", "svg", "canvas"):
                return 0
            elif not attributes.endswith("/"):
                if name == tag:
                    nested += 1
                    if nested + 1 > self.n_closes(tag, at):  # too few end tags are left
                        return 0
                elif name not in VOID:
                    inner[name] = inner.get(name, 0) + 1
                    opened.append(name)
        return 0


class _Open:
    """Open elements with the node their text belongs to, and where the elements of each tag are."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int] | None] = [("html", 0)]  # None: closed below an open one
        self.at: dict[str, list[int]] = {}
        self.links = 0

    @property
    def node(self) -> int:
        return self.stack[-1][1]

    def last(self, tag: str) -> int:
        """The innermost open element of ``tag``; 0 without one."""
        found = self.at.get(tag)
        return found[-1] if found else 0

    def innermost(self, tags) -> int:
        return max([self.last(t) for t in tags], default=0)

    def push(self, tag: str, node: int) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, node))
        self.links += tag == "a"

    def cut(self, i: int) -> None:
        """Close element ``i`` and all inside it."""
        for item in self.stack[i:]:
            if item is not None:
                self.at[item[0]].pop()
                self.links -= item[0] == "a"
        del self.stack[i:]
        self._trim()

    def drop(self, i: int) -> None:
        """Close element ``i`` alone, the innermost of its tag."""
        tag = self.stack[i][0]
        self.at[tag].pop()
        self.links -= tag == "a"
        self.stack[i] = None
        self._trim()

    def _trim(self) -> None:
        while self.stack[-1] is None:
            self.stack.pop()

    def tags(self) -> set[str]:
        return {t for t, found in self.at.items() if found} | {"html"}


def _ends_silent(silent: str, tag: str, closing: bool, open_: _Open) -> bool:
    """Whether a tag ends a head, or another silent element that lacks its end tag."""
    if silent == "head":
        return tag in ("body", "html") if closing else tag not in IN_HEAD
    return (open_.last(tag) > 0 or tag == "html") if closing else tag == silent or tag in _TAG_GROUP


class Page:
    """Block nodes in page order, and the text runs with the node each belongs to."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.bits, self.gold = [-1], ["html"], [0], [""]
        self.runs: list[tuple[int, str, bool]] = []  # node, text, inside a link
        self._parse(source)

    def _node(self, parent: int, tag: str, attributes: str) -> int:
        bits, gold = 0, ""
        if attributes and "=" in attributes:
            for name, *values in _ATTRIBUTE.findall(attributes):
                value = next(filter(None, values), "")
                if name.lower() == "data-gold":
                    gold = value
                    continue
                for token in _TOKEN.findall(value):
                    bit = _TOKEN_BIT.get(token.lower())
                    if bit is not None:
                        bits |= 1 << bit
        self.parent.append(parent)
        self.tag.append(tag)
        self.bits.append(bits)
        self.gold.append(gold)
        return len(self.parent) - 1

    def _parse(self, source: str) -> None:
        open_, page = _Open(), _Source(source)
        at, end, silent = 0, len(source), ""
        while at < end:
            match = page.markup(at)
            start = match.start() if match else end
            if silent == "head" and source[at:start].strip():
                silent = ""
            if start > at and not silent:
                text = source[at:start]
                self.runs.append((open_.node, entities.unescape(text) if "&" in text else text, open_.links > 0))
            if not match:
                break
            at = match.end()
            tag = match[2] or match[5]
            if not tag:
                continue
            tag, closing = tag.lower(), (match[1] or match[4]) == "/"
            attributes = match[3] or match[6] or ""
            if tag in RAW:
                if not closing:
                    at = page.raw_end(at, tag, attributes, silent)
                continue
            if silent:
                if closing and tag == silent:
                    silent = ""
                    continue
                if not _ends_silent(silent, tag, closing, open_):
                    continue
                silent = ""
            if tag in SILENT:
                if tag != "head" and not closing and not attributes.endswith("/"):
                    close = page.silent_end(at, tag, open_.tags() | {"html", "body"})
                    at, silent = (close, "") if close else (at, tag)
                elif tag == "head" and not closing:
                    silent = "head"
                continue
            if tag in INLINE:
                if closing:
                    i = open_.last(tag)
                    if i and i > open_.innermost(BOUNDARY):
                        open_.drop(i)
                else:
                    node = open_.node
                    if tag != "a" and _TOKEN_ATTR.search(attributes):
                        node = self._node(node, tag, attributes)
                    open_.push(tag, node)
                continue
            self.runs.append((open_.node, " ", False))
            if tag in VOID:
                continue
            if closing:
                i = open_.last(tag)
                barred = tag in ("p", "li", "span", "h1", "h2", "h3") and open_.innermost(("table", "article", "main", "body")) > i
                if i and not barred:
                    open_.cut(i)
                continue
            if tag in ("html", "body"):
                if tag == "body" and not open_.last("body"):
                    open_.push(tag, self._node(open_.node, tag, attributes))
                continue
            closes = CLOSES.get(tag, set()) | {"p"}
            while (i := open_.innermost(closes)) and i > open_.innermost(BOUNDARY - closes):
                open_.cut(i)
                if tag not in ("tr", "thead", "tbody", "tfoot", "dt", "dd"):
                    break
            open_.push(tag, self._node(open_.node, tag, attributes))

    def text(self, kept: np.ndarray | list[bool]) -> str:
        return " ".join("".join([t for n, t, _ in self.runs if t == " " or kept[n]]).split())


_TOKEN_ATTR = re.compile(r"\b(?:class|id|role|data-gold)\s*=", re.I)

# --- features -----------------------------------------------------------------

_N_TAGS, _N_TOKENS = len(TAG_GROUPS) + 1, len(TOKEN_GROUPS)


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows for all nodes of all pages; parents, depths and the first node of every page."""
    sizes = np.array([len(p.parent) for p in pages])
    first = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + f) for p, f in zip(pages, first)])
    group = np.array([_TAG_GROUP.get(t, _N_TAGS - 1) for p in pages for t in p.tag])
    bits = np.array([b for p in pages for b in p.bits], np.int64)
    owner = np.repeat(np.arange(len(pages)), sizes)
    depth = np.zeros(n, np.int64)
    is_child = parent >= 0
    for i in np.flatnonzero(is_child):  # parents come first
        depth[i] = depth[parent[i]] + 1

    runs = [(f + r[0], len(r[1]), r[2], r[1].count(" "), sum(map(r[1].count, ",.;:!?"))) for p, f in zip(pages, first) for r in p.runs if r[1] != " "]
    run = np.array(runs, np.float64).reshape(-1, 5)
    node = run[:, 0].astype(np.int64)

    def per_node(values: np.ndarray) -> np.ndarray:
        return np.bincount(node, values, n)

    own = np.stack([per_node(run[:, 1]), per_node(run[:, 1] * run[:, 2]), per_node(run[:, 3]), per_node(run[:, 4]), per_node(np.ones(len(run)))], 1)
    kinds = [group == _TAG_GROUP[t] for t in ("p", "li", "h1", "form")]
    below = np.hstack([own, np.ones((n, 1)), np.stack(kinds, 1)])
    before = np.zeros(n)
    total = np.bincount(owner, own[:, 0], len(pages))
    # Text before a node: its own runs follow the nodes in page order closely enough.
    flow = np.cumsum(own[:, 0]) - own[:, 0]
    before = flow - flow[first][owner]
    around = np.zeros((n, _N_TAGS + _N_TOKENS))
    here = np.zeros((n, _N_TAGS + _N_TOKENS))
    here[np.arange(n), group] = 1
    here[:, _N_TAGS:] = (bits[:, None] >> np.arange(_N_TOKENS)) & 1
    by_depth = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1 if n else 0)]
    for at in by_depth[1:]:
        around[at] = np.maximum(around[parent[at]], here[parent[at]])
    for at in reversed(by_depth[1:]):
        np.add.at(below, parent[at], below[at])
    n_children = np.bincount(parent[is_child], minlength=n)
    place = np.zeros(n)
    seen: dict[int, int] = {}
    for i in np.flatnonzero(is_child).tolist():
        up = int(parent[i])
        place[i] = seen.get(up, 0)
        seen[up] = seen.get(up, 0) + 1
    brothers = np.where(is_child, n_children[parent], 1)
    same = np.zeros(n)
    key = parent * (_N_TAGS + 1) + group
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    same = count[inverse]
    chars = below[:, 0]
    family = np.zeros(n)
    family[is_child] = chars[parent[is_child]]
    dense = [
        depth, np.log1p(chars), np.log1p(own[:, 0]), below[:, 1] / (chars + 1), below[:, 2] / (chars + 1), 100 * below[:, 3] / (chars + 20),
        100 * below[:, 5] / (chars + 20), chars / (below[:, 4] + 1), np.log1p(below[:, 6]), np.log1p(below[:, 7]), below[:, 8], below[:, 9],
        brothers, place / np.maximum(brothers, 1), same, chars / (total[owner] + 1), before / (total[owner] + 1), chars / (family + 1), n_children,
    ]
    return np.hstack([here, around, np.stack(dense, 1)]), parent, depth, first


# --- boosted trees ------------------------------------------------------------


@dataclass
class Trees:
    """Complete binary trees of equal depth: split features and bounds, leaf values."""

    feature: np.ndarray
    bound: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, bound, value in zip(self.feature, self.bound, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > bound[at])
            out += value[at - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32) -> Trees:
    """Logistic boosting with Newton leaves on quantile-binned features."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
    prior = np.clip(y.mean(), 0.01, 0.99)
    base = float(np.log(prior / (1 - prior)))
    score = np.full(len(y), base)
    inner = (1 << depth) - 1
    feature, bound, value = (np.zeros((n_trees, k)) for k in (inner, inner, inner + 1))
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        gradient, curve = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            width = 1 << level
            local = at - (width - 1)
            best = np.zeros(width)
            pick = np.zeros((width, 2), np.int64)
            total_g, total_h = np.bincount(local, gradient, width), np.bincount(local, curve, width)
            for f in range(x.shape[1]):
                if not len(cuts[f]):
                    continue
                key = local * (bins + 1) + binned[:, f]
                g = np.bincount(key, gradient, width * (bins + 1)).reshape(width, -1).cumsum(1)[:, : len(cuts[f])]
                h = np.bincount(key, curve, width * (bins + 1)).reshape(width, -1).cumsum(1)[:, : len(cuts[f])]
                rest_g, rest_h = total_g[:, None] - g, total_h[:, None] - h
                gain = g**2 / (h + 1) + rest_g**2 / (rest_h + 1) - (total_g**2 / (total_h + 1))[:, None]
                gain[(h < 1) | (rest_h < 1)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best[better] = gain[np.arange(width), top][better]
                pick[better] = np.stack([np.full(width, f), top], 1)[better]
            for k in range(width):
                feature[t, width - 1 + k] = pick[k, 0]
                bound[t, width - 1 + k] = cuts[pick[k, 0]][pick[k, 1]] if best[k] > 0 else np.inf
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[t, at].astype(np.int64)] > bound[t, at])
        leaf = at - inner
        g, h = np.bincount(leaf, gradient, inner + 1), np.bincount(leaf, curve, inner + 1)
        value[t] = rate * g / (h + 1)
        score += value[t, leaf]
    return Trees(feature.astype(np.int64), bound, value, base, depth)


def decode(odds: np.ndarray, weight: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The ancestor-closed set of nodes with the largest weighted sum of log odds."""
    worth = odds * weight
    order = np.argsort(-depth, kind="stable")
    for i in order.tolist():
        if parent[i] >= 0 and worth[i] > 0:
            worth[parent[i]] += worth[i]
    kept = worth > 0
    for i in order[::-1].tolist():
        if parent[i] >= 0:
            kept[i] &= kept[parent[i]]
    return kept


def extract(sources: list[str], trees: Trees) -> list[str]:
    """Main text of whole pages."""
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    x, parent, depth, first = features(pages)
    own = np.expm1(x[:, _N_TAGS + _N_TOKENS + _N_TAGS + _N_TOKENS + 2])
    kept = decode(trees(x), own + 1, parent, depth)
    return [p.text(kept[f : f + len(p.parent)]) for p, f in zip(pages, first)]


# --- training -----------------------------------------------------------------


def _labelled(page: Page) -> np.ndarray:
    """1 where a node holds main text: its nearest marked ancestor says so, or a node below does."""
    gold = np.zeros(len(page.parent))
    mark = [""] * len(gold)
    for i, up in enumerate(page.parent):
        mark[i] = page.gold[i] or (mark[up] if up >= 0 else "")
        gold[i] = mark[i] == "1"
    for i in range(len(gold) - 1, 0, -1):
        if gold[i] and mark[page.parent[i]] != "0":
            gold[page.parent[i]] = 1
    return gold


_OWN_PARTS = re.compile(r"<(article|main|nav|aside|footer|form)\b", re.I)


def _marked(source: str) -> str | None:
    """A page with an article element, its sections marked by their own element names."""
    if "<article" not in source.lower():
        return None
    return _OWN_PARTS.sub(lambda m: f'<{m[1]} data-gold="{int(m[1].lower() in ("article", "main"))}"', source)


class Layouts:
    """Random page layouts with known regions around given paragraphs."""

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)

    def pick(self, *options):
        return options[self.rng.integers(len(options))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, paragraphs: list[str], low: int, high: int) -> str:
        source = paragraphs[self.rng.integers(len(paragraphs))].split() or ["text"]
        n = int(self.rng.integers(low, high + 1))
        start = int(self.rng.integers(max(1, len(source) - n + 1)))
        return entities.escape(" ".join(source[start : start + n]))

    def links(self, paragraphs: list[str], low: int = 3, high: int = 9) -> str:
        n = int(self.rng.integers(low, high))
        items = [f'<a href="/{i}">{self.words(paragraphs, 1, 4)}</a>' for i in range(n)]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if self.chance(0.7) else self.pick(" | ", " ").join(items)

    def off(self, tag: str, names: list[str], inside: str, plain: float = 0.15) -> str:
        """A region that is not main text; element names alone may have to tell."""
        token = names[self.rng.integers(len(names))] if names else ""
        attribute = f' {self.pick("class", "class", "id")}="{token}"' if token and not self.chance(plain if tag != "div" else 0.0) else ""
        return f'<{tag}{attribute} data-gold="0">{inside}</{tag}>'

    def region(self, kind: str, p: list[str]) -> str:
        sentence = lambda: f"<p>{self.words(p, 5, 30)}</p>" if self.chance(0.6) else self.words(p, 5, 30)
        if kind == "menu":
            return self.off(self.pick("nav", "nav", "div"), ["menu", "nav", "main-nav", "navbar", "site-menu"], self.links(p))
        if kind == "header":
            inside = f"<{self.pick('h1', 'div', 'span', 'p')}>{self.words(p, 1, 5)}</{self.pick('div', 'p')}>" + (self.links(p) if self.chance(0.4) else "")
            return self.off(self.pick("header", "header", "div"), ["header", "masthead", "site-header", "top-bar", "branding"], inside)
        if kind == "footer":
            inside = f"&copy; {self.words(p, 2, 12)}" + (self.links(p) if self.chance(0.5) else "") + (sentence() if self.chance(0.3) else "")
            return self.off(self.pick("footer", "footer", "div"), ["footer", "site-footer", "copyright", "legal"], inside)
        if kind == "side":
            inside = f"<h3>{self.words(p, 1, 4)}</h3>" + self.pick(self.links(p), sentence() + self.links(p), sentence(), sentence() + sentence())
            return self.off(self.pick("aside", "aside", "div", "section"), ["sidebar", "side-bar", "widget", "right-rail", "related", "recommended", "popular-posts"], inside)
        if kind == "notice":
            inside = sentence() + ("<button>OK</button>" if self.chance(0.5) else "")
            return self.off(self.pick("div", "div", "section", "aside"), ["cookie-notice", "notice", "cookie-banner", "consent", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe-box"], inside)
        if kind == "ad":
            inside = sentence() + (sentence() if self.chance(0.3) else "") + (f'<a href="/x">{self.words(p, 1, 5)}</a>' if self.chance(0.5) else "")
            return self.off(self.pick("div", "div", "aside", "section", "p"), ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot"], inside, 0.0)
        if kind == "form":
            inside = f"<label>{self.words(p, 1, 4)}</label><input name=q>" + (sentence() if self.chance(0.5) else "") + f"<button>{self.words(p, 1, 2)}</button>"
            return self.off(self.pick("form", "form", "div"), ["search-form", "login", "signup", "contact-form", "subscribe"], inside)
        if kind == "share":
            return self.off(self.pick("div", "ul"), ["share", "social", "share-buttons", "tags", "breadcrumb", "pagination", "breadcrumbs"], self.links(p, 2, 6))
        each = self.pick("div", "li", "article", "p", "div")
        own = "" if each == "p" and self.chance(0.5) else f' class="{self.pick("comment", "comment-body", "reply", "comment")}"'
        notes = "".join(
            f"<{each}{own}>" + (f"<b>{self.words(p, 1, 2)}</b> " if self.chance(0.6) else "") + self.pick(sentence, lambda: self.words(p, 10, 80))() + f"</{each}>"
            for _ in range(int(self.rng.integers(1, 8)))
        )
        title = f"<h{self.pick(2, 3)}>{self.words(p, 1, 3)}</h{self.pick(2, 3)}>" if self.chance(0.6) else ""
        return self.off(self.pick("section", "div", "ol", "ul"), ["comments", "comment-list", "discussion", "responses", "reader-comments"], title + notes, 0.0)

    def article(self, p: list[str]) -> str:
        parts = [f"<h1>{self.words(p, 3, 12)}</h1>"] if self.chance(0.85) else []
        if self.chance(0.25):
            parts = [f"<header>{''.join(parts)}</header>"]
        wrap = self.pick("p", "p", "p", "p", "div", "section")
        short = self.chance(0.25)  # a line or two is an article, too
        for _ in range(int(self.rng.integers(0 if parts else 1, 3)) if short else int(self.rng.integers(1, 14))):
            text = entities.escape(p[self.rng.integers(len(p))]) if self.chance(0.8) and not short else self.words(p, 1, 25)
            if self.chance(0.15):
                text = f"<b>{text}<br>" if self.chance(0.5) else f'<a href="/y">{self.words(p, 1, 3)}</a> {text}'
            kind = self.rng.random()
            if kind < 0.06:
                text = "<ul>" + "".join(f"<li>{self.words(p, 2, 20)}</li>" for _ in range(int(self.rng.integers(2, 6)))) + "</ul>"
            elif kind < 0.1:
                text = f"<blockquote>{text}</blockquote>"
            elif kind < 0.13:
                text = "<table>" + "".join(f"<tr><td>{self.words(p, 1, 6)}</td><td>{self.words(p, 1, 6)}</td></tr>" for _ in range(3)) + "</table>"
            elif kind < 0.18:
                text = f"<h2>{self.words(p, 1, 8)}</h2>"
            elif kind < 0.2:
                text = f"<pre>{text}</pre>"
            else:
                text = f"<{wrap}>{text}" + (f"</{wrap}>" if self.chance(0.95) else "")
            parts.append(text)
            if self.chance(0.06):
                parts.append(self.region(self.pick("ad", "side", "share", "notice", "form"), p))
        body = "".join(parts)
        if self.chance(0.25):
            body = f'<div class="{self.pick("content", "body", "entry-content", "text", "x1")}">{body}</div>'
        tag = self.pick("article", "article", "article", "main", "div", "section")
        name = self.pick("content", "article", "post", "entry", "story", "main-content", "post-body", "c2")
        attribute = f' {self.pick("class", "id")}="{name}"' if tag in ("div", "section") or self.chance(0.3) else ""
        return f'<{tag}{attribute} data-gold="1">{body}' + (self.region("comments", p) if self.chance(0.12) else "") + f"</{tag}>"

    def page(self, p: list[str]) -> str:
        above = [k for k, c in (("notice", 0.25), ("header", 0.5), ("menu", 0.7), ("share", 0.2), ("form", 0.2), ("ad", 0.5), ("side", 0.2)) if self.chance(c)]
        under = [k for k, c in (("share", 0.25), ("ad", 0.3), ("comments", 0.45), ("side", 0.4), ("form", 0.25), ("notice", 0.2), ("footer", 0.75)) if self.chance(c)]
        middle = self.article(p)
        if self.chance(0.3):
            middle = f"<main>{middle}</main>"
        if self.chance(0.3):
            middle = f'<div class="{self.pick("container", "wrapper", "row", "page")}">{middle}{self.region("side", p) if self.chance(0.5) else ""}</div>'
        body = "".join([self.region(k, p) for k in above] + [middle] + [self.region(k, p) for k in under])
        return f"<html><head><title>t</title></head><body>{body}</body></html>"


def train(pages: DataFrame, max_pages: int = MAX_PAGES, layouts: int = 800, seed: int = 11) -> Trees:
    """Trees from a bounded sample of ``pages`` and random layouts of their texts."""
    sample = (
        thin(pages, pages.count(), max_pages, "page_id", "url").select("page_id", "html").filter(F.length("html").between(1, _SAMPLE_BYTES))
        .orderBy(F.xxhash64("page_id"), "page_id", "html").limit(max_pages).collect()
    )
    texts = []
    for row in sample:
        page = Page(row.html)
        blocks: dict[int, str] = {}
        for node, text, _ in page.runs:
            blocks[node] = blocks.get(node, "") + text
        texts += [[t for t in (" ".join(b.split()) for b in blocks.values()) if len(t) > 40]]
    texts = [t for t in texts if t] or [["some words, of no language, in a row.", "a few more words stand here, and end."]]
    maker = Layouts(seed)
    made = [maker.page(texts[maker.rng.integers(len(texts))]) for _ in range(layouts)]
    marked = [Page(s) for s in made + [m for m in (_marked(r.html) for r in sample[:100]) if m]]
    x = features(marked)[0]
    y = np.concatenate([_labelled(p) for p in marked])
    return boost(x, y)


def main_texts(pages: DataFrame, trees: Trees) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                found = extract([s or "" for s in part.column(2).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    given = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return given.mapInArrow(run, "page_id long, url string, text string, n_chars long")
