"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Every block element is a node with features of its subtree (text, link and tag density,
punctuation), its attribute tokens, its depth and its siblings. The trees give the log-odds that a
node holds main text. Nodes are then decided together: a node that is out takes its whole subtree
with it, one that is in leaves its children free, and the most likely such labelling is found from
the leaves up. So no descendant of a rejected node comes back, and no kept node stands in a
rejected one.

The trees are trained here, on pages that ``make_page`` writes from many layouts, with the truth.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .textops import chunks

# Fixed values of HTML: elements that never have content, whose content is left out, of these the ones that hold no markup, and those that stand in lines of text.
VOID = frozenset("area base br circle col ellipse embed hr img input line link meta param path polygon polyline rect source stop track use wbr".split())
RAW = frozenset("script style template iframe annotation annotation-xml textarea title select option datalist button".split())
SWALLOW = frozenset("script style textarea title".split())
_MATHS = "math menclose merror mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics"
INLINE = frozenset(f"a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark object q s samp small span strike strong sub sup time tt u var wbr br img input {_MATHS}".split())
#: Elements that a start tag of the key closes if they are open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Block elements that may hold their like; an open paragraph ends at any of them, and at a paragraph.
SCOPES = frozenset("table td th ul ol div section article main aside body html blockquote form".split())

#: A tag: name and attributes up to its end. Quotes count after an equals sign only; the second form ignores them.
_TAGS = tuple(re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)({inside})>") for inside in (r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+""", r"[^>]*+"))
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Nodes whose features stand in memory together, about.
NODES = 1 << 15

#: Lexicon groups of attribute tokens.
GROUPS = [
    "content article post entry main story body text blog page",
    "nav menu navigation navbar breadcrumb breadcrumbs toc",
    "header masthead top banner brand logo",
    "footer bottom copyright legal",
    "sidebar aside side widget rail related recommended more",
    "ad ads advert advertisement sponsor sponsored promo promoted",
    "notice cookie cookies consent alert gdpr message popup modal overlay",
    "form subscribe newsletter signup login search",
    "comment comments discussion reply replies respond disqus",
    "share social follow tags meta byline author date",
]
_GROUP = {w: k for k, words in enumerate(GROUPS) for w in words.split()}
TAGS = "article main section div p h1 h2 h3 h4 ul ol li table tr td blockquote pre figure figcaption nav header footer aside form fieldset dl address body".split()
_TAG = {t: k for k, t in enumerate(TAGS)}


def _markup(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(begin, end, "/" of an end tag, lower-case name, attributes) of each tag; comments and declarations have no name.

    What follows an element that holds no markup (a script, say) starts after its end tag. A comment
    or such an element that isn't closed takes the rest. The first tag that has no end because of its
    quotes makes quotes ordinary characters from there on, so no place is scanned again and again.
    """
    at, last, tag = 0, source.rfind(">"), _TAGS[0]
    closed: dict[str, bool] = {}
    while 0 <= (at := source.find("<", at)) <= last:
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            end = end + 3 if end >= 0 else len(source)
            yield at, end, "", "", ""
        elif source[at + 1] in "!?":
            end = source.find(">", at) + 1
            yield at, end, "", "", ""
        else:
            m = tag.match(source, at)
            if m is None and tag is _TAGS[0] and _TAGS[1].match(source, at):
                tag = _TAGS[1]
                m = tag.match(source, at)
            if m is None:
                at += 1
                continue
            end, name = m.end(), m[2].lower()
            if name in SWALLOW and not m[1] and not m[3].endswith("/"):
                # Whether any end tag follows is asked once, when a search has failed.
                found = _END_TAG[name].search(source, end) if closed.get(name, True) else None
                closed[name] = found is not None
                end = found.end() if found else len(source)
            yield at, end, m[1], name, m[3]
        at = end


_END_TAG = {name: re.compile(rf"</{name}\b[^>]*+>", re.I) for name in SWALLOW}


def _ends(tags: list[tuple[int, int, str, str, str]]) -> dict[int, int]:
    """For start tags of elements whose content is left out, the place in ``tags`` of their end tag; those without one aren't listed."""
    open_: dict[str, list[int]] = {}
    found = {}
    for k, (_, _, slash, name, attrs) in enumerate(tags):
        if name in RAW and name not in SWALLOW:
            if slash:
                if starts := open_.get(name):
                    found[starts.pop()] = k
            elif not attrs.endswith("/"):
                open_.setdefault(name, []).append(k)
    return found


class Page:
    """Block elements of a page in page order, with the text runs between their borders."""

    __slots__ = ("tag", "parent", "attrs", "runs", "depth", "truth")

    def __init__(self, source: str):
        self.tag, self.parent, self.attrs, self.depth, self.truth = ["body"], [-1], [""], [0], [False]
        self.runs: list[tuple[int, str, int, int]] = []  # node, text, characters in links, inline tags
        self._read(source)

    def _read(self, source: str) -> None:
        stack, inline, texts, linked, tags, at, end = [0], [], [], 0, 0, 0, len(source)
        # How many elements of a name are open, so that no stack is searched in vain.
        open_, lined = Counter(), Counter()
        markup = list(_markup(source))
        ends = _ends(markup)
        heads = [k for k, x in enumerate(markup) if x[3] == "head" and x[2] or x[3] == "body" and not x[2]]

        def flush() -> None:
            nonlocal texts, linked, tags
            if texts:
                text = " ".join(html.unescape("".join(texts)).split())
                if text:
                    self.runs.append((stack[-1], text, linked, tags))
            texts, linked, tags = [], 0, 0

        def leave(depth: int) -> None:
            open_.subtract(self.tag[x] for x in stack[depth:])
            del stack[depth:], inline[:]
            lined.clear()

        here = -1
        while at < end:
            here += 1
            begin, after, slash, name, attrs = markup[here] if here < len(markup) else (end, end, "", "", "")
            if begin > at:
                texts.append(source[at:begin])
                linked += (begin - at) * (lined["a"] > 0)
            at, closing = after, slash == "/"
            if not name:
                continue
            if name in RAW:
                # Without its end tag the tag alone goes.
                if here in ends:
                    here = ends[here]
                    at = markup[here][1]
                continue
            if name in INLINE:
                tags += 1
                if name == "br":
                    texts.append(" ")
                elif name not in VOID:
                    if not closing:
                        inline.append(name)
                        lined[name] += 1
                    elif lined[name]:
                        gone = ""
                        while gone != name:
                            gone = inline.pop()
                            lined[gone] -= 1
                continue
            flush()
            if name in ("html", "body"):
                if not closing and name == "body":
                    self.attrs[0] = attrs
                continue
            if name == "head":
                place = bisect.bisect_right(heads, here)
                if not closing and place < len(heads):
                    # The head is left out: on to its end tag, or to the body's start tag.
                    here = heads[place] if markup[heads[place]][3] == "head" else heads[place] - 1
                    at = markup[here][1]
                continue
            if name in VOID:
                continue
            if closing:
                for k in range(len(stack) - 1, 0, -1) if open_[name] else ():
                    if self.tag[stack[k]] == name:
                        leave(k)
                        break
                continue
            shuts = CLOSES.get(name) or {"p"}
            for k in range(len(stack) - 1, 0, -1) if any(open_[x] for x in shuts) else ():
                if self.tag[stack[k]] in shuts:
                    leave(k)
                    break
                if self.tag[stack[k]] in SCOPES:
                    break
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.depth.append(len(stack))
            self.attrs.append(attrs)
            self.truth.append("data-truth" in attrs)
            stack.append(len(self.tag) - 1)
            open_[name] += 1
        flush()


def _attr_tokens(source: str) -> list[str]:
    out = []
    for name, a, b, c in _ATTR.findall(source):
        if name.lower() in ("class", "id", "role", "itemprop", "aria-label"):
            out += [w.lower() for w in _PIECES.findall(a or b or c)]
    return out


_known_attrs: dict[str, tuple[np.ndarray, int]] = {}


def _attr_features(source: str) -> tuple[np.ndarray, int]:
    """Group flags of an element's attribute tokens, whether it has other ones, and how many; and the flags as bits."""
    known = _known_attrs.get(source)
    if known is None:
        found, bits = np.zeros(len(GROUPS) + 2), 0
        for w in _attr_tokens(source):
            found[_GROUP.get(w, len(GROUPS))] = 1.0
            bits |= 1 << _GROUP[w] if w in _GROUP else 0
            found[-1] += 1
        if len(_known_attrs) > 20_000:
            _known_attrs.clear()
        known = _known_attrs[source] = found, bits
    return known


def features(page: Page, limit: int | None = None) -> Iterator[np.ndarray]:
    """A row of features for each node of a page, in matrices of at most ``limit`` rows."""
    n = len(page.tag)
    parent = np.array(page.parent)
    chars, links, tags, stops, words, blocks, paragraphs, longest = (np.zeros(n) for _ in range(8))
    begin = np.full(n, np.inf)
    total = 0
    for node, text, linked, inline in page.runs:
        size = len(text)
        chars[node] += size
        links[node] += min(linked, size)
        tags[node] += inline
        stops[node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
        words[node] += text.count(" ") + 1
        blocks[node] += 1
        longest[node] = max(longest[node], size)
        begin[node] = min(begin[node], total)
        total += size
    own = chars.copy()
    tags += 1
    paragraphs[[t == "p" for t in page.tag]] = 1
    kids, same, rank, elder = (np.zeros(n) for _ in range(4))
    before: dict = {}
    for k in range(1, n):
        p = parent[k]
        rank[k] = kids[p]
        kids[p] += 1
        same[k] = before[p, page.tag[k]] = before.get((p, page.tag[k]), 0) + 1
    for k in range(n - 1, 0, -1):
        p = parent[k]
        for x in (chars, links, tags, stops, words, blocks, paragraphs):
            x[p] += x[k]
        longest[p] = max(longest[p], longest[k])
        begin[p] = min(begin[p], begin[k])
    up = np.maximum(parent, 0)
    begin = np.where(np.isfinite(begin), begin, total)
    elder[1:] = [before.get((p, t), 0) for p, t in zip(page.parent[1:], page.tag[1:])]
    size, link = np.maximum(chars, 1), np.minimum(links / np.maximum(chars, 1), 1)
    numbers = [
        np.array(page.depth, float), kids, rank / np.maximum(kids[up], 1), kids[up], same, elder, np.log1p(chars), np.log1p(own), link, chars / tags, stops / size, words / np.maximum(blocks, 1), np.log1p(paragraphs), np.log1p(blocks),
        chars / max(total, 1), chars / np.maximum(chars[up], 1), begin / max(total, 1), (begin + chars) / max(total, 1), np.log1p(longest), link[up], np.log1p(chars[up]), np.log1p(tags), size / np.maximum(words, 1), np.full(n, np.log1p(total)),
    ]
    tag = np.array([_TAG.get(t, len(TAGS)) for t in page.tag])
    said = [_attr_features(a) for a in page.attrs]
    # What the nearest ancestors say reaches down, as a bit for each group, but a node is judged on itself first.
    above = [0] * n
    for k in range(1, n):
        above[k] = above[page.parent[k]] | said[page.parent[k]][1]
    above, one = np.array(above), np.eye(len(TAGS) + 1)
    for a in range(0, n, limit or n):
        b = min(a + (limit or n), n)
        ancestors = (above[a:b, None] >> np.arange(len(GROUPS)) & 1).astype(float)
        yield np.hstack([np.stack([x[a:b] for x in numbers], axis=1), one[tag[a:b]], np.array([f for f, _ in said[a:b]]), ancestors, one[tag[up[a:b]]]])


def truth(page: Page) -> np.ndarray:
    """Whether each node holds main text, for pages whose main blocks are marked."""
    out = np.array(page.truth)
    for k in range(len(out) - 1, 0, -1):
        out[page.parent[k]] |= out[k]
    return out


class Trees:
    """Boosted regression trees with logistic loss over binned features."""

    def __init__(self, trees: int = 70, depth: int = 5, rate: float = 0.25, bins: int = 32, least: float = 8.0, ridge: float = 1.0):
        self.count, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.cuts: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, k], share)) for k in range(x.shape[1])]
        b, width = self._binned(x), self.bins + 1
        rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(rate / (1 - rate)))
        f = np.full(len(y), self.base)
        flat = b + np.arange(b.shape[1]) * width
        for _ in range(self.count):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            nodes = 2 ** (self.depth + 1) - 1
            split, cut_, value = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)
            where = np.zeros(len(y), np.int64)
            for node in range(nodes):
                own = np.flatnonzero(where == node)
                if not len(own):
                    continue
                gs, hs = g[own].sum(), h[own].sum()
                value[node] = self.rate * gs / (hs + self.ridge)
                if 2 * node + 2 >= nodes or hs < 1e-3 or len(own) < 2 * self.least:
                    continue
                cells = flat[own].ravel()
                size = b.shape[1] * width
                left = [np.bincount(cells, np.repeat(v, b.shape[1]), size).reshape(-1, width).cumsum(1) for v in (g[own], h[own], np.ones(len(own)))]
                gl, hl, nl = left
                gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                gain[(nl < self.least) | (len(own) - nl < self.least)] = -1
                best = int(gain.argmax())
                if gain.flat[best] <= 1e-6:
                    continue
                split[node], cut_[node] = divmod(best, width)
                where[own] = 2 * node + 1 + (b[own, split[node]] > cut_[node])
            f += value[where]
            self.trees.append((split, cut_, value))
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        b, out = self._binned(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for split, cut_, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                s = split[node]
                node = np.where(s >= 0, 2 * node + 1 + (b[rows, s] > cut_[node]), node)
            out += value[node]
        return out


def decode(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """The most likely labels of which no node that is out has a descendant that is in; the root is in."""
    out_ = -np.logaddexp(0, odds)  # log probability of out, then of the subtree out
    in_ = -np.logaddexp(0, -odds)
    for k in range(len(parent) - 1, 0, -1):
        p = parent[k]
        in_[p] += max(in_[k], out_[k])
        out_[p] += out_[k]
    keep = np.ones(len(parent), bool)
    for k in range(1, len(parent)):
        keep[k] = keep[parent[k]] and in_[k] >= out_[k]
    return keep


def make_page(rng: np.random.Generator) -> str:
    """A page of a random layout; blocks of its main text carry the attribute ``data-truth``."""
    syllables = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu an en in on un er ar st th nd".split()
    pick = lambda *x: x[rng.integers(len(x))]
    chance = lambda p: rng.random() < p

    def words(n: int) -> str:
        return " ".join("".join(syllables[k] for k in rng.integers(0, len(syllables), rng.integers(1, 5))) for _ in range(n))

    def prose(n: int) -> str:
        out = []
        while n > 0:
            k = int(min(n, rng.integers(1, 18)))
            out.append(words(k).capitalize() + ".")
            n -= k
        return " ".join(out)

    def attr(*names: str) -> str:
        name = pick(*names)
        return "" if not name else f' {pick("class", "id", "class")}="{pick("", "", "x-", "js-", "site-")}{name}"'

    def link_list(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{words(int(rng.integers(1, 4)))}</a></li>' for k in range(n)) + "</ul>"

    def clutter(kind: str) -> str:
        short, some = prose(int(rng.integers(3, 25))), int(rng.integers(3, 10))
        if kind == "nav":
            tag, a = pick(("nav", ""), ("nav", attr("menu", "")), ("div", attr("menu", "navbar", "breadcrumbs")), ("div", ""))
            return f"<{tag}{a}>{link_list(some)}</{tag}>"
        if kind == "header":
            return pick(f"<header{attr('', 'masthead')}><h1>{words(2)}</h1>{link_list(some) if chance(0.5) else ''}</header>", f"<div{attr('header', 'masthead', 'banner')}><p>{words(3)}</p></div>")
        if kind == "footer":
            body = f"&copy; {words(2)} &middot; {short}" if chance(0.7) else f"<p>{short}</p>{link_list(some)}"
            return pick(f"<footer{attr('', 'footer')}>{body}</footer>", f"<footer>{body}</footer>", f"<div{attr('footer', 'bottom', 'legal')}>{body}</div>")
        if kind == "ad":
            text = pick(short, f"<p>{short}</p>", f'<a href="/x">{words(4)}</a>')
            return pick(f'<div class="ad">{text}</div>', f"<div{attr('ad', 'ads', 'advert', 'sponsored', 'promo')}>{text}</div>", f"<aside{attr('ad', 'sponsor')}>{text}</aside>")
        if kind == "side":
            body = f"<h3>{words(2)}</h3>{link_list(some)}" if chance(0.6) else f"<h3>{words(2)}</h3><p>{prose(int(rng.integers(5, 60)))}</p>"
            return pick(f"<aside{attr('', 'sidebar')}>{body}</aside>", f"<div{attr('sidebar', 'related', 'widget', 'recommended')}>{body}</div>")
        if kind == "notice":
            return pick(f"<div{attr('notice', 'cookie', 'cookie-notice', 'alert', 'consent-popup')}><p>{short}</p>{pick('', '<button>ok</button>')}</div>", f"<p{attr('notice', 'alert')}>{short}</p>")
        if kind == "form":
            return f"<form{attr('', 'newsletter', 'search', 'subscribe', 'login')} action='/f'>{pick('', f'<p>{short}</p>', f'<h3>{words(3)}</h3>')}<label>{words(2)}</label><input name='q'><button>{words(1)}</button></form>"
        if kind == "share":
            return f"<div{attr('share', 'social', 'tags', 'byline')}>{link_list(int(rng.integers(2, 5)))}</div>"
        posts = "".join(pick(f"<div{attr('comment', 'reply', '')}><p>{prose(int(rng.integers(3, 70)))}</p></div>", f"<li{attr('comment', '')}><b>{words(1)}</b><p>{prose(int(rng.integers(3, 70)))}</p></li>") for _ in range(int(rng.integers(1, 7))))
        return pick(f"<section{attr('comments', 'discussion')}><h2>{words(1)}</h2>{posts}</section>", f"<div{attr('comments', 'comment-list', 'replies')}>{posts}</div>", f"<div{attr('comments')}><h3>{words(2)}</h3>{posts}</div>")

    def article() -> str:
        out = [f"<h1 data-truth>{words(int(rng.integers(1, 9)))}</h1>"] if chance(0.85) else []
        kind = pick("plain", "plain", "plain", "rich", "short", "long", "listing")
        n = {"short": int(rng.integers(1, 3)), "long": int(rng.integers(20, 60))}.get(kind, int(rng.integers(2, 16)))
        for _ in range(n):
            text = prose(int(rng.integers(1, 9 if kind == "short" else 120)))
            if chance(0.1):
                text = " ".join(w + pick("%%%", "###", "***", "&amp;&amp;&amp;", "!!") for w in text.split())
            if chance(0.15):
                text = text.replace(" ", f' <a href="/y">{words(2)}</a> ', 1)
            if chance(0.12):
                out.append(f"<p data-truth><b>{text}<br>")
            elif kind in ("rich", "listing") and chance(0.5):
                cells = "".join(f"<td data-truth>{words(2)}</td>" for _ in range(3))
                out.append(pick(
                    f"<h2 data-truth>{words(3)}</h2>", f"<h3 data-truth>{words(3)}</h3>", f"<blockquote><p data-truth>{text}</p></blockquote>", f"<pre data-truth>{text}</pre>", f"<figure><figcaption data-truth>{words(6)}</figcaption></figure>",
                    "<ul>" + "".join(f"<li data-truth>{words(int(rng.integers(1, 15)))}</li>" for _ in range(5)) + "</ul>", f"<table><tr>{cells}</tr><tr>{cells}</tr></table>", f"<div data-truth>{text}</div>",
                ))
            else:
                out.append(f"<p data-truth>{text}" + ("</p>" if chance(0.9) else ""))
            if chance(0.03):
                out.append(clutter(pick("ad", "form", "notice", "share", "side")))
        return "".join(out)

    inner = article()
    if chance(0.25):
        inner += clutter(pick("comments", "share", "form", "ad"))
    main = pick(
        f"<article>{inner}</article>", f"<article{attr('', 'post', 'entry')}>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>",
        f"<div{attr('content', 'post-content', 'entry-content', 'article-body', 'main', 'story', 'text')}>{inner}</div>", f"<section{attr('post', 'article', '')}>{inner}</section>", f"<div>{inner}</div>",
    )
    if chance(0.3):
        main = f"<div{attr('wrapper', 'container', 'row', 'page')}>{clutter('side') if chance(0.4) else ''}{main}{clutter('side') if chance(0.5) else ''}</div>"
    before = [clutter(k) for k, p in (("notice", 0.15), ("header", 0.3), ("nav", 0.8), ("ad", 0.5), ("form", 0.1), ("side", 0.1)) if chance(p)]
    after = [clutter(k) for k, p in (("comments", 0.3), ("side", 0.2), ("ad", 0.15), ("form", 0.15), ("nav", 0.15), ("notice", 0.05), ("footer", 0.85)) if chance(p)]
    return f"<!DOCTYPE html><html><head><title>{words(3)}</title><style>p{{margin:0}}</style></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"


TRAIN_PAGES, SEED = 900, 9


@lru_cache(1)
def trained() -> Trees:
    rng = np.random.default_rng(SEED)
    pages = [Page(make_page(rng)) for _ in range(TRAIN_PAGES)]
    # The root is always in, and isn't learnt.
    return Trees().fit(np.vstack([next(features(p))[1:] for p in pages]), np.concatenate([truth(p)[1:] for p in pages]).astype(float))


def main_text(pages: list[Page], trees: Trees) -> list[str]:
    """Kept blocks of each page, a line each."""
    out, held = [], []

    def judge() -> None:
        odds = trees.odds(np.vstack([row for _, row in held]))
        at = 0
        for page, row in held:
            say(page, odds[at : at + len(row)])
            at += len(row)
        held.clear()

    def say(page: Page, odds: np.ndarray) -> None:
        keep = decode(page.parent, odds.copy())
        out.append("\n".join(text for node, text, _, _ in page.runs if keep[node]))

    for page in pages:
        if len(page.tag) > NODES:
            # A page of very many nodes is judged by itself, some at a time.
            if held:
                judge()
            say(page, np.concatenate([trees.odds(x) for x in features(page, NODES)]))
            continue
        held += [(page, x) for x in features(page)]
        if sum(len(x) for _, x in held) > NODES:
            judge()
    if held:
        judge()
    return out


def _extract(trees: Trees):
    def run(batches):
        for batch in batches:
            names = [c for c in batch.schema.names if c != "_html"]
            for a, b, sources in chunks(batch.column("_html"), 1 << 19):
                texts = main_text([Page(s or "") for s in sources], trees)
                yield pa.RecordBatch.from_arrays([*batch.select(names).slice(a, b - a).columns, pa.array(texts, pa.string())], names=[*names, "_text"])

    return run


def extract(pages: DataFrame, html_col: str = "html", trees: Trees | None = None) -> DataFrame:
    """``pages`` with ``text`` (the main text, a block a line) and ``n_chars`` (its code points) for ``html``.

    Character references are decoded, white space inside a block becomes one space, blocks without
    text are left out. A null or empty page, or one without main text, has an empty text. Broken
    markup is read leniently, to the end of the page. Repeated rows get equal texts; an empty table
    gives no rows. Columns named ``text`` or ``n_chars`` are replaced by the new ones.
    """
    keep = [c for c in pages.columns if c.lower() not in {html_col.lower(), "text", "n_chars"}]
    own = pages.select(F.struct(*(F.col(f"`{c}`") for c in keep), F.lit(True).alias("_all")).alias("_row"), F.col(f"`{html_col}`").alias("_html"))
    out = own.mapInArrow(_extract(trees or trained()), StructType([own.schema["_row"], *StructType.fromDDL("_text string")]))
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in keep), F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
