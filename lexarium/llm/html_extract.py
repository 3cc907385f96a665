"""Main text of web pages: gradient-boosted trees over DOM nodes and hierarchical decoding.

A page becomes a tree of block elements whose leaves are runs of text. Each node has features: tag, attribute tokens of
its own and of its ancestors, depth, text and link density of its subtree, shares and sibling statistics. Boosted trees
give the probability that a node holds main text; the best labelling in which no node is kept below a dropped one is
found by dynamic programming over the tree. Kept runs of text are the result. The trees are trained here, on generated
pages of many layouts whose article is known (TRAINING_PAGES of them, from a fixed seed).
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

#: Generated pages that train the model.
TRAINING_PAGES = 700
#: Elements that flow inside a block; all others are blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture source input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; of the first ones it isn't even markup.
RAW = frozenset("script style noscript template iframe svg math object textarea title xmp noembed".split())
UNSEEN = frozenset("select button datalist head audio video canvas option optgroup".split())
#: Elements that a new one of their kind (or group) closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = frozenset("ul ol dl table".split())
#: Tokens of class, id and role that speak for and against main text.
GOOD = frozenset("article content main post entry story body text blog prose page single hentry news read reader".split())
BAD = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs footer foot header masthead topbar sidebar side aside widget widgets related recommend "
    "recommended more share sharing social comment comments reply replies respond discussion disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login form search pagination pager "
    "copyright legal tags meta byline toolbar skip hidden outbrain taboola trending popular contentinfo complementary tracking".split()
)
TAG_GROUPS = ("p", "h1 h2 h3 h4 h5 h6", "li", "ul ol dl", "div section", "article main", "nav menu", "header", "footer", "aside", "form fieldset legend", "table tbody tr td th thead tfoot", "figure figcaption", "blockquote pre address", "body html", "#text")
_GROUP = {t: i for i, g in enumerate(TAG_GROUPS) for t in g.split()}
_TAG = re.compile(r"<(?:!--(?:.*?-->|.*$)|([a-zA-Z][a-zA-Z0-9:-]*)|/([a-zA-Z][a-zA-Z0-9:-]*)[^>]*>|[!?/][^>]*>)", re.S)
#: A step through a tag's attributes: to a quoted value's opening quote (1), over an unquoted value, to the end (2) or over a stray sign.
_STEP = re.compile(r"[^<>\"'=]*+(?:=\s*+([\"'])|=\s*+[^\s<>\"'][^\s<>]*+|([<>])|[\"'=])")
_NAMED = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STOPS = re.compile(r"[.,;:!?]")
N_GROUPS = len(TAG_GROUPS)


class Tags:
    """The tags of a page in order. Quoted values have any length; where a quote is never closed, the tag ends at the next >."""

    def __init__(self, page: str):
        self.page = page
        self.unclosed: set[str] = set()  # quotes that don't occur in the rest of the page

    def _end(self, at: int) -> int:
        """Where the attributes that begin at `at` end, -1 if there is no end before the next <."""
        while m := _STEP.match(self.page, at):
            at = m.end()
            if m[2]:
                return at - 1 if m[2] == ">" else -1
            if quote := m[1]:
                close = -1 if quote in self.unclosed else self.page.find(quote, at)
                if close < 0:
                    self.unclosed.add(quote)
                    return self.page.find(">", at)
                at = close + 1
        return -1

    def after(self, at: int) -> tuple[int, int, str | None, str, str | None] | None:
        """(start, end, opened tag, its attributes, closed tag) of the next tag, comment or declaration."""
        while m := _TAG.search(self.page, at):
            if not m[1]:
                return m.start(), m.end(), None, "", m[2]
            end = self._end(m.end())
            if end >= 0:
                return m.start(), end + 1, m[1], self.page[m.end() : end], None
            at = m.end()
        return None


class Node:
    __slots__ = ("tag", "parent", "good", "bad", "text", "linked", "kids", "at", "depth", "size", "links", "tags", "stops", "gold", "hidden")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.kids, self.text, self.linked = tag, parent, [], "", 0
        self.good = self.bad = 0
        self.hidden = False
        if attributes:
            for m in _NAMED.finditer(attributes):
                tokens = {t.lower() for t in _TOKEN.findall(m[1] or m[2] or m[3] or "")}
                self.good += len(tokens & GOOD)
                self.bad += len(tokens & BAD)
            low = attributes.lower()
            self.hidden = "display:none" in low.replace(" ", "") or 'aria-hidden="true"' in low or bool(re.search(r"\shidden(\s|=|/|$)", low))
        self.at = len(parent.kids) if parent else 0
        self.depth = parent.depth + 1 if parent else 0


def parse(page: str) -> Node:
    """The tree of a page's blocks; tags may be missing, nested wrongly or cut off."""
    root = Node("html", None)
    stack: list[tuple[str, Node]] = [("html", root)]  # open elements with the block they belong to
    unseen = 0  # open elements whose text doesn't count
    opened: Counter = Counter()  # open elements by name: a stack is searched only for what it holds
    run: list[str] = []
    links = linked = 0
    at, n = 0, len(page)
    tags = Tags(page)

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                block = stack[-1][1]
                leaf = Node("#text", block)
                leaf.text, leaf.linked = text, min(linked, len(text))
                block.kids.append(leaf)
            run.clear()
        linked = 0

    def close(tags: set[str], fence: frozenset[str] = frozenset()) -> bool:
        """Closes the nearest open element among tags, and all inside it; not beyond an element of the fence."""
        nonlocal unseen, links
        if not any(opened[t] for t in tags):
            return False
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                flush()
                for name, _ in stack[i:]:
                    unseen -= name in UNSEEN
                    links -= name == "a"
                    opened[name] -= 1
                del stack[i:]
                return True
            if stack[i][0] in fence:
                return False
        return False

    while at < n:
        found = tags.after(at)
        if not found:
            tail = page[at:]
            cut = tail.rfind("<")  # a tag that the page's end cuts off is no text
            if cut >= 0 and re.match(r"</?[a-zA-Z!]|<$", tail[cut:]):
                tail = tail[:cut]
            if not unseen:
                run.append(tail)
            break
        start, stop_at, tag, attributes, end = found
        if start > at and not unseen:
            piece = page[at:start]
            run.append(piece)
            if links:
                linked += len(piece)
        at = stop_at
        if tag:
            tag = tag.lower()
            if tag in RAW:
                if not attributes.endswith("/"):
                    stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                    at = stop.end() if stop else n
                run.append(" ")
            elif tag in VOID:
                if tag in INLINE:
                    run.append(" " if tag == "br" else "")
                else:
                    flush()
            elif tag in INLINE:
                if tag == "a":
                    links += 1
                stack.append((tag, stack[-1][1]))
                opened[tag] += 1
            else:
                flush()
                if tag in UNSEEN:
                    unseen += 1
                else:
                    close({"p"}, FENCE | {"button", "div", "td", "section", "article"})
                    if tag in CLOSES:
                        close(CLOSES[tag], FENCE)
                    if tag not in {"body", "html"}:
                        close({"head"})
                block = Node(tag, stack[-1][1], attributes)
                block.parent.kids.append(block)
                stack.append((tag, block))
                opened[tag] += 1
        elif end:
            end = end.lower()
            if end in INLINE and opened[end]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == end:
                        del stack[i]
                        links -= end == "a"
                        opened[end] -= 1
                        break
                    if stack[i][0] not in INLINE:
                        break
            elif end not in VOID and end not in INLINE:
                flush()
                close({end}, frozenset() if end in {"body", "html", "table", "article", "main", "div", "section"} else FENCE)
    flush()
    return root


def nodes_of(root: Node) -> list[Node]:
    """The nodes in page order, with the sums of their subtrees."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.kids))
    for node in reversed(out):
        node.size, node.links, node.tags, node.stops = len(node.text), node.linked, node.tag != "#text", 0
        if node.text:
            node.stops = len(_STOPS.findall(node.text))
        for kid in node.kids:
            node.size += kid.size
            node.links += kid.links
            node.tags += kid.tags
            node.stops += kid.stops
    return out


def features(nodes: list[Node]) -> np.ndarray:
    """A row of features for each node in page order."""
    whole = max(1, nodes[0].size)
    log = math.log1p
    inherited: dict[int, tuple] = {}
    rows = []
    for node in nodes:
        group = _GROUP.get(node.tag, N_GROUPS)
        parent = node.parent
        if parent is None:
            above = (0, 0, 0, 0, N_GROUPS, 0)
            siblings, size, before, after, alike = 1, whole, 0, 0, 0.0
        else:
            g, b, inside, outside, _, hidden = inherited[id(parent)]
            pg = _GROUP.get(parent.tag, N_GROUPS)
            above = (min(3, g + parent.good), min(3, b + parent.bad), inside or pg == 5, outside or pg in (6, 7, 8, 9, 10), pg, hidden or parent.hidden)
            kids = parent.kids
            siblings, size = len(kids), max(1, parent.size)
            before, after = (kids[node.at - 1].size if node.at else 0), (kids[node.at + 1].size if node.at + 1 < siblings else 0)
            alike = (size - node.size) / max(1, siblings - 1)
        inherited[id(node)] = above
        n = max(1, node.size)
        rows.append((
            group, above[4], node.depth, node.good, node.bad, above[0], above[1], above[2], above[3], node.hidden or above[5],
            log(node.size), node.links / n, 100 * node.tags / n, 100 * node.stops / n, node.size / whole, node.size / size, len(node.kids),
            node.at, (node.at + 1) / siblings, siblings, log(before), log(after), log(alike), log(node.links), node.text[-1:] in ".!?…",
        ))
    return np.array(rows, np.float32)


class BoostedTrees:
    """Logistic gradient boosting on binned features; trees of fixed depth kept as arrays."""

    def __init__(self, trees: int = 60, depth: int = 5, rate: float = 0.2, bins: int = 48, ridge: float = 2.0):
        self.n, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        codes = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)]).astype(np.int64)
        n, width, bins, inner = len(y), x.shape[1], self.bins, 2**self.depth - 1
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.features, self.cuts, self.leaves = [], [], []
        margin = np.full(n, self.base)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p) + 1e-9
            feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32), np.zeros(n, np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                local = node - first
                best = np.full(count, 1e-6)
                for f in range(width):
                    at = local * bins + codes[:, f]
                    gs = np.bincount(at, g, count * bins).reshape(count, bins).cumsum(1)
                    hs = np.bincount(at, h, count * bins).reshape(count, bins).cumsum(1)
                    total_g, total_h = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (total_g - gs) ** 2 / (total_h - hs + self.ridge) - total_g**2 / (total_h + self.ridge)
                    gain[:, len(self.edges[f]) :] = 0
                    b = gain.argmax(1)
                    top = gain[np.arange(count), b]
                    for i in np.flatnonzero(top > best):
                        best[i], feature[first + i], cut[first + i] = top[i], f, self.edges[f][b[i]]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
            leaf = node - inner
            value = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.ridge)
            margin += value[leaf]
            self.features.append(feature)
            self.cuts.append(cut)
            self.leaves.append(value)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows, inner = np.full(len(x), self.base), np.arange(len(x)), 2**self.depth - 1
        for feature, cut, leaves in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaves[node - inner]
        return out


def decode(nodes: list[Node], margin: np.ndarray) -> list[bool]:
    """Which nodes to keep: the labelling of greatest likelihood in which all ancestors of a kept node are kept."""
    place = {id(node): i for i, node in enumerate(nodes)}
    p = np.clip(margin, -12, 12)
    keep, drop = (-np.logaddexp(0, -p)).tolist(), (-np.logaddexp(0, p)).tolist()  # log probabilities
    best_keep, best_drop = list(keep), list(drop)
    for i in range(len(nodes) - 1, 0, -1):
        up = place[id(nodes[i].parent)]
        best_keep[up] += max(best_keep[i], best_drop[i])
        best_drop[up] += best_drop[i]
    kept = [True] * len(nodes)
    for i in range(1, len(nodes)):
        kept[i] = kept[place[id(nodes[i].parent)]] and best_keep[i] > best_drop[i]
    return kept


# Generated pages for training. A mark at the start of a text says that it belongs to the article.
MARK = ""


class Generator:
    """Pages of many layouts with a known article."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        syllables = ["".join(self.r.choice(p) for p in ("bcdfghklmnprstvwz", "aeiouéä", "nrstl ")).strip() for _ in range(90)]
        self.vocabulary = ["".join(self.r.choice(syllables) for _ in range(self.r.randint(1, 4))) for _ in range(1500)]

    def words(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(self.vocabulary) for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.r.randint(low, high)):
            s = self.words(3, 18)
            if self.r.random() < 0.4:
                s = s.replace(" ", ", ", 1)
            out.append(s.capitalize() + self.r.choice(["."] * 6 + ["?", "!", ""]))
        text = " ".join(out)
        if self.r.random() < 0.25:
            text = " ".join(w + self.r.choice(["", "&amp;&amp;", "%%%", "***"]) for w in text.split(" "))
        return text

    def attributes(self, names: str, share: float = 0.8) -> str:
        if self.r.random() > share:
            return ""
        name = self.r.choice(names.split())
        return f' {self.r.choice(["class", "class", "id"])}="{name}{self.r.choice(["", "", "-1", " box", " col", "-wrap", "_inner"])}"'

    def links(self, low: int, high: int) -> str:
        n, r = self.r.randint(low, high), self.r
        items = [f'<a href="/{r.random()}">{self.words(1, 4)}</a>' for _ in range(n)]
        style = r.random()
        if style < 0.5:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return r.choice([" | ", " ", " &middot; "]).join(items) if style < 0.8 else "".join(f"<div>{i}</div>" for i in items)

    def inline(self, text: str) -> str:
        words = text.split(" ")
        for _ in range(self.r.randint(0, 2)):
            i = self.r.randrange(len(words))
            words[i] = self.r.choice(["<b>{}</b>", "<a href='/x'>{}</a>", "<em>{}</em>", "<b>{}", "{}<br>", "<span>{}</span>"]).format(words[i])
        return " ".join(words)

    def noise(self, kind: str) -> str:
        r, a = self.r, self.attributes
        if kind == "nav":
            return f"<nav{a('nav menu', 0.3)}>{self.links(3, 12)}</nav>" if r.random() < 0.6 else f"<div{a('nav menu navbar navigation topmenu breadcrumb', 0.9)}>{self.links(3, 12)}</div>"
        if kind == "header":
            inner = r.choice([f"<h1>{self.words(1, 3)}</h1>", f"<a href='/'>{self.words(1, 3)}</a>", f"<div>{self.words(1, 5)}</div>", f"<p>{self.words(2, 8)}</p>"]) + (self.links(2, 6) if r.random() < 0.5 else "")
            return f"<header{a('header site-header', 0.4)}>{inner}</header>" if r.random() < 0.6 else f"<div{a('header masthead topbar', 0.95)}>{inner}</div>"
        if kind == "footer":
            inner = f"&copy; {self.words(1, 2)} &middot; {self.sentences(1, 2)}" if r.random() < 0.6 else f"<p>{self.sentences(1, 2)}</p>{self.links(2, 5)}"
            return f"<footer{a('footer', 0.3)}>{inner}</footer>" if r.random() < 0.65 else f"<div{a('footer copyright legal', 0.95)}>{inner}</div>"
        if kind == "aside":
            inner = f"<h{r.randint(2, 4)}>{self.words(1, 4)}</h2>" + r.choice([self.links(3, 8), f"<p>{self.sentences(1, 3)}</p>"])
            return f"<aside{a('sidebar related', 0.5)}>{inner}</aside>" if r.random() < 0.5 else f"<div{a('sidebar widget related more-stories trending side popular', 0.95)}>{inner}</div>"
        if kind == "ad":
            inner = r.choice([self.sentences(1, 2), f"<p>{self.sentences(1, 3)}</p>", f"<a href='/buy'>{self.words(2, 8)}</a>"])
            return f"<{(t := r.choice(['div', 'div', 'section', 'aside']))}{a('ad ads advert sponsor promo banner advertisement sponsored', 0.97)}>{inner}</{t}>"
        if kind == "notice":
            inner = r.choice([self.sentences(1, 3), f"<p>{self.sentences(1, 3)}</p><button>{self.words(1, 2)}</button>"])
            return f"<div{a('cookie notice consent alert popup modal cookie-banner newsletter gdpr', 0.97)}>{inner}</div>"
        if kind == "form":
            inner = f"<label>{self.words(1, 3)}</label><input type=text><button>{self.words(1, 2)}</button>"
            return f"<form{a('search login newsletter subscribe', 0.5)}>{r.choice(['', f'<p>{self.sentences(1, 2)}</p>', f'<h3>{self.words(1, 4)}</h3>'])}{inner}</form>"
        if kind == "share":
            return f"<div{a('share social tags meta byline', 0.97)}>{r.choice([self.links(2, 5), self.words(2, 6)])}</div>"
        t = r.choice(["div", "li", "article", "p"])
        items = "".join(f"<{t}{a('comment reply comment-body', 0.6)}>{r.choice(['', f'<b>{self.words(1, 2)}</b> '])}{r.choice(['{}', '<p>{}</p>']).format(self.sentences(1, 5)) if t != 'p' else self.sentences(1, 5)}</{t}>" for _ in range(r.randint(1, 8)))
        return f"<{(w := r.choice(['section', 'div', 'div', 'ul', 'ol']))}{a('comments comment-list discussion replies respond', 0.97)}>{r.choice(['', f'<h3>{self.words(1, 3)}</h3>'])}{items}</{w}>"

    def article(self) -> str:
        r, parts = self.r, []
        if r.random() < 0.75:
            title = f"<h1>{MARK}{self.words(1, 12)}{r.choice(['', '', '.', '&amp;'])}</h1>"
            parts.append(r.choice([title] * 5 + [f"<header>{title}</header>", f"<div class='title'>{title}</div>"]))
        loose = r.random() < 0.12
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 8, 12, 20, 30])):
            x = r.random()
            if x < 0.82:
                text = MARK + self.inline(self.sentences(1, r.choice([1, 2, 5, 9])))
                parts.append(f"{text}<br><br>" if loose else r.choice(["<p>{}</p>"] * 8 + ["<p>{}", "<p><b>{}<br>", "<div>{}</div>", "<p class='text'>{}</p>"]).format(text))
            elif x < 0.87:
                parts.append(f"<h{(k := r.randint(2, 4))}>{MARK}{self.words(1, 7)}</h{k}>")
            elif x < 0.91:
                parts.append(r.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(f"<li>{MARK}{self.sentences(1, 2)}</li>" for _ in range(r.randint(2, 6)))))
            elif x < 0.93:
                parts.append(f"<blockquote><p>{MARK}{self.sentences(1, 3)}</p></blockquote>")
            elif x < 0.95:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{MARK}{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>")
            else:
                parts.append(self.noise(r.choice(["ad", "ad", "share", "aside", "notice", "form"])))
        body = "".join(parts)
        for _ in range(r.choice([0, 0, 1, 2])):
            body = f"<div{self.attributes('text body inner wrap prose', 0.5)}>{body}</div>"
        return r.choice([
            f"<article{self.attributes('post article hentry', 0.3)}>{body}</article>", f"<article>{body}</article>", f"<main>{body}</main>", f"<main><article>{body}</article></main>", f"<section{self.attributes('content story')}>{body}</section>",
            f"<div{self.attributes('content article post-body entry-content main story article-body post', 0.95)}>{body}</div>", f"<div>{body}</div>", f"<div role='main'>{body}</div>",
        ])

    def page(self) -> str:
        r = self.r
        if r.random() < 0.04:  # a bare text
            return r.choice(["<html><body>{}</body></html>", "{}"]).format("".join(r.choice(["<p>{}</p>", "<p>{}"]).format(MARK + self.inline(self.sentences(1, 6))) for _ in range(r.randint(1, 5))) if r.random() < 0.7 else MARK + self.sentences(1, 6))
        before = [self.noise(k) for k, p in (("notice", 0.2), ("header", 0.5), ("nav", 0.8), ("ad", 0.5), ("form", 0.15)) if r.random() < p]
        after = [self.noise(k) for k, p in (("share", 0.2), ("aside", 0.4), ("comments", 0.4), ("form", 0.2), ("ad", 0.25), ("nav", 0.1), ("footer", 0.85), ("notice", 0.15)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(before)
        middle = self.article() if r.random() < 0.97 else ""
        if r.random() < 0.3:
            k = r.randint(0, len(after))
            middle, after = f"<div{self.attributes('wrapper container page layout', 0.7)}>{middle}{''.join(after[:k])}</div>", after[k:]
        out = f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{''.join(before)}<!-- x -->{middle}{''.join(after)}</body></html>"
        return out[: r.randint(len(out) // 2, len(out))] if r.random() < 0.06 else out


def gold(node: Node) -> bool:
    """Whether the subtree holds marked text; takes the marks away."""
    node.gold = node.text.startswith(MARK) or MARK in node.text
    if node.gold:
        node.text = node.text.replace(MARK, "")
    for kid in node.kids:
        node.gold |= gold(kid)
    return node.gold


def trained_model(pages: int = TRAINING_PAGES, seed: int = 11) -> BoostedTrees:
    generator, xs, ys = Generator(seed), [], []
    for _ in range(pages):
        root = parse(generator.page())
        gold(root)
        nodes = nodes_of(root)
        xs.append(features(nodes))
        ys.append(np.array([n.gold for n in nodes], float))
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys))


def extract_many(pages: list[str | None], model: BoostedTrees) -> list[str]:
    """The main text of each page."""
    trees = [nodes_of(parse(p or "")) for p in pages]
    margins = model.margin(np.concatenate([features(t) for t in trees])) if trees else np.zeros(0)
    out, at = [], 0
    for nodes in trees:
        kept = decode(nodes, margins[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n".join([n.text for n, k in zip(nodes, kept, strict=True) if k and n.text]))
    return out


def extract_text(pages: DataFrame, model: BoostedTrees | None = None, html_column: str = "html") -> DataFrame:
    """pages without the html column, with text and n_chars (long: code points); columns of these names are replaced.

    White space inside a block becomes one space; kept blocks are joined by line feeds in page order. Null and empty
    pages and pages without main text give the empty string. Repeated rows repeat; an empty table gives no rows.
    """
    names = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]
    schema = pages.select(*[f"`{n}`" for n in names]).schema.add("text", "string").add("n_chars", "long")
    shared = pages.sparkSession.sparkContext.broadcast(model or trained_model())

    def extract(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = extract_many(part.column(len(names)).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return pages.select(*[f"`{n}`" for n in names], f"`{html_column}`").mapInArrow(extract, schema)
