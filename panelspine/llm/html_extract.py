"""Main text of HTML pages by boosted trees over DOM nodes.

A page is parsed into nodes with their text runs, in time linear in its length.
Every node is described by its depth and place, the text, link, tag and
punctuation density of its subtree, its parent and its siblings, and by hashed
tokens: tag and attribute words of the node, and those of all nodes above it.
Gradient-boosted trees score each block, whose links, bold words and spans flow
with it: a block takes all of its own running text or none. The scores are
decoded from the root down: a subtree takes either one choice as a whole or its
children's, whichever scores better, and a node under a dropped one is dropped.
Where no block of a page wins, all that is no menu, notice, form or the like
stays.

The trees learn from pages whose structure tells the answer (``teacher``): what
stands in an article or main element outside its navigation, notices, adverts,
forms and comments. Pages of our own making add shapes that a sample may lack:
text without any markup, short articles, captions, tables. No feature tells how
the teacher decides, and each page is learned from three times: as it is, with article and main elements and the words
that name them hidden, and with all sectioning tags and attribute words hidden.
So the trees also judge pages that have no such elements, by what remains.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: HTML element groups, and words in attributes that tell of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style template noscript head title iframe object svg math textarea xmp noembed noframes select datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body caption dd dt html legend li summary tbody td tfoot th thead tr".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPE = frozenset("table ul ol dl body html article section div main aside nav header footer td th".split())
BAD_TAGS = frozenset("nav aside footer header form button menu dialog fieldset label input".split())
BAD_WORDS = frozenset(
    "ad ads advert advertisement advertising banner sponsor sponsored promo promoted nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent notice gdpr popup modal overlay alert newsletter subscribe signup login share sharing social related recommended comment comments disqus reply replies respond form search widget widgets pagination pager toolbar tags rail copyright skip".split()
)
GOOD_WORDS = frozenset("article content main body post entry story text blog page hentry prose".split())
#: Tags that name the role of a part of a page.
SECTIONS = frozenset("article main nav aside footer header form section menu dialog fieldset figure button label input".split())
#: Elements with a choice of their own although they stand in a line.
OWN_CHOICE = frozenset("button label input #root".split())

MARKUP = re.compile(r"<(?=[a-zA-Z/!?])")
#: Possessive, so that no text makes it look twice at a character.
TAG = re.compile(r"<(/?+)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
TOKEN = re.compile(r"[a-z]+")
#: Hashed tokens of a node, and of the nodes above it.
BUCKETS = 128
NUMBERS = 26


class Node:
    __slots__ = ("tag", "words", "parent", "depth", "parts", "n_own", "unit", "n_flow", "n_text", "n_link", "n_nodes", "n_p", "n_marks", "index", "end")

    def __init__(self, tag: str, words: frozenset, parent: Node | None):
        self.tag, self.words, self.parent = tag, words, parent
        self.depth = parent.depth + 1 if parent else 0
        self.parts: list = []  # strings and nodes in order
        self.n_own = self.n_text = self.n_link = self.n_p = self.n_marks = 0
        self.n_nodes = 1
        self.index = self.end = self.unit = self.n_flow = 0


def _words(attributes: str) -> frozenset:
    if "=" not in attributes:
        return frozenset(["hidden"]) if "hidden" in attributes.lower().split() else frozenset()
    out = []
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop"):
            out += TOKEN.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", a or b or c).lower())
        elif name == "hidden" or name == "style" and "display:none" in (a or b or c).replace(" ", "").lower():
            out.append("hidden")
    return frozenset(out)


class _Open:
    """The open elements, with the places of each tag and of scoping tags among them."""

    def __init__(self, root: Node):
        self.path, self.places, self.scopes = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.path))
        if node.tag in SCOPE:
            self.scopes.append(len(self.path))
        self.path.append(node)

    def last(self, tags) -> int:
        """The place of the innermost open element of these tags; 0 if none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, place: int) -> None:
        """Closes that element and all in it."""
        while len(self.path) > place:
            node = self.path.pop()
            self.places[node.tag].pop()
            if node.tag in SCOPE:
                self.scopes.pop()


def parse(page: str) -> list[Node]:
    """All nodes in page order; the first is a root. Never fails: stray end
    tags are passed over, open elements end with their parents, a tag or
    comment without an end takes the rest of the page."""
    root = Node("#root", frozenset(), None)
    nodes, open_, at, n = [root], _Open(root), 0, len(page)
    while at < n:
        m = MARKUP.search(page, at)
        start = m.start() if m else n
        if start > at:
            open_.path[-1].parts.append(html_lib.unescape(page[at:start]))
        if not m:
            break
        m = TAG.match(page, start)
        if not m:
            if page.startswith("<!--", start):
                at = page.find("-->", start + 4) + 3
                at = n if at < start + 4 else at
            else:
                at = page.find(">", start) + 1 or n
            continue
        at = m.end()
        tag = m.group(2).lower()
        if m.group(1):
            place = open_.last((tag,))
            if place and (tag in BLOCKS or open_.scopes[-1] <= place):
                open_.cut(place)
            continue
        if tag in CLOSES_P:
            place = open_.last(("p",))
            if place > open_.scopes[-1]:
                open_.cut(place)
        if tag in CLOSED_BY:
            place = open_.last(CLOSED_BY[tag])
            if place > (open_.scopes[-1] if tag == "p" else open_.last(("table", "ul", "ol", "dl"))):
                open_.cut(place)
        node = Node(tag, _words(m.group(3)), open_.path[-1])
        node.parent.parts.append(node)
        nodes.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            if end:
                if tag not in HIDDEN:
                    node.parts.append(page[at : end.start()])
                at = page.find(">", end.start()) + 1 or n
            else:
                at = n
        elif tag not in VOID and not m.group(3).endswith("/"):
            open_.push(node)
    _measure(nodes)
    return nodes


def _measure(nodes: list[Node]) -> None:
    for i, x in enumerate(nodes):
        x.index = i
        alone = x.tag in BLOCKS or x.tag in HIDDEN or x.tag in OWN_CHOICE or "hidden" in x.words
        x.unit = i if alone else x.parent.unit
    for x in reversed(nodes):
        if x.tag not in HIDDEN:
            for p in x.parts:
                if isinstance(p, str):
                    x.n_own += len(p.strip())
                    x.n_marks += p.count(".") + p.count(",")
        nodes[x.unit].n_flow += x.n_own
        x.n_text += x.n_own
        if x.tag == "a":
            x.n_link = x.n_text
        x.n_p += x.tag == "p"
        x.end = max([x.index + 1, *(p.end for p in x.parts if isinstance(p, Node))])
        p = x.parent
        if p and x.tag not in HIDDEN:
            p.n_text += x.n_text
            p.n_link += x.n_link
            p.n_nodes += x.n_nodes
            p.n_p += x.n_p
            p.n_marks += x.n_marks


_BUCKET: dict[str, int] = {}


def _bucket(token: str) -> int:
    k = _BUCKET.get(token)
    if k is None:
        if len(_BUCKET) > 100_000:
            _BUCKET.clear()
        k = _BUCKET[token] = zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS
    return k


def features(nodes: list[Node], hide: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and tokens (as 0 and 1), one row per node. hide 1: article and main elements count as div and the
    words of GOOD_WORDS are not seen; hide 2: all of SECTIONS count as div and
    no attribute word is seen."""
    n = len(nodes)
    out, tokens = np.zeros((n, NUMBERS), np.float32), np.zeros((n, 2 * BUCKETS), np.uint8)
    total, marks = max(1, nodes[0].n_text), max(1, nodes[0].n_marks)
    around: dict[int, tuple] = {}  # by parent: number of children, their tags, longest text, places
    for i, x in enumerate(nodes):
        children = [p for p in x.parts if isinstance(p, Node)]
        if children:
            tags: dict[str, int] = {}
            for c in children:
                tags[c.tag] = tags.get(c.tag, 0) + 1
            longest = max(c.n_text for c in children)
            for k, c in enumerate(children):
                around[c.index] = (len(children), tags[c.tag], longest, k, children[k - 1].n_text if k else 0, children[k + 1].n_text if k + 1 < len(children) else 0)
        p = x.parent or x
        count, same, longest, k, before, after = around.pop(i, (1, 1, x.n_text, 0, 0, 0))
        out[i] = (
            x.depth,
            x.n_flow,
            x.n_text,
            x.n_text / total,
            x.n_link / max(1, x.n_text),
            x.n_text / x.n_nodes,
            x.n_nodes,
            x.n_p,
            x.n_marks / max(1, x.n_text),
            x.n_marks / marks,
            count,
            same / count,
            longest / total,
            x.n_text / max(1, longest),
            k / count,
            before,
            after,
            x.n_text / max(1, p.n_text),
            p.n_text / total,
            p.n_link / max(1, p.n_text),
            p.n_p,
            p.n_marks / max(1, p.n_text),
            p.n_nodes,
            i / n,
            x.end / n,
            x.tag in HIDDEN,
        )
        tag = "div" if x.tag in (SECTIONS if hide == 2 else ("article", "main") if hide else ()) else x.tag
        words = () if hide == 2 else x.words - GOOD_WORDS if hide else x.words
        row = tokens[i]
        if x.parent:
            above = tokens[p.index]
            np.maximum(above[:BUCKETS], above[BUCKETS:], out=row[BUCKETS:])
        row[_bucket("<" + tag)] = 1
        for w in words:
            row[_bucket(w)] = 1
    return out, tokens


def barred(nodes: list[Node]) -> np.ndarray:
    """Nodes in menus, notices, adverts, forms, comments and the like by their
    tag or words; a header in an article or main element is a part of it."""
    out = np.zeros(len(nodes), bool)
    within = np.zeros(len(nodes), bool)
    for i, x in enumerate(nodes):
        p = x.parent
        within[i] = x.tag in ("article", "main") or (p is not None and within[p.index])
        bad = x.tag in BAD_TAGS and not (x.tag == "header" and within[i]) or x.words & BAD_WORDS and not x.words & GOOD_WORDS
        out[i] = (p is not None and out[p.index]) or x.tag in HIDDEN or "hidden" in x.words or bool(bad)
    return out


def teacher(nodes: list[Node], whole: bool = False) -> np.ndarray | None:
    """1 for nodes of the main text, 0 for others; None if the page does not
    tell. whole: all that is not barred is main text."""
    inside = np.zeros(len(nodes), np.int8)
    dropped = barred(nodes)
    told = whole
    for i, x in enumerate(nodes):
        p = x.parent
        start = whole or x.tag in ("article", "main") or "main" in x.words
        told |= start and not dropped[i]
        inside[i] = not dropped[i] and (start or (p is not None and inside[p.index]))
    return inside if told else None


# --------------------------------------------------------------------------
# boosted trees


class Trees:
    """Logistic gradient boosting with histogram splits and leaf-wise Newton steps."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, least: float = 0.25, penalty: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.penalty = rounds, depth, rate, bins, least, penalty
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        self.base = float(np.log(share / (1 - share)))
        places = np.linspace(0, 1, self.bins + 1)[1:-1]
        varied = [f for f in range(x.shape[1]) if len(x) and x[:, f].min() < x[:, f].max()]
        edges = [np.unique(np.quantile(x[:, f], places)) if x[:, f].max() > 1 or len(np.unique(x[:, f])) > 2 else np.zeros(1) for f in varied]
        self.columns = [(f, e, np.searchsorted(e, x[:, f], "left").astype(np.uint8)) for f, e in zip(varied, edges, strict=True)]
        z = np.full(len(y), self.base)
        for _ in range(self.rounds if 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-z))
            tree: list = []
            z += self._grow(tree, p - y, p * (1 - p), np.arange(len(y)), self.depth, np.zeros(len(y)))
            self.trees.append(tuple(np.array(c) for c in zip(*tree, strict=True)))
        del self.columns
        return self

    def _grow(self, tree: list, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, step: np.ndarray) -> np.ndarray:
        at = len(tree)
        tree.append(None)
        own_g, own_h = g[rows], h[rows]
        G, H = own_g.sum(), own_h.sum()
        best = (1e-6, None, 0)
        if depth:
            for column in self.columns:
                bins = column[2][rows]
                gl = np.cumsum(np.bincount(bins, own_g, len(column[1]) + 1))[:-1]
                hl = np.cumsum(np.bincount(bins, own_h, len(column[1]) + 1))[:-1]
                gain = gl**2 / (hl + self.penalty) + (G - gl) ** 2 / (H - hl + self.penalty) - G**2 / (H + self.penalty)
                gain[(hl < self.least) | (H - hl < self.least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], column, k)
        if best[1] is None:
            value = -self.rate * G / (H + self.penalty)
            step[rows] = value
            tree[at] = (-1, 0.0, 0, 0, value)
            return step
        _, (f, edges, column), k = best
        left = column[rows] <= k
        a = len(tree)
        self._grow(tree, g, h, rows[left], depth - 1, step)
        c = len(tree)
        self._grow(tree, g, h, rows[~left], depth - 1, step)
        tree[at] = (f, float(edges[k]), a, c, 0.0)
        return step

    def log_odds(self, numbers: np.ndarray, tokens: np.ndarray, rows: int = 50_000) -> np.ndarray:
        """For every row; some are widened to numbers at a time, to bound memory."""
        z = np.full(len(numbers), self.base)
        for a in range(0, len(z), rows):
            x = np.concatenate([numbers[a : a + rows], tokens[a : a + rows].astype(np.float32)], axis=1)
            each = np.arange(len(x))
            for feature, edge, left, right, value in self.trees:
                at = np.zeros(len(x), np.int64)
                for _ in range(self.depth):
                    f = feature[at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    go = x[each, np.maximum(f, 0)] <= edge[at]
                    at = np.where(inner, np.where(go, left[at], right[at]), at)
                z[a : a + rows] += value[at]
        return z


# --------------------------------------------------------------------------
# decoding


def by_block(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Every node's odds are those of the block in whose text it flows; where
    none with text is above zero, all that is not barred is kept."""
    odds = np.asarray(odds, float)[[x.unit for x in nodes]]
    worded = np.array([x.n_flow > 0 and x.tag not in HIDDEN for x in nodes])
    if worded.any() and odds[worded].max() <= 0:
        able = worded & ~barred(nodes)
        if able.any():
            odds = np.where(able, 1.0, -1.0)
    return odds


def choose(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept. A node's own text has weight by its length, and one
    without text of its own has no say; from the leaves up, a subtree's value is
    the better of dropping it whole and of keeping its root with the best choice
    for each child; so no kept node has a dropped ancestor."""
    value = np.zeros(len(nodes))
    for i in range(len(nodes) - 1, -1, -1):
        x = nodes[i]
        own = sum(len(p.strip()) for p in x.parts if isinstance(p, str))
        inner = sum(max(0.0, value[p.index]) for p in x.parts if isinstance(p, Node))
        value[i] = -1e9 if x.tag in HIDDEN else odds[i] * own + inner
    keep = np.zeros(len(nodes), bool)
    for i, x in enumerate(nodes):
        keep[i] = (x.parent is None or keep[x.parent.index]) and (value[i] > 0 or x.parent is None)
    return keep


def text_of(nodes: list[Node], keep: np.ndarray, odds: np.ndarray) -> str:
    """Text of kept nodes: blocks in page order, white space in a block as one space.

    A kept container whose own score is against it passes its children's text on
    but not its own runs.
    """
    blocks: list[str] = []
    run: list[str] = []

    def close() -> None:
        line = " ".join("".join(run).split())
        if line:
            blocks.append(line)
        run.clear()

    stack: list = [(nodes[0], 0)]
    while stack:
        x, k = stack.pop()
        if k == 0 and (x.tag in BLOCKS):
            close()
        done = True
        for k in range(k, len(x.parts)):  # noqa: B020
            p = x.parts[k]
            if isinstance(p, str):
                if odds[x.index] > 0:
                    run.append(p)
            elif p.tag == "br":
                close()
            elif keep[p.index]:
                stack += [(x, k + 1), (p, 0)]
                done = False
                break
            elif p.tag in BLOCKS:
                close()
        if done and x.tag in BLOCKS:
            close()
    close()
    return "\n".join(blocks)


def extract(pages: list[str], trees: Trees) -> list[str]:
    """Main texts; the nodes of all pages are scored at once."""
    parsed = [parse(p) for p in pages]
    if not parsed:
        return []
    numbers, tokens = zip(*(features(x) for x in parsed), strict=True)
    odds = np.split(trees.log_odds(np.concatenate(numbers), np.concatenate(tokens)), np.cumsum([len(x) for x in parsed])[:-1])
    odds = [by_block(x, z) for x, z in zip(parsed, odds, strict=True)]
    return [text_of(x, choose(x, z), z) for x, z in zip(parsed, odds, strict=True)]


def lessons(page: str, nodes_of_page: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
    """Features and labels of at most nodes_of_page blocks with text of a page,
    drawn at random by the page's checksum, in all three ways of hiding; None if
    the teacher does not understand the page."""
    nodes = parse(page)
    y = teacher(nodes, whole)
    blocks = np.array([x.index for x in nodes if x.unit == x.index and x.n_flow and x.tag not in HIDDEN], np.int64)
    if y is None or not len(blocks):
        return None
    rng = np.random.default_rng(zlib.crc32(page.encode("utf-8", "surrogatepass")))
    some = np.sort(rng.choice(blocks, min(len(blocks), nodes_of_page), replace=False))
    return np.concatenate([np.concatenate([c[some] for c in features(nodes, hide)], axis=1) for hide in (0, 1, 2)]), np.tile(y[some], 3)


def examples(number: int = 40, seed: int = 11) -> list[str]:
    """Pages of our own making, by a rule, with kinds of parts that a sample may lack."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("aeioulnrst"), int(rng.integers(2, 9))))

    def words(least: int, most: int) -> str:
        return " ".join(word() for _ in range(int(rng.integers(least, most))))

    def text(least: int, most: int) -> str:
        return " ".join(words(4, 14).capitalize() + "," + " " + words(2, 9) + "." for _ in range(int(rng.integers(least, most))))

    def links(n: int) -> str:
        return "<ul>" + "".join(f"<li><a href='/{word()}'>{words(1, 4)}</a></li>" for _ in range(n)) + "</ul>"

    out = []
    for _ in range(number):
        paragraphs = "".join(f"<p>{text(1, 6)} <a href='/x'>{word()}</a> <b>{words(1, 3)}</b></p>" for _ in range(int(rng.integers(2, 9))))
        inner = [paragraphs, f"<h2>{words(2, 6)}</h2><p>{text(1, 4)}</p>", f"<ul><li>{words(3, 9)}</li><li>{words(3, 9)}</li></ul>", f"<blockquote><p>{text(1, 3)}</p></blockquote>", f"<table><tr><th>{word()}</th><td>{words(1, 4)}</td></tr></table>"]
        noise = [f"<div class='ad banner'>{text(1, 2)}</div>", f"<aside class='related'>{links(3)}</aside>", f"<div class='share social'><a href='/s'>{word()}</a></div>", f"<form class='newsletter signup'><label>{words(2, 6)}</label><input><button>{word()}</button></form>"]
        body = inner[0] + "".join(x for x in inner[1:] if rng.random() < 0.4)
        body = "".join(x for x in noise[:2] if rng.random() < 0.3) + f"<h1>{words(3, 9)}</h1>" + body + "".join(x for x in noise if rng.random() < 0.3)
        tag = ["article", "main", "article"][int(rng.integers(3))]
        main = f"<{tag} class='{['post', 'content', 'story entry'][int(rng.integers(3))]}'>{body}</{tag}>"
        before = [f"<header class='masthead'><p>{words(1, 5)}</p></header>", f"<nav class='menu'>{links(5)}</nav>", f"<div class='cookie notice consent'><p>{text(1, 3)}</p><button>{word()}</button></div>", f"<div class='breadcrumb'><a href='/'>{word()}</a> / <a href='/b'>{word()}</a></div>", f"<div class='ad'>{text(1, 3)}</div>", f"<form class='search'><input><button>{word()}</button></form>"]
        after = [f"<section class='comments' id='comments'><h2>{words(1, 3)}</h2>" + "".join(f"<div class='comment'><p>{text(1, 3)}</p></div>" for _ in range(int(rng.integers(1, 5)))) + "</section>", f"<aside class='sidebar'><div class='widget'><h3>{words(1, 3)}</h3>{links(4)}</div><p>{text(1, 2)}</p></aside>", f"<div class='pagination'>{links(2)}</div>", f"<div class='sponsored promo'><p>{text(1, 2)}</p></div>", f"<footer><p>&copy; {words(2, 6)} <a href='/t'>{word()}</a></p></footer>"]
        out.append("<html><head><title>t</title><script>x</script></head><body>" + "".join(x for x in before if rng.random() < 0.6) + main + "".join(x for x in after if rng.random() < 0.6) + "</body></html>")
    return out


def plain_examples(number: int = 160, seed: int = 12) -> list[str]:
    """Pages of our own making that are main text but for menus, adverts, notices
    and footers: without markup, without an article element, with text beside
    elements, captions, tables, code, short or full of links."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("aeioulnrst"), int(rng.integers(2, 9))))
    link = lambda: f"<a href='/{word()}'>{' '.join(word() for _ in range(int(rng.integers(1, 7))))}</a>"

    def sentences(most: int, links: float = 0.0) -> str:
        out = []
        for _ in range(int(rng.integers(1, most + 1))):
            words = [link() if rng.random() < links else word() for _ in range(int(rng.integers(3, 14)))]
            out.append(" ".join(words).capitalize() + ".")
        return " ".join(out)

    kinds = [
        lambda: f"<p>{sentences(4)}</p>",
        lambda: f"<p>{sentences(4, 0.25)}</p>",
        lambda: f"<p>{sentences(2, 0.6)}</p>",
        lambda: f"{sentences(3)}<br><br>{sentences(3)}<br>",
        lambda: f"{sentences(3, 0.2)} <b>{word()}</b> <span>{sentences(1)}</span>",
        lambda: f"<h2>{word()} {word()}</h2>",
        lambda: f"<figure><img src=x><figcaption>{sentences(2)}</figcaption></figure>",
        lambda: f"<pre>{word()} = {word()}({word()})\n{word()}</pre>",
        lambda: "<table>" + "".join(f"<tr><td>{word()}<td>{word()}" for _ in range(int(rng.integers(1, 5)))) + "</table>",
        lambda: f"<ul><li>{sentences(1)}<li>{word()} {word()}<li>{sentences(1, 0.4)}</ul>",
        lambda: f"<blockquote>{sentences(2)}</blockquote>",
        lambda: f"<dl><dt>{word()}<dd>{sentences(1)}</dl>",
        lambda: f"<div>{sentences(3)}</div><div>{sentences(2)}</div>",
    ]
    menu = lambda: f"<nav><ul>{''.join(f'<li>{link()}' for _ in range(int(rng.integers(2, 7))))}</ul></nav>"
    bare_menu = lambda: f"<nav>{' '.join(link() for _ in range(int(rng.integers(1, 7))))}</nav>"
    form = lambda: f"<form><label>{word()}</label><input><button>{word()}</button> {word()}</form>"
    noise = [menu, bare_menu, form, lambda: f"<div class='ad'>{sentences(2)}</div>", lambda: f"<div class='cookie notice'><p>{sentences(2)}</p></div>", lambda: f"<div class='sidebar'><h3>{word()}</h3><ul><li>{link()}<li>{link()}</ul></div>"]
    foot = [form, lambda: f"<footer>&copy; {int(rng.integers(1990, 2030))} {word()} {word()}</footer>", lambda: f"<footer>{sentences(1)}</footer>", lambda: f"<section class='comments'><div class='comment'>{sentences(2)}</div></section>", lambda: f"<footer><p>&copy; {word()} {link()}</p></footer>", lambda: f"<div class='comments'><p>{sentences(2)}</p><p>{sentences(2)}</p></div>", lambda: f"<div class='footer'>{link()} | {link()}</div>"]
    out = []
    for k in range(number):
        some = [kinds[int(rng.integers(len(kinds)))]() for _ in range(int(rng.integers(1, 6)))]
        some += [form()] if rng.random() < 0.2 else []
        some += [f"<div class='ad'>{sentences(1)}</div>"] if rng.random() < 0.2 else []
        if k % 4 == 0:
            some = [[sentences(3), f"<p>{sentences(2)}</p>", f"<div>{sentences(2)}</div>", f"{sentences(2)}<br>{sentences(2)}"][k // 4 % 4]]
        main = "".join(some)
        wrap = ["{}", "<div>{}</div>", "<article>{}</article>", "<main>{}</main>", "<div class='story'>{}</div>", "<article><header><h1>Ae ou</h1></header>{}</article>"][int(rng.integers(6))].format(main)
        if rng.random() < 0.6:
            wrap = "".join(f() for f in noise if rng.random() < 0.4) + wrap + "".join(f() for f in foot if rng.random() < 0.5)
        out.append(wrap if rng.random() < 0.4 else f"<html><head><title>t</title></head><body>{wrap}</body></html>")
    return out


def fit(taught: list[tuple[np.ndarray, np.ndarray]]) -> Trees:
    """Trees from the lessons of pages and those of examples."""
    taught = [*taught, *(lessons(p, 30) for p in examples()), *(lessons(p, 30, whole=True) for p in plain_examples())]
    return Trees().fit(np.concatenate([x for x, _ in taught]), np.concatenate([y for _, y in taught]))


def train(pages: list[str], nodes_of_page: int = 30) -> Trees:
    return fit([x for x in (lessons(p, nodes_of_page) for p in pages) if x is not None])


def extract_main(pages: DataFrame, *, sample_pages: int = 300, nodes_of_page: int = 30) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    The trees learn from at most nodes_of_page blocks of each of at most
    sample_pages pages (documented bounds), those of least id hash; of rows of
    one id the least html counts. Their features are made where the rows are, so
    the driver gets numbers only. A null or empty page has an empty text;
    repeated rows are each returned; pages of any length are read whole; no
    rows: no rows. Other columns are not read.
    """
    spark = pages.sparkSession
    named = pages.where("html is not null").select("page_id", F.col("html").cast("string").alias("html"))
    ids = named.select(F.col("page_id").alias("chosen")).distinct().orderBy(F.xxhash64("chosen"), "chosen").limit(sample_pages)
    chosen = named.join(F.broadcast(ids), F.col("page_id").eqNullSafe(F.col("chosen")), "left_semi").groupBy("page_id").agg(F.min("html").alias("html"))

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(x, y) for x, y in (lessons(p, nodes_of_page) or (None, None) for p in batch.column(1).to_pylist()) if x is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f4").tobytes() for x, _ in got], pa.binary()), pa.array([y.astype(np.int8).tobytes() for _, y in got], pa.binary())], ["x", "y"])

    rows = sorted((bytes(r["x"]), bytes(r["y"])) for r in chosen.mapInArrow(teach, "x binary, y binary").collect())
    model = spark.sparkContext.broadcast(fit([(np.frombuffer(x, "<f4").reshape(-1, NUMBERS + 2 * BUCKETS), np.frombuffer(y, np.int8)) for x, y in rows]))
    whole = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(2).to_pylist()
            for a, b in text_slices(html):
                texts = extract(html[a:b], model.value)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return whole.mapInArrow(run, "page_id long, url string, text string, n_chars long")
