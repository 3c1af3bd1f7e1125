"""Main text of web pages by minimum cut.

A page is parsed into blocks of text, each with its place in the document
tree. A logistic classifier of a block's own looks (length, links, punctuation,
kind of element, place on the page) and marks of its ancestors (elements,
roles and names that say article or menu) gives the log-odds of content; they
become capacities from the source or to the sink. Blocks next to each other on
the page, and blocks in the same part of the tree, are joined by smoothness
edges that are the stronger the nearer they are in the tree. The minimum cut,
found by maximum flow, separates content from boilerplate.

The classifier is trained here on a bounded sample of the pages
(``sample_pages``), with the blocks in marked-up articles and in marked-up
menus, footers and the like as examples; the marks themselves are no features
of it, so it also serves pages without them. Its few weights reach the tasks
with the plan. Everything else is one pass over the pages without a shuffle.

Output: white space inside a block becomes one space, blocks are trimmed and
joined in page order by one line feed. Defined cases: null and empty html give
an empty text; unclosed elements end where their parents do, an unclosed
script or comment at the end of the page; a page without content gives an
empty text; repeated rows give repeated results; extra columns are ignored; an
empty table gives an empty result."""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_arrow

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text of the page.
SKIPPED = frozenset("script style noscript template textarea title iframe svg math object canvas audio video select button datalist head".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label input".split())
#: What an opening element ends if it is still open in the same parent.
ENDS = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "tr td th", "tbody": "thead tr td th", "tfoot": "tbody tr td th"}
#: Elements that an end tag or an implied end does not reach through.
SCOPE = frozenset("table td th ul ol dl div article section main aside nav header footer form body html figure blockquote".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

BAD_ELEMENTS = frozenset("nav footer aside form menu dialog fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words in class and id names that say boilerplate, and those that say content.
BAD_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs
    sidebar side rail footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login
    comment comments commentlist reply replies disqus discussion respond responses share sharing social related recommended recommendations teaser widget pagination pager
    copyright legal disclaimer search form tags skip""".split())
GOOD_NAMES = frozenset("article content main post entry story body text maincontent articlebody postcontent entrycontent".split())
GOOD_ELEMENTS = frozenset("article main".split())

#: Log-odds for ancestors' marks.
BAD_MARK, GOOD_MARK = -9.0, 3.0
#: Shares of the page's text under an element: up to the first a mark of boilerplate counts in full, from the second on not at all.
FULL_SHARE, NO_SHARE = 0.3, 0.6
#: What each level between a block and the mark takes from it.
FADE = 0.1
#: Smoothness: between neighbours on the page, and in the same parent.
NEIGHBOUR, PARENT = 1.2, 0.6

FEATURES = ("one", "length", "links", "stops", "commas", "paragraph", "heading", "item", "early", "late")
#: Weights used while there is nothing to train on.
DEFAULT = np.array([-1.0, 0.9, -5.0, 0.8, 0.5, 1.0, 0.6, -1.5, -0.3, -0.5])


class _Node:
    __slots__ = ("name", "parent", "depth", "bad", "good", "names", "weak")

    def __init__(self, name, parent, bad=False, good=False, weak=False):
        self.name, self.parent, self.bad, self.good, self.weak = name, parent, bad, good, weak
        self.depth = parent.depth + 1 if parent else 0


def _marks(name: str, attrs: str) -> tuple[bool, bool, bool, bool]:
    """Bad by element or role, bad by name, good, hidden."""
    bad = name in BAD_ELEMENTS
    good = name in GOOD_ELEMENTS
    weak = hidden = False
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            key = m[1].lower()
            value = (m[2] or "").strip("\"'")
            if key in ("class", "id"):
                words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
                if not BAD_NAMES.isdisjoint(words):
                    weak = True
                elif not GOOD_NAMES.isdisjoint(words):
                    good = True
            elif key == "role":
                r = value.lower()
                bad |= r in BAD_ROLES
                good |= r in ("main", "article")
            elif key == "hidden":
                hidden = True
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                hidden = True
    return bad, weak, good, hidden


class Block:
    """A run of text and where it stands."""
    __slots__ = ("node", "parts", "link", "text", "tag")

    def __init__(self, node):
        self.node, self.parts, self.link, self.tag = node, [], 0, node.name


def parse(html: str) -> list[Block]:
    """Blocks of text of a page in page order."""
    root = _Node("", None)
    stack, blocks = [root], []
    skip, anchors = 0, 0  # open skipped elements, open links
    block = None
    at, n = 0, len(html)

    def add(s: str):
        nonlocal block
        if skip or not s:
            return
        if "&" in s:
            s = unescape(s)
        if block is None:
            if s.isspace():
                return
            block = Block(stack[-1])
            blocks.append(block)
        block.parts.append(s)
        if anchors:
            block.link += len(s.strip())

    def close(to: int):
        """Close the open elements above index ``to``."""
        nonlocal skip, anchors, block
        for x in stack[to:]:
            skip -= x.name in SKIPPED or x.names == "hidden"
            anchors -= x.name == "a"
            if x.name not in INLINE:
                block = None
        del stack[to:]
    root.names = ""
    while at < n:
        m = _TOKEN.search(html, at)
        if not m:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at: m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, ending, attrs = name.lower(), (m[1] or m[4]) == "/", m[3] if m[2] else m[6]
        if ending:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    close(i)
                    break
                if stack[i].name in SCOPE and name in INLINE | {"p", "li"}:
                    break
            if name not in INLINE:
                block = None
            continue
        if name == "br":
            add(" ")
            continue
        if name not in INLINE:
            block = None
        if name in VOID:
            continue
        if name in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    close(i)
                    break
                if stack[i].name in SCOPE:
                    break
        if name in ENDS:
            names = ENDS[name].split()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in names:
                    close(i)
                    if name not in ("thead", "tbody", "tfoot", "tr"):
                        break
                elif stack[i].name in SCOPE:
                    break
        bad, weak, good, hidden = _marks(name, attrs)
        node = _Node(name, stack[-1], bad, good, weak)
        node.names = "hidden" if hidden else ""
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if attrs.endswith("/") and name not in INLINE and name not in CLOSES_P:
            continue
        stack.append(node)
        skip += name in SKIPPED or hidden
        anchors += name == "a"
    out = []
    for b in blocks:
        b.text = " ".join("".join(b.parts).split())
        if b.text:
            out.append(b)
    return out


def _marked(blocks: list[Block]) -> list[tuple[float, bool]]:
    """For each block the weight of the marks of boilerplate above it (0 to 1), and
    whether it is under one of content. A mark is the weaker the farther up it is
    and the more of the page's text it holds: a wrapper of most of it says nothing."""
    # a name does not count on the page itself, nor where a whole article is inside
    holds = set()
    for b in blocks:
        x, seen = b.node, False
        while x is not None:
            if seen:
                holds.add(id(x))
            seen |= x.name in GOOD_ELEMENTS and not x.weak
            x = x.parent
    under: dict[int, int] = {}
    for b in blocks:
        x = b.node
        while x is not None:
            under[id(x)] = under.get(id(x), 0) + len(b.text)
            x = x.parent
    total = sum(len(b.text) for b in blocks)
    out = []
    for b in blocks:
        x, weight, inside = b.node, 0.0, False
        while x is not None:
            header = x.name == "header"
            if header:  # a header is a page's unless it is an article's
                up = x.parent
                while up is not None and up.name not in GOOD_ELEMENTS:
                    up = up.parent
                header = up is None
            if x.bad or header or (x.weak and x.name not in ("html", "body", "main") and id(x) not in holds):
                share = min(1.0, max(0.0, (NO_SHARE - under[id(x)] / total) / (NO_SHARE - FULL_SHARE)))
                weight = max(weight, share / (1 + FADE * (b.node.depth - x.depth)))
            elif weight < 0.5:  # what is above a clear mark is not about the block
                inside |= x.good
            x = x.parent
        out.append((weight, inside))
    return out


def _labels(marks: list[tuple[float, bool]]) -> list[int]:
    """-1 for blocks under a clear mark of boilerplate, 1 under one of content only, else 0."""
    return [-1 if w >= 0.5 else int(inside and w == 0) for w, inside in marks]


def features(blocks: list[Block]) -> np.ndarray:
    n = len(blocks)
    out = np.zeros((n, len(FEATURES)))
    for i, b in enumerate(blocks):
        t = b.text
        size = len(t)
        words = t.count(" ") + 1
        tags, x = set(), b.node
        while x is not None and (x.name in INLINE or x.name in ("p", "li", "td", "th", "dd", "dt") or x.name[:1] == "h"):
            tags.add(x.name)
            x = x.parent
        out[i] = (1.0, min(np.log1p(words), 5.0), min(1.0, b.link / size), t[-1] in ".!?…。", min(1.0, t.count(",") / words * 5),
                  "p" in tags, any(len(h) == 2 and h[0] == "h" and h[1].isdigit() for h in tags), "li" in tags, i < 0.1 * n, i >= 0.9 * n)
    return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 30, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression with a quadratic penalty, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def source_side(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut: for each node whether it stays with the source.

    ``odds``: capacity from the source (positive) or to the sink (negative);
    ``edges``: undirected, with capacities. Maximum flow by shortest
    augmenting paths from nodes with supply left to nodes with demand left."""
    n = len(odds)
    supply, demand = [max(o, 0.0) for o in odds], [max(-o, 0.0) for o in odds]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    tiny = 1e-9
    while True:
        came = [-1] * n
        queue = deque(i for i in range(n) if supply[i] > tiny)
        for i in queue:
            came[i] = i
        end = -1
        while queue and end < 0:
            i = queue.popleft()
            for j, c in near[i].items():
                if c > tiny and came[j] < 0:
                    came[j] = i
                    if demand[j] > tiny:
                        end = j
                        break
                    queue.append(j)
        if end < 0:
            return [c >= 0 for c in came]
        path, j = [], end
        while came[j] != j:
            path.append((came[j], j))
            j = came[j]
        flow = min(supply[j], demand[end], *(near[a][b] for a, b in path))
        supply[j] -= flow
        demand[end] -= flow
        for a, b in path:
            near[a][b] -= flow
            near[b][a] += flow


def _distance(a: _Node, b: _Node) -> int:
    d = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        d += 1
    return d


def content(blocks: list[Block], weights: np.ndarray) -> list[bool]:
    """For each block whether the cut leaves it with the content."""
    if not blocks:
        return []
    marks = _marked(blocks)
    odds = np.clip(features(blocks) @ weights, -4, 4) + np.array([BAD_MARK * w + GOOD_MARK * inside * (1 - w) for w, inside in marks])
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEIGHBOUR / (1 + _distance(blocks[i - 1].node, b.node) / 2)))
        up = b.node
        while up.parent is not None and (up.name in INLINE or up.name in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6")):
            up = up.parent
        if id(up) in last and last[id(up)] != i - 1:
            edges.append((last[id(up)], i, PARENT))
        last[id(up)] = i
    return source_side(odds.tolist(), edges)


def main_text(html: str, weights: np.ndarray) -> str:
    blocks = parse(html)
    return "\n".join(b.text for b, c in zip(blocks, content(blocks, weights)) if c)


def fit(pages: DataFrame, sample_pages: int = 2000) -> np.ndarray:
    """Classifier weights from marked blocks of a sample of at most about ``sample_pages`` pages."""
    n = pages.count()
    span = 1 << 30
    sample = pages.where(F.pmod(F.xxhash64("html"), F.lit(span)) < int(span * min(1.0, sample_pages / max(1, n))))

    def run(batch):
        rows, marks = [], []
        for h in batch.column("html"):
            blocks = parse(h.as_py() or "")
            if blocks:
                rows.append(features(blocks))
                marks += _labels(_marked(blocks))
        if rows:
            x, y = np.concatenate(rows), np.array(marks)
            keep = y != 0
            yield pa.record_batch([pa.array((y[keep] > 0).astype(np.float64)), *(pa.array(x[keep, k]) for k in range(x.shape[1]))], names=["y", *FEATURES])
    cols = ["y", *FEATURES]
    # sums over equal rows: the sample is bounded, its distinct rows more so
    got = map_arrow(sample.select("html"), run, ", ".join(f"{c} double" for c in cols)).toArrow()
    x, y = np.column_stack([got[c].to_numpy() for c in FEATURES]) if len(got) else np.zeros((0, len(FEATURES))), got["y"].to_numpy()
    order = np.lexsort((*x.T, y))  # the same sums whatever the order of arrival
    x, y = x[order], y[order]
    if len(y) < 20 or y.min() == y.max():
        return DEFAULT
    return train(x, y)


def extract(pages: DataFrame, sample_pages: int = 2000) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    weights = fit(rows, sample_pages)

    def run(batch):
        texts = [main_text(h.as_py() or "", weights) for h in batch.column("html")]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                              names=["page_id", "url", "text", "n_chars"])
    return map_arrow(rows, run, "page_id bigint, url string, text string, n_chars bigint")
