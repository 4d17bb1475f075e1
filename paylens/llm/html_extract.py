"""Main text of web pages by a minimum cut.

A page is read as a tag stream into blocks: runs of text that no block-level tag interrupts. Each block has a cost of
being called content and a cost of being called boilerplate, the log odds of a classifier; they become capacities to
the two terminals. Neighbours on the page, and blocks that share a container of the document tree, are tied by
smoothness edges. The minimum cut is the labelling of least total cost; blocks on the content side are the text.

The classifier is a logistic regression over properties of a block (length, sentences, links, tags). No page has
labels, so it is trained on a bounded sample of pages on blocks that semantic tags or class names label, without showing
it those tags or names; where a page has such marks they are added as prior odds. An element that only its name holds for
boilerplate (comments, an advertisement) is boilerplate if the page has content outside such elements; where it has
hardly any, the name is that of a wrapper, and the classifier decides. Its odds are kept within bounds, so that a short
or unusual block goes with its neighbours and with those that share its containers.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import map_in_arrow

SAMPLE_PAGES = 400
NEIGHBOUR = 0.6
CONTAINER = 1.2
#: Between a section of the page and the one around it.
SECTION = 0.3
PRIOR = 5.0
#: Bounds of the classifier's odds: for content, and against it for blocks without links and of links only.
DOUBT = 2.5
PLAIN = 1.2
#: A page's content outside named elements makes them boilerplate from this share of theirs on.
OUTSIDE = 0.25
#: The mark of an element that only its name holds for boilerplate.
NAMED = -0.4
#: Odds from which the classifier clearly holds a block for content, whatever its element's name.
CLEAR = 1.0

#: Fixed values of the markup language: tags that break text into blocks, that hold no text, that have no end tag.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
HIDDEN_TAGS = frozenset("script style template noscript iframe object svg math canvas audio video head title select textarea button datalist".split())
RAW_TAGS = frozenset("script style textarea title iframe noscript".split())
SECTION_TAGS = frozenset("article aside body center details dialog div fieldset footer form header hgroup html main menu nav search section table tbody td tfoot th thead tr".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT_TAGS = frozenset("article main".split())
OTHER_TAGS = frozenset("nav header footer aside form menu dialog".split())
CONTENT_NAMES = frozenset("article content main post story entry body".split())
OTHER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsored sponsor promo promoted nav navbar navigation menu breadcrumb breadcrumbs header "
    "masthead footer sidebar side aside widget related recommended cookie cookies consent notice notices popup modal overlay newsletter subscribe signup "
    "login share sharing social comment comments reply replies discussion disqus respond pagination pager tags toolbar skip search copyright legal form".split()
)
#: Words that leave a compound (site-footer, comments-list) what its other words say; any other word makes it unknown.
PART_NAMES = frozenset("site page top bottom left right bar box area list item block section container wrapper wrap inner outer link links text global primary secondary".split())
ROLES = {"navigation": -1, "banner": -1, "contentinfo": -1, "complementary": -1, "search": -1, "form": -1, "dialog": -1, "alert": -1, "main": 1, "article": 1}

_token = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_open_tail = re.compile(r"</?[a-zA-Z][^<]*\Z|<!--.*\Z", re.S)
_attribute = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_part = re.compile(r"[-_]+")
_space = re.compile(r"\s+")
_sentence = re.compile(r"[.!?…](?:\s|$)")


@dataclass
class Node:
    """An element: its tag, parent, and what its own and outer marks say (1 content, -1 or NAMED boilerplate, 0 nothing)."""

    tag: str
    parent: int
    mark: float
    hidden: bool


@dataclass
class Block:
    text: str
    container: int
    mark: float
    tag: str
    link_chars: int


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=lambda: [Node("", -1, 0, False)])
    blocks: list[Block] = field(default_factory=list)


def _named(names: list[str]) -> set[str]:
    """The words that mark an element, of whole class tokens: words of the lists, or compounds of them and PART_NAMES."""
    found: set[str] = set()
    for name in names:
        parts = {p for p in _part.split(name) if p}
        if parts <= CONTENT_NAMES | OTHER_NAMES | PART_NAMES:
            found |= parts & OTHER_NAMES or parts & CONTENT_NAMES
    return found


def _mark(tag: str, attributes: str, outer: float) -> tuple[float, bool]:
    """The mark, inside an element with the mark outer, and whether the element is hidden."""
    mark = 1 if tag in CONTENT_TAGS else -1 if tag in OTHER_TAGS else 0
    if tag == "header" and outer > 0:  # the head of an article, not of the page
        mark = 0
    hidden = tag in HIDDEN_TAGS
    names: list[str] = []
    is_main = tag == "main"
    if attributes and not attributes.isspace():
        for m in _attribute.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" and m.start() and attributes[m.start() - 1].isspace() or key == "aria-hidden" and value == "true":
                hidden = True
            elif key == "style":
                hidden |= "display:none" in value.replace(" ", "")
            elif key == "role":
                mark = ROLES.get(value.strip(), mark)
                is_main |= value.strip() == "main"
            elif key in ("class", "id") and tag not in ("html", "body"):
                names += value.split()
    named = _named(names)
    content = bool(named & CONTENT_NAMES)
    if outer > 0 or content:
        named.discard("header")
    other = bool(named & OTHER_NAMES)
    if mark == 0:  # tags and roles win over names, content names over others
        mark = 1 if content else NAMED if other else 0
    if outer == -1 or mark == -1:  # nothing inside a boilerplate element becomes content
        return -1, hidden
    if outer == NAMED and not is_main:  # a name does not hold what an article inside it says: the classifier decides
        return (0 if mark > 0 and not other else NAMED), hidden
    return (NAMED if mark == NAMED else max(mark, outer)), hidden


def parse(source: str) -> Page:
    """Blocks of visible text in page order, white space not yet joined."""
    page = Page()
    nodes, stack, opened = page.nodes, [0], Counter()
    parts: list[str] = []
    links = link_chars = 0
    raw = ""

    def close_block() -> None:
        nonlocal link_chars
        if parts:
            text = _space.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                top = stack[-1]
                page.blocks.append(Block(text, top, nodes[top].mark, nodes[top].tag, link_chars))
            parts.clear()
        link_chars = 0

    def add(text: str) -> None:
        nonlocal link_chars
        if text and not nodes[stack[-1]].hidden:
            parts.append(text)
            if links:
                link_chars += len(text)

    at = 0
    for m in _token.finditer(source):
        if raw:
            if not (m[1] and m[2] and m[2].lower() == raw):
                continue
        elif m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            raw = ""
            if tag == "a":
                links = max(links - 1, 0)
            elif tag == "br":
                add(" ")
            if tag in BLOCK_TAGS or tag in HIDDEN_TAGS:
                if tag in BLOCK_TAGS:
                    close_block()
                if opened[tag] > 0:
                    while True:
                        closed = nodes[stack.pop()].tag
                        opened[closed] -= 1
                        if closed == tag:
                            break
            continue
        if tag == "a":
            links = 1
        elif tag in ("br", "hr", "wbr", "img"):
            add(" " if tag != "wbr" else "")
        if tag in BLOCK_TAGS:
            close_block()
            if nodes[stack[-1]].tag == "p":  # a paragraph ends where a block begins
                opened[nodes[stack.pop()].tag] -= 1
            elif tag == nodes[stack[-1]].tag and tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
                opened[nodes[stack.pop()].tag] -= 1
        if (tag in BLOCK_TAGS or tag in HIDDEN_TAGS) and tag not in VOID_TAGS and not m[3].rstrip().endswith("/"):
            mark, hidden = _mark(tag, m[3], nodes[stack[-1]].mark)
            nodes.append(Node(tag, stack[-1], mark, hidden or nodes[stack[-1]].hidden))
            stack.append(len(nodes) - 1)
            opened[tag] += 1
            raw = tag if tag in RAW_TAGS else ""
    if not raw:
        add(_open_tail.sub("", source[at:]))
    close_block()
    return page


#: The number of features of a block, the constant included.
N_FEATURES = 7


def features(block: Block) -> list[float]:
    """Properties of a block that no semantic tag or name enters."""
    n = len(block.text)
    words = block.text.count(" ") + 1
    return [
        1.0,
        math.log1p(n) / 5,
        math.log1p(words) / 4,
        min(len(_sentence.findall(block.text)), 10) / 5,
        min(block.link_chars / n, 1.0),
        float(block.tag == "p"),
        float(block.tag in ("h1", "h2", "h3", "h4", "h5", "h6")),
    ]


def train(rows: list[tuple[list[float], int]], steps: int = 300, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression, classes weighted alike; zeros without examples of both classes."""
    if len({y for _, y in rows}) < 2:
        return np.zeros(N_FEATURES)
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w = np.zeros(N_FEATURES)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w += 4.0 * ((weight * (y - p)) @ x - ridge * w)
    return w


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source's side of a minimum cut; ties go to the sink's side.

    Shortest augmenting paths in levels (blocking flows) over the residual graph.
    """
    n = len(source)
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    head: list[int] = []
    room: list[float] = []

    def tie(a: int, b: int, ab: float, ba: float) -> None:
        graph[a].append(len(head)), head.append(b), room.append(ab)
        graph[b].append(len(head)), head.append(a), room.append(ba)

    for k in range(n):  # what both terminals could take from a node flows straight through
        through = min(source[k], sink[k])
        if source[k] > through:
            tie(s, k, source[k] - through, 0.0)
        elif sink[k] > through:
            tie(k, t, sink[k] - through, 0.0)
    for a, b, c in edges:
        tie(a, b, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] > tiny and level[head[e]] < 0:
                    level[head[e]] = level[a] + 1
                    queue.append(head[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        follow = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                back = next(k for k, e in enumerate(path) if room[e] <= tiny)
                a = head[path[back] ^ 1]
                del path[back:]
                continue
            while follow[a] < len(graph[a]):
                e = graph[a][follow[a]]
                if room[e] > tiny and level[head[e]] == level[a] + 1:
                    break
                follow[a] += 1
            if follow[a] < len(graph[a]):
                path.append(graph[a][follow[a]])
                a = head[path[-1]]
            elif a == s:
                break
            else:
                e = path.pop()
                a = head[e ^ 1]
                follow[a] += 1


def own_odds(page: Page, weights: np.ndarray) -> list[float]:
    """Odds of each block by itself: the classifier's, within bounds, and what marks add."""
    blocks = page.blocks
    odds, marks = np.array([features(b) for b in blocks]) @ weights, np.array([b.mark for b in blocks])
    chars = np.array([len(b.text) for b in blocks])
    clear, named = odds >= CLEAR, marks == NAMED
    outside, inside = chars[~named & clear & (marks >= 0)].sum(), chars[named & clear].sum()
    if (marks > 0).any() or outside > OUTSIDE * inside:
        marks = np.where(named, -1, marks)
    else:  # the named element is a wrapper of the content
        marks = np.where(named & clear, 0, marks)
    links = np.array([min(b.link_chars / len(b.text), 1.0) for b in blocks])
    bound = np.where(odds > 0, DOUBT, PLAIN + (DOUBT - PLAIN) * links)  # a short block alone says little, a list of links much
    return (bound * np.tanh(odds / bound) + PRIOR * marks).tolist()


def ties(page: Page) -> tuple[list[tuple[int, int, float]], int]:
    """Edges between blocks and their containers, and the number of nodes: first the blocks, then the containers.

    Neighbours on the page are tied. A block is tied to its element, and that, by as many ties as it has blocks, to the one
    around it up to a section of the page: a list goes with the text that it stands in. Sections are tied weakly.
    """
    blocks = page.blocks
    outer: dict[int, int] = {}  # container -> the one around it
    held: Counter = Counter()
    for block in blocks:
        at = block.container
        while at > 0 and page.nodes[at].tag not in ("body", "html"):
            held[at] += 1
            outer[at] = page.nodes[at].parent
            at = outer[at]
    number = {c: len(blocks) + k for k, c in enumerate(sorted(outer))}
    edges = [(k, k + 1, NEIGHBOUR) for k in range(len(blocks) - 1)]
    edges += [(k, number[b.container], CONTAINER) for k, b in enumerate(blocks) if b.container in number]
    edges += [(number[c], number[o], SECTION if page.nodes[c].tag in SECTION_TAGS else CONTAINER * held[c]) for c, o in outer.items() if o in number]
    return edges, len(blocks) + len(number)


def label(page: Page, weights: np.ndarray) -> list[bool]:
    """For each block, whether it is content."""
    if not page.blocks:
        return []
    odds = own_odds(page, weights)
    edges, n = ties(page)
    extra = [0.0] * (n - len(odds))
    cut = minimum_cut([max(o, 0.0) for o in odds] + extra, [max(-o, 0.0) for o in odds] + extra, edges)
    return cut[: len(odds)]


def extract(source: str | None, weights: np.ndarray) -> str:
    page = parse(source or "")
    return "\n\n".join(b.text for b, keep in zip(page.blocks, label(page, weights)) if keep)


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights from the sample_pages pages whose page_id has the smallest hash.

    Of blocks with equal properties and label, eight count at most, so that a menu on every page does not decide alone.
    """
    chosen = pages.select("page_id", F.col("html").cast("string").alias("html")).orderBy(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), "page_id").limit(sample_pages)
    schema = pa.schema([("x", pa.list_(pa.float64())), ("y", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = [b for h in batch.column(1).to_pylist() for b in parse(h or "").blocks if b.mark]
            yield pa.RecordBatch.from_arrays([pa.array([features(b) for b in marked], schema[0].type), pa.array([int(b.mark > 0) for b in marked], pa.int64())], schema=schema)

    counted = map_in_arrow(chosen, run, "x array<double>, y long").groupBy("x", "y").count()  # equal blocks once
    rows = sorted((tuple(r[0]), r[1], r[2]) for r in counted.collect())
    return train([(list(x), y) for x, y, n in rows for _ in range(min(n, 8))])


def extract_pages(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars.

    Null or empty html, or a page without content, gives an empty text. Repeated rows stay.
    """
    weights = fit(pages, sample_pages)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, weights) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema=schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_in_arrow(rows, run, "page_id long, url string, text string, n_chars long")
