"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks at block-level tags. A linear classifier over
place, wording of class names, length and links gives each block the cost of
calling it content and the cost of calling it boilerplate; these are capacities
to the two terminals. Edges between neighbours in the page and between neighbours
of one container cost something if their labels differ, the more the closer
they stand in the tree. The minimum cut of this graph, found by maximum flow, is
the cheapest labelling. Runs of like blocks of one container are one node.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements of the page language.
#: Elements whose text runs to their end tag or, without one, to the end of the page.
_RAW = "script|style|textarea|title"
#: Elements that are left out with all they hold; one without an end tag holds nothing.
_SKIPPED = frozenset("noscript template svg math iframe object canvas audio video select".split())
_BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table
    tbody td tfoot th thead tr ul""".split()
)
_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that a start tag of the given name ends, and where looking for them stops.
_ENDS = {
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt", "p"}, {"dl"}),
    "dt": ({"dd", "dt", "p"}, {"dl"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
}
#: A foreign element that ends itself. The slash after an unquoted value is part of the value.
_CLOSED = r"<(?:svg|math)(?=[\s/>])(?>(?:\s+|/(?!>)|[^\s\"'>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?)*)/>"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|{_CLOSED}|<({_RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>|<[!?/][^>]*+>|<[a-zA-Z][^>]*+>|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"(?:^|[\s\"'])(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)

# What speaks against an element, by the words of its names; and for it.
_AGAINST = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie
    cookies disqus foot footer form gdpr head header login masthead menu menubar modal nav navbar navigation newsletter notice
    notification overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond
    search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets""".split()
)
_FOR = frozenset("article articlebody body content entry main post posting story text".split())
_SCORE = {"nav": -6.0, "aside": -5.0, "footer": -5.0, "header": -4.0, "form": -6.0, "menu": -5.0, "button": -4.0, "dialog": -4.0,
          "fieldset": -4.0, "article": 3.0, "main": 2.5}
_OWN = {"p": 1.0, "pre": 0.8, "blockquote": 1.0, "h1": 1.0, "h2": 0.6, "h3": 0.4, "li": -0.4, "td": -0.2, "th": -0.4}


#: Flow that counts as none.
_NOTHING = 1e-9


@dataclass
class _Element:
    """against, speaks_for: the lowest and highest score of the element and those around it."""

    name: str
    number: int
    score: float
    depth: int
    parent: _Element | None
    against: float = 0.0
    speaks_for: float = 0.0

    def __post_init__(self):
        if self.parent is not None:
            self.against = min(self.parent.against, self.score)
            self.speaks_for = max(self.parent.speaks_for, self.score)


@dataclass
class Block:
    """text, its element, characters inside links, the classifier's score, and whether a name speaks against it."""

    text: str
    element: _Element
    linked: int
    score: float = 0.0
    against: bool = False


@dataclass
class _Node:
    blocks: list[int] = field(default_factory=list)
    content: float = 0.0  # cost of calling it boilerplate
    boilerplate: float = 0.0  # cost of calling it content


def _element_score(name: str, attributes: str, inside: _Element | None) -> float:
    """What the element itself says, for content (above 0) or against."""
    score = _SCORE.get(name, 0.0)
    if name == "header" and inside is not None and inside.name in ("article", "main"):
        score = -1.0  # the heading of an article
    if attributes:
        if _HIDDEN.search(attributes):
            score -= 6.0
        words = re.findall("[a-z]+", " ".join(_NAMED.findall(re.sub("(?<=[a-z])(?=[A-Z])", " ", attributes))).lower())
        if name not in ("html", "body"):
            score -= 5.0 * any(w in _AGAINST for w in words)
            score += 1.5 * any(w in _FOR for w in words)
    return score


def _seen(page: str) -> Iterator[re.Match]:
    """The tokens of a page without skipped elements, start and end tags matched from the inside out."""
    tokens = list(_TOKEN.finditer(page))
    open_: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    for k, token in enumerate(tokens):
        name = token[3].lower() if token[3] else None
        if name in _SKIPPED:
            if not token[2]:
                open_.setdefault(name, []).append(k)
            elif open_.get(name):
                ends[open_[name].pop()] = k
    k = 0
    while k < len(tokens):
        if k in ends:
            k = ends[k]
        elif not (tokens[k][3] and tokens[k][3].lower() in _SKIPPED):
            yield tokens[k]
        k += 1


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page, in its order."""
    root = _Element("", 0, 0.0, 0, None)
    here, count, links = root, 1, 0
    found: list[Block] = []
    parts: list[str] = []
    linked = 0
    opened: Counter[str] = Counter()

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            found.append(Block(text, here, linked))
        parts.clear()
        linked = 0

    def up_to(element: _Element) -> None:
        """Leave this element and all inside it."""
        nonlocal here
        while here is not element.parent:
            opened[here.name] -= 1
            here = here.parent

    def leave(names: set[str], stops: set[str]) -> None:
        at, left = here, None
        if not any(opened[name] for name in names):
            return
        while at.parent is not None and at.name not in stops:
            if at.name in names:
                left = at
            at = at.parent
        if left is not None:
            up_to(left)

    for token in _seen(page):
        name = token[3]
        if name is None:
            body = token[0]
            if body[0] != "<" or body == "<":
                text = html.unescape(body)
                parts.append(text)
                linked += len(text) if links else 0
            elif token[1] is None and body[1:2].isalpha():
                parts.append(" ")
            continue
        name = name.lower()
        if name in _BLOCKS:
            flush()
            if token[2]:
                if opened[name]:
                    at = here
                    while at.name != name:
                        at = at.parent
                    up_to(at)
            else:
                if name in _ENDS:
                    leave(*_ENDS[name])
                elif here.name == "p":
                    up_to(here)
                if name not in _EMPTY:
                    opened[name] += 1
                    here = _Element(name, count, _element_score(name, token[4], here), here.depth + 1, here)
                    count += 1
            links = 0 if name in ("article", "main", "body") else links
        elif name == "a":
            links = max(0, links - 1) if token[2] else 1
        elif name == "br":
            parts.append(" ")
    flush()
    for block in found:
        _judge(block)
    return found


def _judge(block: Block) -> None:
    against, speaks_for = block.element.against, block.element.speaks_for
    size = len(block.text)
    score = against + speaks_for + _OWN.get(block.element.name, 0.0) + min(2.0, math.log1p(size / 40)) - 0.25
    score -= 4.0 * block.linked / size
    if block.text[-1] in ".!?…:;\"'”»)":
        score += 0.5
    if "©" in block.text[:40] or block.text[:9].lower() == "copyright":
        score -= 3.0
    block.score, block.against = score, against <= -4.0


def _cost(score: float) -> float:
    return score + math.log1p(math.exp(-score)) if score > 0 else math.log1p(math.exp(score))


def min_cut(n: int, source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which of n nodes stay with the source in a minimum cut, by flows along all shortest paths at a time.

    source, sink: capacities to the terminals; edges: pairs and a capacity both
    ways. Flow that a node takes from the source is spent on the shortest ways to
    the sink, which are short where costs differ from place to place; so rounds
    are few and each is in proportion to the edges.
    """
    t = n
    room: list[dict[int, float]] = [{} for _ in range(n + 1)]
    supply = [0.0] * n
    for k in range(n):
        direct = min(source[k], sink[k])  # flows through at once
        supply[k] = source[k] - direct
        room[k][t], room[t][k] = sink[k] - direct, 0.0
    for a, b, capacity in edges:
        room[a][b] = room[a].get(b, 0.0) + capacity
        room[b][a] = room[b].get(a, 0.0) + capacity
    while True:
        level = [-1] * (n + 1)
        reached = [k for k in range(n) if supply[k] > _NOTHING]
        for k in reached:
            level[k] = 0
        for at in reached:  # grows meanwhile
            if at != t:
                for to, left in room[at].items():
                    if left > _NOTHING and level[to] < 0:
                        level[to] = level[at] + 1
                        reached.append(to)
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        onward = [iter(list(r)) for r in room]
        for begin in range(n):
            while supply[begin] > _NOTHING:
                path, at = [], begin
                while at != t:
                    for to in onward[at]:
                        if level[to] == level[at] + 1 and room[at][to] > _NOTHING:
                            path.append((at, to))
                            at = to
                            break
                    else:  # nothing leads on from here
                        level[at] = -2
                        if not path:
                            break
                        at = path.pop()[0]
                if at != t:
                    break
                flow = min(supply[begin], *(room[a][b] for a, b in path))
                supply[begin] -= flow
                for a, b in path:
                    room[a][b] -= flow
                    room[b][a] += flow
                    if room[a][b] > _NOTHING:  # the edge has room for the next path
                        onward[a] = chain([b], onward[a])


def _distance(a: _Element, b: _Element) -> int:
    """Steps between two elements of the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def labels(found: list[Block]) -> list[bool]:
    """Whether each block is content."""
    nodes: list[_Node] = []
    last_key = None
    for k, block in enumerate(found):
        container = block.element.parent or block.element
        key = (container.number, block.element.name, block.element.score, 2 * block.linked > len(block.text), block.score > 0)
        if key != last_key:
            nodes.append(_Node())
            last_key = key
        node = nodes[-1]
        node.blocks.append(k)
        node.content += _cost(block.score)
        node.boilerplate += _cost(-block.score)

    def near(a: int, b: int) -> float:
        """Less where only one of two nodes stands in an element whose name speaks against it."""
        return 1.0 if found[nodes[a].blocks[0]].against == found[nodes[b].blocks[0]].against else 0.25

    edges: list[tuple[int, int, float]] = []
    of_container: dict[int, int] = {}
    for k, node in enumerate(nodes):
        element = found[node.blocks[0]].element
        if k:
            edges.append((k - 1, k, near(k - 1, k) / (1 + _distance(found[nodes[k - 1].blocks[-1]].element, element))))
        container = (element.parent or element).number
        if container in of_container:
            edges.append((of_container[container], k, 0.5 * near(of_container[container], k)))
        of_container[container] = k
    kept = min_cut(len(nodes), [x.content for x in nodes], [x.boilerplate for x in nodes], edges)
    out = [False] * len(found)
    for node, keep in zip(nodes, kept, strict=True):
        for k in node.blocks:
            out[k] = keep
    return out


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by a line feed."""
    found = blocks_of(page or "")
    return "\n".join(b.text for b, keep in zip(found, labels(found), strict=True) if keep)


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """Every row with its columns, text and n_chars (code points, long).

    The whole of the column ``source`` is read; null and empty pages, and pages
    without content, give the empty text. Broken markup is read as far as it
    goes. Repeated rows give equal texts. A column of the input that is called
    text or n_chars is replaced.
    """
    names = [f for f in pages.schema.fields if f.name not in ("text", "n_chars") or f.name == source]
    schema = T.StructType([*[f for f in names if f.name not in ("text", "n_chars")], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column(source).to_pylist()]
            own = [n for n in batch.schema.names if n not in ("text", "n_chars")]
            arrays = [*[batch.column(n) for n in own], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*own, "text", "n_chars"])

    return pages.select(*[F.col(f"`{f.name}`") for f in names]).mapInArrow(run, schema)
