"""Main text of web pages by composite text density.

A page becomes a tree of elements. Elements that never hold article text are cut first: scripts,
styles, buttons and what is hidden, and then, unless they hold the page's text, menus, page headers and
footers, asides, forms and elements whose class, id or role names an advert, notice, sidebar, menu,
share bar or comment section. Such an element holds the page's text if all that would be left without
such elements has less than ``LEAST_REST`` of its unlinked characters. For every element left the
density is its characters per tag, adjusted by the share of characters and tags in links; the sum of
its children's densities says how much dense text it holds directly. The element with the largest sum
is the core of the article. The smallest density between it and the body is the threshold: outside the
core, an element beside that path stays if it reaches the threshold.

Defined cases: a null or empty page, or one without text, gives the empty text; unclosed elements,
comments and quotes end where the page ends; references that HTML does not define stay as written;
repeated rows give repeated results; very long pages are read whole, in linear time.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.llm.common import arrow_pass

# Element names by role, as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr img".split()
)
CUT = frozenset(
    "script style noscript template svg math canvas iframe object embed audio video head title meta link "
    "button select option textarea input label noembed noframes".split()
)
ASIDE = frozenset("nav header footer aside form fieldset menu dialog".split())
#: Start tags that end an open element of the listed names, unless one of the walls stands between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WALLS = frozenset("html body article section main div ul ol dl table td th blockquote aside nav header footer form button object".split())

NOISE_NAME = re.compile(
    r"(?:ads?|adverts?|advertisements?|sponsor(?:ed|s)?|promo(?:tion)?s?|banners?|breadcrumbs?|comments?|replies|respond|discussion|disqus"
    r"|cookies?|consent|gdpr|footer|header|masthead|menus?|nav|navbar|navigation|newsletter|notices?|popup|modal|overlay"
    r"|related|recommended|share|sharing|sidebars?|sidebar|signup|social|subscribe|toolbar|widgets?|pagination|pager)(?:$|[-_])",
    re.I,
)
NOISE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)(?:((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|([^>]*+)(?:>|\Z))""", re.S
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)
#: An element that names or tags would cut stays if it has LEAST_TEXT unlinked characters, and without it less than LEAST_REST of them are left.
LEAST_TEXT, LEAST_REST = 200, 0.1
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "parts", "noise", "doubtful", "chars", "tags", "link_chars", "link_tags", "density", "dense")

    def __init__(self, tag: str, parent: Node | None, noise: bool = False, doubtful: bool = False):
        self.tag, self.parent, self.parts, self.noise, self.doubtful = tag, parent, [], noise, doubtful


def noise_of(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is noise, and whether only its name or a tag that can hold a whole page says so."""
    if tag in CUT:
        return True, False
    named = tag in ASIDE
    if tag in ("html", "body", "main") or not attributes:
        return named, named
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            return True, False
        if name == "role" and value.lower() in NOISE_ROLE or name in ("class", "id") and any(NOISE_NAME.match(x) for x in value.split()):
            named = True
    return named, named


class Open:
    """The open elements: their path from the root, and where on it each name and each wall stands."""

    def __init__(self, root: Node):
        self.path, self.at, self.walls = [root], {}, []

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.path))
        if node.tag in WALLS:
            self.walls.append(len(self.path))
        self.path.append(node)

    def cut(self, depth: int) -> None:
        """Ends all elements from this depth on."""
        while len(self.path) > depth:
            tag = self.path.pop().tag
            self.at[tag].pop()
            if tag in WALLS:
                self.walls.pop()

    def start(self, tag: str) -> None:
        """Makes room for a block that starts here: an open p, or li beside li, ends."""
        names = ENDS.get(tag, ()) + ("p",)
        k = len(self.walls)
        while k and self.path[self.walls[k - 1]].tag in names:
            k -= 1
        wall = self.walls[k - 1] if k else 0
        found = [own[i] for own in (self.at.get(x, ()) for x in names) if (i := bisect_right(own, wall)) < len(own)]
        if found:
            self.cut(min(found))

    def end(self, tag: str) -> None:
        """An end tag; one that nothing opened, or beyond a wall for inline names, is ignored."""
        own = self.at.get(tag)
        if own and not (tag in INLINE and self.walls and self.walls[-1] > own[-1]):
            self.cut(own[-1])


def tree(page: str) -> Node:
    """The page's elements; text stays in pieces between them, comments and raw elements are left out."""
    root = Node("html", None)
    live = Open(root)
    at = 0
    while m := TOKEN.search(page, at):
        if m.start() > at:
            live.path[-1].parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            live.end(tag)
        elif tag == "html":
            continue
        elif tag == "body":
            live.cut(1)
            node = Node(tag, root)
            root.parts.append(node)
            live.push(node)
        else:
            attributes = m[3] if m[3] is not None else m[4]
            if tag not in INLINE:
                live.start(tag)
            child = Node(tag, live.path[-1], *noise_of(tag, attributes))
            child.parent.parts.append(child)
            if tag in RAW:
                end = re.compile(f"</{tag}", re.I).search(page, at)
                at = len(page) if end is None else end.start()
                live.push(child)
            elif tag not in VOID and not attributes.endswith("/"):
                live.push(child)
    live.path[-1].parts.append(page[at:])
    return root


def elements(node: Node) -> list[Node]:
    return [x for x in node.parts if type(x) is Node]


def spare(root: Node) -> None:
    """Elements that are noise by name or tag but hold the page's text are noise no more; each element is looked at once."""
    order, todo = [], [(root, root, False)]
    within: dict[int, list[Node]] = {id(root): []}  # of the root and each doubtful element: the doubtful ones right below it
    unlinked, rest = {id(root): 0}, {id(root): 0}  # their characters outside links; without those of doubtful elements below
    while todo:
        node, region, linked = todo.pop()
        if node.noise and node.doubtful:
            within[id(region)].append(node)
            within[id(node)], unlinked[id(node)], rest[id(node)] = [], 0, 0
            order.append((node, region))
            region = node
        linked = linked or node.tag == "a"
        if not linked:
            rest[id(region)] += sum(len(x) - x.count(" ") for x in node.parts if type(x) is str)
        todo += [(x, region, linked) for x in elements(node) if not x.noise or x.doubtful]
    for node, region in reversed(order):
        unlinked[id(node)] += rest[id(node)]
        unlinked[id(region)] += unlinked[id(node)]
    left = rest[id(root)]
    heap = [(-unlinked[id(x)], i, x) for i, x in enumerate(within[id(root)])]
    heapq.heapify(heap)
    count = len(heap)
    while heap:
        size, _, node = heapq.heappop(heap)
        if -size < LEAST_TEXT or left >= LEAST_REST * -size:
            break
        node.noise = False
        left += rest[id(node)]
        for x in within[id(node)]:
            count += 1
            heapq.heappush(heap, (-unlinked[id(x)], count, x))


def measure(root: Node) -> list[Node]:
    """Counts and densities of every element that is not noise; returns them, parents first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in elements(node) if not x.noise][::-1]
    for node in reversed(order):
        own = sum(len(x) - x.count(" ") for x in node.parts if type(x) is str)
        inner = [x for x in elements(node) if not x.noise]
        node.chars = own + sum(x.chars for x in inner)
        node.tags = len(inner) + sum(x.tags for x in inner)
        link = node.tag == "a"
        node.link_chars = node.chars if link else sum(x.link_chars for x in inner)
        node.link_tags = sum(x.link_tags + (x.tag == "a") for x in inner)
    share = root.link_chars / max(root.chars, 1)
    for node in reversed(order):
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + share * c + math.e)  # 1 or more
        node.density = c / t * max(math.log(max(c / lc * t / lt, 1)) / base, 1e-6)
        node.dense = sum(x.density for x in elements(node) if not x.noise)
    return order


def main_nodes(root: Node) -> tuple[Node, set[int], float]:
    """Where the text starts, the ids of the elements on the path to the core, and the threshold beside it."""
    order = measure(root)
    body = next((x for x in order if x.tag == "body"), root)
    if not body.chars:
        return root, set(), math.inf
    core = max(order, key=lambda x: (x.dense, x.density)) if any(x.dense > 0 for x in order) else body
    path, node = [core], core
    while node.parent is not None and node is not body:
        node = node.parent
        path.append(node)
    return path[-1], {id(x) for x in path if x is not core}, min(x.density for x in path)


def text_of(page: str) -> str:
    """The main text: white space within a block is one space, and one space joins the blocks."""
    root = tree(page)
    spare(root)
    start, path, least = main_nodes(root)
    pieces: list[str] = []
    todo: list[Node | str] = [start]
    while todo:
        x = todo.pop()
        if type(x) is str:
            pieces.append(html.unescape(x) if "&" in x else x)
            continue
        block = x.tag not in INLINE
        inner: list[Node | str] = [" "] if block else []
        for y in x.parts:
            if type(y) is str:
                inner.append(y)
            elif not y.noise and (id(x) not in path or id(y) in path or y.tag in INLINE or y.density >= least):
                inner.append(y)
        if block:
            inner.append(" ")
        todo += reversed(inner)
    return " ".join("".join(pieces).split())


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [text_of(x) if x else "" for x in b.column(2).to_pylist()]
        cols = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages; nothing is shuffled."""
    return arrow_pass(pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")), SCHEMA, extract_batches)
