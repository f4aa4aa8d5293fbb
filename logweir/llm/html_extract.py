"""HTML extraction: a minimum cut separates content blocks from boilerplate.

A tolerant scanner splits a page at block tags and keeps each block's ancestors. Every block is a
node. A classifier over semantic tags, class and id words, link share, length and sentence
marks gives the log-odds that the block is content; their sign says to which terminal the node is tied
and their size is that edge's capacity. Neighbours in page order are joined by a smoothness edge that
weakens with their distance in the DOM, and blocks with the same parent by another, in the same units. The minimum
cut labels the page. Nodes whose own preference outweighs all their edges keep it in every minimum cut,
so they are settled first and only the rest go through max-flow.

The classifier is a logistic regression, trained by ``html_training`` on pages that it lays out, where every
block's label is known; the edges' strength is chosen there too, on pages that training has not seen.
Words of classes and ids are features, no vetoes, and an element that wraps the article, or most of the page
with its headline, tells nothing by its name.

Pages are handled where they lie, in Arrow batches, without a shuffle; memory is one page's.

Edge cases. Null or empty html gives an empty text. Unclosed tags, comments, quotes and documents
that break off are read as browsers do, as far as text needs it. Pages without any markup are one
block of content. Repeated rows are handled separately; extra columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from logweir.llm.common import table

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[!?/][^>]*>?|<[a-zA-Z][^>]*>?", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORD = re.compile(r"[a-z]+")
_HREF = re.compile(r"(?<![^\s\"'])href\s*=", re.I)

#: Elements whose text is never shown, or is no running text.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "noembed", "noframes", "xmp"}
#: Elements with text that is shown only where they fail; one without an end tag of its own hides nothing.
FALLBACK = {"object", "canvas", "audio", "video"}
#: Drawings and notes on formulas, which end at their end tag or at the first of these HTML tags.
FOREIGN = {"svg", "annotation", "annotation-xml"}
_BREAKOUT = r"<(?:b|big|blockquote|body|br|center|code|dd|div|dl|dt|em|embed|h[1-6]|head|hr|i|img|li|listing|menu|meta|nobr|ol|p|pre|ruby|s|small|span|strong|strike|sub|sup|table|tt|u|ul|var)(?=[\s/>])"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "output", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "center", "nobr", "picture", "map", "bdo"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
INLINE |= {"math", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "mfrac", "msqrt", "mroot", "mstyle", "merror", "mpadded", "mphantom", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mprescripts", "mtable", "mtr", "mtd", "semantics"}
STOPS = {"ul", "ol", "dl", "table", "select", "body", "html"}
SIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "select", "button", "fieldset", "head"}
SIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "note", "status"}
SIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice "
    "alert warning newsletter subscribe subscription signup login popup modal overlay share sharing social related recommended recommendations trending popular comment comments reply replies respond discussion disqus "
    "widget toolbar pagination pager copyright legal disclaimer skip tags form search".split()
)
#: Words that speak of a layout's state, and those that name any box.
LAYOUT = set("no has with without enabled disabled open closed on off active show hide is not".split())
BOXES = set("box wrapper wrap container area section block item items list inner outer row col column left right top bottom bar widget panel group holder unit region".split())
BODY_WORDS = set("article content entry story main body post text".split())

FEATURES = ["bias", "article", "side", "header", "hidden", "side_word", "body_word", "links", "length", "brief", "sentence", "heading", "paragraph", "item", "commas", "mass", "headline", "foot"]


class Element:
    __slots__ = ("tag", "parent", "depth", "is_main", "is_side", "is_header", "is_hidden", "side_share", "body_share", "article", "side", "header", "hidden", "side_word", "body_word", "mass", "anchor", "share", "headline")

    def __init__(self, tag: str, attrs: str, parent: "Element | None"):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.side_share = self.body_share = 0.0
        named_header, role, hidden = False, "", False
        if attrs and ("=" in attrs or "hidden" in attrs):
            for k, v in _ATTR.findall(attrs):
                k = k.lower()
                v = v.strip("\"'").lower()
                if k in ("class", "id"):
                    for token in v.split():
                        # "no-sidebar", "has-menu", "comments-enabled" speak of a layout, not of the element.
                        parts = _WORD.findall(token)
                        if not parts or LAYOUT.intersection(parts):
                            continue
                        telling = [w for w in parts if w not in BOXES] or parts
                        self.side_share = max(self.side_share, sum(w in SIDE_WORDS for w in telling) / len(telling))
                        self.body_share = max(self.body_share, sum(w in BODY_WORDS for w in telling) / len(telling))
                        named_header = named_header or "header" in parts and not BODY_WORDS.intersection(parts)
                elif k == "role":
                    role = v
                elif k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and "display:none" in v.replace(" ", ""):
                    hidden = True
        self.is_main = tag in ("article", "main") or role in ("main", "article")
        self.is_side = tag in SIDE or role in SIDE_ROLES
        self.is_header = tag == "header" or named_header
        self.is_hidden = hidden
        self.mass, self.anchor = 0, False


def settle(elements: list[Element], page: list["Block"]) -> None:
    """What each element says of the blocks inside it, from the page as a whole: parents come first."""
    for b in page:
        b.home.mass += b.size
    total = max(1, elements[0].mass + sum(e.mass for e in elements[1:]))
    apart = {}
    for e in elements:
        # Articles among side matter, such as readers' comments, are no sign of the main text.
        apart[e] = e.side_share == 1 or e.is_side and e.tag != "form" or e.parent is not None and apart[e.parent]
        e.anchor = not apart[e] and (e.is_main or e.tag == "h1") or e.tag == "main"
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.mass += e.mass
            e.parent.anchor = e.parent.anchor or e.anchor
    for e in elements:
        up = e.parent
        wraps = e.anchor and (0 < e.side_share < 1 or 2 * e.mass > total) or e.tag in ("body", "html", "main", "")
        side_word = 0.0 if wraps else e.side_share
        side = e.is_side and not wraps
        e.article = e.is_main and not apart[e] or up is not None and up.article
        e.side = side or up is not None and up.side
        e.hidden = e.is_hidden or up is not None and up.hidden
        e.header = e.is_header and not wraps and not (up is not None and up.article) or up is not None and up.header
        e.side_word = max(side_word, up.side_word if up is not None else 0.0)
        e.body_word = max(e.body_share, up.body_word if up is not None else 0.0)
        # Of the box that a block stands in: its share of the page's text, and whether the headline is there.
        box = up if up is not None and e.tag not in ("div", "section", "td") else e
        e.share, e.headline = box.mass / total, box.anchor and box.tag not in ("body", "html", "")


class Block:
    __slots__ = ("parts", "home", "linked", "size")

    def __init__(self, home: Element):
        self.parts, self.home, self.linked, self.size = [], home, 0, 0

    @property
    def text(self) -> str:
        return " ".join(unescape("".join(self.parts)).split())


def blocks(html: str) -> list[Block]:
    """The page's blocks of text, in page order, those without text left out."""
    root = Element("", "", None)
    here, link = root, None
    elements, opened = [root], Counter()
    found: list[Block] = []
    block = Block(root)

    def close_to(node: Element) -> None:
        """Closes all that is open below a node; a link ends with the element that it began in."""
        nonlocal here, link
        while here is not node:
            opened[here.tag] -= 1
            here = here.parent
        if link is not None and link.depth > here.depth:
            link = None

    def end_block(home: Element) -> None:
        nonlocal block
        if block.size:
            found.append(block)
        block = Block(home)

    def add(text: str) -> None:
        if text:
            block.parts.append(text)
            n = len(text.strip())
            block.size += n
            if link is not None:
                block.linked += n

    at, size = 0, len(html)
    while at < size:
        m = _TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in INLINE:
                link = None if tag == "a" else link
            elif tag == "br":
                block.parts.append(" ")
            elif tag not in VOID and opened[tag] > 0:
                node = here
                while node.tag != tag:
                    node = node.parent
                close_to(node.parent)
                end_block(here)
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                at = close.end() if close else size
            block.parts.append(" ")
            continue
        if tag in FOREIGN:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>|(?={_BREAKOUT})", re.I).search(html, at)
                at = end.end() if end else size
            block.parts.append(" ")
            continue
        if tag in FALLBACK:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>|<{tag}\b", re.I).search(html, at)
                at = end.end() if end and end[0][1] == "/" else at
            block.parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                link = here if _HREF.search(m[3]) else None
            continue
        if tag in VOID:
            block.parts.append(" ")
            if tag == "hr":
                end_block(here)
            continue
        # A block that opens ends an open paragraph, and items end items of their own list.
        if here.tag == "p" or here.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "div", "article", "section"):
            close_to(here.parent)
        if tag in CLOSES and any(opened[t] > 0 for t in CLOSES[tag]):
            node, to = here, here
            while node.parent is not None and node.tag not in STOPS - {tag}:
                if node.tag in CLOSES[tag]:
                    to = node.parent
                    if node.tag == tag:
                        break
                node = node.parent
            close_to(to)
        here = Element(tag, m[3], here)
        elements.append(here)
        opened[tag] += 1
        end_block(here)
    end_block(here)
    page = [b for b in found if b.text]
    settle(elements, page)
    return page


def features(block: Block) -> list[float]:
    """In order of ``FEATURES``."""
    e, text = block.home, block.text
    size = len(text)
    return [
        1.0, float(e.article), float(e.side), float(e.header), float(e.hidden), e.side_word, e.body_word, min(1.0, block.linked / max(1, block.size)),
        min(2.0, size / 100), float(size < 25), float(text[-1] in ".!?…:;"), float(e.tag[:1] == "h" and e.tag[1:].isdigit()), float(e.tag in ("p", "blockquote", "pre")), float(e.tag in ("li", "td", "th", "dd", "dt")), min(1.0, text.count(",") / 3),
        e.share, float(e.headline), float("©" in text or "(c)" in text[:40].lower()),
    ]


@dataclass(frozen=True)
class Labeller:
    """Weights of features, and strengths of the edges between neighbours and between siblings."""

    weights: tuple[float, ...]
    adjacent: float
    sibling: float

    def preference(self, block: Block) -> float:
        """What calling the block boilerplate costs more than calling it content."""
        return sum(w * x for w, x in zip(self.weights, features(block), strict=True))

    def labels(self, page: list[Block]) -> list[bool]:
        if len(page) == 1 and not page[0].home.tag:
            return [True]
        return min_cut([self.preference(b) for b in page], edges(page, self.adjacent, self.sibling))


def _apart(a: Element, b: Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def _border(a: Element, b: Element) -> int:
    """Steps for the article, side matter, or what is named as such, beginning or ending between two blocks."""
    return 2 * ((a.article != b.article) + (a.side != b.side) + (a.header != b.header) + (abs(a.side_word - b.side_word) >= 0.5))


def edges(page: list[Block], adjacent: float, sibling: float) -> list[tuple[int, int, float]]:
    """Halved with each step in the DOM beyond siblings, and with each step of a border."""
    out, last = [], {}
    for i, b in enumerate(page):
        if i:
            a = page[i - 1].home
            out.append((i - 1, i, adjacent / 2 ** (max(0, min(20, _apart(a, b.home) - 2)) + _border(a, b.home))))
        key = id(b.home.parent)
        if key in last and last[key] != i - 1:
            out.append((last[key], i, sibling / 2 ** _border(page[last[key]].home, b.home)))
        last[key] = i
    return out


def min_cut(prefer: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: pay |prefer| for going against it, and an edge's weight for cutting it.

    Where two cuts cost the same, nodes reachable from the content terminal are content."""
    n = len(prefer)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, w in links:
        near[i].append((j, w))
        near[j].append((i, w))
    label: list[bool | None] = [None] * n
    pull = list(prefer)
    loose = [sum(w for _, w in x) for x in near]
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(pull[i]) > loose[i]:
            label[i] = pull[i] > 0
            for j, w in near[i]:
                if label[j] is None:
                    loose[j] -= w
                    pull[j] += w if label[i] else -w
                    todo.append(j)
    open_ = [i for i in range(n) if label[i] is None]
    if open_:
        s, t = n, n + 1
        graph: dict[int, dict[int, float]] = {i: {} for i in [*open_, s, t]}
        for i in open_:
            a, b = (s, i) if pull[i] > 0 else (i, t)
            graph[a][b] = graph[a].get(b, 0) + abs(pull[i])
            graph[b].setdefault(a, 0)
            for j, w in near[i]:
                if label[j] is None:
                    graph[i][j] = graph[i].get(j, 0) + w
        while True:
            # Shortest augmenting paths.
            back, queue = {s: s}, deque([s])
            while queue and t not in back:
                u = queue.popleft()
                for v, c in graph[u].items():
                    if c > 1e-12 and v not in back:
                        back[v] = u
                        queue.append(v)
            if t not in back:
                break
            path, v = [], t
            while v != s:
                path.append((back[v], v))
                v = back[v]
            flow = min(graph[u][v] for u, v in path)
            for u, v in path:
                graph[u][v] -= flow
                graph[v][u] = graph[v].get(u, 0) + flow
        for i in open_:
            label[i] = i in back
    return [bool(x) for x in label]


@cache
def labeller() -> Labeller:
    """The trained labeller; training takes a second, and gives the same weights anywhere."""
    from logweir.llm.html_training import train

    return train()


def extract(html: str | None, how: Labeller | None = None) -> str:
    """The main text of a page."""
    page = blocks(html or "")
    keep = (how or labeller()).labels(page)
    return " ".join(b.text for b, k in zip(page, keep, strict=True) if k)


def extract_pages(pages: DataFrame) -> DataFrame:
    # Trained once, here; tasks get the weights.
    how = labeller()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, how) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
