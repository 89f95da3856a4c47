"""Main text of web pages by scoring the element tree.

A page is read into a tree of elements, leniently. Every text block (paragraph)
passes points for its length and commas to its ancestors, fewer with each step;
a container's points are discounted by the share of its text that is links. The
article or main element around the best container is kept whole. Beside it, or
on every level above the best container where there is none, what scores like
it or is not mostly links is kept. Menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are cut from the tree before anything is scored. A form, or an element
whose name only contains such a word (``has-sidebar``, ``no-ads``), is a wrapper
and stays if most of the page's paragraphs are in it, and its headline or
article too if the page has one.
"""
from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: how HTML and its authors name things
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe noembed noframes xmp".split())
BLOCK = set("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption
 figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary
 table tbody td tfoot th thead tr ul""".split())
CUT = set("""script style noscript template textarea title iframe noembed noframes head nav menu aside button
 select option fieldset dialog svg canvas object audio video footer""".split())
CUT_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
PROSE = set("p pre blockquote".split())
HEADLINE = set("h1 article main".split())
READERS = ("comment", "respond", "replies", "disqus")  # a name that begins so is what readers wrote
CUT_NAMES = set("""nav navbar navigation menu breadcrumb breadcrumbs footer sidebar cookie cookies consent gdpr notice
 banner ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments respond
 replies disqus share sharing social related recommended newsletter subscribe popup modal overlay toolbar login
 signup search pagination pager masthead topbar""".split())
GOOD_NAMES = set("article post entry content story text body main".split())
CLOSES = {  # an opening tag ends an open element of these kinds
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
    "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = set("table ul ol dl td th article section main body html div aside nav header footer form blockquote".split())

_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_END = {tag: re.compile(rf"</{tag}\s*>?", re.I) for tag in RAW}


@dataclass(frozen=True)
class Settings:
    chars_a_point: int = 100  # of a paragraph, up to ``length_points``
    length_points: float = 3.0
    levels: int = 5  # ancestors that get points
    sibling_share: float = 0.2  # of the best score that a sibling must reach
    most_links: float = 0.25  # link density of a paragraph kept beside the best container


@dataclass
class Block:
    node: int
    text: str
    links: int  # characters of it inside links


class Page:
    """Elements in page order (a parent before its children), and the text blocks."""

    def __init__(self, source: str):
        self.tag, self.parent, self.good, self.cut = ["#root"], [-1], [False], [False]
        self.doubt = [False]  # cut unless it turns out to be a wrapper
        self.blocks: list[Block] = []
        self._open = [0]  # the path to the current element
        self._count: dict[str, int] = {}  # open elements by tag
        self._parts: list[str] = []
        self._links = 0
        at = 0
        while at < len(source):
            mark = _MARK.search(source, at)
            if not mark:
                self._text(source[at:])
                break
            if mark.start() > at:
                self._text(source[at: mark.start()])
            at = mark.end()
            name = mark.group(2) or mark.group(5)
            if not name:
                if mark.group().startswith("<![CDATA["):
                    self._text(html.escape(mark.group()[9:].removesuffix("]]>"), quote=False))
                continue
            tag = name.lower()
            if mark.group(1) or mark.group(4):
                self._close(tag)
                continue
            self._begin(tag, mark.group(3) or mark.group(6) or "")
            if tag in RAW:
                end = _END[tag].search(source, at)
                at = end.end() if end else len(source)
                self._close(tag)
        self._flush()
        if any(self.doubt):
            self._settle()

    def _settle(self) -> None:
        """Decide on the elements in doubt, the outer ones first, and drop the text of those that go."""
        n = len(self.tag)
        prose, heads, headed = [0] * n, [0] * n, [False] * n
        for node in range(1, n):
            headed[node] = self.tag[node] in HEADLINE or headed[self.parent[node]]
        for block in self.blocks:
            if self.tag[block.node] in PROSE:
                prose[block.node] += len(block.text) - block.links
            heads[block.node] += headed[block.node]
        for node in range(n - 1, 0, -1):
            prose[self.parent[node]] += prose[node]
            heads[self.parent[node]] += heads[node]
        gone = [False] * n
        for node in range(1, n):
            wraps = 2 * prose[node] > prose[0] and (heads[node] > 0 or not heads[0])
            gone[node] = gone[self.parent[node]] or (self.doubt[node] and not wraps)
        self.blocks = [block for block in self.blocks if not gone[block.node]]

    def _flush(self) -> None:
        if self._parts:
            text = " ".join(html.unescape("".join(self._parts)).split())
            if text:
                node = next(n for n in reversed(self._open) if n == 0 or self.tag[n] in BLOCK)
                self.blocks.append(Block(node, text, min(self._links, len(text))))
            self._parts, self._links = [], 0

    def _text(self, text: str) -> None:
        if not self.cut[self._open[-1]]:
            self._parts.append(text)
            if self._count.get("a"):
                self._links += len(" ".join(text.split()))

    def _pop(self) -> None:
        tag = self.tag[self._open.pop()]
        self._count[tag] -= 1

    def _end_open(self, tags: set) -> None:
        """End the nearest open element of ``tags`` inside the current scope."""
        if not any(self._count.get(t) for t in tags):
            return
        for i in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[i]]
            if tag in tags:
                while len(self._open) > i:
                    self._pop()
                return
            if tag in SCOPE:
                return

    def _begin(self, tag: str, raw: str) -> None:
        if tag == "br":
            self._text(" ")
            return
        if tag in BLOCK:
            self._flush()
            self._end_open({"p"})
        if tag in CLOSES:
            self._end_open(CLOSES[tag])
        if tag in VOID:
            return
        above = self._open[-1]
        cut, good, doubt = self.cut[above] or tag in CUT, False, tag == "form"
        if tag == "header" and not (self._count.get("article") or self._count.get("main")):
            cut = True
        if raw and not cut and tag not in ("html", "body"):
            cut, good, named = self._judge(tag, raw)
            doubt |= named
        self.tag.append(tag)
        self.parent.append(above)
        self.cut.append(cut)
        self.good.append(good or tag in ("article", "main"))
        self.doubt.append(doubt and not cut)
        self._open.append(len(self.tag) - 1)
        self._count[tag] = self._count.get(tag, 0) + 1

    def _judge(self, tag: str, raw: str) -> tuple[bool, bool, bool]:
        """Whether attributes say that an element is no content, that it is, or that it may be none."""
        cut, doubt, whole, names = False, False, set(), set()
        for key, *values in _ATTRIBUTE.findall(raw):
            key, value = key.lower(), next((v for v in values if v), "")
            if key in ("class", "id"):
                whole.update(value.lower().split())
                names.update(x.lower() for x in _NAME.findall(value))
            elif key == "role":
                cut |= value.lower() in CUT_ROLES
                doubt |= value.lower() == "form"
            elif key == "aria-hidden":
                cut |= value.lower() == "true"
            elif key == "style":
                cut |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
        cut |= re.search(r"(?:^|\s)hidden(?=\s|=|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", raw)) is not None
        if tag not in ("article", "main"):
            inside = self._count.get("article") or self._count.get("main")
            cut |= bool(whole & CUT_NAMES) or any(x.startswith(READERS) for x in whole)
            cut |= "header" in names and not inside
            doubt |= bool(names & CUT_NAMES)
        return cut, bool(names & GOOD_NAMES), doubt

    def _close(self, tag: str) -> None:
        if tag in ("br", "p") and not self._count.get(tag):
            self._flush()
            return
        if not self._count.get(tag):
            return
        if tag in BLOCK:
            self._flush()
        while self.tag[self._open[-1]] != tag:
            if self.tag[self._open[-1]] in BLOCK:
                self._flush()
            self._pop()
        self._pop()


def main_text(source: str | None, use: Settings = Settings()) -> str:
    """The main text of a page: its blocks in page order, one a line; empty if none."""
    page = Page(source or "")
    if not page.blocks:
        return ""
    n = len(page.tag)
    points, chars, links, commas = [0.0] * n, [0] * n, [0] * n, [0] * n
    for block in page.blocks:
        size = len(block.text)
        value = 1 + block.text.count(",") + min(size / use.chars_a_point, use.length_points)
        value *= 1 - block.links / size
        chars[block.node] += size
        links[block.node] += block.links
        # a paragraph's container gets all of it, the ones above ever less
        node = page.parent[block.node] if block.node else 0
        for level in range(use.levels):
            if node < 0:
                break
            points[node] += value / (1, 2, 6, 9, 12)[min(level, 4)]
            node = page.parent[node]
    for node in range(n - 1, 0, -1):
        chars[page.parent[node]] += chars[node]
        links[page.parent[node]] += links[node]
    scores = [0.0] * n
    for node in range(n):
        if chars[node]:
            bonus = 25.0 if page.good[node] and points[node] else 0.0
            scores[node] = (points[node] + bonus) * (1 - links[node] / chars[node])
    best = max(range(n), key=lambda k: (scores[k], -k))
    score = scores[best]
    around = [best]  # the best element and those that hold it, the outermost last
    while around[-1]:
        around.append(page.parent[around[-1]])
    whole = next((node for node in around if page.tag[node] in ("article", "main")), None)
    if whole is not None:
        around = around[around.index(whole):][:2]
    kept, above = {around[0]}, set(around[1:])
    for node in range(1, n):
        if page.parent[node] not in above or node in above or not chars[node]:
            continue
        density, tag = links[node] / chars[node], page.tag[node]
        text = whole is None or tag in ("p", "blockquote", "pre", "h1", "h2", "h3", "ul", "ol", "table", "figure")
        if scores[node] >= max(1.0, use.sibling_share * score) or (text and density < use.most_links):
            kept.add(node)
    inside = [False] * n
    for node in range(n):
        inside[node] = node in kept or (node > 0 and inside[page.parent[node]])
    loose = above if whole is None else set()  # text of their own, in no block inside
    return "\n".join(block.text for block in page.blocks if inside[block.node] or (
        block.node in loose and block.links < use.most_links * len(block.text)))


def extracted(pages: DataFrame, use: Settings = Settings()) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    Null and empty html give an empty text, and so do pages that are all menu
    or advert or form. Character references are decoded; white space inside a block is
    one space. Nothing else is dropped or cut short. Rows that repeat are each
    answered.
    """
    rows = pages.select("page_id", "url", F.col("html").cast("string"))
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [main_text(x, use) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)
