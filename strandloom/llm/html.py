"""Visible text of web pages, laid out as a reader sees it.

A tree is built from the tags, with the ends that HTML implies. What is not shown is left out. Blocks stand on lines
of their own, paragraphs and headings apart, list items behind marks, and table cells in aligned columns.
Of form controls, the texts of textarea, select with its options and datalist, and the values of input are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import slices, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template iframe object svg math canvas audio video select datalist textarea title".split())
RAW = frozenset("script style textarea title noscript iframe template".split()) - {"noscript", "template"}
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr".split())
BLOCK = APART | frozenset("html body div section article aside header footer nav main address form fieldset legend figcaption details summary li dt dd tr caption thead tbody tfoot hgroup search dialog center menu".split())
CLOSES_P = BLOCK - frozenset("html body tr caption thead tbody tfoot".split())
#: Elements that a start tag ends, and the elements at which the search for them stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}), "th": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "caption", "colgroup"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
SECTIONS = frozenset("thead tbody tfoot colgroup".split())
SCOPES = frozenset("table td th caption html template".split())
#: Letters of a line that widen its column, and the last place of a line at which a column may begin aligned.
WIDE, ALIGNED = 80, 240
#: Deeper elements join the one at this depth; their text stays.
DEEPEST = 200
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]++))?")
SPACE = re.compile(r"[ \t\n\r\f]+")
UNSEEN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.IGNORECASE)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def attribute(self, name: str) -> str | None:
        if name not in self.attrs.lower():
            return None
        for key, value in ATTRIBUTE.findall(self.attrs):
            if key.lower() == name:
                return unescape(value[1:-1] if value[:1] in "\"'" and value else value)
        return None

    def shown(self) -> bool:
        if self.tag in HIDDEN:
            return False
        if not self.attrs:
            return True
        return self.attribute("hidden") is None and not UNSEEN.search(self.attribute("style") or "") and not (self.tag == "dialog" and self.attribute("open") is None)

    def unseen(self, now: bool) -> bool:
        """Whether its own text is invisible, ``now`` being so for what it stands in; children may be visible again."""
        m = VISIBILITY.search(self.attribute("style") or "") if self.attrs else None
        return now if m is None else m[1].lower() != "visible"

    def number(self, name: str, default: int) -> int:
        """An attribute that is a whole number."""
        m = re.match(r"\s*([+-]?[0-9]{1,9})", self.attribute(name) or "", re.ASCII)
        return int(m[1]) if m else default


def build(html: str) -> Node:
    """The tree of a page. Comments and declarations go; an unfinished tag ends the page, as in browsers."""
    root = Node("html")
    stack, at, n = [root], 0, len(html)

    open_now: Counter[str] = Counter()

    def cut(i: int) -> None:
        open_now.subtract(x.tag for x in stack[i:])
        del stack[i:]

    def pop_to(names: set[str], stop: set[str] | frozenset[str]) -> None:
        if not any(open_now[x] for x in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                cut(i)
                while len(stack) > 1 and stack[-1].tag in names and stack[-1].tag not in stop:  # a row holds a cell
                    cut(len(stack) - 1)
                return
            if stack[i].tag in stop:
                return

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            stack[-1].children.append(html[at:])
            break
        if lt > at:
            stack[-1].children.append(html[at:lt])
        mark = html[lt + 1 : lt + 2]
        if mark in ("!", "?"):
            close, more = ("-->", 3) if html.startswith("<!--", lt) else (">", 1)
            end = html.find(close, lt + (4 if more == 3 else 2) - (more == 3 and html.startswith("<!-->", lt)) * 2)
            at = n if end < 0 else end + more
            continue
        m = TAG.match(html, lt)
        if not m:
            if mark.isascii() and mark.isalpha() or mark == "/" and html[lt + 2 : lt + 3].isalpha():
                break
            stack[-1].children.append("<")
            at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag == "p" or tag not in SCOPES and tag not in ("body", "ul", "ol", "tr", "tbody", "thead", "tfoot"):
                stop = SCOPES
            else:
                stop = {"html"}
            if tag not in ("html", "body"):
                pop_to({tag}, stop - {tag})
            continue
        if tag == "html" or tag == "body" and open_now["body"]:
            continue
        if tag in CLOSES_P:
            pop_to({"p"}, SCOPES)
        if tag in ENDS:
            pop_to(*ENDS[tag])
        if tag in ("td", "th"):  # the row that a cell implies
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SECTIONS or stack[i].tag == "table":
                    cut(i + 1)
                    row = Node("tr")
                    (stack[-1] if len(stack) <= DEEPEST else stack[DEEPEST]).children.append(row)
                    stack.append(row)
                    open_now["tr"] += 1
                    break
                if stack[i].tag == "tr" or stack[i].tag in SCOPES:
                    break
        node = Node(tag, m[3])
        (stack[-1] if len(stack) <= DEEPEST else stack[DEEPEST]).children.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(html, at)
            node.children.append(html[at : end.start() if end else n])
            close = html.find(">", end.end()) if end else -1
            at = n if close < 0 else close + 1
        elif tag not in VOID and not (m[3].endswith("/") and tag in ("svg", "path")):
            stack.append(node)
            open_now[tag] += 1
    return root


class Page:
    """Lines under construction."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0
        self.lead: list[str] = []
        self.mark = ""
        self.unseen = False

    def word(self, text: str) -> None:
        """Flowing text: any white space is one blank between words, and none at a line's ends."""
        if not text or self.unseen:
            return
        core = SPACE.sub(" ", text)
        if core[0] == " ":
            self.space, core = True, core[1:]
        if not core:
            return
        tail = core[-1] == " "
        self.put(core[:-1] if tail else core)
        self.space = tail

    def put(self, text: str) -> None:
        if self.unseen:
            return
        if not self.line:
            if self.lines:
                self.lines += [""] * self.gap
            self.line.append("".join(self.lead[: -1 if self.mark else None]) + self.mark)
            self.gap, self.mark = 0, ""
        elif self.space:
            self.line.append(" ")
        self.line.append(text)
        self.space = False

    def end(self, gap: int = 0) -> None:
        """Ends the line; the next one stands ``gap`` blank lines below."""
        if self.line:
            self.lines.append("".join(self.line))
            self.line = []
        self.space = False
        self.gap = max(self.gap, gap)

    def text(self) -> str:
        self.end()
        return "\n".join(self.lines)


def block_of(node: Node, unseen: bool) -> list[str]:
    """The lines of a cell, laid out as a page of its own."""
    page = Page()
    page.unseen = unseen
    for c in node.children:
        render(c, page)
    text = page.text()
    return text.split("\n") if text else []


def rows_of(node: Node, unseen: bool) -> Iterator[tuple[Node, bool, int]]:
    """The rows of a table, whether their text is invisible, and a number for the section that each stands in."""
    for k, c in enumerate(node.children):
        if isinstance(c, Node) and c.shown():
            if c.tag == "tr":
                yield c, c.unseen(unseen), -1
            elif c.tag in SECTIONS:
                for row, hidden, _ in rows_of(c, c.unseen(unseen)):
                    yield row, hidden, k


def strays_of(node: Node) -> Iterator[Node | str]:
    """What stands in a table or its sections, but in no row."""
    for c in node.children:
        if isinstance(c, Node) and c.tag in SECTIONS:
            if c.shown():
                yield from strays_of(c)
        elif isinstance(c, str) or c.tag != "tr":
            yield c


class Taken:
    """Columns that cells of rows above reach into: (from, upto, last row, -1 for all rows of the section)."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int, int]] = []
        self.at = 0

    def row(self, number: int) -> None:
        """Begins a row: spans that end above it go."""
        self.spans = [x for x in self.spans if x[2] < 0 or x[2] >= number]
        self.at = 0

    def free(self, column: int) -> int:
        """The first free column from this one on; a row asks from left to right."""
        while self.at < len(self.spans) and self.spans[self.at][0] <= column:
            column = max(column, self.spans[self.at][1])
            self.at += 1
        return column

    def add(self, new: list[tuple[int, int, int]]) -> None:
        """Ends a row, with the spans that begin in it; neighbours that end in one row become one."""
        merged: list[tuple[int, int, int]] = []
        for x in sorted(self.spans + new):
            if merged and merged[-1][1] == x[0] and merged[-1][2] == x[2]:
                merged[-1] = (merged[-1][0], x[1], x[2])
            else:
                merged.append(x)
        self.spans = merged


def render_table(node: Node, page: Page) -> None:
    """A caption and stray content first, then the rows: cells are blocks of lines, side by side in aligned columns.

    A column is as wide as its longest line of up to ``WIDE`` letters; a longer one pushes what stands right of it. Columns
    without text take no room, and a table of one column is its blocks as they are. Columns that would begin behind
    ``ALIGNED`` letters follow by two blanks, so a row's line is longer than its text by about as much at most.
    """
    for c in strays_of(node):
        render(c, page)
    page.end()
    grid: list[list[tuple[int, list[str]]]] = []
    taken, section, number = Taken(), None, 0
    for row, unseen, part in rows_of(node, page.unseen):
        if part != section:
            taken, section = Taken(), part
        number += 1
        taken.row(number)
        cells, new, column = [], [], 0
        for c in row.children:
            if isinstance(c, Node) and c.tag in ("td", "th"):
                if c.shown():
                    column = taken.free(column)
                    wide, high = min(max(c.number("colspan", 1), 1), 1000), min(max(c.number("rowspan", 1), 0), 65534)
                    if high != 1:
                        new.append((column, column + wide, number + high - 1 if high else -1))
                    if lines := block_of(c, c.unseen(unseen)):
                        cells.append((column, lines))
                    column += wide
            elif isinstance(c, Node) or c.strip():
                was, page.unseen = page.unseen, unseen
                render(c, page)
                page.unseen = was
        taken.add(new)
        if cells:
            grid.append(cells)
    page.end()
    widths: dict[int, int] = {}
    for cells in grid:
        for column, lines in cells:
            widths[column] = max(widths.get(column, 0), max((len(x) for x in lines if len(x) <= WIDE), default=1))
    starts, at = {}, 0
    for column in sorted(widths):
        starts[column] = at
        at += widths[column] + 2
    for cells in grid:
        i, blank = 0, 0
        while cells:
            line = ""
            for column, lines in cells:
                if lines[i]:
                    if line:
                        line += "  "
                    line = (line.ljust(starts[column]) if starts[column] <= ALIGNED else line) + lines[i]
            if line:
                page.end(blank)
                page.put(line)
                blank = 0
            else:
                blank += 1
            i += 1
            cells = [c for c in cells if len(c[1]) > i]
        page.end()


def render(node: Node | str, page: Page, pre: bool = False) -> None:
    if isinstance(node, str):
        text = unescape(node) if "&" in node else node
        if not pre:
            page.word(text)
            return
        for i, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if i:
                if not page.line:
                    page.put("")
                page.end()
            if line:
                page.put(line)
        return
    if not node.shown():
        return
    was, page.unseen = page.unseen, node.unseen(page.unseen)
    render_element(node, page, pre)
    page.unseen = was


def render_element(node: Node, page: Page, pre: bool) -> None:
    tag = node.tag
    if tag == "br":
        if not page.line:
            page.put("")
        page.end()
        return
    if tag == "img":
        page.word(node.attribute("alt") or "")
        return
    if tag not in BLOCK:
        for c in node.children:
            render(c, page, pre)
        if tag in ("td", "th"):
            page.word(" ")
        return
    if tag == "details" and node.attribute("open") is None:  # closed: only its summary is seen
        page.end()
        for c in [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]:
            render(c, page, pre)
        page.end()
        return
    gap = int(tag in APART and not (tag in ("ul", "ol") and len(page.lead) > 0))
    page.end(gap)
    if tag == "hr":
        page.put("---")
    elif tag == "table":
        render_table(node, page)
    elif tag in ("ul", "ol", "menu"):
        number = node.number("start", 1) - 1
        for c in node.children:
            if isinstance(c, Node) and c.tag == "li" and c.shown():
                number = c.number("value", number + 1)
                mark = f"{number}. " if tag == "ol" else "- "
                page.end()
                page.lead.append(" " * len(mark))
                page.mark = mark
                was, page.unseen = page.unseen, c.unseen(page.unseen)
                for x in c.children:
                    render(x, page)
                page.unseen = was
                page.end()
                page.gap = 0 if c is not node.children[-1] else page.gap
                page.mark = ""
                page.lead.pop()
            else:
                render(c, page)
    else:
        if tag in ("blockquote", "dd"):
            page.lead.append("  ")
        for c in node.children:
            render(c, page, pre or tag == "pre")
        if tag in ("blockquote", "dd"):
            page.end()
            page.lead.pop()
    page.end(gap)


def visible_text(html: str | None) -> str:
    page = Page()
    if html:
        render(build(html), page)
    return page.text()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_lines, n_chars of every row of ``pages``.

    Null and empty pages give empty text. Whole pages are rendered, however long. Each row has its own result, so
    equal rows have equal ones. No rows: no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 8 << 20):
            texts = [visible_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string()), pa.array([t.count("\n") + bool(t) for t in texts], pa.int64()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "text", "n_lines", "n_chars"])

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(run, "page_id long, text string, n_lines long, n_chars long")


def op7_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
