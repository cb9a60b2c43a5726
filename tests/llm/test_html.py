import re
import time
from html.parser import HTMLParser

import pytest

from strandloom.llm.html import HIDDEN, VOID, extract, visible_text

CASES = {
    "<p>One<p>Two &amp; <b>three</b>\n four": "One\n\nTwo & three four",
    "<ul><li>a<li>b<ol><li>x</li><li>y</ol></ul>z": "- a\n- b\n  1. x\n  2. y\n\nz",
    "<table><tr><th>Name<th>N<tr><td>ab<td>1<tr><td>abcdef<td>22</table>": "Name    N\nab      1\nabcdef  22",
    "<table><tbody><tr><td colspan=2>wide</td><td>c</td></tr><tr><td>1<td>2<td>3</table>": "wide     c\n1     2  3",
    "<div>a</div><div hidden>b</div><div style='display: none'>c</div><span style=\"visibility:hidden\">d</span>e": "a\ne",
    "<head><title>T</title></head><body>x<script>var a = '</p>';</script>y<!-- no -->z<style>p{}</style>": "xyz",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<pre>a\n  b\n\nc</pre>d": "a\n  b\n\nc\n\nd",
    "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
    "x<a href='>'>y</a><img alt='pic'>": "xypic",
    "ok <b unfinished": "ok",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "": "", None: "",
}


@pytest.mark.parametrize("html", list(CASES))
def test_layout(html):
    assert visible_text(html) == CASES[html]


class Plain(HTMLParser):
    """A renderer for the given pages' elements, by events alone: no tree, breaks between the pieces of text.

    A break is the number of blank lines that it asks for; of breaks that follow each other the largest counts.
    """

    GAP = dict.fromkeys("p h1 ul".split(), 1) | dict.fromkeys("html body div nav article footer li".split(), 0)

    def __init__(self):
        super().__init__()
        self.lines, self.line, self.gap, self.mark, self.hidden, self.paragraph = [], "", 0, "", [], False

    def border(self, tag, paragraph):
        """Begins or ends a block, and the paragraph that is still open with it."""
        self.breaks(1 if self.paragraph else self.GAP[tag])
        self.breaks(self.GAP[tag])
        self.paragraph = paragraph

    def breaks(self, gap):
        if self.line.strip():
            self.lines.append(self.line.rstrip(" "))
        self.line, self.gap = "", max(self.gap, gap)

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden.append(tag)
        elif not self.hidden and tag in self.GAP:
            self.border(tag, tag == "p")
            self.mark = "- " if tag == "li" else self.mark
        elif not self.hidden and tag == "br":
            if not self.line:
                self.handle_data("\0")
            self.breaks(0)

    def handle_endtag(self, tag):
        if self.hidden:
            self.hidden = self.hidden[:-1] if tag == self.hidden[-1] else self.hidden
        elif tag in self.GAP:
            self.border(tag, False)

    def handle_data(self, data):
        data = re.sub(r"[ \t\n\r\f]+", " ", data)
        if self.hidden or not (data.lstrip(" ") if not self.line else data):
            return
        if not self.line:
            self.lines += [""] * (self.gap if self.lines else 0)
            self.line, self.gap, self.mark = self.mark, 0, ""
            data = data.lstrip(" ")
        self.line += data[1:] if self.line.endswith(" ") and data[0] == " " else data

    def text(self):
        self.breaks(0)
        return "\n".join(self.lines).replace("\0", "")


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_pages(spark, size):
    """Every given page, line by line."""
    df = spark.read.parquet(f"/root/testdata/{size}/pages.parquet")
    pages = {r["page_id"]: r["html"] for r in df.collect()}
    got = {r["page_id"]: r["text"] for r in extract(df).collect()}
    assert got.keys() == pages.keys()
    for key, html in pages.items():
        plain = Plain()
        plain.feed(html)
        plain.close()
        assert got[key] == plain.text(), key


def test_cells_are_blocks():
    assert visible_text("<table><tr><td><h1>Title</h1><p>one<p>two<ul><li>x<li>y</ul></table>") == "Title\n\none\n\ntwo\n\n- x\n- y"
    assert visible_text("<table><tr><td><table><tr><td>A<td>B<tr><td>1<td>2</table><td>side</table>") == "A  B  side\n1  2"
    assert visible_text("<table><tr><td><pre>a\n  b</pre><td>c<tr><td>longer<td>d</table>") == "a       c\n  b\nlonger  d"
    assert visible_text("<ul><li><table><tr><td>a<br>b<td>c</table></ul>") == "- a  c\n  b"
    assert visible_text("<table><tr><td><p>a<p>b<td>x<br>y<br>z</table>") == "a  x\n   y\nb  z"
    assert visible_text("<table><tr><td>a<p>b</table>z") == "a\n\nb\n\nz"
    assert visible_text("<table><tr><td colspan=3>a<td>b</table>") == "a  b"
    long = "x" * 300
    assert visible_text(f"<table><tr><td>{long}<td>b<tr><td>cc<td>d</table>") == f"{long}  b\ncc  d"
    assert visible_text("<table>" + "<tr><td>" + "".join(f"<td>{'y' * 70}" for _ in range(6)) + "<tr><td colspan=6>q<td>r</table>").split("\n")[1] == "q" + " " * 0 + "  r"


def test_tables_grow_with_their_text():
    """Neither spans nor wide columns nor nesting make more than some twenty letters of one."""
    for page in ("<table>" + "<tr><td colspan=1000>a<td colspan=1000>b" * 5000, "<table>" + "<tr><td rowspan=0 colspan=1000>a" * 5000, "<table><tr><td>" + "w" * 80 + "<td>" + "w" * 80 + "<td>c" + "<tr><td>a<td>b<td>c" * 20_000, "<table><tr><td>" * 60 + "x" + "<td>y" * 3000):
        began = time.time()
        assert len(visible_text(page)) < 20 * len(page) and time.time() - began < 20


def test_closed_details():
    assert visible_text("a<details>no<summary>S <b>t</b></summary>hidden<p>x</details>b") == "a\nS t\nb"
    assert visible_text("<details open><summary>T</summary>seen</details>") == "T\nseen" and visible_text("<details>x</details>y") == "y"


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "<p>a", "x"), (3, "<p>a", "x"), (3, "<p>a", "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    assert sorted((r["page_id"] or -1, r["text"]) for r in extract(df).collect()) == [(-1, "a"), (1, ""), (2, ""), (3, "a"), (3, "a")]
    assert extract(df.limit(0)).collect() == []


def test_long_and_deep():
    start = time.time()
    assert visible_text("<div>" * 50_000 + "x" + "</div>" * 50_000) == "x"
    assert visible_text("<a \"" * 50_000) == ""
    assert len(visible_text("<p>a</p>" * 50_000).split("\n\n")) == 50_000
    visible_text("<" * 200_000), visible_text("<!--" * 50_000), visible_text("<ul><li>" * 20_000 + "deep")
    assert time.time() - start < 60


def test_cells_imply_rows():
    assert visible_text("<table><tbody><td>a<td>b</table>") == "a  b"
    assert visible_text("<table><td>a<th>b<tr><td>c</table>") == "a  b\nc"
    assert visible_text("<table><colgroup><col><tr><td>a<td>b</table>") == "a  b"
    assert visible_text("<table><caption>t<td>a<tfoot><b><td>z</b></table>") == "t\na\nz"


def test_stray_content_of_sections():
    assert visible_text("<table><thead>up<tr><th>a</thead><tbody><p>in</p><tr><td>b</tbody><tfoot>down</table>x") == "up\n\nin\n\ndown\na\nb\n\nx"
    assert visible_text("<table><tbody hidden>no<tr><td>no</tbody><tbody>yes</table>") == "yes"


def test_spans_of_rows():
    assert visible_text("<table><tr><td rowspan=2>A<td>1<tr><td>2</table>") == "A  1\n   2"
    assert visible_text("<table><tr><td>x<td rowspan=0 colspan=2>B<td>1<tr><td>y<td>2<tr><td>z<td>3<tbody><tr><td>p<td>q</table>") == "x  B  1\ny     2\nz     3\np  q"
    assert visible_text("<table><tr><td colspan=99999>a<td>b</table>").split() == ["a", "b"]


def test_list_numbers():
    assert visible_text("<ol start=5><li>a<li value=9>b<li>c</ol>") == "5. a\n9. b\n10. c"


def test_visible_inside_invisible():
    assert visible_text("<div style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</div>d") == "b\nd"
    assert visible_text("<table><tr style='visibility:hidden'><td>a<td style='visibility:visible'>b<tr><td>c<td>d</table>") == "   b\nc  d"
    assert visible_text("<ul><li style='visibility:hidden'>a<li>b</ul>") == "- b"
