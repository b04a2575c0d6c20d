import random
from html.parser import HTMLParser

import pytest

from areasignal.llm import html_layout as h


def test_blocks_and_hidden():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><script>if (a<b) x("</p>")</script>
    <h1>Head</h1><p>One <b>two</b>
    three<p>Four<br>five<div>six</div><!-- no --><p hidden>gone</p><div style="display: none">gone</div>
    <p style="visibility:hidden">gone <i style="visibility:visible">seen</i></p><noscript>gone</noscript>&lt;&amp;&nbsp;x"""
    assert h.render(page) == "Head\n\nOne two three\n\nFour\nfive\n\nsix\n\nseen\n\n<& x"


def test_lists():
    assert h.render("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>end") == "- a\n- b\n  3. c\n  4. d\n\nend"
    assert h.render("<dl><dt>t<dd>d</dl>") == "t\n  d"


def test_tables_are_aligned():
    page = "<table><caption>C</caption><tr><th>Name<th>n<tr><td>long name<td>1<tr><td colspan=2>both</table>"
    assert h.render(page) == "C\nName      | n\nlong name | 1\nboth"
    assert h.render("<table><tr><td>東京<td>x<tr><td>abcde<td>y</table>") == "東京  | x\nabcde | y"
    assert h.render("<table><tr><td><p>a<p>b</table>") == "a\n\nb"


def test_pre_and_quote():
    assert h.render("<pre>\n a\n  b\n</pre><blockquote>q<br>r</blockquote>") == " a\n  b\n\n> q\n> r"


def test_broken_markup():
    assert h.render("a < b and <c") == "a < b and"
    assert h.render("<p>x</div></span>y</p></p>z") == "x y".replace(" ", "") + "\n\nz"
    assert h.render(None) == h.render("") == h.render("<script>") == ""
    assert h.render("<i>" * 5000 + "deep") == "deep"
    assert h.render("<ul><li>" * 3000 + "deep").endswith("deep")
    assert h.render('<p title="a>b" data-hidden=1>kept') == "kept"


class Slow(HTMLParser):
    """An independent renderer of pages of paragraphs, headings, breaks, sections and one level of dashed lists."""

    WIDE, NARROW, UNSEEN = {"p", "h1", "ul"}, {"div", "article", "nav", "footer", "li", "body"}, {"script", "style", "title"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.now, self.unseen, self.gap, self.mark, self.open_p = [], "", 0, 0, "", False

    def space(self, gap):
        if text := " ".join(self.now.split()):
            if self.gap == 2 and self.lines:
                self.lines.append("")
            self.lines.append(self.mark + text)
            self.mark, self.gap = "", 0
        self.now, self.gap = "", max(self.gap, gap)

    def handle_starttag(self, tag, attrs):
        self.unseen += tag in self.UNSEEN
        if tag == "br":
            self.space(1)
        elif tag in self.WIDE | self.NARROW:
            self.space(1 + (tag in self.WIDE or self.open_p))
            self.open_p = tag == "p"
            self.mark = "- " if tag == "li" else ""

    def handle_endtag(self, tag):
        self.unseen -= tag in self.UNSEEN
        if tag in self.WIDE | self.NARROW:
            self.space(1 + (tag in self.WIDE or self.open_p))
            self.open_p = False

    def handle_data(self, data):
        self.now += data if not self.unseen else ""


def slow(page):
    parser = Slow()
    parser.feed(page)
    parser.close()
    parser.space(0)
    return "\n".join(parser.lines)


def test_whole_pages_against_an_independent_renderer(spark):
    rows = h.extract_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(rows) == len(pages) > 200
    for r in rows:
        assert r.text == slow(pages[r.page_id]), r.page_id


def test_pages_with_expected_text():
    for page, want in (
        ("<h2>A</h2><table><thead><tr><th>k<th>v<tbody><tr><td>one<td>1<tr><td>two<br>lines<td>2</table><p>B", "A\n\nk     | v\none   | 1\ntwo   | 2\nlines |\n\nB"),
        ("<ol><li>a<ul><li>b<ul><li>c</ul></ul><li><p>d<p>e</ol>", "1. a\n   - b\n     - c\n2. d\n\n   e"),
        ("<blockquote><blockquote>a</blockquote>b<ul><li>c</ul></blockquote>", "> > a\n>\n> b\n>\n> - c"),
        ("<table><tr><td>x<td><ul><li>a<li>b</ul><tr><td>long one<td>c</table>", "x        | - a\n         | - b\nlong one | c"),
        ("<p>a<table><tr><td>b<table><tr><td>c<td>d</table><td>e</table>f", "a\n\nb     | e\n      |\nc | d |\n\nf"),
        ("<dl><dt>t<dd>d<dl><dt>u<dd>e</dl></dl>", "t\n  d\n\n  u\n    e"),
        ("<div>a<span>b</span> <em>c</em><div>d</div>e</div>", "ab c\nd\ne"),
        ("<section hidden><p>x</section><details><summary>s</summary>t</details>", "s\nt"),
    ):
        assert h.render(page) == want, page


def test_depth_is_not_bounded():
    for n in (10, 4000):
        assert h.render("<blockquote>" * n + "deep") == "> " * n + "deep"
        assert h.render("<ul><li>" * n + "deep") == "- " * n + "deep"
        assert h.render("<table><tr><td>" * n + "deep<td>x") == "deep | x"
        assert h.render("<dl><dd>" * n + "deep") == "  " * n + "deep"


def test_edge_rows(spark):
    schema = "page_id long, html string, text string"
    df = spark.createDataFrame([(1, None, "t"), (1, "<p>a", "t"), (None, "", "t"), (2, "<p>" + "word " * 200_000, "t")], schema)
    got = h.extract_text(df).collect()
    assert sorted(len(r.text) for r in got) == [0, 0, 1, 999_999]
    assert h.extract_text(df.limit(0)).collect() == []


def test_hidden_is_an_attribute_of_its_own():
    page = '<p><a href="/hidden/gems">one</a> <i class="hidden md:block">two</i> <b title="a hidden gem">three</b> <u data-x="style=display:none">four</u><p HIDDEN="">gone<p class=x hidden=hidden>gone<p style="color:red; DISPLAY : none !important">gone<p hidden=until-found>five'
    assert h.render(page) == "one two three four\n\nfive"


def test_text_of_forms_and_drawings_is_shown():
    assert h.render("a<textarea>\nb &amp; c\n d</textarea>e") == "a\nb & c\n d\ne"
    assert h.render("a<select><option>b<option selected>c<option>d</select>e") == "a c e"
    assert h.render("<select><option disabled>a<option>b</select>") == "b"
    assert h.render("<select multiple><optgroup label=G><option>a<option hidden>x<option>b</select>") == "G\na\nb"
    assert h.render("<svg><title>x</title><defs><text>x</text></defs><rect width=1 /><g><text>a<tspan>b</tspan></text></g><text>c</text></svg>d") == "ab c d"


@pytest.mark.parametrize(("html", "want"), [
    ("<p class=it's>Hello</p><p>World</p><p>it's fine</p>", "Hello\n\nWorld\n\nit's fine"),
    ("<p title=\"a > b\">x</p><p data-'q>y</p>", "x\n\ny"),
    ("<p a='1'b=\"2\"c>x</p>", "x"),
    ("<p =x>one</p><p = y>two</p>", "one\n\ntwo"),
    ("<p x= >one</p><a href=/a/>two</a>", "one\n\ntwo"),
    ("<p x=\"never closed>one</p>", ""),
    ("<p \"x\">one</p>", "one"),
    ("a<!-->b<!--->c<!-- > -->d</>e</3>f", "abcdef"),
    ("<ol><li>a<li value=7>b<li>c</ol>", "1. a\n7. b\n8. c"),
    ("<ol reversed><li>a<li>b</ol><ol reversed start=9><li>c<li>d</ol>", "2. a\n1. b\n\n9. c\n8. d"),
    ("<details><summary>more</summary>text</details><dialog>no</dialog><dialog open>yes</dialog>", "more\ntext\nyes"),
])
def test_as_browsers_show_it(html, want):
    assert h.render(html) == want


def cells_of(rows):
    """Columns of the cells of a table by filling a grid row by row: {(row, column): text}, the grid's brute force."""
    grid = {}
    for i, row in enumerate(rows):
        j = 0
        for text, across, down in row:
            while (i, j) in grid:
                j += 1
            for y in range(i, min(len(rows), i + down)):
                for x in range(j, j + across):
                    grid[y, x] = text if (y, x) == (i, j) else ""
            j += across
    return grid


def test_row_spans_against_a_grid():
    assert h.render("<table><tr><td rowspan=2>A<td>B</tr><tr><td>C</tr></table>") == "A | B\n  | C"
    rng = random.Random(3)
    for _ in range(200):
        rows = [[(f"{i}.{j}", 1, rng.choice((1, 1, 2, 3))) for j in range(rng.randint(2, 4))] for i in range(rng.randint(2, 5))]
        html = "<table>" + "".join("<tr>" + "".join(f"<td rowspan={d}>{t}</td>" for t, _, d in row) + "</tr>" for row in rows) + "</table>"
        grid = cells_of(rows)
        for i, line in enumerate(h.render(html).split("\n")):
            shown = [x.strip() for x in line.split("|")]
            want = [grid.get((i, j), "") for j in range(1 + max(x for y, x in grid if y == i))]
            while want and not want[-1]:
                want.pop()
            assert shown[: len(want)] == want and not any(shown[len(want) :])


def test_markup_takes_time_in_step():
    for html in ("<p " + "a='" * 100_000, "<p " + "a=" * 200_000, "<" * 300_000, "<a/" * 100_000, "<!--" * 100_000, "<p x" + " " * 300_000):
        h.render(html)
