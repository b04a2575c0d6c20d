"""HTML extraction by layout: a tree builder with implied tags, visibility rules, and a renderer of blocks, lists and tables."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Generator, Iterator
from html import unescape
from unicodedata import east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame

from areasignal.llm.common import arrow_map, kind_of

# Element names by how they are parsed and shown.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = set("head script style template noscript title iframe noembed noframes object audio video canvas datalist area base link meta param source track col colgroup".split())
PARAGRAPH = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset".split())
BLOCK = PARAGRAPH | set("address article aside body center dd details dialog div dt figcaption footer form header hgroup html legend li main menu nav section summary caption tr thead tbody tfoot optgroup option search".split())
CELL, HEAD_ONLY = {"td", "th"}, set("base link meta script style title template noscript".split())
#: By a start tag: open elements that it closes, and those that the search for them doesn't leave.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
#: Block elements whose start ends an open paragraph.
ENDS_P = (PARAGRAPH | set("address article aside center details dialog dir div dl fieldset figcaption figure footer form header hgroup main menu nav section summary li dd dt".split())) - {"caption"}
#: What an end tag can't reach out of.
WALL = {"table", "td", "th", "caption", "body", "html"}

#: An attribute: a name (a quote in it is a character like any other), and after = a quoted value or one up to white space.
_NAME = r"(?:=[^\s/>=]*+|[^\s/>=]++)"
_VALUE = r"(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+|(?=>)|\Z)"
_MARKUP = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/[^A-Za-z>])[^>]*(?:>|\Z)|</>|</?([A-Za-z][^\s/>]*+)((?:[\s/]++|{_NAME}(?:\s*+=\s*+{_VALUE})?+)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>\"'][^\s>]*+))?+)?+")
_WHOLE = re.compile(r"\s*(-?\d+)")
UNSHOWN_INPUTS = set("hidden checkbox radio password file image".split())
#: Of svg: what is drawn only where it is referred to, or not at all.
UNDRAWN = set("defs symbol clippath mask pattern marker lineargradient radialgradient metadata title desc script style".split())
_SPACES = re.compile(r"[ \t\n\r\f]+")


def attributes(text: str) -> dict[str, str]:
    """Names in lower case and values of an element's attributes' text; of a name given twice, the first."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        value = m[2] or m[3] or m[4] or ""
        out.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
    return out


def _style(text: str) -> dict[str, str]:
    """The properties of a style attribute; of one given twice, the last."""
    pairs = (x.partition(":") for x in text.lower().split(";"))
    return {name.strip(): value.replace("!important", "").strip() for name, _, value in pairs}


def _number(text: str | None) -> int | None:
    m = _WHOLE.match(text or "")
    return int(m[1]) if m else None


class Node:
    """An element with its attributes' text and its children: nodes and texts."""

    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: str = "") -> None:
        self.name, self.attrs, self.children = name, attrs, []


def parse(html: str) -> Node:
    """The tree of a page; no input is an error.

    Implied are html and body, the end of p before a block, of li, dt, dd, option, cells and rows before the next one,
    tbody and tr around cells, and the end of all that is open at an outer end tag. An end tag without its start is left
    out, but </p> makes an empty paragraph and </br> a break.
    """
    root = Node("html")
    stack = [root]
    open_: Counter[str] = Counter()  # of the stack: a search for a name that isn't there is left out
    at, n = 0, len(html)

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(unescape(s) if "&" in s else s)

    def push(name: str, attrs: str = "") -> None:
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if name not in VOID:
            stack.append(node)
            open_[name] += 1

    def cut(k: int) -> None:
        open_.subtract(x.name for x in stack[k:])
        del stack[k:]

    def close(names: set[str], walls: set[str]) -> bool:
        """Closes the nearest open element of these names, with all in it, unless a wall comes before it."""
        if not any(open_[x] for x in names):
            return False
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                cut(k)
                return True
            if stack[k].name in walls:
                return False
        return False

    while at < n:
        m = _MARKUP.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        name = (m[1] or "").lower()
        if not name:
            continue
        if html[m.start() + 1] == "/":
            if name == "br":
                push("br")
            elif name == "p" and not close({"p"}, WALL):
                push("p")
                cut(len(stack) - 1)
            elif name in CELL or name in ("tr", "tbody", "thead", "tfoot", "caption"):
                close({name}, {"table"})
            elif name in ("table", "html", "body"):
                close({name}, set())
            elif name != "p":
                close({name}, WALL)
            continue
        attrs = m[2]
        if name == "html":
            continue
        if name == "body":
            close({"head"}, set())
        elif stack[-1].name == "head" and name not in HEAD_ONLY:
            cut(len(stack) - 1)
        if name in ENDS_P:
            close({"p"}, WALL | {"button"})
        if name in CLOSES:
            closes, walls = CLOSES[name]
            while close(closes, walls):
                pass
        if name in CELL or name == "tr":
            if stack[-1].name == "table":
                push("tbody")
            if name in CELL and stack[-1].name in ("tbody", "thead", "tfoot"):
                push("tr")
        push(name, attrs)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            text_end = end.start() if end else n
            if name == "textarea" or name == "title":
                text(html[at:text_end])
            elif text_end > at:
                stack[-1].children.append(html[at:text_end])
            at = end.end() if end else n
            cut(len(stack) - 1)
        elif attrs.rstrip().endswith("/") and stack[-1].name == name and open_["svg"]:
            cut(len(stack) - 1)
    return root


def width(text: str) -> int:
    """Columns that a line takes."""
    return len(text) if text.isascii() else sum(2 if east_asian_width(c) in "WF" else 1 for c in text)


class _Flow:
    """Lines of text with white space made one space, breaks and blank lines kept apart from text."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0  # lines to end before the next text: 1 for a new line, 2 for a blank one

    def add(self, text: str) -> None:
        if text[:1] in " \t\n\r\f":
            self.space = True
        words = _SPACES.sub(" ", text).strip(" ")
        if not words:
            return
        self._settle()
        if self.space and self.line:
            self.line.append(" ")
        self.line.append(words)
        self.space = text[-1] in " \t\n\r\f"

    def _settle(self) -> None:
        if self.gap:
            if self.out and self.gap > 1 and self.out[-1] != "":
                self.out.append("")
            self.gap = 0

    def end(self, gap: int = 1) -> None:
        """Ends the line, if it has text; gap: of what follows."""
        if self.line:
            self.out.append("".join(self.line))
            self.line = []
        self.space = False
        self.gap = max(self.gap, gap)

    def br(self) -> None:
        if self.line:
            self.end(0)
        elif self.out and not self.gap:
            self.out.append("")
        self.space = False

    def lines(self, lines: list[str], gap: int) -> None:
        """Whole lines as they are, with a gap before and after."""
        if lines:
            self.end(gap)
            self._settle()
            self.out += lines
            self.gap = gap

    def done(self) -> list[str]:
        self.end(0)
        while self.out and not self.out[-1]:
            self.out.pop()
        return self.out


def _visible(node: Node, seen: bool) -> tuple[bool, bool]:
    """Whether the node is rendered at all, and whether its own text is seen."""
    if node.name in HIDDEN:
        return False, False
    a = attributes(node.attrs) if node.attrs else {}
    if node.name == "dialog" and "open" not in a:
        return False, False
    if "hidden" in a and a["hidden"].lower() != "until-found":
        return False, False
    if style := a.get("style"):
        found = _style(style)
        if found.get("display") == "none":
            return False, False
        if (kind := found.get("visibility")) in ("hidden", "collapse", "visible"):
            return True, kind == "visible"
    return True, seen


def _below(node: Node, names: set[str], without: set[str]) -> list[Node]:
    """The outermost elements of these names in a node, in order, but those in elements that are left out."""
    out, todo = [], list(reversed(node.children))
    while todo:
        item = todo.pop()
        if isinstance(item, Node) and item.name not in without:
            if item.name in names:
                out.append(item)
            else:
                todo.extend(reversed(item.children))
    return out


def _contents(node: Node) -> list:
    """What is shown of a node's children: of a select the chosen option, or all of a list box; of svg the drawn text."""
    if node.name == "svg":
        return [y for x in _below(node, {"text", "foreignobject"}, UNDRAWN) for y in (" ", x, " ")]
    if node.name != "select":
        return node.children
    a, options = attributes(node.attrs), _below(node, {"option"}, set())
    if "multiple" not in a and (_number(a.get("size")) or 1) <= 1:
        of = [(x, attributes(x.attrs)) for x in options]
        chosen = [x for x, y in of if "selected" in y][-1:] or [x for x, y in of if "disabled" not in y][:1]
        return [" ", *(y for x in chosen for y in _option(x)), " "]
    out: list = []
    for item in _below(node, {"option", "optgroup"}, set()):
        inner = [item] if item.name == "option" else _below(item, {"option"}, set())
        if _visible(item, True)[0]:
            for line in ([] if item.name == "option" else [[attributes(item.attrs).get("label", "")]]) + [_option(x) for x in inner if _visible(x, True)[0]]:
                out.append(holder := Node("div"))
                holder.children = line
    return out


def _option(node: Node) -> list:
    label = attributes(node.attrs).get("label")
    return [label] if label else node.children


#: What asks for other nodes' lines while it lays out its own: `_laid_out` keeps those that wait, so depth isn't bounded.
Layout = Generator["Layout", list[str], list[str]]


def _laid_out(first: Layout) -> list[str]:
    """What a layout returns, with each layout that it yields run before it goes on."""
    waiting, given = [first], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(given))
            given = None
        except StopIteration as done:
            given = done.value
            waiting.pop()
    return given


def _lines(node: Node, seen: bool, list_gap: int = 2) -> Layout:
    """The lines that a node's contents take, without the spacing of the node itself; list_gap: of lists in it."""
    flow = _Flow()
    todo: list[tuple] = [(x, seen) for x in reversed(node.children)]
    while todo:
        item, shown = todo.pop()
        if isinstance(item, str):
            if shown:
                flow.add(item)
            continue
        if isinstance(item, int):
            flow.end(item)
            continue
        there, shown = _visible(item, shown)
        if not there:
            continue
        name = item.name
        if name == "br":
            flow.br()
        elif name == "hr":
            flow.lines(["---"], 2)
        elif name == "img":
            if shown and (alt := attributes(item.attrs).get("alt")):
                flow.add(alt)
        elif name == "input":
            a = attributes(item.attrs)
            if shown and a.get("type", "").lower() not in UNSHOWN_INPUTS and "value" in a:
                flow.add(f" {a['value']} ")
        elif name == "textarea":
            flow.lines(_preformatted(item, shown), 1)
        elif name in ("ul", "ol", "menu", "dir"):
            flow.lines((yield _list(item, shown)), list_gap)
        elif name == "table":
            flow.lines((yield _table(item, shown)), 2)
        elif name == "pre":
            flow.lines(_preformatted(item, shown), 2)
        elif name == "blockquote":
            flow.lines([f"> {x}".rstrip() for x in (yield _lines(item, shown))], 2)
        elif name == "dd":
            flow.lines([f"  {x}".rstrip() for x in (yield _lines(item, shown))], 1)
        elif name in BLOCK:
            gap = 2 if name in PARAGRAPH else 1
            flow.end(gap)
            todo.append((gap, True))
            todo.extend((x, shown) for x in reversed(item.children))
        else:
            todo.extend((x, shown) for x in reversed(_contents(item)))
    return flow.done()


def _list(node: Node, seen: bool) -> Layout:
    """Items with a dash or a number (a list's start and reversed, an item's value), what follows in an item indented under it."""
    out: list[str] = []
    a = attributes(node.attrs) if node.name == "ol" else {}
    start, step = _number(a.get("start")), -1 if "reversed" in a else 1
    items = sum(isinstance(x, Node) and x.name == "li" and _visible(x, seen)[0] for x in node.children) if step < 0 else 1
    number = items if start is None else start
    for item in node.children:
        holder = item if isinstance(item, Node) and item.name == "li" else None
        if holder is None:
            holder = Node("span")
            holder.children = [item]
            if isinstance(item, Node) and item.name in ("ul", "ol", "menu"):
                there, shown = _visible(item, seen)
                out += [f"  {x}".rstrip() for x in (yield _list(item, shown))] if there else []
                continue
        there, shown = _visible(holder, seen)
        lines = (yield _lines(holder, shown, 1)) if there else []
        if holder is item and there:
            own = _number(attributes(item.attrs).get("value")) if node.name == "ol" and item.attrs else None
            number = number if own is None else own
            mark = f"{number}. " if node.name == "ol" else "- "
            number += step
            out += [(mark if i == 0 else " " * len(mark)) + x if x else "" for i, x in enumerate(lines)]
        else:
            out += lines
    return out


def _table(node: Node, seen: bool) -> Layout:
    """Rows with cells padded to the width of their column; a cell's lines stay in it, and so do the columns under a cell of
    several rows. Captions come first. A table in a cell, or one of a single column, is laid out as blocks."""
    captions: list[str] = []
    rows: list[list[tuple[int, int, list[str]]]] = []  # column, columns and lines of each cell
    below: dict[int, int] = {}  # columns that a cell above goes on in, and for how many rows
    todo: list[tuple] = [(x, seen) for x in reversed(node.children)]
    loose = Node("span")
    while todo:
        item, shown = todo.pop()
        if isinstance(item, str):
            if item.strip():
                loose.children.append(item)
            continue
        there, shown = _visible(item, shown)
        if not there:
            continue
        if item.name == "caption":
            captions += yield _lines(item, shown)
        elif item.name == "tr":
            row, column = [], 0
            below = {c: k - 1 for c, k in below.items() if k > 0}
            taken = {c for c in below}
            for cell in item.children:
                if isinstance(cell, Node) and cell.name in CELL:
                    here, cell_shown = _visible(cell, shown)
                    if here:
                        a = attributes(cell.attrs) if cell.attrs else {}
                        span, deep = _number(a.get("colspan")), _number(a.get("rowspan"))
                        span = 1 if span is None else max(1, min(1000, span))
                        deep = 1 if deep is None or deep < 0 else deep or 65534  # 0: to the end of its group
                        while column in taken:
                            column += 1
                        row.append((column, span, (yield _lines(cell, cell_shown))))
                        if deep > 1:
                            below.update(dict.fromkeys(range(column, column + span), min(deep, 65534) - 1))
                        column += span
                elif not isinstance(cell, str) or cell.strip():
                    loose.children.append(cell)
            rows.append(row)
        elif item.name in ("tbody", "thead", "tfoot"):
            below = {}  # what spans rows ends with its group
            todo.extend((x, shown) for x in reversed(item.children))
        else:
            loose.children.append(item)
    out = [*captions, *(yield _lines(loose, seen))]  # text outside cells is shown before the table
    rows = [r for r in rows if any(lines for _, _, lines in r)]
    if rows and all(len(r) == 1 and r[0][0] == 0 for r in rows):
        for ((_, _, lines),) in rows:
            out += [*([""] if out and len(lines) > 1 else []), *lines]
        return out
    widths: dict[int, int] = {}
    for column, span, lines in (c for r in rows for c in r):
        if span == 1:
            widths[column] = max(widths.get(column, 0), *(width(x) for x in lines), 0)
    for r in rows:
        for k in range(max(len(lines) for _, _, lines in r)):
            at, parts = 0, []
            for column, span, lines in r:
                parts += [" " * widths.get(c, 0) for c in range(at, column)]
                room = sum(widths.get(column + j, 0) for j in range(span)) + 3 * (span - 1)
                x = lines[k] if k < len(lines) else ""
                parts.append(x + " " * max(0, room - width(x)))
                at = column + span
            out.append(" | ".join(parts).rstrip())
    return out


def _preformatted(node: Node, seen: bool) -> list[str]:
    """Text with its own white space; a line break right after the start is left out."""
    parts, todo = [], [(x, seen) for x in reversed(node.children)]
    while todo:
        item, shown = todo.pop()
        if isinstance(item, str):
            parts.append(item if shown else "")
        elif item.name == "br":
            parts.append("\n")
        else:
            there, shown = _visible(item, shown)
            if there:
                todo.extend((x, shown) for x in reversed(_contents(item)))
    lines = "".join(parts).replace("\r\n", "\n").removeprefix("\n").split("\n")
    lines = [x.rstrip() for x in lines]
    while lines and not lines[-1]:
        lines.pop()
    return lines


def render(html: str | None) -> str:
    """All visible text of a page, however deep its elements are nested; of null, an empty text.

    What a reader can open on the page itself is its text, so closed `details` are shown whole; what only a script opens (a
    `dialog` that isn't open) is not.
    """
    return "\n".join(_laid_out(_lines(parse(html), True))) if html else ""


def extract_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id_col and text (the visible text of the page, laid out) of each row.

    A null or empty page has an empty text; a null id stays. Repeated rows give repeated results; other columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([render(x.as_py()) for x in batch.column(1)], pa.string())], [id_col, "text"])

    return arrow_map(df.select(id_col, html_col), run, f"`{id_col}` {kind_of(df, id_col)}, text string")
