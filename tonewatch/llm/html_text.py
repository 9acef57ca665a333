"""All visible text of a page, laid out as it would be read.

A tree is built by the usual rules for tags that are implied: a block ends an
open paragraph, an item ends the item before it, rows and cells end rows and
cells.  What a browser would not show is left out: scripts, styles, the head,
hidden elements, closed details.  The tree is then laid out as lines of text:
blocks on lines of their own, paragraphs and headings set off by an empty line,
list items behind their bullet or number, table cells aligned in columns.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Generator, Iterable
from html import unescape
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, arrow_map, require

#: How HTML treats its elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes".split())  # text up to their end tag
ESCAPABLE_RAW = set("textarea title".split())
NEVER_SHOWN = set(
    "head script style template noscript iframe noembed noframes object audio video canvas datalist title".split()
)
BLOCKS = set(
    "html body address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure "
    "footer form header hgroup h1 h2 h3 h4 h5 h6 hr legend li main menu nav ol optgroup option p pre search section "
    "summary table caption ul textarea tr td th thead tbody tfoot colgroup".split()
)
SET_OFF = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
ENDS_PARAGRAPH = BLOCKS - set("html body option optgroup tr td th thead tbody tfoot caption colgroup textarea".split())
HEAD_ONLY = set("base link meta title style script template noscript".split())
#: An open element that a start tag ends, and the elements beyond which it does not reach.
IMPLIED_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("optgroup", "option"), ("select",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
}
#: End tags do not reach out of these.
SCOPES = set("table td th caption html button object template".split())

_MARKUP = re.compile(r"<(?:!--|[!?]|(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)|/)")
_COMMENT_END = re.compile(r"--!?>")
_TAG_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
#: Inputs that show something else than their value.
_UNSHOWN_INPUTS = ("hidden", "password", "checkbox", "radio", "color", "range", "file", "image")
#: Wider cells do not widen their column, and no cell begins further right than this by alignment.
WIDEST_ALIGNED, FURTHEST_ALIGNED = 120, 400
_BLANK = re.compile(r"[ \t\n\f\r]+")

RESULT = "page_id long, url string, text string"


class _Tags:
    """Finds where tags end; a quote that is never closed is a character like any other."""

    def __init__(self, html: str) -> None:
        self.html = html
        self.last = {quote: html.rfind(quote) for quote in "\"'"}

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag, -1 if nothing does."""
        while True:
            stop = _TAG_STOP.search(self.html, at)
            if stop is None:
                return -1
            if stop[0] == ">":
                return stop.start()
            at = stop.end()
            if stop.start() < self.last[stop[0]]:
                at = self.html.index(stop[0], at) + 1


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if source and not source.isspace():
        for name, *values in _ATTRIBUTE.findall(source):
            found.setdefault(name.lower(), unescape(next((v for v in values if v), "")))
    return found


class _Open:
    """The open elements, and at which depths each tag is open, so that no tag looks through all of them."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.depths = [root], {}

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, depth: int) -> None:
        while len(self.nodes) > depth:
            self.depths[self.nodes.pop().tag].pop()

    def last(self, names: Iterable[str]) -> int:
        """Depth of the innermost open element of ``names``, 0 if there is none."""
        return max((own[-1] for own in map(self.depths.get, names) if own), default=0)

    def close(self, names: tuple[str, ...], within: tuple[str, ...] | set[str]) -> None:
        """End the outermost open element of ``names`` that no element of ``within`` encloses."""
        if not any(map(self.depths.get, names)):
            return
        edge, found = self.last(within), len(self.nodes)
        for own in map(self.depths.get, names):
            if own and own[-1] > edge:
                found = min(found, own[bisect_right(own, edge)])
        self.cut(found)

    def close_one(self, name: str) -> None:
        """End the innermost open ``name`` and what is open in it; without one in scope the end tag means nothing."""
        depth = self.last((name,))
        if depth and (name in ("table", "tr", "thead", "tbody", "tfoot") or self.last(SCOPES) <= depth):
            self.cut(depth)


def build(html: str) -> Node:
    """Tree of a page; its root is ``html`` with an implied ``head`` and ``body``."""
    root = Node("html", {})
    body = Node("body", {})
    opened, in_head = _Open(root), True
    stack = opened.nodes

    def text(source: str) -> None:
        nonlocal in_head
        if source and in_head and not source.isspace():
            start_body()
        if source and not in_head:
            stack[-1].children.append(source)

    def start_body() -> None:
        nonlocal in_head
        in_head = False
        root.children.append(body)
        opened.push(body)
        opened.depths.clear()  # tags end elements of the body only

    at, tags = 0, _Tags(html)
    while True:
        mark = _MARKUP.search(html, at)
        if mark is None:
            text(unescape(html[at:]))
            break
        if mark.start() > at:
            text(unescape(html[at : mark.start()]))
        if mark[0] == "<!--":
            comment = _COMMENT_END.search(html, mark.end())
            at = comment.end() if comment else len(html)
            continue
        name = mark["name"]
        stop = tags.end(mark.end()) if name else html.find(">", mark.end())
        if stop < 0:  # the page ends within a tag
            break
        at = stop + 1
        if not name:
            continue
        rest = html[mark.end() : stop]
        name, ends = name.lower(), bool(mark["end"])
        if ends:
            if name == "head" and in_head:
                start_body()
            elif name == "br":
                stack[-1].children.append(Node("br", {}))
            elif name == "p" and not opened.depths.get("p"):
                text("")
                stack[-1].children.append(Node("p", {}))
            elif name not in ("html", "body"):
                opened.close_one(name)
            continue
        if name in ("html", "head", "body"):
            if name == "body":
                if in_head:
                    start_body()
                body.attributes = {**_attributes(rest), **body.attributes}
            continue
        if in_head and name not in HEAD_ONLY:
            start_body()
        attributes = _attributes(rest)
        if name in ENDS_PARAGRAPH:
            opened.close(("p",), SCOPES)
        if name in IMPLIED_ENDS:
            opened.close(*IMPLIED_ENDS[name])
        if name in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            opened.cut(len(stack) - 1)
        if name in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            stack[-1].children.append(Node("tr", {}))
            opened.push(stack[-1].children[-1])
        node = Node(name, attributes)
        if name in RAW or name in ESCAPABLE_RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>|\Z", re.I).search(html, at)
            content, at = html[at : end.start()], end.end()
            node.children.append(unescape(content) if name in ESCAPABLE_RAW else content)
            if not in_head:
                stack[-1].children.append(node)
            continue
        if in_head:  # metadata shows nothing
            continue
        stack[-1].children.append(node)
        if name not in VOID:
            opened.push(node)
    if in_head:
        start_body()
    return root


def shown(node: Node) -> bool:
    if node.tag in NEVER_SHOWN:
        return False
    own = node.attributes
    if node.tag == "dialog" and "open" not in own:
        return False
    if not own:
        return True
    if "hidden" in own or (node.tag == "input" and own.get("type", "").strip().lower() in _UNSHOWN_INPUTS):
        return False
    return not ("style" in own and _HIDING.search(own["style"]))


class Line(NamedTuple):
    text: str
    gap: bool  # set off from what comes before


class _Layout:
    """Lines of one block; pieces of running text wait until a block or break ends the line."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.pieces: list[str] = []
        self.gap = False

    def end_line(self, kept: bool = False) -> None:
        text = "".join(self.pieces)
        self.pieces = []
        text = text.strip("\n") if kept else _BLANK.sub(" ", text).strip(" ")
        if text.strip():
            for one in text.split("\n") if kept else [text]:
                self.lines.append(Line(one.rstrip() if kept else one, self.gap))
                self.gap = False

    def add(self, lines: list[Line], set_off: bool) -> None:
        if not lines:
            return
        for i, line in enumerate(lines):
            self.lines.append(Line(line.text, line.gap or (i == 0 and (set_off or self.gap))))
        self.gap = set_off


#: A step of the layout yields the steps it needs and gets their results; none calls another.
Step = Generator["Step", Any, Any]


def _done(step: Step) -> Any:
    """Result of a step, whose steps within steps wait on a list: elements may be nested to any depth."""
    waiting, result = [step], None
    while waiting:
        try:
            needed = waiting[-1].send(result)
        except StopIteration as end:
            waiting.pop()
            result = end.value
        else:
            waiting.append(needed)
            result = None
    return result


def _block(node: Node, kept: bool = False) -> Step:
    layout = _Layout()
    yield _flow(node, layout, kept)
    layout.end_line(kept)
    return layout.lines


def _flow(node: Node, layout: _Layout, kept: bool) -> Step:
    children = node.children
    if node.tag == "details" and "open" not in node.attributes:
        children = [c for c in children if not isinstance(c, str) and c.tag == "summary"][:1]
    number, step = _start_number(node), -1 if "reversed" in node.attributes else 1
    for child in children:
        if isinstance(child, str):
            layout.pieces.append(child)
        elif not shown(child):
            continue
        elif child.tag == "br":
            if kept:
                layout.pieces.append("\n")
            else:
                layout.end_line()
        elif child.tag == "img":
            layout.pieces.append(child.attributes.get("alt", ""))
        elif child.tag == "input":
            layout.pieces.append(f" {child.attributes.get('value', '')} ")
        elif child.tag in BLOCKS:
            layout.end_line(kept)
            if child.tag == "hr":
                layout.gap = True
            elif child.tag == "table":
                layout.add((yield _table(child)), True)
            elif child.tag == "li":
                number = number if number is None else _number(child, "value", number)
                bullet = "- " if number is None else f"{number}. "
                layout.add((yield _item(child, bullet)), False)
                number = None if number is None else number + step
            else:
                keeps = kept or child.tag in ("pre", "textarea")
                lines = yield _block(child, keeps)
                if child.tag == "dd" or child.tag == "blockquote":
                    lines = [Line("  " + x.text, x.gap) for x in lines]
                nested = child.tag in ("ul", "ol") and node.tag == "li"
                layout.add(lines, child.tag in SET_OFF and not nested)
        else:
            yield _flow(child, layout, kept)


def _number(node: Node, name: str, default: int) -> int:
    value = node.attributes.get(name, "").strip()
    return int(value) if re.fullmatch(r"-?\d{1,9}", value) else default


def _start_number(node: Node) -> int | None:
    if node.tag != "ol":
        return None
    items = sum(not isinstance(c, str) and c.tag == "li" for c in node.children) if "reversed" in node.attributes else 1
    return _number(node, "start", items)


def _item(node: Node, bullet: str) -> Step:
    lines = yield _block(node)
    indent = " " * len(bullet)
    return [Line((indent if i else bullet) + x.text, x.gap and i > 0) for i, x in enumerate(lines)]


def _span(cell: Node, name: str) -> int:
    value = cell.attributes.get(name, "1")
    return min(max(int(value), 1), 1000) if re.fullmatch(r"\d{1,6}", value) else 1


def _rows(table: Node) -> list[list[Node]]:
    rows = []
    waiting = list(reversed(table.children))
    while waiting:
        child = waiting.pop()
        if isinstance(child, str) or not shown(child):
            continue
        if child.tag == "tr":
            rows.append([c for c in child.children if not isinstance(c, str) and c.tag in ("td", "th") and shown(c)])
        elif child.tag in ("thead", "tbody", "tfoot"):
            waiting.extend(reversed(child.children))
    return rows


def _outside_cells(table: Node) -> Node:
    """What a table holds that is in no cell; it is shown before the table, as browsers do."""
    rest = Node("div", {})
    waiting = list(reversed(table.children))
    while waiting:
        child = waiting.pop()
        if isinstance(child, str):
            rest.children.append(child)
        elif child.tag in ("tr", "thead", "tbody", "tfoot") and shown(child):
            inner = child.children
            waiting.extend(reversed([c for c in inner if isinstance(c, str) or c.tag not in ("td", "th")]))
        elif child.tag not in ("tr", "thead", "tbody", "tfoot", "colgroup"):
            rest.children.append(child)
    return rest


def _table(table: Node) -> Step:
    """Cells of a column begin at the same place; a cell with several lines keeps them in its column.

    A cell that spans rows keeps its columns of the rows below, as many as there
    are.  What is kept is an interval of columns, and only columns in which a
    cell begins or whose width counts are looked at, so time and memory follow
    the cells and not their spans.  Cells wider than ``WIDEST_ALIGNED`` do not
    widen their column, and cells that would begin beyond ``FURTHEST_ALIGNED``
    follow the one before after two blanks, so a line is not longer than its
    cells by more than that.
    """
    before = yield _block(_outside_cells(table))
    grid: list[list[tuple[int, int, list[str]]]] = []  # column, columns, lines
    taken: list[tuple[int, int, int]] = []  # first column, column after the last, row after the last
    for r, cells in enumerate(_rows(table)):
        taken = sorted(x for x in taken if x[2] > r)
        column, row, k = 0, [], 0
        below = []
        for cell in cells:
            while k < len(taken) and taken[k][0] <= column:
                column = max(column, taken[k][1])
                k += 1
            wide, deep = _span(cell, "colspan"), _span(cell, "rowspan")
            if deep > 1:
                below.append((column, column + wide, r + deep))
            row.append((column, wide, [x.text for x in (yield _block(cell))] or [""]))
            column += wide
        taken += below
        grid.append(row)
    widths: dict[int, int] = {}
    for row in grid:
        for column, wide, lines in row:
            if wide == 1:
                fitting = [len(x) for x in lines if len(x) <= WIDEST_ALIGNED]
                widths[column] = max(widths.get(column, 0), *fitting, 0)
    starts, place = {}, 0
    for column in sorted({column for row in grid for column, _, _ in row} | set(widths)):
        starts[column] = place
        place += widths[column] + 2 if widths.get(column) else 0
    lines = []
    for row in grid:
        for i in range(max([len(x) for _, _, x in row], default=0)):
            line = ""
            for column, _, cell in row:
                if i < len(cell) and cell[i]:
                    if starts[column] <= FURTHEST_ALIGNED:
                        line = line.ljust(starts[column])
                    line += "  " * (len(line) > starts[column] or starts[column] > FURTHEST_ALIGNED) + cell[i]
            if line.strip():
                lines.append(Line(line, False))
    return before + lines


def visible_text(html: str | None) -> str:
    """The laid-out text of a page; null and empty pages have none."""
    if not html:
        return ""
    root = build(html.replace("\x00", "").replace("\r\n", "\n"))
    body = root.children[0]
    lines = _done(_block(body)) if shown(body) else []
    text: list[str] = []
    for line in lines:
        if line.gap and text:
            text.append("")
        text.append(line.text)
    return "\n".join(text)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Visible text of each row of ``pages``: columns ``RESULT``.

    Null and empty pages give the empty text; repeated rows come back as often
    as they are there; any string is a page, however broken.  Other columns are
    not read.
    """
    require(pages, [id_col, url_col, html_col])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = [visible_text(x.as_py()) for x in batch["html"]]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    named = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    return arrow_map(named, run, RESULT)
