"""Visible text of web pages, laid out: blocks on lines of their own, list marks, aligned table cells.

A small tree builder applies the implied tags that pages leave out; a renderer then walks the tree with visibility
rules. One page is one row: nothing is shared between pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dugout.llm.common import slices

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*>?)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']*)))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(hidden|collapse|visible)", re.I)
_SPAN = re.compile(r"\s*(\d{1,9})")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
#: A slash that ends an unquoted value is part of it.
_VALUE_SLASH = re.compile(r"=\s*[^\s\"'>=][^\s>]*/>\Z")
_BLANK = re.compile(r"[ \t\n\r\f]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title noscript noembed noframes iframe object audio video canvas svg math datalist area base link meta param source track".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset menu".split())
BLOCK = SPACED | frozenset("html body div section article main aside header footer nav address li dt dd form figcaption details summary dialog center caption tr td th thead tbody tfoot hr legend optgroup option search".split())
#: A start tag closes these when they are open, up to the tags named second.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th", "colgroup"}, {"tr", "table"}), "th": ({"td", "th", "colgroup"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "colgroup": ({"colgroup"}, {"table"}), "caption": ({"colgroup"}, {"table"}), "body": ({"head"}, {"html"}),
}
_CLOSES_P = SPACED | frozenset("address article aside center details dialog div figcaption footer form header hr main nav section li dt dd".split())
_IN_HEAD = frozenset("base link meta script style template title noscript head".split())
#: Where the raw text of an element ends; letters outside A-Z have no case here.
_RAW_END = {tag: re.compile("</" + tag, re.I | re.A) for tag in RAW}
_ROWS = frozenset("table tr td th thead tbody tfoot body html".split())
_CELL_TAGS = ("table", "td", "th")
_P_STOPS = ("td", "th", "li", "div", "button", "table")
#: A cell wider than this is not filled up; indents end here; a table inside so many others has its cells one below the other.
WIDEST, INDENT, NESTED = 40, 80, 20


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []


def tree(page: str) -> Node:
    """The element tree; texts are strings among the children."""
    root = Node("html")
    stack = [root]
    #: Places in the stack of the open elements of each tag, the innermost last; the root is not among them.
    places: dict[str, list[int]] = {}

    def innermost(tags) -> int:
        """Place of the innermost open element of one of these tags; 0 if none is open."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(upto: int) -> None:
        while len(stack) > upto:
            places[stack.pop().tag].pop()

    def imply(tag: str) -> None:
        if tag not in _IN_HEAD and (i := innermost(("head",))):
            close(i)
        ends, stops = _IMPLIED.get(tag, ((), ()))
        while (i := innermost(ends)) > innermost(stops):
            close(i)
            if tag not in ("tr", "thead", "tbody", "tfoot", "optgroup"):
                break
        if tag in _CLOSES_P and (i := innermost(("p",))) > innermost(_P_STOPS):
            close(i)
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            add("tr", "")

    def add(tag: str, attributes: str) -> None:
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag not in VOID:
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)

    at = 0
    while True:
        mark = _MARK.search(page, at)
        text = page[at : mark.start() if mark else len(page)]
        if text:
            if stack[-1].tag == "head" and text.strip():
                close(len(stack) - 1)
            stack[-1].children.append(html.unescape(text))
        if not mark:
            return root
        at = mark.end()
        tag = mark[2]
        if not tag:
            continue
        tag = tag.lower()
        if mark[1]:
            if tag == "br":
                add("br", "")
            if (i := innermost((tag,))) > (0 if tag in _ROWS else innermost(_CELL_TAGS)):
                close(i)
            continue
        if tag == "html":
            root.attributes = root.attributes or mark[3]
            continue
        imply(tag)
        parent = stack[-1]
        add(tag, mark[3])
        if tag in ("svg", "math") and mark[3].endswith("/>") and not _VALUE_SLASH.search(_QUOTED.sub('""', mark[3])):
            if stack[-1] is not parent:
                close(len(stack) - 1)
            continue
        if tag in RAW:
            found = _RAW_END[tag].search(page, at)
            end = found.start() if found else len(page)
            if tag not in UNSEEN:
                stack[-1].children.append(html.unescape(page[at:end]))
            if stack[-1].tag == tag and len(stack) > 1:
                close(len(stack) - 1)
            close_mark = page.find(">", end)
            at = len(page) if close_mark < 0 else close_mark + 1


def attributes(node: Node) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(node.attributes.rstrip(">")):
        found.setdefault(name.lower(), html.unescape(values[0] or values[1] or values[2]))
    return found


def seen(node: Node) -> bool:
    """Whether an element has a box: by its tag, ``hidden``, ``display``, and closed ``dialog``."""
    if node.tag in UNSEEN:
        return False
    if len(node.attributes) < 4:
        return node.tag != "dialog"
    a = attributes(node)
    if "hidden" in a or _NO_DISPLAY.search(a.get("style", "")) or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return False
    return node.tag != "dialog" or "open" in a


def visible(node: Node, inherited: bool) -> bool:
    """Whether an element's own text shows; unlike a missing box this can be undone further in."""
    if len(node.attributes) < 4:
        return inherited
    said = _VISIBILITY.findall(attributes(node).get("style", ""))
    return said[-1].lower() == "visible" if said else inherited


def _run(task: Generator):
    """The result of a task that yields the tasks it waits for: pages nest deeper than Python calls may."""
    waiting, value = [task], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(value))
            value = None
        except StopIteration as done:
            waiting.pop()
            value = done.value
    return value


class _Page:
    """Lines under construction: ``gap`` is what is owed before the next text (0 nothing, 1 a line end, 2 a blank line)."""

    def __init__(self, shown: bool = True, nested: int = 0):
        self.shown, self.nested = shown, nested
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap, self.space, self.indent, self.mark = 0, False, "", ""

    def flush(self) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []
        self.space = False

    def block(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def open_line(self) -> None:
        if not self.now:
            if self.gap > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0
            self.now.append(self.indent[: len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent)
            self.mark = ""
            self.space = False

    def deeper(self, indent: str, by: int) -> str:
        return indent + " " * by if len(indent) + by <= INDENT else indent.ljust(by)

    def text(self, value: str) -> None:
        if not self.shown:
            return
        words = _BLANK.split(value)
        if words[0] == "" and len(words) > 1 and self.now:
            self.space = True
        body = " ".join(w for w in words if w)
        if body:
            self.open_line()
            self.now.append(" " + body if self.space else body)
            self.space = words[-1] == ""

    def verbatim(self, value: str) -> None:
        for i, line in enumerate(value.split("\n")):
            if i:
                self.flush() if self.now else self.lines.append("")
            if line:
                self.open_line()
                self.now.append(line)


def _rows(table: Node, shown: bool) -> list[list[tuple[Node, bool]]]:
    """The cells of each row that has a box, each with whether its own text shows."""
    out = []
    todo = [(iter(table.children), shown)]
    while todo:
        children, shown = todo[-1]
        child = next(children, None)
        if child is None:
            todo.pop()
        elif isinstance(child, Node) and seen(child):
            inside = visible(child, shown)
            if child.tag == "tr":
                out.append([(c, visible(c, inside)) for c in child.children if isinstance(c, Node) and c.tag in ("td", "th") and seen(c)])
            elif child.tag in ("thead", "tbody", "tfoot"):
                todo.append((iter(child.children), inside))
    return out


def _strays(page: _Page, node: Node) -> Generator:
    """What stands in a table, its groups and rows outside cells; it shows before the rows."""
    before = page.shown
    page.shown = visible(node, before)
    for child in node.children:
        if isinstance(child, str):
            page.text(child)
        elif not seen(child) or child.tag == "col" or (node.tag == "tr" and child.tag in ("td", "th")):
            continue
        elif child.tag == "colgroup" or (node.tag in ("table", "thead", "tbody", "tfoot") and child.tag in ("thead", "tbody", "tfoot", "tr")):
            yield _strays(page, child)
        else:
            yield _walk(page, child, "")
            page.block(1)
    page.shown = before


def _span(cell: Node, name: str, most: int) -> int:
    said = _SPAN.match(attributes(cell).get(name, "")) if cell.attributes else None
    return min(int(said[1]), most) if said else 1


def _grid(rows: list[list[Node]]) -> list[list[int]]:
    """The column that each cell of each row starts at, beside cells that reach over columns and down rows."""
    out, reaching = [], []
    for row in rows:
        reaching = sorted((first, end, left) for first, end, left in reaching if left)
        at, passed, here, new = 0, 0, [], []
        for cell in row:
            while passed < len(reaching) and reaching[passed][0] <= at:
                at = max(at, reaching[passed][1])
                passed += 1
            end = at + max(1, _span(cell, "colspan", 1000))
            if (down := _span(cell, "rowspan", 65534) or 65534) > 1:
                new.append((at, end, down - 1))
            here.append(at)
            at = end
        reaching = [(first, end, left - 1) for first, end, left in reaching] + new
        out.append(here)
    return out


def _table(page: _Page, node: Node) -> Generator:
    """Rows of cells, each under the start of its column; a cell over several columns widens none."""
    yield _strays(page, node)
    rows = _rows(node, page.shown)
    if page.nested >= NESTED:
        for row in rows:
            for cell, shown in row:
                page.block(1)
                before, page.shown = page.shown, shown
                yield _walk(page, cell, "")
                page.shown = before
        return
    cells = []
    for row in rows:
        cells.append([])
        for cell, shown in row:
            cells[-1].append((yield _render(cell, shown, page.nested + 1)).split("\n"))
    starts = _grid([[cell for cell, _ in row] for row in rows])
    widths: dict[int, int] = {}
    for row, texts, columns in zip(rows, cells, starts, strict=True):
        for (cell, _), text, column in zip(row, texts, columns, strict=True):
            width = max((len(x) for x in text if len(x) <= WIDEST), default=0) if _span(cell, "colspan", 1000) < 2 else 0
            widths[column] = max(width, widths.get(column, 0))
    left, offset = {}, 0
    for column in sorted(widths):
        left[column] = offset
        offset += widths[column] + 2
    before, page.shown = page.shown, True
    for texts, columns in zip(cells, starts, strict=True):
        page.block(1)
        for k in range(max((len(t) for t in texts), default=0)):
            line = ""
            for text, column in zip(texts, columns, strict=True):
                if k < len(text) and text[k]:
                    line = line.ljust(left[column]) if len(line) + 2 <= left[column] or not line else line + "  "
                    line += text[k]
            if line:
                page.verbatim(line.rstrip())
                page.flush()
    page.shown = before


def _walk(page: _Page, node: Node, kind: str) -> Generator:
    """``kind``: the list a child ``li`` stands in."""
    tag = node.tag
    outside = page.shown
    page.shown = visible(node, outside)
    if tag == "br":
        page.flush() if page.now else page.block(2)
    elif tag == "hr":
        page.block(1)
        if page.shown:
            page.verbatim("---")
        page.block(1)
    elif tag == "img":
        if alt := attributes(node).get("alt"):
            page.text(alt)
    else:
        yield _inside(page, node, kind)
    page.shown = outside


def _inside(page: _Page, node: Node, kind: str) -> Generator:
    tag = node.tag
    if tag in BLOCK:
        page.block(2 if tag in SPACED and not (tag in ("ul", "ol") and kind) else 1)
    before, mark = page.indent, page.mark
    if tag == "table":
        yield _table(page, node)
    elif tag == "pre":
        page.verbatim("".join(_strings(node, page.shown)).removeprefix("\n"))
    else:
        number = 1
        if tag == "ol":
            start = attributes(node).get("start", "")
            number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
        if tag == "blockquote":
            page.indent = page.deeper(page.indent, 2)
        shut = tag == "details" and "open" not in attributes(node)
        inner = tag if tag in ("ul", "ol", "menu") else kind if tag not in ("li", "td", "th", "div") else ""
        for child in node.children:
            if isinstance(child, str):
                if not shut:
                    page.text(child)
            elif seen(child) and not (shut and child.tag != "summary"):
                if child.tag == "li":
                    page.block(1)
                    outer = page.indent
                    page.mark = f"{number}. " if tag == "ol" else "- "
                    page.indent = page.deeper(outer, len(page.mark))
                    number += 1
                    yield _walk(page, child, "li")
                    page.indent, page.mark = outer, ""
                else:
                    yield _walk(page, child, kind if tag == "li" else inner)
    page.indent = before
    if mark != page.mark and mark:
        page.mark = page.mark and mark
    if tag in BLOCK:
        page.block(2 if tag in SPACED and not (tag in ("ul", "ol") and kind) else 1)
    elif tag in ("td", "th"):
        page.space = True


def _strings(node: Node, shown: bool) -> Iterator[str]:
    todo = [(iter(node.children), shown)]
    while todo:
        children, shown = todo[-1]
        child = next(children, None)
        if child is None:
            todo.pop()
        elif isinstance(child, str):
            if shown:
                yield child
        elif child.tag == "br":
            yield "\n"
        elif seen(child):
            todo.append((iter(child.children), visible(child, shown)))


def _render(node: Node, shown: bool, nested: int) -> Generator:
    page = _Page(shown, nested)
    for child in node.children:
        if isinstance(child, str):
            page.text(child)
        elif seen(child):
            yield _walk(page, child, "")
    page.flush()
    return "\n".join(page.lines)


def render(page: str) -> str:
    """All visible text of a page, laid out."""
    root = tree(page)
    return _run(_render(root, visible(root, True), 0)) if seen(root) else ""


def extract(pages: DataFrame, source: str = "html", column: str = "text") -> DataFrame:
    """``pages`` with the visible text of ``source`` in ``column`` (replaced if there).

    A null page gives a null text, a page without visible text an empty one. Broken markup is read as far as it can
    be, and text is never dropped for it. Rows are independent: repeated rows and empty tables are plain cases.
    """
    names = [c for c in pages.columns if c != column]

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, source):
            texts = [None if p is None else render(p) for p in batch.column(source).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, column])

    pages = pages.select(*names)
    return pages.mapInArrow(extracted, pages.withColumn(column, F.lit(None).cast("string")).schema)
