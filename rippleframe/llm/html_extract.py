"""HTML extraction by layout-aware rendering.

A tree builder supplies implied end tags and skips what a reader does not see; the
renderer walks the tree and keeps what layout says: blank lines around blocks, list
markers with nesting, preformatted text, and table cells padded to their columns' width.
Parsing is a small helper per page inside Arrow batches; Spark deals out the pages.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleframe.llm.base import text_batches

# Element classes of the HTML standard (fixed values).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("head script style template noscript title meta link object audio video canvas iframe datalist noframes desc metadata defs annotation annotation-xml".split())
#: A start tag of any other element ends the head.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
#: A start tag closes the open elements named here, up to the given boundary elements.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)), "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)), "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select", "datalist")),
}
CLOSES_P = BLOCK - {"body", "html", "dt", "dd", "li", "option", "optgroup"}
#: What is inside closes nothing outside.
CLOSED = frozenset("object template".split())
SCOPE = CLOSED | frozenset("table td th caption html body button".split())
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")
#: Deeper elements are rendered as parts of the one at this depth, so nesting cannot exhaust the stack.
DEPTH = 200
#: Cells are padded to this many columns at most, so that one wide cell does not blow up all rows; their text stays whole.
WIDEST = 80
#: A tag that the page ends in; the standard drops it.
UNFINISHED = re.compile(r"<[A-Za-z/!?]")
INTEGER = re.compile(r"\s*[-+]?\d{1,9}")


@dataclass
class Node:
    tag: str
    children: list[Node | str] = field(default_factory=list)
    start: int | None = None
    hidden: bool = False
    seen: bool = True
    reverse: bool = False
    span: int = 1


def integer(text: str | None) -> int | None:
    """The integer an attribute starts with."""
    found = INTEGER.match(text or "")
    return int(found.group()) if found else None


class TreeBuilder(HTMLParser):
    """Builds the tree; elements a reader does not see are marked hidden.

    Visibility, which an element inside may set again, is told apart from what is not rendered at all.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        self.title: list[str] = []
        self.in_title = False

    def _close(self, tags: Iterable[str], stop: Iterable[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return self._close(tags, stop)
            if self.open[k].tag in stop or self.open[k].tag in CLOSED:
                return None
        return None

    def _foreign(self) -> bool:
        """Whether the innermost markup is SVG or MathML."""
        inner = next((n.tag for n in reversed(self.open) if n.tag in ("svg", "math", "foreignobject")), "")
        return inner in ("svg", "math")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]], closed: bool = False) -> None:
        self.in_title = tag == "title" and not self.title and not self._foreign()
        if tag == "body":
            self._close(HEAD | {"head"}, ())  # a head without an end
        if tag in ("html", "body"):
            return
        if self.open[-1].tag == "head" and tag not in HEAD:
            self.open.pop()
        if tag in CLOSES_P:
            self._close(("p",), SCOPE)
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        own = dict(attrs)
        node = Node(tag, hidden=bool(tag in HIDDEN or "hidden" in own or (tag == "input" and own.get("type") == "hidden") or UNSEEN.search(own.get("style") or "")))
        said = VISIBILITY.findall(own.get("style") or "")
        node.seen = said[-1].lower() == "visible" if said else self.open[-1].seen
        if tag in ("ol", "li"):
            node.start = integer(own.get("start" if tag == "ol" else "value"))
            node.reverse = "reversed" in own
        if tag in ("td", "th"):
            node.span = min(max(integer(own.get("colspan")) or 1, 1), 1000)
        if tag == "img":
            node.children.append(own.get("alt") or "")
        self.open[-1].children.append(node)
        # Hidden elements are not rendered, so they may lie deeper.
        if tag not in VOID and not closed and (len(self.open) < DEPTH or (len(self.open) < 2 * DEPTH and (node.hidden or any(n.hidden for n in self.open)))):
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # The slash means nothing in HTML, but ends an element of SVG or MathML.
        self.handle_starttag(tag, attrs, tag in ("svg", "math") or self._foreign())

    def handle_endtag(self, tag: str) -> None:
        self.in_title = False
        if tag == "p" and not any(n.tag == "p" for n in self.open):
            self.open[-1].children.append(Node("p", seen=self.open[-1].seen))
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        elif self.open[-1].tag == "head" and data.strip():
            self.open.pop()
        self.open[-1].children.append(data)


def width(text: str) -> int:
    """Columns a text takes: wide characters two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Renderer:
    """Lines of text with block spacing; ``gap`` is the number of line ends owed before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line = ""
        self.gap = 0
        self.indent = ""
        self.marker = ""
        self.seen = True

    def text(self, data: str, pre: bool) -> None:
        if pre and self.seen:
            parts = data.split("\n")
            for k, part in enumerate(parts):
                if k:
                    self.flush(True)
                self.put(part, True)
            return
        self.put(SPACE.sub(" ", data), False)

    def put(self, data: str, pre: bool) -> None:
        if not pre and (not self.line or self.line.endswith(" ")):
            data = data.lstrip(" ")
        if not data or not self.seen:
            return
        if not self.line and self.gap > 1 and self.lines and self.lines[-1]:
            self.lines.append("")
        if not self.line:
            data = self.indent + self.marker + data
            self.marker = ""
        self.gap = 0
        self.line += data

    def flush(self, keep: bool = False) -> None:
        if self.line.strip() or keep:
            self.lines.append(self.line.rstrip())
        self.line = ""

    def block(self, spaced: bool) -> None:
        self.flush()
        self.gap = max(self.gap, 2 if spaced else 1)

    def done(self) -> str:
        self.flush()
        return "\n".join(self.lines).strip("\n")


def render(node: Node, out: Renderer, pre: bool = False, depth: int = 0) -> None:
    number, step = 1 if node.start is None else node.start, -1 if node.reverse else 1
    if node.reverse and node.start is None:
        number = sum(isinstance(c, Node) and c.tag == "li" and not c.hidden for c in node.children)
    outer, out.seen = out.seen, node.seen
    for child in node.children:
        if isinstance(child, str):
            out.text(child, pre)
            continue
        if child.hidden:
            continue
        tag = child.tag
        if tag in ("br", "hr") and not child.seen:
            continue
        if tag == "br":
            out.flush(True)
        elif tag == "hr":
            out.block(True)
            out.put("---", False)
            out.block(True)
        elif tag == "table":
            table(child, out)
        elif tag in ("ul", "ol", "menu"):
            out.block(depth == 0)
            before, out.indent = out.indent, out.indent + ("  " if depth else "")
            render(child, out, pre, depth + 1)
            out.indent = before
            out.block(depth == 0)
        elif tag == "li":
            out.block(False)
            number = number if child.start is None else child.start
            out.marker = f"{number}. " if node.tag == "ol" else "- "
            number += step
            render(child, out, pre, depth)
            out.block(False)
            out.marker = ""
        elif tag in BLOCK:
            out.block(tag in SPACED)
            before = out.indent
            out.indent += "  " if tag in ("blockquote", "dd") else ""
            render(child, out, pre or tag == "pre", depth)
            out.block(tag in SPACED)
            out.indent = before
        else:
            render(child, out, pre or tag == "textarea", depth)
    out.seen = outer


def cells(node: Node) -> Iterator[Node]:
    """Visible rows of a table in order, whatever groups they are in; what stands in a group outside a row is a row."""
    loose: list[Node | str] = []
    for child in node.children:
        if isinstance(child, Node) and child.hidden:
            continue
        if isinstance(child, Node) and child.tag in ("tr", "thead", "tbody", "tfoot"):
            if loose:
                yield Node("tr", loose, seen=node.seen)
                loose = []
            if child.tag == "tr":
                yield child
            else:
                yield from cells(child)
        elif node.tag != "table" and not (isinstance(child, str) and not child.strip()):
            loose.append(child)
    if loose:
        yield Node("tr", loose, seen=node.seen)


def table(node: Node, out: Renderer) -> None:
    """Cells padded to the width of their column, ``WIDEST`` at most; a cell's own lines are joined by spaces.

    A cell that spans columns takes their width and what would part them. Cells that span rows
    stand in their first row alone. A table of one column is laid out as blocks. Text beside the
    rows, as captions are, comes first.
    """
    grid: list[list[tuple[int, int, str]]] = []  # column, span and text
    for tr in cells(node):
        row, at = [], 0
        for cell in tr.children:
            if isinstance(cell, Node) and cell.hidden or isinstance(cell, str) and not cell.strip():
                continue
            if not isinstance(cell, Node) or cell.tag not in ("td", "th"):
                cell = Node("td", [cell], seen=tr.seen)
            own = Renderer()
            render(cell, own)
            row.append((at, cell.span, own.done()))
            at += cell.span
        grid.append(row)
    out.block(True)
    for child in node.children:
        if isinstance(child, str) or child.tag not in ("tr", "thead", "tbody", "tfoot", "colgroup", "col"):
            render(Node("div", [child], seen=node.seen), out)
            out.block(False)
    if max(map(len, grid), default=0) <= 1:
        for row in grid:
            for line in (row[0][2].split("\n") if row else []):
                out.put(line, False)
                out.block(False)
    else:
        flat = [[(at, span, SPACE.sub(" ", c)) for at, span, c in row] for row in grid]
        wide: dict[int, int] = {}
        for at, span, c in (cell for row in flat for cell in row):
            if span == 1:
                wide[at] = max(wide.get(at, 0), min(width(c), WIDEST))

        def room(at: int, span: int) -> int:
            # What parts the columns alone fills the limit of a cell that spans many.
            return min(3 * (span - 1) + sum(wide.get(k, 0) for k in range(at, at + min(span, WIDEST))), WIDEST)

        for row in flat:
            if any(c for _, _, c in row):
                out.put(" | ".join(c + " " * (room(at, span) - width(c)) for at, span, c in row).rstrip(), True)
                out.block(False)
    out.block(True)


def extract(html: str | None) -> tuple[str | None, str | None]:
    """(title, visible text) of a page; both null for a null page, empty texts if there is nothing to see."""
    if html is None:
        return None, None
    cut = UNFINISHED.search(html, html.rfind(">") + 1)
    tree = TreeBuilder()
    tree.feed(html[: cut.start()] if cut else html)
    tree.close()
    out = Renderer()
    render(tree.root, out)
    return SPACE.sub(" ", "".join(tree.title)).strip(), out.done()


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [extract(h) for h in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([t for _, t in found], pa.string())], names=["page_id", "title", "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, title and text of every row of (page_id, html).

    Broken markup is repaired as browsers do where it matters for the text; nothing in a
    page fails the job. Null pages give nulls, pages without visible text an empty text.
    Repeated rows and null ids are kept as they are.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    return text_batches(pages).select("page_id", F.col("html").cast("string").alias("html")).mapInArrow(_extract, f"page_id {kind}, title string, text string")
