"""Layout-aware text of HTML pages: a tree builder with implied tags, visibility rules, and a
renderer that keeps block spacing, lists and aligned table cells. Style sheets are not read: only the ``hidden``
attribute and ``style`` attributes hide elements.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, utf8, with_id

_TAG = re.compile(r"""<(?:!--(?:.*?)(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)(?:>|(\Z))|[!?/][^>]*+(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")

#: Fixed sets of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript noembed noframes iframe object canvas audio video datalist defs desc metadata".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul fieldset".split())
#: A start tag ends open elements of these kinds, up to an element that holds them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
ENDS_P = BLOCKS - {"body", "html", "legend", "option", "optgroup", "dd", "dt", "li"} | {"dd", "dt", "li"}
#: Elements deeper than this become children of the one at this depth.
MAX_DEPTH = 200
#: Spaces that align the tables of a page are at most so many, and so many for each character of HTML.
PADDING, PADDING_RATE = 65536, 4


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def parse(html: str) -> Node:
    """The tree of a page, with omitted end tags, rows and the end of the head implied. A tag that never closes takes the rest
    of the page with it, as browsers have it; so no part is looked at twice."""
    root = Node("html")
    stack = [root]

    def end(kinds: set[str], until: set[str]) -> None:
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].tag in until:
                return
            if stack[at].tag in kinds:
                del stack[at:]
                if not kinds - {"p"}:
                    return
                end(kinds, until)
                return

    def text(part: str) -> None:
        if part:
            if stack[-1].tag == "head" and not part.isspace():
                stack.pop()
            stack[-1].children.append(unescape(part) if "&" in part else part)

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if m[4] is not None:
            break
        tag = m[2].lower() if m[2] else None
        if tag is None:
            continue
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
                continue
            walls = {"table"} if tag not in ("table", "body", "html") else set()
            if tag in ("p", "b", "i", "a", "span", "em", "strong"):
                walls |= {"td", "th", "caption"}
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in walls:
                    break
            continue
        if tag in ("html", "body") and any(x.tag == tag for x in stack):
            continue
        attrs = {a[1].lower(): unescape(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(m[3])} if m[3].strip() else {}
        if stack[-1].tag == "head" and tag not in ("meta", "link", "base", "title", "style", "script", "noscript", "template"):
            stack.pop()
        if tag in ENDS:
            end(*ENDS[tag])
        if tag in ENDS_P:
            end({"p"}, {"td", "th", "table", "caption", "button"})
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr")
            stack[-1].children.append(row)
            stack.append(row)
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            inner = html[at : close.start() if close else n]
            at = close.end() if close else n
            node.children.append(unescape(inner) if tag in ("textarea", "title") else inner)
        elif tag not in VOID and len(stack) < MAX_DEPTH:
            stack.append(node)
    return root


def visible(node: Node, shown: bool) -> tuple[bool, bool]:
    """Whether the element takes room, and whether its own text shows."""
    if node.tag in UNSEEN or "hidden" in node.attrs:
        return False, False
    if node.tag == "dialog" and "open" not in node.attrs:
        return False, False
    style = re.sub(r"\s+|!important", "", node.attrs.get("style", "").lower())
    if style:
        rules = dict(r.split(":", 1) for r in style.split(";") if ":" in r)
        if rules.get("display") == "none":
            return False, False
        if "visibility" in rules:
            shown = rules["visibility"] == "visible"
    return True, shown


class _Out:
    """Lines under construction. Pending breaks: 1 for a new line, 2 for an empty line before it."""

    def __init__(self, padding: list[int]):
        self.padding = padding  # spaces left for tables, shared by the page
        self.lines: list[str] = []
        self.line = ""
        self.breaks = 0
        self.prefix = ""
        self.mark: str | None = None

    def block(self, breaks: int) -> None:
        if self.line:
            self.lines.append(self.line.rstrip(" "))
            self.line = ""
        self.breaks = max(self.breaks, breaks)

    def _start(self) -> None:
        if not self.line:
            if self.breaks > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.breaks = 0
            self.line = self.mark if self.mark is not None else self.prefix
            self.mark = None

    def text(self, part: str) -> None:
        part = _SPACE.sub(" ", part)
        if not self.line or self.line.endswith(" "):
            part = part.lstrip(" ")
        if part:
            self._start()
            self.line += part

    def raw(self, part: str) -> None:
        for i, line in enumerate(part.split("\n")):
            if i:
                self.newline()
            if line:
                self._start()
                self.line += line

    def newline(self) -> None:
        if self.line:
            self.lines.append(self.line.rstrip(" "))
            self.line = ""
        elif self.lines and not self.breaks:
            self.lines.append("")

    def value(self) -> list[str]:
        self.block(0)
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        return lines


def _table(node: Node, shown: bool, out: _Out) -> None:
    """Rows of cells; the columns are aligned with spaces. Cells of several lines keep them."""
    captions: list[Node] = []
    rows: list[tuple[Node, bool]] = []

    def gather(parent: Node, shown: bool) -> None:
        for c in parent.children:
            if isinstance(c, str):
                if c.strip():
                    rows.append((_wrap(c), shown))
                continue
            room, see = visible(c, shown)
            if not room:
                continue
            if c.tag in ("thead", "tbody", "tfoot"):
                gather(c, see)
            elif c.tag == "tr":
                rows.append((c, see))
            elif c.tag == "caption":
                captions.append(c)
            elif c.tag not in ("colgroup", "col"):
                rows.append((_wrap(c), see))

    gather(node, shown)
    for c in captions:
        out.block(1)
        _children(c, shown, out)
    grid: list[list[tuple[int, list[str]]]] = []
    held: dict[int, int] = {}
    for row, see in rows:
        cells: list[tuple[int, list[str]]] = []
        at = 0
        for c in row.children:
            if isinstance(c, str) and not c.strip():
                continue
            cell = c if isinstance(c, Node) else _wrap(c).children[0]
            room, show = visible(cell, see)
            if not room:
                continue
            while held.get(at, 0):
                held[at] -= 1
                at += 1
            inner = _Out(out.padding)
            _children(cell, show, inner)
            span = [max(1, min(1000, int(v))) if (v := cell.attrs.get(k, "1").strip()).isdecimal() and len(v) < 6 else 1 for k in ("colspan", "rowspan")]
            cells.append((at, inner.value()))
            if span[1] > 1:
                for k in range(at, at + span[0]):
                    held[k] = span[1] - 1
            at += span[0]
        for k in [k for k in held if k >= at and held[k]]:
            held[k] -= 1
        grid.append(cells)
    starts = sorted({at for cells in grid for at, _ in cells})
    order = {at: i for i, at in enumerate(starts)}
    widths = [0] * len(starts)
    for cells in grid:
        for at, lines in cells:
            widths[order[at]] = max([widths[order[at]], *map(len, lines)])
    ends, total = [], 0  # where a column's cells start in a line
    for w in widths:
        ends.append(total)
        total += w + 2
    padding = 0
    for cells in grid:
        for k in range(max([len(lines) for _, lines in cells], default=0)):
            here = [(ends[order[at]], len(lines[k])) for at, lines in cells if k < len(lines) and lines[k]]
            padding += max((e + n for e, n in here), default=0) - sum(n for _, n in here)
    aligned = padding <= out.padding[0]
    if aligned:
        out.padding[0] -= padding
    for cells in grid:
        out.block(1)
        for k in range(max([len(lines) for _, lines in cells], default=0)):
            line = ""
            for at, lines in cells:
                if k < len(lines) and lines[k]:
                    line = line.ljust(ends[order[at]] if aligned else len(line) + 2 * bool(line)) + lines[k]
            if line := line.rstrip():
                out.raw(line)
                out.block(1)


def _select(node: Node, shown: bool, out: _Out) -> None:
    """What a closed list shows: its selected option, or the first."""
    options, todo = [], node.children[::-1]
    while todo:
        c = todo.pop()
        if isinstance(c, Node) and c.tag == "option":
            options.append(c)
        elif isinstance(c, Node) and c.tag == "optgroup":
            todo += c.children[::-1]
    chosen = next((o for o in reversed(options) if "selected" in o.attrs), options[0] if options else None)
    if chosen is not None and "hidden" not in chosen.attrs:
        _children(chosen, shown, out)


def _wrap(c: Node | str) -> Node:
    row, cell = Node("tr"), Node("td")
    cell.children.append(c)
    row.children.append(cell)
    return row


def _children(node: Node, shown: bool, out: _Out, pre: bool = False) -> None:
    number = None
    if node.tag == "ol":
        start = node.attrs.get("start", "1").strip()
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    closed = node.tag == "details" and "open" not in node.attrs
    for c in node.children:
        if isinstance(c, str):
            if shown and not closed:
                (out.raw if pre else out.text)(c)
            continue
        if closed and c.tag != "summary":
            continue
        room, see = visible(c, shown)
        if not room:
            continue
        if c.tag == "br":
            out.newline()
            continue
        if c.tag == "input":
            if see and c.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                out.text(c.attrs.get("value", ""))
            continue
        if c.tag == "select":
            _select(c, see, out)
            continue
        breaks = (2 if c.tag in SPACED and not (c.tag in ("ul", "ol") and node.tag == "li") else 1) if c.tag in BLOCKS else 0
        if breaks:
            out.block(breaks)
        if c.tag == "table":
            _table(c, see, out)
        elif c.tag == "li":
            mark = "- "
            if number is not None:
                value = c.attrs.get("value", "").strip()
                number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number
                mark = f"{number}. "
                number += 1
            before = out.prefix
            out.mark, out.prefix = before + mark, before + " " * len(mark)
            _children(c, see, out, pre)
            out.block(1)
            out.mark, out.prefix = None, before
        elif c.tag in ("blockquote", "dd"):
            out.prefix += "  "
            _children(c, see, out, pre)
            out.block(1)
            out.prefix = out.prefix[:-2]
        else:
            _children(c, see, out, pre or c.tag in ("pre", "textarea", "xmp"))
        if breaks:
            out.block(breaks)


def render(html: str | None) -> str:
    """All visible text of a page."""
    if not html:
        return ""
    out = _Out([PADDING + PADDING_RATE * len(html)])
    _children(parse(html), True, out)
    return "\n".join(out.value())


def extract_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: its id, ``text`` (all visible text), ``n_lines`` and ``text_sha256``.

    A null or empty page has an empty text. Any input gives a result: unknown and unclosed tags
    are read as browsers do, elements nested deeper than MAX_DEPTH are read as siblings, and bytes that aren't UTF-8 as U+FFFD.
    Tables whose alignment would take more spaces than PADDING and PADDING_RATE leave a page have two spaces between cells instead.
    Repeated rows and null ids give rows like others; other columns are ignored; an empty table gives an empty result.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                texts = [render(h.decode(errors="replace") if h else "") for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    rows = pages.select(column(id_col).alias("id"), utf8(html_col).alias("html"))
    out = rows.mapInArrow(scan, with_id(rows, "id", "text string"))
    return out.select(
        F.col("id").alias(id_col),
        "text",
        F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )
