"""HTML to text as it would be laid out: a tree with implied tags, rules of visibility, and a
renderer that keeps the spacing of blocks, lists, and the columns of tables."""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import by_batch

# Classes of elements as the HTML standard has them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = set(
    "head script style template title noscript iframe noembed noframes object audio video canvas "
    "datalist map param rp svg math".split()
)
SPACED = set(  # blocks with a blank line before and after
    "p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table pre xmp blockquote figure hr form fieldset".split()
)
BLOCKS = SPACED | set(
    "html body div section article aside nav header footer main address hgroup li dt dd tr td th thead tbody "
    "tfoot caption colgroup center details summary dialog figcaption legend option optgroup search".split()
)
CLOSES_P = SPACED | set(
    "address article aside center details dialog div figcaption footer header hgroup main nav section search".split()
)
#: An opening tag ends these open elements, up to one of the bounds.
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: End tags do not reach over these.
SCOPES = {"table", "td", "th", "caption", "html"}
HEAD_TAGS = set("html head title meta link base script style noscript template".split())
#: Nesting beyond this is put beside its parent, as browsers do. Spans end here, as they do there.
MAX_DEPTH, MAX_SPAN = 150, 1000
#: A table may get so many blanks for each of its characters; columns of one that would need more
#: are aligned up to this width only.
MAX_BLANKS, MAX_PAD = 16, 60

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</[a-zA-Z][^>]*>?"""
    r"""|<[a-zA-Z][^\s/>]*+(?:[^>"']|"[^"]*"|'[^']*')*+>?""",
    re.S,
)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible|initial)", re.I)
KEEPS_SPACE = re.compile(r"white-space\s*:\s*(?:pre|break-spaces)", re.I)
ALIGNED = re.compile(r"text-align\s*:\s*(right|center)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)
    #: Whether its own text is seen, by its own or the nearest visibility given around it, and whether
    #: some element in it is seen.
    shown: bool = True
    reveals: bool = False

    def number(self, name: str, default: int) -> int:
        found = re.match(r"\s*(-?\d{1,9})", self.attributes.get(name, ""))
        return int(found[1]) if found else default

    def displayed(self) -> bool:
        return not (
            self.tag in HIDDEN
            or "hidden" in self.attributes
            or (self.tag == "dialog" and "open" not in self.attributes)
            or UNSEEN.search(self.attributes.get("style", ""))
        )

    def visible(self) -> bool:
        return (self.shown or self.reveals) and self.displayed()


def attributes_of(tag: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(NAME.sub("", tag, count=1).rstrip(">")):
        found.setdefault(name.lower(), html.unescape("".join(values)))
    return found


class Builder:
    """Builds the tree from tags and texts; the stack holds the open elements."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.stack = [self.root]
        self.deeper: list[str] = []  # open elements that are nested too deep to have a place

    def text(self, value: str) -> None:
        if "&" in value:
            value = html.unescape(value)
        self.leave_head(None if value.strip() else "head")
        if self.stack[-1].shown:
            self.stack[-1].children.append(value)

    def leave_head(self, tag: str | None) -> None:
        """A visible element or text ends an open head."""
        if tag not in HEAD_TAGS and len(self.stack) > 1 and self.stack[-1].tag == "head":
            self.stack.pop()

    def close(self, tags: set[str], bounds: set[str]) -> None:
        """End the outermost open element of ``tags`` within ``bounds``, and what is in it."""
        at = None
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in bounds:
                break
            if self.stack[i].tag in tags:
                at = i
        if at is not None:
            del self.stack[at:]
            self.deeper.clear()

    def start(self, tag: str, source: str) -> None:
        self.leave_head(tag)
        if tag == "html":
            self.root.attributes = attributes_of(source) | self.root.attributes
            return
        if tag in CLOSES_P:
            self.close({"p"}, SCOPES | {"button"})
        if tag in CLOSED_BY:
            self.close(*CLOSED_BY[tag])
        node = Node(tag, attributes_of(source) if len(source) > len(tag) + 2 else {})
        node.shown = self.stack[-1].shown
        for given in VISIBILITY.findall(node.attributes.get("style", "")):
            node.shown = given.lower() in {"visible", "initial"}
        if node.shown and not self.stack[-1].shown:
            for around in reversed(self.stack):
                if around.shown or around.reveals:
                    break
                around.reveals = True
        if tag in VOID or (source.endswith("/>") and tag in {"svg", "math"}):
            self.stack[-1].children.append(node)
        elif len(self.stack) < MAX_DEPTH or (not node.displayed() and self.stack[-1].displayed()):
            # What is not displayed needs no place in the layout, but has to hold what is in it.
            self.stack[-1].children.append(node)
            self.stack.append(node)
            self.deeper.clear()
        else:
            self.deeper.append(tag)

    def end(self, tag: str) -> None:
        if tag in self.deeper:
            del self.deeper[len(self.deeper) - 1 - self.deeper[::-1].index(tag) :]
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                self.deeper.clear()
                return
            if self.stack[i].tag in SCOPES and tag not in {"table", "tbody", "thead", "tfoot", "tr", "body", "html"}:
                return


def parse(source: str) -> Node:
    """The tree of a page; whatever the mark-up, no text is lost."""
    builder, at, size = Builder(), 0, len(source)
    while at < size:
        token = TOKEN.search(source, at)
        if token is None:
            builder.text(source[at:])
            break
        if token.start() > at:
            builder.text(source[at : token.start()])
        at, piece = token.end(), token[0]
        if piece.startswith("<![CDATA["):
            builder.text(html.escape(piece[9:].removesuffix("]]>"), quote=False))
            continue
        name = NAME.match(piece)
        if name is None:
            continue
        tag = name[1].lower()
        if piece[1] == "/":
            if tag == "p" and not any(node.tag == "p" for node in builder.stack):
                builder.start("p", "<p>")
            builder.end(tag)
            continue
        builder.start(tag, piece)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b", re.I).search(source, at)
            end = stop.start() if stop else size
            if tag == "textarea" and end > at:
                builder.text(source[at:end])
            at = end
    return builder.root


def width(text: str) -> int:
    return len(text) if text.isascii() else sum(1 + (unicodedata.east_asian_width(c) in "WF") for c in text)


class Lines:
    """Lines of a block, with its margins collapsed like those of a page."""

    def __init__(self, keep_space: bool) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.before = self.margin = 0
        self.keep_space = keep_space

    def text(self, value: str) -> None:
        self.inline.append(value)

    def flush(self) -> None:
        """End the line that is being written."""
        if not self.inline:
            return
        joined, self.inline = "".join(self.inline), []
        if self.keep_space:
            fresh = joined.split("\n")
        else:
            parts = [SPACE.sub(" ", part).strip(" ") for part in joined.split("\v")]
            if parts and not parts[-1]:
                parts.pop()  # a line break at the end of a block ends its last line
            fresh = parts
        if any(fresh):
            self.put(fresh)

    def put(self, fresh: list[str]) -> None:
        if self.lines:
            self.lines += [""] * self.margin
        else:
            self.before = self.margin
        self.margin = 0
        self.lines += fresh

    def block(self, fresh: list[str], before: int, after: int) -> None:
        self.flush()
        self.margin = max(self.margin, before)
        if fresh:
            self.put(fresh)
            self.margin = after


def flow(node: Node, keep_space: bool = False, listed: int = 0) -> list[str]:
    """The lines of what is in ``node``."""
    return laid_out(node, keep_space, listed).lines


def laid_out(node: Node, keep_space: bool, listed: int) -> Lines:
    lines = Lines(keep_space)
    counter = [node.number("start", 1)]
    closed = node.tag == "details" and "open" not in node.attributes
    walk(node, lines, keep_space, listed, counter, closed)
    lines.flush()
    return lines


def walk(node: Node, lines: Lines, keep_space: bool, listed: int, counter: list[int], closed: bool = False) -> None:
    for child in node.children:
        if isinstance(child, str):
            if not closed:
                lines.text(child if keep_space else child.replace("\v", " "))
        elif child.visible() and (not closed or child.tag == "summary"):
            kept = keep_space or child.tag in {"pre", "textarea", "xmp"} or bool(
                KEEPS_SPACE.search(child.attributes.get("style", ""))
            )
            if child.tag == "br":
                lines.text("\n" if keep_space else "\v")
            elif child.tag == "table":
                lines.block(table(child, listed), 1, 1)
            elif child.tag == "li":
                lines.block(item(child, node, kept, listed, counter), 0, 0)
            elif child.tag == "blockquote":
                lines.block([f"> {line}".rstrip() for line in flow(child, kept, listed)], 1, 1)
            elif child.tag in BLOCKS:
                inner = listed + (child.tag in {"ul", "ol", "menu", "dir"})
                spaced = child.tag in SPACED and not (listed and inner > listed)
                placed = laid_out(child, kept, inner)
                fresh = placed.lines
                if child.tag == "dd":
                    fresh = [f"  {line}".rstrip() for line in fresh]
                while kept and fresh and not fresh[0].strip():
                    fresh.pop(0)
                while kept and fresh and not fresh[-1].strip():
                    fresh.pop()
                lines.block(fresh, max(placed.before, spaced), max(placed.margin, spaced))
            else:
                walk(child, lines, keep_space, listed, counter)
                if child.tag in {"option", "button", "select"}:
                    lines.text(" ")


def item(node: Node, parent: Node, keep_space: bool, listed: int, counter: list[int]) -> list[str]:
    """A list item: its mark before the first line, the others below it."""
    mark = "- "
    if parent.tag == "ol":
        counter[0] = node.number("value", counter[0])
        mark = f"{counter[0]}. "
        counter[0] += 1
    fresh = flow(node, keep_space, max(listed, 1)) or [""]
    return [(mark + fresh[0]).rstrip(), *[(" " * len(mark) + line).rstrip() for line in fresh[1:]]]


def rows_of(node: Node) -> tuple[list[Node], list[Node]]:
    """Rows and captions of a table, without those of tables in it; stray content is a row."""
    rows, captions, groups = [], [], [node]
    while groups:
        group = groups.pop()
        inner = []
        for child in group.children:
            if isinstance(child, str):
                if child.strip():
                    rows.append(Node("tr", {}, [Node("td", {}, [child])]))
            elif not child.visible():
                continue
            elif child.tag == "tr":
                rows.append(child)
            elif child.tag == "caption":
                captions.append(child)
            elif child.tag in {"thead", "tbody", "tfoot"}:
                inner.append(child)
                rows += rows_of(child)[0]
            elif child.tag in {"td", "th"}:
                rows.append(Node("tr", {}, [child]))
            elif child.tag != "colgroup":
                rows.append(Node("tr", {}, [Node("td", {}, [child])]))
    return rows, captions


def grid_of(rows: list[Node], listed: int) -> list[list[tuple[int, int, list[str], str]]]:
    """By row its cells: first column, columns it spans, lines and alignment. Columns in which no
    cell begins are left out, so that spans cannot make a table wider than it has cells."""
    grid: list[list[tuple[int, int, list[str], str]]] = []
    blocked: list[tuple[int, int, int]] = []  # stretches of columns that cells from above still fill
    for row in rows:
        cells, column, ahead = [], 0, sorted(blocked)
        fresh = []
        for cell in row.children:
            if isinstance(cell, str):
                if not cell.strip():
                    continue
                cell = Node("td", {}, [cell])
            elif not cell.visible():
                continue
            while ahead and ahead[0][0] <= column:
                column = max(column, ahead.pop(0)[1])
            span = min(max(cell.number("colspan", 1), 1), MAX_SPAN)
            below = min(max(cell.number("rowspan", 1), 1), MAX_SPAN)
            found = ALIGNED.search(cell.attributes.get("style", ""))
            align = (found[1] if found else cell.attributes.get("align", "")).lower()
            whole = cell if cell.tag in {"td", "th"} else Node("td", {}, [cell])
            cells.append((column, span, flow(whole, False, listed), align))
            fresh.append((column, column + span, below))
            column += span
        blocked = [(a, b, n - 1) for a, b, n in blocked + fresh if n > 1]
        grid.append(cells)
    begins = sorted({cell[0] for cells in grid for cell in cells})
    return [
        [
            (bisect_left(begins, a), bisect_left(begins, a + span) - bisect_left(begins, a), lines, align)
            for a, span, lines, align in cells
        ]
        for cells in grid
    ]


def table(node: Node, listed: int) -> list[str]:
    """A table: cells of a column begin below each other, over spans of rows and columns."""
    rows, captions = rows_of(node)
    grid = grid_of(rows, listed)
    widths: dict[int, int] = {}
    for cells in grid:
        for column, span, lines, _ in cells:
            if span == 1:
                widths[column] = max(widths.get(column, 0), *map(width, lines), 0) if lines else widths.get(column, 0)
    size = sum(len(line) + 1 for cells in grid for cell in cells for line in cell[2])
    n_lines = sum(max((len(cell[2]) for cell in cells), default=0) for cells in grid)
    if n_lines * sum(n + 2 for n in widths.values()) > MAX_BLANKS * size + 10_000:
        widths = {column: min(n, MAX_PAD) for column, n in widths.items()}
    out = [line for caption in captions for line in flow(caption, False, listed)]
    for cells in grid:
        for i in range(max((len(cell[2]) for cell in cells), default=0)):
            line, at, filled = "", 0, 0
            for column, span, lines, align in cells:
                while at < column:
                    filled += widths.get(at, 0) + 2
                    at += 1
                text = lines[i] if i < len(lines) else ""
                room = sum(widths.get(c, 0) for c in range(column, column + span)) + 2 * (span - 1)
                free = max(room - width(text), 0)
                before = free if align == "right" else free // 2 if align == "center" else 0
                gap = max(filled - width(line), 2 if line.strip() else 0)
                line += " " * (gap + before) + text
                filled += room + 2
                at = column + span
            out.append(line.rstrip())
    return out


def text_of(source: str | None) -> str | None:
    """The visible text of a page; null for null."""
    return None if source is None else "\n".join(flow(parse(source.replace("\r\n", "\n"))))


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id_col, text``: the visible text of every page, as it would be laid out.

    Text of a hidden element (by tag, ``hidden``, ``display: none`` or ``visibility: hidden``) is
    left out, but for elements in a hidden one that set ``visibility: visible`` again; all other
    text stays. Elements nested more than 150 deep are laid out as text of the one around them.
    Columns are aligned whatever their width, unless that takes more than 16 blanks for every
    character of the table (then up to 60). A null page gives null, an empty one an empty text;
    broken mark-up is repaired; pages are read whole; repeated rows and null ids are kept;
    other columns are not read."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([text_of(value.as_py()) for value in batch.column(1)], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), texts], ["id", "text"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(by_batch(run), f"id {kind}, text string").withColumnRenamed("id", id_col)
