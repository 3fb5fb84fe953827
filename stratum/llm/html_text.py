"""Visible text of HTML pages, laid out: a small tree builder with implied tags, and a renderer of blocks.

The builder closes what HTML closes by itself (p before a block, li before li, cells and rows of tables, options) and
ignores end tags without a start. The renderer emits all text that a browser draws:

* Not drawn are the head, scripts, styles, templates, comments, data lists, closed dialogs, the fallback content of
  object, canvas, audio, video, progress, meter, iframe, noscript, noembed and noframes, titles, descriptions, definitions and annotations
  in svg and math, and elements with `aria-hidden=true`, with display:none, or with `hidden` and no other display.
* visibility:hidden is inherited, and a visibility:visible further in shows that part again.
* Form fields show what a browser shows in them: the text of a textarea, the value of text inputs and buttons, the
  chosen option of a drop-down list, all options of a list box. Closed details count as open.

White space collapses as in a browser (not in pre, xmp, listing and textarea, nor under white-space: pre, pre-wrap or
break-spaces; pre-line collapses too). An empty line is put around paragraphs, headings, lists and tables; other blocks
begin a line. List items get a dash or a number (start, value and reversed count), and nested ones an indent (of at most
64 characters, so that deep nesting does not grow the text). Table cells are aligned in columns, with colspan and rowspan;
of a cell of several lines, each stands under the one before it.

Defined cases: null or empty html gives an empty text; text outside any tag counts; unclosed tags end with the page;
bytes that are no markup (a lone <, or a tag that the page ends before its '>') are text; a quote in a tag opens a string
only right behind =, and only if another closes it. Work and output grow in step with the page, whatever its markup: open
elements are looked up by tag; tables nested more than 32 deep are laid out a row a line; a table whose padding would
exceed 16 times its text has its cells apart by two spaces without padding; and where rows have to go around more than 64
cells from above for each of the table's cells, rowspan no longer counts. None of these drops text. Pages are rendered
one by one, so ties and repeated rows make no difference; the new column gets underscores behind its name if a kept
column has that name.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, text_lists

_S = r"[ \t\n\r\f]"
#: An attribute as HTML reads it: only a quote behind = opens a string, and only if another closes it.
_PAIR = (
    r"([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)"
    rf"(?:{_S}*+={_S}*+(?:\"([^\"]*+)\"|'([^']*+)'|([^ \t\n\r\f>\"'][^ \t\n\r\f>]*+))?+)?+"
)
#: A comment, a start or end tag, or a declaration; possessive throughout, so every byte is looked at a few times.
_TOKEN = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))"
    rf"|(?:(?P<close>/)?(?P<tag>[a-zA-Z][^ \t\n\r\f/>]*+)(?P<rest>(?:[ \t\n\r\f/]++|{_PAIR})*+)|[!?/][^>]*+)(?P<end>>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(_PAIR)
_SPACE = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
UNSEEN = frozenset(
    "head script style template noscript title datalist iframe noembed noframes object canvas audio video progress meter".split()
)
#: Not drawn inside svg and math.
UNDRAWN = frozenset(
    "title desc defs metadata symbol clippath mask pattern marker annotation annotation-xml mphantom".split()
)
#: HTML again inside svg and math.
ISLANDS = ("foreignobject", "desc", "annotation-xml", "mi", "mo", "mn", "ms", "mtext")
#: What stands in these is drawn apart, so a space divides it.
SPREAD = frozenset("mfrac mroot msub msup msubsup munder mover munderover mtable mtr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VERBATIM = frozenset("pre xmp listing textarea".split())
APART = HEADINGS | frozenset(
    "p ul ol dl table blockquote pre xmp listing figure fieldset hr menu".split()
)
BLOCK = APART | frozenset(
    "html body div section article header footer nav main aside address form li dt dd tr figcaption center details "
    "summary hgroup search legend caption optgroup dialog".split()
)
#: Drawn in a box of their own within a line, so a space stands on both sides.
FIELDS = frozenset(("select", "textarea", "button"))
#: Text fields and buttons, by their type, whose value is drawn.
WRITTEN = frozenset(
    "text search tel url email number date month week time datetime-local submit reset button".split()
)
_CELLS, _PARTS = {"td", "th"}, {"thead", "tbody", "tfoot"}
#: Opening the key closes an open element of the first set, if none of the second stands between.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
    **dict.fromkeys(_CELLS, (_CELLS, {"tr", "table"})),
    "tr": (_CELLS | {"tr"}, {"table"}),
    **dict.fromkeys(_PARTS, (_CELLS | {"tr"} | _PARTS, {"table"})),
}
#: Opening one of these ends an open caption of the same table.
AFTER_CAPTION = _CELLS | _PARTS | {"tr", "caption", "col", "colgroup"}
#: An end tag does not reach beyond these.
FENCE = frozenset(("table", "td", "th", "button", "object", "caption"))
END_FENCE = {"table": frozenset()} | dict.fromkeys(_CELLS | _PARTS | {"tr"}, frozenset({"table"}))
HEAD_TAGS = frozenset("title meta link base style script noscript template".split())
#: Tables nested deeper are laid out a row a line; characters of an indent; padding for each character of a table.
DEEPEST_TABLE, WIDEST_INDENT, MOST_PADDING = 32, 64, 16
#: Cells from rows above that a row has to go around, for each row and cell of a table on average.
MOST_HELD = 64
#: The most columns and rows that HTML lets a cell span.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


class Node:
    """An element: seen is False for display:none; visible, and kept for white space that does not collapse, are None where
    they are inherited."""

    __slots__ = ("tag", "children", "seen", "visible", "kept", "attributes")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.seen, self.visible, self.kept, self.attributes = tag, True, None, None, attributes or {}
        self.children: list[Node | str] = []


def _attributes(rest: str) -> dict[str, str]:
    said: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        said.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return said


def _style(text: str) -> dict[str, str]:
    """What a style attribute says of each property: the last word, but an important one first."""
    plain: dict[str, str] = {}
    important: dict[str, str] = {}
    for part in text.lower().split(";"):
        name, _, value = part.partition(":")
        value, bang, _ = value.partition("!")
        (important if bang else plain)[name.strip()] = value.strip()
    return plain | important


def _resolve(node: Node, foreign: bool) -> None:
    """Sets whether a node is drawn, from its tag and attributes."""
    said = node.attributes
    node.seen = node.tag not in (UNDRAWN if foreign else UNSEEN) and (node.tag != "dialog" or "open" in said)
    if said:
        style = _style(said["style"]) if "style" in said else {}
        display = style.get("display", "none" if "hidden" in said else "")
        node.seen = node.seen and display != "none" and said.get("aria-hidden", "").lower() != "true"
        if style.get("visibility") in ("hidden", "collapse", "visible"):
            node.visible = style["visibility"] == "visible"
        if style.get("white-space") in ("normal", "nowrap", "pre-line", "pre", "pre-wrap", "break-spaces"):
            node.kept = style["white-space"] in ("pre", "pre-wrap", "break-spaces")


class Builder:
    """The open elements, and for each tag where in the stack they are."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.stack = [self.root]
        self.places: defaultdict[str, list[int]] = defaultdict(list)

    def innermost(self, names: Iterable[str]) -> int:
        return max((self.places[n][-1] for n in names if self.places[n]), default=0)

    def pop(self, down_to: int) -> None:
        for node in self.stack[down_to:]:
            self.places[node.tag].pop()
        del self.stack[down_to:]

    def close(self, names: Iterable[str], fences: Iterable[str], all_of_them: bool = False) -> None:
        """Closes the innermost open element with one of the names (or all), unless a fence stands within it."""
        while (at := self.innermost(names)) > self.innermost(fences):
            self.pop(at)
            if not all_of_them:
                break

    def add(self, child: Node | str) -> None:
        self.stack[-1].children.append(child)

    def end(self, tag: str) -> None:
        if tag == "br" or tag == "p" and not self.places["p"]:
            self.add(Node(tag))
        elif tag != "html":
            self.close((tag,), END_FENCE.get(tag, FENCE - {tag}))

    def start(self, tag: str, rest: str) -> Node | None:
        """Opens an element; returns it if it is a RAW one, whose content the caller is to read."""
        foreign = self.innermost(("svg", "math")) > self.innermost(ISLANDS)
        if foreign and (tag in ("text", "foreignobject") or self.stack[-1].tag in SPREAD):
            self.add(" ")
        if tag in BLOCK:
            self.close(("p",), FENCE)
            if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
                self.pop(len(self.stack) - 1)
        if tag in AFTER_CAPTION:
            self.close(("caption",), ("table",))
        if tag in IMPLIED_END:
            self.close(*IMPLIED_END[tag], all_of_them=tag == "tr" or tag in _PARTS or tag == "optgroup")
        if self.stack[-1].tag == "head" and tag not in HEAD_TAGS:
            self.pop(len(self.stack) - 1)
        node = Node(tag, _attributes(rest) if rest else None)
        _resolve(node, foreign)
        self.add(node)
        if tag in VOID or rest.endswith("/") and (foreign or tag in ("svg", "math")):
            return None
        if tag in RAW:
            return node
        self.places[tag].append(len(self.stack))
        self.stack.append(node)
        return None


def parse(page: str) -> Node:
    """The tree of a page."""
    build, at = Builder(), 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m and m["end"] == "":
            m = None
        text = page[at : m.start() if m else len(page)]
        if text:
            build.add(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if m["tag"] is None or m["tag"].lower() == "html":
            continue
        tag = m["tag"].lower()
        if m["close"]:
            build.end(tag)
            continue
        node = build.start(tag, m["rest"])
        if tag == "plaintext":
            build.add(page[at:])
            break
        if node:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            inner = page[at : stop.start() if stop else len(page)]
            if tag in VERBATIM:
                node.children.append(html.unescape(inner) if tag == "textarea" else inner)
            closing = page.find(">", stop.end()) if stop else -1
            at = closing + 1 if closing >= 0 else len(page)
    return build.root


class Layout:
    """Lines of text so far, and the one that is being written."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.blank = False
        self.indent = ""
        self.mark = ""  # of a list item that has no line yet: it stands in the place of the indent

    def write(self, text: str) -> None:
        words = _SPACE.sub(" ", text)
        if not words:  # a reference to a control character is nothing
            return
        if words == " ":
            self.space = self.space or bool(self.parts)
            return
        if words[0] == " ":
            self.space, words = self.space or bool(self.parts), words[1:]
        if self.space and self.parts:
            self.parts.append(" ")
        self.space = words[-1:] == " "
        self.parts.append(words.rstrip(" "))

    def verbatim(self, text: str) -> None:
        first, *more = text.split("\n")
        self.parts += [" ", first] if self.space and self.parts else [first]
        for line in more:
            self.line(True)
            self.parts.append(line)
        self.space = False

    def line(self, force: bool = False) -> None:
        """Ends the line being written, if anything is in it."""
        if self.parts or force:
            text = "".join(self.parts).rstrip(" \t\r\f")
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.lines.append((self.mark or self.indent) + text if text or self.mark else "")
            self.mark, self.parts = "", []
        self.space = False

    def apart(self) -> None:
        self.line()
        self.blank = True

    def item(self, mark: str) -> None:
        """Begins a list item; the lines behind its first are indented by the width of its mark."""
        self.mark = self.indent + mark
        self.deeper(len(mark))

    def deeper(self, by: int) -> None:
        self.indent = (self.indent + " " * by)[:WIDEST_INDENT]

    def text(self) -> str:
        self.line()
        return "\n".join(self.lines).strip("\n")


def _is_cell(child: Node | str) -> bool:
    return isinstance(child, Node) and child.tag in _CELLS


def _span(cell: Node, name: str, most: int) -> int:
    said = re.match(r"\s*(\d{1,9})", cell.attributes.get(name, "1"))
    return min(most, int(said[1])) if said else 1


def _positions(rows: list[list[Node]], ends: list[int]) -> list[list[tuple[int, int]]]:
    """First column and the one behind the last of every cell; ends[r]: the row behind the last of r's row group."""
    placed: list[list[tuple[int, int]]] = []
    held: list[tuple[int, int, int]] = []  # first column, end column, end row: cells that reach into later rows
    steps, most = 0, MOST_HELD * (len(rows) + sum(map(len, rows)))
    for r, row in enumerate(rows):
        steps += len(held)
        held = sorted(h for h in held if h[2] > r) if steps <= most else []
        at, k, own, reaching = 0, 0, [], []
        for cell in row:
            while k < len(held) and held[k][0] <= at:
                at, k = max(at, held[k][1]), k + 1
            end = at + max(1, _span(cell, "colspan", MOST_COLUMNS))
            down = _span(cell, "rowspan", MOST_ROWS) or MOST_ROWS  # 0: to the end of its row group
            if down > 1 and r + 1 < ends[r]:
                reaching.append((at, end, min(r + down, ends[r])))
            own.append((at, end))
            at = end
        held += reaching
        placed.append(own)
    return placed


def _aligned(grid: list[list[tuple[int, int, str]]]) -> list[str] | None:
    """Lines of rows of cells (first column, end column, text of one line), padded to columns; None where that is too much."""
    edges = sorted({x for row in grid for a, b, _ in row for x in (a, b)})
    place = {x: k for k, x in enumerate(edges)}
    widths = [0] * max(0, len(edges) - 1)
    spans: list[tuple[int, int, int]] = []
    for row in grid:
        for a, b, text in row:
            first, last = place[a], place[b] - 1
            if first == last:
                widths[first] = max(widths[first], len(text))
            else:
                spans.append((last, first, len(text)))
    for last, first, size in sorted(spans):
        # Columns without any text take no room, and no gap.
        taken = sum(w + 2 for w in widths[first : last + 1] if w) - 2
        if size > taken:
            widths[last] += size - max(taken, 0)
    begins = [0, *accumulate(w + 2 if w else 0 for w in widths)]
    text_size = sum(len(text) for row in grid for _, _, text in row)
    padded = sum(max((begins[place[a]] for a, _, text in row if text), default=0) for row in grid)
    if padded > MOST_PADDING * text_size:
        return None
    lines = []
    for row in grid:
        parts, at = [], 0
        for a, _, text in row:
            if text:
                gap = begins[place[a]] - at
                parts += [" " * (gap if gap > 0 else 2 * bool(at)), text]
                at = max(begins[place[a]], at + 2 * bool(at)) + len(text)
        lines.append("".join(parts).rstrip())
    return lines


def _table(node: Node, depth: int, visible: bool) -> list[str]:
    """A table's rows as aligned lines; what stands between the rows comes first."""
    rows: list[tuple[Node, int]] = []  # and the number of their row group
    captions: list[str] = []
    groups = 0
    todo: list[tuple[Node | str, int]] = [(c, 0) for c in reversed(node.children)]
    while todo:
        child, group = todo.pop()
        if isinstance(child, str):
            if child.strip() and visible:
                captions.append(" ".join(child.split()))
        elif not child.seen:
            continue
        elif child.tag == "tr":
            rows.append((child, group))
        elif child.tag in _PARTS:
            groups += 1
            todo += [(c, groups) for c in reversed(child.children)]
        elif child.tag in _CELLS:
            row = Node("tr")
            row.children.append(child)
            rows.append((row, group))
        elif text := render(child, depth=depth, visible=visible):
            captions += text.split("\n")
    ends, grid = [0] * len(rows), []
    for r in range(len(rows) - 1, -1, -1):
        last = r + 1 == len(rows) or rows[r + 1][1] != rows[r][1]
        ends[r] = r + 1 if last else ends[r + 1]
    cells = [[c for c in row.children if _is_cell(c) and c.seen] for row, _ in rows]
    for (row, _), own, placed in zip(rows, cells, _positions(cells, ends)):
        shown = visible if row.visible is None else row.visible
        line = [(a, b, render(cell, True, depth, shown)) for cell, (a, b) in zip(own, placed)]
        rest = Node("tr")  # what stands in the row beside its cells
        rest.children = [c for c in row.children if not _is_cell(c)]
        if text := render(rest, True, depth, shown).replace("\n", " "):
            end = placed[-1][1] if placed else 0
            line.append((end, end + 1, text))
        if any(text for _, _, text in line):
            grid.append(line)
    # A line of the page for each line of a row's longest cell.
    split: list[list[tuple[int, int, str]]] = []
    for row in grid:
        texts = [(a, b, text.split("\n")) for a, b, text in row if text]
        own = [[] for _ in range(max(len(t) for _, _, t in texts))]
        for a, b, t in texts:
            for k, x in enumerate(t):
                own[k].append((a, b, x))
        split += own
    lines = _aligned(split)
    if lines is None:  # cell by cell
        lines = [x for row in grid for x in (["  ".join(t for _, _, t in row if t)] if not any("\n" in t for _, _, t in row) else [x for _, _, t in row if t for x in t.split("\n")])]
    return captions + lines


def _options(select: Node) -> list[Node | str]:
    """What a list shows: the chosen option, or all options and the labels of their groups in a list box."""
    options: list[Node] = []
    shown: list[Node | str] = []
    todo = list(reversed(select.children))
    while todo:
        child = todo.pop()
        if isinstance(child, str) or not child.seen:
            continue
        if child.tag == "option":
            options.append(child)
            shown += [Node("br"), child] if shown else [child]
        else:
            if child.tag == "optgroup" and child.attributes.get("label"):
                shown += [Node("br"), child.attributes["label"]] if shown else [child.attributes["label"]]
            todo += reversed(child.children)
    if "multiple" in select.attributes or _span(select, "size", MOST_ROWS) > 1:
        return shown
    chosen = [o for o in options if "selected" in o.attributes][-1:]
    return chosen or [o for o in options if "disabled" not in o.attributes][:1]


def _number(said: str | None, otherwise: int) -> int:
    return int(said) if said and re.fullmatch(r"\s*[-+]?\d{1,9}\s*", said) else otherwise


def render(root: Node, inside: bool = False, depth: int = 0, visible: bool = True) -> str:
    """The visible text of a node; inside: of its children, whatever the node is; depth: of tables around it."""
    out = Layout()
    lists: list[list] = []  # [next number or None, step] of the open lists
    work: list[tuple] = [("in", root)]
    pre = False
    while work:
        what, node = work.pop()
        if what != "in":
            tag = node.tag
            if tag in ("ul", "ol", "menu"):
                lists.pop()
                out.line() if lists else out.apart()
            elif tag in APART:
                out.apart()
            elif tag in BLOCK:
                out.line()
            elif tag in FIELDS:
                out.write(" ")
            indent, pre, visible = what
            if tag in BLOCK:
                out.indent = indent
                if tag == "li":
                    out.mark = ""
            continue
        if isinstance(node, str):
            if visible:
                out.verbatim(node) if pre else out.write(node)
            continue
        if not node.seen:
            continue
        tag, state = node.tag, (out.indent, pre, visible)
        if node.visible is not None:
            visible = node.visible
        if node.kept is not None or tag in VERBATIM:
            pre = tag in VERBATIM if node.kept is None else node.kept
        if tag == "br":
            out.line(True)
        elif tag == "hr":
            out.apart()
        elif tag == "input":
            if visible and node.attributes.get("type", "text").lower() in WRITTEN:
                out.write(f" {node.attributes.get('value', '')} ")
        elif tag == "table" and depth < DEEPEST_TABLE:
            out.apart()
            for line in _table(node, depth + 1, visible):
                out.parts = [line]
                out.line()
            out.apart()
        else:
            children = _options(node) if tag == "select" else node.children
            if tag in ("ul", "ol", "menu"):
                out.line() if lists else out.apart()
                back = tag == "ol" and "reversed" in node.attributes
                first = sum(isinstance(c, Node) and c.tag == "li" for c in node.children) if back else 1
                lists.append([_number(node.attributes.get("start"), first) if tag == "ol" else None, -1 if back else 1])
            elif tag == "li":
                out.line()
                number = lists[-1][0] if lists else None
                if number is not None:
                    number = _number(node.attributes.get("value"), number)
                    lists[-1][0] = number + lists[-1][1]
                if visible:
                    out.item("- " if number is None else f"{number}. ")
            elif tag in ("dd", "blockquote"):
                out.apart() if tag == "blockquote" else out.line()
                out.deeper(2)
            elif tag in FIELDS or tag in _CELLS and not (inside and node is root):
                out.write(" ")
            elif tag in APART:
                out.line() if out.mark else out.apart()
            elif tag in BLOCK:
                out.line()
            if tag in VERBATIM:
                if children and isinstance(children[0], str):  # the line break behind the tag does not count
                    children = [re.sub(r"\A\r?\n", "", children[0]), *children[1:]]
            work.append((state, node))
            work += [("in", c) for c in reversed(children)]
            continue
        pre, visible = state[1:]
    return out.text()


def page_text(page: str) -> str:
    return render(parse(page))


def extract_text(pages: DataFrame, keep: list[str], html_col: str = "html", out_col: str = "text") -> DataFrame:
    """The columns of keep, then each page's visible text."""
    names = [f"_c{k}" for k in range(len(keep))]
    carried = [F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)]
    rows = pages.select(*carried, F.col(f"`{html_col}`").cast("string").alias("_html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, pages_ in text_lists(batch, len(names)):
                texts = [page_text(p).encode("utf-8", "replace").decode() for p in pages_]
                own = [batch.column(k).slice(at, end - at) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string())], names=[*names, "_text"])

    schema = ", ".join([*(f"{n} {kinds[n]}" for n in names), "_text string"])
    return rows.mapInArrow(extract, schema).toDF(*keep, free_name(keep, out_col))
