"""HTML extraction by layout-aware rendering.

A tokenizer cuts the source into tags, text and raw elements in one pass; a tree builder opens implied
parents, closes what the next tag ends (paragraphs, items, rows, cells, options, the head) and ignores
stray end tags; visibility rules prune scripts, styles, templates, ``hidden`` and ``display: none``
branches and the like, and blank what is ``visibility: hidden`` but not what a part of it shows again.
The renderer emits all visible text: blocks on lines of their own, paragraph-like ones between blank
lines, list items with marks and numbers, indented by depth, tables as columns of equal width in
which cells keep their lines and span rows and columns, preformatted text as it stands.

Time and output grow with the page, however its tags are nested or left open: open elements are found
by tag, not by walking the stack. Bounds on layout only, never on text: indentation stops to grow at
``MOST_INDENT``, columns at ``WIDEST`` (earlier where a page's ``ROOM`` for blanks is spent), tables inside ``MOST_TABLES`` others are flowed like blocks, and a table whose
spanned rows take more than ``MOST_STEPS`` steps to lay out goes on without spans of rows.

Edge cases: null, empty and text-free pages give the empty text; unclosed or crossed tags are closed as
browsers do, a tag or comment that never ends swallows the rest of the page as it does there, and
``<`` before anything but a letter, ``/``, ``!`` or ``?`` is text; closed ``details`` count as seen;
repeated rows give equal texts; bytes that aren't valid UTF-8 are read as U+FFFD; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from brindle.llm.texts import arrow_map, valid

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noframes textarea title xmp".split())
INVISIBLE = frozenset("head title script style noscript template iframe noframes object audio video canvas datalist desc defs metadata annotation annotation-xml rp".split())
#: What may stand in a head; anything else ends it.
IN_HEAD = frozenset("base link meta title script style noscript noframes template".split())
#: Blocks that stand between blank lines, and blocks that only start a line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure fieldset".split())
LINED = frozenset("html body div section article aside nav main header footer address form li dt dd tr caption legend details summary dialog figcaption center option hgroup search menu".split())
BLOCKS = SPACED | LINED
LISTS = frozenset(("ul", "ol", "menu"))
CELLS = frozenset(("td", "th"))
#: A start tag that ends open elements: tag -> (the elements it ends, the elements that stop the search).
ENDS = {
    "li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
ENDS["thead"] = ENDS["tfoot"] = ENDS["tbody"]
_P_STOPS = frozenset(("td", "th", "li", "table", "button"))
#: End tags that close elements beyond the borders of a cell or table.
_CROSSING = BLOCKS | CELLS | {"tbody", "thead", "tfoot"}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SKIP = re.compile(r"[\s/]*")
_SPACE = re.compile(r"\s*")
_ATTRIBUTE = re.compile(r"=?[^\s/>=]*")
_UNQUOTED = re.compile(r"[^\s>]*")
_BLANKS = re.compile(r"[ \t\n\f\r]+")
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I) for tag in RAW}
_DECLARATION = re.compile(r"""\s*([\w-]+)\s*:((?:[^;"'()]|"[^"]*"|'[^']*'|\([^()]*\))*)(?:;|\Z)|[^;]*(?:;|\Z)""")
#: Input types whose value is seen.
_SEEN_INPUTS = frozenset("text search url tel email number date month week time datetime-local submit button reset".split()) | {""}
MOST_INDENT = 64
MOST_TABLES = 20
MOST_STEPS = 500_000
#: A column is as wide as its widest line of at most so many characters; longer lines stand out. Narrower columns if room is short.
WIDEST = 200
WIDTHS = (200, 80, 30, 10, 0)
#: Characters that blanks and bars may take on a page: so many, and so many for each of its own.
ROOM, ROOM_SHARE = 10_000, 4
#: Columns that a cell spans at most (fixed value of the format).
MOST_SPAN = 1000


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def _attributes(source: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes that begin at ``at`` inside a tag, and the place behind the tag; -1 if it never ends."""
    found: dict[str, str] = {}
    while True:
        at = _SKIP.match(source, at).end()
        if at >= len(source):
            return found, -1
        if source[at] == ">":
            return found, at + 1
        name = _ATTRIBUTE.match(source, at)
        at, value = _SPACE.match(source, name.end()).end(), ""
        if source[at : at + 1] == "=":
            at = _SPACE.match(source, at + 1).end()
            quote = source[at : at + 1]
            if quote in ('"', "'") and quote:
                end = source.find(quote, at + 1)
                if end < 0:
                    return found, -1
                value, at = source[at + 1 : end], end + 1
            else:
                plain = _UNQUOTED.match(source, at)
                value, at = plain[0], plain.end()
        found.setdefault(name[0].lower(), html.unescape(value))


class _Builder:
    """The stack of open elements, with the depths of each tag, so that an element is found without a walk."""

    def __init__(self):
        self.root = Node("html")
        self.stack = [self.root]
        self.depths: dict[str, list[int]] = defaultdict(list)

    def top(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node, open_it: bool = True) -> None:
        self.stack[-1].children.append(node)
        if open_it:
            self.depths[node.tag].append(len(self.stack))
            self.stack.append(node)

    def cut(self, depth: int) -> None:
        """Close the elements from ``depth`` on."""
        for node in self.stack[depth:]:
            self.depths[node.tag].pop()
        del self.stack[depth:]

    def deepest(self, tags) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def close(self, ends, stops) -> None:
        """Close the open elements ``ends`` above the nearest of ``stops``."""
        floor = self.deepest(stops)
        while (depth := self.deepest(ends)) > floor:
            self.cut(depth)

    def text(self, raw: str) -> None:
        if raw:
            if self.stack[-1].tag == "head" and raw.strip():
                self.cut(len(self.stack) - 1)
            self.stack[-1].children.append(html.unescape(raw))

    def start(self, tag: str, attrs: dict[str, str]) -> Node:
        if self.stack[-1].tag == "head" and tag not in IN_HEAD:
            self.cut(len(self.stack) - 1)
        if tag in BLOCKS or tag == "hr":
            self.close(("p",), _P_STOPS)
        if tag in ENDS:
            self.close(*ENDS[tag])
        if tag in CELLS and self.stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.push(Node("tr"))
        node = Node(tag, attrs)
        self.push(node, tag not in VOID and tag not in RAW)
        return node

    def end(self, tag: str) -> None:
        if tag == "br" or tag == "p" and not self.depths.get("p"):
            self.stack[-1].children.append(Node(tag))
            return
        depth = self.deepest((tag,))
        if depth and (tag in _CROSSING or depth > self.deepest(("td", "th", "table"))):
            self.cut(depth)


def build(source: str) -> Node:
    """The tree of a page; text is kept as ``str`` children with entities resolved."""
    page, at, size = _Builder(), 0, len(source)
    while at < size:
        tag_at = source.find("<", at)
        if tag_at < 0 or tag_at == size - 1:
            page.text(source[at:])
            break
        after = source[tag_at + 1]
        closing = after == "/"
        name = _NAME.match(source, tag_at + 1 + closing)
        if name is None:
            if not closing and after not in "!?":  # a bare <
                page.text(source[at : tag_at + 1])
                at = tag_at + 1
                continue
            page.text(source[at:tag_at])
            if source.startswith("<!--", tag_at):
                end = -1 if source.startswith((">", "->"), tag_at + 4) else source.find("-->", tag_at + 4)
                at = source.index(">", tag_at) + 1 if source.startswith((">", "->"), tag_at + 4) else end + 3 if end >= 0 else size
            else:
                end = source.find(">", tag_at)
                at = end + 1 if end >= 0 else size
            continue
        page.text(source[at:tag_at])
        tag = name[0].lower()
        at = name.end()
        if source[at : at + 1] == ">":
            attrs, at = {}, at + 1
        else:
            attrs, at = _attributes(source, at)
            if at < 0:
                break
        if closing:
            page.end(tag)
        elif tag == "html":
            page.root.attrs.update(attrs)
        elif tag in RAW:
            node = page.start(tag, attrs)
            end = _RAW_END[tag].search(source, at)
            stop = end.start() if end else size
            if tag == "textarea" or tag == "xmp":
                node.children.append(source[at:stop] if tag == "xmp" else html.unescape(source[at:stop]))
            at = end.end() if end else size
        else:
            page.start(tag, attrs)
    return page.root


def style(source: str) -> dict[str, str]:
    """The declarations of a style attribute: property -> value, lower-cased; the last one counts, important ones before others."""
    found: dict[str, tuple[bool, str]] = {}
    for name, value in _DECLARATION.findall(source):
        if name:
            value = value.strip().lower()
            important = value.endswith("!important") or value.replace(" ", "").endswith("!important")
            value = value.rpartition("!")[0].strip() if important else value
            if important or not found.get(name.lower(), (False, ""))[0]:
                found[name.lower()] = important, value
    return {k: v for k, (_, v) in found.items()}


def displayed(node: Node, rules: dict[str, str]) -> bool:
    """Whether an element has a box at all."""
    if node.tag in INVISIBLE or node.tag == "dialog" and "open" not in node.attrs and "display" not in rules:
        return False
    if node.tag == "input" and node.attrs.get("type", "").strip().lower() == "hidden":
        return False
    return rules.get("display") != "none" if "display" in rules else "hidden" not in node.attrs


def prune(root: Node) -> Node:
    """Drop branches without a box and blank the text of what is hidden by visibility, which children inherit or undo."""
    todo: list[tuple[Node, bool]] = [(root, True)]
    while todo:
        node, seen = todo.pop()
        kept = []
        for c in node.children:
            if isinstance(c, str):
                if seen:
                    kept.append(c)
                continue
            rules = style(c.attrs["style"]) if "style" in c.attrs else {}
            if not displayed(c, rules):
                continue
            wanted = rules.get("visibility")
            inside = seen if wanted in (None, "inherit") else wanted not in ("hidden", "collapse")
            if not inside:
                for name in ("alt", "value"):
                    c.attrs.pop(name, None)
                c.attrs["_unseen"] = ""
            kept.append(c)
            todo.append((c, inside))
        node.children = kept
    return root


class _Page:
    """Lines of output: collapses blanks, and keeps one blank line at most between blocks."""

    def __init__(self, depth: int, room: list[int]):
        self.depth, self.room = depth, room  # room: characters that may still be spent on aligning cells
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = True  # whether the line is empty or ends in a blank
        self.gap = False
        self.indent = self.mark = ""
        self.items = 0  # open list items: lists inside them stand without blank lines

    def words(self, raw: str) -> None:
        raw = _BLANKS.sub(" ", raw)
        if self.blank and raw[:1] == " ":
            raw = raw[1:]
        if raw:
            self.line.append(raw)
            self.blank = raw[-1] == " "

    def end_line(self, spaced: bool = False) -> None:
        line = "".join(self.line).strip(" ")
        if line:
            if self.gap and self.lines:
                self.lines.append("")
            lead = self.indent[: len(self.indent) - len(self.mark)] + self.mark
            self.lines.append(lead + line)
            self.mark, self.gap = "", False
        self.line, self.blank = [], True
        self.gap = self.gap or spaced

    def break_line(self) -> None:
        """A line break; one more in a row leaves a blank line."""
        if "".join(self.line).strip(" "):
            self.end_line()
        else:
            self.line, self.blank, self.gap = [], True, self.gap or bool(self.lines)

    def verbatim(self, lines: list[str]) -> None:
        self.end_line()
        if self.gap and self.lines and lines:
            self.lines.append("")
        self.gap = False
        if self.mark and lines:
            lines = [lines[0], *lines[1:]]
            self.lines.append((self.indent[: len(self.indent) - len(self.mark)] + self.mark + lines[0]).rstrip())
            self.mark, lines = "", lines[1:]
        self.lines += [(self.indent + x).rstrip() for x in lines]


def _flow(page: _Page, node: Node) -> None:
    """Render what lies below ``node``, in order, with an explicit stack of (node or text, leaving, what to restore)."""
    todo: list[tuple] = [(c, False, None) for c in reversed(node.children)]
    while todo:
        item, leaving, kept = todo.pop()
        if isinstance(item, str):
            page.words(item)
            continue
        tag = item.tag
        if leaving:
            indent, spaced = kept
            page.end_line(spaced)
            if indent is not None:
                page.indent, page.mark = indent, ""
            page.items -= tag == "li"
            continue
        if tag == "br":
            page.break_line()
        elif tag == "hr":
            page.end_line(True)
        elif tag == "img":
            page.words(item.attrs.get("alt", ""))
        elif tag == "input":
            kind = item.attrs.get("type", "").strip().lower()
            page.words(item.attrs.get("value", "") if kind in _SEEN_INPUTS else item.attrs.get("alt", "") if kind == "image" else "")
        elif tag in ("pre", "xmp", "textarea"):
            page.end_line(True)
            lines = _plain(item).strip("\n").split("\n")
            page.verbatim(lines if any(x.strip() for x in lines) else [])
            page.gap = True
        elif tag == "table" and page.depth < MOST_TABLES:
            page.end_line(True)
            _table(page, item)
            page.gap = True
        else:
            if tag in BLOCKS:
                indent, spaced = None, tag in SPACED and not (tag in LISTS and page.items)
                page.end_line(spaced)
                if tag == "li":
                    indent, page.items = page.indent, page.items + 1
                    mark = "" if "_unseen" in item.attrs else item.attrs.get("_mark", "- ")
                    page.indent, page.mark = (page.indent + " " * len(mark), mark) if len(page.indent) < MOST_INDENT else (page.indent, "")
                elif tag in ("blockquote", "dd") and len(page.indent) < MOST_INDENT:
                    indent = page.indent
                    page.indent += "  "
                if tag in LISTS:
                    _number(item)
                todo.append((item, True, (indent, spaced)))
            elif tag in CELLS:
                page.words(" ")
            todo += [(c, False, None) for c in reversed(item.children)]


def _whole(source: str, usual: int) -> int:
    found = re.match(r"\s*([+-]?\d{1,9})", source)
    return int(found[1]) if found else usual


def _number(listing: Node) -> None:
    items = [c for c in listing.children if isinstance(c, Node) and c.tag == "li"]
    back = listing.tag == "ol" and "reversed" in listing.attrs
    n = _whole(listing.attrs.get("start", ""), len(items) if back else 1)
    for c in items:
        n = _whole(c.attrs.get("value", ""), n)
        c.attrs["_mark"] = f"{n}. " if listing.tag == "ol" else "- "
        n += -1 if back else 1


def _plain(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag == "br":
            out.append("\n")
        else:
            todo += reversed(n.children)
    return "".join(out)


def _rows(table: Node) -> list[tuple[list[Node], int]]:
    """The cells of each row, and the place of its group's last row, to which cells may span."""
    rows, groups, todo = [], [], [(table, 0)]
    while todo:
        n, group = todo.pop()
        if n.tag == "tr":
            cells = [c for c in n.children if isinstance(c, Node) and c.tag in CELLS]
            if cells:
                rows.append(cells)
                groups.append(group)
        for c in reversed(n.children):
            if isinstance(c, Node) and c.tag in ("thead", "tbody", "tfoot", "tr"):
                todo.append((c, group if c.tag == "tr" else id(c)))
    last = {g: i for i, g in enumerate(groups)}
    return [(cells, last[g]) for cells, g in zip(rows, groups)]


def _grid(rows: list[tuple[list[Node], int]]) -> list[list[tuple[int, Node]]]:
    """Per row its cells with their columns, as spans of rows and columns place them."""
    out, until, steps = [], {}, 0  # until: column -> the last row that a cell from above takes
    for r, (cells, last) in enumerate(rows):
        line, at = [], 0
        for c in cells:
            while steps < MOST_STEPS and until.get(at, -1) >= r:
                at, steps = at + 1, steps + 1
            span = min(max(_whole(c.attrs.get("colspan", ""), 1), 1), MOST_SPAN)
            down = _whole(c.attrs.get("rowspan", ""), 1)
            end = last if down == 0 else min(r + max(down, 1) - 1, last)
            line.append((at, c))
            if end > r and steps < MOST_STEPS:
                until.update(dict.fromkeys(range(at, at + span), end))
                steps += span
            at += span
        out.append(line)
    return out


def _table(page: _Page, table: Node) -> None:
    """Cells as columns of equal width, joined by `` | ``, each of as many lines as it has; columns in which no cell
    begins are left out; text outside cells comes before the rows."""
    rows = _rows(table)
    inside = {id(c) for cells, _ in rows for c in cells}
    loose, todo = [], list(reversed(table.children))
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            loose.append(n)
        elif id(n) not in inside:
            if n.tag in ("thead", "tbody", "tfoot", "tr"):
                todo += reversed(n.children)
            else:
                loose.append("\n" + "\n".join(_lines(n, page)) + "\n")
    for x in "".join(loose).split("\n"):
        page.words(x)
        page.end_line()
    grid = [[(at, _lines(c, page) or [""]) for at, c in line] for line in _grid(rows)]
    if grid:
        page.verbatim(_aligned(grid, page.room))


def _aligned(grid: list[list[tuple[int, list[str]]]], room: list[int]) -> list[str]:
    """The lines of rows of (column, lines of the cell)."""
    widths: dict[int, int] = {}
    for line in grid:
        for at, lines in line:
            widths[at] = max(widths.get(at, 0), max((n for n in map(len, lines) if n <= WIDEST), default=0))
    if len(widths) == 1:
        return [x.rstrip(" ") for line in grid for _, lines in line for x in lines]
    place = {at: i for i, at in enumerate(sorted(widths))}
    heights = [max(len(x) for _, x in line) for line in grid]
    lasts = [place[line[-1][0]] for line in grid]
    for most in (*WIDTHS, None):
        if most is None:  # no room: cells as they follow each other
            return [" | ".join(x[k] for _, x in line if k < len(x)).rstrip(" ") for line, n in zip(grid, heights) for k in range(n)]
        size = [min(widths[at], most) for at in place]
        before = [0, *accumulate(w + 3 for w in size)]
        spent = sum(n * before[last] for n, last in zip(heights, lasts))
        if spent <= room[0]:
            room[0] -= spent
            break
    empty = [""] * len(place)
    out = []
    for line, n, last in zip(grid, heights, lasts):
        for k in range(n):
            here = empty[: last + 1]
            for at, x in line:
                if k < len(x):
                    here[place[at]] = x[k]
            out.append(" | ".join(x.ljust(w) for x, w in zip(here, size)).rstrip(" "))
    return out


def _lines(node: Node, page: _Page | None, room: int = 0) -> list[str]:
    """A branch rendered on its own, inside a table of ``page`` if given."""
    page = _Page(page.depth + 1, page.room) if page else _Page(0, [room])
    _flow(page, node)
    page.end_line()
    return page.lines


def extract_text(source: str | None) -> str:
    return "\n".join(_lines(prune(build(source)), None, ROOM + ROOM_SHARE * len(source))) if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text) for every page: all of its visible text."""

    def make():
        def step(batch: pa.RecordBatch) -> list:
            return [batch.column(0), [extract_text(x) for x in batch.column(1).to_pylist()]]

        return step

    return arrow_map(pages.select("page_id", valid("html")), "page_id bigint, text string", make)
