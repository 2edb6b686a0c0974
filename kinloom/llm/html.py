"""HTML to text by layout.

A tree builder reads tags as browsers do where it matters for text: implied ends
(a head before other content, a paragraph before a block, list items, rows, cells,
options), implied rows, content of a table outside its cells (which goes before
the table), void elements, raw text, and ends without a start. A renderer then walks the tree and writes
what is visible:

* No head, script, style, template or fallback content; nothing with ``hidden`` or
  display:none, whether by attribute or by a rule of the page's style sheets for
  a tag, class or id (rules of other selectors and of media queries are not
  read); of a closed ``details`` its summary, of a closed ``dialog`` nothing. What
  is visibility:hidden is left out, but not its visible children. Text areas,
  the options that a ``select`` shows, buttons, entered values and the text of
  drawings and formulas are visible.
* Blank lines around paragraphs and headings, line breaks around other blocks;
  list items with a bullet or their number and indentation; white space kept in
  ``pre`` and text areas.
* Tables with cells padded to their column's width, over as many columns and
  rows as they span; a cell of several lines takes several lines of its row.

Trees are built and walked without recursion, so no depth is too deep. Null html
gives null text, an empty page an empty text. Equal pages give equal texts;
rows with equal keys are rows of their own; other columns, whatever their names,
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import map_arrow

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript iframe object canvas audio video datalist title desc defs metadata annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure".split())
BLOCK = SPACED | frozenset("html body div section article header footer nav main aside address form fieldset li dt dd tr thead tbody tfoot caption figcaption details summary hr center".split())
#: A start tag of the first kind ends an open element of the second, up to the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
HEAD = frozenset("base basefont bgsound link meta title style script noscript template".split())
#: Parts of a table, and the open elements in which each may stand.
TABLE = {
    "caption": set(), "colgroup": set(), "col": {"colgroup"}, "thead": set(), "tbody": set(), "tfoot": set(), "tr": {"thead", "tbody", "tfoot"},
    "td": {"thead", "tbody", "tfoot", "tr"}, "th": {"thead", "tbody", "tfoot", "tr"},
}
CELLS = frozenset(("td", "th", "caption"))
#: Kinds of input whose value is on the screen.
SHOWN = frozenset(("", "text", "search", "email", "url", "tel", "number", "submit", "button", "reset"))
#: Columns that a cell spans at most, as in browsers.
WIDEST = 1000
#: Where cells are still aligned, in characters from the line's begin. A cell whose column begins beyond it, or that the line has already passed, follows two spaces after what stands before it.
LINE = 400
_DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*([\w-]+)", re.I)
_VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(\w+)", re.I)
_SELECTOR = re.compile(r"[\w-]*(?:[.#][\w-]+)?")


def _uncommented(css: str) -> str:
    """Without comments; one that does not end runs to the end."""
    out, at = [], 0
    while (begin := css.find("/*", at)) >= 0:
        out.append(css[at:begin])
        end = css.find("*/", begin + 2)
        if end < 0:
            return "".join(out)
        at = end + 2
    return "".join([*out, css[at:]])


def _rules(css: str) -> Iterator[tuple[str, str]]:
    """Selectors and body of each plain rule, in one pass from brace to brace. At-rules are left out with all that they hold."""
    css = _uncommented(css)
    begin, depth, nested = 0, 0, None  # where the prelude begins, how deep an at-rule is open, where the last open brace is
    for found in re.finditer(r"[{};@]", css):
        at, kind = found.start(), found[0]
        if kind == "@" and not depth and nested is None:
            depth = 1  # within the at-rule's own prelude
        elif kind == "{":
            if depth:
                depth += 1
            else:
                nested = (begin, at) if nested is None else (nested[1] + 1, at)
        elif kind == ";" and depth == 1:
            depth, begin = 0, at + 1
        elif kind == "}":
            if depth:
                depth = 0 if depth <= 2 else depth - 1
                begin = begin if depth else at + 1
            else:
                if nested is not None:
                    yield css[nested[0] : nested[1]], css[nested[1] + 1 : at]
                nested, begin = None, at + 1


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        self.headless = False
        self.where: dict[str, list[int]] = {}  # where in open the elements of a tag are

    def _push(self, node: Node) -> None:
        self.where.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def _cut(self, at: int) -> None:
        """Closes all open elements from a place on."""
        for node in self.open[at:]:
            self.where[node.tag].pop()
        del self.open[at:]

    def _last(self, tags) -> int:
        """Where the last open element of these tags is; 0 if there is none."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def _close(self, tags: set[str], until: set[str]) -> None:
        while (at := self._last(tags)) > self._last(until):
            self._cut(at)
            if not any(n.tag in tags for n in self.open[max(1, at - 2) :]):
                return

    def _table(self) -> int:
        """Where the table is whose content is read now; 0 where that is a cell's or no table's."""
        at = self._last(("table",))
        return at if at > self._last(CELLS) else 0

    def _part(self, tag: str) -> bool:
        """Makes way for a part of a table, with a row for a cell; False outside tables."""
        at = self._last(("table",))
        if not at:
            return False
        while len(self.open) > at + 1 and (self.open[-1].tag not in TABLE[tag] or self._last(CELLS) > at):
            self._cut(len(self.open) - 1)
        if tag in ("td", "th") and self.open[-1].tag != "tr":
            row = Node("tr", {})
            self.open[-1].children.append(row)
            self._push(row)
        return True

    def _outside(self) -> int:
        """Where the table is, if what comes next would stand in it but in no cell."""
        tag = self.open[-1].tag
        return self._table() if tag == "table" or tag in TABLE and tag not in CELLS else 0

    def handle_starttag(self, tag, attrs):
        if tag == "head":
            if self.headless or any(n.tag not in ("", "html") for n in self.open):
                return
            self.headless = True
        elif tag != "html" and tag not in HEAD:
            self.headless = True
            if self.open[-1].tag == "head":
                self._cut(len(self.open) - 1)
        if not (tag in TABLE and self._part(tag)) and tag in IMPLIED:
            self._close(*IMPLIED[tag])
        if tag in BLOCK:
            self._close({"p"}, {"table", "td", "th", "li", "div", "section", "article", "button"})
        if tag == "body":
            self._close({"head"}, set())
        node = Node(tag, dict(attrs))
        at = 0 if tag in TABLE or tag in HEAD else self._outside()
        if at and tag == "table":
            self._cut(at)
            at = 0
        if at and tag != "form":
            self.open[at - 1].children.insert(-1, node)
        else:
            self.open[-1].children.append(node)
        if tag not in VOID and not (at and tag == "form"):
            self._push(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag):
        """Closes the last open element of the tag; what stands in a table does not close what is outside."""
        at = self._last((tag,))
        if at and (tag in ("table", "tr", "tbody", "body", "html") or at >= self._last(("table", "td", "th"))):
            self._cut(at)

    def handle_data(self, data):
        if data.strip():
            if self.open[-1].tag in ("", "html", "head"):
                self.headless = True
            if self.open[-1].tag == "head":
                self._cut(len(self.open) - 1)
            if at := self._outside():
                self.open[at - 1].children.insert(-1, data)
                return
        self.open[-1].children.append(data)


class Sheet:
    """What the page's style sheets say of display and visibility, by simple selector; later rules win."""

    def __init__(self, root: Node):
        self.display: dict[str, str] = {}
        self.visibility: dict[str, str] = {}
        todo: list[Node] = [root]
        sheets = []
        while todo:
            node = todo.pop()
            if node.tag == "style":
                sheets.append("".join(c for c in node.children if isinstance(c, str)))
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
        for selectors, body in _rules("\n".join(sheets)):
            for name, found in (("display", _DISPLAY.findall(body)), ("visibility", _VISIBILITY.findall(body))):
                if found:
                    getattr(self, name).update((x.strip(), found[-1].lower()) for x in selectors.split(",") if _SELECTOR.fullmatch(x.strip()))

    def _value(self, node: Node, pattern: re.Pattern, rules: dict[str, str]) -> str:
        if own := pattern.findall(node.attrs.get("style") or ""):
            return own[-1].lower()
        if rules:
            names = [f".{c}" for c in (node.attrs.get("class") or "").split()] + ([f"#{node.attrs['id']}"] if node.attrs.get("id") else [])
            for name in (*(f"{node.tag}{n}" for n in reversed(names)), *reversed(names), node.tag):
                if name in rules:
                    return rules[name]
        return ""

    def displayed(self, node: Node) -> bool:
        if node.tag in UNSEEN or node.tag == "dialog" and "open" not in node.attrs:
            return False
        value = self._value(node, _DISPLAY, self.display)
        return value != "none" if value else "hidden" not in node.attrs

    def visible(self, node: Node, inherited: bool) -> bool:
        value = self._value(node, _VISIBILITY, self.visibility)
        return value == "visible" if value in ("visible", "hidden", "collapse") else inherited


class Writer:
    """Text with collapsed white space and pending breaks, of at most so many lines."""

    def __init__(self, most: int = 2):
        self.out: list[str] = []
        self.breaks = self.space = 0
        self.most, self.marked = most, False

    def text(self, s: str, pre: bool = False) -> None:
        if pre:
            if s:
                self._flush()
                self.out.append(s)
            return
        words = s.split()
        if not words:
            self.space |= bool(s)
            return
        lead = self.space or s[0].isspace()
        self._flush()
        if lead and self.out and not self.out[-1].endswith(("\n", " ")):
            self.out.append(" ")
        self.out.append(" ".join(words))
        self.space = s[-1].isspace()

    def mark(self, s: str) -> None:
        """A list item's mark: what the item begins with stays on its line."""
        self.text(s, True)
        self.marked = True

    def block(self, lines: int) -> None:
        if not self.marked:
            self.breaks, self.space = max(self.breaks, min(lines, self.most)), 0

    def line(self) -> None:
        self.breaks, self.space, self.marked = self.breaks + 1, 0, False

    def _flush(self) -> None:
        if self.breaks and self.out:
            self.out.append("\n" * self.breaks)
        self.breaks, self.marked = 0, False

    def done(self) -> str:
        return "".join(self.out)


def _number(text: str | None, least: int, most: int) -> int | None:
    found = re.match(r"\s*([-+]?\d{1,9})", text or "")
    return min(max(int(found[1]), least), most) if found else None


def _aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table from its cells: their lines, and how many columns and rows they span. Cells are aligned up to LINE; spans end at column WIDEST."""
    busy: dict[int, int] = {}  # the last row of the cells that columns have been taken by
    placed = []
    for r, cells in enumerate(rows):
        at, row, taken = 0, [], []
        for lines, across, down in cells:
            while busy.get(at, -1) >= r:
                at += 1
            across = min(across, max(1, WIDEST - at))
            row.append((at, across, lines))
            if down > 1:
                taken.append((at, across, r + down - 1))
            at += across
        for begin, across, last in taken:  # of cells that overlap, the later one counts
            busy.update(dict.fromkeys(range(begin, begin + across), last))
        placed.append(row)
    columns = max((at + across for row in placed for at, across, _ in row), default=0)
    width = [0] * columns
    for at, across, lines in sorted((c for row in placed for c in row), key=lambda c: c[1]):
        end = min(at + across, columns)
        missing = max(map(len, lines), default=0) - sum(width[at:end]) - 2 * (end - at - 1)
        width[end - 1] += max(0, missing)
    start = [0]
    for w in width:
        start.append(start[-1] + (w + 2 if w else 0))
    out = []
    for row in placed:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            line: list[str] = []
            size = 0
            for at, _, lines in row:
                if k < len(lines) and lines[k]:
                    gap = start[at] - size if start[at] <= LINE else 2 if line else 0
                    line.append(" " * max(0, gap) + lines[k])
                    size += len(line[-1])
            out.append("".join(line))
    return out


class Renderer:
    """Walks a tree. Its methods are generators that yield walks of subtrees, which run() keeps on a stack of its own."""

    def __init__(self, root: Node):
        self.sheet = Sheet(root)

    def run(self, walk):
        stack, value = [walk], None
        while stack:
            try:
                stack.append(stack[-1].send(value))
                value = None
            except StopIteration as end:
                stack.pop()
                value = end.value
        return value

    def _cell(self, node: Node, shown: bool):
        out = Writer(1)
        yield self.walk(node, out, False, 0, shown)
        lines = [x.rstrip() for x in out.done().strip("\n").split("\n")]
        return [x for x in lines if x], _number(node.attrs.get("colspan"), 1, WIDEST) or 1, _number(node.attrs.get("rowspan"), 1, 65534) or 1

    def _table(self, table: Node, out: Writer, shown: bool):
        rows, todo = [], [(c, shown) for c in reversed(table.children)]
        while todo:
            c, shown = todo.pop()
            if not isinstance(c, Node) or not self.sheet.displayed(c):
                continue
            shown = self.sheet.visible(c, shown)
            if c.tag == "caption":
                yield self.walk(c, out, False, 0, shown)
                out.block(1)
            elif c.tag in ("thead", "tbody", "tfoot"):
                todo += [(x, shown) for x in reversed(c.children)]
            elif c.tag == "tr":
                cells = []
                for x in c.children:
                    if isinstance(x, Node) and x.tag in ("td", "th") and self.sheet.displayed(x):
                        cells.append((yield self._cell(x, self.sheet.visible(x, shown))))
                if cells:
                    rows.append(cells)
        for line in _aligned(rows):
            out.text(line, True)
            out.block(1)

    def _selected(self, select: Node) -> list[Node]:
        """The options that are on the screen: all of a list, else the selected or the first."""
        options, todo = [], list(reversed(select.children))
        while todo:
            c = todo.pop()
            if isinstance(c, Node):
                todo += reversed(c.children)
                options += [c] if c.tag == "option" else []
        if "multiple" in select.attrs or (_number(select.attrs.get("size"), 0, 9999) or 0) > 1:
            return options
        return [o for o in options if "selected" in o.attrs][:1] or options[:1]

    def walk(self, node: Node, out: Writer, pre: bool, depth: int, shown: bool):
        number = _number(node.attrs.get("start"), -(10**9), 10**9) if node.tag == "ol" else None
        number = 1 if number is None else number
        summaries = [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1] if node.tag == "details" and "open" not in node.attrs else None
        for c in node.children if summaries is None else summaries:
            if isinstance(c, str):
                if shown:
                    out.text(c, pre)
                continue
            if not self.sheet.displayed(c):
                continue
            own = self.sheet.visible(c, shown)
            if c.tag == "br":
                out.line()
                continue
            if c.tag in ("img", "input"):
                value = c.attrs.get("alt") if c.tag == "img" or (c.attrs.get("type") or "").lower() == "image" else c.attrs.get("value") if (c.attrs.get("type") or "").lower() in SHOWN else ""
                if own and value:
                    out.text(f" {value} ")
                continue
            gap = 2 if c.tag in SPACED and not (c.tag in ("ul", "ol") and depth) else 1 if c.tag in BLOCK else 0
            if gap:
                out.block(gap)
            if c.tag == "table":
                yield self._table(c, out, own)
            elif c.tag == "select":
                for option in self._selected(c):
                    out.text(" ")
                    yield self.walk(option, out, False, depth, own)
                    out.text(" ")
            elif c.tag == "li":
                given = _number(c.attrs.get("value"), -(10**9), 10**9) if node.tag == "ol" else None
                number = number if given is None else given
                if own:
                    out.mark("  " * max(0, depth - 1) + (f"{number}. " if node.tag == "ol" else "- "))
                number += 1
                yield self.walk(c, out, pre, depth, own)
                out.marked = False
            else:
                yield self.walk(c, out, pre or c.tag in ("pre", "textarea"), depth + (c.tag in ("ul", "ol")), own)
            if gap:
                out.block(gap)


def page_text(html: str) -> str:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    out, renderer = Writer(), Renderer(builder.root)
    renderer.run(renderer.walk(builder.root, out, False, 0, True))
    return "\n".join(x.rstrip() for x in out.done().strip("\n").split("\n"))


def extract(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key and the visible text of each page's html; null for null. Time and memory follow a page's size, however its tags are nested, closed or styled; only a table's alignment adds to its text, by LINE characters a line at most."""

    def run(batches):
        for batch in batches:
            texts = [None if h is None else page_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    source = pages.select(F.col(key).cast("long").alias("key"), "html")
    return map_arrow(source, run, "key long, text string").withColumnRenamed("key", key)
