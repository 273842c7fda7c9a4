"""Layout-aware text of HTML pages: all that is visible, laid out in lines.

A tree builder turns tags into matched openings and closings: it closes paragraphs, list items, rows and cells that
the next tag implies, opens rows and tables that a cell implies, ignores closings of what isn't open, and lets no
closing leave its table cell. It knows where each name was opened last, so a tag costs the same at any depth. A renderer
follows the openings and closings, so neither needs recursion. It leaves out what visibility rules hide (head, script, style and
the like, `hidden`, display: none, dialogs that aren't open, details that aren't but for their summary; visibility: hidden, unless a descendant is visible
again), collapses white space outside pre, puts one blank line around paragraphs, headings, lists and tables, marks and indents list items (numbers follow
start, value and reversed), and pads table cells to the width of their column: that of its widest line. Rows are padded in runs: where very long lines would make
others many times their size, a new run with widths of its own begins, so padding stays in proportion to the text. What style sheets hide is not known, only what
attributes do.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body

#: Fixed values, from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style noscript template title iframe noembed noframes object audio video canvas datalist desc defs metadata symbol annotation annotation-xml".split())
#: Types of input whose value isn't shown as text.
UNSHOWN = frozenset("hidden checkbox radio range color file image password".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr menu".split())
BLOCK = SPACED | frozenset(
    "html body address article aside center dd details div dt fieldset figcaption footer form header legend li main nav optgroup option search section summary tr caption thead tbody tfoot".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening closes the nearest open one of the first set, unless one of the second is nearer.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu table".split())),
    "dt": (frozenset("dt dd".split()), frozenset("dl table".split())),
    "dd": (frozenset("dt dd".split()), frozenset("dl table".split())),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
    "optgroup": (frozenset(["optgroup", "option"]), frozenset("select datalist".split())),
    "td": (frozenset("td th caption".split()), frozenset(["table"])),
    "th": (frozenset("td th caption".split()), frozenset(["table"])),
    "tr": (frozenset("tr caption".split()), frozenset(["table"])),
    "tbody": (frozenset("thead tbody tfoot tr caption".split()), frozenset(["table"])),
}
IMPLIED["thead"] = IMPLIED["tfoot"] = IMPLIED["tbody"]
CELLS = frozenset("td th caption".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?/][^>A-Za-z][^>]*>|<[!?][^>]*>|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'](?=[^\"']*>))*+)>", re.S
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
#: Columns to which any cell may be padded; beyond that, padding of a run is at most so many times its text, and some more.
PAD, TIMES, FREE = 60, 2, 4096
SPACE = re.compile(r"[ \t\n\f\r]+")


def _attributes(rest: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(rest):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def events(page: str):
    """("open", name, attributes), ("close", name, None) and ("text", text, None), openings and closings matched."""
    stack: list[str] = []
    places: dict[str, list[int]] = {}  # of the open elements of each name
    at, n = 0, len(page)

    def nearest(names) -> int:
        return max((p[-1] for x in names if (p := places.get(x))), default=-1)

    def up_to(targets, walls):
        """Closings that reach the nearest open target, if no wall is nearer."""
        i = nearest(targets)
        if i < 0 or i < nearest(walls):
            return []
        out = [("close", x, None) for x in reversed(stack[i:])]
        for x in stack[i:]:
            places[x].pop()
        del stack[i:]
        return out

    def push(name):
        places.setdefault(name, []).append(len(stack))
        stack.append(name)

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            yield "text", html.unescape(page[at:]), None
            break
        if m.start() > at:
            yield "text", html.unescape(page[at : m.start()]), None
        at = m.end()
        if not (name := m["name"]):
            continue
        name = name.lower()
        if m["end"]:
            if name == "br":
                yield "open", "br", {}
                yield "close", "br", None
            elif name in HEADINGS:
                yield from up_to(HEADINGS, CELLS)
            elif name in ("table", "tr", "thead", "tbody", "tfoot"):
                yield from up_to({name}, {"table"} if name != "table" else ())
            elif places.get(name):
                yield from up_to({name}, CELLS - {name})
            elif name == "p":
                yield "open", "p", {}
                yield "close", "p", None
            continue
        if name in CLOSES_P:
            yield from up_to({"p"}, CELLS | {"button"})
        if name in HEADINGS and stack and stack[-1] in HEADINGS:
            yield from up_to(HEADINGS, CELLS)
        if name in IMPLIED:
            yield from up_to(*IMPLIED[name])
        if name in ("td", "th", "tr"):
            for needed in ("table", "tr") if name != "tr" else ("table",):
                place = nearest(("table", needed))
                if place < 0 or stack[place] != needed:
                    push(needed)
                    yield "open", needed, {}
        attributes = _attributes(m["rest"]) if m["rest"] else {}
        yield "open", name, attributes
        if name in VOID:
            yield "close", name, None
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            inner = page[at : end.start() if end else n]
            yield "text", html.unescape(inner) if name in ("textarea", "title") else inner, None
            yield "close", name, None
            at = end.end() if end else n
        else:
            push(name)
    for name in reversed(stack):
        yield "close", name, None


def width(s: str) -> int:
    """Columns that a line takes: wide characters take two, combining ones none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class _Flow:
    """Lines of one block context: a page or a cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False  # a blank line is due
        self.space = False  # white space is due
        self.indent: list[str] = []
        self.mark = ""

    def text(self, s: str, pre: bool):
        if pre:
            for i, part in enumerate(s.replace("\r\n", "\n").split("\n")):
                if i:
                    self.end(keep=True)
                if part:
                    self.line.append(part)
            return
        words = SPACE.split(s)
        for i, word in enumerate(words):
            self.space |= i > 0
            if word:
                if self.space and self.line:
                    self.line.append(" ")
                self.line.append(word)
                self.space = False

    def end(self, keep: bool = False):
        """The line ends; keep: also an empty one."""
        s = "".join(self.line).rstrip(" ")
        self.line, self.space = [], False
        if s or keep:
            self.put(s)

    def put(self, s: str):
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        lead = "".join(self.indent)
        if self.mark:
            lead = "".join(self.indent[:-1]) + self.mark
            self.mark = ""
        self.lines.append((lead + s).rstrip(" "))

    def block(self, spaced: bool):
        self.end()
        self.gap |= spaced

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class _Table:
    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.down: dict[int, tuple[int, int]] = {}  # of columns that a cell above fills: its last row, and the column behind it
        self.column = 0
        self.caption: list[str] = []
        self.span = (1, 1)

    def row(self):
        self.rows.append([])
        self.column = 0

    def cell(self, lines: list[str]):
        row = len(self.rows) - 1
        while (above := self.down.get(self.column)) and above[0] >= row:
            self.column = above[1]
        wide, high = self.span
        self.rows[-1].append((self.column, wide, lines))
        if high > 1:
            self.down |= dict.fromkeys(range(self.column, self.column + wide), (row + high - 1, self.column + wide))
        self.column += wide

    def runs(self) -> list[tuple[list, dict[int, int]]]:
        """Rows that are padded together, and the widths of their columns."""
        out: list[tuple[list, dict[int, int]]] = []
        rows, columns, high, size, beyond = [], {}, 0, 0, 0
        for row in self.rows:
            own, text = {}, 0
            for c, wide, lines in row:
                at = [width(line) for line in lines]
                text += sum(at)
                if wide == 1:
                    own[c] = max([own.get(c, 0), *at])
            lines = max((len(lines) for _, _, lines in row), default=0)
            more = sum(max(0, w - max(PAD, columns.get(c, 0))) for c, w in own.items())
            if rows and (high + lines) * (beyond + more) > TIMES * (size + text) + FREE:
                out.append((rows, columns))
                rows, columns, high, size, beyond = [], {}, 0, 0, 0
                more = sum(max(0, w - PAD) for w in own.values())
            rows.append(row)
            columns |= {c: max(columns.get(c, 0), w) for c, w in own.items()}
            high, size, beyond = high + lines, size + text, beyond + more
        return out + [(rows, columns)]

    def render(self) -> list[str]:
        out = list(self.caption)
        for rows, columns in self.runs():
            known, ends, x = sorted(columns), [0], 0
            for c in known:
                x += columns[c] + 3
                ends.append(x)
            for row in rows:
                for k in range(max((len(lines) for _, _, lines in row), default=0)):
                    line, at = [], 0
                    for c, _, lines in row:
                        s = lines[k] if k < len(lines) else ""
                        if c:
                            start = ends[bisect_left(known, c)]
                            line.append(" " * max(0, start - 3 - at) + " | ")
                            at = max(at + 3, start)
                        line.append(s)
                        at += width(s)
                    out.append("".join(line).rstrip(" "))
        return out


def _hidden(name: str, attributes: dict[str, str]) -> bool:
    """Whether it isn't displayed, nor anything in it."""
    return (
        name in HIDDEN
        or "hidden" in attributes
        or (name == "dialog" and "open" not in attributes)
        or (name == "input" and attributes.get("type", "").lower() in UNSHOWN)
        or ("style" in attributes and bool(NO_DISPLAY.search(attributes["style"])))
    )


def _count(value: str | None, most: int) -> int:
    m = re.match(r"\s*\+?(\d{1,6})", value or "")
    return max(1, min(most, int(m[1]))) if m else 1


def _number(value: str | None) -> int | None:
    m = re.match(r"\s*([+-]?\d{1,9})", value or "")
    return int(m[1]) if m else None


def _items(page: str) -> list[int]:
    """How many items that are shown each ordered list has, in the order in which they open."""
    counts: list[int] = []
    lists: list[int | None] = []
    for kind, name, attributes in events(page):
        if kind == "open" and name in ("ul", "ol", "menu"):
            lists.append(len(counts) if name == "ol" else None)
            counts += [0] * (name == "ol")
        elif kind == "open" and name == "li" and lists and lists[-1] is not None:
            counts[lists[-1]] += not _hidden(name, attributes)
        elif kind == "close" and name in ("ul", "ol", "menu") and lists:
            lists.pop()
    return counts


def render(page: str) -> str:
    """The visible text of a page."""
    items = iter(_items(page) if "reversed" in page.lower() else ())
    flows, tables, lists = [_Flow()], [], []
    hidden, pre = 0, 0
    shown: list[bool] = []  # of the open elements, whether each one hides
    visible = [True]  # of them, whether their text can be seen
    folds: list[list[bool]] = [[]]  # of them, of closed details whether a summary has come
    for kind, name, attributes in events(page):
        flow = flows[-1]
        if kind == "text":
            if not hidden and visible[-1] and not folds[-1]:
                flow.text(name, pre > 0)
        elif kind == "open":
            hides = bool(hidden) or _hidden(name, attributes)
            if folds[-1]:
                hides |= name != "summary" or folds[-1][0]
                folds[-1][0] |= name == "summary"
            folds.append([False] if name == "details" and "open" not in attributes else [])
            listed = next(items, 0) if name == "ol" else 0
            shown.append(hides)
            hidden += hides
            told = VISIBILITY.findall(attributes.get("style", ""))
            visible.append(told[-1].lower() == "visible" if told else visible[-1])
            if hides:
                continue
            if name == "br":
                flow.end(keep=True)
            elif name in ("img", "input"):
                if visible[-1]:
                    flow.text(attributes.get("alt" if name == "img" else "value", ""), False)
            elif name == "table":
                flow.block(True)
                tables.append((_Table(), len(flows)))
            elif name == "tr" and tables:
                tables[-1][0].row()
            elif name in CELLS and tables:
                if name != "caption" and not tables[-1][0].rows:
                    tables[-1][0].row()
                tables[-1][0].span = (_count(attributes.get("colspan"), 1000), _count(attributes.get("rowspan"), 65534))
                flows.append(_Flow())
                flows[-1].span = tables[-1][0].span
            elif name in BLOCK:
                flow.block(name in SPACED and not (name in ("ul", "ol") and lists))
                if name in ("ul", "ol", "menu"):
                    down = name == "ol" and "reversed" in attributes
                    first = _number(attributes.get("start")) if name == "ol" else 0
                    lists.append([name, (listed if down else 1) if first is None else first, -1 if down else 1])
                elif name == "li":
                    mark = "- "
                    if lists and lists[-1][0] == "ol":
                        if (said := _number(attributes.get("value"))) is not None:
                            lists[-1][1] = said
                        mark = f"{lists[-1][1]}. "
                        lists[-1][1] += lists[-1][2]
                    flow.indent.append(" " * len(mark))
                    flow.mark = mark if visible[-1] else ""
                elif name == "dd":
                    flow.indent.append("    ")
                elif name == "blockquote":
                    flow.indent.append("> ")
                elif name == "hr":
                    if visible[-1]:
                        flow.put("---")
                elif name == "pre":
                    pre += 1
        else:
            hides = shown.pop()
            visible.pop()
            folds.pop()
            hidden -= hides
            if hides:
                continue
            if name == "table":
                table, _ = tables.pop()
                for line in table.render():
                    flow.put(line)
                flow.gap = True
            elif name in CELLS and tables:
                own = flows.pop()
                if name == "caption":
                    tables[-1][0].caption += own.done()
                else:
                    tables[-1][0].span = own.span
                    tables[-1][0].cell(own.done())
            elif name in BLOCK:
                flow.block(name in SPACED and not (name in ("ul", "ol") and len(lists) > 1))
                if name in ("ul", "ol", "menu") and lists:
                    lists.pop()
                elif name in ("li", "dd", "blockquote"):
                    flow.indent.pop()
                    if name == "li":
                        if flow.mark:  # an item without text
                            flow.put("")
                elif name == "pre":
                    pre -= 1
    return "\n".join(flows[0].done())


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row for each of pages: id_col, text, n_chars, n_lines. Null and empty pages have an empty text of no line. Rows may
    repeat; other columns are not read."""

    @F.arrow_udf("string")
    def text(pages: pa.Array) -> pa.Array:
        return pa.array([render(p.as_py()) for p in pages], pa.string())

    laid = pages.select(F.col(id_col), text(body(html_col)).alias("text"))
    lines = F.when(F.col("text") == "", 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    return laid.select(id_col, "text", F.length("text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"))
