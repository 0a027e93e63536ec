"""HTML to text by layout: all visible text, with block spacing, lists and aligned table cells.

A builder keeps the stack of open elements, closes those that HTML closes by implication and drops end tags that match
nothing; each element writes into the layout as it opens and closes, so depth costs no recursion and a page no tree.  The
places of open elements are kept by name, so a tag costs the same whatever is open, and a page costs time by its length.

Visible is what a browser that can run scripts shows before any has run: nothing inside head, script, style, template,
noscript, iframe, object, svg, canvas, audio, video, a data list or a formula's annotations and phantoms, nor under a style of
display:none or the attribute `hidden` without another display, nor closed dialogs, nor closed details but for their summary.
Text under visibility:hidden or collapse does not show, but that of a descendant with visibility:visible does; of a style's
declarations of one property the last counts, those marked important before others.  A paragraph-like block stands between empty lines, another block on its own lines; list items have a mark and
indent, up to INDENT characters; table rows are lines (or several, if cells have several) whose cells start in common
columns, up to COLUMN characters wide, and stay clear of cells that span from rows above; `pre` and `xmp` keep their white
space; formulae are inline text; inputs show their value, unless their type has none to read.

Tables of any width are aligned.  The white space that alignment takes in a page is bounded by PADDING characters for each of its
own, which only tables made of little but spans exceed; the cells of a table beyond it follow each other without alignment, and the
cells of tables inside more than NESTED others are blocks; text is never left out for that.

Defined cases: a null or empty page has an empty text; text without markup is one block; broken markup never fails: numbers
that are none count as absent, a tag that the page's end cuts off is dropped; repeated rows render alike; other columns pass
through, but one with the name of the new column is replaced.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Widest padding of a table column.
COLUMN = 60
#: White space of alignment for each character of a page, deepest indent, and tables around one that has a grid.
PADDING, INDENT, NESTED = 32, 60, 32
#: Most rows that a cell spans (a fixed value of HTML).
ROWS = 65_534
#: Element names by role (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe object svg canvas audio video datalist noembed noframes title annotation annotation-xml mphantom".split())
#: Types of inputs whose value is not shown as text.
UNREAD = frozenset("hidden checkbox radio password file range color image".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre xmp blockquote figure hr form fieldset".split())
BLOCK = SPACED | frozenset(
    "address article aside body center details dialog dd div dt figcaption footer header hgroup html legend li main menu nav "
    "option optgroup search section select summary caption tr tbody thead tfoot td th textarea".split()
)
#: Opening the key closes an open element of the values, up to the nearest of the bounds.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu table td th".split())),
    "dt": (frozenset("dt dd".split()), frozenset("dl table td th".split())),
    "dd": (frozenset("dt dd".split()), frozenset("dl table td th".split())),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "td": (frozenset("td th".split()), frozenset("table tr".split())),
    "th": (frozenset("td th".split()), frozenset("table tr".split())),
    "tr": (frozenset("tr td th caption".split()), frozenset(["table"])),
    "tbody": (frozenset("tbody thead tfoot tr td th caption".split()), frozenset(["table"])),
    "thead": (frozenset("tbody thead tfoot tr td th caption".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot tr td th caption".split()), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
#: Starting one of these ends an open paragraph.
ENDS_P = BLOCK - frozenset("td th tr tbody thead tfoot caption option optgroup html body".split())
#: Start tags that may stand inside head; any other ends it.
IN_HEAD = frozenset("base link meta script style title template noscript".split())
#: An end tag does not reach through these, unless it is one of them.
WALLS = frozenset("td th table caption".split())
P_WALLS = WALLS | {"button"}

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_NAME = re.compile(r"[a-zA-Z][^ \t\n\f/>]*")
_BETWEEN = re.compile(r"[ \t\n\f/]*")
_ATTRIBUTE = re.compile(r"=?[^ \t\n\f/>=]*")
_EQUALS = re.compile(r"[ \t\n\f]*=[ \t\n\f]*")
_BARE = re.compile(r"[^ \t\n\f>]*")
_DECLARED = re.compile(r"(?:^|;)\s*+(display|visibility)\s*+:\s*+([a-z-]++)([^;]*+)", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")
_INTEGER = re.compile(r"[ \t\n\f\r]*([+-]?)0*([0-9]*)")
_REFERENCE = re.compile(r"&#0*+[0-9]{8,};?")


def number(s: str | None, otherwise: int, most: int = (1 << 31) - 1) -> int:
    """The integer that an attribute begins with, as HTML reads it: ASCII digits, at most `most` in size."""
    m = _INTEGER.match(s or "")
    if not m or m.end() == m.end(1) or (not m[2] and "0" not in m[0]):
        return otherwise
    n = min(int(m[2][:12] or 0), most)
    return -n if m[1] == "-" else n


def unescape(s: str) -> str:
    """Text with character references read; those beyond all code points, of any number of digits, are U+FFFD."""
    return html.unescape(_REFERENCE.sub("\ufffd", s) if "&#" in s else s)


def _styled(style: str) -> dict[str, str]:
    """display and visibility as a style has them in the end."""
    found: dict[str, tuple[bool, str]] = {}
    for m in _DECLARED.finditer(style):
        name, important = m[1].lower(), "!important" in m[3].lower().replace(" ", "")
        if important or not found.get(name, (False,))[0]:
            found[name] = (important, m[2].lower())
    return {name: value for name, (_, value) in found.items()}


class Sheet:
    """Lines of text that grow; a table cell has one of its own."""

    def __init__(self):
        self.lines: list[str] = []
        self.part: list[str] = []
        self.gap, self.blank, self.indent, self.mark = False, False, "", ""

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.split("\n")
            self._put(first)
            for line in rest:
                self.line(force=True)
                self._put(line)
            return
        words = _SPACES.split(s)
        if words[0] == "":
            self.gap = self.gap or bool(self.part)
        inner = " ".join(w for w in words if w)
        if inner:
            self._put((" " if self.gap and self.part else "") + inner)
            self.gap = words[-1] == ""

    def _put(self, s: str) -> None:
        if s:
            if self.blank and self.lines and self.lines[-1]:
                self.lines.append("")
            self.blank = False
            if not self.part:
                self.part.append(self.mark or self.indent)
                self.mark = ""
            self.part.append(s)

    def line(self, force: bool = False) -> None:
        if self.part:
            self.lines.append("".join(self.part).rstrip())
            self.part = []
        elif force:
            self.lines.append("")
        self.gap = False

    def space(self) -> None:
        self.line()
        self.blank = True

    def done(self) -> list[str]:
        self.line()
        out = self.lines
        while out and not out[-1]:
            out.pop()
        first = next((i for i, x in enumerate(out) if x), 0)
        return out[first:]


class Grid:
    """The cells of an open table."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []  # columns, rows, lines
        self.groups: set[int] = set()  # the first row of each group, which no cell from above spans into

    def placed(self, steps: int) -> list[list[tuple[int, int, list[str]]]] | None:
        """Column, columns and lines of the cells of each row, beside the columns that cells from above span; None where more
        than so many columns are stepped over."""
        until: dict[int, int] = {}  # the last row that a cell spans, by column
        found = []
        for k, row in enumerate(self.rows):
            if k in self.groups:
                until = {}
            out, at = [], 0
            for span, rows, cell in row:
                while until.get(at, -1) >= k:
                    at, steps = at + 1, steps - 1
                if rows > 1:
                    until |= dict.fromkeys(range(at, at + span), k + rows - 1)
                    steps -= span
                if steps < 0:
                    return None
                if cell:
                    out.append((at, span, cell))
                at += span
            found.append(out)
        return found

    def begins(self, rows: list[list[tuple[int, int, list[str]]]]) -> dict[int, int]:
        """Where each column begins in which a cell does."""
        width: dict[int, int] = {}
        for row in rows:
            for at, span, cell in row:
                width[at] = max(width.get(at, 0), min(COLUMN, max(map(len, cell))) if span == 1 else 0)
        out, used = {}, 0
        for at in sorted(width):
            out[at] = used + 2 * at  # columns without text are two wide
            used += width[at]
        return out

    def lines(self, room: int) -> tuple[list[str], int]:
        """The lines of the table, and how much white space alignment took: at most `room`, else there is none."""
        rows, need = self.placed(room // 2), 0
        begins = {} if rows is None else self.begins(rows)
        if rows is None:
            rows = [[(0, span, cell) for span, _, cell in row if cell] for row in self.rows]
        for row in rows if begins else []:
            height = 0
            for at, _, cell in reversed(row):  # each line is as wide as its last cell begins
                need += begins[at] * max(len(cell) - height, 0)
                height = max(height, len(cell))
        if need > room:
            begins, need = {}, 0
        out = []
        for row in rows:
            cells, k = [(begins.get(at, 0), cell) for at, _, cell in row], 0
            while cells:
                line = ""
                for begin, cell in cells:
                    line = line.ljust(begin) if not line or len(line) + 2 <= begin else line + "  "
                    line += cell[k]
                out.append(line)
                k += 1
                cells = [c for c in cells if len(c[1]) > k]
        return out, need


class Layout:
    """One page."""

    def __init__(self):
        self.sheet = Sheet()
        self.stack: list[tuple] = []  # name, change of unseen, state to restore, whether it was opened in the layout, visibility around it
        self.places: dict[str, list[int]] = {}  # where in the stack each name is open
        self.unseen = self.pre = self.room = 0
        self.visible = True

    def _last(self, names) -> int:
        """The innermost place of any of the names, -1 if none is open."""
        return max((own[-1] for n in names if (own := self.places.get(n))), default=-1)

    def _inside(self, name: str) -> bool:
        return bool(self.places.get(name))

    def _imply(self, name: str) -> None:
        """Closes and opens what a start tag implies."""
        if name not in IN_HEAD and self._inside("head"):
            self._pop_to(self.places["head"][-1])
        if name in ENDS_P and self._inside("p") and (p := self.places["p"][-1]) > self._last(P_WALLS):
            self._pop_to(p)
        if name in HEADINGS and self.stack and self.stack[-1][0] in HEADINGS:
            self._pop_to(len(self.stack) - 1)
        if name in CLOSES:
            shut, bound = CLOSES[name]
            inner = self._last(bound)
            first = [own[k] for n in shut if (own := self.places.get(n)) and (k := bisect_right(own, inner)) < len(own)]
            if first:
                self._pop_to(min(first))
        if name in ("td", "th") and self._inside("table") and self.stack[-1][0] not in ("tr", "table"):
            self.start("tr", {})

    def start(self, name: str, attributes: dict[str, str]) -> None:
        self._imply(name)
        style = _styled(attributes["style"]) if attributes.get("style") else {}
        hidden = style["display"] == "none" if "display" in style else "hidden" in attributes
        hidden |= name in HIDDEN or name == "dialog" and "open" not in attributes
        visible = {"visible": True, "hidden": False, "collapse": False}.get(style.get("visibility"), self.visible)
        if name in VOID:
            if not self.unseen and not hidden:
                self._void(name, attributes, visible)
            return
        around, self.visible = self.visible, visible
        change = int(hidden)
        if name == "summary" and not hidden and self.stack and self.stack[-1][0] == "details" and self.stack[-1][2] == ["closed"]:
            self.stack[-1][2][0] = "summed up"  # the first summary of closed details shows
            change = -1
        self.unseen += change
        opened = not self.unseen
        state = self._open(name, attributes) if opened else None
        if name == "details" and "open" not in attributes:
            change, state = change + 1, ["closed"]
            self.unseen += 1
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, change, state, opened, around))

    def _void(self, name: str, attributes: dict[str, str], visible: bool) -> None:
        if name == "br":
            self.sheet.line(force=True)
        elif name == "hr":
            self.sheet.space()
        elif name == "wbr":
            pass
        elif name == "input" and visible and attributes.get("type", "text").strip().lower() not in UNREAD:
            self.sheet.text(attributes.get("value", ""), False)

    def _open(self, name: str, attributes: dict[str, str]):
        sheet = self.sheet
        if name in ("td", "th"):
            grid = self._grid()
            if grid is not None:
                self.sheet = Sheet()
                span, rows = number(attributes.get("colspan"), 1, 100), number(attributes.get("rowspan"), 1, ROWS)
                # 0 is all rows to the end of the group
                return ("cell", sheet, grid, max(span, 1), (rows or ROWS) if rows >= 0 else 1)
        if name == "tr" and (grid := self._grid()) is not None:
            grid.rows.append([])
            return None
        if name in ("tbody", "thead", "tfoot") and (grid := self._grid()) is not None:
            grid.groups.add(len(grid.rows))
        if name in BLOCK:
            nested = name in ("ul", "ol") and self._inside("li")
            sheet.space() if name in SPACED and not nested else sheet.line()
        if name == "table":
            return ("table", Grid()) if len(self.places.get("table", ())) < NESTED else None
        if name in ("pre", "xmp"):
            self.pre += 1
            return ("pre",)
        if name in ("ul", "ol", "menu"):
            first = [number(attributes.get("start"), 1)] if name == "ol" else None
            return ("list", first, sheet.indent, name in ("ul", "ol") and self._inside("li"))
        if name == "li":
            of = self._last(("ul", "ol", "menu"))
            counter = self.stack[of][2][1] if of >= 0 and self.stack[of][2] else None
            mark = "- "
            if counter is not None:
                counter[0] = number(attributes.get("value"), counter[0])
                mark = f"{counter[0]}. "
                counter[0] += 1
            state = ("item", sheet.indent)
            sheet.mark, sheet.indent = sheet.indent + mark, (sheet.indent + " " * len(mark))[:INDENT]
            return state
        if name in ("dd", "blockquote"):
            state = ("item", sheet.indent)
            sheet.indent = (sheet.indent + "  ")[:INDENT]
            return state
        if name == "q" and self.visible:
            sheet.text('"', False)
        return None

    def _grid(self) -> Grid | None:
        at = self._last(("table",))
        return self.stack[at][2][1] if at >= 0 and self.stack[at][2] else None

    def end(self, name: str) -> None:
        if name == "br":
            return self.start("br", {})
        own = self.places.get(name)
        through = name in WALLS or name in ("tr", "tbody", "thead", "tfoot", "html", "body")
        if own and (through or own[-1] > self._last(WALLS)):
            self._pop_to(own[-1])

    def _pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            name, change, state, opened, around = self.stack.pop()
            self.places[name].pop()
            self.unseen -= change
            if opened:
                self._shut(name, state)
            self.visible = around

    def _shut(self, name: str, state) -> None:
        kind = state[0] if state else None
        if kind == "cell":
            cell = [x for x in self.sheet.done() if x]
            self.sheet = state[1]
            grid = state[2]
            if not grid.rows:
                grid.rows.append([])
            grid.rows[-1].append((state[3], state[4], cell))
            return
        sheet = self.sheet
        if kind == "table":
            sheet.space()
            lines, spent = state[1].lines(self.room)
            self.room -= spent
            for row in lines:
                sheet._put(row)
                sheet.line()
        if name in ("pre", "xmp"):
            self.pre -= 1
        if kind == "list":
            sheet.line()
            sheet.indent = state[2]
            if not state[3]:
                sheet.space()
            return
        if kind == "item":
            sheet.line()
            sheet.indent, sheet.mark = state[1], ""
        if name == "q" and self.visible:
            sheet.text('"', False)
        if name in BLOCK:
            sheet.space() if name in SPACED else sheet.line()

    def text(self, s: str) -> None:
        if s and not self.unseen and self.visible:
            if self.stack and self.stack[-1][0] in ("table", "tbody", "thead", "tfoot", "tr") and not s.strip():
                return
            self.sheet.text(unescape(s) if "&" in s else s, self.pre > 0)

    @staticmethod
    def _tag(page: str, at: int) -> tuple[int, dict[str, str]]:
        """Where a tag ends whose name ends at `at`, and its attributes; -1 if the page ends first.

        Quotes count after an equals sign alone, as in HTML.  Each character is looked at a bounded number of times.
        """
        found: dict[str, str] = {}
        while True:
            at = _BETWEEN.match(page, at).end()
            if at >= len(page):
                return -1, found
            if page[at] == ">":
                return at + 1, found
            m = _ATTRIBUTE.match(page, at)
            name, value, at = m[0].lower(), "", m.end()
            if m := _EQUALS.match(page, at):
                at = m.end()
                quote = page[at : at + 1]
                if quote in ('"', "'"):
                    close = page.find(quote, at + 1)
                    if close < 0:
                        return -1, found
                    value, at = page[at + 1 : close], close + 1
                elif quote != ">":
                    m = _BARE.match(page, at)
                    value, at = m[0], m.end()
            found.setdefault(name, unescape(value) if "&" in value else value)

    def render(self, page: str) -> str:
        page = page.replace("\r\n", "\n").replace("\r", "\n")
        self.room = PADDING * len(page)
        at = begun = 0  # text not yet written begins there
        while (at := page.find("<", at)) >= 0:
            closing = page.startswith("/", at + 1)
            name = _NAME.match(page, at + 1 + closing)
            if not name and not closing and page[at + 1 : at + 2] not in ("!", "?"):
                at += 1
                continue
            self.text(page[begun:at])
            if not name:  # a comment, a declaration or an end tag of nothing
                comment = page.startswith("<!--", at)
                end = page.find("-->" if comment else ">", at + 2)
                begun = at = len(page) if end < 0 else end + (3 if comment else 1)
                continue
            end, attributes = self._tag(page, name.end())
            begun = at = len(page) if end < 0 else end
            if end < 0:
                break
            tag = name[0].lower()
            if closing:
                self.end(tag)
                continue
            self.start(tag, attributes)
            if tag in RAW:
                begun = at = self._raw(page, at, tag)
            elif tag == "pre" and page.startswith("\n", at):
                begun = at = at + 1
        self.text(page[begun:])
        self._pop_to(0)
        return "\n".join(self.sheet.done())

    def _raw(self, page: str, at: int, tag: str) -> int:
        """Past an element whose content is no markup."""
        close = _RAW_END[tag].search(page, at)
        stop = close.start() if close else len(page)
        if tag == "textarea":
            self.text(page[at:stop])
        elif tag == "xmp" and not self.unseen and self.visible:  # its text has no entities
            self.sheet.text(page[at:stop], True)
        self.end(tag)
        end = self._tag(page, close.end())[0] if close else -1
        return len(page) if end < 0 else end


_RAW_END = {name: re.compile(rf"</{name}(?=[ \t\n\f/>])", re.I) for name in RAW}


def extract(page: str | None) -> str:
    return Layout().render(page) if page else ""


def with_text(pages: DataFrame, source: str = "html", name: str = "text") -> DataFrame:
    """pages with the visible text of the column of HTML."""

    @F.pandas_udf("string")
    def visible(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([extract(x) for x in s], dtype=object)

    return pages.withColumn(name, visible(F.col(source)))


def op6_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages."""
    out = with_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op6_layout_text": op6_layout_text}
ORACLE_SQL: dict[str, str] = {}
