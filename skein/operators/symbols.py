"""Declarations of C#-like source by braces: symbols apart from each other, and chunks for each of them under a token budget.

One pass over a file with comments and strings blanked out at equal length, so places stay; a declaration is what stands
before a brace or a semicolon.  Nothing is compiled: preprocessor branches and macros are text like any other.

Defined cases: a null or blank file has no symbols and no chunks; a file without types has its header chunk alone; braces
that do not balance close with the file; repeated files are split each; a null path stays null; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .chunks import BUDGET, OVERLAP, estimate, pack_lines

_NOISE = re.compile(r"""//[^\n]*+|/\*.*?(?:\*/|\Z)|@"[^"]*+(?:""[^"]*+)*+"?|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?|'(?:\\.|[^'\\\n])'""", re.S)
_TYPE = re.compile(r"\b(class|struct|interface|enum|record)\s+(?:class\s+|struct\s+)?([A-Za-z_]\w*)")
_SPACE = re.compile(r"\bnamespace\s+([\w.]+)\s*$")
_BRACE = re.compile("[{};]")
_USING = re.compile(r"^[ \t]*(?:global\s+)?using\s+(?!\()[^;(]*;", re.M)
#: These meet heads whose white space is squeezed, and take a name from its first letter alone: else they were quadratic.
_CALLABLE = re.compile(r"(?<!\w)([A-Za-z_]\w*+) ?(?:<[^<>()]*>)? ?\((?:[^()]|\([^()]*\))*+\) ?(?:: ?(?:base|this) ?\(.*\)|where\b.*)?$", re.S)
_MEMBER = re.compile(r"[\w>\]?] (?<!\w)([A-Za-z_]\w*+)$")
#: Words that are followed by brackets and are no methods (fixed values).
CONTROL = frozenset("if for foreach while switch using lock catch return fixed nameof typeof when new await yield throw".split())


class Declaration(NamedTuple):
    kind: str  # namespace, class, struct, interface, enum, record, method, property, event or field
    name: str
    parent: int  # its place in the list, -1 for none
    start: int
    end: int
    begin: int  # where the text before it ends, so that its comments lie between
    mark: int  # its brace or semicolon


_END = Declaration._fields.index("end")
#: Without one of these words nothing is declared outside of a type.
_KEYWORD = re.compile("namespace|class|struct|interface|enum|record")
_OWNERS = ("class", "struct", "interface", "record")


def _blank(m: re.Match) -> str:
    text = m[0]
    return "\n".join([" " * len(x) for x in text.split("\n")]) if "\n" in text else " " * len(text)


def blanked(code: str) -> str:
    """Code with comments, strings and characters as blanks of equal length."""
    return _NOISE.sub(_blank, code)


def declarations(code: str, flat: str | None = None) -> list[Declaration]:
    """The declarations of a file in the order in which they begin; flat is the file blanked, where that is known."""
    flat = blanked(code) if flat is None else flat
    found: list[list] = []
    stack: list[int] = []  # an index into found, or -1 for a brace of another kind
    begin = 0
    for m in _BRACE.finditer(flat):
        mark, at = m[0], m.start()
        before, begin = begin, at + 1
        if mark == "}":
            if stack:
                k = stack.pop()
                if k >= 0:
                    found[k][_END] = begin
            continue
        parent = stack[-1] if stack else -1
        if stack and parent < 0:  # inside a body
            if mark == "{":
                stack.append(-1)
            continue
        head = flat[before:at]
        own = _declared(head, mark, found[parent][0] if parent >= 0 else "")
        if own is None:
            if mark == "{":
                stack.append(-1)
            continue
        start = before + len(head) - len(head.lstrip())
        if mark == "{" or own[0] == "namespace":  # to the end of the file, until its brace is met; a namespace without one is for the rest of the file
            stack.append(len(found))
            end = len(code)
        else:
            end = begin
        found.append([*own, parent, start, end, before, at])
    return [Declaration(*d) for d in found]


_ATTRIBUTES = re.compile(r"^(?: ?\[(?:[^\[\]]|\[[^\[\]]*\])*+\])++")


_VALUE_MARK = re.compile(r"=>|[<>!=]=|[()\[\]<>=,]")


def _before_value(text: str) -> tuple[str, str]:
    """The text before its first value or second declarator outside brackets, and the mark of the value: = or => or nothing."""
    depth = angles = 0
    end, given = len(text), ""
    for m in _VALUE_MARK.finditer(text):
        if m[0] in "([":
            depth += 1
        elif m[0] in ")]":
            depth -= 1
        elif m[0] in "<>":
            angles += 1 if m[0] == "<" else -1
        elif m[0] in ("=", "=>") and depth <= 0:
            end, given = min(end, m.start()), m[0]
            break
        elif m[0] == "," and depth <= 0 and angles <= 0:
            end = min(end, m.start())
    return text[:end].strip(), given


def _declared(head: str, mark: str, inside: str) -> tuple[str, str] | None:
    named = _KEYWORD.search(head)
    if not named and inside not in _OWNERS:
        return None
    text = " ".join(head.split())
    text = _ATTRIBUTES.sub("", text).strip() if text[:1] == "[" else text
    if named and (m := _SPACE.search(text)):
        return "namespace", m[1]
    body, given = _before_value(text)
    if named and (m := _TYPE.search(body)):
        return (m[1], m[2]) if mark == "{" or m[1] == "record" else None
    if inside not in _OWNERS:
        return None
    if "(" in body and (m := _CALLABLE.search(body)):
        return ("method", m[1]) if m[1] not in CONTROL else None
    if m := _MEMBER.search(body):
        if "event" in body and re.search(r"\bevent\b", body):
            return "event", m[1]
        return ("property" if given == "=>" or mark == "{" and not given else "field", m[1])
    return None


_TYPES = frozenset("class struct interface enum record".split())


def split_symbols(code: str) -> Iterator[tuple[str, str, str | None, str | None, str, str]]:
    """kind, name, namespace, declaring types, full name and text of each type; nested ones are taken out of the others' text."""
    found = declarations(code)
    usings = "".join(f"{x}\n" for x in dict.fromkeys(m[0].strip() for m in _USING.finditer(code)))
    for k, d in enumerate(found):
        if d.kind not in _TYPES:
            continue
        up, chain, spaces = d.parent, [], []
        while up >= 0:
            (spaces if found[up].kind == "namespace" else chain).insert(0, found[up].name)
            up = found[up].parent
        parts, at = [], d.start
        for x in found[k + 1 :]:
            if x.start >= d.end:
                break
            if x.kind in _TYPES and x.start >= at:
                parts.append(code[at : x.start])
                at = x.end
        body = "".join([*parts, code[at : d.end]]).replace("\r\n", "\n")
        space = ".".join(spaces) or None
        if space:
            body = f"namespace {space}\n{{\n" + "".join(f"    {x}\n" if x else "\n" for x in body.split("\n")) + "}"
        yield d.kind, d.name, space, ".".join(chain) or None, ".".join([*spaces, *chain, d.name]), (usings + "\n" if usings else "") + body + "\n"


def signature(flat: str, code: str, d: Declaration) -> str:
    """A callable as it is written from its type to its closing bracket; of a constructor from its name on."""
    open_ = re.compile(r"(?<!\w)" + re.escape(d.name) + r"\s*+(?:<[^<>()]*+>\s*+)?\(").search(flat, d.start, d.mark)
    if not open_:
        return d.name
    depth, end = 0, d.mark
    for m in re.compile(r"[()]").finditer(flat, open_.end() - 1, d.mark):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            end = m.end()
            break
    before = _ATTRIBUTES.sub("", " ".join(flat[d.start : open_.start()].split())).split()
    type_ = " ".join(w for w in before if w not in _MODIFIERS)
    return f"{type_} {d.name}{code[open_.end() - 1 : end]}".strip()


#: Words before the type of a method (fixed values).
_MODIFIERS = frozenset("public protected internal private static virtual override async abstract sealed new partial extern unsafe".split())


def symbol_chunks(code: str, budget: int = BUDGET, overlap: int = OVERLAP) -> Iterator[tuple[str, str | None, int, int, str]]:
    """kind, name, first line, last line, text: the header (comments and usings), then each symbol, cut under the budget.

    Each chunk of a method begins with a comment line that says which method it is of; the line is not part of the budget.
    """
    first = re.match(r"(?:\s|//[^\n]*|/\*.*?\*/)*", code, re.S)[0].strip()
    header = "\n".join(x for x in (first, "\n".join(m[0].strip() for m in _USING.finditer(code))) if x)
    while header and estimate(header) > budget:
        header = header[: int(len(header) * 0.9)]
    if header:
        yield "file", None, 1, min(code.count("\n") + 1, 200), header
    lines = [0, *[m.end() for m in re.finditer("\n", code)]]

    def line_of(at: int) -> int:
        lo, hi = 0, len(lines)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if lines[mid] <= at else (lo, mid)
        return lo + 1

    flat = blanked(code)
    for d in declarations(code, flat):
        if d.kind == "namespace":
            continue
        base = line_of(d.start)
        title = f"// Method {d.name}. Signature: {signature(flat, code, d)}.\n" if d.kind == "method" else ""
        for a, b, text in pack_lines(code[lines[base - 1] : d.end], budget, overlap):
            text = title + text
            yield "type" if d.kind in _TYPES else d.kind, d.name, base + a - 1, base + b - 1, text


def _each(files: DataFrame, path: str, text: str, split, columns: list[StructField]) -> DataFrame:
    """path and what `split` makes of each file, as Arrow batches of bounded size."""
    schema = StructType([files.schema[path], *columns])
    types = [pa.int32() if isinstance(c.dataType, IntegerType) else pa.string() for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out, rows = batch.slice(at, 256), [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    made = list(split(t)) if t and not t.isspace() else []
                    out += made
                    rows += [i] * len(made)
                if out:
                    values = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), *values], names=schema.names)

    return files.select(path, text).mapInArrow(run, schema)


def _fields(text: str, ints: str = "") -> list[StructField]:
    return [StructField(c, IntegerType() if c in ints.split() else StringType()) for c in text.split()]


def with_symbols(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, symbol_kind, symbol, namespace, declaring, full_name, text of each type of each file."""
    return _each(files, path, text, split_symbols, _fields("symbol_kind symbol namespace declaring full_name text"))


def with_symbol_chunks(files: DataFrame, budget: int = BUDGET, overlap: int = OVERLAP, path: str = "path", text: str = "text") -> DataFrame:
    """path, part, total, symbol_kind, symbol, first_line, last_line, tokens, chunk of each file; the header is named by its path."""

    def split(code: str):
        made = list(symbol_chunks(code, budget, overlap))
        for n, (kind, name, a, b, chunk) in enumerate(made, 1):
            yield n, len(made), kind, name, a, b, estimate(chunk), chunk

    return _each(files, path, text, split, _fields("part total symbol_kind symbol first_line last_line tokens chunk", "part total first_line last_line tokens"))
