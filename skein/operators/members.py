"""Types of C#-like source with their members, attributes, parameters and comments: one nested row per type.

Descriptions, route tables, catalogues and metadata are DataFrame operations on these rows (operators/describe.py and
operators/catalogue.py).  A declaration is read from what stands before its brace or semicolon, over the file with comments
and strings blanked at equal length, so that nothing inside them disturbs it; values are cut out of the file itself.

Nothing is compiled: types are named as they are written, preprocessor branches are text like any other.

Defined cases: a null or blank file has no types; a file with braces that do not balance ends its open declarations; partial
classes are a row each; comments `///` belong to the declaration that follows them; a null path stays null; repeated files are
read each; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

from .symbols import Declaration, blanked, declarations

_ATTRIBUTE = "array<struct<name:string,args:array<struct<name:string,text:string,value:string>>>>"
_DOC = "struct<summary:string,remarks:string,params:array<struct<name:string,text:string>>>"
_PARAMETER = f"array<struct<name:string,type:string,value:string,attributes:{_ATTRIBUTE}>>"
MEMBER = (
    f"struct<kind:string,name:string,type:string,modifiers:array<string>,attributes:{_ATTRIBUTE},parameters:{_PARAMETER},doc:{_DOC},"
    "text:string,value:string,body:string,statements:int,calls:array<struct<target:string,name:string>>,"
    "given:array<struct<name:string,text:string,value:string>>,first_line:int,last_line:int>"
)
#: What is read of a type.  args and parameters keep the text of a value, and the string where it is a literal; given is what the
#: object initializer of a member's first return sets; first_of_kind: no other type of its kind begins before in the file.
TYPE = (
    f"position int, first_of_kind boolean, siblings array<struct<kind:string,name:string>>, kind string, name string, arity int, namespace string, declaring string, modifiers array<string>, attributes {_ATTRIBUTE}, "
    f"bases array<string>, doc {_DOC}, first_line int, last_line int, members array<{MEMBER}>"
)


class Needs(NamedTuple):
    """What is read of types and of their members: names of fields, and kinds of members; members of other kinds are left out."""

    fields: frozenset[str]
    members: frozenset[str] = frozenset()
    kinds: frozenset[str] = frozenset()


def needs(fields: str, members: str = "", kinds: str = "") -> Needs:
    """Fields of TYPE, fields of MEMBER besides its kind, and kinds of members, apart by blanks."""
    return Needs(frozenset(fields.split() + ["members"] * bool(kinds)), frozenset(["kind", *members.split()]), frozenset(kinds.split()))


#: All there is.
ALL = needs(
    "position first_of_kind siblings kind name arity namespace declaring modifiers attributes bases doc first_line last_line",
    "name type modifiers attributes parameters doc text value body statements calls given first_line last_line", "method constructor property event field",
)
#: Words before a declaration's type (fixed values).
MODIFIERS = frozenset("public protected internal private static virtual override async abstract sealed readonly const new partial extern unsafe volatile required ref event".split())
_TYPES = frozenset("class struct interface enum record".split())
_MARK = re.compile(r"=>|[<>!=]=|[()\[\]{}<>,:=]")
_HEAD = re.compile(r"\b(?:class|struct|interface|enum|record)\b(?: (?:class|struct)\b)? ?([A-Za-z_]\w*+)")
_CALL = re.compile(r"(?<![\w.])([A-Za-z_]\w*+)\s*+\.\s*+([A-Za-z_]\w*+)")
_CREATED = re.compile(r"\breturn\s++new\s++[\w.<>]++\s*+(?:\([^()]*+\)\s*+)?\{")
_ATTRIBUTE_NAME = re.compile(r"\s*(?:(?:assembly|module|return|field|property|method|param|type)\s*:\s*)?([\w.:]+)\s*")
_ARGUMENT_NAME = re.compile(r"\s*(\w+)\s*(?:=(?![=>])|:(?!:))")
_BEFORE_TYPE = re.compile(r"^(?:(?:this|ref|out|in|params|scoped) )+")
_PAIRS = {"(": re.compile(r"[()]"), "[": re.compile(r"[\[\]]"), "<": re.compile("[<>]"), "{": re.compile("[{}]")}
_COMMENT = re.compile(r"^[ \t]*///(?!/)[ \t]?(.*)$", re.M)
_STATEMENT = re.compile(r"[(){};]")
_GOES_ON = re.compile(r"\s*(?:[;,.)]|else\b|catch\b|finally\b|while\b)")
_WHERE = re.compile(r"\bwhere\b")
_NEW_LINE = re.compile("\n")
_LITERAL = re.compile(r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"', re.S)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{1,4})|(.))", re.S)
_PLAIN = dict(zip("0abfnrtv", "\0\a\b\f\n\r\t\v", strict=True))


def literal(text: str) -> str | None:
    """The string that a literal stands for; None for any other expression."""
    if text.startswith('@"') and text.endswith('"') and len(text) > 2:
        body = text[2:-1]
        return body.replace('""', '"') if '"' not in body.replace('""', "") else None
    if not _LITERAL.fullmatch(text):
        return None
    if "\\" not in text:
        return text[1:-1]

    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        if code:
            return chr(int(code, 16)) if int(code, 16) < 0x110000 else m[0]
        return _PLAIN.get(m[4], m[4])

    return _ESCAPE.sub(one, text[1:-1])


def _squeezed(text: str) -> str:
    return " ".join(text.split())


class _File:
    """A file, its blanked form, and the places of its lines."""

    def __init__(self, code: str, asked: Needs = ALL):
        self.code, self.flat, self.asked = code, blanked(code), asked
        self._lines: list[int] = []

    def line(self, at: int) -> int:
        if not self._lines:
            self._lines = [0, *[m.end() for m in _NEW_LINE.finditer(self.code)]]
        return bisect_right(self._lines, at)

    def marks(self, a: int, b: int) -> Iterator[tuple[str, int]]:
        """Marks outside all brackets between two places, and the places of outer opening and closing brackets."""
        depth = 0
        for m in _MARK.finditer(self.flat, a, b):
            c = m[0]
            if c in "([{<":
                if not depth:
                    yield c, m.start()
                depth += 1
            elif c in ")]}>":
                depth = max(depth - 1, 0)
                if not depth:
                    yield c, m.start()
            elif not depth:
                yield c, m.start()

    def split(self, a: int, b: int) -> list[tuple[int, int]]:
        """The parts between commas outside brackets; none if all is blank."""
        if self.flat.find(",", a, b) < 0:
            return [(a, b)] if self.code[a:b].strip() else []
        commas = [i for c, i in self.marks(a, b) if c == ","]
        parts = list(zip([a, *[i + 1 for i in commas]], [*commas, b], strict=True))
        return [(x, y) for x, y in parts if self.code[x:y].strip()]

    def closing(self, a: int, b: int) -> int:
        """The place of the bracket that closes the one at a, or b."""
        depth, opening = 0, self.flat[a]
        for m in _PAIRS[opening].finditer(self.flat, a, b):
            depth += 1 if m[0] == opening else -1
            if not depth:
                return m.start()
        return b

    def attributes(self, a: int, b: int, read: bool = True) -> tuple[list[dict], int]:
        """The attributes at a, if they are to be read, and where they end."""
        found = []
        while True:
            if self.flat[a : a + 1].isspace():
                rest = self.flat[a:b]
                a += len(rest) - len(rest.lstrip())
            if self.flat[a : a + 1] != "[" or a >= b:
                return found, a
            end = self.closing(a, b)
            for x, y in self.split(a + 1, end) if read else ():
                m = _ATTRIBUTE_NAME.match(self.flat, x, y)
                if m:
                    args = self.arguments(m.end() + 1, self.closing(m.end(), y)) if self.flat[m.end() : m.end() + 1] == "(" and m.end() < y else []
                    found.append({"name": m[1], "args": args})
            a = end + 1

    def arguments(self, a: int, b: int) -> list[dict]:
        out = []
        for x, y in self.split(a, b):
            m = _ARGUMENT_NAME.match(self.flat, x, y)
            text = self.code[m.end() if m else x : y].strip()
            out.append({"name": m[1] if m else None, "text": text, "value": literal(text)})
        return out

    def parameters(self, a: int, b: int) -> list[dict]:
        out = []
        for x, y in self.split(a, b):
            own, x = self.attributes(x, y) if self.flat.find("[", x, y) >= 0 else ([], x)
            given = next((i for c, i in self.marks(x, y) if c == "="), y) if self.flat.find("=", x, y) >= 0 else y
            words = _squeezed(self.flat[x:given])
            type_, _, name = _BEFORE_TYPE.sub("", words).rpartition(" ")
            out.append({"name": name, "type": type_, "value": self.code[given + 1 : y].strip() if given < y else None, "attributes": own})
        return out

    def doc(self, d: Declaration) -> dict | None:
        """The documentation comment before a declaration, without the marks at the starts of its lines."""
        before = self.code[d.begin : d.start]
        lines = _COMMENT.findall(before) if "///" in before else []
        if not lines:
            return None
        text = "\n".join(x.rstrip("\r") for x in lines)
        tidy = lambda t: "\n".join(x.strip() for x in t.strip().split("\n"))
        first = lambda tag: next((tidy(m[1]) for m in re.finditer(rf"<{tag}>(.*?)</{tag}>", text, re.S)), None)
        params = [{"name": m[1], "text": tidy(m[2])} for m in re.finditer(r'<param name="(\w*)">(.*?)</param>', text, re.S)]
        return {"summary": first("summary"), "remarks": first("remarks"), "params": params}

    def statements(self, a: int, b: int) -> int:
        """Statements of a block, blocks inside it counted as one each."""
        n = braces = rounds = 0
        for m in _STATEMENT.finditer(self.flat, a, b):
            if m[0] in "()":
                rounds += 1 if m[0] == "(" else -1
            elif m[0] == "{":
                braces += 1
            elif m[0] == "}":
                braces -= 1
                after = _GOES_ON.match(self.flat[m.end() : m.end() + 64])
                n += not braces and not rounds and not after
            else:
                n += not braces and not rounds
        return n

    def member(self, d: Declaration, owner: str) -> Iterator[dict]:
        asked = self.asked.members
        attributes, at = self.attributes(d.start, d.mark, "attributes" in asked)
        out = {
            "attributes": attributes, "doc": self.doc(d) if "doc" in asked else None, "parameters": [], "text": None, "value": None, "body": None, "statements": 0, "calls": [],
            "given": [], "first_line": self.line(d.start) if "first_line" in asked else 0, "last_line": self.line(d.end - 1) if "last_line" in asked else 0,
        }
        marks = list(self.marks(at, d.mark))
        arrow = next((i for c, i in marks if c == "=>"), d.mark)
        given = next((i for c, i in marks if c == "=" and i < arrow), d.mark)
        is_field = d.kind in ("field", "event")
        stop = given if is_field else arrow
        if not is_field and (arrow < d.mark or self.flat[d.mark] == "{"):
            if "body" in asked:
                out["body"] = self.code[min(arrow, d.mark) : d.end].rstrip(";").rstrip() if arrow < d.mark else self.code[d.mark : d.end]
            if "calls" in asked:
                out["calls"] = [{"target": m[1], "name": m[2]} for m in _CALL.finditer(self.flat, min(arrow, d.mark), d.end)]
            if "given" in asked and (m := _CREATED.search(self.flat, d.mark, d.end)):
                out["given"] = [x for x in self.arguments(m.end(), self.closing(m.end() - 1, d.end)) if x["name"]]
            if "statements" in asked:
                out["statements"] = self.statements(d.mark + 1, d.end - 1) if arrow == d.mark else 0
        if d.kind == "method":
            ends = next((i for c, i in marks if c == ":"), stop)
            where = _WHERE.search(self.flat, at, ends) if self.flat.find("where", at, ends) >= 0 else None
            opened = [i for c, i in marks if c == "(" and i < (where.start() if where else ends)]
            if not opened:
                return
            if "parameters" in asked:
                out["parameters"] = self.parameters(opened[-1] + 1, self.closing(opened[-1], d.mark))
            stop = opened[-1]
        head = _squeezed(self.flat[at:stop])
        names, parts = [""], self.split(at, d.mark) if is_field else []
        if is_field:
            first, *more = [_squeezed(self.flat[x:y].split("=", 1)[0]) for x, y in parts] or [""]
            head, names = first, ["", *more]
        words = head.split(" ")
        n = next((i for i, w in enumerate(words) if w not in MODIFIERS), len(words))
        modifiers, rest = words[:n], " ".join(words[n:])
        if rest.endswith(">"):  # type parameters of a method
            depth = 0
            for i in range(len(rest) - 1, -1, -1):
                depth += (rest[i] == ">") - (rest[i] == "<")
                if not depth:
                    rest = rest[:i].rstrip()
                    break
        type_, _, name = rest.rpartition(" ")
        kind = "constructor" if d.kind == "method" and not type_ and name == owner else d.kind
        if name.startswith("~") or d.kind == "method" and not type_ and kind == "method":
            return
        if kind not in self.asked.kinds:
            return
        values = [self.code[x:y] for x, y in parts]
        for k, extra in enumerate(names):
            text = values[k].split("=", 1)[1].strip() if k < len(values) and "=" in self.flat[slice(*parts[k])] else None
            if is_field and self.flat[d.mark] == "{" and given < d.mark:
                text = self.code[given + 1 : d.end].strip()
            yield out | {
                "kind": kind, "name": (extra or name).rpartition(".")[2], "type": type_ or None, "modifiers": modifiers,
                "text": text, "value": literal(text) if text else None,
            }

    def type_row(self, found: list[Declaration], k: int, position: int, children: list[int]) -> dict:
        d = found[k]
        attributes, at = self.attributes(d.start, d.mark, "attributes" in self.asked.fields)
        head = _squeezed(self.flat[at : d.mark])
        m = _HEAD.search(head)
        up, chain, spaces = d.parent, [], []
        while up >= 0:
            (spaces if found[up].kind == "namespace" else chain).insert(0, found[up].name)
            up = found[up].parent
        marks = list(self.marks(at, d.mark))
        colon = next((i for c, i in marks if c == ":"), None)
        generic = next((i for c, i in marks if c == "<" and (colon is None or i < colon)), None)
        where = _WHERE.search(self.flat, at, d.mark)
        end = where.start() if where else d.mark
        kinds = self.asked.kinds | ({"method"} if "constructor" in self.asked.kinds else set())
        return {
            "position": position, "kind": d.kind, "name": d.name, "arity": len(self.split(generic + 1, self.closing(generic, d.mark))) if generic is not None and generic < end else 0,
            "namespace": ".".join(spaces) or None, "declaring": ".".join(chain) or None, "modifiers": head[: m.start()].split() if m else [], "attributes": attributes,
            "bases": [_squeezed(self.flat[x:y]) for x, y in self.split(colon + 1, end)] if colon is not None and colon < end else [], "doc": self.doc(d),
            "first_line": self.line(d.start), "last_line": self.line(d.end - 1),
            "members": [x for c in children if found[c].kind in kinds for x in self.member(found[c], d.name)],
        }


def types_of(code: str, asked: Needs = ALL) -> list[dict]:
    """The types of a file in the order in which they begin, nested ones too; what is not asked for is not read."""
    file = _File(code, asked)
    found = declarations(code, file.flat)
    children: dict[int, list[int]] = {}
    for k, d in enumerate(found):
        children.setdefault(d.parent, []).append(k)
    own = [k for k, d in enumerate(found) if d.kind in _TYPES]
    siblings = [{"kind": found[k].kind, "name": found[k].name} for k in own]
    rows = [file.type_row(found, k, n, children.get(k, [])) for n, k in enumerate(own)]
    return [r | {"siblings": siblings, "first_of_kind": r["kind"] not in {x["kind"] for x in rows[:n]}} for n, r in enumerate(rows)]


def _asked(asked: Needs) -> StructType:
    """The fields of TYPE and of its members that are asked for."""
    own = DataType.fromDDL(TYPE)
    member = own["members"].dataType.elementType
    kept = ArrayType(StructType([f for f in member.fields if f.name in asked.members]))
    return StructType([StructField(f.name, kept) if f.name == "members" else f for f in own.fields if f.name in asked.fields])


def with_types(files: DataFrame, path: str = "path", text: str = "text", asked: Needs = ALL) -> DataFrame:
    """path and the columns of TYPE that are asked for, a row for each type of each file."""
    own = _asked(asked)
    schema = StructType([StructField(path, files.schema[path].dataType), *own.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [to_arrow_type(f.dataType) for f in own.fields]
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part, out, rows = batch.slice(at, 128), [], []
                for i, code in enumerate(part.column(1).to_pylist()):
                    made = types_of(code, asked) if code and not code.isspace() else []
                    out += made
                    rows += [i] * len(made)
                if out:
                    values = [pa.array([r[f.name] for r in out], k) for f, k in zip(own.fields, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), *values], names=schema.names)

    return files.select(path, text).mapInArrow(run, schema)
