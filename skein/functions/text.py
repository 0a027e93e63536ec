"""Column functions over text: normalisation, hashes, identities, estimates.  All stay inside the JVM.

Lengths are in code points.  White space and word characters are Unicode, written as classes that Java's and RE2's regular
expressions read alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes without their brackets (fixed values).
WHITE = r"\t-\r \x{85}\p{Z}"
WORD = r"\p{L}\p{Mn}\p{Nd}\p{Pc}"
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}"
URL = rf"(?i)https?://[^{WHITE}]+|www\.[^{WHITE}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_white(c: Column | str) -> Column:
    # a run is tried at its first character alone, so long inner runs cost no more than their length
    return F.regexp_replace(_col(c), rf"^[{WHITE}]++|(?<![{WHITE}])[{WHITE}]++$", "")


def is_blank(c: Column | str) -> Column:
    """True for null, empty and all-white text."""
    return F.coalesce(~_col(c).rlike(f"[^{WHITE}]"), F.lit(True))


def normalize_crlf(c: Column | str) -> Column:
    """Each of CR, LF and CRLF becomes CRLF."""
    return F.regexp_replace(_col(c), "\r\n|\r|\n", "\r\n")


def sha256_hex(c: Column | str) -> Column:
    return F.sha2(_col(c), 256)


def file_hash(c: Column | str) -> Column:
    """SHA-256 of the text with CRLF line ends."""
    return sha256_hex(normalize_crlf(c))


def code_hash(c: Column | str, width: int = 500) -> Column:
    """SHA-256 of the text with LF line ends, lines cut at `width`, and LF after each line; '' for null."""
    lines = F.split(F.regexp_replace(_col(c), "\r\n|\r", "\n"), "\n", -1)
    cut = F.array_join(F.transform(lines, lambda x: F.concat(F.substring(x, 1, width), F.lit("\n"))), "")
    return F.when(_col(c).isNull(), "").otherwise(sha256_hex(cut))


def uuid5_hex(name: Column | str, namespace: str) -> Column:
    """Version-5 UUID of a name as 32 upper-case hexadecimal digits without dashes."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(_col(name), "UTF-8")))
    variant = F.substring(F.lit("89AB"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.upper(F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15)))


#: Namespace of document ids (fixed value).
DOC_NAMESPACE = "9a9a77a0-6f19-4b44-a8a7-4e4e1a4f3d01"


def canonical_path(project: Column | str, path: Column | str) -> Column:
    joined = F.concat(F.lit("/"), _col(project), F.lit("/"), _col(path))
    return F.lower(F.trim(F.regexp_replace(F.translate(joined, "\\", "/"), "/+", "/")))


def normalize_repo_url(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(trim_white(c), "/+$", ""))


def normalize_index_path(c: Column | str) -> Column:
    """Key of a path: forward slashes, none doubled, no leading ./, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.translate(_col(c), "\\", "/"), "/+", "/"), r"^(\./)+", ""))


def doc_id(repo_url: Column | str, project: Column | str, path: Column | str) -> Column:
    return uuid5_hex(F.concat(normalize_repo_url(repo_url), F.lit("|"), canonical_path(project, path)), DOC_NAMESPACE)


def normalize_route(c: Column | str, blank_as_null: bool = False) -> Column:
    """Route without query, with {x} for placeholders, one slash at a time, none at the end, in lower case."""
    r = F.translate(F.regexp_replace(trim_white(c), r"(?s)\?.*$", ""), "\\", "/")
    r = F.regexp_replace(F.regexp_replace(r, "/+", "/"), r"\{[^}]+\}", "{x}")
    r = F.when(F.length(r) > 1, F.regexp_replace(r, "/+$", "")).otherwise(r)
    r = F.when(~F.startswith(r, F.lit("/")) & F.contains(r, F.lit("/")), F.concat(F.lit("/"), r)).otherwise(r)
    return F.when(is_blank(c), F.lit(None) if blank_as_null else F.lit("")).otherwise(F.lower(r))


def parse_boolish(c: Column | str) -> Column:
    v = F.lower(trim_white(c))
    return F.when(v.isin("true", "1"), True).when(v.isin("false", "0"), False)


def estimate_tokens(c: Column | str) -> Column:
    """Rough number of model tokens; 0 for blank text."""
    s = _col(c)
    cjk = F.regexp_count(s, F.lit(f"[{CJK}]"))
    urls = F.aggregate(
        F.regexp_extract_all(s, F.lit(f"({URL})"), F.lit(1)), F.lit(0).cast("long"),
        lambda a, u: a + F.greatest(F.lit(8).cast("long"), F.ceil(F.length(u) / 3.0)),
    )
    marks = F.regexp_count(s, F.lit(f"[^{WORD}{WHITE}]"))
    words = F.regexp_count(s, F.lit(f"[{WORD}]+"))
    by_kind = F.ceil((F.length(s) - cjk) / 4.0) + cjk + urls + F.ceil(marks / 3.0)
    return F.when(is_blank(s), F.lit(0).cast("long")).otherwise(F.greatest(by_kind, F.ceil(words * F.lit(0.7).cast("double"))) + 2)


def slugify(c: Column | str) -> Column:
    s = F.regexp_replace(F.lower(trim_white(c)), f"[{WHITE}]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9-]", ""), "-+", "-")
    return F.coalesce(F.regexp_replace(s, "^-|-$", ""), F.lit(""))


def normalize_question(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.translate(trim_white(c), "`", ""), f"[{WHITE}]+", " "))


#: Dotted identifiers, or capitalised words of three letters or more (fixed value).
APPLIES = r"^(?:[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+|[A-Z][A-Za-z0-9_]{2,})$"


def applies_to(c: Column | str, most: int = 50) -> Column:
    """Dotted identifiers and capitalised words of three letters or more, distinct ignoring case, sorted."""
    runs = F.regexp_extract_all(_col(c), F.lit(rf"([{WORD}]+(?:\.[{WORD}]+)*)"), F.lit(1))
    found = F.filter(runs, lambda x: x.rlike(APPLIES))
    return F.slice(F.array_sort(F.array_distinct(F.transform(found, lambda x: F.lower(x)))), 1, most)


def html_to_text(c: Column | str) -> Column:
    """Drops script, style and tags and collapses white space; entities stay (see functions.python.unescape_html)."""
    s = _col(c)
    for name in ("script", "style"):  # up to the last closing tag, so no opening one is sought to the end in vain
        head = F.regexp_extract(s, rf"(?is)^(.*</{name}>)", 1)
        s = F.concat(F.regexp_replace(head, rf"(?is)<{name}.*?</{name}>", " "), F.substring(s, F.length(head) + 1, F.length(s)))
    tail = F.substring_index(s, ">", -1)
    head = F.substring(s, F.lit(1), F.length(s) - F.length(tail))
    s = F.concat(F.regexp_replace(head, "<[^>]+>", " "), tail)
    collapsed = F.regexp_replace(F.regexp_replace(s, "[\r\n\t]+", " "), f"[{WHITE}]{{2,}}", " ")
    return F.coalesce(trim_white(collapsed), F.lit(""))


def looks_like_html(c: Column | str) -> Column:
    return F.contains(_col(c), F.lit("<")) & F.contains(_col(c), F.lit(">"))


def slice_lines(c: Column | str, start: int, end: int) -> Column:
    """Lines start to end, from 1, as far as there are any."""
    first = max(1, start)
    return F.array_join(F.slice(F.split(_col(c), "\r?\n", -1), first, max(0, end - first + 1)), "\n")


#: Extension to language (fixed values).
LANGUAGES = {
    "cs": "csharp", "ts": "typescript", "js": "javascript", "html": "html", "css": "css", "json": "json", "xml": "xml", "md": "markdown",
    "sql": "sql", "py": "python",
}


def language_from_path(c: Column | str, otherwise: str | None = "plaintext") -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(table[F.lower(F.regexp_extract(_col(c), r"\.([^./\\]+)$", 1))], F.lit(otherwise))


def table_safe(c: Column | str) -> Column:
    return F.when(is_blank(c), "_").otherwise(F.translate(_col(c), "/\\#?", "____"))


def joined_key(*parts: Column | str, by: str = "|") -> Column:
    return F.concat_ws(by, *[F.coalesce(_col(p), F.lit("")) for p in parts])


def chunk_id(*parts: Column | str) -> Column:
    """Colon-joined lower-case identity of the parts that are not blank."""
    return F.lower(F.concat_ws(":", *[F.when(~is_blank(p), trim_white(p)) for p in parts]))


def semantic_id(*parts: Column | str) -> Column:
    """Colon-joined identity; an empty part is an error."""
    value = F.concat_ws(":", *[F.coalesce(_col(p), F.lit("")) for p in parts])
    return F.when(F.contains(value, F.lit("::")) | F.startswith(value, F.lit(":")) | F.endswith(value, F.lit(":")), F.raise_error(F.concat(F.lit("empty part in "), value))).otherwise(value)


def truncate_utf8(c: Column | str, max_bytes: Column | int) -> Column:
    """The longest prefix of at most so many UTF-8 bytes that ends between characters."""
    raw = F.encode(_col(c), "UTF-8")
    most = F.lit(max_bytes) if isinstance(max_bytes, int) else max_bytes.cast("int")
    out = F.when(F.octet_length(_col(c)) <= most, raw)
    for back in range(4):  # a cut is inside a character iff a continuation byte (10xxxxxx) comes next
        n = most - back
        follows = F.conv(F.hex(F.substring(raw, n + 1, F.lit(1))), 16, 10).cast("int")
        out = out.when((n >= 0) & ~follows.between(0x80, 0xBF), F.substring(raw, F.lit(1), n))
    return F.decode(out, "UTF-8")


def parse_iso_or_min(c: Column | str) -> Column:
    return F.coalesce(F.try_to_timestamp(_col(c)), F.lit("0001-01-01 00:00:00").cast("timestamp"))


def has_any_tag(tags: Column | str, wanted: list[str]) -> Column:
    return F.arrays_overlap(F.transform(_col(tags), lambda t: F.lower(trim_white(t))), F.array(*[F.lit(w.strip().lower()) for w in wanted]))


def has_all_tags(tags: Column | str, wanted: list[str]) -> Column:
    own = F.transform(_col(tags), lambda t: F.lower(trim_white(t)))
    return F.size(F.array_except(F.array(*[F.lit(w.strip().lower()) for w in wanted]), own)) == 0


def is_test_path(c: Column | str) -> Column:
    p = F.translate(_col(c), "\\", "/")
    return p.rlike(r"(?i)/tests/|\.tests/|tests\.cs$")


def batch_size(dim: Column | int) -> Column:
    """Points to write at once for vectors of so many dimensions."""
    d = F.lit(dim) if isinstance(dim, int) else dim
    return F.least(F.greatest(F.floor(2_500_000 / (28 * d + 2000)), F.lit(8)), F.lit(128)).cast("int")


def method_kind(name: Column | str) -> Column:
    n, out = _col(name), F.lit("Other")
    rules = [("Query", "get|list|query"), ("Validation", "validat"), ("Delete", "delete|remove"), ("Update", "update|upsert"), ("Create", "add|create")]
    for kind, start in rules:
        out = F.when(n.rlike(f"(?i)^(?:{start})"), kind).otherwise(out)
    return out


def combine_routes(a: Column | str, b: Column | str) -> Column:
    x, y = F.regexp_replace(_col(a), "^/+|/+$", ""), F.regexp_replace(_col(b), "^/+|/+$", "")
    return F.concat(F.lit("/"), F.concat_ws("/", F.nullif(x, F.lit("")), F.nullif(y, F.lit(""))))


def endpoint_key(controller: Column | str, action: Column | str) -> Column:
    """Controller and action, the latter without Async at its end."""
    return F.concat_ws(".", _col(controller), F.regexp_replace(_col(action), "Async$", ""))


def ddr_identifier(c: Column | str) -> Column:
    """TLA-000001 form of an identifier with one to six digits; null for anything else."""
    m = rf"^[{WHITE}]*([A-Za-z]{{3}})-([0-9]{{1,6}})[{WHITE}]*$"
    return F.when(_col(c).rlike(m), F.concat(F.upper(F.regexp_extract(_col(c), m, 1)), F.lit("-"), F.lpad(F.regexp_extract(_col(c), m, 2), 6, "0")))


def typed_check(value: Column | str, kind: str, required: bool = False, choices: list[str] | None = None) -> Column:
    """Error text of a user-defined field value, null if it is valid."""
    v = _col(value)
    tests = {
        "Number": v.try_cast("double").isNull(), "Bool": parse_boolish(v).isNull(), "Date": v.try_cast("date").isNull(),
        "DateTime": v.try_cast("timestamp").isNull(), "Enum": ~v.isin(choices or []), "Text": F.lit(False),
    }
    if kind not in tests:
        raise ValueError(f"unknown field kind {kind}")
    missing = F.when(is_blank(v), F.lit("required") if required else F.lit(None))
    return missing if kind == "Text" else F.when(is_blank(v), missing).when(tests[kind], F.lit(f"not a valid {kind}"))


def calculate(op: str, a: Column | str, b: Column | str) -> Column:
    x, y = _col(a), _col(b)
    if op == "div":
        return F.when(F.abs(y) < 1e-300, F.raise_error(F.lit("division by zero"))).otherwise(x / y)
    return {"add": x + y, "sub": x - y, "mul": x * y}[op]


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity in double precision; null where a vector is all zero."""
    def dot(x, y):
        return F.aggregate(F.zip_with(_col(x), _col(y), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
