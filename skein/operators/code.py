"""Source code without a compiler: kinds of file, symbols, resource usages, design documents.

Comments and strings are blanked by one regular expression, then declarations are found by others; nested generics, macros
and preprocessor branches are not understood.  Everything is column expressions and generators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_test_path

#: Kinds in the order in which they are tried: name, test of the text, suffix of the type name (fixed values).
KINDS = (
    ("Test", r"\[(?:Test|TestMethod|TestClass|TestFixture|Fact|Theory)\b", r"Tests?$"),
    ("DomainDescription", r"\[Domain(?:Descriptor|Description)\b", r"Domain$"),
    ("Exception", r":\s*(?:\w+\.)*\w*Exception\b", r"Exception$"),
    ("ListModel", r":\s*(?:\w+\.)*SummaryData\b", r"Summary$"),
    ("Model", r"\[EntityDescription\b", r"Model$"),
    ("Manager", r"class\s+\w+Manager\b", r"Manager$"),
    ("Repository", r"class\s+\w+Repo(?:sitory)?\b", r"Repo(?:sitory)?$"),
    ("Controller", r"\[(?:ApiController|Route)\b|class\s+\w+Controller\b", r"Controller$"),
    ("Service", r"class\s+\w+Service\b", r"Service$"),
    ("Interface", r"\binterface\s+I[A-Z]\w*", r"^I[A-Z]\w*$"),
    ("Startup", r"class\s+Startup\b", r"^Startup$"),
)
#: Comments, strings and characters.  Possessive and without alternatives in a loop: the stack of the JVM's engine grows with those.
_COMMENT = r"//[^\n]*+|/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/)?+"
_STRING = r"""@"[^"]*+(?:""[^"]*+)*+"|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'(?:\\.|[^'\\\n])'"""
_NOISE = rf"(?s){_COMMENT}|{_STRING}"
_TYPE = r"\b(class|interface|struct|enum|record)\s+([A-Za-z_]\w*)"
_METHOD = r"(?m)^[ \t]*((?:(?:public|protected|internal|private|static|virtual|override|async|abstract|sealed)\s+)+)([\w<>\[\],.? ]+?)\s+([A-Za-z_]\w*)\s*\(([^()]*)\)"


def blanked(c: Column | str) -> Column:
    """Code with comments, strings and characters as one space each."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, _NOISE, " ")


def without_comments(c: Column | str) -> Column:
    """Code with each comment as one space; strings stay."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, rf"(?s)({_STRING})|{_COMMENT}", "$1 ")


def with_kind(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """files with kind, primary_type and evidence: the first rule that holds, else the suffix of the first type's name."""
    code = blanked(text)
    name = F.nullif(F.regexp_extract(code, _TYPE, 2), F.lit(""))
    out = files.withColumns({"__code": code, "primary_type": name})
    p = F.lower(F.translate(path, "\\", "/"))
    rules = [("Test", is_test_path(path))] + [("Ddr", p.rlike(r"ddrs?/.*\.md$")), ("MarkDown", p.endswith(".md"))]
    rules += [(kind, F.col("__code").rlike(pattern)) for kind, pattern, _ in KINDS]
    named = [(kind, F.coalesce(F.col("primary_type").rlike(suffix), F.lit(False))) for kind, _, suffix in KINDS]
    kind = F.lit("Other")
    for k, test in reversed(rules + named):
        kind = F.when(test, k).otherwise(kind)
    evidence = F.array_compact(F.array(*[F.when(t, F.lit(f"rule:{k}")) for k, t in rules], *[F.when(t, F.lit(f"name:{k}")) for k, t in named]))
    return out.withColumns({"kind": kind, "evidence": evidence}).drop("__code")


def symbols(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One row per declared type, nested ones too: path, position, symbol_kind, symbol."""
    code = blanked(text)
    kinds, names = F.regexp_extract_all(code, F.lit(_TYPE), F.lit(1)), F.regexp_extract_all(code, F.lit(_TYPE), F.lit(2))
    return files.select(path, F.posexplode(F.arrays_zip(kinds.alias("k"), names.alias("n"))).alias("position", "z")).select(
        path, "position", F.col("z.k").alias("symbol_kind"), F.col("z.n").alias("symbol")
    )


def methods(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One row per method with modifiers: path, position, modifiers, returns, method, parameters."""
    code = blanked(text)
    part = lambda g: F.regexp_extract_all(code, F.lit(_METHOD), F.lit(g))
    z = F.arrays_zip(part(1).alias("m"), part(2).alias("r"), part(3).alias("n"), part(4).alias("p"))
    out = files.select(path, F.posexplode(z).alias("position", "z"))
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return out.select(path, "position", flat("z.m").alias("modifiers"), flat("z.r").alias("returns"), F.col("z.n").alias("method"), flat("z.p").alias("parameters"))


def resource_usages(files: DataFrame, containers: list[str], path: str = "path", text: str = "text") -> DataFrame:
    """path, container, key, usage (attribute or member), is_test; a member use is left out where an attribute names the key.

    Attribute uses are Container.Names.Key inside square brackets; member uses are Container.Key or Container.Names.Key.
    """
    any_ = "|".join(containers)
    ref = rf"\b({any_})\.(?:Names\.)?([A-Za-z_]\w*)"
    inside = F.flatten(F.transform(F.regexp_extract_all(F.col(text), F.lit(r"(?m)^\s*(\[[^\]\n]*\])"), F.lit(1)), lambda a: F.regexp_extract_all(a, F.lit(rf"({ref})"), F.lit(1))))
    everywhere = F.regexp_extract_all(F.col(text), F.lit(rf"({ref})"), F.lit(1))
    def rows(uses: Column, kind: str) -> DataFrame:
        out = files.select(path, F.explode(F.array_distinct(uses)).alias("u"))
        return out.select(path, F.regexp_extract("u", ref, 1).alias("container"), F.regexp_extract("u", ref, 2).alias("key"), F.lit(kind).alias("usage")).where("key <> 'Names'").distinct()
    attribute, member = rows(inside, "attribute"), rows(everywhere, "member")
    keys = [path, "container", "key"]
    return attribute.unionByName(member.join(attribute.select(*keys), keys, "left_anti")).withColumn("is_test", is_test_path(path))


def ddr_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with title (first heading), fields (map of `key: value` lines before the chapters) and summary."""
    head = F.split(text, r"(?m)^## ", 2)[0]
    line = r"(?m)^\**([A-Za-z][\w ]{0,30})\**:\**[ \t]*([^\n]+)$"
    keys, values = F.regexp_extract_all(head, F.lit(line), F.lit(1)), F.regexp_extract_all(head, F.lit(line), F.lit(2))
    entries = F.arrays_zip(F.transform(keys, lambda k: F.lower(F.trim(k))).alias("k"), F.transform(values, lambda v: F.trim(v)).alias("v"))
    first = F.filter(entries, lambda e: F.lit(True))
    pairs = F.aggregate(first, F.array().cast("array<struct<k:string,v:string>>"), lambda a, e: F.when(F.exists(a, lambda x: x["k"] == e["k"]), a).otherwise(F.concat(a, F.array(e))))
    return docs.withColumns({
        "title": F.trim(F.regexp_extract(text, r"(?m)^# +([^\n]*)", 1)), "fields": F.map_from_entries(pairs),
        "summary": F.trim(F.regexp_extract(text, r"(?m)^Summary:[ \t]*([^\n]*)", 1)),
    })


def ddr_chapters(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per `## n - title` chapter: key, chapter, title, body."""
    parts = F.filter(F.split(text, r"(?m)(?=^## +[0-9]+ *[-–])", -1), lambda p: p.rlike(r"^## +[0-9]+"))
    out = docs.select(key, F.explode(parts).alias("__p"))
    head = r"^## +([0-9]+) *[-–] *([^\n]*)"
    return out.select(
        key, F.regexp_extract("__p", head, 1).cast("int").alias("chapter"), F.trim(F.regexp_extract("__p", head, 2)).alias("title"),
        F.trim(F.regexp_replace("__p", r"^## [^\n]*\n?", "")).alias("body"),
    )


def validate_patches(changes: DataFrame) -> DataFrame:
    """changes (path, original_sha256, operation, start_line, end_line, after_line, n_new, n_match) with an array of errors."""
    op = F.lower("operation")
    tests = [
        ("missing path", F.coalesce(F.trim("path") == "", F.lit(True))),
        ("bad hash", ~F.coalesce(F.col("original_sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False))),
        ("unknown operation", ~op.isin("insert", "replace", "delete")),
        ("insert needs after_line", (op == "insert") & F.coalesce(F.col("after_line") < 0, F.lit(True))),
        ("insert needs new lines", (op == "insert") & (F.coalesce("n_new", F.lit(0)) == 0)),
        ("range is wrong", op.isin("replace", "delete") & F.coalesce((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), F.lit(True))),
        ("match lines differ from range", op.isin("replace", "delete") & F.coalesce(F.col("n_match") != F.col("end_line") - F.col("start_line") + 1, F.lit(True))),
    ]
    return changes.withColumn("errors", F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(m)) for m, t in tests])))
