"""Sections of described classes and endpoints: texts under a token budget, several kinds for each type.

The methods of a type are folded inside their array: a section is full when the next method would not fit, and the next one
begins with the same header.  Nothing is exploded and grouped again; each type gives its sections where it lies.

`header` is a column of domain_name, domain_tagline, model_name, model_class, model_tagline (any of them null), or None.

Defined cases: a type without methods has a section that says so; a method that alone is above the budget has a section of its
own; methods stand in the order of their names by code point, equal names as in the file; blank values have no line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, is_blank, trim_white
from .points import method_summary

BUDGET = 6500
#: What an endpoint of a pattern is for (fixed values).
PATTERNS = {
    "FormFactory": "This endpoint returns a blank, initialized model instance for client-side form creation (form factory).",
    "FormLoad": "This endpoint loads an existing model instance for editing using an id route parameter.",
    "List": "This endpoint returns a list of models suitable for list or grid rendering, typically using paging.",
    "Command": "This endpoint executes a command and returns an InvokeResult indicating success or failure.",
    "Detail": "This endpoint returns a detailed model instance suitable for display or editing.",
}
_SECTION = "array<struct<section_key:string,section_type:string,part:int,total:int,text:string>>"
_HEADER = "struct<domain_name:string,domain_tagline:string,model_name:string,model_class:string,model_tagline:string>"


def _text(c: Column | str) -> Column:
    return F.lit(c) if isinstance(c, str) else c.cast("string")


def line(*parts: Column | str, only: Column | None = None) -> Column:
    """A line of the parts; none if `only` is blank or false, or if a part is null."""
    made = F.concat(*[_text(p) for p in parts], F.lit("\n"))
    return made if only is None else F.when(only, made)


def filled(label: str, value: Column) -> Column:
    return line(label, value, only=~is_blank(value))


def lines(*parts: Column) -> Column:
    """The lines that are there, as one text."""
    return F.array_join(F.array_compact(F.array(*parts)), "")


def said(c: Column) -> Column:
    return F.when(c, "True").otherwise("False")


def _spans(m: Column) -> Column:
    return F.concat_ws("-", m["first_line"], m["last_line"])


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it: expressions inside arrays share nothing by themselves."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def header_lines(header: Column | None) -> Column:
    """The lines on domain and model, and a blank one after them."""
    h = F.lit(None).cast(_HEADER) if header is None else header

    def titled(label: str, name: Column, tagline: Column) -> Column:
        has, more = ~is_blank(name), ~is_blank(tagline)
        return F.when(has & more, F.concat(F.lit(f"{label}: "), name, F.lit(" — "), tagline)).when(has, F.concat(F.lit(f"{label}: "), name)).when(more, tagline)

    model = F.when(~is_blank(h["model_name"]), h["model_name"]).otherwise(h["model_class"])
    both = F.array_compact(F.array(titled("Domain", h["domain_name"], h["domain_tagline"]), titled("Model", model, h["model_tagline"])))
    return F.when(F.size(both) > 0, F.concat(F.array_join(both, "\n"), F.lit("\n\n"))).otherwise("")


def folded(head: Column, blocks: Column, budget: int) -> Column:
    """Texts of head and as many blocks as the budget takes; at least one block each."""
    tokens = lambda t: estimate_tokens(t).cast("long")
    sized = F.transform(blocks, lambda b: let(b, lambda t: F.struct(t.alias("text"), tokens(t).alias("tokens"))))

    def fold(top: Column, each: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), top.alias("now"), tokens(top).alias("used"))

        def step(acc: Column, block: Column) -> Column:
            full = (acc["now"] != top) & (acc["used"] + block["tokens"] > budget)
            grown = let(full, lambda f: F.struct(F.when(f, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"), F.concat(F.when(f, top).otherwise(acc["now"]), block["text"]).alias("now")))
            return let(grown, lambda g: F.struct(g["done"].alias("done"), g["now"].alias("now"), tokens(g["now"]).alias("used")))

        return F.aggregate(each, start, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))

    return let(F.struct(head.alias("top"), sized.alias("each")), lambda x: fold(x["top"], x["each"]))


def _numbered(key: str, kind: str, texts: Column) -> Column:
    """Sections of one kind with their places."""
    row = lambda t, i, n: F.struct(F.lit(key).alias("section_key"), F.lit(kind).alias("section_type"), (i + 1).cast("int").alias("part"), n.alias("total"), trim_white(t).alias("text"))
    return let(texts, lambda ts: F.transform(ts, lambda t, i: row(t, i, F.size(ts)))).cast(_SECTION)


def _emitted(rows: DataFrame, path: str, symbol: str, kinds: list[tuple[str, str, Column]]) -> DataFrame:
    """A row per section: path, symbol, section_key, section_type, part, total, text, tokens."""
    # as rows of a generator, values that the sections name again and again are computed once
    rows = rows.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in rows.columns])).select(F.inline(F.array("__row")))
    made = rows.withColumn("__all", F.concat(*[_numbered(*k) for k in kinds])).select(path, F.col(symbol).alias("symbol"), F.inline("__all"))
    return made.withColumn("tokens", estimate_tokens("text").cast("int"))


def _methods(of: str, sub_kind: str, header: Column | None, budget: int, detail: bool) -> Column:
    """The sections of the methods of one type, in order of their names."""
    symbol = F.col("interface_name" if of == "interface" else "class_name")
    head = F.concat(header_lines(header), F.lit(f"Methods for {of} "), symbol, F.lit(":\n"))
    h = F.lit(None).cast(_HEADER) if header is None else header
    model = F.coalesce(*[F.when(~is_blank(c), c) for c in (h["model_class"], h["model_name"])], F.col("primary_entity"))

    def block(m: Column) -> Column:
        taken = let(F.array_join(F.transform(m["parameters"], lambda p: F.concat_ws(" ", p["type"], p["name"])), ", "), lambda t: F.when(t == "", "no parameters").otherwise(t))
        sentence = method_summary(m["name"], F.lit(sub_kind), model, h["domain_name"])
        parts = [F.lit("\n"), line("- ", sentence, *([] if detail else [F.when(m["is_async"], " (async)").otherwise("")]))]
        if detail:
            access = F.when(m["is_public"], "public").when(m["is_protected_or_internal"], "protected/internal").when(m["is_private"], "private").otherwise("unknown")
            parts.append(line("  Kind: ", m["kind"], ", ", access, ", ", F.when(m["is_significant"], "significant").otherwise("non-significant")))
        parts += [line("  Returns: ", F.coalesce(m["returns"], F.lit(""))), line("  Params: ", taken), line("  Lines: ", _spans(m))]
        if detail:
            parts.append(line("  XML Summary:\n  ", trim_white(m["summary"]), only=~is_blank(m["summary"])))
        return lines(*parts)

    ordered = F.transform(F.array_sort(F.transform("methods", lambda m, i: F.struct(m["name"].alias("name"), i.alias("i"), m.alias("m")))), lambda x: x["m"])
    return F.when(F.size("methods") == 0, F.array(F.concat(head, F.lit("No methods discovered.\n")))).otherwise(folded(head, F.transform(ordered, block), budget))


def manager_sections(rows: DataFrame, header: Column | None = None, budget: int = BUDGET, path: str = "path") -> DataFrame:
    """Overview, constructors and methods of what describe.managers gives."""
    overview = lines(
        header_lines(header), line("Manager: ", F.col("class_name")), filled("Namespace: ", F.col("namespace")), filled("Base Type: ", F.col("base_type")), F.lit("Manager Type: ManagerOverview\n"), filled("Primary Entity: ", F.col("primary_entity")),
        filled("Implements: ", F.array_join("interfaces", ", ")), filled("Depends On: ", F.array_join("dependencies", ", ")), line("\nSummary:\n", trim_white("summary"), only=~is_blank("summary")),
    )
    built = F.transform("constructors", lambda c: lines(
        F.lit("- (constructor)\n"), line("  Dependencies: ", F.array_join(F.transform(c["parameters"], lambda p: F.concat_ws(" ", p["type"], p["name"])), ", "), only=F.size(c["parameters"]) > 0), line("  Lines: ", _spans(c))))
    constructors = F.concat(header_lines(header), F.lit("Constructors for manager "), F.col("class_name"), F.lit(":\n"), F.when(F.size("constructors") == 0, F.lit("No constructors discovered.\n")).otherwise(F.array_join(built, "")))
    return _emitted(rows, path, "class_name", [
        ("manager-overview", "Overview", F.array(overview)), ("manager-constructors", "Constructors", F.array(constructors)),
        ("manager-methods", "Methods", _methods("manager", "ManagerMethod", header, budget, True)),
    ])


def repository_sections(rows: DataFrame, header: Column | None = None, budget: int = BUDGET, path: str = "path") -> DataFrame:
    """Overview and methods of what describe.repositories gives."""
    overview = lines(
        header_lines(header), line("Repository: ", F.col("class_name")), filled("Namespace: ", F.col("namespace")), filled("Base: ", F.col("base_type")), line("Kind: ", F.col("repository_kind")),
        filled("Primary Entity: ", F.col("primary_entity")), filled("Implements: ", F.array_join("interfaces", ", ")),
    )
    return _emitted(rows, path, "class_name", [("repository-overview", "Overview", F.array(overview)), ("repository-methods", "Methods", _methods("repository", "RepositoryMethod", header, budget, True))])


def interface_sections(rows: DataFrame, header: Column | None = None, budget: int = BUDGET, path: str = "path") -> DataFrame:
    """Overview and methods of what describe.interfaces gives."""
    overview = lines(
        header_lines(header), line("Interface: ", F.col("interface_name")), filled("Namespace: ", F.col("namespace")), filled("Full Name: ", F.col("full_name")),
        line("IsGeneric: ", said(F.col("is_generic")), ", GenericArity: ", F.col("generic_arity")), filled("Role: ", F.col("role")), filled("Primary Entity: ", F.col("primary_entity")),
        line("Lines: ", F.concat_ws("-", "first_line", "last_line")),
    )
    return _emitted(rows, path, "interface_name", [("interface-overview", "Overview", F.array(overview)), ("interface-methods", "Methods", _methods("interface", "InterfaceMethod", header, budget, False))])


def endpoint_sections(rows: DataFrame, header: Column | None = None, path: str = "path") -> DataFrame:
    """Overview and contracts of what describe.endpoints gives."""
    e, a = F.col("handler"), F.col("authorization")
    purpose = F.coalesce(*[F.when(F.col("ui_pattern") == k, v) for k, v in PATTERNS.items()], F.col("ui_pattern"))
    overview = lines(
        header_lines(header), line("Endpoint: ", F.col("endpoint_key")), filled("Controller: ", F.col("controller")), filled("Action: ", F.col("action")), filled("Route: ", F.col("route")),
        line("HTTP Methods: ", F.array_join("http_methods", ", "), only=F.size("http_methods") > 0), filled("API Version: ", F.col("api_version")), filled("Area: ", F.col("area")), filled("Primary Entity: ", F.col("primary_entity")),
        F.when(e.isNotNull(), lines(F.lit("\nHandler:\n"), filled("  Interface: ", e["interface"]), filled("  Method: ", e["method"]), filled("  Kind: ", e["kind"]))),
        lines(F.lit("\nAuthorization:\n"), line("  Requires Authentication: ", said(a["requires_authentication"])), line("  Allow Anonymous: ", said(a["allow_anonymous"])), filled("  Tenancy: ", a["tenancy"])),
        line("\nUI Pattern:\n  ", purpose, only=~is_blank("ui_pattern")), line("\nLines: ", F.concat_ws("-", "first_line", "last_line")),
        line("\nSummary:\n", trim_white("summary"), only=~is_blank("summary")), line("\nDescription:\n", trim_white("description"), only=~is_blank("description")),
    )
    b = F.col("request_body")
    parameters = F.transform("parameters", lambda p: lines(
        line("- ", p["name"], ": Source=", p["source"], ", Type=", p["type"], ", Required=", said(p["is_required"]), ", Collection=", said(p["is_collection"]), ", Default=",
             F.when(is_blank(p["default_value"]), "(none)").otherwise(p["default_value"])), line("  ", trim_white(p["description"]), only=~is_blank(p["description"]))))
    responses = F.transform("responses", lambda r: lines(
        F.lit("\n"), line("- ", r["status"], ": ", F.coalesce(r["description"], F.lit(""))), filled("  Model: ", r["model_type"]), line("  IsCollection: ", said(r["is_collection"])), line("  IsWrapped: ", said(r["is_wrapped"])),
        filled("  Wrapper: ", r["wrapper_type"]), F.lit("  ContentTypes: application/json\n"), line("  IsError: ", said(r["is_error"])), line("  ErrorShape: ", r["wrapper_type"], only=r["is_error"])))
    contracts = lines(
        header_lines(header), line("Request and response shape for endpoint ", F.col("endpoint_key"), ":"), F.lit("\nNon-body parameters:\n"),
        F.when(F.size("parameters") == 0, F.lit("  None.\n")).otherwise(F.array_join(parameters, "")), F.lit("\nRequest body:\n"),
        F.when(b.isNull(), F.lit("  None.\n")).otherwise(lines(
            filled("  Model: ", b["model_type"]), line("  IsCollection: ", said(b["is_collection"])), line("  IsPrimitive: ", said(b["is_primitive"])), F.lit("  ContentTypes: application/json\n"),
            line("  ", trim_white(b["description"]), only=~is_blank(b["description"])))),
        F.lit("\nResponses:\n"), F.array_join(responses, ""),
    )
    return _emitted(rows, path, "endpoint_key", [("endpoint-overview", "Overview", F.array(overview)), ("endpoint-request-response", "Contracts", F.array(contracts))])
