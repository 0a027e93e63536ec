"""Sections of described source as texts and as points of a vector store: templates, titles, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, semantic_id, trim_white

_ID = ("org", "project", "repo", "symbol_type", "symbol", "section_key")


def points(sections: DataFrame) -> DataFrame:
    """sections (org, project, repo, symbol_type, symbol, section_key, part, total, text, snippet, blob_uri) with title,
    semantic_id, blob_place and content, the snippet or else the text.  An empty part of an identity is an error."""
    part = F.col("part").cast("string")
    title = F.format_string("%s: %s - %s (Chunk %d of %d)", "symbol_type", "symbol", "section_key", "part", "total")
    place = F.concat(F.lower("blob_uri"), F.lit("."), F.lower(F.concat_ws("/", "symbol", "section_key")), F.lit("."), part)
    return sections.withColumns({
        "title": title, "semantic_id": F.lower(semantic_id(*_ID, part)), "blob_place": F.replace(place, F.lit(" "), F.lit("_")),
        "content": F.when(is_blank("snippet"), F.col("text")).otherwise(F.col("snippet")),
    })


def with_unique(df: DataFrame, key: str = "blob_place") -> DataFrame:
    """df; a key that occurs twice is an error when the rows are read.  Counts are partly taken before the shuffle."""
    n = df.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n"))
    once = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("not unique: "), F.col(key)))).otherwise(F.col(key))
    return df.join(n, F.col(key).eqNullSafe(F.col("__k"))).withColumn(key, once).drop("__k", "__n")


def resource_text(key: Column | str, value: Column | str, comment: Column | str, culture: Column | str, path: Column | str) -> Column:
    """The text of a resource entry that is embedded."""
    labels = [("Key", key), ("Value", value), ("Comment", comment), ("Culture", culture), ("Source", path)]
    lines = [F.concat(F.lit(f"{n}: "), F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) for n, c in labels]
    return F.concat(F.lit("RESX Resource Entry\n\n"), F.concat_ws("\n", *lines))


def is_significant(modifiers: Column | str, n_statements: Column | str) -> Column:
    """A method that is public, protected or internal, or has more than one statement."""
    m = F.col(modifiers) if isinstance(modifiers, str) else modifiers
    return m.rlike(r"\b(?:public|protected|internal)\b") | ((F.col(n_statements) if isinstance(n_statements, str) else n_statements) > 1)


def ui_pattern(wrapper: Column, route: Column, action: Column, is_collection: Column, model: Column) -> Column:
    """How an endpoint is used: FormFactory, FormLoad, Detail, List, Command, or null."""
    w, r = F.coalesce(wrapper, F.lit("")), F.lower(F.coalesce(route, F.lit("")))
    detail = F.contains(w, F.lit("DetailResponse"))
    factory = r.endswith("/factory") | F.lower(F.coalesce(action, F.lit(""))).endswith("factory")
    return (
        F.when(detail & factory, "FormFactory").when(detail & F.contains(r, F.lit("{id}")), "FormLoad").when(detail, "Detail")
        .when(F.contains(w, F.lit("ListResponse")) | F.coalesce(is_collection, F.lit(False)), "List")
        .when(F.contains(w, F.lit("InvokeResult")) & model.isNull(), "Command")
    )


def endpoint_entity(model: Column, route: Column, controller: Column) -> Column:
    """What an endpoint is about: the model it returns, else the last part of its route unless that is an id, else its controller."""
    last = F.element_at(F.filter(F.split(route, "/"), lambda x: x != ""), -1)
    last = F.regexp_replace(last, r"^[{}]+|[{}]+$", "")
    named = F.when(~is_blank(last) & (F.lower(last) != "id"), last)
    return F.coalesce(F.when(~is_blank(model), model), named, F.when(controller.endswith("Controller"), F.regexp_replace(controller, "Controller$", "")))


def class_entity(name: Column, added: Column, voted: Column, suffix: str = "Manager") -> Column:
    """What a class is about: its name without the suffix, else the first type that it adds or creates, else the most frequent one."""
    stem = F.when(name.endswith(suffix), F.regexp_replace(name, f"{suffix}$", ""))
    return F.coalesce(F.when(~is_blank(stem), stem), added, voted)


def cardinality(type_name: Column) -> Column:
    """OneToMany for a collection of references, else OneToOne."""
    return F.when(type_name.rlike(r"^(?:\w+\.)*(?:I?(?:List|Enumerable|Collection|ReadOnlyList)|ObservableCollection|HashSet)<|\[\]$"), "OneToMany").otherwise("OneToOne")


def method_summary(
    name: Column, sub_kind: Column | None = None, model: Column | None = None, domain: Column | None = None, signature: Column | None = None,
    domain_tagline: Column | None = None, model_tagline: Column | None = None,
) -> Column:
    """A sentence on a method: what it is called and is, on which model and in which domain it works, then taglines and signature."""
    has = lambda before, c, after="": F.when(~is_blank(c), F.concat(F.lit(before), c, F.lit(after))) if c is not None else F.lit(None).cast("string")
    core = F.concat_ws(" ", has("Method ", name), has("(", sub_kind, ")"), has("operates on the ", model, " model"), has("in the ", domain, " domain"))
    extras = F.concat_ws(". ", has("Domain focus: ", domain_tagline), has("Model focus: ", model_tagline), has("Signature: ", signature))
    text = trim_white(F.concat_ws(". ", F.nullif(core, F.lit("")), F.nullif(extras, F.lit(""))))
    return F.when(text == "", "Method summary placeholder.").when(text.endswith("."), text).otherwise(F.concat(text, F.lit(".")))


def finder_snippet(kind: Column, name: Column, domain: Column, summary: Column) -> Column:
    """Kind, name, domain and summary on a line each; blank ones are left out."""
    lines = [("Kind", kind), ("Artifact", name), ("Domain", domain), ("Summary", summary)]
    return F.concat_ws("\n", *[F.when(~is_blank(c), F.concat(F.lit(f"{label}: "), trim_white(c))) for label, c in lines])
