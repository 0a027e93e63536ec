"""Models and domains declared in source: their structure, a catalogue of them, and metadata that lists what is wrong.

Rows of operators/members.with_types go in.  A model is a class with an EntityDescription attribute of four arguments or more:
domain, title, description, help; texts are resources, looked up by join.  A domain is a public static property with a
DomainDescription attribute in a class with a DomainDescriptor one.

Defined cases: of equal resource keys the least value in code-point order counts, in `metadata` that of the first set that has
one that is not blank; a resource that is missing is its key (`structures`) or an error (`metadata`), so no model is lost; of
several attributes of one name the first counts; a null text is nowhere found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..storage import materialize
from .describe import argument, bare, members_of, named, one
from .members import with_types

#: Fields that hold other objects (fixed values).
CHILD_FIELDS = ("ChildView", "ChildItem", "ChildList", "ChildListInline", "ChildListInlinePicker")
#: What a model says of itself by named arguments (fixed values).
FLAGS = ("Cloneable", "CanImport", "CanExport")
LINKS = ("ListUIUrl", "EditUIUrl", "CreateUIUrl", "HelpUrl", "InsertUrl", "SaveUrl", "UpdateUrl", "FactoryUrl", "GetUrl", "GetListUrl", "DeleteUrl")
_VALUES = ("bool", "byte", "sbyte", "short", "ushort", "int", "uint", "long", "ulong", "float", "double", "decimal", "Guid", "DateTime", "TimeSpan")


def last_name(arg: Column) -> Column:
    """A literal's string, the last part of a dotted name, or the expression as it is written."""
    return F.coalesce(arg["value"], F.when(arg["text"].rlike(r"^[\w.]+$"), F.substring_index(arg["text"], ".", -1)), F.trim(arg["text"]))


def resource_key(arg: Column) -> Column:
    """As last_name, but of an expression with .Names. all that follows it."""
    return F.coalesce(arg["value"], F.nullif(F.regexp_extract(arg["text"], r"\.Names\.(.+)$", 1), F.lit("")), last_name(arg))


def _camel(name: Column) -> Column:
    return F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))


def _looked_up(rows: DataFrame, resources: DataFrame, columns: list[str]) -> DataFrame:
    """rows with the values of resource keys; a key without one stays.  One aggregate of the resources serves all columns."""
    one_each = resources.groupBy(F.col("key").alias("__key")).agg(F.min("value").alias("__value"))
    for c in columns:
        rows = rows.join(one_each, F.col(c) == F.col("__key"), "left").withColumn(c, F.trim(F.coalesce("__value", c))).drop("__key", "__value")
    return rows


def _entity(types: DataFrame) -> DataFrame:
    own = named(F.col("attributes"), "EntityDescription")
    return types.where((F.col("kind") == "class") & (F.size(own) > 0)).withColumns({"entity": one(own), "n_entity": F.size(own)})


def structures(types: DataFrame, resources: DataFrame | None = None, base_properties: tuple[str, ...] = ("Name", "Key"), path: str = "path") -> DataFrame:
    """One row per model with its texts, links, fields, references to other entities, children and relationships.

    Classes on EntityBase have `base_properties` too, in the group of that name, unless they have properties of these names
    (ignoring case): the base's own source need not be among the files.
    """
    rows = _entity(types).where(F.size("entity.args") >= 4)
    arg = lambda i: F.get("entity.args", F.lit(i))
    enums = F.transform(F.filter("siblings", lambda s: s["kind"] == "enum"), lambda s: s["name"])

    def field(m: Column) -> Column:
        form = one(named(m["attributes"], "FormField"))
        generic = r"^(?:List|IList|ICollection|IEnumerable)<\s*([^,]+?)\s*>$"
        array = r"^(.*?)\[[,\s]*\]$"
        inner = F.coalesce(F.nullif(F.regexp_extract(m["type"], array, 1), F.lit("")), F.nullif(F.regexp_extract(m["type"], generic, 1), F.lit("")))
        clr, kind = F.coalesce(inner, m["type"]), last_name(argument(form, "FieldType"))
        target = F.nullif(F.trim(F.regexp_extract(clr, r"EntityHeader<([^>]+)>", 1)), F.lit(""))
        refers = F.contains(clr, F.lit("EntityHeader<")) | clr.endswith("EntityHeader")
        return F.struct(
            m["name"].alias("name"), clr.alias("clr_type"), inner.isNotNull().alias("is_collection"), bare(clr).isin(*_VALUES).alias("is_value_type"),
            F.array_contains(enums, bare(clr)).alias("is_enum"),
            (F.lower(m["name"]).endswith("id") | (F.lower(m["name"]) == "key") | F.coalesce(F.lower(kind) == "key", F.lit(False))).alias("is_key"),
            kind.alias("field_type"), F.lit(None).cast("string").alias("group"), refers.alias("refers"), F.when(refers, F.coalesce(target, F.lit("EntityHeader"))).alias("target"),
            F.coalesce(kind.isin(*CHILD_FIELDS), F.lit(False)).alias("is_child"), resource_key(argument(form, "LabelResource")).alias("label_key"),
        )

    fields = F.transform(F.filter(members_of(types, "property"), lambda m: F.size(named(m["attributes"], "FormField")) > 0), field)
    rows = rows.select(
        path, "position", F.col("name").alias("model"), "namespace", F.concat_ws(".", "namespace", "name").alias("qualified_name"), last_name(arg(0)).alias("domain"),
        resource_key(arg(1)).alias("title"), resource_key(arg(2)).alias("description"), resource_key(arg(3)).alias("help"),
        *[F.coalesce(argument(F.col("entity"), n)["text"] == "true", F.lit(False)).alias(f"flag_{n}") for n in FLAGS], *[argument(F.col("entity"), n)["value"].alias(f"link_{n}") for n in LINKS],
        fields.alias("fields"), F.exists("bases", lambda b: bare(b) == "EntityBase").alias("on_base"),
    )
    if resources is not None:
        rows = _looked_up(rows, resources, ["title", "description", "help"])
    own = F.transform("fields", lambda f: F.struct(
        *[f[c].alias(c) for c in ("name", "clr_type", "is_collection", "is_value_type", "is_enum", "is_key", "field_type")],
        F.when(f["refers"], _camel(f["name"])).alias("header_key"), F.when(f["is_child"], _camel(f["name"])).alias("child_key"), f["group"].alias("group")))
    base = F.array(*[F.struct(
        F.lit(n).alias("name"), F.lit("System.String").alias("clr_type"), F.lit(False).alias("is_collection"), F.lit(True).alias("is_value_type"), F.lit(False).alias("is_enum"),
        F.lit(n.lower() == "key" or n.lower().endswith("id")).alias("is_key"), F.lit(None).cast("string").alias("field_type"), F.lit(None).cast("string").alias("header_key"),
        F.lit(None).cast("string").alias("child_key"), F.lit("EntityBase").alias("group")) for n in base_properties])
    missing = F.filter(base, lambda b: ~F.exists("fields", lambda f: F.lower(f["name"]) == F.lower(b["name"]))) if base_properties else F.slice(own, 1, 0)
    refs = F.filter("fields", lambda f: f["refers"])
    many = lambda f: F.when(f["is_collection"], "OneToMany").otherwise("OneToOne")
    return rows.select(
        path, "position", "model", "namespace", "qualified_name", "domain", "title", "description", "help",
        F.struct(*[F.col(f"flag_{n}").alias(n) for n in FLAGS]).alias("flags"), F.struct(*[F.col(f"link_{n}").alias(n) for n in LINKS]).alias("links"),
        F.when(F.col("on_base"), F.concat(own, missing)).otherwise(own).alias("properties"),
        F.transform(refs, lambda f: F.struct(_camel(f["name"]).alias("key"), f["name"].alias("property"), F.when(F.contains(f["clr_type"], F.lit("<")), f["target"]).alias("target"), f["is_collection"].alias("is_collection"))).alias("header_refs"),
        F.transform(F.filter("fields", lambda f: f["is_child"]), lambda f: F.struct(_camel(f["name"]).alias("key"), f["name"].alias("property"), f["clr_type"].alias("clr_type"), f["is_collection"].alias("is_collection"))).alias("children"),
        F.transform(refs, lambda f: F.struct(F.concat("model", F.lit("To"), bare(f["target"])).alias("name"), F.col("qualified_name").alias("from_model"), f["target"].alias("to_model"), many(f).alias("cardinality"), f["name"].alias("property"))).alias("relationships"),
    )


def domains(types: DataFrame, path: str = "path") -> DataFrame:
    """One row per described domain: key, the name of the constant it comes from, title, description, type and place."""
    known = F.filter("members", lambda m: (m["kind"] == "field") & F.array_contains(m["modifiers"], "const") & (m["type"] == "string") & m["value"].isNotNull())
    rows = types.where((F.col("kind") == "class") & (F.size(named(F.col("attributes"), "DomainDescriptor")) > 0)).select(
        path, "position", F.concat_ws(".", "namespace", "name").alias("source_type"), known.alias("known"), F.posexplode(members_of(types, "property")).alias("place", "m")
    )
    both = F.array_contains("m.modifiers", "public") & F.array_contains("m.modifiers", "static") & F.col("m.type").endswith("DomainDescription")
    rows = rows.withColumn("a", one(named(F.col("m.attributes"), "DomainDescription"))).where(both & F.col("a").isNotNull())
    first = F.get("a.args", F.lit(0))
    constant = F.when(first["text"].rlike(r"^[A-Za-z_]\w*$"), first["text"])
    rows = rows.withColumns({
        "key": F.coalesce(first["value"], F.try_element_at(F.filter("known", lambda k: k["name"] == constant), F.lit(-1))["value"]), "key_name": constant,
        "said": F.try_element_at(F.filter("m.given", lambda x: F.lower(x["name"]) == "name"), F.lit(-1))["value"],
        "description": F.coalesce(F.try_element_at(F.filter("m.given", lambda x: F.lower(x["name"]) == "description"), F.lit(-1))["value"], F.lit("")),
        "domain_type": F.coalesce(F.nullif(F.substring_index(F.try_element_at(F.filter("m.given", lambda x: F.lower(x["name"]) == "domaintype"), F.lit(-1))["text"], ".", -1), F.lit("")), F.lit("BusinessObject")),
    })
    filled = lambda c: F.when(~is_blank(c), F.col(c))
    title = F.coalesce(filled("said"), filled("key"), F.col("m.name"))
    return rows.select(
        path, "position", "place", F.coalesce(filled("key"), title).alias("domain_key"), F.col("key_name").alias("domain_key_name"), title.alias("title"), "description", "domain_type",
        "source_type", F.col("m.name").alias("source_property"),
    )


def catalogue(types: DataFrame, resources: DataFrame | None = None, path: str = "path") -> DataFrame:
    """entry (domain, domain_name or model), key, name, title, path and place of what a scan of all files in order of path ends with.

    Of domains with one key, and with one constant's name, the first counts; of models with one qualified name the last; keys
    compare ignoring case.  All kinds are merged in one aggregate, which takes the first and the last by (path, position, place).
    """
    found, own = domains(types, path), structures(types, resources, path=path)
    common = lambda kind, key, name: [F.lit(kind).alias("entry"), F.col(key).alias("key"), F.col(name).alias("name"), "title", F.col(path).alias("path"), "position"]
    rows = found.select(*common("domain", "domain_key", "source_property"), "place")
    rows = rows.unionByName(found.where(~is_blank("domain_key_name")).select(*common("domain_name", "domain_key_name", "source_property"), "place"))
    rows = rows.unionByName(own.select(*common("model", "qualified_name", "model"), F.lit(0).alias("place")))
    at, held = F.struct("path", "position", "place"), F.struct("key", "name", "title", "path", "position", "place")
    merged = rows.groupBy("entry", F.lower("key").alias("__key")).agg(F.min_by(held, at).alias("first"), F.max_by(held, at).alias("last"), F.count("*").alias("n"))
    return merged.select("entry", F.when(F.col("entry") == "model", F.col("last")).otherwise(F.col("first")).alias("x"), "n").select("entry", "x.*", "n")


def model_files(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """The files that may declare models: C# sources outside tests/ whose text has the attribute.  The scan takes the filter."""
    at = F.lower(F.translate(path, "\\", "/"))
    return files.where(F.contains(F.col(text), F.lit("[EntityDescription")) & at.endswith(".cs") & ~F.startswith(at, F.lit("tests/")) & (at != "tests"))


def model_entries(files: DataFrame, resources: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """The models of files of which nothing is missing: domain, class, qualified name, title, description and help."""
    rows = structures(with_types(model_files(files, path, text), path, text), resources, path=path)
    needed = ("domain", "model", "qualified_name", "title", "description", "help")
    return rows.where(~F.array_contains(F.array(*[is_blank(c) for c in needed]), True)).select(F.translate(path, "\\", "/").alias("path"), "position", *needed)


def metadata(types: DataFrame, resources: DataFrame, path: str = "path") -> DataFrame:
    """One row per class with the attribute: path, position, class_name, keys and texts, fields (property, label, help), and errors in order.

    resources: resource_set, key, value.  Nothing is dropped: what is wrong with a model is listed in its row.
    """
    rows = _entity(types)
    arg = lambda i: F.when(F.size("entity.args") >= 4, last_name(F.get("entity.args", F.lit(i))))

    def field(m: Column) -> Column:
        form = one(named(m["attributes"], "FormField"))
        of = lambda n: one(F.filter(form["args"], lambda x: F.lower(x["name"]) == n))
        return F.struct(m["name"].alias("property"), of("labelresource").isNotNull().alias("has_label"), last_name(of("labelresource")).alias("label_key"), last_name(of("helpresource")).alias("help_key"))

    fields = F.transform(F.filter(members_of(types, "property"), lambda m: F.size(named(m["attributes"], "FormField")) > 0), field)
    rows = rows.select(
        path, "position", F.col("name").alias("class_name"), "n_entity", F.size("entity.args").alias("n_args"), arg(0).alias("domain_key"), arg(1).alias("title_key"), arg(2).alias("description_key"),
        arg(3).alias("help_key"), fields.alias("fields"), F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows, "model_rows")  # row numbers stay; the rows go two ways
    asked = F.concat(F.array("title_key", "description_key", "help_key"), F.transform("fields", lambda f: f["label_key"]), F.transform("fields", lambda f: f["help_key"]))
    asked = rows.select("row", F.explode(F.array_distinct(F.filter(asked, lambda k: ~is_blank(k)))).alias("key"))
    known = materialize(resources.where(~is_blank("value")).groupBy("key").agg(F.min_by("value", "resource_set").alias("value")), "resources")
    texts = asked.join(known, "key").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("texts"))
    rows = rows.join(texts, "row", "left").withColumn("texts", F.coalesce("texts", F.create_map().cast("map<string,string>")))
    text = lambda key: F.try_element_at("texts", key)
    when = lambda test, *parts: F.when(test, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    whole = F.col("n_args") >= 4

    def label_error(f: Column) -> Column:
        on = (F.lit("FormField on property '"), f["property"], F.lit("' "))
        return F.coalesce(
            when(~f["has_label"], *on, "is missing a LabelResource argument."), when(is_blank(f["label_key"]), *on, "has a LabelResource expression that could not be parsed."),
            when(text(f["label_key"]).isNull(), *on, "has LabelResource '", f["label_key"], "' that could not be resolved."),
        )

    unresolved = lambda what, key: when(~is_blank(key) & text(F.col(key)).isNull(), f"{what} resource '", F.col(key), "' could not be resolved.")
    general = F.array(
        F.when(F.col("n_entity") > 1, "Class has multiple [EntityDescription] attributes."),
        F.when(~whole, "[EntityDescription] must have at least 4 positional arguments (domain, title, description, help)."),
        F.when(whole & is_blank("title_key"), "Title resource key could not be extracted from [EntityDescription]."),
        F.when(whole & is_blank("description_key"), "Description resource key could not be extracted from [EntityDescription]."),
        unresolved("Title", "title_key"), unresolved("Description", "description_key"),
    )
    said = F.transform("fields", lambda f: F.struct(
        f["property"].alias("property"), F.coalesce(F.when(~is_blank(f["label_key"]), text(f["label_key"])), f["property"]).alias("label"), F.when(~is_blank(f["help_key"]), text(f["help_key"])).alias("help")))
    return rows.select(
        path, "position", "class_name", "domain_key", "title_key", "description_key", "help_key", text(F.col("title_key")).alias("title"), text(F.col("description_key")).alias("description"),
        text(F.col("help_key")).alias("help"), said.alias("fields"), F.array_compact(F.concat(general, F.transform("fields", label_error))).alias("errors"),
    )
