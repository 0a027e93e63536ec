"""Descriptions of controllers, managers, repositories and interfaces, and tables of routes, fields and models.

All of it is column expressions over the nested rows of operators/members.with_types: a row per type gives a row per type or
member, nothing moves between tasks but in the joins of constants and enumerations.

Types are named as a compiler names them, without name space and type arguments: `string` is String, `int?` Nullable, an array
has no name.  A first base is the base class unless it is named like an interface (I and a capital).  The marks at the starts of
a documentation comment's lines are not part of its text.

Defined cases: a type without members gives empty arrays; an attribute without arguments has no route; of several classes in a
file the first is described by `managers` and `repositories`, every controller by `endpoints`; a null text is nowhere matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import endpoint_key, is_blank, normalize_route
from ..storage import materialize
from . import points
from .members import needs

#: Keywords of built-in types and their names (fixed values).
BUILT_IN = {
    "bool": "Boolean", "byte": "Byte", "sbyte": "SByte", "short": "Int16", "ushort": "UInt16", "int": "Int32", "uint": "UInt32", "long": "Int64",
    "ulong": "UInt64", "float": "Single", "double": "Double", "decimal": "Decimal", "char": "Char", "string": "String", "object": "Object", "void": "Void",
}
#: Attributes and the methods they stand for, in the order in which they are tried (fixed values).
VERBS = {"HttpGet": "GET", "HttpPost": "POST", "HttpPut": "PUT", "HttpDelete": "DELETE", "HttpPatch": "PATCH"}
MORE_VERBS = VERBS | {"HttpHead": "HEAD", "HttpOptions": "OPTIONS"}
#: What an entity's attribute may name (fixed values).
URLS = "GetUrl GetListUrl FactoryUrl SaveUrl DeleteUrl PreviewUIUrl ListUIUrl EditUIUrl CreateUIUrl Icon ClusterKey".split()
#: What these read of types and members, for members.with_types: what else a file has need not be read.
ENDPOINTS = needs("position kind name bases attributes", "name type attributes parameters doc calls first_line last_line", "method field")
CLASSES = needs("first_of_kind siblings kind name namespace bases doc", "name type modifiers parameters doc statements body first_line last_line", "method constructor")
INTERFACES = needs("first_of_kind siblings kind name namespace arity bases first_line last_line", "name type parameters doc first_line last_line", "method")
ROUTES = needs("position kind name namespace bases attributes", "name type attributes parameters", "method")
ENTITY_URLS = needs("position kind name namespace bases attributes")
HEADER_FIELDS = needs("position kind name namespace", "name type attributes", "property")
_VALUE_TYPES = [k for k in BUILT_IN if k not in ("string", "object", "void")] + ["Guid", "DateTime", "DateTimeOffset", "TimeSpan"]


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def one(found: Column) -> Column:
    """The first of an array; null if there is none."""
    return F.try_element_at(found, F.lit(1))


def bare(type_: Column) -> Column:
    """A type's own name as it is written: without name space, type arguments and question mark."""
    return F.substring_index(F.regexp_extract(F.regexp_replace(type_, r"\?$", ""), r"^\s*(?:global::)?([^<\[]*)", 1), ".", -1)


def type_name(type_: Column) -> Column:
    """The name that a compiler gives a type; an empty one for arrays."""
    names = F.create_map(*[F.lit(x) for pair in BUILT_IN.items() for x in pair])
    name = bare(type_)
    may_be_null = type_.endswith("?") & name.isin(_VALUE_TYPES)
    return F.when(type_.rlike(r"\]\??$"), "").when(may_be_null, "Nullable").otherwise(F.coalesce(F.try_element_at(names, name), name))


def is_collection(type_: Column) -> Column:
    return type_.rlike(r"\]\??$") | type_.rlike(r"^(?:\w+(?:\.|::))*(?:List|IEnumerable|ICollection)<")


def is_primitive(type_: Column) -> Column:
    return ~type_.endswith("]") & type_name(type_).isin([v for v in BUILT_IN.values() if v != "Void"] + ["Guid", "DateTime"])


def named(attributes: Column, *names: str) -> Column:
    """The attributes of these names, written with or without a name space and the word Attribute."""
    return F.filter(attributes, lambda a: F.regexp_replace(F.substring_index(a["name"], ".", -1), "(?<=.)Attribute$", "").isin(*names))


def holding(attributes: Column, *parts: str) -> Column:
    """The attributes whose name holds one of the parts."""
    return F.filter(attributes, lambda a: a["name"].rlike("|".join(parts)))


def argument(attribute: Column, name: str) -> Column:
    """The argument of a name, as name, text and value."""
    return one(F.filter(attribute["args"], lambda x: x["name"] == name))


def value_or_text(arg: Column) -> Column:
    return F.coalesce(arg["value"], arg["text"])


def members_of(types: DataFrame, *kinds: str) -> Column:
    return F.filter("members", lambda m: m["kind"].isin(*kinds))


def is_interface_name(name: Column) -> Column:
    return F.substring_index(F.regexp_extract(name, "^[^<]*", 0), ".", -1).rlike("^I[A-Z]")


# -- endpoints


def returned(type_: Column) -> Column:
    """model, is_collection and wrapper of what a method returns; a task or an action result around it is taken off."""
    inner = F.coalesce(F.nullif(F.regexp_extract(type_, r"^(?:\w+\.)*(?:Task|ActionResult)<(.+)>$", 1), F.lit("")), type_)
    pattern = r"^(?:\w+\.)*(DetailResponse|ListResponse|InvokeResult)<(.+)>$"
    wrapper, held = F.regexp_extract(inner, pattern, 1), F.regexp_extract(inner, pattern, 2)
    wrapped = wrapper != ""
    return F.struct(
        F.when(wrapped, type_name(held)).otherwise(type_name(inner)).alias("model"),
        F.when(wrapped, (wrapper == "ListResponse") | is_collection(held)).otherwise(is_collection(inner)).alias("is_collection"),
        F.when(wrapped, inner).alias("wrapper"),
    )


def first_template(attributes: Column, *parts: str) -> Column:
    """The first argument of the first attribute of these that has one: its string, or else the expression as it is written."""
    return value_or_text(one(F.transform(F.filter(holding(attributes, *parts), lambda a: F.size(a["args"]) > 0), lambda a: a["args"][0])))


def joined_routes(of_class: Column, of_method: Column) -> Column:
    """Both templates with one slash between; one alone as it is."""
    a, b = F.nullif(of_class, F.lit("")), F.nullif(of_method, F.lit(""))
    return F.when(b.isNull(), a).when(a.isNull(), b).otherwise(F.concat(F.regexp_replace(a, "/+$", ""), F.lit("/"), F.regexp_replace(b, "^/+", "")))


def _parameter(p: Column, route: Column, verbs: Column, params: Column) -> Column:
    own = p["attributes"]
    by = one(F.filter(F.transform(own, lambda a: F.regexp_extract(a["name"], "From(Route|Query|Header)", 1)), lambda x: x != ""))
    source = F.coalesce(
        by, F.when(F.contains(text_of(route), F.concat(F.lit("{"), p["name"], F.lit("}"))), "Route"),
        F.when(F.arrays_overlap(verbs, F.array(F.lit("GET"), F.lit("DELETE"))), "Query"), F.lit("Unknown"),
    )
    optional = p["type"].endswith("?") | p["value"].isNotNull()
    return F.struct(
        p["name"].alias("name"), source.alias("source"), type_name(p["type"]).alias("type"), is_collection(p["type"]).alias("is_collection"),
        (F.size(holding(own, "Required")).cast("boolean") | ~optional).alias("is_required"), p["value"].alias("default_value"),
        one(F.filter(params, lambda x: x["name"] == p["name"]))["text"].alias("description"), is_primitive(p["type"]).alias("is_primitive"),
    )


def endpoints(types: DataFrame, path: str = "path") -> DataFrame:
    """One row per action of a controller with what it answers to, takes, returns and calls."""
    controller = F.exists("bases", lambda b: F.contains(b, F.lit("Controller"))) | F.col("name").endswith("Controller")
    fields = F.filter(members_of(types, "field"), lambda f: type_name(f["type"]).endswith("Manager"))
    own = types.where((F.col("kind") == "class") & controller)
    own = own.withColumn("managers", F.transform(fields, lambda f: F.struct(f["name"].alias("name"), type_name(f["type"]).alias("type")))).select(
        path, "position", F.col("name").alias("controller"), F.col("attributes").alias("of_class"), "managers", F.posexplode(members_of(types, "method")).alias("place", "m"),
    )
    verb = lambda a: F.coalesce(*[F.when(F.contains(a["name"], F.lit(k)), v) for k, v in VERBS.items()])
    providers = ("Route", *VERBS)
    own = own.withColumns({
        "http_methods": F.filter(F.transform("m.attributes", verb), lambda v: v.isNotNull()),
        "route": joined_routes(first_template(F.col("of_class"), *providers), first_template(F.col("m.attributes"), *providers)),
        "returned": returned(F.col("m.type")),
    }).where(F.size("http_methods") > 0)
    entity = points.endpoint_entity(F.col("returned.model"), F.col("route"), F.col("controller"))
    skipped = lambda p: (F.size(holding(p["attributes"], "FromServices")) > 0) | type_name(p["type"]).rlike("ILogger|HttpContext")
    taken = F.transform(F.filter("m.parameters", lambda p: ~skipped(p)), lambda p: _parameter(p, F.col("route"), F.col("http_methods"), F.coalesce("m.doc.params", F.array().cast("array<struct<name:string,text:string>>"))))
    own = own.withColumns({"primary_entity": entity, "taken": taken})
    writes = F.arrays_overlap("http_methods", F.array(*map(F.lit, ("POST", "PUT", "PATCH"))))
    may_be_body = lambda p: (p["source"] == "Unknown") & writes & ~p["is_primitive"]
    at = one(F.filter(F.transform("taken", lambda p, i: F.when(may_be_body(p), i)), lambda i: i.isNotNull()))
    own = own.withColumn("body_at", at)
    manager = one(F.filter("managers", lambda f: F.exists("m.calls", lambda c: c["target"] == f["name"])))
    all_attributes = F.concat("of_class", "m.attributes")
    anonymous = F.size(holding(F.col("m.attributes"), "AllowAnonymous")) > 0
    body = F.try_element_at("taken", F.col("body_at") + 1)
    created, nothing = F.array_contains("http_methods", "POST"), F.lit(None).cast("string")
    return own.select(
        path, "position", "place", "controller", F.col("m.name").alias("action"), endpoint_key("controller", F.col("m.name")).alias("endpoint_key"),
        "route", "http_methods", first_text(F.col("of_class"), "ApiVersion").alias("api_version"), first_text(F.col("of_class"), "Area").alias("area"), "primary_entity",
        F.coalesce("m.doc.summary", F.concat(F.get("http_methods", F.lit(0)), F.lit(" "), F.when(is_blank("primary_entity"), F.col("m.name")).otherwise(F.col("primary_entity")))).alias("summary"),
        F.col("m.doc.remarks").alias("description"),
        F.when(manager.isNotNull(), F.struct(manager["type"].alias("interface"), one(F.filter("m.calls", lambda c: c["target"] == manager["name"]))["name"].alias("method"), F.lit("Manager").alias("kind"))).alias("handler"),
        F.transform(F.filter(F.transform("taken", lambda p, i: F.when(F.col("body_at").isNull() | (i != F.col("body_at")), p)), lambda p: p.isNotNull()), lambda p: p.dropFields("is_primitive")).alias("parameters"),
        F.when(body.isNotNull(), F.struct(body["type"].alias("model_type"), body["is_collection"].alias("is_collection"), body["is_primitive"].alias("is_primitive"), body["description"].alias("description"))).alias("request_body"),
        F.array(
            F.struct(F.when(created, 201).otherwise(200).alias("status"), nothing.alias("description"), F.col("returned.model").alias("model_type"), F.col("returned.is_collection").alias("is_collection"),
                     F.col("returned.wrapper").isNotNull().alias("is_wrapped"), F.col("returned.wrapper").alias("wrapper_type"), F.lit(False).alias("is_error")),
            F.struct(F.lit(400).alias("status"), F.lit("Validation or input error.").alias("description"), nothing.alias("model_type"), F.lit(False).alias("is_collection"),
                     F.lit(True).alias("is_wrapped"), F.lit("InvokeResult").alias("wrapper_type"), F.lit(True).alias("is_error")),
        ).alias("responses"),
        points.ui_pattern(F.col("returned.wrapper"), F.col("route"), F.col("m.name"), F.col("returned.is_collection"), F.col("returned.model")).alias("ui_pattern"),
        F.struct(((F.size(holding(all_attributes, "Authorize", "ConfirmedUser", "AppBuilder")) > 0) & ~anonymous).alias("requires_authentication"), anonymous.alias("allow_anonymous"),
                 F.when(anonymous, "Public").otherwise("OrgScoped").alias("tenancy")).alias("authorization"),
        F.col("m.first_line").alias("first_line"), F.col("m.last_line").alias("last_line"),
    )


def first_text(attributes: Column, part: str) -> Column:
    """The first argument of the first attribute whose name holds `part`, as it is written but without quotes around it."""
    arg = F.get(one(holding(attributes, part))["args"], F.lit(0))
    shown = F.when(arg["name"].isNotNull(), F.concat(arg["name"], F.lit(" = "), arg["text"])).otherwise(arg["text"])
    return F.regexp_replace(shown, '^"+|"+$', "")


# -- classes and interfaces


def _described(m: Column, kind: Column) -> Column:
    has = lambda *w: F.arrays_overlap(m["modifiers"], F.array(*map(F.lit, w)))
    return F.struct(
        m["name"].alias("name"), m["doc"]["summary"].alias("summary"), m["type"].alias("returns"),
        F.transform(m["parameters"], lambda p: F.struct(p["name"].alias("name"), type_name(p["type"]).alias("type"))).alias("parameters"),
        has("public").alias("is_public"), has("protected", "internal").alias("is_protected_or_internal"), has("private").alias("is_private"),
        (has("public", "protected", "internal") | (m["statements"] > 1)).alias("is_significant"), kind.alias("kind"),
        m["first_line"].alias("first_line"), m["last_line"].alias("last_line"), m["body"].alias("body"),
    )


def _most_frequent(names: Column) -> Column:
    """The value that an array has most often, the first of equals."""
    ranked = F.transform(F.array_distinct(names), lambda n, i: F.struct((-F.size(F.filter(names, lambda x: x == n))).alias("a"), i.alias("i"), n.alias("n")))
    return F.array_min(ranked)["n"]


def _signatures(methods: Column) -> Column:
    """The names of all returned and taken types, in order."""
    each = F.flatten(F.transform(methods, lambda m: F.concat(F.array(type_name(m["type"])), F.transform(m["parameters"], lambda p: type_name(p["type"])))))
    return F.filter(each, lambda n: ~is_blank(n))


def _starts(name: Column, *words: str) -> Column:
    return name.rlike(f"(?i)^(?:{'|'.join(words)})")


def manager_method_kind(n: Column) -> Column:
    return (
        F.when(_starts(n, "Add", "Create"), "Create").when(_starts(n, "Update", "Upsert"), "Update").when(_starts(n, "Delete", "Remove"), "Delete")
        .when(n.rlike("(?i)^Validate|Validation"), "Validation").when(_starts(n, "Get", "List", "Query"), "Query").otherwise("Other")
    )


def repository_method_kind(n: Column) -> Column:
    return (
        F.when(_starts(n, "Query", "List"), "Query").when(_starts(n, "Get") & n.rlike("(?i)Summaries|List|ForOrg"), "Query").when(_starts(n, "Get"), "GetById")
        .when(_starts(n, "Add", "Insert", "Save"), "Insert").when(_starts(n, "Update", "Upsert"), "Update").when(_starts(n, "Delete", "Remove"), "Delete").otherwise("Other")
    )


def repository_kind(base: Column) -> Column:
    has = lambda part: F.contains(base, F.lit(part))
    return (
        F.when(base.isNull(), "Unknown").when(has("DocumentDBRepoBase"), "DocumentDb").when(has("TableStorage"), "TableStorage").when(has("Sql"), "Sql").when(has("InMemory"), "InMemory").otherwise("Other")
    )


def _class_rows(types: DataFrame, path: str) -> DataFrame:
    first = F.get("bases", F.lit(0))
    base = F.when(~is_interface_name(first), first)
    return types.where((F.col("kind") == "class") & F.col("first_of_kind")).withColumns({
        "base": base, "interfaces": F.array_distinct(F.transform(F.filter("bases", lambda b: is_interface_name(b)), lambda b: bare(b))),
        "constructors": F.transform(members_of(types, "constructor"), lambda c: F.struct(
            F.transform(c["parameters"], lambda p: F.struct(p["name"].alias("name"), type_name(p["type"]).alias("type"))).alias("parameters"),
            c["first_line"].alias("first_line"), c["last_line"].alias("last_line"), c["body"].alias("body"))),
        "taken": F.flatten(F.transform(members_of(types, "constructor"), lambda c: F.transform(c["parameters"], lambda p: p["type"]))),
        "methods": members_of(types, "method"),
    })


def _first_parameter(methods: Column, *words: str) -> Column:
    """The type of the first parameter of the first method whose name begins with one of the words and that takes something."""
    found = F.filter(methods, lambda m: m["name"].rlike(f"^(?:{'|'.join(words)})") & (F.size(m["parameters"]) > 0) & ~F.get(m["parameters"], F.lit(0))["type"].endswith("]"))
    return type_name(F.get(one(found)["parameters"], F.lit(0))["type"])


_CLASS = ("namespace", "summary", "base_type", "interfaces", "primary_entity", "constructors", "dependencies", "methods")


def managers(types: DataFrame, path: str = "path") -> DataFrame:
    """The first class of each file as a manager: entity, constructors, what they depend on, and methods by kind."""
    rows = _class_rows(types, path)
    entity = points.class_entity(F.col("name"), _first_parameter(F.col("methods"), "Add", "Create"), _most_frequent(_signatures(F.col("methods"))))
    return rows.withColumns({
        "summary": F.col("doc.summary"), "base_type": bare(F.col("base")), "primary_entity": entity,
        "dependencies": F.array_distinct(F.transform(F.filter("taken", is_interface_name), bare)),
    }).withColumn("methods", F.transform("methods", lambda m: _described(m, manager_method_kind(m["name"])))).select(path, F.col("name").alias("class_name"), *_CLASS)


def repositories(types: DataFrame, path: str = "path") -> DataFrame:
    """The first class of each file as a repository: what it stores and where; it depends on the interfaces of its own file."""
    rows = _class_rows(types, path)
    stored = F.nullif(type_name(F.regexp_extract("base", r"<\s*([^,]+?)\s*[,>]", 1)), F.lit(""))
    stem = F.when(F.col("name").rlike("Repo(?:sitory)?$"), F.regexp_replace("name", "(?:Repository|Repo)$", ""))
    entity = F.coalesce(stored, stem, _first_parameter(F.col("methods"), "Add", "Insert", "Upsert", "Save"), _most_frequent(_signatures(F.col("methods"))))
    here = F.transform(F.filter("siblings", lambda s: s["kind"] == "interface"), lambda s: s["name"])
    return rows.withColumns({
        "summary": F.col("doc.summary"), "base_type": bare(F.col("base")), "primary_entity": entity, "repository_kind": repository_kind(F.col("base")),
        "dependencies": F.array_intersect(F.transform("taken", bare), here),
    }).withColumn("methods", F.transform("methods", lambda m: _described(m, repository_method_kind(m["name"])))).select(path, F.col("name").alias("class_name"), "repository_kind", *_CLASS)


def interfaces(types: DataFrame, path: str = "path") -> DataFrame:
    """The first interface of each file as a contract: entity, role and methods."""
    rows = types.where((F.col("kind") == "interface") & F.col("first_of_kind")).withColumn("methods", members_of(types, "method"))
    stem = F.regexp_replace("name", "^I(?=[A-Z])", "")
    for suffix in ("Manager", "Repository", "Service"):
        stem = F.regexp_replace(stem, f"{suffix}$", "")
    classes = F.transform(F.filter("siblings", lambda s: s["kind"] == "class"), lambda s: s["name"])
    held = lambda m: F.nullif(F.regexp_extract(m["type"], r"<\s*([^<,>]+)", 1), F.lit(""))
    used = F.flatten(F.transform("methods", lambda m: F.concat(F.transform(m["parameters"], lambda p: bare(p["type"])), F.array_compact(F.array(bare(held(m)))))))
    entity = F.coalesce(F.when(~is_blank(stem), stem), _most_frequent(F.filter(used, lambda n: F.array_contains(classes, n))))
    role = F.coalesce(*[F.when(F.col("name").endswith(s), f"{s}Contract") for s in ("Manager", "Repository", "Service")], F.lit("OtherContract"))
    methods = F.transform("methods", lambda m: F.struct(
        m["name"].alias("name"), m["type"].alias("returns"), m["type"].rlike(r"^Task<|^Task$|^System\.Threading\.Tasks\.Task").alias("is_async"),
        F.transform(m["parameters"], lambda p: F.struct(p["name"].alias("name"), F.when(p["type"].endswith("]"), p["type"]).otherwise(type_name(p["type"])).alias("type"), p["value"].isNotNull().alias("is_optional"), p["value"].alias("default_value"))).alias("parameters"),
        m["doc"]["summary"].alias("summary"), m["first_line"].alias("first_line"), m["last_line"].alias("last_line")))
    return rows.select(
        path, F.col("name").alias("interface_name"), "namespace", F.concat_ws(".", "namespace", "name").alias("full_name"), (F.col("arity") > 0).alias("is_generic"),
        F.col("arity").alias("generic_arity"), F.array_distinct("bases").alias("base_interfaces"), entity.alias("primary_entity"), role.alias("role"), methods.alias("methods"), "first_line", "last_line",
    )


# -- tables of routes, entities and fields


def constants(types: DataFrame) -> DataFrame:
    """The string constants of all files: constant (Class.Name) and value; of several of one name the least value."""
    each = types.select("name", F.explode(F.filter("members", lambda m: (m["kind"] == "field") & F.array_contains(m["modifiers"], "const") & m["value"].isNotNull())).alias("m"))
    return each.groupBy(F.concat_ws(".", "name", "m.name").alias("constant")).agg(F.min("m.value").alias("value"))


def _resolved(rows: DataFrame, known: DataFrame, columns: list[str], owner: str) -> DataFrame:
    """rows with the texts of columns that name a constant, of any class or of their own, replaced by its value."""
    for c in columns:
        last_two = F.regexp_extract(c, r"(?:^|[.:])(\w+\.\w+)$", 1)
        key = F.when(F.col(c).rlike(r"^\w+$"), F.concat_ws(".", owner, c)).otherwise(F.nullif(last_two, F.lit("")))
        right = known.select(F.col("constant").alias("__constant"), F.col("value").alias("__value"))
        rows = rows.withColumn("__key", key).join(right, F.col("__key") == F.col("__constant"), "left")
        rows = rows.withColumn(c, F.coalesce("__value", c)).drop("__key", "__constant", "__value")
    return rows


def controller_routes(types: DataFrame, known: DataFrame | None = None, path: str = "path") -> DataFrame:
    """One row per action of a controller with its verb, routes, returned type and body.

    A template that is no literal stays the expression it is, unless `known` (as from `constants`) has its value.
    """
    based = F.exists("bases", lambda b: b.rlike(r"Controller(?:Base)?$|\.Controller"))
    controller = F.col("name").endswith("Controller") | based | F.exists("attributes", lambda a: a["name"].rlike("ApiController(?:Attribute)?$"))
    providers = [f"{k}(?:Attribute)?$" for k in VERBS]
    template = lambda attributes: first_template(attributes, r"(?:^|\.)Route(?:Attribute)?$", *providers)
    rows = types.where((F.col("kind") == "class") & controller).select(
        path, "position", F.concat_ws(".", "namespace", "name").alias("full_name"), F.col("name").alias("class_name"), template(F.col("attributes")).alias("class_route"),
        F.posexplode(members_of(types, "method")).alias("place", "m"),
    )
    simple = lambda a: F.regexp_replace(F.substring_index(a["name"], ".", -1), "Attribute$", "")
    verbs = F.create_map(*[F.lit(x) for pair in MORE_VERBS.items() for x in pair])
    verb = one(F.filter(F.transform("m.attributes", lambda a: F.try_element_at(verbs, simple(a))), lambda v: v.isNotNull()))
    rows = rows.withColumns({"verb": verb, "method_route": template(F.col("m.attributes"))}).where("verb IS NOT NULL")
    if known is not None:
        rows = _resolved(rows, known, ["class_route", "method_route"], "class_name")
    slashes = lambda c: F.regexp_replace(F.trim(c), "^/+|/+$", "")
    rooted = lambda c: F.when(F.startswith(c, F.lit("/")), c).otherwise(F.concat(F.lit("/"), c))
    a, b = F.trim(text_of(F.col("class_route"))), F.trim(text_of(F.col("method_route")))
    full = (
        F.when((a == "") & (b == ""), "").when(a == "", rooted(b)).when(b == "", rooted(a)).when(F.startswith(b, F.lit("/")), b)
        .otherwise(rooted(F.concat(slashes(a), F.lit("/"), slashes(b))))
    )
    body = one(F.filter("m.parameters", lambda p: F.size(named(p["attributes"], "FromBody")) > 0))["type"]
    posted = F.when(F.col("verb").isin("POST", "PUT", "PATCH"), F.regexp_replace(body, "^global::", ""))
    rows = rows.withColumns({"full_route": full, "body_type": posted})
    return rows.select(
        path, "position", "place", "full_name", "class_name", F.col("m.name").alias("method_name"), "verb", "class_route", "method_route", "full_route",
        normalize_route("full_route").alias("full_route_norm"), F.col("m.type").alias("return_type"), F.contains("m.type", F.lit("Task")).alias("is_task"),
        F.exists("m.parameters", lambda p: p["type"].rlike(r"^(?:.*\.)?ListRequest$|ListRequest<")).alias("takes_list_request"), F.col("body_type").isNotNull().alias("has_body"),
        "body_type", F.substring_index(F.regexp_extract("body_type", "^[^<]*", 0), ".", -1).alias("body_name"),
        F.exists("m.parameters", lambda p: F.size(named(p["attributes"], "FromServices")) > 0).alias("takes_services"),
    )


def entity_urls(types: DataFrame, path: str = "path") -> DataFrame:
    """One row per class with an entity attribute: its bases and what the attribute's named arguments say."""
    own = one(F.filter("attributes", lambda a: a["name"].rlike("EntityDescription(?:Attribute)?$")))
    rows = types.where(F.col("kind") == "class").withColumn("a", own).where("a IS NOT NULL")
    says = lambda n: value_or_text(F.try_element_at(F.filter(F.col("a.args"), lambda x: x["name"] == n), F.lit(-1)))
    snake = lambda n: "".join(f"_{c.lower()}" if c.isupper() and i and not n[i - 1].isupper() else c.lower() for i, c in enumerate(n))
    inherits = lambda b: F.exists("bases", lambda x: x.endswith(b) | F.contains(x, F.lit(f".{b}")))
    return rows.select(
        path, "position", F.concat_ws(".", "namespace", "name").alias("full_name"), F.col("name").alias("class_name"), inherits("SummaryData").alias("inherits_summary"),
        inherits("EntityBase").alias("inherits_entity"), *[says(n).alias(snake(n)) for n in URLS],
    )


def header_fields(types: DataFrame, path: str = "path") -> DataFrame:
    """One row per field property that refers to another entity, with its picker's URL; references to enumerations are left out.

    Enumerations are those of all files; they are told by their simple name.
    """
    form = lambda m: one(F.filter(m["attributes"], lambda a: a["name"].rlike("FormField(?:Attribute)?$")))
    found = F.transform(members_of(types, "property"), lambda m, i: F.struct(i.alias("place"), m["name"].alias("name"), m["type"].alias("type"), form(m).alias("form")))
    kept = F.filter(found, lambda m: m["type"].rlike(r"(?:^|[<.,\s])EntityHeader(?:[<>?,\s]|$)") & m["form"].isNotNull())
    rows = types.where(F.col("kind").isin("class", "struct", "record", "enum")).select(
        path, "position", "kind", F.concat_ws(".", "namespace", "name").alias("full_name"), F.col("name").alias("class_name"), F.when(F.col("kind") != "enum", kept).alias("found"),
    )
    rows = materialize(rows, "header_rows")  # the files are read once; enumerations and properties go two ways
    props = rows.select(path, "position", "full_name", "class_name", F.explode("found").alias("m")).select("*", "m.form", "m.place")
    held = F.nullif(F.regexp_extract("m.type", r"^[^<]*<\s*(.+?)\s*>\??$", 1), F.lit(""))
    props = props.withColumns({"argument_type": held, "argument_name": bare(held)})
    enums = rows.where(F.col("kind") == "enum").select(F.col("class_name").alias("argument_name")).distinct().withColumn("is_enum", F.lit(True))
    props = props.join(enums, "argument_name", "left").withColumn("is_enum", F.coalesce("is_enum", F.lit(False)))
    props = props.where(~(F.col("is_enum") & (bare(F.col("m.type")) == "EntityHeader")))
    first = F.get("form.args", F.lit(0))
    kind = F.coalesce(F.when(first["name"].isNull(), first["text"]), argument(F.col("form"), "FieldType")["text"])
    return props.select(
        path, "position", "place", "full_name", "class_name", F.col("m.name").alias("property"), F.col("m.type").alias("property_type"), "argument_type",
        F.when(F.col("argument_type").isNotNull(), F.col("is_enum")).alias("argument_is_enum"), kind.alias("field_type"),
        value_or_text(argument(F.col("form"), "EntityHeaderPickerUrl")).alias("picker_url"),
    )
