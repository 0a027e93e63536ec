"""Queries over declared types: every document becomes a source file, every line of it a member.

The length of a line decides what its member looks like, so members vary with the texts; the line itself stands in a comment and,
escaped, in a string literal, with all its quotes, braces and comment marks.  SQL derives the expected rows from the same lines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import catalog, describe, members, models, sections
from .registry import Registry, read, spread

R = Registry()


def _pick(n: Column, choices: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in choices]), (n % len(choices) + 1).cast("int"))


def _fill(template: Column, **values: Column) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def _files(spark, d, head: str, member, tail: str, path: str):
    """path and text of a file per document: head, then what `member` makes of (line, number) for each line, then tail."""
    docs = spread(read(spark, d, "documents").where("doc_id IS NOT NULL").select("doc_id", "text", "lang", "source"))
    lines = F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("")), "\n", -1)
    own = {"i": F.col("doc_id"), "l": F.coalesce("lang", F.lit("x")), "s": F.coalesce("source", F.lit("x"))}
    literal = lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))

    def one(line: Column, at: Column) -> Column:
        text = member(F.length(line), at)
        text = F.replace(F.replace(text, F.lit("{n}"), (at + 1).cast("string")), F.lit("{i}"), F.col("doc_id").cast("string"))
        # the line goes in last: what it holds is no place for anything else
        parts = F.transform(F.split(text, "@", -1), lambda p: F.when(p == "line", line).when(p == "lit", literal(line)).otherwise(p))
        return F.array_join(parts, "")

    body = F.array_join(F.transform(lines, one), "")
    return docs.select("doc_id", _fill(F.lit(path), **own).alias("path"), F.concat(_fill(F.lit(head), **own), body, _fill(F.lit(tail), **own)).alias("text"))


#: The lines of all documents: i doc_id, k number of the line from 1, n its length, l lang, s source, t the line.
_LINES = """lines AS (SELECT doc_id AS i, coalesce(lang, 'x') AS l, coalesce(source, 'x') AS s, unnest(string_split(replace(coalesce(text, ''), chr(13), ''), chr(10))) AS t,
    generate_subscripts(string_split(replace(coalesce(text, ''), chr(13), ''), chr(10)), 1) AS k FROM documents WHERE doc_id IS NOT NULL),
  m AS (SELECT *, length(t) AS n FROM lines)"""

# -- controllers

_VERBS = ["[HttpGet", "[HttpPost", "[HttpPut", "[Microsoft.HttpDelete", "[HttpPatchAttribute", "[Note"]
_ROUTES = ["x/{id}", "/abs/{n}", "x{n}"]
_RETURNS = ["Task<DetailResponse<W{i}>>", "Task<ListResponse<W{i}>>", "Task<InvokeResult>", "List<W{i}>", "string"]
_TAKES = ["string id, ", "int? id, ", "[FromBody] My.W{i} id, ", "[FromServices] ILogger id, "]
_CONTROLLER = """using System;
namespace A.{l}
{
    [Route("api/{s}")]
    [Authorize]
    public class W{i}Controller : Base, IDisposable
    {
        public const string Base = "v{i}";
        private readonly IW{i}Manager _m, _n;
"""


def _action(n: Column, at: Column) -> Column:
    doc = F.when(n % 2 == 0, F.lit("        /// <summary>About {n}</summary>\n")).otherwise(F.lit(""))
    head = F.concat(F.lit("        // @line@\n"), doc, F.lit("        "), _pick(n, _VERBS), F.lit('("'), _pick(n, _ROUTES), F.lit('")]\n        public '), _pick(n, _RETURNS))
    return F.concat(head, F.lit(" M{n}Async("), _pick(n, _TAKES), F.lit('string q = "@lit@")\n        {\n            // } _n.Not(\n            return _m.Load{n}(q);\n        }\n'))


def _controllers(spark, d, asked: members.Needs):
    return members.with_types(_files(spark, d, _CONTROLLER, _action, "    }\n}\n", "src/{i}Controller.cs"), asked=asked)


_A = f"""WITH {_LINES}, e AS (SELECT *, ['GET', 'POST', 'PUT', 'DELETE', 'PATCH'][n % 6 + 1] AS verb,
    9 + sum(7 + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY i ORDER BY k) AS last_line FROM m),
  a AS (SELECT *, CASE WHEN n % 3 = 0 THEN 'Route' WHEN verb IN ('GET', 'DELETE') THEN 'Query' ELSE 'Unknown' END AS source,
    CASE WHEN verb IN ('GET', 'DELETE') THEN 'Query' ELSE 'Unknown' END AS q_source FROM e WHERE n % 6 < 5),
  b AS (SELECT *, n % 4 IN (1, 2) AND source = 'Unknown' AS is_body FROM a)"""


@R.add("endpoint_descriptions", f"""{_A} SELECT 'src/' || i || 'Controller.cs' AS path, 'W' || i || 'Controller.M' || k AS endpoint_key, 'api/' || s || CASE n % 3 WHEN 0 THEN '/x/{{id}}' WHEN 1 THEN '/abs/' || k ELSE '/x' || k END AS route, verb,
    CASE n % 5 WHEN 2 THEN 'InvokeResult' WHEN 3 THEN 'List' WHEN 4 THEN 'String' ELSE 'W' || i END AS primary_entity,
    CASE WHEN n % 2 = 0 THEN 'About ' || k ELSE verb || ' ' || CASE n % 5 WHEN 2 THEN 'InvokeResult' WHEN 3 THEN 'List' WHEN 4 THEN 'String' ELSE 'W' || i END END AS summary,
    'IW' || i || 'Manager.Load' || k AS handler,
    CASE WHEN n % 4 = 3 OR is_body THEN '' ELSE 'id:' || source || ':' || CASE n % 4 WHEN 0 THEN 'String:true' WHEN 1 THEN 'Nullable:false' ELSE 'W' || i || ':true' END || ',' END || 'q:' || q_source || ':String:false' AS parameters,
    CASE WHEN is_body THEN CASE n % 4 WHEN 1 THEN 'Nullable' ELSE 'W' || i END END AS body, md5('"' || replace(replace(t, '\\', '\\\\'), '"', '\\"') || '"') AS default_hash,
    CASE WHEN verb = 'POST' THEN 201 ELSE 200 END AS status, CASE n % 5 WHEN 0 THEN CASE WHEN n % 3 = 0 THEN 'FormLoad' ELSE 'Detail' END WHEN 1 THEN 'List' WHEN 3 THEN 'List' END AS ui_pattern,
    true AS requires_authentication, (last_line - 5)::INTEGER AS first_line, last_line::INTEGER AS last_line FROM b""")
def endpoint_descriptions(spark, d):
    out = describe.endpoints(_controllers(spark, d, describe.ENDPOINTS))
    shown = F.array_join(F.transform("parameters", lambda p: F.concat_ws(":", p["name"], p["source"], p["type"], p["is_required"].cast("string"))), ",")
    return out.select(
        "path", "endpoint_key", "route", F.col("http_methods")[0].alias("verb"), "primary_entity", "summary", F.concat_ws(".", "handler.interface", "handler.method").alias("handler"), shown.alias("parameters"),
        F.col("request_body.model_type").alias("body"), F.md5(F.element_at("parameters", -1)["default_value"].cast("binary")).alias("default_hash"), F.col("responses")[0]["status"].alias("status"),
        "ui_pattern", "authorization.requires_authentication", "first_line", "last_line",
    )


@R.add("controller_routes", f"""{_A} SELECT 'A.' || l || '.W' || i || 'Controller' AS full_name, 'M' || k || 'Async' AS method_name, verb, CASE n % 3 WHEN 0 THEN '/api/' || s || '/x/{{id}}' WHEN 1 THEN '/abs/' || k ELSE '/api/' || s || '/x' || k END AS full_route,
    CASE n % 3 WHEN 0 THEN '/api/' || lower(s) || '/x/{{x}}' WHEN 1 THEN '/abs/' || k ELSE '/api/' || lower(s) || '/x' || k END AS full_route_norm, n % 5 < 3 AS is_task,
    CASE WHEN n % 4 = 2 AND verb IN ('POST', 'PUT', 'PATCH') THEN 'My.W' || i END AS body_type, n % 4 = 3 AS takes_services FROM b""")
def controller_routes(spark, d):
    out = describe.controller_routes(_controllers(spark, d, describe.ROUTES))
    return out.select("full_name", "method_name", "verb", "full_route", "full_route_norm", "is_task", "body_type", "takes_services")


#: Routes by constants of their own class and of another file's.
_CONSTANT = """namespace A { [Route(W{i}Routes.Base)] public class W{i}Controller {
    public const string Own = "own{i}", Unused = "u";
"""
_CONSTANTS = 'public static class W{i}Routes { public const string Base = "v{l}"; /* {s} */\n'


def _constant_action(n: Column, at: Column) -> Column:
    return F.concat(F.lit("    // @line@\n    [HttpGet("), _pick(n, ["Own", "My.W{i}Routes.L{n}", "Not.Known", '"x{n}"']), F.lit(')] public void M{n}() { Say("@lit@"); }\n'))


@R.add("routes_by_constants", f"""WITH {_LINES} SELECT 'W' || i || 'Controller' AS class_name, 'M' || k AS method_name, '/v' || l || '/' || CASE n % 4 WHEN 0 THEN 'own' || i WHEN 1 THEN replace(replace(t, '\\', '/'), '/', '') || 'z' WHEN 2 THEN 'Not.Known' ELSE 'x' || k END AS full_route FROM m""")
def routes_by_constants(spark, d):
    used = members.with_types(_files(spark, d, _CONSTANT, _constant_action, "} }\n", "src/{i}Controller.cs"))
    cleaned = lambda n, at: F.lit('public const string L{n} = "@lit@z";\n')
    others = members.with_types(_files(spark, d, _CONSTANTS, cleaned, "}\n", "src/{i}Routes.cs"))
    known = describe.constants(used.unionByName(others))
    known = known.withColumn("value", F.when(F.col("constant").rlike(r"\.L\d+$"), F.translate("value", "\\/", "")).otherwise(F.col("value")))
    return describe.controller_routes(used, known).select("class_name", "method_name", "full_route")


@R.add("scanned_route_join", f"""{_A}, r AS (SELECT CASE n % 3 WHEN 0 THEN '/api/' || lower(s) || '/x/{{x}}' WHEN 1 THEN '/abs/' || k ELSE '/api/' || lower(s) || '/x' || k END AS u, count(*) AS c FROM b GROUP BY 1),
  p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN '/abs/' || (page_id % 40) ELSE '/api/src' || (page_id % 30) || '/x/{{x}}' END AS u FROM pages)
  SELECT count(*) AS pickers, count(p.u) AS with_url, coalesce(sum(c), 0)::BIGINT AS matched, count(*) FILTER (p.u IS NOT NULL AND c IS NULL) AS unmatched FROM p LEFT JOIN r ON p.u = r.u""")
def scanned_route_join(spark, d):
    i = F.col("page_id")
    url = F.when(i % 3 == 1, F.concat(F.lit("/abs/"), i % 40)).when(i % 3 == 2, F.concat(F.lit("/api/src"), i % 30, F.lit("/x/{x}")))
    pickers = read(spark, d, "pages").select(url.alias("picker_url_norm"))
    return catalog.route_join_stats(pickers, describe.controller_routes(_controllers(spark, d, describe.ROUTES)))


# -- managers, repositories, interfaces

_STARTS = ["Add", "Update", "Remove", "Get", "QueryAll", "Validate", "GetListOf", "Run"]
_ACCESS = ["public", "private", "protected internal", ""]
_MANAGER = """namespace A.{l}
{
    /// <summary>
    /// What {s}
    ///   does
    /// </summary>
    public class W{i}Manager : ManagerBase<{l}>, IW{i}Manager, A.IMore<W{i}>
    {
        public W{i}Manager(IStore store, Clock clock, A.B.ISafe<string> safe) : base(store) { _s = store; }
"""
_REPOSITORY = """namespace A.{l}
{
    public interface IStore { void Save(W{i} x, int n = 1); Task<List<W{i}>> AllAsync(string[] a); }
    public class W{i}Repo : TableStorageBase<Data.W{i}>, IW{i}Repo
    {
        public W{i}Repo(IStore store, ISafe safe) { }
"""


def _method(n: Column, at: Column) -> Column:
    body = _pick(n, ["{ }", '{ Say("@lit@"); }', '{ if (x) { y("}"); } else { z(); } return; }', "=> Say(null);"])
    return F.concat(F.lit("        // @line@\n        "), _pick(n, _ACCESS), F.lit(" Task<W{i}> "), _pick(n, _STARTS), F.lit("{n}(W{i} x, int? n = 3) "), body, F.lit("\n"))


_KINDS = "['Create', 'Update', 'Delete', 'Query', 'Query', 'Validation', 'Query', 'Other']"
_STORES = "['Insert', 'Update', 'Delete', 'GetById', 'Query', 'Other', 'Query', 'Other']"
_WORDS = "['Add', 'Update', 'Remove', 'Get', 'QueryAll', 'Validate', 'GetListOf', 'Run']"


@R.add("class_descriptions", f"""WITH {_LINES} SELECT 'manager' AS described, 'W' || i || 'Manager' AS class_name, 'What ' || s || chr(10) || 'does' AS summary, 'ManagerBase' AS base_type, 'IW' || i || 'Manager,IMore' AS interfaces, 'W' || i AS primary_entity,
    'IStore,ISafe' AS dependencies, NULL AS repository_kind, {_WORDS}[n % 8 + 1] || k AS method, {_KINDS}[n % 8 + 1] AS kind, n % 4 <> 1 AND n % 4 <> 3 AS significant, 'Task<W' || i || '>' AS returns, 'W' || i || ',Nullable' AS takes, (9 + 2 * k)::INTEGER AS first_line FROM m
  UNION ALL SELECT 'repository', 'W' || i || 'Repo', NULL, 'TableStorageBase', 'IW' || i || 'Repo', 'W' || i, 'IStore', 'TableStorage', {_WORDS}[n % 8 + 1] || k, {_STORES}[n % 8 + 1], n % 4 <> 1 AND n % 4 <> 3, 'Task<W' || i || '>', 'W' || i || ',Nullable', (6 + 2 * k)::INTEGER FROM m""")
def class_descriptions(spark, d):
    def rows(name: str, found):
        m = found.withColumn("m", F.explode("methods"))
        return m.select(
            F.lit(name).alias("described"), "class_name", "summary", "base_type", F.array_join("interfaces", ",").alias("interfaces"), "primary_entity", F.array_join("dependencies", ",").alias("dependencies"),
            (F.col("repository_kind") if "repository_kind" in found.columns else F.lit(None).cast("string")).alias("repository_kind"), F.col("m.name").alias("method"), F.col("m.kind").alias("kind"),
            F.col("m.is_significant").alias("significant"), F.col("m.returns").alias("returns"), F.array_join(F.transform("m.parameters", lambda p: p["type"]), ",").alias("takes"), F.col("m.first_line").alias("first_line"),
        )

    managers = describe.managers(members.with_types(_files(spark, d, _MANAGER, _method, "    }\n}\n", "src/{i}Manager.cs"), asked=describe.CLASSES))
    repositories = describe.repositories(members.with_types(_files(spark, d, _REPOSITORY, _method, "    }\n}\n", "src/{i}Repo.cs"), asked=describe.CLASSES))
    return rows("manager", managers).unionByName(rows("repository", repositories))


_INTERFACE = """namespace A.{l};
public interface IW{i}Manager<T, U> : IMany<T>, IOther where T : class
{
"""


def _contract(n: Column, at: Column) -> Column:
    return F.concat(F.lit("  // @line@\n  "), _pick(n, ["Task<W{i}>", "void", "My.W{i}[]"]), F.lit(" M{n}("), _pick(n, ["", "W{i} a", 'string a, string b = "@lit@"', "int[] a"]), F.lit(");\n"))


@R.add("interface_descriptions", f"""WITH {_LINES} SELECT 'A.' || l || '.IW' || i || 'Manager' AS full_name, 2 AS generic_arity, 'IMany<T>,IOther' AS base_interfaces, 'W' || i AS primary_entity, 'ManagerContract' AS role, 'M' || k AS method,
    ['Task<W' || i || '>', 'void', 'My.W' || i || '[]'][n % 3 + 1] AS returns, n % 3 = 0 AS is_async, CASE n % 4 WHEN 0 THEN '' WHEN 1 THEN 'a:W' || i || ':false' WHEN 2 THEN 'a:String:false,b:String:true' ELSE 'a:int[]:false' END AS takes,
    CASE WHEN n % 4 = 2 THEN md5('"' || replace(replace(t, '\\', '\\\\'), '"', '\\"') || '"') END AS default_hash, (3 + 2 * k)::INTEGER AS first_line FROM m""")
def interface_descriptions(spark, d):
    found = describe.interfaces(members.with_types(_files(spark, d, _INTERFACE, _contract, "}\n", "src/I{i}.cs"), asked=describe.INTERFACES)).withColumn("m", F.explode("methods"))
    takes = F.array_join(F.transform("m.parameters", lambda p: F.concat_ws(":", p["name"], p["type"], p["is_optional"].cast("string"))), ",")
    default = F.try_element_at(F.col("m.parameters"), F.lit(2))["default_value"]
    return found.select("full_name", "generic_arity", F.array_join("base_interfaces", ",").alias("base_interfaces"), "primary_entity", "role", F.col("m.name").alias("method"), F.col("m.returns").alias("returns"), "m.is_async",
                        takes.alias("takes"), F.md5(default.cast("binary")).alias("default_hash"), F.col("m.first_line").alias("first_line"))


# -- sections

_NL = "chr(10)"


@R.add("manager_sections", f"""WITH {_LINES}, h AS (SELECT *, 'Domain: A.' || l || {_NL} || 'Model: W' || i || ' — of it' || {_NL} || {_NL} AS head, {_WORDS}[n % 8 + 1] || k AS name,
    row_number() OVER (PARTITION BY i ORDER BY encode({_WORDS}[n % 8 + 1] || k)) AS part, count(*) OVER (PARTITION BY i) AS total FROM m)
  SELECT 'W' || i || 'Manager' AS symbol, 'manager-methods' AS section_key, part::INTEGER AS part, total::INTEGER AS total, md5(head || 'Methods for manager W' || i || 'Manager:' || {_NL} || {_NL} || '- Method ' || name || ' (ManagerMethod) operates on the W' || i || ' model in the A.' || l || ' domain.' || {_NL}
    || '  Kind: ' || {_KINDS}[n % 8 + 1] || ', ' || ['public', 'private', 'protected/internal', 'unknown'][n % 4 + 1] || ', ' || CASE WHEN n % 4 IN (0, 2) THEN 'significant' ELSE 'non-significant' END || {_NL}
    || '  Returns: Task<W' || i || '>' || {_NL} || '  Params: W' || i || ' x, Nullable n' || {_NL} || '  Lines: ' || (9 + 2 * k) || '-' || (9 + 2 * k)) AS hash FROM h
  UNION ALL SELECT 'W' || i || 'Manager', 'manager-overview', 1, 1, md5(head || 'Manager: W' || i || 'Manager' || {_NL} || 'Namespace: A.' || l || {_NL} || 'Base Type: ManagerBase' || {_NL} || 'Manager Type: ManagerOverview' || {_NL} || 'Primary Entity: W' || i || {_NL}
    || 'Implements: IW' || i || 'Manager, IMore' || {_NL} || 'Depends On: IStore, ISafe' || {_NL} || {_NL} || 'Summary:' || {_NL} || 'What ' || s || {_NL} || 'does') FROM h WHERE k = 1
  UNION ALL SELECT 'W' || i || 'Manager', 'manager-constructors', 1, 1, md5(head || 'Constructors for manager W' || i || 'Manager:' || {_NL} || '- (constructor)' || {_NL} || '  Dependencies: IStore store, Clock clock, ISafe safe' || {_NL} || '  Lines: 9-9') FROM h WHERE k = 1""")
def manager_sections(spark, d):
    """With a budget of one token, so that each method has a section of its own."""
    rows = describe.managers(members.with_types(_files(spark, d, _MANAGER, _method, "    }\n}\n", "src/{i}Manager.cs"), asked=describe.CLASSES))
    nothing = F.lit(None).cast("string")
    header = F.struct(F.col("namespace").alias("domain_name"), nothing.alias("domain_tagline"), nothing.alias("model_name"), F.col("primary_entity").alias("model_class"), F.lit("of it").alias("model_tagline"))
    return sections.manager_sections(rows, header, 1).select("symbol", "section_key", "part", "total", F.md5(F.col("text").cast("binary")).alias("hash"))


@R.add("endpoint_sections", f"""{_A}, c AS (SELECT *, 'W' || i || 'Controller.M' || k AS symbol, CASE n % 5 WHEN 2 THEN 'InvokeResult' WHEN 3 THEN 'List' WHEN 4 THEN 'String' ELSE 'W' || i END AS model, n % 5 < 2 AS wrapped,
    CASE n % 5 WHEN 0 THEN CASE WHEN n % 3 = 0 THEN 'This endpoint loads an existing model instance for editing using an id route parameter.' ELSE 'This endpoint returns a detailed model instance suitable for display or editing.' END
      WHEN 1 THEN 'This endpoint returns a list of models suitable for list or grid rendering, typically using paging.' WHEN 3 THEN 'This endpoint returns a list of models suitable for list or grid rendering, typically using paging.' END AS purpose FROM b)
  SELECT symbol, 'endpoint-overview' AS section_key, md5('Endpoint: ' || symbol || {_NL} || 'Controller: W' || i || 'Controller' || {_NL} || 'Action: M' || k || 'Async' || {_NL} || 'Route: api/' || s || CASE n % 3 WHEN 0 THEN '/x/{{id}}' WHEN 1 THEN '/abs/' || k ELSE '/x' || k END || {_NL} || 'HTTP Methods: ' || verb || {_NL}
    || 'Primary Entity: ' || model || {_NL} || {_NL} || 'Handler:' || {_NL} || '  Interface: IW' || i || 'Manager' || {_NL} || '  Method: Load' || k || {_NL} || '  Kind: Manager' || {_NL} || {_NL} || 'Authorization:' || {_NL} || '  Requires Authentication: True' || {_NL} || '  Allow Anonymous: False' || {_NL} || '  Tenancy: OrgScoped' || {_NL}
    || coalesce({_NL} || 'UI Pattern:' || {_NL} || '  ' || purpose || {_NL}, '') || {_NL} || 'Lines: ' || (last_line - 5)::INTEGER || '-' || last_line::INTEGER || {_NL} || {_NL} || 'Summary:' || {_NL} || CASE WHEN n % 2 = 0 THEN 'About ' || k ELSE verb || ' ' || model END) AS hash FROM c
  UNION ALL SELECT symbol, 'endpoint-request-response', md5('Request and response shape for endpoint ' || symbol || ':' || {_NL} || {_NL} || 'Non-body parameters:' || {_NL}
    || CASE WHEN n % 4 = 3 OR is_body THEN '' ELSE '- id: Source=' || source || ', Type=' || CASE n % 4 WHEN 0 THEN 'String, Required=True' WHEN 1 THEN 'Nullable, Required=False' ELSE 'W' || i || ', Required=True' END || ', Collection=False, Default=(none)' || {_NL} END
    || '- q: Source=' || q_source || ', Type=String, Required=False, Collection=False, Default="' || replace(replace(t, '\', '\\'), '"', '\"') || '"' || {_NL} || {_NL} || 'Request body:' || {_NL}
    || CASE WHEN is_body THEN '  Model: ' || CASE n % 4 WHEN 1 THEN 'Nullable' ELSE 'W' || i END || {_NL} || '  IsCollection: False' || {_NL} || '  IsPrimitive: False' || {_NL} || '  ContentTypes: application/json' || {_NL} ELSE '  None.' || {_NL} END
    || {_NL} || 'Responses:' || {_NL} || {_NL} || '- ' || CASE WHEN verb = 'POST' THEN 201 ELSE 200 END || ': ' || {_NL} || '  Model: ' || model || {_NL} || '  IsCollection: ' || CASE WHEN n % 5 IN (1, 3) THEN 'True' ELSE 'False' END || {_NL} || '  IsWrapped: ' || CASE WHEN wrapped THEN 'True' ELSE 'False' END || {_NL}
    || CASE n % 5 WHEN 0 THEN '  Wrapper: DetailResponse<W' || i || '>' || {_NL} WHEN 1 THEN '  Wrapper: ListResponse<W' || i || '>' || {_NL} ELSE '' END || '  ContentTypes: application/json' || {_NL} || '  IsError: False' || {_NL} || {_NL}
    || '- 400: Validation or input error.' || {_NL} || '  IsCollection: False' || {_NL} || '  IsWrapped: True' || {_NL} || '  Wrapper: InvokeResult' || {_NL} || '  ContentTypes: application/json' || {_NL} || '  IsError: True' || {_NL} || '  ErrorShape: InvokeResult') FROM c""")
def endpoint_sections(spark, d):
    rows = sections.endpoint_sections(describe.endpoints(_controllers(spark, d, describe.ENDPOINTS)))
    return rows.select("symbol", "section_key", F.md5(F.col("text").cast("binary")).alias("hash"))


# -- models and domains

_TYPES = ["string", "EntityHeader<Mode>", "List<EntityHeader<My.Thing>>", "EntityHeader", "Mode", "int[]", "List<Child>"]
_LABELS = ["LabelResource: Res.Names.K{n}, ", "", 'LabelResource: "@lit@", ', "HelpResource = Res.K1, LabelResource = K2, "]
_MODEL = """namespace A.{l}
{
    public enum Mode { A, B }
    [EntityDescription(Domains.{s}, Res.Names.K1, Res.Names.N{i}, "K2", GetUrl: "/api/{s}/{i}", Cloneable: true, Icon = Icons.{l})]
    public class W{i} : EntityBase, ISome
    {
"""


def _property(n: Column, at: Column) -> Column:
    kind = _pick(n, ["Text", "ChildList", "Key"])
    return F.concat(F.lit("        // @line@\n        [FormField("), _pick(n, _LABELS), F.lit("FieldType: FieldTypes."), kind, F.lit(')]\n        public '), _pick(n, _TYPES), F.lit(' P{n} { get; set; } = "@lit@";\n'))


def _models(spark, d):
    return _files(spark, d, _MODEL, _property, "    }\n}\n", "src/{i}.cs")


def _resources(spark, d):
    """Keys K0 .. K24 from the nations, K2 twice."""
    nation = read(spark, d, "nation")
    own = nation.select(F.lit("b").alias("resource_set"), F.concat(F.lit("K"), "n_nationkey").alias("key"), F.col("n_name").alias("value"))
    return own.unionByName(nation.where("n_nationkey = 2").select(F.lit("a").alias("resource_set"), F.lit("K2").alias("key"), F.lit("Two").alias("value")))


_FIELDS = """f AS (SELECT *, ['string', 'EntityHeader<Mode>', 'EntityHeader<My.Thing>', 'EntityHeader', 'Mode', 'int', 'Child'][n % 7 + 1] AS clr, n % 7 IN (2, 5, 6) AS many FROM m)"""


@R.add("model_structures", f"""WITH {_LINES}, {_FIELDS},
  w AS (SELECT i, any_value(l) AS l, any_value(s) AS s, string_agg('P' || k || ':' || clr || ':' || many || ':' || (n % 7 = 5) || ':' || (n % 7 = 4) || ':' || (n % 3 = 2), ',' ORDER BY k) AS properties,
    coalesce(string_agg('p' || k || ':' || coalesce(['Mode', 'My.Thing', NULL][n % 7], ''), ',' ORDER BY k) FILTER (n % 7 IN (1, 2, 3)), '') AS header_refs,
    coalesce(string_agg('p' || k, ',' ORDER BY k) FILTER (n % 3 = 1), '') AS children,
    coalesce(string_agg('W' || i || 'To' || ['Mode', 'Thing', 'EntityHeader'][n % 7] || ':' || CASE WHEN many THEN 'OneToMany' ELSE 'OneToOne' END, ',' ORDER BY k) FILTER (n % 7 IN (1, 2, 3)), '') AS relationships FROM f GROUP BY i)
  SELECT 'A.' || l || '.W' || i AS qualified_name, s AS domain, (SELECT n_name FROM nation WHERE n_nationkey = 1) AS title, 'N' || i AS description, least((SELECT n_name FROM nation WHERE n_nationkey = 2), 'Two') AS help, true AS cloneable,
    '/api/' || s || '/' || i AS get_url, properties || ',Name:System.String:false:true:false:false,Key:System.String:false:true:false:true' AS properties, header_refs, children, relationships FROM w""")
def model_structures(spark, d):
    found = models.structures(members.with_types(_models(spark, d)), _resources(spark, d))
    show = lambda c, *fields: F.array_join(F.transform(c, lambda p: F.concat_ws(":", *[F.coalesce(p[f].cast("string"), F.lit("")) for f in fields])), ",")
    return found.select(
        "qualified_name", "domain", "title", "description", "help", F.col("flags.Cloneable").alias("cloneable"), F.col("links.GetUrl").alias("get_url"),
        show("properties", "name", "clr_type", "is_collection", "is_value_type", "is_enum", "is_key").alias("properties"), show("header_refs", "key", "target").alias("header_refs"),
        show("children", "key").alias("children"), show("relationships", "name", "cardinality").alias("relationships"),
    )


@R.add("model_metadata", f"""WITH {_LINES}, {_FIELDS}, r AS (SELECT 'K' || n_nationkey AS key, CASE WHEN n_nationkey = 2 THEN 'Two' ELSE n_name END AS value FROM nation),
  e AS (SELECT i, l, s, k, CASE n % 4 WHEN 0 THEN 'K' || k WHEN 2 THEN t WHEN 3 THEN 'K2' END AS label_key, n % 4 AS how FROM f),
  x AS (SELECT e.*, value AS label, coalesce(trim(label_key, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '') = '' AS blank FROM e LEFT JOIN r ON key = label_key),
  y AS (SELECT i, any_value(l) AS l, any_value(s) AS s, string_agg('P' || k || '=' || coalesce(CASE WHEN NOT blank THEN label END, 'P' || k), '|' ORDER BY k) AS fields, count(*) FILTER (how = 3) AS helped,
    count(*) FILTER (how = 1) AS missing, string_agg(CASE WHEN how = 1 THEN 'FormField on property ''P' || k || ''' is missing a LabelResource argument.' WHEN blank THEN 'FormField on property ''P' || k || ''' has a LabelResource expression that could not be parsed.'
      WHEN label IS NULL THEN 'FormField on property ''P' || k || ''' has LabelResource ''' || label_key || ''' that could not be resolved.' END, '|' ORDER BY k) AS errors FROM x GROUP BY i)
  SELECT 'W' || i AS class_name, s AS domain_key, 'K1' AS title_key, (SELECT value FROM r WHERE key = 'K1') AS title, 'N' || i AS description_key, NULL AS description, 'Two' AS help, md5(fields) AS fields, helped,
    md5(concat_ws('|', 'Description resource ''N' || i || ''' could not be resolved.', errors)) AS errors FROM y""")
def model_metadata(spark, d):
    found = models.metadata(members.with_types(_models(spark, d)), _resources(spark, d))
    fields = F.array_join(F.transform("fields", lambda f: F.concat_ws("=", f["property"], f["label"])), "|")
    hashed = lambda c: F.md5(c.cast("binary"))
    return found.select(
        "class_name", "domain_key", "title_key", "title", "description_key", "description", "help", hashed(fields).alias("fields"),
        F.size(F.filter("fields", lambda f: f["help"].isNotNull())).cast("long").alias("helped"), hashed(F.array_join("errors", "|")).alias("errors"),
    )


@R.add("header_fields", f"""WITH {_LINES} SELECT 'A.' || l || '.W' || i AS full_name, 'P' || k AS property, CASE n % 7 WHEN 2 THEN 'List<EntityHeader<My.Thing>>' ELSE 'EntityHeader' END AS property_type,
    CASE WHEN n % 7 = 2 THEN 'EntityHeader<My.Thing>' END AS argument_type, CASE WHEN n % 7 = 2 THEN false END AS argument_is_enum, 'FieldTypes.' || ['Text', 'ChildList', 'Key'][n % 3 + 1] AS field_type FROM m WHERE n % 7 IN (2, 3)""")
def header_fields(spark, d):
    return describe.header_fields(members.with_types(_models(spark, d), asked=describe.HEADER_FIELDS)).select("full_name", "property", "property_type", "argument_type", "argument_is_enum", "field_type")


@R.add("entity_urls", """SELECT 'src/' || doc_id || '.cs' AS path, 'A.' || coalesce(lang, 'x') || '.W' || doc_id AS full_name, false AS inherits_summary, true AS inherits_entity, '/api/' || coalesce(source, 'x') || '/' || doc_id AS get_url, NULL AS save_url,
    'Icons.' || coalesce(lang, 'x') AS icon FROM documents WHERE doc_id IS NOT NULL""")
def entity_urls(spark, d):
    return describe.entity_urls(members.with_types(_models(spark, d), asked=describe.ENTITY_URLS)).select("path", "full_name", "inherits_summary", "inherits_entity", "get_url", "save_url", "icon")


@R.add("model_entries", """WITH r AS (SELECT 'K' || n_nationkey AS key, CASE WHEN n_nationkey = 2 THEN least(n_name, 'Two') ELSE n_name END AS value FROM nation)
  SELECT 'src/' || doc_id || '.cs' AS path, coalesce(source, 'x') AS domain, 'W' || doc_id AS model, (SELECT value FROM r WHERE key = 'K1') AS title, 'N' || doc_id AS description, (SELECT value FROM r WHERE key = 'K2') AS help FROM documents WHERE doc_id IS NOT NULL AND doc_id % 3 <> 0""")
def model_entries(spark, d):
    files = _models(spark, d).withColumn("path", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Tests\\"), "path")).otherwise(F.col("path")))
    return models.model_entries(files, _resources(spark, d)).select("path", "domain", "model", "title", "description", "help")


#: A file declares the domain of its source and a model; both come again in other files.
_DOMAIN = """namespace A.{l}
{
    [DomainDescriptor]
    public class D{i}
    {
        public const string Key = "{s}";
        [DomainDescription(Key)]
        public static DomainDescription Main { get { return new DomainDescription() { Name = "N {i}; {", Description = "of {s}", DomainType = DomainDescription.DomainTypes.Service }; } }
"""


def _more_domains(n: Column, at: Column) -> Column:
    key = _pick(n, ['"L@lit@"', "Unknown{n}", "Key"])
    return F.concat(F.lit("        // @line@\n        [DomainDescription("), key, F.lit(")] public static DomainDescription P{n} { get { return Of({n}); } }\n"))


_WITH_MODEL = """    }
    [EntityDescription(Key, K1, K2, K3)] public class Shared{l} { }
    [EntityDescription(Key, K1)] public class Half{l} { }
}
"""


@R.add("domain_model_catalogue", f"""WITH {_LINES}, p AS (SELECT i, l, s, k, t, n % 3 AS how, 'src/' || i || '.cs' AS path FROM m),
  d AS (SELECT s AS key, 'Key' AS key_name, 'Main' AS name, 'N ' || i || '; {{' AS title, path, 0 AS place FROM (SELECT DISTINCT i, s, path FROM p)
    UNION ALL SELECT CASE how WHEN 0 THEN 'L' || t WHEN 1 THEN 'P' || k ELSE s END, CASE how WHEN 1 THEN 'Unknown' || k WHEN 2 THEN 'Key' END, 'P' || k, CASE how WHEN 0 THEN 'L' || t WHEN 1 THEN 'P' || k ELSE s END, path, k FROM p),
  e AS (SELECT 'domain' AS entry, key, name, title, path, place FROM d UNION ALL SELECT 'domain_name', key_name, name, title, path, place FROM d WHERE key_name IS NOT NULL
    UNION ALL SELECT 'model', 'A.' || l || '.Shared' || l, 'Shared' || l, 'K1', path, 0 FROM (SELECT DISTINCT i, l, path FROM p)),
  o AS (SELECT *, row_number() OVER (PARTITION BY entry, lower(key) ORDER BY path, place) AS up, row_number() OVER (PARTITION BY entry, lower(key) ORDER BY path DESC, place DESC) AS down, count(*) OVER (PARTITION BY entry, lower(key)) AS n FROM e)
  SELECT entry, md5(key) AS key, name, md5(title) AS title, path, n FROM o WHERE CASE WHEN entry = 'model' THEN down ELSE up END = 1""")
def domain_model_catalogue(spark, d):
    out = models.catalogue(members.with_types(_files(spark, d, _DOMAIN, _more_domains, _WITH_MODEL, "src/{i}.cs")))
    return out.select("entry", F.md5(F.col("key").cast("binary")).alias("key"), "name", F.md5(F.col("title").cast("binary")).alias("title"), "path", "n")
