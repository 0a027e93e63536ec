"""Queries over source files, points, commands and plain tools.

All documents are made into files of one or several shapes: the whole text stands in a comment or a chapter, the rest follows from
the id, so that SQL can say what must come out.  Files whose members vary with the texts are those of code_queries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import python as P
from ..functions import text as T
from ..operators import code, points, symbols, tools
from ..operators import sessions as S
from ..operators.ranks import with_place
from .registry import Registry, read, spread

R = Registry()

#: A class with a field, a property, a method and a nested enum; {i} is the id and {l} the language.
_CLASS = """public class W{i}Manager : IBase
    {
        [Label(X.Names.K{k})]
        private int _n = 1;
        public string Name { get; set; }
        public async Task<W{i}> GetAsync(string id)
        {
            if (id == null) { return X.Missing; }
            return Load(id); // class Fake
        }
        <ENUM>
    }"""
_ENUM = "enum Mode { A, B }"
_HEAD = "/* {t} */\nusing System;\n\nnamespace A.{l}\n{\n    "
_MODEL = '[EntityDescription("IoT")]\npublic class W{i} { /* {t} */ }\n'
_TEST = "// {i}\n[TestFixture] public class W{i}Tests\n{\n  [Test]\n  public void Works() { Use(X.Device); }\n}\n/* {t} */"
_DDR = "# Title {i}\nOwner: me\n\n## 1 - First\n{t}\n## 2 - Second\nmore {i}"
_FILES = [("src/{i}Manager.cs", _HEAD + _CLASS.replace("<ENUM>", _ENUM) + "\n}\n"), ("src/{i}.cs", _MODEL), ("tests/{i}Tests.cs", _TEST), ("docs/{i}.md", _DDR)]
_NAMES = {"{i}": "doc_id", "{k}": "doc_id % 7", "{l}": "coalesce(lang, 'x')", "{t}": "translate(coalesce(text, ''), '*#`', '+++')"}


def _filled(template: str) -> Column:
    out = F.lit(template)
    for name, expression in _NAMES.items():
        out = F.replace(out, F.lit(name), F.expr(expression).cast("string"))
    return out


def _files(spark, d, *kinds):
    """Each document as a file of each of the kinds."""
    docs = read(spark, d, "documents").where(F.col("doc_id").isNotNull())
    made = [docs.select("doc_id", _filled(_FILES[k][0]).alias("path"), _filled(_FILES[k][1]).alias("text")) for k in kinds]
    return reduce(lambda a, b: a.unionByName(b), made)


def _sql(template: str) -> str:
    out = "'" + template.replace("'", "''") + "'"
    for name, expression in _NAMES.items():
        if name in template:
            out = f"replace({out}, '{name}', ({expression})::VARCHAR)"
    return out


_DOCS = "FROM documents WHERE doc_id IS NOT NULL"


@R.add("code_kinds", f"""SELECT CASE k {" ".join(f"WHEN {k} THEN {_sql(p)}" for k, (p, _) in enumerate(_FILES))} END AS path,
    CASE k WHEN 0 THEN 'Manager' WHEN 1 THEN 'Model' WHEN 2 THEN 'Test' ELSE 'MarkDown' END AS kind,
    CASE k WHEN 0 THEN 'W' || doc_id || 'Manager' WHEN 1 THEN 'W' || doc_id WHEN 2 THEN 'W' || doc_id || 'Tests' END AS primary_type,
    CASE k WHEN 0 THEN 'rule:Manager,name:Manager' WHEN 1 THEN 'rule:Model' WHEN 2 THEN 'rule:Test,rule:Test,name:Test' ELSE 'rule:MarkDown' END AS evidence FROM documents, range(4) AS r(k) WHERE doc_id IS NOT NULL""")
def code_kinds(spark, d):
    # of a document in a file of its own nothing is a type, whatever words stand there
    out = code.with_kind(_files(spark, d, 0, 1, 2, 3).withColumn("text", F.when(F.col("path").startswith("docs/"), F.concat(F.lit("/* "), F.replace("text", F.lit("*/"), F.lit("")))).otherwise(F.col("text"))))
    return out.select("path", "kind", "primary_type", F.array_join("evidence", ",").alias("evidence"))


_INDENTED = r"regexp_replace({}, '(^|\n)([^\n])', '\1    \2', 'g')"
_PLAIN = _sql(_CLASS.replace("<ENUM>", "")).replace("'\n", "'\n")


@R.add("code_symbols", f"""WITH s AS (SELECT doc_id, 'src/' || doc_id || 'Manager.cs' AS path, 'A.' || coalesce(lang, 'x') AS ns, {_PLAIN} AS body {_DOCS}),
  a AS (SELECT path, 'class' AS symbol_kind, 'W' || doc_id || 'Manager' AS symbol, ns AS namespace, NULL AS declaring, body FROM s
    UNION ALL SELECT path, 'enum', 'Mode', ns, 'W' || doc_id || 'Manager', '{_ENUM}' FROM s)
  SELECT path, symbol_kind, symbol, namespace, declaring, concat_ws('.', namespace, declaring, symbol) AS full_name,
    md5('using System;' || chr(10) || chr(10) || 'namespace ' || namespace || chr(10) || '{{' || chr(10) || {_INDENTED.format("body")} || chr(10) || '}}' || chr(10)) AS hash FROM a
  UNION ALL SELECT 'src/' || doc_id || '.cs', 'class', 'W' || doc_id, NULL, NULL, 'W' || doc_id, md5('[EntityDescription("IoT")]' || chr(10) || 'public class W' || doc_id || ' {{ /* ' || {_NAMES["{t}"]} || ' */ }}' || chr(10)) {_DOCS}""")
def code_symbols(spark, d):
    # text is compared with line feeds alone
    out = symbols.with_symbols(_files(spark, d, 0, 1).withColumn("text", F.replace("text", F.lit("\r\n"), F.lit("\n"))))
    return out.withColumn("hash", F.md5(F.col("text").cast("binary"))).drop("text")


@R.add("code_symbol_chunks", f"""WITH s AS (SELECT doc_id, 'src/' || doc_id || 'Manager.cs' AS path, length({_NAMES["{t}"]}) - length(replace({_NAMES["{t}"]}, chr(10), '')) AS n {_DOCS}),
  p(part, symbol_kind, symbol, first, last) AS (VALUES (1, 'file', NULL, 1, NULL), (2, 'type', 'Manager', 6, 17), (3, 'field', '_n', 8, 9), (4, 'property', 'Name', 10, 10), (5, 'method', 'GetAsync', 11, 15), (6, 'type', 'Mode', 16, 16))
  SELECT path, part::INTEGER AS part, 6::INTEGER AS total, symbol_kind, CASE WHEN symbol = 'Manager' THEN 'W' || doc_id || symbol ELSE symbol END AS symbol,
    CASE WHEN part = 1 THEN 1 ELSE first + n END::INTEGER AS first_line, CASE WHEN part = 1 THEN least(n + 19, 200) ELSE last + n END::INTEGER AS last_line FROM s, p""")
def code_symbol_chunks(spark, d):
    out = symbols.with_symbol_chunks(_files(spark, d, 0).withColumn("text", F.replace("text", F.lit("\r\n"), F.lit("\n"))), overlap=0)
    return out.select("path", "part", "total", "symbol_kind", "symbol", "first_line", "last_line")


@R.add("code_methods", f"""SELECT 'src/' || doc_id || 'Manager.cs' AS path, 0 AS position, 'public async' AS modifiers, 'Task<W' || doc_id || '>' AS returns, 'GetAsync' AS method, 'string id' AS parameters, 'Query' AS kind {_DOCS}
  UNION ALL SELECT 'tests/' || doc_id || 'Tests.cs', 0, 'public', 'void', 'Works', '', 'Other' {_DOCS}""")
def code_methods(spark, d):
    return code.methods(_files(spark, d, 0, 2)).withColumn("kind", T.method_kind("method"))


@R.add("resource_usages", f"""WITH u AS (SELECT doc_id, 'src/' || doc_id || 'Manager.cs' AS path, 'K' || (doc_id % 7) AS key, 'attribute' AS usage, false AS is_test {_DOCS}
    UNION ALL SELECT doc_id, 'src/' || doc_id || 'Manager.cs', 'Missing', 'member', false {_DOCS} UNION ALL SELECT doc_id, 'tests/' || doc_id || 'Tests.cs', 'Device', 'member', true {_DOCS})
  SELECT path, 'X' AS container, key, usage, is_test FROM u""")
def resource_usages(spark, d):
    return code.resource_usages(_files(spark, d, 0, 2).withColumn("text", code.without_comments("text")), ["X"])


@R.add("ddr_chapters", f"""SELECT 'docs/' || doc_id || '.md' AS path, 1 AS chapter, 'First' AS title, md5(trim({_NAMES["{t}"]} || chr(10))) AS hash {_DOCS}
  UNION ALL SELECT 'docs/' || doc_id || '.md', 2, 'Second', md5('more ' || doc_id) {_DOCS}""")
def ddr_chapters(spark, d):
    return code.ddr_chapters(_files(spark, d, 3), "path").select("path", "chapter", "title", F.md5(F.col("body").cast("binary")).alias("hash"))


def _sections(spark, d):
    docs = with_place(read(spark, d, "documents").where("doc_id IS NOT NULL"), ["source"], ["doc_id"], "part", "total")
    return docs.select(
        F.lit("Org").alias("org"), F.coalesce("source", F.lit("none")).alias("project"), F.lit("Repo").alias("repo"), F.lit("Doc").alias("symbol_type"), F.concat(F.lit("D"), "doc_id").alias("symbol"),
        F.coalesce("lang", F.lit("none")).alias("section_key"), "part", "total", "text", F.when(F.col("doc_id") % 2 == 0, F.lit(" ")).otherwise(F.lit("snip")).alias("snippet"), F.lit("Blob/A b").alias("blob_uri"),
    )


@R.add("rag_points", """WITH s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS part, count(*) OVER (PARTITION BY source) AS total FROM documents WHERE doc_id IS NOT NULL)
  SELECT 'Doc: D' || doc_id || ' - ' || coalesce(lang, 'none') || ' (Chunk ' || part || ' of ' || total || ')' AS title, lower('Org:' || coalesce(source, 'none') || ':Repo:Doc:D' || doc_id || ':' || coalesce(lang, 'none') || ':' || part) AS semantic_id,
    'blob/a_b.d' || doc_id || '/' || lower(coalesce(lang, 'none')) || '.' || part AS blob_place, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE 'snip' END) AS hash FROM s""")
def rag_points(spark, d):
    out = points.with_unique(points.points(_sections(spark, d)))
    return out.select("title", "semantic_id", "blob_place", F.md5(F.col("content").cast("binary")).alias("hash"))


@R.add("endpoint_facts", """WITH e AS (SELECT page_id AS i, ['DetailResponse', 'ListResponse', 'InvokeResult', NULL][page_id % 4 + 1] AS w, ['/api/thing/factory', '/api/thing/{id}', '/api/things'][page_id % 3 + 1] AS r, CASE WHEN page_id % 5 = 0 THEN 'Device' END AS m FROM pages)
  SELECT i AS page_id, CASE WHEN w = 'DetailResponse' THEN CASE i % 3 WHEN 0 THEN 'FormFactory' WHEN 1 THEN 'FormLoad' ELSE 'Detail' END WHEN w = 'ListResponse' THEN 'List' WHEN w = 'InvokeResult' AND m IS NULL THEN 'Command' END AS pattern,
    coalesce(m, CASE i % 3 WHEN 0 THEN 'factory' WHEN 2 THEN 'things' ELSE 'Thing' END) AS entity, CASE WHEN i % 2 = 0 THEN 'OneToMany' ELSE 'OneToOne' END AS relation, i % 3 <> 1 OR i % 7 > 1 AS significant FROM e""")
def endpoint_facts(spark, d):
    i = F.col("page_id")
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % n + 1).cast("int"))
    wrapper, route = pick(4, "DetailResponse", "ListResponse", "InvokeResult", None), pick(3, "/api/thing/factory", "/api/thing/{id}", "/api/things")
    model = F.when(i % 5 == 0, "Device")
    return read(spark, d, "pages").select(
        "page_id", points.ui_pattern(wrapper, route, F.lit("Get"), F.lit(False), model).alias("pattern"), points.endpoint_entity(model, route, F.lit("ThingController")).alias("entity"),
        points.cardinality(F.when(i % 2 == 0, "List<Thing>").otherwise("Thing")).alias("relation"), points.is_significant(pick(3, "public", "private", "protected"), i % 7).alias("significant"),
    )


@R.add("source_texts", """SELECT doc_id, md5('RESX Resource Entry' || chr(10) || chr(10) || 'Key: k' || doc_id || chr(10) || 'Value: ' || coalesce(text, '') || chr(10) || 'Comment: ' || chr(10) || 'Culture: ' || coalesce(lang, '') || chr(10) || 'Source: ' || coalesce(source, '')) AS resource,
    'Method Get' || doc_id || ' (Query)' || CASE WHEN trim(source) <> '' THEN ' operates on the ' || source || ' model' ELSE '' END || CASE WHEN trim(lang) <> '' THEN ' in the ' || lang || ' domain' ELSE '' END || '. '
      || CASE WHEN doc_id % 3 = 0 THEN 'Model focus: ' || n_chars || ' characters. ' ELSE '' END || 'Signature: void Get' || doc_id || '(string id).' AS method,
    concat_ws(chr(10), 'Kind: Doc', 'Artifact: D' || doc_id, CASE WHEN trim(lang) <> '' THEN 'Domain: ' || lang END) AS finder FROM documents""")
def source_texts(spark, d):
    i = F.col("doc_id")
    return read(spark, d, "documents").select(
        "doc_id", F.md5(points.resource_text(F.concat(F.lit("k"), i), "text", F.lit(None).cast("string"), "lang", "source").cast("binary")).alias("resource"),
        points.method_summary(
            F.concat(F.lit("Get"), i), F.lit("Query"), F.col("source"), F.col("lang"), F.concat(F.lit("void Get"), i, F.lit("(string id)")),
            model_tagline=F.when(i % 3 == 0, F.concat("n_chars", F.lit(" characters"))),
        ).alias("method"),
        points.finder_snippet(F.lit("Doc"), F.concat(F.lit("D"), i), F.col("lang"), F.lit(" ")).alias("finder"),
    )


#: Command lines made of whole texts: quoted and escaped, bare, with a quote that is not closed, and without a command.
_COMMANDS = r"""WITH t AS (SELECT doc_id, doc_id % 4 AS how, coalesce(text, '') AS t, replace(replace(coalesce(text, ''), '"', ''), chr(92), '') AS bare FROM documents WHERE doc_id >= 0),
  w AS (SELECT *, list_filter(regexp_split_to_array(bare, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM t)
  SELECT doc_id, CASE WHEN how = 0 OR (how = 1 AND len(words) <= 40) THEN 'SingleMatch' ELSE 'NoMatch' END AS outcome, CASE WHEN how = 0 THEN 'run' WHEN how = 1 AND len(words) <= 40 THEN 'go' END AS command_id,
    md5(CASE WHEN how = 0 THEN CASE WHEN t = '' THEN 'tail' ELSE t || '|tail' END WHEN how = 1 AND len(words) <= 40 THEN array_to_string(words, '|') END) AS args, CASE WHEN how = 0 THEN 'run' WHEN how = 1 AND len(words) <= 40 THEN 'go' ELSE '' END AS candidates FROM w"""


@R.add("command_routes", _COMMANDS)
def command_routes(spark, d):
    rows = [("run", ["Run"], True, 0, 1, 3, None), ("go", ["go", "walk on"], False, 0, 0, 40, None), ("stop", ["halt", "stop"], False, 0, 1, 1, "^[0-9]+$")]
    registry = spark.createDataFrame(rows, "command_id string, triggers array<string>, ignore_case boolean, priority int, min_args int, max_args int, arg_pattern string")
    text = F.coalesce("text", F.lit(""))
    quoted = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    bare, how = F.translate(text, '"\\', ""), F.col("doc_id") % 4
    line = (
        F.when(how == 0, F.concat(F.lit('  rUN "'), quoted, F.lit('" tail'))).when(how == 1, F.concat(F.lit("go "), bare))
        .when(how == 2, F.concat(F.lit('go "'), bare)).otherwise(F.concat(F.lit("x"), text))
    )
    out = tools.route_commands(spread(read(spark, d, "documents").select("doc_id", "text").where("doc_id >= 0")).withColumn("text", line), registry, "text", "doc_id")
    return out.select("doc_id", "outcome", "command_id", F.md5(F.array_join("args", "|").cast("binary")).alias("args"), F.array_join("candidates", ",").alias("candidates"))


@R.add("scoped_rows", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey % 2 = 0 AND coalesce(o_orderkey % 3 <> 0, true) AND o_orderstatus IN ('O', 'F')")
def scoped_rows(spark, d):
    rows = read(spark, d, "orders").withColumn("is_deleted", F.nullif(F.col("o_orderkey") % 3 == 0, F.lit(False))).withColumn("org_id", (F.col("o_custkey") % 2).cast("string"))
    return tools.of_kinds(tools.not_deleted(tools.of_org(rows, "0")), ["o", "F"], "o_orderstatus").select("o_orderkey", "o_orderstatus")


@R.add("label_samples", "SELECT l.doc_id, d.lang || '-text-' || d.source AS partition_key FROM labels l JOIN documents d USING (doc_id) WHERE d.lang = 'en' AND d.source = (SELECT min(source) FROM documents)")
def label_samples(spark, d):
    docs = read(spark, d, "documents").select("doc_id", tools.label_key("lang", F.concat(F.lit("text/"), "source")).alias("partition_key"))
    least = read(spark, d, "documents").agg(F.min("source")).first()[0]
    return tools.of_partition(read(spark, d, "labels").select("doc_id").join(docs, "doc_id"), f"en-text-{least}")


@R.add("not_recorded", "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents r WHERE r.doc_id % 3 = 0 AND r.doc_id IS NOT DISTINCT FROM d.doc_id AND r.lang IS NOT DISTINCT FROM d.lang AND r.text IS NOT DISTINCT FROM d.text)")
def not_recorded(spark, d):
    found = read(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("hash"))
    return tools.not_recorded(found, found.where("doc_id % 3 = 0"), ["doc_id", "lang", "hash"]).drop("hash")


@R.add("resource_files", """WITH e AS (SELECT p_brand AS key, min(p_type) AS f FROM part WHERE p_partkey % 3 <> 0 AND p_size > 40 GROUP BY p_brand)
  SELECT p_partkey, f AS resource_file, f IS NULL AS unresolved FROM part LEFT JOIN e ON key = p_brand""")
def resource_files(spark, d):
    part = read(spark, d, "part")
    entries = part.where("p_partkey % 3 <> 0 AND p_size > 40").select(F.col("p_brand").alias("key"), F.col("p_type").alias("path"))
    return tools.resource_files(part.select("p_partkey", F.col("p_brand").alias("key")), entries).select("p_partkey", "resource_file", "unresolved")


@R.add("choices", "SELECT n_nationkey, n_name FROM nation ORDER BY n_regionkey = 2 DESC, n_name LIMIT 5")
def choices(spark, d):
    nation = read(spark, d, "nation").withColumn("kind", F.col("n_regionkey").cast("string"))
    return nation.orderBy(*tools.kind_first("2", "n_name")).limit(5).select("n_nationkey", "n_name")


@R.add("chapters_listed", "SELECT n_nationkey, n_name = 'CHINA' AS is_current FROM nation")
def chapters_listed(spark, d):
    return tools.listed_chapters(read(spark, d, "nation"), "CHINA", "n_nationkey", "n_name").select("n_nationkey", "is_current")


@R.add("lines_reversed", "SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey DESC)::BIGINT AS place FROM nation WHERE n_nationkey > 2")
def lines_reversed(spark, d):
    rows = tools.newest_first_without_preview(read(spark, d, "nation"), "n_nationkey")
    return with_place(rows, [], ["-n_nationkey"]).select("n_nationkey", "place")


@R.add("changed_fields", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment, 'Approved' AS status FROM customer")
def changed_fields(spark, d):
    customer = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    changes = customer.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "CHANGED").alias("c_mktsegment"))
    return tools.with_status(tools.with_changes(customer, changes, "c_custkey"), " approved", ["Draft", "Approved"])


@R.add("small_forms", """SELECT doc_id, [true, true, false, false, NULL][(doc_id % 5 + 5) % 5 + 1] AS boolish, contains(coalesce(text, ''), '<') AND contains(coalesce(text, ''), '>') AS html,
    CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2024-02-29 12:00:00' ELSE TIMESTAMP '0001-01-01' END::VARCHAR AS at, CASE WHEN doc_id % 3 = 0 THEN 'ABC-' || lpad(((doc_id % 1000 + 1000) % 1000)::VARCHAR, 6, '0') END AS ddr,
    coalesce((doc_id % 4 + 4) % 4 <> 3, false) AS is_test, coalesce('/api/v' || doc_id, '') || '/things' AS route, coalesce('Thing' || doc_id || 'Controller.', '') || 'Get' AS endpoint FROM documents""")
def small_forms(spark, d):
    i = F.col("doc_id")
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(i, F.lit(n)) + 1).cast("int"))
    return read(spark, d, "documents").select(
        "doc_id", T.parse_boolish(pick(5, " TRUE", "1", "False ", "0", "yes")).alias("boolish"), F.coalesce(T.looks_like_html("text"), F.lit(False)).alias("html"),
        F.date_format(T.parse_iso_or_min(pick(2, "2024-02-29T12:00:00", "no date")), "yyyy-MM-dd HH:mm:ss").alias("at"),
        T.ddr_identifier(F.when(i % 3 == 0, F.concat(F.lit(" abc-"), F.pmod(i, F.lit(1000)))).otherwise(F.concat(F.lit("ab-"), i))).alias("ddr"),
        T.is_test_path(pick(4, "a\\Tests\\x.cs", "Lib.Tests/x.cs", "src/xTests.cs", "src/x.cs")).alias("is_test"),
        T.combine_routes(F.concat(F.lit("/api/v"), i, F.lit("//")), F.lit("/things/")).alias("route"), T.endpoint_key(F.concat(F.lit("Thing"), i, F.lit("Controller")), F.lit("GetAsync")).alias("endpoint"),
    )


@R.add("chapters_reordered", "SELECT n_name, (26 - rank() OVER (ORDER BY n_name))::INTEGER AS place FROM nation")
def chapters_reordered(spark, d):
    nation = read(spark, d, "nation")
    names = [r[0] for r in nation.select("n_name").orderBy(F.desc("n_name")).limit(1000).collect()]  # the chapters of one document
    return S.reorder_chapters(nation, names, "n_name").select("n_name", "place")


@R.add("clean_json", """SELECT doc_id, '{"a": ' || to_json('x' || doc_id || ' y') || ', "b": [' || doc_id || ', "z"]}' AS cleaned FROM documents""")
def clean_json(spark, d):
    raw = F.concat(F.lit('{"a": "<p>x'), "doc_id", F.lit('</p> y", "auditHistory": [1], "b": ['), "doc_id", F.lit(', "z"]}'))
    return read(spark, d, "documents").select("doc_id", P.clean_json(raw).alias("cleaned"))
