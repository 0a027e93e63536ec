"""Queries over ingestion plans, catalogues, lists and counts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C
from ..operators import ingest as I
from ..operators import retrieval as V
from ..sources import content, points
from ..storage import scratch_path
from .registry import Registry, read

R = Registry()
_STATES = """WITH found AS (SELECT 'Docs/' || doc_id || '.md' AS path, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0),
  known AS (SELECT 'docs//' || doc_id || '.md' AS path, doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256(text) ELSE 'old' END AS h,
    CASE WHEN doc_id % 7 = 0 THEN 'full' WHEN doc_id % 11 = 0 THEN ' ' END AS reindex FROM documents WHERE doc_id % 2 = 0)"""


def _states(spark, d):
    docs = read(spark, d, "documents")
    found = docs.where("doc_id % 5 <> 0").select(F.concat(F.lit("Docs/"), "doc_id", F.lit(".md")).alias("path"), F.sha2("text", 256).alias("content_hash"))
    known = docs.where("doc_id % 2 = 0").select(
        F.concat(F.lit("docs//"), "doc_id", F.lit(".md")).alias("path"), F.col("doc_id").cast("string").alias("doc_id"),
        F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).otherwise("old").alias("content_hash"),
        F.when(F.col("doc_id") % 7 == 0, "full").when(F.col("doc_id") % 11 == 0, " ").alias("reindex"),
    )
    return found, known


_PLAN = _STATES + """ SELECT coalesce(f.path, k.path) AS path, doc_id, CASE WHEN f.path IS NULL THEN 'delete' WHEN k.path IS NULL THEN 'full'
    ELSE coalesce(nullif(trim(reindex), ''), {known}) END AS action, coalesce(f.h <> k.h, false) AS hash_changed
  FROM found f FULL JOIN known k ON lower(f.path) = lower(replace(k.path, '//', '/'))"""


@R.add("plan_ingest", _PLAN.format(known="'chunk'"))
def plan_ingest(spark, d):
    return I.plan_ingest(*_states(spark, d))


@R.add("plan_ingest_skip", _PLAN.format(known="CASE WHEN f.h = k.h THEN 'skip' ELSE 'chunk' END"))
def plan_ingest_skip(spark, d):
    return I.plan_ingest(*_states(spark, d), skip_unchanged=True)


@R.add("plan_deletes", _STATES + " SELECT doc_id, path FROM known k WHERE NOT EXISTS (SELECT 1 FROM found f WHERE lower(f.path) = lower(replace(k.path, '//', '/')))")
def plan_deletes(spark, d):
    return I.plan_deletes(*_states(spark, d)).select("doc_id", "path")


@R.add("replace_documents", """WITH new AS (SELECT doc_id, 'new' AS state FROM documents WHERE doc_id % 3 = 0)
  SELECT doc_id, 'old' AS state FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 2 = 0 UNION ALL SELECT * FROM new""")
def replace_documents(spark, d):
    docs = read(spark, d, "documents")
    old = docs.where("doc_id % 2 = 0").select("doc_id", F.lit("old").alias("state"))
    return I.replace_documents(old, docs.where("doc_id % 3 = 0").select("doc_id", F.lit("new").alias("state")))


@R.add("delete_by_ids", "SELECT doc_id FROM documents WHERE doc_id % 4 <> 1")
def delete_by_ids(spark, d):
    docs = read(spark, d, "documents").select("doc_id")
    gone = docs.where("doc_id % 4 = 1").select(F.concat(F.lit(" "), "doc_id").alias("doc_id"))
    return I.delete_by(docs, gone, "doc_id")


@R.add("facets_distinct", """SELECT arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source, count(*)::BIGINT AS n FROM documents GROUP BY lower(lang), lower(source)""")
def facets_distinct(spark, d):
    return I.distinct_facets(read(spark, d, "documents"), ["lang", "source"], "doc_id")


@R.add("duplicates_by_hash", r"""SELECT sha256(regexp_replace(text, '\r\n|\r|\n', chr(13) || chr(10), 'g')) AS key, count(*)::BIGINT AS n, min(doc_id) AS first_id
  FROM documents GROUP BY key HAVING count(*) > 1""")
def duplicates_by_hash(spark, d):
    return I.duplicates(read(spark, d, "documents"), T.file_hash("text"), "doc_id")


@R.add("first_wins_union", "SELECT key, arg_min(v, p) AS v FROM (SELECT lower(source) AS key, lang AS v, doc_id AS p FROM documents) GROUP BY key")
def first_wins_union(spark, d):
    docs = read(spark, d, "documents")
    return I.first_wins(docs, F.lower("source"), [F.col("doc_id")]).select(F.lower("source").alias("key"), F.col("lang").alias("v"))


_ROUTE = r"lower(regexp_replace(regexp_replace(url, '\?.*$', ''), '(.)/+$', '\1'))"


@R.add("route_join_stats", f"""WITH p AS (SELECT CASE WHEN page_id % 7 <> 0 THEN {_ROUTE} END AS u FROM pages), r AS (SELECT {_ROUTE} AS u FROM pages WHERE page_id % 2 = 0),
  k AS (SELECT u, count(*) AS k FROM r GROUP BY u)
  SELECT count(*)::BIGINT AS pickers, count(p.u)::BIGINT AS with_url, coalesce(sum(k), 0)::BIGINT AS matched, count(*) FILTER (p.u IS NOT NULL AND k IS NULL)::BIGINT AS unmatched
  FROM p LEFT JOIN k USING (u)""")
def route_join_stats(spark, d):
    pages = read(spark, d, "pages").select("page_id", T.normalize_route("url").alias("r"))
    pickers = pages.select(F.when(F.col("page_id") % 7 != 0, F.col("r")).alias("picker_url_norm"))
    return C.route_join_stats(pickers, pages.where("page_id % 2 = 0").select(F.col("r").alias("full_route_norm")))


@R.add("domain_catalog", """SELECT r_regionkey, r_name, coalesce(array_to_string(list_sort(list(n_name) FILTER (n_name IS NOT NULL)), ','), '') AS classes
  FROM region LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON n_regionkey = r_regionkey GROUP BY ALL""")
def domain_catalog(spark, d):
    out = C.domains_with_classes(read(spark, d, "region"), read(spark, d, "nation").where("n_regionkey <> 2"), "r_regionkey", "n_regionkey", "n_name")
    return out.select("r_regionkey", "r_name", F.array_join("classes", ",").alias("classes"))


@R.add("domain_for_class", """WITH c AS (SELECT n_name AS simple, r_name || '.' || n_name AS qualified, r_name AS domain FROM nation JOIN region ON n_regionkey = r_regionkey),
  a AS (SELECT CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN lower(r_name) || '.' || n_name ELSE 'x' || n_name END AS name FROM nation JOIN region ON n_regionkey = r_regionkey)
  SELECT name, (SELECT min(domain) FROM c WHERE lower(simple) = lower(name) OR lower(qualified) = lower(name)) AS domain FROM a""")
def domain_for_class(spark, d):
    j = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    classes = j.select(F.col("n_name").alias("simple"), F.concat_ws(".", "r_name", "n_name").alias("qualified"), F.col("r_name").alias("domain"))
    k = F.col("n_nationkey") % 3
    asked = j.select(F.when(k == 0, F.col("n_name")).when(k == 1, F.concat_ws(".", F.lower("r_name"), "n_name")).otherwise(F.concat(F.lit("x"), "n_name")).alias("name"))
    return C.domain_for_class(asked, classes)


@R.add("model_for_fact", """WITH m AS (SELECT r_name || '.' || n_name AS model, r_name AS domain FROM nation JOIN region ON n_regionkey = r_regionkey)
  SELECT c_custkey AS fact_id, n_name AS entity, (SELECT min(model) FROM m WHERE model = n_name OR ends_with(model, '.' || n_name)) AS model,
    (SELECT arg_min(domain, model) FROM m WHERE model = n_name OR ends_with(model, '.' || n_name)) AS domain FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def model_for_fact(spark, d):
    nation, region = read(spark, d, "nation"), read(spark, d, "region")
    models = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws(".", "r_name", "n_name").alias("model"), F.col("r_name").alias("domain"))
    facts = read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("fact_id"), F.col("n_name").alias("entity"))
    return C.model_for_fact(facts, models)


@R.add("sample_labels", "SELECT d.doc_id, quality, toxic, count(quality) OVER (PARTITION BY source)::BIGINT AS labelled_in_source FROM documents d LEFT JOIN labels l USING (doc_id)")
def sample_labels(spark, d):
    docs, labels = read(spark, d, "documents").select("doc_id", "source"), read(spark, d, "labels")
    j = docs.join(labels, "doc_id", "left")
    n = j.groupBy(F.col("source").alias("own")).agg(F.count("quality").alias("labelled_in_source"))
    return j.join(n, F.col("source").eqNullSafe(F.col("own"))).select("doc_id", "quality", "toxic", "labelled_in_source")


@R.add("primary_entity", """WITH n AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
  SELECT o_custkey, arg_min(o_orderpriority, (-n, o_orderpriority)) AS o_orderpriority, max(n)::BIGINT AS n FROM n GROUP BY o_custkey""")
def primary_entity(spark, d):
    return C.most_frequent(read(spark, d, "orders"), "o_custkey", "o_orderpriority")


@R.add("catalog_counts", """WITH u AS (SELECT 'refined' AS status, quality AS kind FROM labels WHERE toxic = 0 UNION ALL SELECT 'warning', quality FROM labels WHERE toxic = 1
    UNION ALL SELECT 'failure', quality FROM labels WHERE quality = 0) SELECT status, kind, count(*)::BIGINT AS n FROM u GROUP BY ALL""")
def catalog_counts(spark, d):
    labels = read(spark, d, "labels")
    status = F.array_compact(F.array(F.when(F.col("toxic") == 0, "refined"), F.when(F.col("toxic") == 1, "warning"), F.when(F.col("quality") == 0, "failure")))
    return labels.select(F.explode(status).alias("status"), F.col("quality").alias("kind")).groupBy("status", "kind").agg(F.count("*").alias("n"))


@R.add("versions_distinct", """SELECT DISTINCT trim(v) AS version FROM (SELECT p_brand AS v FROM part UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT ' ') WHERE trim(v) <> ''""")
def versions_distinct(spark, d):
    parts = read(spark, d, "part").select(F.col("p_brand").alias("v"))
    u = parts.unionByName(read(spark, d, "customer").select(F.col("c_mktsegment").alias("v"))).unionByName(spark.sql("SELECT ' ' AS v"))
    return u.select(F.trim("v").alias("version")).where("version <> ''").distinct()


@R.add("duplicate_pairs", "SELECT l_orderkey, count(*)::BIGINT AS n, count(DISTINCT (l_suppkey % 5, l_linenumber))::BIGINT AS n_distinct FROM lineitem GROUP BY l_orderkey HAVING count(*) <> count(DISTINCT (l_suppkey % 5, l_linenumber))")
def duplicate_pairs(spark, d):
    out = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct(F.struct(F.col("l_suppkey") % 5, "l_linenumber")).alias("n_distinct"))
    return out.where("n <> n_distinct")


@R.add("page_list", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 50 OFFSET 50")
def page_list(spark, d):
    return C.page(read(spark, d, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 50, 1)


@R.add("page_keyset", "SELECT p_partkey, p_brand FROM part WHERE (p_brand, p_partkey) > ('Brand#2', 100) ORDER BY p_brand, p_partkey LIMIT 50")
def page_keyset(spark, d):
    return C.page_after(read(spark, d, "part").select("p_partkey", "p_brand"), ["p_brand", "p_partkey"], ["Brand#2", 100], 50)


@R.add("key_in_use", "SELECT n_nationkey AS c_nationkey, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) AS in_use FROM nation")
def key_in_use(spark, d):
    probes = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    return C.key_in_use(probes, read(spark, d, "customer").where("c_acctbal > 9900"), "c_nationkey")


@R.add("search_contains", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ing') AND contains(lower(p_type), 'a')")
def search_contains(spark, d):
    part = read(spark, d, "part").where(F.contains("p_name", F.lit("ing")) & F.contains(F.lower("p_type"), F.lit("a")))
    return part.select("p_partkey", "p_name")


@R.add("id_list_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (3, 1, 7, 999999999)")
def id_list_lookup(spark, d):
    return read(spark, d, "customer").where(F.col("c_custkey").isin(3, 1, 7, 999_999_999)).select("c_custkey", "c_name").orderBy("c_custkey")


@R.add("missing_ids", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def missing_ids(spark, d):
    asked = read(spark, d, "lineitem").select("l_partkey").distinct()
    return asked.join(read(spark, d, "part").where("p_size < 25"), F.col("l_partkey") == F.col("p_partkey"), "left_anti")


@R.add("missing_ids_whole", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def missing_ids_whole(spark, d):
    asked = read(spark, d, "lineitem").select("l_partkey").distinct()
    return asked.join(read(spark, d, "part").where("p_size < 25"), F.col("l_partkey") == F.col("p_partkey"), "left_anti")


@R.add("tags_any", "SELECT p_partkey FROM part WHERE list_has_any(list_transform(string_split(p_name, ' '), lambda x: lower(x)), ['ring', 'bolt'])")
def tags_any(spark, d):
    return read(spark, d, "part").where(T.has_any_tag(F.split("p_name", " "), [" Ring", "BOLT"])).select("p_partkey")


@R.add("tags_all", "SELECT p_partkey FROM part WHERE list_has_all(list_transform(string_split(p_name, ' '), lambda x: lower(x)), [lower(string_split((SELECT min(p_name) FROM part), ' ')[1])])")
def tags_all(spark, d):
    first = read(spark, d, "part").agg(F.min("p_name").alias("m")).first()["m"]
    return read(spark, d, "part").where(T.has_all_tags(F.split("p_name", " "), [first.split(" ")[0] if first else ""])).select("p_partkey")


@R.add("tags_distinct", """WITH t AS (SELECT unnest(string_split(p_name, ' ')) AS t FROM part)
  SELECT lower(t) AS key, min(t) AS tag, count(*)::BIGINT AS n FROM t WHERE trim(t) <> '' GROUP BY lower(t)""")
def tags_distinct(spark, d):
    return C.distinct_tags(read(spark, d, "part"), F.split("p_name", " "))


@R.add("seq_next", """SELECT o_orderpriority, (coalesce(max(o_orderkey), 0) + 1)::BIGINT AS next_number, 'KFR-' || o_orderpriority || '-' || lpad((coalesce(max(o_orderkey), 0) + 1)::VARCHAR, 6, '0') AS next_id
  FROM orders GROUP BY o_orderpriority""")
def seq_next(spark, d):
    named = read(spark, d, "orders").withColumn("id", F.format_string("KFR-%s-%06d", "o_orderpriority", "o_orderkey"))
    return C.next_in_sequence(named, "o_orderpriority", "id", r"-([0-9]+)$", "KFR-%s-%06d")


@R.add("authoritative_lookup", rf"""WITH e AS (SELECT doc_id AS entry_id, sha256(lower(source)) AS h, CASE WHEN doc_id % 3 = 0 THEN lang END AS m, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE upper(lang) END AS a,
    'REF-' || doc_id AS i, CASE WHEN doc_id % 5 = 0 THEN 'src' || doc_id END AS sr, CASE WHEN doc_id % 2 = 0 THEN 'low' END AS cf FROM documents),
  q AS (SELECT item_id AS question_id, sha256('src' || (item_id % 25)) AS question_hash FROM benchmark),
  p AS (SELECT h, count(DISTINCT lower(nullif(trim(coalesce(m, a)), ''))) AS k, count(*) AS n, arg_min((coalesce(m, a), coalesce(sr, 'ref:' || i), coalesce(cf, 'high')), entry_id) AS f FROM e GROUP BY h)
  SELECT question_id, question_hash, CASE WHEN n IS NULL THEN 'NotFound' WHEN k > 1 THEN 'Conflict' ELSE 'Answered' END AS status, coalesce(n, 0)::BIGINT AS matches,
    CASE WHEN k <= 1 THEN f[1] END AS answer, CASE WHEN k <= 1 THEN f[2] END AS source_ref, CASE WHEN k <= 1 THEN f[3] END AS confidence FROM q LEFT JOIN p ON h = question_hash""")
def authoritative_lookup(spark, d):
    return _lookup(spark, d, read(spark, d, "documents"))


@R.add("authoritative_lookup_whole", R.sql["authoritative_lookup"])
def authoritative_lookup_whole(spark, d):
    return _lookup(spark, d, read(spark, d, "documents"))


def _lookup(spark, d, docs):
    i = F.col("doc_id")
    entries = docs.select(
        i.alias("entry_id"), F.sha2(F.lower("source"), 256).alias("question_hash"), F.when(i % 3 == 0, F.col("lang")).alias("model_answer"),
        F.when(i % 4 != 0, F.upper("lang")).alias("human_answer"), F.concat(F.lit("REF-"), i).alias("identifier"),
        F.when(i % 5 == 0, F.concat(F.lit("src"), i)).alias("source_ref"), F.when(i % 2 == 0, "low").alias("confidence"), F.lit(True).alias("is_active"),
    )
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.sha2(F.concat(F.lit("src"), F.col("item_id") % 25), 256).alias("question_hash"))
    return C.authoritative_lookup(asked, entries)


@R.add("resolver_match", """SELECT n_nationkey, n_name, CASE WHEN lower(n_nationkey::VARCHAR) = '1' THEN 1.0 WHEN contains(lower(n_name), '1') THEN 0.8 ELSE 0.0 END::DOUBLE AS score FROM nation""")
def resolver_match(spark, d):
    return read(spark, d, "nation").select("n_nationkey", "n_name", C.resolver_score(F.col("n_name"), F.col("n_nationkey").cast("string"), " 1 ").alias("score"))


@R.add("intent_match", """WITH w(workflow, pattern) AS (VALUES ('a', 'the '), ('a', 'anon'), ('b', 'lich')), m AS (SELECT conv_id, turn, workflow, min(pattern) AS pattern
    FROM conversations JOIN w ON contains(lower(text), pattern) WHERE role = 'user' GROUP BY ALL) SELECT conv_id, turn, workflow, pattern, 1.0::DOUBLE AS score FROM m""")
def intent_match(spark, d):
    flows = spark.createDataFrame([("a", ["the ", "anon"], "Active"), ("b", ["lich", ""], "Active"), ("c", ["e"], "Disabled")], "workflow string, patterns array<string>, status string")
    return C.intent_matches(read(spark, d, "conversations").where("role = 'user'"), flows).select("conv_id", "turn", "workflow", "pattern", "score")


@R.add("list_newest", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INTEGER AS place FROM orders")
def list_newest(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return read(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place"))


@R.add("entity_summaries", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_nationkey = 5 AND c_acctbal >= 0")
def entity_summaries(spark, d):
    return read(spark, d, "customer").where("c_nationkey = 5 AND c_acctbal >= 0").select("c_custkey", "c_name", "c_mktsegment")


_STORE = "SELECT doc_id::VARCHAR AS key, sha256(coalesce(text, '')) AS hash, length(text) AS n FROM documents WHERE doc_id IS NOT NULL"


@R.add("content_store", f"""WITH s AS ({_STORE}), a AS (SELECT key FROM s UNION ALL SELECT 'none' || page_id FROM pages)
  SELECT a.key, s.key IS NOT NULL AS found, CASE WHEN try_cast(a.key AS BIGINT) % 3 = 0 THEN sha256('again ' || a.key) ELSE hash END AS hash, CASE WHEN try_cast(a.key AS BIGINT) % 3 = 0 THEN 6 + length(a.key) ELSE n END AS n FROM a LEFT JOIN s ON a.key = s.key""")
def content_store(spark, d):
    """Every document is put twice, every third one then with another content; all keys and as many absent ones are asked."""
    root = scratch_path(spark, "contents")
    docs = read(spark, d, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").cast("string").alias("key"), F.coalesce("text", F.lit("")).alias("content"))
    content.put(docs, root)
    content.put(docs, root)
    content.put(docs.where("CAST(key AS LONG) % 3 = 0").withColumn("content", F.concat(F.lit("again "), "key")), root)
    asked = docs.select("key").unionByName(read(spark, d, "pages").select(F.concat(F.lit("none"), "page_id").alias("key")))
    return content.get(asked, root).select("key", "found", "hash", F.length("content").cast("long").alias("n"))


_READ = """WITH a AS (SELECT min(k) AS id FROM (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'P' ELSE ' p' END || l_partkey AS k FROM lineitem) GROUP BY lower(trim(k))),
  c AS (SELECT 'p' || p_partkey AS k, p_name AS v FROM part WHERE p_size < 10), s AS (SELECT 'P' || p_partkey AS k, p_brand AS v FROM part WHERE p_size BETWEEN 5 AND 30)
  SELECT id, CASE WHEN c.k IS NOT NULL THEN 'cached' WHEN s.k IS NOT NULL THEN 'stored' ELSE 'missing' END AS outcome, coalesce(c.v, s.v) AS value FROM a LEFT JOIN c ON lower(trim(id)) = c.k LEFT JOIN s ON lower(trim(id)) = lower(s.k)"""


@R.add("read_through", _READ)
def read_through(spark, d):
    return _through(spark, d)


@R.add("read_through_fills", f"SELECT id, value FROM ({_READ}) WHERE outcome = 'stored'")
def read_through_fills(spark, d):
    return I.cache_fills(_through(spark, d))


@R.add("read_through_failures", f"SELECT id FROM ({_READ}) WHERE outcome = 'missing'")
def read_through_failures(spark, d):
    return I.failures(_through(spark, d))


def _through(spark, d):
    asked = read(spark, d, "lineitem").select(F.concat(F.when(F.col("l_orderkey") % 2 == 0, "P").otherwise(" p"), "l_partkey").alias("id"))
    part = read(spark, d, "part")
    cached = part.where("p_size < 12").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.when(F.col("p_size") < 10, F.col("p_name")).otherwise(" ").alias("value"))
    stored = part.where("p_size BETWEEN 5 AND 30").select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_brand").alias("value"))
    return I.read_through(asked, cached, stored)


#: Filters of three levels, and what they mean.
_FILTERS = {
    "filter_nested": (
        {"must": [{"key": "p_size", "range": {"gte": 5, "lt": 40}}, {"should": [{"key": "p_brand", "match": {"any": ["Brand#11", "Brand#23", "Brand#5"]}}, {"must": [{"key": "p_name", "match": {"text": "widget"}}], "must_not": [{"key": "p_size", "match": {"value": 7}}]}]}],
         "must_not": [{"key": "p_type", "match": {"value": "ECONOMY"}}]},
        "p_size >= 5 AND p_size < 40 AND (p_brand IN ('Brand#11', 'Brand#23', 'Brand#5') OR (contains(p_name, 'widget') AND p_size <> 7)) AND coalesce(p_type <> 'ECONOMY', true)",
    ),
    "filter_tags": (
        {"must_not": [{"should": [{"key": "tags", "match": {"any": ["ring", "bolt"]}}, {"key": "tags", "match": {"text": "nu"}}]}], "must": [{"key": "p_size", "range": {"gt": 2}}]},
        "NOT (list_has_any(string_split(p_name, ' '), ['ring', 'bolt']) OR len(list_filter(string_split(p_name, ' '), lambda x: contains(x, 'nu'))) > 0) AND p_size > 2",
    ),
    "filter_except": ({"should": [{"key": "p_brand", "match": {"except": ["Brand#11", "Brand#22"]}}, {"must": [{"key": "p_size", "range": {"lte": 3}}, {}]}]}, "p_brand NOT IN ('Brand#11', 'Brand#22') OR p_size <= 3"),
}


def _filtered(name):
    def query(spark, d):
        part = read(spark, d, "part").withColumn("tags", F.split("p_name", " "))
        return part.where(V.compiled_filter(_FILTERS[name][0], dict(part.dtypes))).select("p_partkey")

    return query


for _name, (_, _where) in _FILTERS.items():
    R.add(_name, f"SELECT p_partkey FROM part WHERE {_where}")(_filtered(_name))


class _Folder:
    """A point store of the simplest kind: a file per request; it refuses requests of more than 50 points."""

    def __init__(self, folder: str):
        import pyarrow.fs

        self._fs, self._base = pyarrow.fs.FileSystem.from_uri(folder)
        self._fs.create_dir(self._base, recursive=True)

    def upsert(self, rows: list) -> None:
        if len(rows) > 50:
            raise points.TooLarge
        with self._fs.open_output_stream(f"{self._base}/{uuid.uuid4().hex}.json") as out:
            out.write("".join(json.dumps(r) + "\n" for r in rows).encode())


@R.add("point_sink", "SELECT vec_id AS id, label, len(embedding) AS dim FROM embeddings")
def point_sink(spark, d):
    """All vectors are sent to a store that refuses large requests, twice; the store holds each once."""
    folder = scratch_path(spark, "points")
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.size("embedding").alias("dim"))
    for _ in range(2):
        points.upsert(rows, lambda: _Folder(folder), 64)
    return spark.read.schema("id long, label int, dim long").json(folder).dropDuplicates(["id"])
