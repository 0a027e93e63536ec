"""Queries over sessions, key facts, lists, streams, time series and source code."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog
from ..operators import sessions as S
from ..operators.ranks import with_place
from ..sources import files
from ..streaming import incremental, sse
from .registry import Registry, read

R = Registry()


@R.add("turn_latest", """WITH a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p,
    count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, role, n::BIGINT AS n_turns, p AS previous_turn FROM a WHERE k = 1""")
def turn_latest(spark, d):
    return S.latest_turn(read(spark, d, "conversations")).select("conv_id", "turn", "role", "n_turns", "previous_turn")


@R.add("turn_prefix", "SELECT conv_id, turn, role FROM conversations WHERE turn <= conv_id % 3")
def turn_prefix(spark, d):
    turns = read(spark, d, "conversations")
    anchors = turns.select("conv_id").distinct().withColumn("anchor", F.col("conv_id") % 3)
    return S.turns_up_to(turns, anchors).select("conv_id", "turn", "role")


@R.add("loop_guard", """WITH n AS (SELECT event_id, event_type || ':' || props AS signature, row_number() OVER (PARTITION BY user_id, event_type || ':' || props ORDER BY ts, event_id)::INTEGER AS nth FROM events)
  SELECT *, CASE WHEN nth >= 3 THEN 'suppress' WHEN nth >= 2 THEN 'warn' ELSE 'none' END AS action FROM n""")
def loop_guard(spark, d):
    out = S.loop_guard(read(spark, d, "events"), "user_id", ["ts", "event_id"], F.concat_ws(":", "event_type", "props"))
    return out.select("event_id", "signature", "nth", "action")


@R.add("loop_guard_results", """WITH f AS (SELECT user_id, min({'t': ts, 'i': event_id}) AS first_at FROM events WHERE event_type = 'purchase' GROUP BY user_id),
  n AS (SELECT event_id, events.user_id, ts, event_type || ':{"a":' || (event_id % 3) || ',"Props":' || to_json(props) || '}' AS signature, row_number() OVER (PARTITION BY events.user_id, event_type, event_id % 3, props ORDER BY ts, event_id)::INTEGER AS nth FROM events)
  SELECT event_id, md5(signature) AS signature, nth, CASE WHEN first_at IS NULL OR {'t': ts, 'i': event_id} <= first_at THEN 'none' WHEN nth >= 3 THEN 'suppress' WHEN nth >= 2 THEN 'warn' ELSE 'none' END AS action FROM n LEFT JOIN f USING (user_id)""")
def loop_guard_results(spark, d):
    """Arguments come in two orders of their names, which make one call; nothing happens before a session's first result."""
    events = read(spark, d, "events")
    a, props = F.concat(F.lit('"a": '), F.col("event_id") % 3), F.concat(F.lit('"Props": '), F.to_json(F.struct("props")).substr(F.lit(10), F.length(F.to_json(F.struct("props"))) - 10))
    arguments = F.concat(F.lit("{"), F.when(F.col("event_id") % 2 == 0, F.concat(a, F.lit(" , "), props)).otherwise(F.concat(props, F.lit(","), a)), F.lit(" }"))
    calls = events.withColumn("arguments", arguments)
    out = S.loop_guard(calls, "user_id", ["ts", "event_id"], S.call_signature("event_type", "arguments"), result=F.col("event_type") == "purchase")
    return out.select("event_id", F.md5(F.col("signature").cast("binary")).alias("signature"), "nth", "action")


@R.add("repeat_counts", "SELECT event_type || ':' || props AS signature, count(*)::BIGINT AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def repeat_counts(spark, d):
    return read(spark, d, "events").groupBy(F.concat_ws(":", "event_type", "props").alias("signature")).agg(F.count("*").alias("n")).where("n > 1")


@R.add("kfr_active", """SELECT event_id, user_id, event_type, event_type NOT IN ('click', 'view') OR row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1 AS is_active FROM events""")
def kfr_active(spark, d):
    out = S.active_facts(read(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"], ["click", "view"])
    return out.select("event_id", "user_id", "event_type", "is_active")


@R.add("kfr_newest", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def kfr_newest(spark, d):
    return S.newest_per_key(read(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@R.add("reorder_items", """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r,
    count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem), m AS (SELECT *, r = 1 AS moved, least(3, n) AS goal FROM a)
  SELECT l_orderkey, l_linenumber, l_partkey, (10 * CASE WHEN moved THEN goal WHEN r <= goal THEN r - 1 ELSE r END)::INTEGER AS new_order FROM m""")
def reorder_items(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    items = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").withColumn("place", place)
    return S.move_item(items, "l_orderkey", "place", F.col("place") == 1, 3).select("l_orderkey", "l_linenumber", "l_partkey", "new_order")


@R.add("next_order", "SELECT l_orderkey, (max(l_linenumber) + 10)::INTEGER AS next_order FROM lineitem GROUP BY ALL")
def next_order(spark, d):
    return S.next_order(read(spark, d, "lineitem"), "l_orderkey", "l_linenumber").withColumn("next_order", F.col("next_order").cast("int"))


_SLUG_NAME = "CASE p_partkey % 5 WHEN 0 THEN '2' WHEN 1 THEN '2 2' WHEN 2 THEN '3' ELSE '' END"


@R.add("slug_unique", f"""WITH RECURSIVE a AS (SELECT p_partkey, 'w' || (p_partkey % 37) AS stem, 'w' || (p_partkey % 37) || CASE p_partkey % 5 WHEN 0 THEN '-2' WHEN 1 THEN '-2-2' WHEN 2 THEN '-3' ELSE '' END AS base FROM part),
    k AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY p_partkey) AS k FROM a),
    f AS (SELECT stem, p_partkey, k, base AS slug, [base] AS taken FROM k WHERE k = 1 UNION ALL
      SELECT stem, p_partkey, k, slug, list_append(taken, slug) FROM (SELECT k.stem, k.p_partkey, k.k, f.taken,
        CASE WHEN NOT list_contains(f.taken, k.base) THEN k.base ELSE k.base || '-' || list_min(list_filter(range(2, len(f.taken) + 3), lambda n: NOT list_contains(f.taken, k.base || '-' || n))) END AS slug
        FROM f JOIN k ON k.stem = f.stem AND k.k = f.k + 1))
  SELECT p_partkey, slug FROM f""")
def slug_unique(spark, d):
    """Names that end in numbers, so that some meet the suffixes of others."""
    named = read(spark, d, "part").select("p_partkey", F.concat_ws(" ", F.concat(F.lit("W"), F.col("p_partkey") % 37), F.expr(_SLUG_NAME)).alias("name"))
    return S.unique_slugs(named, "name", "p_partkey").select("p_partkey", "slug")


@R.add("checkpoint_list", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def checkpoint_list(spark, d):
    return S.newest(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 100)


@R.add("tool_reconcile", """WITH c AS (SELECT conv_id || ':' || (turn // 2) AS call_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1),
    r AS (SELECT conv_id || ':' || (turn // 2) AS call_id, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1)
  SELECT call_id, coalesce(c.n, 0)::BIGINT AS n_calls, coalesce(r.n, 0)::BIGINT AS n_results, CASE WHEN c.n IS NULL THEN 'unexpected' WHEN r.n IS NULL THEN 'missing'
    WHEN c.n > 1 OR r.n > 1 THEN 'duplicate' ELSE 'ok' END AS status FROM c FULL JOIN r USING (call_id)""")
def tool_reconcile(spark, d):
    turns = read(spark, d, "conversations").withColumn("call_id", F.concat_ws(":", "conv_id", F.floor(F.col("turn") / 2)))
    return S.reconcile_calls(turns.where("role = 'user'"), turns.where("role = 'assistant'"))


@R.add("knowledge_dedup", "SELECT lower(source) AS key, arg_min(source, doc_id) AS value, min(doc_id) AS first_at FROM documents GROUP BY lower(source)")
def knowledge_dedup(spark, d):
    return S.first_occurrences(read(spark, d, "documents"), F.col("source"), "doc_id")


@R.add("memory_recall", """SELECT event_id::VARCHAR AS note_id, event_type AS kind, value, NULL::VARCHAR AS details FROM events WHERE event_type = 'click' AND value >= 10 ORDER BY ts DESC, event_id::VARCHAR DESC LIMIT 50""")
def memory_recall(spark, d):
    e = read(spark, d, "events")
    notes = e.select(F.col("event_id").cast("string").alias("note_id"), F.array("event_type").alias("tags"), F.col("event_type").alias("kind"), F.col("value").alias("importance"), F.col("ts").alias("created"), F.col("props").alias("details"))
    return S.recall_notes(notes, tag="CLICK", kind="click", least=10, details=False).select("note_id", "kind", F.col("importance").alias("value"), "details")


@R.add("facts_by_tags", "SELECT event_id FROM events WHERE event_type IN ('click', 'error') AND value > 20")
def facts_by_tags(spark, d):
    facts = read(spark, d, "events").select("event_id", F.array("event_type").alias("tags"), (F.col("value") > 20).alias("is_active"))
    return S.facts_by_tags(facts, ["Click ", "error"]).select("event_id")


@R.add("session_refs", "SELECT conv_id, sum(len(string_split(text, chr(10))))::BIGINT AS n_lines, count(*)::BIGINT AS n_turns FROM conversations GROUP BY conv_id")
def session_refs(spark, d):
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.size(F.split("text", "\n", -1))).alias("n_lines"), F.count("*").alias("n_turns"))


@R.add("timeseries_split", """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS k, count(*) OVER () AS n FROM events)
  SELECT event_id, CASE WHEN k <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM r""")
def timeseries_split(spark, d):
    return S.split_ordinal(read(spark, d, "events").select("ts", "event_id"), ["ts", "event_id"]).select("event_id", "part")


@R.add("timeseries_naive", "SELECT event_id, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS forecast FROM events")
def timeseries_naive(spark, d):
    return S.naive_forecast(read(spark, d, "events"), "event_type", ["ts", "event_id"], "value").select("event_id", "value", "forecast")


@R.add("route_order", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey, length(p_name) DESC, p_name)::INTEGER AS place FROM part")
def route_order(spark, d):
    part = read(spark, d, "part").withColumn("length", F.length("p_name"))
    out = with_place(part, ["p_brand"], ["-p_size", "p_partkey", "-length", "p_name"])
    return out.select("p_partkey", F.col("place").cast("int").alias("place"))


@R.add("table_batches", "SELECT event_id, floor((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) / 100)::INTEGER AS batch FROM events")
def table_batches(spark, d):
    return files.in_batches(read(spark, d, "events"), "event_type", "event_id").select("event_id", "batch")


@R.add("typed_fields", """SELECT c_custkey, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'not a valid Enum' END AS segment_error,
    CASE WHEN TRY_CAST(c_name AS DOUBLE) IS NULL THEN 'not a valid Number' END AS name_error FROM customer""")
def typed_fields(spark, d):
    return read(spark, d, "customer").select("c_custkey", T.typed_check("c_mktsegment", "Enum", choices=["BUILDING", "MACHINERY"]).alias("segment_error"), T.typed_check("c_name", "Number").alias("name_error"))


@R.add("calculator", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity AS unit_price, l_extendedprice * l_tax AS tax FROM lineitem")
def calculator(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.calculate("div", "l_extendedprice", "l_quantity").alias("unit_price"), T.calculate("mul", "l_extendedprice", "l_tax").alias("tax"))


@R.add("windowed_events", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def windowed_events(spark, d):
    return incremental.windowed(read(spark, d, "events"))


@R.add("sse_assemble", """SELECT conv_id::VARCHAR AS stream_id, string_agg(role || ';', '' ORDER BY turn) AS text, '{"id":"r' || conv_id || '"}' AS response FROM conversations GROUP BY conv_id""")
def sse_assemble(spark, d):
    turns = read(spark, d, "conversations")
    delta = F.concat(F.lit('data: {"type":"response.output_text.delta","delta":"'), "role", F.lit(';"}'))
    rows = turns.select(F.col("conv_id").cast("string").alias("stream_id"), (F.col("turn") * 10).alias("n"), F.explode(F.array(F.lit("event: response.output_text.delta"), delta, F.lit(""))).alias("line"))
    rows = rows.withColumn("n", F.col("n") + F.when(F.startswith("line", F.lit("event")), 0).when(F.col("line") == "", 2).otherwise(1))
    last = turns.select(F.col("conv_id").cast("string").alias("stream_id"), F.lit(1_000_000).cast("long").alias("n"),
                        F.concat(F.lit('data: {"type":"response.completed","response":{"id":"r'), "conv_id", F.lit('"}}')).alias("line")).distinct()
    found = sse.events(rows.unionByName(last))
    return sse.assembled(found).join(sse.completed(found), "stream_id")


@R.add("transcript_cap")
def transcript_cap(spark, d):
    turns = read(spark, d, "documents").select("doc_id", F.col("source").alias("instructions"), F.col("text").alias("answer"))
    out = files.capped_record(turns, 2000)
    return out.select("doc_id", F.octet_length("answer").alias("n_bytes"), F.octet_length(F.to_json(F.struct("doc_id", "instructions", "answer"))).alias("record_bytes"))


@R.add("chapters_edit", """SELECT source, coalesce((SELECT string_agg(CASE WHEN i % 2 = 0 THEN i || ':Approved' ELSE i || ':Draft' END, ',' ORDER BY i) FROM (SELECT DISTINCT doc_id // 20 % 5 AS i FROM documents x WHERE x.source = s.source) WHERE i <> 3), '') AS chapters
  FROM (SELECT DISTINCT source FROM documents) s""")
def chapters_edit(spark, d):
    each = F.struct((F.floor(F.col("doc_id") / 20) % 5).alias("id"), F.lit("Draft").alias("status"))
    docs = read(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_set(each)).alias("chapters"))
    out = S.without_element(S.with_element(docs, "chapters", lambda c: c["id"] % 2 == 0, {"status": F.lit("Approved")}), "chapters", lambda c: c["id"] == 3)
    return out.select("source", F.array_join(F.transform("chapters", lambda c: F.concat_ws(":", c["id"], c["status"])), ",").alias("chapters"))


@R.add("supplier_votes", "WITH n AS (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_orderkey, arg_min(l_suppkey, (-n, l_suppkey)) AS l_suppkey, max(n)::BIGINT AS n FROM n GROUP BY l_orderkey")
def supplier_votes(spark, d):
    return catalog.most_frequent(read(spark, d, "lineitem"), "l_orderkey", "l_suppkey")
