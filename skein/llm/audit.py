"""Audit of how filters interact: what each removes in each order, alone, redundantly and at what cost.

A row fails a set of filters: a mask with one bit per filter.  All that the audit needs of the corpus are counts by part and
mask, so rows are added up into mask cells first: at most 2 ** k of them in a part.  The rest is long-form window evaluation:
each cell is unpivoted against the steps of all k! orders; a running bit-or over the steps before tells whether the cell was
removed earlier; conditional sums over the cells of a step give its counts, and a window over all steps of a filter gives its
total.  A part's long form has at most 2 ** k * k! * k rows (19,200 for five filters), however many rows the part has.

Equal texts are told apart by SHA-256.  A row is a repeat if some row of the same text has a smaller doc_id.  Rows of one text
are added up by (text, part, labels) before the least ids of a text meet, so thousands of copies are a few rows there.

Defined cases: a null text is empty; a null source is the part of the empty string; a null doc_id is neither smaller nor
greater than another, so it is no repeat and makes none, and it has no labels; rows with equal doc_id and text are no repeats
of each other; a doc_id with several label rows has each label that one of them has; a null label counts as 0; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table

FILTERS = "ABCDE"
#: Orders grow with the factorial of the number of filters.
MOST_FILTERS = 6
REPEAT = FILTERS.index("E")


def text_mask(text: Column) -> Column:
    """The bits of the filters that look at a text alone: A few words, B few distinct words, C capitals, D symbols."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 0)
    fails = (
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        text.rlike("[#$%&*|]"),
    )
    return sum((F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def document_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: the rows of docs (doc_id, text, source) by the filters A to E they fail; labels has doc_id, quality, toxic."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("mask"))
    rows = rows.groupBy("doc_id", "digest", "part").agg(F.max("mask").alias("mask"), F.count("*").alias("n"))
    # rows without an id would all meet in one task of the join
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.crc32("digest")).otherwise(F.lit(0).cast("long")))
    one = lambda c: F.max((F.col(c) == 1).cast("int"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    known = materialize(known, "audit_labels").withColumn("salt", F.lit(0).cast("long"))
    rows = rows.join(known, ["doc_id", "salt"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    # of each text, the rows of one part and label: how many, and how many have the least id
    same = rows.groupBy("digest", "part", "good", "toxic").agg(
        F.max("mask").alias("mask"), F.sum("n").alias("n"), F.min("doc_id").alias("least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
        F.min_by("n", "doc_id").alias("n_least"),
    )
    least = F.min("least").over(Window.partitionBy("digest"))
    first = F.col("no_id") + F.when(F.col("least") == least, F.col("n_least")).otherwise(0)
    same = same.withColumn("first", first)
    cells = same.select("part", "good", "toxic", F.inline(F.array(
        F.struct(F.col("mask").alias("mask"), F.col("first").alias("n")),
        F.struct((F.col("mask") + (1 << REPEAT)).alias("mask"), (F.col("n") - F.col("first")).alias("n")),
    ))).where("n > 0")
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step; cells has part, mask, n, good, toxic, bit i of mask for filter i."""
    if not 1 <= len(filters) <= MOST_FILTERS or len(set(filters)) < len(filters):
        raise ValueError(f"1 to {MOST_FILTERS} filters of different letters")
    orders = [""]
    for _ in filters:
        orders = [o + f for o in orders for f in filters if f not in o]
    bit = F.call_function("shiftleft", F.lit(1), F.call_function("instr", F.lit(filters), F.col("filter")) - 1)
    long = (
        cells.repartition("part")
        .withColumn("filter_order", F.explode(F.split(F.lit(" ".join(orders)), " ")))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
        .withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
        .withColumn("own", F.col("mask").bitwiseAND(bit))
    )
    before = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("own").over(before), F.lit(0)))
    fails, gone = F.col("own") > 0, F.col("earlier") > 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).alias
    steps = long.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & ~gone)("kept"), total(fails & ~gone)("removed"), total(fails & gone)("redundant"),
        total(fails & (F.col("mask") == F.col("own")))("unique_fails"),
        total(fails & ~gone, "good")("good_lost"), total(fails & ~gone, "toxic")("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, five filters in all 120 orders, by source."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return audit(document_cells(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")))


QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLE_SQL = {
    "op12_filter_audit": r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM texts GROUP BY t),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
          FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * length(regexp_replace(texts.t, '[^A-Z]+', '', 'g')) > 2 * length(texts.t) AS c,
         regexp_matches(texts.t, '[#$%&*|]') AS d, coalesce(texts.doc_id > least, false) AS e
  FROM texts JOIN firsts ON texts.t = firsts.t LEFT JOIN known ON texts.doc_id = known.doc_id),
cells AS (
  SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY ALL),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE length(replace(replace(replace(replace(replace('ABCDE', p.x, ''), q.x, ''), r.x, ''), s.x, ''), t.x, '')) = 0),
steps AS (SELECT filter_order, s.step, substr(filter_order, s.step, 1) AS f FROM orders, (VALUES (1), (2), (3), (4), (5)) s(step)),
long AS (
  SELECT part, filter_order, step, f, n, good, toxic, (a::int + b::int + c::int + d::int + e::int) AS fails_all,
         CASE f WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails,
         (a AND instr(substr(filter_order, 1, step - 1), 'A') > 0) OR (b AND instr(substr(filter_order, 1, step - 1), 'B') > 0)
         OR (c AND instr(substr(filter_order, 1, step - 1), 'C') > 0) OR (d AND instr(substr(filter_order, 1, step - 1), 'D') > 0)
         OR (e AND instr(substr(filter_order, 1, step - 1), 'E') > 0) AS gone
  FROM cells, steps),
sums AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::bigint AS kept,
         sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::bigint AS removed,
         sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::bigint AS redundant,
         sum(CASE WHEN fails AND fails_all = 1 THEN n ELSE 0 END)::bigint AS unique_fails,
         sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END)::bigint AS good_lost,
         sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END)::bigint AS toxic_lost
  FROM long GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::int AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::bigint AS shapley
FROM sums
""",
}
