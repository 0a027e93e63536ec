"""Queries over vectors and their content."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as V
from ..operators.retrieval import Condition
from .registry import Registry, read
from .text_queries import _tokens, _trim

R = Registry()
_COS = """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1),
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings{where}),
s AS (SELECT vec_id, label, list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) AS score FROM e, q),
t AS (SELECT * FROM s ORDER BY score DESC NULLS LAST, vec_id LIMIT 24)"""
_DIVERSE = _COS.format(where="") + """,
f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS k FROM t),
r AS (SELECT vec_id, label, score, row_number() OVER (ORDER BY score DESC, vec_id)::INTEGER AS rank FROM f WHERE k = 1 ORDER BY rank LIMIT 8)"""


def _scored(spark, d, test=None):
    points = read(spark, d, "embeddings")
    query = points.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    return V.with_score(points.where(test) if test is not None else points, query)


@R.add("vector_topk", _COS.format(where="") + " SELECT vec_id, round(score, 6) AS score FROM t")
def vector_topk(spark, d):
    return V.top_k(_scored(spark, d), V.fetch_limit(8)).select("vec_id", F.round("score", 6).alias("score"))


@R.add("vector_topk_scoped", _COS.format(where=" WHERE label IN (1, 2, 3, 4) AND label NOT IN (2)") + " SELECT vec_id, label, round(score, 6) AS score FROM t")
def vector_topk_scoped(spark, d):
    test = V.scope_filter([Condition("label", "IsEquals", [1, 2, 3, 4, 4]), Condition("label", "NotEquals", [2]), Condition("label", "Contains", ["", None])])
    return V.top_k(_scored(spark, d, test), 24).select("vec_id", "label", F.round("score", 6).alias("score"))


@R.add("vector_filter_tree", _COS.format(where=" WHERE (label BETWEEN 2 AND 6 OR label = 9) AND NOT label = 4") + " SELECT vec_id, label, round(score, 6) AS score FROM t")
def vector_filter_tree(spark, d):
    test = V.filter_tree(should=[F.col("label").between(2, 6), F.col("label") == 9], must_not=[F.col("label") == 4])
    return V.top_k(_scored(spark, d, test), 24).select("vec_id", "label", F.round("score", 6).alias("score"))


@R.add("vector_diverse", _DIVERSE + " SELECT vec_id, label, round(score, 6) AS score, rank FROM r")
def vector_diverse(spark, d):
    out = V.diverse(V.top_k(_scored(spark, d), 24), F.col("label"))
    return out.select("vec_id", "label", F.round("score", 6).alias("score"), "rank")


@R.add("retrieve_context", _DIVERSE + f""" SELECT rank, vec_id, round(score, 6) AS score, {_tokens('text')} AS tokens, lang FROM r JOIN documents ON doc_id = vec_id WHERE {_trim('text')} <> ''""")
def retrieve_context(spark, d):
    hits = V.diverse(V.top_k(_scored(spark, d), 24), F.col("label")).select("rank", "vec_id", "score")
    out = V.with_content(hits, read(spark, d, "documents").select("doc_id", "text", "lang"), "vec_id", "doc_id")
    return out.select("rank", "vec_id", F.round("score", 6).alias("score"), V.token_estimate().alias("tokens"), "lang")


_EACH = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings{where}),
s AS (SELECT query_id, vec_id, label, list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) AS score FROM e, q),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, vec_id) <= 24)"""
_DIVERSE_EACH = _EACH.format(where="") + """,
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS k FROM t),
r AS (SELECT query_id, vec_id, label, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM f WHERE k = 1 QUALIFY rank <= 8)"""


def _best_each(spark, d, test=None):
    """The 24 best points for each row whose vec_id is divisible by 100."""
    points = read(spark, d, "embeddings")
    queries = points.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return V.top_k_each(points.where(test) if test is not None else points, queries, V.fetch_limit(8))


@R.add("vector_topk_each", _EACH.format(where="") + " SELECT query_id, vec_id, round(score, 6) AS score FROM t")
def vector_topk_each(spark, d):
    return _best_each(spark, d).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@R.add("vector_topk_scoped_each", _EACH.format(where=" WHERE label IN (1, 2, 3, 4) AND label NOT IN (2)") + " SELECT query_id, vec_id, label, round(score, 6) AS score FROM t")
def vector_topk_scoped_each(spark, d):
    test = V.scope_filter([Condition("label", "IsEquals", [1, 2, 3, 4, 4]), Condition("label", "NotEquals", [2]), Condition("label", "Contains", ["", None])])
    return _best_each(spark, d, test).withColumn("score", F.round("score", 6))


@R.add("vector_filter_tree_each", _EACH.format(where=" WHERE (label BETWEEN 2 AND 6 OR label = 9) AND NOT label = 4") + " SELECT query_id, vec_id, label, round(score, 6) AS score FROM t")
def vector_filter_tree_each(spark, d):
    test = V.filter_tree(should=[F.col("label").between(2, 6), F.col("label") == 9], must_not=[F.col("label") == 4])
    return _best_each(spark, d, test).withColumn("score", F.round("score", 6))


@R.add("vector_diverse_each", _DIVERSE_EACH + " SELECT query_id, vec_id, label, round(score, 6) AS score, rank FROM r")
def vector_diverse_each(spark, d):
    return V.diverse_each(_best_each(spark, d), F.col("label")).withColumn("score", F.round("score", 6))


@R.add("retrieve_context_each", _DIVERSE_EACH + f""" SELECT query_id, rank, vec_id, round(score, 6) AS score, {_tokens('text')} AS tokens, lang FROM r JOIN documents ON doc_id = vec_id WHERE {_trim('text')} <> ''""")
def retrieve_context_each(spark, d):
    hits = V.diverse_each(_best_each(spark, d), F.col("label")).select("query_id", "rank", "vec_id", "score")
    docs = read(spark, d, "documents").where(~T.is_blank("text")).select("doc_id", V.token_estimate().alias("tokens"), "lang")
    return docs.join(hits, F.col("doc_id") == F.col("vec_id")).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"), "tokens", "lang")


@R.add("context_block", """WITH a AS (SELECT lang, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents)
  SELECT lang, string_agg('[R' || n || '] ' || text, chr(10) ORDER BY n) AS block FROM a WHERE n <= 5 GROUP BY lang""")
def context_block(spark, d):
    return V.context_block(read(spark, d, "documents"), "lang", "doc_id")
