"""Vector retrieval: payload filters, cosine top-k, diverse selection, context assembly."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions.text import cosine, estimate_tokens, is_blank
from ..storage import materialize

KEEP = 8
#: Points and queries that are scored at once, and queries whose scores are summed together.
POINT_BLOCK, QUERY_BLOCK, _STRIP = 4096, 1024, 64


def fetch_limit(k: int = KEEP) -> int:
    """How many points to fetch so that k different ones remain."""
    return min(max(3 * k, 12), 50)


@dataclass(frozen=True)
class Condition:
    """key, operator (IsEquals, NotEquals, Contains, DoesNotContain) and values."""

    key: str
    operator: str
    values: Sequence


def scope_filter(conditions: Sequence[Condition], schema: dict[str, str] | None = None) -> Column | None:
    """All conditions together; blank and repeated values are dropped, conditions without values are skipped.

    Nulls follow SQL: a row whose key is null matches neither a condition nor its negation.  Array columns match if they
    overlap the values; schema (df.dtypes) tells which they are.
    """
    tests = []
    for c in conditions:
        kept = {}
        for v in c.values:
            if v is not None and str(v).strip():
                kept.setdefault(str(v).strip().lower(), v.strip() if isinstance(v, str) else v)
        values = list(kept.values())
        if c.operator not in ("IsEquals", "NotEquals", "Contains", "DoesNotContain"):
            raise ValueError(f"unknown operator {c.operator}")
        if not values:
            continue
        array = (schema or {}).get(c.key, "").startswith("array")
        hit = F.arrays_overlap(F.col(c.key), F.array(*map(F.lit, values))) if array else F.col(c.key).isin(values)
        tests.append(hit if c.operator in ("IsEquals", "Contains") else ~hit)
    return reduce(lambda a, b: a & b, tests) if tests else None


def filter_tree(must: Sequence[Column] = (), should: Sequence[Column] = (), must_not: Sequence[Column] = ()) -> Column:
    """All of must, one of should if there is any, none of must_not."""
    parts = [*must, *[~c for c in must_not]]
    if should:
        parts.append(reduce(lambda a, b: a | b, should))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def compiled_filter(spec: dict, schema: dict[str, str]) -> Column:
    """A filter as a column: {"must": [..], "should": [..], "must_not": [..]} of conditions or of filters again, to any depth.

    A condition names a `key` and has a `match` (value, any, except or text, which is a part of the value) or a `range` (gte, gt,
    lte, lt); an array column matches if one of its values does.  schema (dict(df.dtypes)) has the columns.  A filter without
    conditions holds for every row; a row whose key is null meets no condition, and so passes must_not.  An unknown key, or a
    condition that says nothing, is an error.  Leaves are plain comparisons, so those under must reach the scan.
    """
    known = {"must", "should", "must_not"}
    if set(spec) & known or not spec:
        if set(spec) - known:
            raise ValueError(f"unknown parts of a filter: {sorted(set(spec) - known)}")
        parts = {k: [compiled_filter(c, schema) for c in spec.get(k) or []] for k in known}
        tests = [*parts["must"], *[~F.coalesce(c, F.lit(False)) for c in parts["must_not"]]]
        if parts["should"]:
            tests.append(reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in parts["should"]]))
        return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)
    key = spec.get("key")
    if key not in schema:
        raise ValueError(f"no column {key}")
    c, many = F.col(f"`{key}`"), schema[key].startswith("array")
    each = lambda test: F.exists(c, test) if many else test(c)
    among = lambda values: lambda x: x.isin(list(values))
    holding = lambda part: lambda x: F.contains(x, F.lit(part))
    match, limits = spec.get("match") or {}, spec.get("range") or {}
    tests = []
    for how, value in match.items():
        if value is None:
            continue
        if how == "value":
            tests.append(F.array_contains(c, value) if many else c == value)
        elif how == "any":
            tests.append(each(among(value)))
        elif how == "except":
            tests.append(~each(among(value)))
        elif how == "text":
            tests.append(each(holding(value)))
        else:
            raise ValueError(f"unknown match {how}")
    compare = {"gte": lambda x, v: x >= v, "gt": lambda x, v: x > v, "lte": lambda x, v: x <= v, "lt": lambda x, v: x < v}
    if set(limits) - set(compare):
        raise ValueError(f"unknown limits {sorted(set(limits) - set(compare))}")
    found = [(how, v) for how, v in limits.items() if v is not None]
    if found:
        tests.append(each(lambda x: reduce(lambda a, b: a & b, [compare[how](x, v) for how, v in found])))
    if not tests:
        raise ValueError(f"the condition on {key} says nothing")
    return reduce(lambda a, b: a & b, tests)


def with_embedding(df: DataFrame, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]], dim: int, text: str = "text") -> DataFrame:
    """df with `embedding` from a plug-in that maps a batch of texts to vectors of dim numbers; another length is an error."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        vectors = list(embed(texts.fillna("").tolist()))
        if any(len(v) != dim for v in vectors):
            raise ValueError(f"a vector is not of {dim} numbers")
        return pd.Series(vectors)

    return df.withColumn("embedding", run(F.col(text)))


def with_score(points: DataFrame, query: Sequence[float] | DataFrame, vector: str = "embedding") -> DataFrame:
    """points with the cosine score against a literal vector, or the vector `q` of a one-row DataFrame."""
    if isinstance(query, DataFrame):
        return points.crossJoin(F.broadcast(query.select("q").limit(1))).withColumn("score", cosine(vector, "q")).drop("q")
    return points.withColumn("score", cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])))


def top_k(scored: DataFrame, k: int, tie: str = "vec_id") -> DataFrame:
    """The k best by score, ties by id: partial top-k in each partition, one small merge."""
    return scored.orderBy(F.desc_nulls_last("score"), F.asc(tie)).limit(k)


def _scores(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosines of all pairs, products summed in the order of the numbers, so that equal vectors have equal scores."""
    out, norms = np.empty((len(queries), len(points))), [np.zeros(len(points)), np.zeros(len(queries))]
    for norm, x in zip(norms, (points, queries), strict=True):
        for j in range(x.shape[1]):
            norm += x[:, j] * x[:, j]
    columns = np.ascontiguousarray(points.T)
    for at in range(0, len(queries), _STRIP):
        part = queries[at : at + _STRIP]
        dots = np.zeros((len(part), len(points)))
        for j, column in enumerate(columns):
            dots += part[:, j, None] * column
        below = np.sqrt(norms[1][at : at + _STRIP, None]) * np.sqrt(norms[0])
        out[at : at + _STRIP] = np.divide(dots, below, out=np.full(dots.shape, np.nan), where=below > 0)
    return out


def _query_blocks(queries: DataFrame) -> Iterator[tuple[list, list]]:
    """Ids and vectors of queries in turns of at most QUERY_BLOCK; the driver holds one turn."""
    ids, vectors = [], []
    for r in queries.select("query_id", F.col("q").cast("array<double>").alias("q")).toLocalIterator():
        ids.append(r["query_id"])
        vectors.append(r["q"])
        if len(ids) == QUERY_BLOCK:
            yield ids, vectors
            ids, vectors = [], []
    if ids:
        yield ids, vectors


def _nearest(part: pd.DataFrame, ids: list, vectors: list, k: int) -> pd.DataFrame:
    """The k best rows of a part of the points (key, label, v) for each query, ties by key."""
    places, scores, asked = [], [], []
    part = part.sort_values("key", kind="stable").reset_index(drop=True)
    sizes = part["v"].map(lambda v: -1 if v is None else len(v)).to_numpy()
    wanted = np.array([-1 if v is None else len(v) for v in vectors])
    for size in np.unique(wanted):
        rows, like = np.flatnonzero(wanted == size), np.flatnonzero(sizes == size)
        score = np.full((len(rows), len(part)), np.nan)
        if size > 0 and len(like):
            score[:, like] = _scores(np.stack(part["v"].to_numpy()[like]), np.array([vectors[i] for i in rows], float))
        for row, values in zip(rows, score, strict=True):
            down = np.where(np.isnan(values), np.inf, -values)
            near = np.arange(len(down))
            if len(down) > k:  # all as good as the k-th, then by key
                near = np.flatnonzero(down <= np.partition(down, k - 1)[k - 1])
            chosen = near[np.argsort(down[near], kind="stable")[:k]]
            asked += [row] * len(chosen)
            places += chosen.tolist()
            scores += values[chosen].tolist()
    found = part.iloc[places]
    return pd.DataFrame({"asked": asked, "key": found["key"].array, "label": found["label"].array, "score": scores})


def top_k_each(points: DataFrame, queries: DataFrame, k: int, label: str = "label", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, key, label, score: for each of queries (query_id, q) the k best of points by cosine, ties by key.

    Points stay where they lie: blocks of at most QUERY_BLOCK queries are broadcast in turns, each task keeps the k best of its
    own points for each query of a block, and only these move to be merged.  A null vector, one that is all zero or of another
    length than the query has a null score and comes last; query_id and key are ids without repeats and not null.
    """
    own = points.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    types = {f.name: f.dataType.simpleString() for f in own.schema} | {"query_id": queries.schema["query_id"].dataType.simpleString()}
    schema = f"query_id {types['query_id']}, `{key}` {types['key']}, `{label}` {types['label']}, score double"
    context, found = points.sparkSession.sparkContext, None
    for n, block in enumerate(_query_blocks(queries)):
        sent = context.broadcast(block)

        def best(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            (ids, vectors), held = sent.value, None
            for pdf in frames:
                for at in range(0, len(pdf), POINT_BLOCK):
                    near = _nearest(pdf.iloc[at : at + POINT_BLOCK], ids, vectors, k)
                    held = near if held is None else pd.concat([held, near], ignore_index=True)
                    held = held.sort_values(["asked", "score", "key"], ascending=[True, False, True], na_position="last", kind="stable").groupby("asked").head(k)
            if held is not None and len(held):
                score = pd.array([None if np.isnan(x) else x for x in held["score"]], dtype="Float64")
                yield pd.DataFrame({"query_id": [ids[i] for i in held["asked"]], key: held["key"].array, label: held["label"].array, "score": score})

        some = own.mapInPandas(best, schema)
        if n:
            some = materialize(some, "nearest")  # the plan does not grow with the number of blocks' scans
        found = some if found is None else found.unionByName(some)
    if found is None:
        return points.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), F.asc(key))
    return found.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).drop("__n")


def diverse_each(best: DataFrame, key: Column, k: int = KEEP, tie: str = "vec_id") -> DataFrame:
    """`diverse` for each query_id."""
    order = [F.desc_nulls_last("score"), F.asc(tie)]
    keyed = best.withColumn("__key", F.lower(key.cast("string"))).where("__key IS NOT NULL")
    first = keyed.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "__key").orderBy(*order))).where("__n = 1")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).drop("__key", "__n")


def diverse(best: DataFrame, key: Column, k: int = KEEP, tie: str = "vec_id") -> DataFrame:
    """The first row of each key (ignoring case; null keys are skipped) in order of score, k at most, with its rank.

    best is the output of a limit, so one partition holds it.
    """
    order = [F.desc_nulls_last("score"), F.asc(tie)]
    keyed = best.withColumn("__key", F.lower(key.cast("string"))).where("__key IS NOT NULL")
    first = keyed.withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy(*order))).where("__n = 1")
    ranked = first.orderBy(*order).limit(k)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("__key", "__n")


#: Hits that are looked up by their ids at most.
MOST_HITS = 1000


def with_content(hits: DataFrame, contents: DataFrame, hit_key: str, content_key: str, text: str = "text") -> DataFrame:
    """hits with their text; hits whose text is missing or blank are dropped.

    Hits are few by their limit: up to MOST_HITS become a filter on ids that reaches the files of the contents, so that no
    other text is read; more of them are joined.
    """
    few = hits.limit(MOST_HITS + 1).collect()
    if len(few) > MOST_HITS:
        return contents.where(~is_blank(text)).join(hits, F.col(content_key) == F.col(hit_key))
    hits = hits.sparkSession.createDataFrame(few, hits.schema)
    contents = contents.where(F.col(content_key).isin([r[hit_key] for r in few]))
    return contents.where(~is_blank(text)).join(F.broadcast(hits), F.col(content_key) == F.col(hit_key))


def context_block(rows: DataFrame, group: str, order: str, text: str = "text", most: int = 5) -> DataFrame:
    """Numbered exhibits [R1], [R2] .. of each group's first rows, joined into one text."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    first = rows.withColumn("__n", n).where(F.col("__n") <= most)
    entry = F.struct(F.col("__n").alias("n"), F.concat(F.lit("[R"), F.col("__n"), F.lit("] "), F.col(text)).alias("t"))
    return first.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["t"]), "\n").alias("block"))


def token_estimate(text: str = "text") -> Column:
    return estimate_tokens(text)
