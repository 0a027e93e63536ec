"""Incremental ingestion: what to index, what to delete, keyed merges and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, normalize_index_path, trim_white


def hash_changed(stored: Column, active: Column) -> Column:
    """Both hashes are known and differ."""
    return stored.isNotNull() & (stored != "") & active.isNotNull() & (active != "") & (stored != active)


def plan_ingest(discovered: DataFrame, index: DataFrame, skip_unchanged: bool = False) -> DataFrame:
    """path, action for the full outer join of discovered (path, content_hash) and index (path, doc_id, content_hash, reindex).

    New files get `full`; known ones their stored flag or `chunk`; `delete` names index rows whose file is gone.  With
    skip_unchanged, known files without a flag whose hash is the same get `skip`.  Paths compare by their normal form.
    """
    d = discovered.select(normalize_index_path("path").alias("key"), F.col("path").alias("d_path"), F.col("content_hash").alias("d_hash"))
    i = index.select(
        normalize_index_path("path").alias("key"), F.col("path").alias("i_path"), "doc_id", F.col("content_hash").alias("i_hash"), "reindex"
    )
    flag = F.nullif(trim_white(F.col("reindex")), F.lit(""))
    known = F.coalesce(flag, F.lit("chunk"))
    if skip_unchanged:
        known = F.when(flag.isNull() & (F.col("d_hash") == F.col("i_hash")), "skip").otherwise(known)
    action = F.when(F.col("d_path").isNull(), "delete").when(F.col("i_path").isNull(), "full").otherwise(known)
    changed = F.coalesce(hash_changed(F.col("i_hash"), F.col("d_hash")), F.lit(False))
    return d.join(i, "key", "full_outer").select(
        F.coalesce("d_path", "i_path").alias("path"), "doc_id", action.alias("action"), changed.alias("hash_changed")
    )


def plan_deletes(discovered: DataFrame, index: DataFrame) -> DataFrame:
    """Index rows whose file was not discovered."""
    seen = discovered.select(normalize_index_path("path").alias("__key")).distinct()
    return index.withColumn("__key", normalize_index_path("path")).join(seen, "__key", "left_anti").drop("__key")


def merge_by_key(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Upsert: rows of new, and those of old whose key is not in new."""
    keys = [key] if isinstance(key, str) else key
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_documents(points: DataFrame, fresh: DataFrame, doc: str = "doc_id") -> DataFrame:
    """All points of the documents in fresh give way to those of fresh."""
    return merge_by_key(points, fresh, doc)


def delete_by(points: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """points without the trimmed, distinct keys of ids."""
    gone = ids.select(F.trim(F.col(key).cast("string")).alias("__gone")).where("__gone <> ''").distinct()
    return points.join(gone, F.col(key).cast("string") == F.col("__gone"), "left_anti")


def distinct_facets(df: DataFrame, columns: list[str], first: str) -> DataFrame:
    """One row per combination of the columns ignoring case, in the casing of the least `first`."""
    keys = {f"__{c}": F.lower(c) for c in columns}
    chosen = df.withColumns(keys).groupBy(*keys).agg(F.min_by(F.struct(*columns), first).alias("s"), F.count("*").alias("n"))
    return chosen.select("s.*", "n")


def first_wins(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key; a window keeps one row per key and drops the rest in place."""
    n = F.row_number().over(Window.partitionBy("__key").orderBy(*order))
    return df.withColumn("__key", key).withColumn("__n", n).where("__n = 1").drop("__key", "__n")


def duplicates(df: DataFrame, key: Column, identity: str) -> DataFrame:
    """Keys that occur twice or more: key, n, first_id."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(identity).alias("first_id")).where("n > 1")


def read_through(asked: DataFrame, cached: DataFrame, stored: DataFrame, key: str = "id", value: str = "value") -> DataFrame:
    """key, outcome (cached, stored or missing) and value for each asked key, by one shuffle of each side.

    Keys compare ignoring case, blank ones are not asked, repeated ones are one, in their least spelling.  A cached value that
    is blank is no answer; a stored row is one even if its value is null.  `stored` rows fill the cache, `missing` ones are failures.
    """
    of = lambda df, what, v: df.select(F.lower(trim_white(F.col(key).cast("string"))).alias("__k"), F.lit(what).alias("__of"), F.col(key).cast("string").alias("__key"), v.alias("__value"))
    nothing = F.lit(None).cast("string")
    rows = of(asked, "asked", nothing).unionByName(of(cached, "cached", F.when(~is_blank(value), F.col(value)))).unionByName(of(stored, "stored", F.col(value).cast("string")))
    side = lambda what, c: F.min(F.when(F.col("__of") == what, c))
    met = rows.where(~is_blank("__k")).groupBy("__k").agg(
        side("asked", F.col("__key")).alias(key), side("cached", F.col("__value")).alias("c"), side("stored", F.col("__value")).alias("s"), F.max(F.col("__of") == "stored").alias("kept"))
    outcome = F.when(F.col("c").isNotNull(), "cached").when(F.col("kept"), "stored").otherwise("missing")
    return met.where(F.col(key).isNotNull()).select(key, outcome.alias("outcome"), F.coalesce("c", "s").alias(value))


def cache_fills(answers: DataFrame, value: str = "value") -> DataFrame:
    """The answers that the store gave and the cache lacks: only those with a value."""
    return answers.where((F.col("outcome") == "stored") & ~is_blank(value)).drop("outcome")


def failures(answers: DataFrame, key: str = "id") -> DataFrame:
    """The keys that neither side has."""
    return answers.where("outcome = 'missing'").select(key)
