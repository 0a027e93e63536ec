"""A content store in files: contents are kept once by their hash, keys lead to hashes through an index.

Below the root lie `blobs/p=<digit of the hash>` (hash, content) and `index/p=<digit of the key's hash>` (key, hash, version), in files
in order of the hash or key.  A put writes only what is not there yet, and appends its keys; a get reads the index partitions of the
asked keys, then the blob partitions of their hashes, and of their files what the bounds of their row groups leave.

Defined cases: of several contents put under a key the one of the last put counts, and in one put that of the greatest hash; a null
content is kept as null, a null key is an error; a key that was never put comes back with `found` false; equal contents of many
keys are one blob; a put that is tried again adds nothing to the blobs and gives the same answers.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize

_BLOBS, _INDEX = "hash string, content string, p string", "key string, hash string, version long, p string"


def _part(c: Column | str) -> Column:
    return F.substring(F.sha2(c if isinstance(c, Column) else F.col(c), 256), 1, 1)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing was put yet
        return spark.createDataFrame([], schema)


def put(contents: DataFrame, root: str, key: str = "key", content: str = "content") -> DataFrame:
    """Stores contents by key; returns key and hash.  A blob that is there already is not written again."""
    spark = contents.sparkSession
    named = F.when(F.col(key).isNull(), F.raise_error(F.lit("a content needs a key"))).otherwise(F.col(key).cast("string"))
    rows = contents.select(named.alias("key"), F.coalesce(F.sha2(content, 256), F.lit("0" * 64)).alias("hash"), F.col(content).alias("content"))
    keys = materialize(rows.groupBy("key").agg(F.max("hash").alias("hash")), "content_keys")
    known = _table(spark, f"{root}/blobs", _BLOBS).where(F.col("content").isNotNull()).select("hash")
    fresh = rows.where("content IS NOT NULL").join(keys.select("hash").distinct(), "hash", "left_semi").join(known, "hash", "left_anti")
    fresh = fresh.groupBy("hash").agg(F.first("content").alias("content")).withColumn("p", F.substring("hash", 1, 1))
    fresh.repartitionByRange("hash").sortWithinPartitions("p", "hash").write.mode("append").partitionBy("p").parquet(f"{root}/blobs")
    version = (_table(spark, f"{root}/index", _INDEX).agg(F.max("version")).first()[0] or 0) + 1
    keys = keys.withColumns({"version": F.lit(version), "p": _part("key")})
    keys.repartitionByRange("p", "key").sortWithinPartitions("p", "key").write.mode("append").partitionBy("p").parquet(f"{root}/index")
    return keys.select("key", "hash")


def get(asked: DataFrame, root: str, key: str = "key") -> DataFrame:
    """asked with found, hash and content.  The partitions of the asked keys and hashes are pruned at run time."""
    spark = asked.sparkSession
    wanted = asked.withColumns({"__k": F.col(key).cast("string"), "__p": _part(F.col(key).cast("string"))})
    index = _table(spark, f"{root}/index", _INDEX)
    ours = wanted.select("__k", "__p").distinct()
    last = index.join(ours, (F.col("p") == F.col("__p")) & (F.col("key") == F.col("__k"))).groupBy("__k").agg(F.max_by("hash", "version").alias("hash"))
    last = materialize(last, "content_asked")
    blobs = _table(spark, f"{root}/blobs", _BLOBS)
    needed = last.select("hash", F.substring("hash", 1, 1).alias("__b")).distinct()
    texts = blobs.join(needed.withColumnRenamed("hash", "__h"), (F.col("p") == F.col("__b")) & (F.col("hash") == F.col("__h"))).groupBy("__h").agg(F.first("content").alias("content"))
    both = last.join(texts, F.col("hash") == F.col("__h"), "left").select("__k", "hash", "content")
    return wanted.join(both, "__k", "left").select(*[F.col(f"`{c}`") for c in asked.columns], F.col("hash").isNotNull().alias("found"), "hash", "content")
