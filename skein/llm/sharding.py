"""Sharding by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split.

A document's hash is 60 bits of the MD5 of its key.  The directory starts as one bucket without bits; a bucket whose bytes
are above the limit splits on the next bit, again and again, until each shard fits.  Rounds of `STEP` bits find where all
buckets stop from sums over hash cells, so the number of passes over the rows grows with the logarithm of shards / 4096.
Everything is DataFrame operations.

Defined cases: a null or empty text has 0 bytes; a null key hashes as the empty string; rows with one hash (equal keys)
cannot be parted, so a shard that holds a single hash may be above the limit; an empty table has no shards; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

HASH_BITS = 60
STEP = 12
#: Bytes of text in a shard at most, in the registered query.
SHARD_BYTES = 1 << 20


def key_hash(key: Column) -> Column:
    """60 bits of the MD5 of the key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def prefix(hash_: Column, bits: Column | int) -> Column:
    """The first `bits` bits of a hash as a string of 0 and 1."""
    whole = F.lpad(F.bin(hash_), HASH_BITS, "0")
    return F.substring(whole, F.lit(1), F.lit(bits) if isinstance(bits, int) else bits)


def directory(rows: DataFrame, max_bytes: int) -> DataFrame:
    """One row per shard: depth, shard (its prefix), shard_bytes, n_rows; rows has h and n_bytes."""
    found, deep = [], 0
    active = rows.withColumn("root", F.lit(""))
    while True:
        top = min(deep + STEP, HASH_BITS)
        cells = active.groupBy("root", prefix(F.col("h"), top).alias("cell")).agg(
            F.sum("n_bytes").alias("b"), F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")
        )
        ladder = cells.withColumn("depth", F.explode(F.sequence(F.lit(deep), F.lit(top))))
        sums = ladder.groupBy("depth", F.substring(F.col("cell"), F.lit(1), F.col("depth")).alias("shard")).agg(
            F.sum("b").alias("shard_bytes"), F.sum("n").alias("n_rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
        )
        fits = (F.col("shard_bytes") <= max_bytes) | (F.col("lo") == F.col("hi")) | (F.col("depth") == HASH_BITS)
        # a bucket exists if it is the start of this round or its parent had to split
        parent = sums.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("shard").alias("up"))
        sums = sums.withColumn("fits", fits).withColumn("up", F.expr("substring(shard, 1, greatest(depth - 1, 0))"))
        alive = sums.where(F.col("depth") == deep).unionByName(sums.where(F.col("depth") > deep).join(parent, ["depth", "up"], "left_semi"))
        alive = materialize(alive.select("depth", "shard", "shard_bytes", "n_rows", "fits"), f"shard_directory{deep}")
        found.append(alive.where("fits").drop("fits"))
        more = alive.where(~F.col("fits") & (F.col("depth") == top)).select(F.col("shard").alias("root"))
        if top == HASH_BITS or not more.take(1):
            break
        active = rows.withColumn("root", prefix(F.col("h"), top)).join(more, "root")
        deep = top
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def shard_documents(docs: DataFrame, max_bytes: int = SHARD_BYTES, key: str = "doc_id", payload: str = "text") -> DataFrame:
    """key, n_bytes, shard, depth, shard_bytes for each row of docs.

    A row finds its shard among the depths that occur, by equality of prefixes; the directory has one row per shard.
    """
    rows = docs.select(
        F.col(key), key_hash(F.col(key)).alias("h"), F.coalesce(F.octet_length(F.col(payload)), F.lit(0)).cast("long").alias("n_bytes")
    )
    rows = materialize(rows, "shard_rows")
    shards = materialize(directory(rows, max_bytes), "shard_directory")
    span = shards.agg(F.min("depth"), F.max("depth")).first()
    lo, hi = (span[0], span[1]) if span[0] is not None else (0, 0)
    # directory entries of one width, as in an array of pointers: a shard of depth d owns 2 ** (hi - d) of them; where that
    # would be many more than there are shards, rows look at each depth instead
    if hi - lo <= 6:
        slot = F.expr(f"sequence(0L, shiftleft(1L, {hi} - depth) - 1L)")
        wide = shards.withColumn("slot", F.explode(slot)).withColumn(
            "entry", F.concat("shard", F.expr(f"lpad(bin(slot), {hi} - depth, '0')"))
        )
        near = rows.withColumn("entry", prefix(F.col("h"), hi))
        out = near.join(wide, "entry")
    else:
        near = rows.withColumn("depth", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).withColumn("shard", prefix(F.col("h"), F.col("depth")))
        out = near.join(shards, ["depth", "shard"])
    return out.select(key, "n_bytes", "shard", "depth", "shard_bytes")


def write_shards(docs: DataFrame, path: str, max_bytes: int = SHARD_BYTES, key: str = "doc_id", payload: str = "text") -> None:
    """Writes docs as one folder per shard; all rows of a shard are written by one task, which its limit bounds."""
    place = shard_documents(docs, max_bytes, key, payload).select(key, "shard").dropDuplicates([key])
    docs.join(place, key).repartition("shard").write.partitionBy("shard").parquet(path)


def op3_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, shards of at most 1 MiB of text."""
    return shard_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op3_extendible_sharding": op3_extendible_sharding}
ORACLE_SQL = {
    "op3_extendible_sharding": f"""
WITH d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
         right(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT::BIT::VARCHAR, {HASH_BITS}) AS h
  FROM documents
), p AS (
  SELECT d.*, i AS depth, substr(h, 1, i) AS shard FROM d, (SELECT unnest(range(0, 31))::INTEGER AS i)
), s AS (
  SELECT depth, shard, sum(n_bytes)::BIGINT AS shard_bytes, count(DISTINCT h) AS n_hashes FROM p GROUP BY ALL
), f AS (
  SELECT p.doc_id, p.n_bytes, p.shard, p.depth, s.shard_bytes,
         row_number() OVER (PARTITION BY p.doc_id ORDER BY p.depth) AS k
  FROM p JOIN s USING (depth, shard) WHERE s.shard_bytes <= {SHARD_BYTES} OR s.n_hashes = 1
)
SELECT doc_id, n_bytes, shard, depth, shard_bytes FROM f WHERE k = 1"""
}
