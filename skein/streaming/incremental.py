"""Streams into tables: an index that follows changes, an append log, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Documents of a bucket at most; a fuller one is split.
MOST_ROWS = 200_000
#: Bits by which an overfull bucket may grow in one batch, and all bits of a key's hash.
STEP, BITS = 12, 64


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below path; none if there is no such folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(place) if f.isDirectory()] if fs.exists(place) else []


def _versions(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """The versions of each bucket, in order; a listing of one folder per bucket and version."""
    found: dict[str, list[int]] = {}
    for v in _children(spark, path):
        if v.startswith("v="):
            for b in _children(spark, f"{path}/{v}"):
                found.setdefault(b[3:], []).append(int(v[2:]))  # b=x and the bits
    return {b: sorted(v) for b, v in found.items()}


def _directory(versions: dict[str, list[int]], before: int | None = None) -> dict[str, int]:
    """The buckets that hold the state, and the newest version of each: those that no later version has split."""
    newest = {b: max(own) for b, v in versions.items() if (own := [x for x in v if before is None or x < before])}
    split: dict[str, int] = {}  # the newest version of anything below each bucket
    for b, v in newest.items():
        for n in range(len(b)):
            split[b[:n]] = max(split.get(b[:n], -1), v)
    return {b: v for b, v in newest.items() if v > split.get(b, -1)}


def _buckets(spark: SparkSession, path: str, schema, newest: dict[str, int]) -> DataFrame:
    places = [f"{path}/v={v}/b=x{b}" for b, v in sorted(newest.items())]
    if not places:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*places).where("NOT deleted")


def current_state(spark: SparkSession, path: str, schema) -> DataFrame:
    """The documents as of the last batch that follow_changes wrote below path."""
    return _buckets(spark, path, schema, _directory(_versions(spark, path)))


def _bits(key: str):
    """The hash of a key as binary digits."""
    return F.lpad(F.bin(F.xxhash64(key)), BITS, "0")


def _placed(rows: DataFrame, leaves: list[str], bits: str, name: str) -> DataFrame:
    """rows with the one of the buckets in which each lies: a row meets the beginnings of its bits, so nothing is compared in pairs.

    The buckets, which the driver has listed, are broadcast: else each row would be shuffled once for each of its beginnings.
    """
    deepest = max(map(len, leaves))
    known = rows.sparkSession.createDataFrame([(x,) for x in leaves], f"{name} string")
    begins = F.transform(F.sequence(F.lit(0), F.lit(deepest)), lambda n: F.substring(F.col(bits), F.lit(1), n))
    return rows.withColumn(name, F.explode(begins)).join(F.broadcast(known), name)


def _split(sizes: dict[str, int], leaf: str, most: int, deepest: int) -> list[str]:
    """The parts of a bucket, given the number of rows below each beginning of `deepest` bits: none above `most`, if bits suffice."""
    if sum(sizes.values()) <= most or len(leaf) >= min(deepest, BITS):
        return [leaf]
    sides = [{b: n for b, n in sizes.items() if b[len(leaf)] == side} for side in "01"]
    return [x for side, own in zip("01", sides, strict=True) for x in _split(own, leaf + side, most, deepest)]


def follow_changes(changes: DataFrame, path: str, checkpoint: str, key: str = "doc_id", order: str = "seq", most_rows: int = MOST_ROWS) -> StreamingQuery:
    """Keeps the state of each document in a bucketed parquet table below path: a changed one replaces, a deleted one goes.

    changes has key, order, deleted and payload columns.  A bucket holds the keys whose hash begins with its bits, at most
    `most_rows` of them: a fuller one is split on further bits, so files stay bounded and their number grows with the state.
    Batch n writes version n of the buckets whose keys it holds, from the newest earlier version of these; so other buckets are
    neither read nor written, and a batch that is tried again gives the same table.  What a later version replaced or split
    before the last batch is removed.  Of a batch's changes to a key the one of greatest order counts; a bucket without documents
    holds one deleted row.  The directory of buckets, some tens of bytes for each, is listed on the driver.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c != key]
        last = batch.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*").withColumn("__bits", _bits(key)).persist()
        try:
            versions = _versions(spark, path)
            live = _directory(versions, n) or {"": -1}
            placed = _placed(last, sorted(live), "__bits", "__leaf")
            touched = {r["__leaf"]: live[r["__leaf"]] for r in placed.select("__leaf").distinct().collect()}  # at most the buckets
            if not touched:
                return
            old = _buckets(spark, path, batch.schema, {b: v for b, v in touched.items() if v >= 0}).withColumn("__bits", _bits(key))
            out = old.join(last.select(key), key, "left_anti").unionByName(last.where(~F.col("deleted"))).persist()
            try:
                placed = _placed(out, sorted(touched), "__bits", "__leaf")
                counts = placed.groupBy("__leaf").count().where(F.col("count") > most_rows).collect()  # overfull buckets
                leaves = dict.fromkeys(touched)
                for r in counts:
                    leaf = r["__leaf"]
                    deepest = len(leaf) + STEP
                    own = placed.where(F.col("__leaf") == leaf).groupBy(F.substring("__bits", 1, deepest).alias("begin")).count().collect()  # 2 ** STEP at most
                    parts = _split({x["begin"]: x["count"] for x in own}, leaf, most_rows, deepest)
                    del leaves[leaf]
                    leaves |= dict.fromkeys(parts)
                rows = _placed(out, sorted(leaves), "__bits", "__leaf").withColumn("b", F.concat(F.lit("x"), "__leaf")).drop("__leaf", "__bits")
                empty = spark.createDataFrame([(f"x{b}",) for b in leaves], "b string").withColumn("deleted", F.lit(True))
                rows = rows.unionByName(empty, allowMissingColumns=True)
                rows.repartition("b").write.mode("overwrite").partitionBy("b").parquet(f"{path}/v={n}")
            finally:
                out.unpersist()
        finally:
            last.unpersist()
        for b, own in versions.items():
            for v in own:
                if v < n and live.get(b) != v:
                    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}/b=x{b}")
                    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_log(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.format("json").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts and sums per window and kind (an addition): rows later than the watermark are dropped in a stream."""
    w = F.window(ts, width)
    out = events.withWatermark(ts, late).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), kind, "n", "total")
