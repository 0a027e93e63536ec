"""Queries that stream a table: the state that follows its changes, and the milestones on the way."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..storage import partitions, scratch_path
from ..streaming import incremental, progress
from .registry import Registry, read

R = Registry()
_STATE = "doc_id long, seq long, deleted boolean, body string"


def _changes(spark, d, batches: int = 1):
    """Each document as a change, every fifth one as a deletion; a stream follows a folder of files, in this many batches at most.

    There is a file for each shuffle partition, so that files, and tasks that write and read them, stay bounded.
    """
    docs, folder, files = read(spark, d, "documents"), scratch_path(spark, "changes"), max(4, partitions(spark))
    docs.repartition(files, "doc_id").write.parquet(folder)
    docs = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", -(-files // batches)).parquet(folder).where("doc_id IS NOT NULL")
    return docs.select("doc_id", F.col("doc_id").alias("seq"), (F.col("doc_id") % 5 == 0).alias("deleted"), F.col("text").alias("body"))


@R.add("followed_changes", "SELECT doc_id, md5(coalesce(text, '')) AS hash FROM documents WHERE doc_id IS NOT NULL AND doc_id % 5 <> 0")
def followed_changes(spark, d):
    """With buckets of 5,000 documents, so that they are split where there are more."""
    path = scratch_path(spark, "followed")
    incremental.follow_changes(_changes(spark, d, 2), path, scratch_path(spark, "followed_cp"), most_rows=5000).awaitTermination()
    return incremental.current_state(spark, path, _STATE).select("doc_id", F.md5(F.coalesce("body", F.lit("")).cast("binary")).alias("hash"))


@R.add("appended_log", "SELECT doc_id, doc_id % 5 = 0 AS deleted, md5(coalesce(text, '')) AS hash FROM documents WHERE doc_id IS NOT NULL")
def appended_log(spark, d):
    path = scratch_path(spark, "appended")
    incremental.append_log(_changes(spark, d), path, scratch_path(spark, "appended_cp")).awaitTermination()
    return spark.read.schema(_STATE).json(path).select("doc_id", "deleted", F.md5(F.coalesce("body", F.lit("")).cast("binary")).alias("hash"))


@R.add("stream_milestones", """SELECT 'started' AS kind, NULL::BIGINT AS n_rows, NULL AS documents, NULL AS deleted UNION ALL SELECT 'ended', NULL, NULL, NULL
  UNION ALL SELECT 'batch', (SELECT count(*) FROM documents), count(*)::VARCHAR, count(*) FILTER (doc_id % 5 = 0)::VARCHAR FROM documents WHERE doc_id IS NOT NULL""")
def stream_milestones(spark, d):
    """A stream of all documents that observes what it passes on, in one batch."""
    folder = scratch_path(spark, "milestones")
    listener = progress.Milestones(folder)
    spark.streams.addListener(listener)
    try:
        seen = _changes(spark, d).observe("seen", F.count("*").alias("documents"), F.count_if("deleted").alias("deleted"))
        query = incremental.append_log(seen, scratch_path(spark, "observed"), scratch_path(spark, "observed_cp"))
        query.awaitTermination()
        rows = progress.milestones(spark, folder, query)
        return rows.select("kind", "n_rows", F.col("observed")["seen.documents"].alias("documents"), F.col("observed")["seen.deleted"].alias("deleted"))
    finally:
        spark.streams.removeListener(listener)
