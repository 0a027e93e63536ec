"""Streams with an end, and their milestones."""

import time

import pytest
from pyspark.sql import functions as F

from skein.streaming import incremental, progress, sse

STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EMPTY = "spark.sql.streaming.noDataMicroBatches.enabled"
LINES = "stream_id string, n long, line string"


def test_open_streams_end(spark, tmp_path):
    """An open event comes out when its stream has been idle, in the run after; a query over what is there ends."""
    source = lambda: spark.readStream.schema(LINES).parquet(str(tmp_path / "in"))
    put = lambda rows: spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([("a", 1, "event: x"), ("a", 2, "data: one"), ("a", 3, ""), ("a", 4, "data: open"), ("b", 1, "data: b1"), ("b", 2, "data: [DONE]"), ("c", 1, "event: only a name")])
    with pytest.raises(ValueError, match="RocksDB"):
        sse.expiring_events(source())
    before = {k: spark.conf.get(k) for k in (STORE, EMPTY)}
    spark.conf.set(STORE, ROCKS)
    spark.conf.set(EMPTY, "false")
    try:
        def run():
            q = sse.expiring_events(source(), idle=2).writeStream.format("json").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
            assert q.awaitTermination(90) and q.exception() is None
            return sorted((r.stream_id, r.seq, r.event, r.data) for r in spark.read.schema(sse.EVENTS).json(str(tmp_path / "out")).collect())

        first = [("a", 0, "x", "one"), ("b", 0, "", "b1")]
        assert run() == first
        put([("a", 5, "data: more")])  # may come within the time or not, but the event is given once
        got = run()
        assert got in (first, [first[0], ("a", 1, "", "open"), first[1]])
        time.sleep(3)
        put([("d", 1, "data: d"), ("d", 2, "")])
        texts = [(s, d) for s, _, _, d in run()]
        assert ("d", "d") in texts and (("a", "open\nmore") in texts or {("a", "open"), ("a", "more")} <= set(texts)) and len(texts) in (4, 5) and ("c", "") not in texts
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_milestones(spark, tmp_path):
    folder = f"file://{tmp_path}/milestones"
    listener = progress.Milestones(folder)
    spark.streams.addListener(listener)
    try:
        for part in range(2):
            spark.range(10 * (part + 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        seen = source.observe("seen", F.count("*").alias("n"), F.max("id").alias("most"))
        query = incremental.append_log(seen, str(tmp_path / "out"), str(tmp_path / "cp"))
        query.awaitTermination()
        rows = sorted(progress.milestones(spark, folder, query).collect(), key=lambda r: r.place)
        assert [r.kind for r in rows] == ["started", "batch", "batch", "ended"] and [r.place for r in rows] == sorted(r.place for r in rows)
        assert sorted((r.n_rows, r.observed["seen.n"], r.observed["seen.most"]) for r in rows[1:3]) == [(10, "10", "9"), (20, "20", "19")] and rows[3].error is None
        failing = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).select(F.raise_error(F.lit("no good")).cast("string").alias("x"))
        bad = failing.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
        with pytest.raises(Exception, match="no good"):
            bad.awaitTermination()
        end = progress.milestones(spark, folder, bad).where("kind = 'ended'").first()
        assert "no good" in end.error and progress.milestones(spark, folder).select("run_id").distinct().count() == 2
    finally:
        spark.streams.removeListener(listener)
