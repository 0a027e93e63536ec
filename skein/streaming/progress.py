"""Milestones of streaming queries as rows: when a query starts, after each batch, and when it ends.

A listener of the session writes a small file for each event below a shared folder; `milestones` reads them in order.  What a query
observes of its rows (DataFrame.observe) comes with its batches.

Defined cases: events of queries that ran before the listener was added are not there; a query that fails ends with its error; a batch
without rows has a milestone if Spark reports one; files of an event that is reported twice give one row.
"""

from __future__ import annotations

import json
import time

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = "run_id string, place long, kind string, name string, batch long, n_rows long, observed map<string,string>, error string"


class Milestones(StreamingQueryListener):
    """Writes the events of the session's streaming queries below folder; add it with spark.streams.addListener."""

    def __init__(self, folder: str):
        self._fs, self._base = pyarrow.fs.FileSystem.from_uri(folder)
        self._fs.create_dir(self._base, recursive=True)

    def _put(self, run_id, place: int, kind: str, **more) -> None:
        row = {"run_id": str(run_id), "place": place, "kind": kind, **more}
        with self._fs.open_output_stream(f"{self._base}/{run_id}-{place:012d}.json") as out:
            out.write(json.dumps(row).encode())

    def onQueryStarted(self, event) -> None:
        self._put(event.runId, 0, "started", name=event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = {f"{n}.{k}": str(v) for n, row in (p.observedMetrics or {}).items() for k, v in row.asDict().items()}
        self._put(p.runId, p.batchId + 1, "batch", name=p.name, batch=p.batchId, n_rows=p.numInputRows, observed=seen)

    def onQueryIdle(self, event) -> None:
        """Nothing has happened, so there is no milestone."""

    def onQueryTerminated(self, event) -> None:
        self._put(event.runId, 10**11, "ended", error=event.exception)


def milestones(spark: SparkSession, folder: str, query: StreamingQuery | None = None, wait: float = 60) -> DataFrame:
    """The events below folder; those of one query up to its end, which the listener may report some time after."""
    rows = spark.read.schema(SCHEMA).json(folder)
    if query is not None:
        rows = rows.where(F.col("run_id") == str(query.runId))
        until = time.monotonic() + wait
        while time.monotonic() < until and not rows.where("kind = 'ended'").take(1):
            time.sleep(0.2)
            rows = spark.read.schema(SCHEMA).json(folder).where(F.col("run_id") == str(query.runId))
    return rows
