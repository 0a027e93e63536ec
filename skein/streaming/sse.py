"""Server-sent events: framing, deltas, completed responses; as a batch and as a stream with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "stream_id string, seq long, event string, data string"


def frame(lines: list[str], name: str = "", data: list[str] | None = None) -> tuple[list[tuple[str, str]], str, list[str], bool]:
    """The events that lines complete, then what is open: event name, its data lines, and whether [DONE] was met."""
    data, out = list(data or []), []

    def flush() -> None:
        nonlocal name
        if data:
            out.append((name, "\n".join(data)))
        name = ""
        data.clear()

    for line in lines:
        if not line.strip():
            flush()
        elif line.startswith("event:"):
            flush()
            name = line[6:].strip()
        elif line.startswith("data:"):
            part = line[5:].strip()
            if part == "[DONE]":
                flush()
                return out, "", [], True
            data.append(part)
    return out, name, data, False


def events(lines: DataFrame) -> DataFrame:
    """stream_id, seq, event, data of whole streams; lines has stream_id, n, line.  One stream is one response of a model."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        out, name, data, done = frame(pdf["line"].fillna("").tolist())
        if data and not done:
            out.append((name, "\n".join(data)))
        rows = [(pdf["stream_id"].iloc[0], i, e, d) for i, (e, d) in enumerate(out)]
        return pd.DataFrame(rows, columns=["stream_id", "seq", "event", "data"])

    return lines.groupBy("stream_id").applyInPandas(run, EVENTS)


def stream_events(lines: DataFrame) -> DataFrame:
    """The same over a stream: the open event of each stream is its state, so one may be split across batches."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, joined, n_data, seq, done = state.get if state.exists else ("", "", 0, 0, False)
        data = joined.split("\n") if n_data else []
        pdf = pd.concat(list(frames)).sort_values("n")
        rows: list[tuple] = []
        if not done:
            found, name, data, done = frame(pdf["line"].fillna("").tolist(), name, data)
            rows = [(key[0], seq + i, e, d) for i, (e, d) in enumerate(found)]
        state.update((name, "\n".join(data), len(data), seq + len(rows), done))
        yield pd.DataFrame(rows, columns=["stream_id", "seq", "event", "data"])

    schema = "name string, data string, n_data int, seq long, done boolean"
    return lines.groupBy("stream_id").applyInPandasWithState(run, EVENTS, schema, "append", GroupStateTimeout.NoTimeout)


class _Frames(StatefulProcessor):
    """Keeps the open event of each stream, and closes a stream of which nothing has come for `idle` milliseconds."""

    def __init__(self, idle: int):
        self._idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", "name string, data string, n_data int, seq long, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        name, joined, n_data, seq, done = self._open.get() if self._open.exists() else ("", "", 0, 0, False)
        data, out = joined.split("\n") if n_data else [], []
        pdf = pd.concat(list(rows)).sort_values("n")
        if not done:
            found, name, data, done = frame(pdf["line"].fillna("").tolist(), name, data)
            out = [(key[0], seq + i, e, d) for i, (e, d) in enumerate(found)]
        self._open.update((name, "\n".join(data), len(data), seq + len(out), done))
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._idle)
        yield pd.DataFrame(out, columns=["stream_id", "seq", "event", "data"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self._open.exists():
            name, joined, n_data, seq, _ = self._open.get()
            out = [(key[0], seq, name, joined)] if n_data else []
            self._open.clear()
        yield pd.DataFrame(out, columns=["stream_id", "seq", "event", "data"])

    def close(self) -> None:
        """Nothing is held beside the state."""


def expiring_events(lines: DataFrame, idle: float = 600) -> DataFrame:
    """stream_events with an end: a stream of which nothing has come for `idle` seconds gives its open event, and its state goes.

    Time is that of processing, and is looked at in each batch.  A query that runs on has batches without data for that; one under
    availableNow ends only if the session has spark.sql.streaming.noDataMicroBatches.enabled off, and the first batch of its next
    run gives what has expired since.  A line that comes after its stream's end begins a stream of that name anew.
    State with timers is kept by the RocksDB store alone, which the session has to name.
    """
    store = lines.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    if not store.endswith("RocksDBStateStoreProvider"):
        raise ValueError("set spark.sql.streaming.stateStore.providerClass to the RocksDB store")
    return lines.groupBy("stream_id").transformWithStateInPandas(_Frames(round(1000 * idle)), EVENTS, "append", "processingTime")


def event_type(data: Column | str = "data", event: Column | str = "event") -> Column:
    d = F.col(data) if isinstance(data, str) else data
    return F.coalesce(F.get_json_object(d, "$.type"), F.col(event) if isinstance(event, str) else event, F.lit(""))


def delta_text(data: Column | str = "data", event: Column | str = "event") -> Column:
    """Text of a delta event in any of its four shapes; null for other events."""
    d = F.col(data) if isinstance(data, str) else data

    def either(path: str) -> Column:
        whole, text = F.get_json_object(d, path), F.get_json_object(d, f"{path}.text")
        return F.nullif(F.coalesce(text, F.when(~F.startswith(F.ltrim(whole), F.lit("{")), whole)), F.lit(""))

    found = F.coalesce(either("$.delta"), either("$.output_text.delta"))
    return F.when(F.lower(event_type(data, event)).endswith("output_text.delta"), found)


def completed(evts: DataFrame) -> DataFrame:
    """stream_id, response: the last completed response of each stream, unwrapped; null where there is none."""
    done = F.lower(event_type()) == "response.completed"
    body = F.coalesce(F.get_json_object("data", "$.response"), F.col("data"))
    return evts.groupBy("stream_id").agg(F.max_by(body, F.when(done, F.col("seq"))).alias("last"), F.max(F.when(done, 1)).alias("has")).select(
        "stream_id", F.when(F.col("has") == 1, F.col("last")).alias("response")
    )


def assembled(evts: DataFrame) -> DataFrame:
    """stream_id, text: the deltas in order."""
    part = F.struct("seq", delta_text().alias("t"))
    return evts.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "").alias("text"))
