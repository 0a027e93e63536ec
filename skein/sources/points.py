"""A sink for points of a vector store: batches by size, halved where the store refuses them, safe to try again.

`upsert` writes a DataFrame through Spark's Python data source interface.  Each task sends its rows in batches to a client of
its own; a batch that is too large is halved, down to one point, and the smaller size stays for the rest of the task; a store that
is busy is asked again.  The store must replace a point by its id: then a task that fails and runs again, or one that runs twice,
neither loses nor doubles a point.

Defined cases: an empty DataFrame sends nothing; a single point that is too large is an error; rows with equal ids are sent each, the
store keeps the last; the write fails if any task has failed for good, and may be run again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Bytes of a request, of each number of a vector and of the rest of a point, and bounds of a batch (fixed values).
TARGET_BYTES, NUMBER_BYTES, POINT_BYTES, LEAST, MOST = 2_500_000, 28, 2000, 8, 128


class TooLarge(Exception):
    """The store refuses a batch for its size."""


class Busy(Exception):
    """The store cannot take a batch just now."""


class Client(Protocol):
    def upsert(self, points: list[dict[str, Any]]) -> None: ...


@dataclass
class Sent(WriterCommitMessage):
    points: int
    batches: int


def batch_points(dim: int) -> int:
    """Points to send at once for vectors of so many numbers."""
    return max(LEAST, min(MOST, TARGET_BYTES // max(1, dim * NUMBER_BYTES + POINT_BYTES)))


def send(rows: Iterator[dict[str, Any]], client: Client, size: int, tries: int = 10, wait: float = 2.0) -> Sent:
    """Sends rows in order; holds one batch at a time."""
    held: list[dict[str, Any]] = []
    sent = Sent(0, 0)
    done = False
    while not done or held:
        while not done and len(held) < size:
            try:
                held.append(next(rows))
            except StopIteration:
                done = True
        if not held:
            break
        for left in range(tries - 1, -1, -1):
            try:
                client.upsert(held[:size])
                sent.points, sent.batches = sent.points + len(held[:size]), sent.batches + 1
                held = held[size:]
                break
            except TooLarge:
                if min(size, len(held)) <= 1:
                    raise
                size = max(1, min(size, len(held)) // 2)
                break
            except Busy:
                if not left:
                    raise
                time.sleep(wait)
    return sent


def upsert(points: DataFrame, connect: Callable[[], Client], dim: int, most: int | None = None, wait: float = 2.0, name: str = "point_store") -> None:
    """Writes all rows of points to the store that `connect` opens in each task."""
    size = most or batch_points(dim)

    class Writer(DataSourceWriter):
        def write(self, iterator):
            return send((row.asDict(recursive=True) for row in iterator), connect(), size, wait=wait)

        def commit(self, messages) -> None:
            """All tasks are done; what they have sent is in the store already."""

        def abort(self, messages) -> None:
            """Points that were sent stay: the write is run again, and replaces them by their ids."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema, overwrite):
            return Writer()

    points.sparkSession.dataSource.register(Source)
    points.write.format(name).mode("append").save()
