"""Document fingerprints by winnowing.

Each run of K code points has a rolling hash; of each window of W runs the least hash is chosen, the rightmost of equal
ones; what is chosen is kept with its place.  Two texts that share K + W - 1 code points share a chosen hash.  A short text
has a narrower window, so that half of it spans one: from 2 K - 1 code points on, a text shares a chosen hash with any text
of no greater length that has its first half.  Shorter ones share one only with texts that have a whole run of theirs.

Documents meet their successor in descending order of doc_id by a range shuffle with one halo row per range.

Defined cases: a null text is empty; an empty text has no fingerprint (an empty string), is like another empty one (1) and
unlike any other (0); a text of fewer than K code points is one run; a null doc_id, for which -2 ** 63
stands, comes last; rows with equal doc_id follow each other in the order of a hash of their texts; the successor of the last row
is the first; in a table of one row it is the row itself; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, partitions, table
from .hashing import mix

#: Code points in a run (a power of 2) and most runs in a window.
K, W = 8, 64
_U = np.uint64
_MULTIPLIER = 0x9FB21C651E98DF25
_NO_ID = -(1 << 63)
_OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def width(n: int, k: int = K) -> int:
    """Runs in a window of a text of n code points: W, or as many as the first half of a shorter text holds."""
    return max(1, min(W, (n + 1) // 2 - k + 1))


def winnow(text: str, k: int = K, w: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The chosen hashes (32 bits) of a text and their places, in order; windows of w runs, or by the text's length."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(points)
    w = w or width(n, k)
    if not n:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        if n < k:
            h = np.array([(points * np.array([pow(_MULTIPLIER, j, 1 << 64) for j in range(n)], np.uint64)).sum() + _U(n)], np.uint64)
        else:  # runs of 1, 2, 4 .. k code points, each from two of half its length
            h, size = points, 1
            while size < k:
                h = h[:-size] * _U(pow(_MULTIPLIER, size, 1 << 64)) + h[size:]
                size *= 2
    # hash above, places from the right below: the least is the least hash, then the rightmost
    keys = (mix(h) & _U(0xFFFFFFFF00000000)) | (_U(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    span = 1
    while span < w and len(keys) > span:
        step = min(span, w - span)
        keys = np.minimum(keys[:-step], keys[step:]) if len(keys) > step else keys
        span += step
    if len(h) < w:
        keys = keys.min(keepdims=True)
    keys = keys[np.flatnonzero(np.diff(keys, prepend=~keys[:1]))]
    return (keys >> _U(32)).astype(np.uint32), (_U(0xFFFFFFFF) - (keys & _U(0xFFFFFFFF))).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of the distinct hashes of two fingerprints."""
    if not len(a) and not len(b):
        return 1.0
    a, b = np.unique(a), np.unique(b)
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def as_text(hashes: np.ndarray, places: np.ndarray) -> str:
    """A fingerprint as text: hash in hexadecimal, @, place."""
    return " ".join([f"{h:08x}@{p}" for h, p in zip(hashes.tolist(), places.tolist(), strict=True)])


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with hashes array<long> and places array<long> of a text column; columns of these names are replaced."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            found = [winnow(t or "") for t in texts]
            yield pd.DataFrame({"hashes": [h.astype(np.int64) for h, _ in found], "places": [p for _, p in found]})

    own = F.pandas_udf(run, "hashes array<long>, places array<long>")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own(F.col(f"`{text}`")).alias("found"))
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("hashes", "places")]
    return rows.select(*kept, "found.hashes", "found.places")


def with_successor(docs: DataFrame, n: int) -> DataFrame:
    """id, h (a hash of the text), text, range, halo: ranges of descending id and ascending h, each followed by the first row of the next.

    The ranges part the keys alone, id and h, into about equal numbers of rows, so an id of very many rows lies in many ranges; where
    a range begins is one row on the driver.  Rows that are alike in id and text lie in one range.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    keys = rows.select("id", "h").repartitionByRange(n, F.desc("id"), "h").withColumn("range", F.spark_partition_id())
    first = materialize(keys, "winnow_keys").groupBy("range").agg(F.max(F.struct("id", F.bitwise_not("h").alias("h"))).alias("k"))
    starts = sorted(((-r["k"]["id"], ~r["k"]["h"]) for r in first.collect()))  # one row per range
    if not starts:
        return rows.withColumns({"range": F.lit(0), "halo": F.lit(False)})
    limits = np.array([i for i, _ in starts], object), [h for _, h in starts]

    def places(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array(_ranges(ids.to_numpy(), hashes.to_numpy(), *limits), pa.int32())

    range_ = F.arrow_udf(places, "int")
    heads = [(-i, h, (k - 1) % len(starts)) for k, (i, h) in enumerate(starts)]
    halos = docs.sparkSession.createDataFrame(heads, "id long, h long, ahead int")  # one row per range
    own = F.struct(range_("id", "h").alias("range"), F.lit(False).alias("halo"))
    more = F.when(F.col("ahead").isNotNull(), F.struct(F.col("ahead").alias("range"), F.lit(True).alias("halo")))
    marked = rows.withColumn("own", own).join(F.broadcast(halos), ["id", "h"], "left").withColumn("more", more)
    return marked.select("id", "h", "text", F.inline(F.array_compact(F.array("own", "more"))))


def _ranges(ids: np.ndarray, hashes: np.ndarray, from_ids: np.ndarray, from_hashes: list[int]) -> np.ndarray:
    """The last of the limits (minus id, hash), in order, that is not behind each row."""
    down = np.array([-int(i) for i in from_ids], np.int64)  # ids of the limits, descending
    first, last = (len(down) - np.searchsorted(down[::-1], ids, side) for side in ("right", "left"))
    out = first - 1  # limits of greater ids
    for i in np.unique(ids[last > first]).tolist():  # ids in which ranges begin
        own = np.flatnonzero(ids == i)
        a, b = int(first[own[0]]), int(last[own[0]])
        out[own] = a - 1 + np.searchsorted(np.array(from_hashes[a:b], np.int64), hashes[own], "right")
    return np.maximum(out, 0)


def compare_successive(docs: DataFrame, k: int = K, w: int | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): its fingerprint, that of its edited text, and how like they are."""
    n = partitions(docs.sparkSession)
    rows = with_successor(docs, n).repartitionById(n, "range")  # each range is a partition of its own
    rows = rows.sortWithinPartitions("range", "halo", F.desc("id"), "h", "text")

    def print_of(text: str):
        hashes, places = winnow(text, k, w)
        return hashes, as_text(hashes, places)

    def row(id_, text, own, nxt, nxt_own):
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        hashes, shown = own if edited == text else print_of(edited)
        return (
            None if id_ == _NO_ID else id_, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
            own[1], shown, likeness(own[0], hashes), likeness(own[0], nxt_own[0]),
        )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _OUT.split(", ")]
        current = held = None  # the range, and its row whose successor is awaited
        closed = False  # the range has had its halo
        for pdf in frames:
            out = []
            for id_, text, range_, halo in zip(pdf["id"], pdf["text"], pdf["range"], pdf["halo"], strict=True):
                if range_ != current:
                    current, held, closed = range_, None, False
                if closed:
                    continue
                own = held[2] if held and held[1] == text else print_of(text)
                if held:
                    out.append(row(*held, text, own))
                held, closed = (id_, text, own), halo
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, _OUT)


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, runs of 8 code points, windows of up to 64."""
    return compare_successive(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op9_winnowing": op9_winnowing}
ORACLE_SQL: dict[str, str] = {}
