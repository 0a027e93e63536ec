"""Packing along a space-filling curve.

A document's hashed tokens, projected to a few dimensions by random signs, give a direction, whatever the document's
length; rare tokens weigh more than those that all texts share.  The direction's place on a Hilbert curve is the key of a
range sort, so neighbours in the order are alike.  Documents travel in runs of at most RUN tokens and rows have numbers, so
that ranges hold about equal tokens and neither a very long text nor many copies of one row land in one task.  Each range is cut along
the curve into sequences of SEQUENCE tokens; documents are cut where a sequence is full.  What is left at the end of a range
becomes sequences of powers of two, which need no padding.

Defined cases: a null or empty text has the end id alone and lies at the middle of the space; a null doc_id stays null;
repeated rows are packed each; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, partitions, table
from .hashing import batches, mix
from .tokens import encoder, tokenizer_path

SEQUENCE = 4096
#: Dimensions of the projection and bits of each on the curve.
DIMENSIONS, BITS = 4, 12
END_ID = 2
#: Tokens that travel in one row.
RUN = 2048
_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, ids binary"
)
_RUNS = "doc_id long, absent boolean, curve long, row long, start long, doc_tokens long, width int, ids binary"


def _signs(n: int) -> np.ndarray:
    """A sign per hashed token and dimension, for the tokens below n."""
    h = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.stack([((h >> np.uint64(60 - d)) & np.uint64(1)).astype(np.float32) * 2 - 1 for d in range(DIMENSIONS)], axis=1)


#: Vocabularies number their entries from the frequent to the rare ones, so an id tells how much its token says.
_SIGNS = _signs(1 << 16) * np.sqrt(np.arange(1, (1 << 16) + 1) / (1 << 16)).astype(np.float32)[:, None]


def project(tokens: list[np.ndarray]) -> np.ndarray:
    """A point per document: the weighted sum of signs of its hashed tokens, as a unit vector, on a grid of 2 ** BITS steps."""
    out = np.zeros((len(tokens), DIMENSIONS))
    for i, ids in enumerate(tokens):
        for at in range(0, len(ids), 1 << 16):
            out[i] += _SIGNS[ids[at : at + (1 << 16)] & 0xFFFF].sum(axis=0)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    unit = np.divide(out, length, out=np.zeros_like(out), where=length > 0)
    return np.minimum((unit + 1) / 2 * (1 << BITS), (1 << BITS) - 1).astype(np.int64)


def hilbert(points: np.ndarray) -> np.ndarray:
    """Places on the Hilbert curve of points with DIMENSIONS coordinates of BITS bits: Skilling's transposed form."""
    x = points.copy()
    n = x.shape[1]
    for b in range(BITS - 1, 0, -1):
        q = 1 << b
        low = q - 1
        for i in range(n):
            flip = (x[:, i] & q) != 0
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(flip, low, swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    for b in range(BITS - 1, 0, -1):
        q = 1 << b
        t ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(BITS - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[:, i] >> b) & 1
    return key


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Runs of documents: doc_id (0 where it is absent), curve (the Hilbert key), row (a number of the row), start, doc_tokens and ids of `width` bytes each, little-endian."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(path).encode_batch, np.array([end_id], "<u4").tobytes()
        row = TaskContext.get().partitionId() << 33
        for pdf in batches(frames, 1024):
            ids = [np.frombuffer(b + end, "<u4") for b in encode(pdf["text"].tolist())]
            # the end id says nothing of a document
            curve = hilbert(project([x[:-1] for x in ids])).tolist()
            out = []
            for doc_id, absent, key, x in zip(pdf["doc_id"], pdf["absent"], curve, ids, strict=True):
                row += 1  # so that equal rows need not lie in one range
                for at in range(0, len(x), RUN):
                    part = x[at : at + RUN]
                    width = 2 if int(part.max()) < 1 << 16 else 4
                    out.append((doc_id, absent, key, row, at, len(x), width, part.astype(f"<u{width}").tobytes()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _RUNS.split(", ")])

    rows = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.isnull("doc_id").alias("absent"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, _RUNS)


def pack(docs: DataFrame, path: str, end_id: int = END_ID, sequence: int = SEQUENCE) -> DataFrame:
    """The pieces of all sequences: which ids of which document stand where; ids are 4 bytes each, little-endian."""
    n = partitions(docs.sparkSession)
    rows = materialize(tokenized(docs, path, end_id), "tokenized")  # else the range limits would encode everything twice
    order = ("curve", "absent", "doc_id", "row", "start")
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32  # sequences of a range are numbered from here
        held: list[tuple] = []  # the pieces of the open sequence: doc_id, start, ids, doc_tokens
        filled = 0
        out: list[tuple] = []

        def emit(pieces: list[tuple], size: int) -> None:
            nonlocal number
            offset = 0
            for doc_id, start, ids, whole in pieces:
                data = ids.tobytes()
                out.append((doc_id, start, len(ids), zlib.crc32(data), whole, number, offset, size, data))
                offset += len(ids)
            number += 1

        def frame() -> pd.DataFrame:
            ids = pd.array([x[0] for x in out], "Int64")  # exact where some are null
            made = pd.DataFrame(out, columns=[c.split()[0] for c in _PIECES.split(", ")])
            out.clear()
            return made.assign(doc_id=ids)

        for pdf in frames:
            for doc_id, absent, start, whole, width, data in zip(*[pdf[c] for c in ("doc_id", "absent", "start", "doc_tokens", "width", "ids")], strict=True):
                doc_id = None if absent else doc_id
                ids, at = np.frombuffer(data, f"<u{width}").astype("<u4"), 0
                while at < len(ids):
                    take = min(sequence - filled, len(ids) - at)
                    held.append((doc_id, start + at, ids[at : at + take], whole))
                    at, filled = at + take, filled + take
                    if filled == sequence:
                        emit(held, sequence)
                        held, filled = [], 0
                if len(out) >= 2000:
                    yield frame()
        while filled:  # the rest, in powers of two from the largest
            size = 1 << filled.bit_length() - 1
            now, room = [], size
            while room:
                doc_id, start, ids, whole = held[0]
                take = min(room, len(ids))
                now.append((doc_id, start, ids[:take], whole))
                held = held[1:] if take == len(ids) else [(doc_id, start + take, ids[take:], whole), *held[1:]]
                room -= take
            emit(now, size)
            filled -= size
        yield frame()

    return rows.mapInPandas(run, _PIECES)


def op10_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, word BPE, id 2 at the end of each, sequences of 4096."""
    out = pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("word_bpe_49k.json"))
    return out.drop("ids")


QUERIES = {"op10_hilbert_packing": op10_hilbert_packing}
ORACLE_SQL: dict[str, str] = {}
