"""Token ids in sorted-string-table shards, looked up by identifier.

File: data blocks, one index block, one Bloom filter, one footer; integers are little-endian unless they are keys.

    block   entries sorted by key: shared prefix length u8, suffix length u8, suffix, number of tokens u32, id width u8,
            then the ids (2 or 4 bytes each); the whole block compressed with zstd
    index   per block: offset u64, stored size u32, raw size u32, size of the last key u8, last key
    bloom   number of hashes u8, bits as bytes
    footer  index offset u64, index size u64, bloom offset u64, bloom size u64, entries u64, tokens u64, magic

A key is 0x00 for a null identifier, else 0x01 and the identifier, big-endian with its sign bit flipped, so keys sort as
identifiers do.  A reader fetches the footer, the filter and the index, then one block per lookup.

Tasks write under names of their own attempt through pyarrow's file systems, so any store works that these know (local,
object stores, HDFS); a manifest table, written by Spark, names the files that count.  A lost task leaves a file no
manifest names.

Defined cases: a null text is empty and has the end id alone; a null doc_id sorts first; rows with equal doc_id are kept,
in the order of a hash of their texts; an empty table makes an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, scratch_path, table
from .tokens import encoder, tokenizer_path

MAGIC = b"SKEINSS1"
_FOOTER = struct.Struct("<QQQQQQ8s")
_ENTRY = struct.Struct("<QII")
BLOCK_BYTES = 64 << 10
#: A task starts another file beyond so many stored bytes.
FILE_BYTES = 64 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7
_NO_ID = -(1 << 63)


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes one shard; keys come in ascending order."""

    def __init__(self, stream, block_bytes: int = BLOCK_BYTES):
        self._stream, self._codec, self._limit = stream, pa.Codec("zstd", 1), block_bytes
        self._at, self._block, self._last, self._index, self._keys, self._tokens = 0, bytearray(), b"", [], [], 0

    @property
    def stored(self) -> int:
        return self._at

    def _put(self, data: bytes) -> tuple[int, int]:
        self._stream.write(data)
        self._at += len(data)
        return self._at - len(data), len(data)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        while shared < min(len(key), len(self._last)) and key[shared] == self._last[shared]:
            shared += 1
        width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
        self._block += bytes((shared, len(key) - shared)) + key[shared:] + struct.pack("<IB", len(ids), width)
        self._block += ids.astype("<u2" if width == 2 else "<u4").tobytes()
        self._last = key
        self._tokens += len(ids)
        self._keys.append(key)
        if len(self._block) >= self._limit:
            self._flush()

    def _flush(self) -> None:
        if self._block:
            raw = bytes(self._block)
            offset, size = self._put(self._codec.compress(raw, asbytes=True))
            self._index.append(_ENTRY.pack(offset, size, len(raw)) + bytes([len(self._last)]) + self._last)
            self._block, self._last = bytearray(), b""

    def close(self) -> tuple[int, int]:
        """Ends the file; its entries and tokens."""
        self._flush()
        index = self._put(b"".join(self._index))
        bits = max(64, BLOOM_BITS * len(self._keys) + 7 & ~7)
        filter_ = np.zeros(bits, bool)
        filter_[[p for key in self._keys for p in _probes(key, bits)]] = True
        bloom = self._put(bytes([BLOOM_HASHES]) + np.packbits(filter_, bitorder="little").tobytes())
        self._put(_FOOTER.pack(*index, *bloom, len(self._keys), self._tokens, MAGIC))
        self._stream.close()
        return len(self._keys), self._tokens


class Reader:
    """Reads one shard: all entries in order, or those of one identifier."""

    def __init__(self, source):
        self._source, self._codec = source, pa.Codec("zstd")
        size = source.size()
        footer = self._read(size - _FOOTER.size, _FOOTER.size)
        i, n, b, m, self.entries, self.tokens, magic = _FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        index, bloom = self._read(i, n), self._read(b, m)
        self._filter = np.frombuffer(bloom[1:], np.uint8)
        self._blocks, self._last, at = [], [], 0
        while at < len(index):
            self._blocks.append(_ENTRY.unpack_from(index, at))
            at += _ENTRY.size
            self._last.append(index[at + 1 : at + 1 + index[at]])
            at += 1 + index[at]

    def _read(self, at: int, size: int) -> bytes:
        self._source.seek(at)
        return self._source.read(size)

    def _entries(self, block: tuple[int, int, int]) -> Iterator[tuple[bytes, np.ndarray]]:
        offset, stored, raw = block
        data = self._codec.decompress(self._read(offset, stored), raw, asbytes=True)
        at, key = 0, b""
        while at < len(data):
            shared, more = data[at], data[at + 1]
            key = key[:shared] + data[at + 2 : at + 2 + more]
            at += 2 + more
            count, width = struct.unpack_from("<IB", data, at)
            at += 5
            yield key, np.frombuffer(data, "<u2" if width == 2 else "<u4", count, at).astype("<u4")
            at += count * width

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for block in self._blocks:
            for key, ids in self._entries(block):
                yield id_of(key), ids

    def may_have(self, doc_id: int | None) -> bool:
        bits = 8 * len(self._filter)
        return all(self._filter[p >> 3] >> (p & 7) & 1 for p in _probes(key_of(doc_id), bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each row with this identifier: binary search over the blocks' last keys."""
        key, found = key_of(doc_id), []
        if self.may_have(doc_id):
            for i in range(bisect_left(self._last, key), len(self._last)):
                found += [ids for k, ids in self._entries(self._blocks[i]) if k == key]
                if self._last[i] > key:
                    break
        return found


def _file_system(uri: str):
    return pa.fs.FileSystem.from_uri(uri)


def write_shards(
    docs: DataFrame, folder: str, path: str, end_id: int = 0, text: str = "text", file_bytes: int = FILE_BYTES, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Encodes docs (doc_id, text) with the tokenizer file at path and writes shards below folder, in order of doc_id.

    The manifest: shard (its place in the order), file, entries, tokens, first_id, last_id, and start, the number of ids in
    all shards before it; it is one row per file.  Texts go to ranges of doc_id once, and are encoded there.
    """
    n = partitions(docs.sparkSession)
    rows = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # rows with equal ids may lie in several ranges, by a hash of their text
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h", "text").drop("h")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _file_system(folder)
        fs.create_dir(base, recursive=True)
        encode, end = encoder(path).encode_batch, np.array([end_id], "<u4").tobytes()
        writer = name = first = last = None
        made = []

        def finish() -> None:
            entries, tokens = writer.close()
            made.append((f"{folder}/{name}", entries, tokens, first, last, TaskContext.get().partitionId() << 32 | len(made)))

        for pdf in frames:
            ids = pdf["id"].tolist()
            for at in range(0, len(ids), 1024):
                for id_, encoded in zip(ids[at : at + 1024], encode(pdf["text"].iloc[at : at + 1024].tolist()), strict=True):
                    if writer is not None and writer.stored >= file_bytes:
                        finish()
                        writer = None
                    if writer is None:
                        name, first = f"{uuid.uuid4().hex}.sst", id_
                        writer = Writer(fs.open_output_stream(f"{base}/{name}"), block_bytes)
                    last = id_
                    writer.add(key_of(None if id_ == _NO_ID else id_), np.frombuffer(encoded + end, "<u4"))
        if writer is not None:
            finish()
        yield pd.DataFrame(made, columns=["file", "entries", "tokens", "first_id", "last_id", "place"])

    made = rows.mapInPandas(write, "file string, entries long, tokens long, first_id long, last_id long, place long")
    made = materialize(made, "sst_manifest")
    order = Window.orderBy("place")  # one row per file
    start = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return made.withColumns({"shard": F.row_number().over(order), "start": start.cast("long")}).drop("place")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids of each entry of the shards of a manifest, read from the files."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for file, start in zip(pdf["file"], pdf["start"], strict=True):
                fs, place = _file_system(file)
                out, held = [], 0
                with fs.open_input_file(place) as source:
                    for doc_id, ids in Reader(source):
                        data = ids.tobytes()
                        out.append((doc_id, start, len(ids), zlib.crc32(data), data))
                        start, held = start + len(ids), held + len(data)
                        if held > 16 << 20:
                            yield _frame(out)
                            out, held = [], 0
                yield _frame(out)

    spread = manifest.select("file", "start").repartition(partitions(manifest.sparkSession), "file")
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
    return out.assign(doc_id=pd.array([r[0] for r in rows], "Int64"))  # exact where some are null


def lookup(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of the wanted identifiers: each goes to the shards whose key range holds it, then to one block of each.

    Files and wanted ids are sorted together by range; an id is asked of the last file that begins before it, and of those
    that begin with it.  The last file of each range is handed on to the ranges behind it (a row per range), so nothing is
    broadcast or compared in pairs.
    """
    n = partitions(manifest.sparkSession)
    ids = wanted.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"))
    files = manifest.select(F.col("first_id").alias("id"), "last_id", "file")
    both = files.withColumn("asked", F.lit(False)).unionByName(ids.withColumn("asked", F.lit(True)), allowMissingColumns=True)
    both = materialize(both.repartitionByRange(n, "id").withColumn("range", F.spark_partition_id()), "sst_asked")
    ends = both.groupBy("range").agg(F.max(F.when(~F.col("asked"), F.struct("id", "last_id", "file"))).alias("f"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    carried = ends.withColumn("f", F.max("f").over(earlier)).where("f IS NOT NULL").select(F.lit(_NO_ID).alias("id"), "f.last_id", "f.file", F.lit(False).alias("asked"), "range")
    by = Window.partitionBy("range").orderBy("id", F.desc("asked"), "last_id")
    before = F.last(F.when(~F.col("asked"), F.struct("last_id", "file")), ignorenulls=True).over(by)
    near = both.unionByName(carried).withColumn("f", before).where("asked AND id <= f.last_id").select("f.file", "id")
    near = near.unionByName(ids.join(files, "id").select("file", "id"))
    near = near.repartition("file")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for file, ids in pdf.groupby("file")["id"]:
                fs, place = _file_system(file)
                with fs.open_input_file(place) as source:
                    shard = Reader(source)
                    for id_ in ids.tolist():
                        own = None if id_ == _NO_ID else id_
                        out += [(own, x.tobytes()) for x in shard.get(own)]
            got = pd.DataFrame(out, columns=["doc_id", "ids"])
            yield got.assign(doc_id=pd.array([r[0] for r in out], "Int64"))

    return near.sortWithinPartitions("file").mapInPandas(read, "doc_id long, ids binary")


def op5_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, byte-level BPE, id 0 at the end of each."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    manifest = write_shards(docs, scratch_path(spark, "sst"), tokenizer_path("byte_bpe_50k.json"))
    return read_shards(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op5_sstable": op5_sstable}
ORACLE_SQL: dict[str, str] = {}
