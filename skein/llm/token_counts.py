"""Token counts of whole texts, without their ids.

An Arrow function takes the texts as bytes and returns two numbers for each; neither texts nor ids come back.  The rows of an
Arrow batch are dealt into groups of about equal bytes, however many rows these are; a longer text is split, so that no group
is larger than about BATCH bytes.  A text is split at a space between two ASCII letters or digits, where each supported
tokenizer cuts too, so the counts of its parts add up to that of the whole: byte-level tokenizers begin a piece with the space,
folding ones drop it, and sentencepiece models put it back as their prefix (one whose vocabulary has pieces across spaces
splits nothing).  The pass is narrow: no row moves.

Defined cases: a null text is empty, with 0 bytes and 0 tokens; strings of added tokens inside a text count as the library takes
them by default, as one token each; nothing is truncated; rows that repeat are counted each; an empty table gives no rows;
columns of docs named n_bytes, n_tokens or over_limit are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import Encoder, Pieces, encoder, parts_of, tokenizer_path

#: Bytes of text that are counted together, and most bytes of one part of a long text.
BATCH = 1 << 20
#: Tokens above which a document is over the limit.
LIMIT = 2048
_NEW = ("n_bytes", "n_tokens", "over_limit")


def byte_groups(sizes: np.ndarray, most: int = BATCH) -> list[tuple[int, int]]:
    """Ranges of rows with about equal bytes, at most about `most` each unless one row has more."""
    n = len(sizes)
    if not n:
        return []
    ends = np.cumsum(sizes)
    groups = max(1, -(-int(ends[-1]) // most))
    cuts = np.searchsorted(ends, ends[-1] * np.arange(1, groups) / groups, "right")
    edges = np.unique(np.concatenate([[0], cuts, [n]])).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


def count_array(texts: pa.Array, by: Encoder | Pieces, most: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of each text."""
    data = texts.cast(pa.large_binary())
    sizes = pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    tokens = np.zeros(len(sizes), np.int64)
    for a, b in byte_groups(sizes, most):
        held: list[bytes] = []
        owners: list[int] = []
        size = 0

        def flush(held=held, owners=owners) -> None:
            np.add.at(tokens, owners, by.count_batch(held))
            held.clear()
            owners.clear()

        for row, text in enumerate(data.slice(a, b - a).to_pylist(), a):
            for n, part in enumerate(parts_of(text or b"", most) if by.splits else [text or b""]):
                if held and size + len(part) > 2 * most:
                    flush()
                    size = 0
                held.append(part if by.keeps_space or not n else part[1:])
                owners.append(row)
                size += len(part)
        flush()
    return sizes, tokens


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit of a text column; path is a tokenizers .json or a sentencepiece .model."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in arrays:
            yield pa.StructArray.from_arrays([pa.array(x) for x in count_array(texts, encoder(path))], ["n_bytes", "n_tokens"])

    own = F.arrow_udf(run, "n_bytes long, n_tokens long")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in _NEW]
    rows = docs.select(F.struct(*kept).alias("row") if kept else F.struct(F.lit(0)).alias("row"), own(F.col(f"`{text}`")).alias("found"))
    fields = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in _NEW]
    return rows.select(*fields, "found.n_bytes", "found.n_tokens", (F.col("found.n_tokens") > limit).alias("over_limit"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, word BPE, limit 2048."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return count_tokens(docs, tokenizer_path("word_bpe_49k.json")).drop("text")


QUERIES = {"op11_token_counts": op11_token_counts}
ORACLE_SQL: dict[str, str] = {}
