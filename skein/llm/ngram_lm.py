"""Language-model scores by stupid backoff over n-gram counts of the whole corpus.

Each document is scored by the counts of all other rows: its own n-grams are taken off first, or a text would be sure of
itself.  A word scores count(w-2 w-1 w) / count(w-2 w-1) where the trigram is known, else BACKOFF times the same one word
shorter, at last its share of all words; a word that no other row has counts as one more word.

Relations are joined in packed rows, as three n-grams a word would be many times the text: documents lie in blocks of fixed
size, by a hash of the row and its place; each block has its distinct n-grams, sorted by hash, with counts, in one row for
each of FAN hash ranges.  The ranges of up to FAN blocks meet in the count table, which is partitioned by hash, adds them up
and answers each row in its order.  Of more blocks, FAN at a time meet first; what they add up to goes to FAN finer ranges
with that of the others, and the answers come back the same way.  Blocks join their answers, explode their n-grams by
position and add up each document.  So a block makes at most FAN rows on each level, levels grow with the logarithm of the
corpus to the base FAN, no task's share grows, and an n-gram has one entry for each block, however frequent it is.

Words are runs of characters other than ASCII white space, A-Z in lower case.

Defined cases: a null or empty text has no words, a log score of 0 and no per-word score; repeated rows count as other rows
of each other; an empty table gives an empty result; other columns are ignored.  docs is read twice if its shuffle is lost:
hand in a table or a plan that deals its rows alike each time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, n_words, table
from .hashing import Words, grams, mix

BACKOFF = 0.4
#: Bytes of text in a block, about.
BLOCK_BYTES = 12 << 20
#: Blocks whose n-grams meet at once, and hash ranges of each block; a power of 2.
FAN = 4096
#: Tasks for each block, most of them empty.
SPREAD = 4
#: 56 bits of each hash travel: at a billion different n-grams one in 70 million shares its count with another.
_KEPT = np.uint64(0xFFFFFFFFFFFFFF00)
_OUT = "doc_id long, n_words long, n_trigram long, n_bigram long, n_unigram long, log_score double"
_NO_ID = -(1 << 63)


def _squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed planes of bytes: high bytes of small numbers cost next to nothing."""
    raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _spread(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(8, n).T.copy().view("<u8").reshape(n)


def _ranges(sorted_hashes: np.ndarray, parent: int, depth: int, fan: int) -> np.ndarray:
    """Where each of the fan equal parts of range `parent`, of fan ** depth, begins in a sorted list of hashes in it."""
    bits = (depth + 1) * (fan.bit_length() - 1)
    starts = np.array([(parent * fan + k) << (64 - bits) for k in range(fan)], np.uint64)
    return np.append(np.searchsorted(sorted_hashes, starts), len(sorted_hashes))


def _packed(block: int, parent: int, depth: int, fan: int, hashes: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """The rows of a block: one for each of the ranges that have n-grams of it."""
    cuts, out = _ranges(hashes, parent, depth, fan), []
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        part = slice(cuts[k], cuts[k + 1])
        out.append((parent * fan + k, block, _squeeze(np.diff(hashes[part], prepend=np.uint64(0))), _squeeze(counts[part])))
    return pd.DataFrame(out, columns=["range", "block", "hashes", "counts"])


def _added(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of a range: its n-grams with counts, the place in them of each entry of each row, and where rows end."""
    with np.errstate(over="ignore"):
        keys = [np.cumsum(_spread(x), dtype=np.uint64) for x in pdf["hashes"]]
    hashes, back = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(back, weights=np.concatenate([_spread(x) for x in pdf["counts"]]).astype(float), minlength=len(hashes))
    return hashes, sums.astype(np.uint64), back, np.cumsum([len(k) for k in keys])


def _answers(pdf: pd.DataFrame, sums: np.ndarray, back: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"block": pdf["block"], "range": pdf["range"], "sums": [_squeeze(a) for a in np.split(sums[back], ends[:-1])]})


_LIST, _SUMS = "range long, block long, hashes binary, counts binary", "block long, range long, sums binary"


def _totals(lists: DataFrame, n: int, fan: int, tasks: int, depth: int = 1) -> DataFrame:
    """block, range and the corpus counts of each packed row of n blocks, in the order of its n-grams."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        _, sums, back, ends = _added(pdf)
        return _answers(pdf, sums, back, ends)

    if n <= fan:
        return lists.repartition(tasks, "range").groupBy("range").applyInPandas(add, _SUMS)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, sums, _, _ = _added(pdf)
        return _packed(int(pdf["up"].iloc[0]), int(pdf["range"].iloc[0]), depth, fan, hashes, sums)

    def hand_back(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        _, _, back, ends = _added(pdf)
        sums = np.concatenate([_spread(x) for x in answers.sort_values("range")["sums"]])
        return _answers(pdf, sums, back, ends)

    lists = materialize(lists.withColumn("up", F.floor(F.col("block") / fan)), f"lm_lists{depth}")
    finer = _totals(lists.repartition(tasks, "up", "range").groupBy("up", "range").applyInPandas(merge, _LIST), -(-n // fan), fan, tasks, depth + 1)
    finer = finer.select(F.col("block").alias("up"), F.floor(F.col("range") / fan).alias("parent"), "range", "sums")
    pairs = lists.groupBy("up", "range").cogroup(finer.groupBy("up", "parent"))
    return pairs.applyInPandas(hand_back, _SUMS)


def _orders(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unigrams, bigrams and trigrams of a block's documents, one after the other."""
    makers = (mix, lambda w: grams(w, 2), lambda w: grams(w, 3))
    return tuple(np.concatenate([f(w) for w in words]) & _KEPT if words else np.empty(0, np.uint64) for f in makers)


def _left(hashes: np.ndarray, doc: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Counts of n-grams in other rows: those of the corpus, by rank of the hash, less those of the document itself.

    A stable sort keeps documents in order among equal hashes, so the n-grams of one document are neighbours.
    """
    order = np.argsort(hashes, kind="stable")
    ranked, owner = hashes[order], doc[order]
    fresh = np.empty(len(order), bool)
    fresh[:1] = True
    np.not_equal(ranked[1:], ranked[:-1], out=fresh[1:])
    del ranked
    total = sums[np.cumsum(fresh) - 1]
    fresh[1:] |= owner[1:] != owner[:-1]
    starts = np.flatnonzero(fresh)
    own = np.diff(starts, append=len(order))
    out = np.empty(len(order), np.int64)
    out[order] = total - np.repeat(own, own)
    return out


def _scores(words: list[np.ndarray], sums: np.ndarray, corpus: int) -> tuple[np.ndarray, ...]:
    """Per document of a block: words scored by trigram, by bigram, by unigram, and the log score."""
    size = np.array([len(w) for w in words])
    n, doc = int(size.sum()), np.repeat(np.arange(len(words), dtype=np.int32), size)
    rank = np.arange(n) - np.repeat(np.cumsum(size) - size, size)  # place in its document
    second, third = np.flatnonzero(rank >= 1), np.flatnonzero(rank >= 2)
    left = _left(np.concatenate(_orders(words)), np.concatenate([doc, doc[second], doc[third]]), sums)
    c1, c2, c3 = left[:n], np.zeros(n, np.int64), left[n + len(second) :]
    c2[second] = left[n : n + len(second)]
    others = corpus - size[doc].astype(float)
    score, by = np.where(c1 > 0, c1 / np.maximum(others, 1), 1 / (others + 1)), np.ones(n, np.int8)
    known = c2[second] > 0
    score[second] = np.where(known, c2[second] / np.maximum(c1[second - 1], 1), BACKOFF * score[second])
    by[second[known]] = 2
    known = c3 > 0
    score[third] = np.where(known, c3 / np.maximum(c2[third - 1], 1), BACKOFF * score[third])
    by[third[known]] = 3
    count = lambda k: np.bincount(doc[by == k], minlength=len(words))
    return count(3), count(2), count(1), np.bincount(doc, weights=np.log(score), minlength=len(words))


def score_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """doc_id, n_words, n_trigram, n_bigram, n_unigram, log_score, per_word for each row of docs (doc_id, text)."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(n_words(F.col("text"))).alias("words")).first()
    total, n = size["words"] or 0, max(1, -(-(size["bytes"] or 0) // block_bytes))
    rows = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # by the row and its place, so that repeated rows lie in many blocks
    dealt = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(n))
    tasks = SPREAD * n  # hashed numbers of blocks seldom meet in one of them
    rows = rows.withColumn("block", dealt).repartition(tasks, "block")

    def lists(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, counts = np.unique(np.concatenate(_orders(Words().of(pdf["text"].tolist()))), return_counts=True)
        return _packed(int(pdf["block"].iloc[0]), 0, 0, fan, hashes, counts)

    def finish(key: tuple, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        words = Words().of(pdf["text"].tolist())
        parts = [_spread(x) for x in answers.sort_values("range")["sums"]]
        sums = np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
        three, two, one, score = _scores(words, sums, total)
        found = {"doc_id": pdf["doc_id"].to_numpy(), "n_words": [len(w) for w in words], "n_trigram": three, "n_bigram": two, "n_unigram": one}
        return pd.DataFrame(found | {"log_score": score})

    told = _totals(rows.groupBy("block").applyInPandas(lists, _LIST), n, fan, tasks)
    out = rows.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(finish, _OUT)
    return out.withColumns({"doc_id": F.nullif("doc_id", F.lit(_NO_ID)), "per_word": F.try_divide("log_score", "n_words")})


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each by the counts of all others."""
    out = score_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.withColumns({"log_score": F.round("log_score", 4), "per_word": F.round("per_word", 6)})


QUERIES = {"op8_stupid_backoff": op8_stupid_backoff}
ORACLE_SQL = {
    "op8_stupid_backoff": f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), p AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d
), g AS (
  SELECT doc_id, i, w, lag(w) OVER o AS v, lag(w, 2) OVER o AS u FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), c AS (
  SELECT *, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS c1,
    count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY doc_id, v, w) AS c2,
    count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY doc_id, u, v, w) AS c3,
    count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS others
  FROM g
), k AS (
  SELECT *, lag(c1) OVER o AS x1, lag(c2) OVER o AS x2 FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), s1 AS (
  SELECT *, CASE WHEN c1 > 0 THEN c1 / others ELSE 1.0 / (others + 1.0) END::DOUBLE AS a FROM k
), s2 AS (
  SELECT *, CASE WHEN i = 1 THEN a WHEN c2 > 0 THEN c2::DOUBLE / greatest(x1, 1) ELSE {BACKOFF}::DOUBLE * a END AS b FROM s1
), s3 AS (
  SELECT *, CASE WHEN i > 2 AND c3 > 0 THEN 3 WHEN i > 1 AND c2 > 0 THEN 2 ELSE 1 END AS o,
    CASE WHEN i <= 2 THEN b WHEN c3 > 0 THEN c3::DOUBLE / greatest(x2, 1) ELSE {BACKOFF}::DOUBLE * b END AS s FROM s2
), t AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (o = 3) AS t3, count(*) FILTER (o = 2) AS t2, count(*) FILTER (o = 1) AS t1, sum(ln(s)) AS z
  FROM s3 GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(t3, 0)::BIGINT AS n_trigram, coalesce(t2, 0)::BIGINT AS n_bigram,
  coalesce(t1, 0)::BIGINT AS n_unigram, round(coalesce(z, 0), 4)::DOUBLE AS log_score, round(z / n, 6)::DOUBLE AS per_word
FROM d LEFT JOIN t USING (doc_id)"""
}
