"""Ranked search against scores computed row by row, and the bitwise steps against plain integers."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import lexical as L

from .brute import LOWER
from .conftest import BASE, ROWS, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall((t or "").translate(LOWER))


def ranked(docs, items, k=10):
    """{(item_id, text): [(score, doc_id)]} by the definition."""
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c, c.total()) for i, c in own if c]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = {}
    for item, text in items:
        scores = []
        for i, c, n in own:
            m = 25 + (75 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out[item, text] = [(-s, None if a else i) for s, a, i in sorted(scores)[:k]]
    return out


def planes(values, bits):
    """Bit slices over 64-bit words."""
    words = -(-len(values) // 64)
    out = np.zeros((bits, words), np.uint64)
    for i, v in enumerate(values):
        for b in range(bits):
            out[b, i >> 6] |= np.uint64((v >> b & 1) << (i & 63))
    return out


def numbers(sliced, n):
    return [sum(int(sliced[b, i >> 6] >> np.uint64(i & 63) & np.uint64(1)) << b for b in range(len(sliced))) for i in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.lists(st.lists(st.integers(0, 1000), min_size=70, max_size=70), min_size=1, max_size=9), st.integers(1, 12))
def test_sums_and_best(n, rows, k):
    rows = rows[:n]
    total = [sum(c) for c in zip(*rows)]
    got = L.added(np.stack([planes(r, 14) for r in rows]))
    assert numbers(got, 70) == total
    want = sorted(((-v, i) for i, v in enumerate(total) if v))[:k]
    assert sorted((-v, i) for i, v in L.best(got, k)) == want


@given(st.lists(st.tuples(st.integers(0, (1 << 20) - 1), st.integers(0, 1 << 15)), min_size=1, max_size=40))
def test_products(pairs):
    slices = np.concatenate([np.packbits([[v >> b & 1] + [0] * 7 for b in range(20)], axis=1, bitorder="little") for v, _ in pairs], axis=1)
    out = L.multiplied(slices, np.array([f for _, f in pairs]), 36)
    assert [sum((int(out[b, i]) & 1) << b for b in range(36)) for i in range(len(pairs))] == [v * f for v, f in pairs]


def run(spark, docs, items, k=10, **sizes):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, score int").repartition(3)
    asked = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, rank int")
    return L.search(*L.build(frame, **sizes), asked, k).collect()


def check(rows, want):
    got = {}
    for r in rows:
        got.setdefault(r.item_id, []).append((r["rank"], r.score, r.doc_id))
    texts = {}
    for (item, _), found in want.items():
        texts.setdefault(item, []).extend((n, *x) for n, x in enumerate(found, 1))
    key = lambda x: [(v is None, v or 0) for v in x]
    assert {k: sorted(v, key=key) for k, v in got.items()} == {k: sorted(v, key=key) for k, v in texts.items() if v}


DOCS = [(i, t) for i, t, *_ in ROWS] + [(100 + i, prose(i, 30 + i)) for i in range(150)] + [(7, "...,;"), (8, "A"), (8, "a"), (None, "ALPHA-beta_gamma"), (None, None)]
ITEMS = [(1, BASE), (2, "alpha"), (3, "Alpha alpha BETA, héllo!"), (4, ""), (5, None), (6, "nothing here"), (7, "one"), (7, "two"), (8, "a"), (8, "a"), (None, "wörld"), (9, prose(11, 900))]


@pytest.mark.parametrize("sizes", [{}, {"most_rows": 7}, {"most_rows": 70, "most_bytes": 3000}])
def test_awkward_rows(spark, sizes):
    check(run(spark, DOCS, ITEMS, **sizes), ranked(DOCS, set(ITEMS)))


def test_ties_and_copies(spark):
    docs = [(i * 37 % 500, BASE if i % 3 else "alpha") for i in range(500)]
    check(run(spark, docs, [(1, "alpha beta"), (2, BASE)], 25), ranked(docs, [(1, "alpha beta"), (2, BASE)], 25))


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == [] and run(spark, DOCS, []) == [] and run(spark, [(1, "..")], ITEMS) == []


def test_an_item_of_very_many_terms(spark):
    """Sums of parts of an item, and groups of items, give what the whole gives."""
    frame = spark.createDataFrame(DOCS, "doc_id long, text string").coalesce(1)
    blocks, index, n = L.build(frame)
    items = [(r.item, r.terms, r.factors) for r in L.item_terms(spark.createDataFrame(ITEMS, "item_id long, text string"), blocks, n).collect()]
    words = pa.array(sorted({t for _, own, _ in items for t in own}))
    batch = index.toArrow().combine_chunks().to_batches()[0]
    row = {c: batch.column(c)[0] for c in batch.schema.names}
    row["terms"] = pa.scalar(row["terms"].as_py(), pa.list_(pa.string()))
    whole = sorted(L._search_block(row, items, words, 10))
    assert whole and all(sorted(L._search_block(row, items, words, 10, held)) == whole for held in (1, 2, 5, 30))


def test_turns_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEM_TERMS", 5)
    check(run(spark, DOCS, ITEMS), ranked(DOCS, set(ITEMS)))


def test_row_groups_are_of_few_blocks(spark):
    """Writers and readers hold a row group whole, so its size may not follow a task's number of blocks."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.hex(F.xxhash64("doc_id", i))), " ")
    docs = spark.range(12, numPartitions=1).toDF("doc_id").withColumn("text", text)
    for made in L.build(docs, most_rows=4)[:2]:
        found = [pq.ParquetFile(file.removeprefix("file://")).metadata for file in made.inputFiles()]
        rows = [m.row_group(i).num_rows for m in found for i in range(m.num_row_groups)]
        assert rows == [1, 1, 1]
