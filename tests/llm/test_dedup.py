import re
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import dedup as D
from skein.llm.components import components
from skein.llm.hashing import Words, shingles

from .conftest import BASE, ROWS, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """Component and set size of each row, from all pairs."""
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(rows)))

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                comp[top(i)] = top(j)
    inf = float("inf")
    least = {}
    for i, r in enumerate(rows):
        least[top(i)] = min(least.get(top(i), inf), inf if r[0] is None else r[0])
    return sorted(((r[0] is None, r[0] or 0), len(sets[i]), least[top(i)]) for i, r in enumerate(rows))


def result(df):
    inf = float("inf")
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, inf if r.component_id is None else r.component_id) for r in df.collect())


def test_components_of_awkward_rows(docs):
    out = D.near_duplicates(docs)
    assert result(out) == brute(ROWS)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_families_across_buckets(spark, monkeypatch):
    """A chain of edits, where the ends are not alike, and documents that share a long passage but are not linked."""
    monkeypatch.setattr(D, "SMALL", 2)
    monkeypatch.setattr(D, "SKETCH_BLOCK", 8)
    monkeypatch.setattr(D, "SET_BLOCK", 8)
    text, rows = prose(50, 100).split(), []
    for i in range(40):
        rows.append((100 + (i * 17) % 40, " ".join(text)))
        text[(i * 13) % 100] = f"edit{i}"
        text[(i * 29 + 7) % 100] = f"more{i}"
    shared = prose(60, 60)
    rows += [(500 + i, shared + " " + prose(70 + i, 45)) for i in range(30)]
    assert result(D.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_one_bucket_of_many_classes(spark, monkeypatch):
    """2,500 documents share a passage of less than three quarters: none may travel into blocks; one near the threshold does."""
    monkeypatch.setattr(D, "SMALL", 4)
    shared = prose(60, 60)
    rows = [(i, shared + " " + " ".join(f"own{i}w{k}" for k in range(40))) for i in range(2500)]
    most = prose(61, 200)
    rows += [(5000 + i, most + " " + " ".join(f"few{i}w{k}" for k in range(44 - 22 * (i in (3, 4))))) for i in range(40)]
    seen, pairs = [], D._block_pairs

    def counted(df, *args):
        seen.append(df.count())
        return pairs(df, *args)

    monkeypatch.setattr(D, "_block_pairs", counted)
    got = D.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and sum(seen) <= 40 * 40 + 40
    comps = {r.doc_id: r.component_id for r in got}
    assert all(comps[i] == i for i in range(2500))
    few = [r for r in rows if r[0] >= 5000]
    assert sorted(((False, i), comps[i]) for i, _ in few) == [(k, c) for k, _, c in brute(few)]


@pytest.mark.skipif(not Path("/root/testdata/sf0.01/documents.parquet").exists(), reason="no test tables")
def test_links_of_each_hundredth_document(spark):
    """Exact links of every id divisible by 100, against all rows: each lies within a component."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    cut = Words()
    sets = {i: set(shingles(cut.of([t])[0]).tolist()) for i, t in rows}
    comps = {r.doc_id: r.component_id for r in D.op1_setsketch_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert set(comps) == set(sets)
    links = [(q, i) for q in sets if q % 100 == 0 for i in sets if i != q and sets[q] and 100 * len(sets[q] & sets[i]) >= 75 * len(sets[q] | sets[i])]
    assert links and all(comps[q] == comps[i] for q, i in links)


def test_keep_one_with_clashing_names(spark):
    rows = [(1, BASE, 5, "a"), (2, BASE, 6, "b"), (3, prose(9, 60), 7, "c"), (3, prose(9, 60), 8, "c"), (None, None, 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, body string").withColumn("row", F.lit(1)).withColumn("kept", F.lit(2))
    out = D.keep_one(docs)
    assert out.columns == docs.columns and sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 3]


def test_keep_one(docs, none):
    kept = D.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.select("doc_id").collect())
    want = {(r.doc_id is None, r.doc_id or 0) for r in D.near_duplicates(docs).where("kept").collect()}
    assert ids == sorted(want)
    assert D.keep_one(none).count() == 0 and D.near_duplicates(none).count() == 0


def test_sketches_merge():
    a, b = (shingles(w) for w in Words().of([prose(1, 300), prose(2, 300)]))
    both = D.registers(np.union1d(a, b))
    assert (D.merge(D.registers(a), D.registers(b)) == both).all()


@settings(max_examples=15, deadline=None)
@given(st.floats(0.76, 1.0), st.integers(0, 1 << 30))
def test_likely_pairs_are_never_dropped(share, seed):
    r = np.random.default_rng(seed)
    x = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    n = int(400 * (1 - share) / (1 + share))
    a, b = x, np.concatenate([x[n:], r.integers(0, 1 << 63, n, dtype=np.uint64)])
    p, q = D.registers(a), D.registers(b)
    one = lambda v: np.array([v])
    assert D.plausible(one((p > q).sum()), one((p < q).sum()), one(400.0), one(400.0))[0]


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.comp) for r in components(links).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_rows_of_one_id_meet_by_their_texts(spark):
    """Many texts of one id and of none: each is joined with itself alone, and keep_one keeps one row of each component."""
    near = lambda i, k: f"{prose(900 + i, 60)} tail{k}"
    rows = [(None, near(i, k)) for i in range(150) for k in range(2)] + [(7, near(i, 2)) for i in range(150, 300)] + [(3, near(0, 5)), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketched = D.sketches(docs).where("n_shingles > 0")
    classes = sketched.groupBy("set_id").agg(F.min(F.struct("id", "body")).alias("x")).select(F.monotonically_increasing_id().alias("node"), F.col("x.id").alias("rep"), F.col("x.body").alias("body"), "set_id")
    texts = docs.select(F.coalesce("doc_id", F.lit(D._NO_ID)).alias("rep"), F.xxhash64("text").alias("body")).join(classes, ["rep", "body"])
    assert texts.count() == 451
    kept = D.keep_one(docs).collect()
    want = [(3, near(0, 5))]
    found = {(r.doc_id, r.text) for r in kept}
    assert want[0] in found and not {(None, near(0, 0)), (None, near(0, 1))} & found
    for i in range(1, 150):
        assert len({(None, near(i, 0)), (None, near(i, 1))} & found) == 1
    assert sum(r.doc_id == 7 for r in kept) == 150 and len(kept) == 1 + 149 + 150 + 2


def test_components_of_awkward_links(spark):
    links = spark.createDataFrame([(1, 2, "x"), (2, 1, "x"), (2, 3, "y"), (5, 5, "z"), (None, 7, "z"), (8, None, "z"), (10, 9, "z"), (1, 2, "x")], "a long, b long, comp string")
    assert sorted((r.node, r.comp) for r in components(links).collect()) == [(1, 1), (2, 1), (3, 1), (9, 9), (10, 9)]
    assert components(links.where("1 = 0")).count() == 0
