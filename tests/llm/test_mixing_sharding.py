import collections

import numpy as np
import pandas as pd
import pytest

from skein.llm import mixing as M
from skein.llm import sharding as S

from .conftest import ROWS, prose


def waterfill(sizes, weights, share, most):
    """Targets by sharing the excess again until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        part = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if part[s] > most * sizes[s]}
        if not full:
            return out | part
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_targets_and_taken(docs):
    rows = M.mix(M.sizes_of(docs)).collect()
    size = collections.Counter()
    for _, t, _, s in ROWS:
        size[s] += len((t or "").split())
    want = waterfill(size, (5, 2, 1), 1.5, 2)
    taken = collections.Counter()
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    assert len(rows) == len(ROWS)
    assert sorted(rows, key=str) == sorted(M.mix(M.sizes_of(docs.repartition(5))).collect(), key=str)


def test_tree_over_blocks_comes_near(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 16)
    monkeypatch.setattr(M, "FANOUT", 3)
    rows = [(i, f"s{i % 3 if i % 4 else 0}", 1 + (i * 7919) % 400) for i in range(3000)]
    out = M.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"), weights=(1, 3, 2)).collect()
    taken, target = collections.Counter(), {}
    for r in out:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(out) == 3000 and all(abs(taken[s] - target[s]) <= 400 for s in target)


def test_documents_of_the_mix(docs, none):
    mixed = M.mix_documents(docs)
    assert mixed.columns == docs.columns
    taken, target = collections.Counter(), {r.source: r.target for r in M.mix(M.sizes_of(docs)).collect()}
    for r in mixed.collect():
        taken[r.source] += len((r.text or "").split())
    assert all(abs(taken[s] - target[s]) <= 30_000 for s in target)
    assert M.mix_documents(none).count() == 0


def test_expected_copies_are_kept():
    """Blocks of an upper layer, with unequal fractions and large rows: each row's mean over seeds is its fraction."""
    rng = np.random.default_rng(3)
    n = 60
    x = np.where(np.arange(n) % 2, 0.1, 0.9)
    size = np.where(np.arange(n) == 7, 400, rng.integers(1, 9, n))
    x[7] = 0.6
    pdf = pd.DataFrame({"doc_id": np.arange(n), "source": "s", "size": size, "tag": 0, "source_size": 1, "target": 1.0, "base": 0, "x": x, "block": 0, "open": True})
    mean, runs = np.zeros(n), 4000
    for seed in range(runs):
        out = M._pivot(pdf, seed).sort_values("doc_id")
        mean += out["x"].to_numpy() / runs
        assert out["open"].sum() <= 1 and abs((out["x"] * out["size"]).sum() - (x * size).sum()) < 1e-6
    assert np.abs(mean - x).max() < 4.5 * np.sqrt(0.25 / runs)


def test_many_equal_rows_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 64)
    monkeypatch.setattr(M, "CHUNK", 16)
    rows = [(None, "a", 7)] * 900 + [(5, "b", 3)] * 700 + [(i, "c", i % 50) for i in range(300)]
    out = M.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    assert collections.Counter((r.doc_id, r.source, r.size) for r in out) == collections.Counter(rows)
    taken, target = collections.Counter(), {}
    for r in out:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 50 for s in target)


def test_documents_with_awkward_columns(spark):
    """Repeated rows, absent keys and columns with the names that the mix uses itself."""
    rows = [(i % 5 if i % 4 else None, prose(i % 7, 5 + i % 3), "s" if i % 3 else None, i % 2, 1, "x", [i % 2]) for i in range(60)]
    names = "doc_id long, text string, source string, copies int, tag int, row string, size array<int>"
    docs = spark.createDataFrame(rows, names)
    mixed = M.mix_documents(docs)
    assert mixed.columns == docs.columns
    had, got = collections.Counter(map(str, rows)), collections.Counter(str(tuple(r)) for r in mixed.collect())
    assert set(got) <= set(had) and all(n <= 2 * had[r] for r, n in got.items())
    assert got.total() == sum(r.copies for r in M.mix(M.sizes_of(docs)).collect()) or abs(got.total() - 90) <= 15
    assert got == collections.Counter(str(tuple(r)) for r in M.mix_documents(docs.repartition(7)).collect())


@pytest.mark.parametrize("limit", [300, 2_000, 10**9])
def test_shards(docs, limit, spark):
    rows = S.shard_documents(docs, limit).collect()
    assert len(rows) == len(ROWS)
    used, keys = collections.Counter(), collections.defaultdict(set)
    for r in rows:
        used[r.shard] += r.n_bytes
        keys[r.shard].add(r.doc_id)
        assert len(r.shard) == r.depth
    for r in rows:
        assert r.shard_bytes == used[r.shard] and (used[r.shard] <= limit or len(keys[r.shard]) == 1)
        up = r.shard[:-1]  # no split without need: the parent was too large
        assert not r.shard or sum(v for s, v in used.items() if s.startswith(up)) > limit
    shards = sorted(used)
    assert not any(b.startswith(a) for a, b in zip(shards, shards[1:]))


def test_deep_directory(spark, none, monkeypatch):
    monkeypatch.setattr(S, "STEP", 2)
    rows = [(i, prose(i, 20)) for i in range(200)]
    out = S.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 400).collect()
    assert len(out) == 200 and max(r.depth for r in out) > 4
    assert S.shard_documents(none).count() == 0


def test_rows_that_differ_in_where_a_null_stands(spark):
    """No row is lost, whatever column, field, element or entry tells two rows apart."""
    rows = [
        (1, "a b c", "s", None, 5, [None, 1], {"k": None}, (None, 2)), (1, "a b c", "s", 5, None, [None, 1], {"k": None}, (None, 2)), (1, "a b c", "s", 5, None, [1], {"k": None}, (None, 2)),
        (1, "a b c", "s", 5, None, [1, None], {"k": None}, (None, 2)), (1, "a b c", "s", 5, None, None, {"k": 1}, (None, 2)), (1, "a b c", "s", 5, None, [], {"k": 1}, (None, 2)),
        (1, "a b c", "s", 5, None, [], {"j": 1}, (None, 2)), (1, "a b c", "s", 5, None, [], {"j": 1, "k": 2}, (None, 2)), (1, "a b c", "s", 5, None, [], {"k": 2, "j": 1}, (2, None)), (None, "a b c", "s", 5, None, [], {}, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, x int, y int, z array<int>, m map<string,int>, r struct<p:int,q:int>")
    shown = lambda df: sorted(str(r) for r in df.select("doc_id", "x", "y", "z", M.F.array_sort(M.F.map_entries("m")).alias("m"), "r").collect())
    tags = docs.select(M.identity(docs).alias("t")).distinct().count()
    assert tags == len(rows)
    mixed = M.mix_documents(docs, share=2.0)
    assert sorted(2 * shown(docs)) == shown(mixed)
    same = spark.createDataFrame([(1, {"a": 1, "b": 2}), (1, {"b": 2, "a": 1})], "doc_id long, m map<string,int>")
    assert same.select(M.identity(same).alias("t")).distinct().count() == 1
