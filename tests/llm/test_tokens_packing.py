import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import packing as P
from skein.llm import sstable as B
from skein.llm.common import scratch_path
from skein.llm.tokens import Encoder, tokenizer_path

from .conftest import ROWS, prose

tokenizers = pytest.importorskip("tokenizers")
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def direct(name):
    t = tokenizers.Tokenizer.from_file(tokenizer_path(name))
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


_direct, _own = {n: direct(n) for n in FILES}, {n: Encoder(tokenizer_path(n), memo_units=50) for n in FILES}


PIECES = [*"ab'sté , .\n\t\r\x1c\x85   　ΣςİéÉ中😀0²<|>AB_-’́", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'ll", "Word", "thing"]
#: Each code point whose lower case has several, and one of each hundred others.
PIECES += [c for c in map(chr, range(0x110000)) if len(c.lower()) > 1 or (ord(c) % 101 == 0 and not 0xD800 <= ord(c) < 0xE000)][:600] + ["İ,", "İ!", "İ's"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*PIECES]), max_size=30).map("".join), min_size=1, max_size=5))
def test_units_encode_as_whole_texts(texts):
    for n in FILES:
        assert [np.frombuffer(b, "<u4").tolist() for b in _own[n].encode_batch(texts)] == _direct[n](texts)


def test_awkward_units_by_plain_calls():
    for n in FILES:
        for t in ["İ,", "İ!", "aİ's", "x<|endoftext|>y", " <|endoftext|> ", "<|startoftext|>A", "<|ENDOFTEXT|>", "a\xa0  b", " \n a\n\n b \n", "\n", " ", "  a", "a "]:
            assert np.frombuffer(_own[n].encode_batch(["b c", t, "", None, "d"])[1], "<u4").tolist() == _direct[n]([t])[0], ascii(t)


def expected(name, end):
    ids = _direct[name]([t or "" for _, t, *_ in ROWS])
    return [(r[0], np.array(x + [end], "<u4")) for r, x in zip(ROWS, ids)]


def test_sstable_round_trip(spark, docs, none):
    path = tokenizer_path(FILES[0])
    manifest = B.write_shards(docs, scratch_path(spark, "t"), path, block_bytes=512)
    rows = sorted(B.read_shards(manifest).collect(), key=lambda r: r.start)
    want = sorted(expected(FILES[0], 0), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in rows] == [i for i, _ in want]
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    assert sorted(bytes(r.ids) for r in rows) == sorted(x.tobytes() for _, x in want)
    found = B.lookup(manifest, spark.createDataFrame([(12,), (5,), (999,), (None,)], "doc_id long")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == [(False, 5), (False, 12), (False, 12), (True, 0)]
    assert {bytes(r.ids) for r in found if r.doc_id == 5} == {x.tobytes() for i, x in want if i == 5}
    assert B.read_shards(B.write_shards(none, scratch_path(spark, "t"), path)).count() == 0


def test_shard_file_lookup():
    sink = pa.BufferOutputStream()
    w = B.Writer(sink)
    for i in range(0, 3000, 3):
        w.add(B.key_of(i - 500), np.arange(i % 50, dtype="<u4") + 70_000 * (i % 2))
    assert w.close()[0] == 1000
    r = B.Reader(pa.BufferReader(sink.getvalue()))
    assert [x.tolist() for x in r.get(-500 + 33)] == [(np.arange(33) + 70_000).tolist()]
    assert r.get(-499) == [] and sum(r.may_have(i) for i in range(10_000, 11_000)) < 50
    assert [i for i, _ in r] == [i - 500 for i in range(0, 3000, 3)]


def test_lookup_over_files_and_ranges(spark):
    """Files of one block each: ids in several files, the first and last of a file, and between files."""
    rows = [(i * 3, prose(i, 40)) for i in range(60)] + [(33, prose(900 + i, 60)) for i in range(25)] + [(None, "x y"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    manifest = B.write_shards(docs, scratch_path(spark, "t"), tokenizer_path(FILES[0]), file_bytes=1, block_bytes=64).persist()
    assert manifest.count() > 8
    wanted = [None, 0, 1, 33, 34, 57, 177, 178, -5, 1 << 62]
    found = B.lookup(manifest, spark.createDataFrame([(w,) for w in wanted], "doc_id long")).collect()
    want = [(i, _direct[FILES[0]]([t or ""])[0] + [0]) for i, t in rows if i in wanted]
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in found), key=str) == sorted(want, key=str)
    at = 0
    for r in sorted(B.read_shards(manifest).collect(), key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [x for x, _ in sorted(((r.doc_id, r.start) for r in B.read_shards(manifest).collect()), key=lambda x: x[1])] == [
        x for x, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ]
    manifest.unpersist()


def test_pieces(docs, none):
    out = P.pack(docs, tokenizer_path(FILES[1]), sequence=256)
    rows = out.collect()
    sequences = {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_tokens))
    for own in sequences.values():
        own.sort()
        assert [o for o, *_ in own] == [sum(x[1] for x in own[:k]) for k in range(len(own))]
        total = sum(x[1] for x in own)
        assert total == own[0][2] <= 256 and total & (total - 1) == 0
    joined = []
    for start in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.doc_tokens, r.start)):
        joined.append(start)
    whole = {}
    for r in joined:
        whole.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for i, ids in expected(FILES[1], 2):
        own = whole[(i, len(ids))]
        copies = sum(1 for x in ROWS if x[0] == i)
        assert sum(r.length for r in own) == copies * len(ids)
        for r in own:
            assert bytes(r.ids) == ids[r.start : r.start + r.length].tobytes()
    assert P.pack(none, tokenizer_path(FILES[1])).count() == 0


def test_hilbert_curve_steps(monkeypatch):
    monkeypatch.setattr(P, "BITS", 2)
    grid = np.stack(np.meshgrid(*[np.arange(4)] * 4), -1).reshape(-1, 4)
    key = P.hilbert(grid)
    path = grid[np.argsort(key)]
    assert len(set(key.tolist())) == 256 and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_large_ids_beside_null_ones(spark):
    rows = [((1 << 62) + 1, "a b"), (None, "c"), (-(1 << 62) - 1, "d")]
    out = P.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path(FILES[1])).collect()
    assert {r.doc_id for r in out} == {r[0] for r in rows}


def test_neighbours_along_the_curve_are_alike(spark):
    """Eight topics, lengths from 20 to 900 words: neighbours share more tokens than in a random order, whatever their length."""
    rng = np.random.default_rng(4)
    common = prose(99, 400).split()
    topics = [[f"{w}{t}" for w in prose(t, 150).split()] for t in range(8)]
    rows = []
    for i in range(400):
        n = int(rng.integers(20, 900))
        words = [rng.choice(topics[i % 8]) if rng.random() < 0.6 else rng.choice(common) for _ in range(n)]
        rows.append((i, " ".join(words)))
    runs = P.tokenized(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path(FILES[1])).where("start = 0").orderBy("curve", "doc_id").collect()
    order = [r.doc_id for r in runs]
    same = lambda ids: np.mean([a % 8 == b % 8 for a, b in zip(ids, ids[1:])])
    assert same(order) > 0.5 > 0.2 > same(rng.permutation(order).tolist())
    length = [len(rows[i][1]) for i in order]
    assert abs(np.corrcoef(length[1:], length[:-1])[0, 1]) < 0.3
    assert max(len(r.ids) for r in runs) <= 4 * P.RUN


def test_ranges_hold_about_equal_tokens(spark):
    """One very long text, and a third of all rows alike."""
    rows = [(i, prose(7, 200) if i % 3 == 0 else prose(i, 50 + i % 400)) for i in range(1500)] + [(5000, prose(5000, 120_000))]
    out = P.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path(FILES[1])).collect()
    tokens = {}
    for r in out:
        tokens[r.sequence_id >> 32] = tokens.get(r.sequence_id >> 32, 0) + r.length
    assert len(tokens) == 4 and max(tokens.values()) <= 2 * sum(tokens.values()) / 4


def test_equal_rows_lie_in_many_ranges(spark):
    """Of 20,000 equal rows without id no range has more than twice the mean of the tokens."""
    docs = spark.createDataFrame([(None, prose(1, 20))] * 20_000, "doc_id long, text string").repartition(8)
    pieces = P.pack(docs, tokenizer_path(FILES[1]))
    parts = [r.n for r in pieces.groupBy(P.F.shiftright("sequence_id", 32).alias("part")).agg(P.F.sum("length").alias("n")).collect()]
    assert len(parts) == 4 and max(parts) <= 2 * sum(parts) / 4
    assert pieces.where("start = 0").count() == 20_000
