"""The whole run and each stage against plain versions, on small tables with awkward rows."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from skein.llm import quality
from skein.llm.common import materialize
from skein.llm.tokens import tokenizer_path

from . import brute
from .conftest import ROWS, prose
from .test_filters import plain_ftrl

tokenizers = pytest.importorskip("tokenizers")
COLUMNS = "doc_id long, text string, lang string, source string"


def corpus():
    """Clean, toxic, low-quality and short documents, exact and near copies, nulls, in three sources and none."""
    rows, labels = [], []
    for i in range(240):
        w = prose(i, 60 + i % 90).split()
        if i % 6 == 0:
            w[i % 50] = "vileword"
        low = i % 5 == 2
        text = " ".join(f"{x}#$%" if low else x for x in w)
        rows.append((i, text, "en", ["a", "b", None, "c"][i % 4]))
        if i < 200:
            labels.append((i, int(not low), int(i % 6 == 0)))
    rows += [(500 + i, rows[i][1], "fr", "a") for i in range(20)]  # copies
    for i in range(20, 40):  # near copies
        w = rows[i][1].split()
        w[3] = "changed"
        rows.append((500 + i, " ".join(w), None, "b"))
    rows += [(600, None, "en", "a"), (601, "", "en", None), (602, " \t\n", None, "b"), (603, "too short", "en", "a"), (604, prose(99, 3000), "en", "c"), (None, prose(98, 70), "en", "a")]
    rows += [rows[1], rows[3], rows[3]]  # repeated rows
    return rows, [*labels, (None, 1, 0), (3, None, 0), (7, 1, None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rows, labels = corpus()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def order_of(spark, ids, *salt):
    """ids in the order of Spark's hash, as the samples are drawn."""
    df = spark.createDataFrame([(i,) for i in sorted(ids)], "doc_id long")
    return [r.doc_id for r in df.orderBy(F.xxhash64(*[F.lit(s) for s in salt], "doc_id"), "doc_id").collect()]


def plain_quality(spark, rows, labels):
    known = {i: q for i, q, _ in labels if i is not None and q is not None}
    ids = spark.createDataFrame([(i,) for i in known], "doc_id long")
    prune = {r.doc_id for r in ids.where(F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(3)) == 0).collect()}
    samples = [(brute.shares(t), known[i] == 0, i in prune) for i, t, *_ in rows if i in known and not brute.base_fails(t)]
    return brute.decision_list(samples)


def plain_toxicity(spark, rows, labels):
    known, least = {}, {}
    for i, _, y in labels:
        if i is not None and y is not None:
            known[i] = max(known.get(i, 0), y)
    for i, t, *_ in rows:
        if i in known and t is not None:
            least[i] = min(least.get(i, t), t)
    order = order_of(spark, least)
    return plain_ftrl([least[i] for i in order], [known[i] for i in order], [t for _, t, *_ in rows])


def plain_run(spark):
    """The rows that reach the mix, by loops."""
    rows, labels = corpus()
    rules = plain_quality(spark, rows, labels)
    assert rules
    rows = [r for r in rows if not brute.rejects(rules, r[1])]
    rows = [r for r, s in zip(rows, plain_toxicity(spark, rows, labels)) if s < 0.3]
    comp = brute.components([t for _, t, *_ in rows])
    best = {}
    for r, c in zip(rows, comp):
        key = lambda x: (x[0] is None, x[0] or 0)
        best[c] = min(best.get(c, r), r, key=key)
    return rows, sorted(best.values(), key=str)


def test_run_against_plain_versions(spark, tables):
    filtered, mixed = plain_run(spark)
    texts = {r[0]: r[1] for r in mixed}
    size = {r[0]: len(brute.words_of(r[1])) for r in mixed}
    per = collections.Counter()
    for r in mixed:
        per[r[3]] += size[r[0]]
    target = brute.targets(per)
    encode = tokenizers.Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {i: np.array(encode.encode(t, add_special_tokens=False).ids + [2], "<u4") for i, t in texts.items()}
    pieces = C.run(spark, tables).collect()
    taken = collections.Counter()
    for r in pieces:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        taken[r.doc_id] += r.length
    source = {r[0]: r[3] for r in mixed}
    words = collections.Counter()
    for i, n in taken.items():
        copies, rest = divmod(n, len(ids[i]))
        rate = target[source[i]] / per[source[i]]
        assert rest == 0 and int(rate + 1e-9) <= copies <= min(2, int(rate + 1 - 1e-9))
        words[source[i]] += copies * size[i]
    assert all(abs(words[s] - target[s]) <= max(size[i] for i in size if source[i] == s) for s in target)
    filled = collections.Counter()
    for r in pieces:
        filled[r.sequence_id] += r.length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in filled.values())


def test_stages_before_the_mix_against_plain_versions(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    filtered, mixed = plain_run(spark)
    for name, stage in C.STAGES[:3]:
        docs = materialize(stage(spark, docs, tables), name)
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        if name == "toxicity":
            assert sorted(map(str, map(tuple, docs.collect()))) == sorted(map(str, filtered))
    assert sorted(str((r.doc_id, r.text)) for r in docs.collect()) == sorted(str(r[:2]) for r in mixed)


def test_verdict_of_the_quality_query(spark, tables):
    rows, labels = corpus()
    rules = plain_quality(spark, rows, labels)
    got = quality.op7_decision_list(spark, tables).collect()
    want = collections.Counter((r[0], *brute.counts(r[1]), brute.base_fails(r[1]), not brute.rejects(rules, r[1])) for r in rows)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == want


@pytest.mark.parametrize("name,stage", C.STAGES)
def test_stage_on_awkward_rows(spark, tables, name, stage):
    """Nulls, empty and very long texts, repeated rows, names that the stages use themselves, and no rows at all."""
    names = "copies n_words hashes row id tag kept score size body words whole".split()
    docs = spark.createDataFrame([(*r, *[f"{n}{i}" for n in names]) for i, r in enumerate(ROWS)], COLUMNS + "".join(f", `{n}` string" for n in names)).repartition(3)
    out = stage(spark, docs, tables)
    rows = out.collect()
    last = name == C.STAGES[-1][0]
    if not last:
        assert out.columns == docs.columns
        assert {tuple(r) for r in rows} <= {tuple(r) for r in docs.collect()}
    clean = {11, 5}  # long clean texts pass each filter; the mix may take a text no time
    if name != "source_mix":
        assert clean <= {r.doc_id for r in rows}
    empty = stage(spark, docs.where("1 = 0"), tables)
    assert empty.count() == 0 and empty.columns == out.columns
