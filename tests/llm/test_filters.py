import collections
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import quality as Q
from skein.llm import toxicity as X

from .conftest import ROWS, prose


def counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(grams)
    covered = {k for i, g in enumerate(grams) if n[g] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_base_statistics(spark, docs):
    odd = ["", "   ", None, "\x0b a", "A1!#é Ü?9 $x", "x x x", "a b c " * 400, "q " * 5, "a b c d e f a b c", "a b c a b d a b c",
           "a b c a b c", "a a a a", "x\ny\n\nx\n \n", "a b", "#|<>&", "a\vb\fc", "é" * 5 + " x", "a b c d a b c e b c d", "\r\nq\r\nq"]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    for r in Q.with_statistics(both).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(r.text), r.text[:40]


def test_clashing_statistics(docs, labelled):
    clash = docs.selectExpr("doc_id", "text", "size AS n_words", "block AS kept", "score AS rule", "lang AS `row`", "source AS words")
    out = Q.judge(clash, labelled[1])
    assert len(set(out.columns)) == len(out.columns) and {"row", "words"} <= set(out.columns)
    for r in out.collect():
        assert r.n_words == counts(r.text)[0] and isinstance(r.kept, bool)
    kept = Q.filter_documents(clash, labelled[1])
    assert kept.columns == clash.columns and kept.count() == out.where("kept").count()


@pytest.fixture(scope="module")
def labelled(spark):
    """300 clean texts, 100 with symbols, 60 in capitals; a toxic word in every sixth."""
    rows, labels = [], []
    for i in range(460):
        words = [f"w{(i * 31 + k * 7) % 997}x{k}" for k in range(80)]
        if i % 6 == 0:
            words[i % 70] = "vileword"
        text = " ".join(words)
        text = text.replace(" ", " %% ") if 300 <= i < 400 else text.upper() if i >= 400 else text
        rows.append((i, text))
        labels.append((i, int(i < 300), int(i % 6 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rules_find_low_quality(labelled):
    docs, labels = labelled
    rules = Q.learn(docs, labels)
    assert rules and len(rules) <= Q.MAX_RULES
    kept = {r.doc_id: r.kept for r in Q.judge(docs, labels).collect()}
    assert all(kept[i] == (i < 300) for i in kept)
    assert Q.filter_documents(docs, labels).count() == 300


def test_without_labels_only_base_rules(docs, none, labelled):
    labels = labelled[1].where("1 = 0")
    assert Q.learn(docs.select("doc_id", "text"), labels) == []
    for r in Q.judge(docs.select("doc_id", "text"), labels).collect():
        n, _, _, _, repeated = counts(r.text)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n) and r.kept == (not r.base_failed)
    out = Q.filter_documents(docs, labels)
    assert out.columns == docs.columns and out.count() == sum(1 for _, t, *_ in ROWS if not (counts(t)[0] < 50 or 2 * counts(t)[4] > counts(t)[0]))
    assert Q.filter_documents(none, labels).count() == 0


def test_toxicity_learns_the_word(labelled, docs, none):
    train, labels = labelled
    model = X.train(train, labels, ~X.held_out(F.col("doc_id")))
    scores = {r.doc_id: r.score for r in X.with_score(train, model).collect()}
    assert all((s >= X.THRESHOLD) == (i % 6 == 0) for i, s in scores.items())
    own = X.with_score(docs.drop("score"), model).select("doc_id", "text", "score").collect()
    assert len(own) == len(ROWS) and all(0 <= r.score <= 1 for r in own)
    blank = {round(r.score, 12) for r in own if not (r.text or "").strip()}
    assert len(blank) == 1
    assert X.with_score(none.drop("score"), model).count() == 0
    kept = X.filter_documents(docs, labels.where("doc_id < 0"))
    assert kept.columns == docs.columns and kept.count() == len(ROWS)


def test_held_out_fold_is_not_learned(spark, labelled):
    import zlib

    train, labels = labelled
    folds = {r.doc_id: r.h for r in train.select("doc_id", X.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in folds.items())
    flipped = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (X.train(train, x, ~X.held_out(F.col("doc_id"))) for x in (labels, flipped))
    assert a.bias == b.bias and (a.keys == b.keys).all() and (a.weights == b.weights).all()


def test_weights_are_few():
    r = np.random.default_rng(0)
    texts = [np.unique(r.integers(1, 5000, 60)).astype(np.uint32) for _ in range(400)]
    y = np.array([float(i % 5 == 0) for i in range(400)])
    texts = [np.union1d(t, [7_000_000]).astype(np.uint32) if v else t for t, v in zip(texts, y)]
    bias, keys, weights = X.fit(texts, y)
    assert 7_000_000 in keys and len(keys) < 400 and weights[list(keys).index(7_000_000)] == weights.max()
    assert prose(1, 3) == prose(1, 3)


def test_words_of_few_texts_are_learned():
    r = np.random.default_rng(1)
    texts = [np.unique(r.integers(1, 1 << 31, 60)).astype(np.uint32) for _ in range(400)]
    y = np.array([float(i % 5 == 0) for i in range(400)])
    few = 3_000_000_000
    for i in (0, 100, 200, 300):  # in four toxic texts and in no other
        texts[i] = np.append(texts[i], few).astype(np.uint32)
    bias, keys, weights = X.fit(texts, y)
    assert few in keys.tolist() and weights[keys.tolist().index(few)] > 0


def test_left_out_features_would_have_no_weight(monkeypatch):
    r = np.random.default_rng(2)
    texts = [np.unique(r.integers(1, 3000, 40)).astype(np.uint32) for _ in range(300)]
    y = np.array([float(i % 4 == 0) for i in range(300)])
    monkeypatch.setattr(X, "L1", 10.0)
    bias, keys, weights = X.fit(texts, y)
    # the same with z kept for every feature
    w, z, n = ({k: 0.0 for t in texts for k in t.tolist()} for _ in range(3))
    b = float(np.log(y.mean() / (1 - y.mean())))
    for epoch in range(X.EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(texts)):
            own = texts[i].tolist()
            g = 1 / (1 + np.exp(-(b + sum(w[k] for k in own)))) - y[i]
            for k in own:
                new = n[k] + g * g
                z[k] += g - (np.sqrt(new) - np.sqrt(n[k])) / X.ALPHA * w[k]
                n[k] = new
                w[k] = (-X.L1 - z[k]) / ((X.BETA + np.sqrt(new)) / X.ALPHA + X.L2) if z[k] < -X.L1 else 0.0
    want = {k: v for k, v in w.items() if v}
    assert sorted(want) == keys.tolist() and np.allclose([want[k] for k in sorted(want)], weights) and np.isclose(b, bias)


def plain_ftrl(rows, labels, score):
    """Scores of texts by FTRL over sets of tuples, one coordinate after the other; rows in the order of learning."""
    def parts(t):
        w = [x for x in re.split("[" + "".join(re.escape(chr(b)) for b in X.MARKS) + "]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) if x]
        return {(x,) for x in w} | {(a, b) for a, b in zip(w, w[1:])} | {(a, None, b) for a, b in zip(w, w[2:])}

    sets, w, z, n = [parts(t) for t in rows], {}, collections.Counter(), collections.Counter()
    bias = np.log(np.mean(labels) / (1 - np.mean(labels)))
    for epoch in range(X.EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            g = 1 / (1 + np.exp(-(bias + sum(w.get(k, 0.0) for k in sets[i])))) - labels[i]
            for k in sets[i]:
                new = n[k] + g * g
                z[k] += g - (np.sqrt(new) - np.sqrt(n[k])) / X.ALPHA * w.get(k, 0.0)
                n[k] = new
                w[k] = max(-X.L1 - z[k], 0.0) / ((X.BETA + np.sqrt(new)) / X.ALPHA + X.L2)
    return [1 / (1 + np.exp(-(bias + sum(w.get(k, 0.0) for k in parts(t))))) for t in score]


def test_query_against_plain_ftrl(spark, tmp_path):
    import zlib

    rows = [(i, prose(i, 30 + i % 40) + (" vile thing" if i % 5 == 0 else "") + (" Odd-WORD" if i % 10 == 1 else ""), "en", "a") for i in range(160)]
    rows += [(7, rows[7][1], "en", "a"), (900, None, "en", "a"), (901, "", None, None), (None, "vile", None, None)]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(150)] + [(900, 1, 0), (None, 1, 1), (3, 1, 0), (151, 1, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = X.op4_ftrl_toxicity(spark, str(tmp_path)).collect()
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    text, known = {i: t for i, t, *_ in rows}, {i: y for i, _, y in labels if i is not None and y is not None and not fold(i)}
    order = [r.doc_id for r in spark.createDataFrame([(i,) for i in known], "doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    want = plain_ftrl([text[i] for i in order], [known[i] for i in order], [t for _, t, *_ in rows])
    assert len(got) == len(rows)
    assert sorted(((str(r.doc_id), round(r.score, 6)) for r in got)) == sorted(((str(r[0]), round(float(s), 6)) for r, s in zip(rows, want)))
    assert all(r.held_out == fold(r.doc_id) and r.predicted == int(r.score >= 0.3) for r in got)
    assert any(r.predicted for r in got if r.held_out)


def test_labels_of_one_class_and_repeated_ids(spark, docs, labelled):
    train = labelled[0]
    for toxic, score in ((0, 0.0), (1, 1.0)):
        model = X.train(train, labelled[1].withColumn("toxic", F.lit(toxic)))
        assert {r.score for r in X.with_score(docs.drop("score"), model).collect()} == {score}
    model = X.train(train, labelled[1].where("doc_id < 0"))
    assert {r.score for r in X.with_score(docs.drop("score"), model).collect()} == {0.0}
    many = train.unionByName(spark.range(20_000).selectExpr("5L AS doc_id", "concat('zz extra text ', id) AS text"))
    a, b = X.train(train, labelled[1]), X.train(many, labelled[1])
    assert a.bias == b.bias and set(a.keys.tolist()) == set(b.keys.tolist())


@pytest.mark.skipif(not Path("/root/testdata/sf0.1/labels.parquet").exists(), reason="no test tables")
def test_held_out_recall(spark):
    folder = "/root/testdata/sf0.1"
    out = X.op4_ftrl_toxicity(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.02 * n[0, 0]
