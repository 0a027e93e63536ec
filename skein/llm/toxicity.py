"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are 32-bit hashes of single words, pairs of neighbours and pairs with one word between, present or not.  Each
coordinate has its own rate and an L1 bound, so that few weights are not zero; only these are broadcast.  Weights are not
below zero and the bias is the log-odds of the labels: no number of harmless words makes up for a toxic one, so long texts
and languages with few toxic texts are judged as others are.

The model is fitted on a bounded sample of labelled rows, in one task: at most TRAIN_ROWS by the hash of their id, one row of
each id, and of these all that still fit into TRAIN_FEATURES features, in that order.  Texts reach it as feature hashes; L1 alone selects
among them, whatever the number of texts that have a feature.  Scoring reads whole texts where they lie.

Defined cases: a null or empty text has the score that the bias alone gives; labels that are null or absent are not used;
of rows with one id the least text is learned; without labels every score is 0, and with labels of one class alone it is
that class; repeated rows score alike; other columns pass through `filter_documents` and are ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget_memos, table
from .hashing import MARKS, Words, batches, grams, mix

TRAIN_ROWS, TRAIN_FEATURES = 12_000, 16_000_000
EPOCHS = 8
#: FTRL-proximal: rate, its smoothing, L1 and L2.  L1 is chosen by four folds of the rows that may be learned from, see the README.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0
THRESHOLD = 0.3


def features(words: np.ndarray) -> np.ndarray:
    """The distinct 32-bit features of a text's word hashes, sorted."""
    parts = [mix(words), grams(words, 2), grams(words, 2, gap=1)]
    return np.unique((np.concatenate(parts) >> np.uint64(32)).astype(np.uint32))


@dataclass
class Model:
    bias: float
    keys: np.ndarray  # sorted features
    weights: np.ndarray

    def score(self, words: np.ndarray) -> float:
        z = self.bias
        if len(self.keys) and len(words):
            own = features(words)
            at = np.searchsorted(own, self.keys)
            at[at == len(own)] = 0
            z += float(self.weights[own[at] == self.keys].sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))) if np.isfinite(z) else float(z > 0)


def log_odds(labels: np.ndarray) -> float:
    """Of class 1; infinite where there is but one class, and minus infinity without labels."""
    if not labels.any() or labels.all():
        return np.inf if len(labels) and labels.all() else -np.inf
    return float(np.log(labels.mean() / (1 - labels.mean())))


def fit(texts: list[np.ndarray], labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, features and weights that are not zero, from feature arrays in a fixed order."""
    flat = np.concatenate(texts) if texts else np.empty(0, np.uint32)
    keys, count = np.unique(flat, return_counts=True)
    # each text moves z by less than 1 an epoch, so the others cannot pass L1: without them all weights are the same
    keys = keys[count * EPOCHS > L1]
    rows = []
    for own in texts:
        at = np.searchsorted(keys, own)
        at[at == len(keys)] = 0
        rows.append(at[keys[at] == own] if len(keys) else at[:0])
    z, n, w = np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(keys))
    bias = log_odds(labels)
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at = rows[i]
            p = 1.0 / (1.0 + np.exp(-np.clip(bias + w[at].sum(), -35, 35)))
            g = p - labels[i]
            n_old = n[at]
            n_new = n_old + g * g
            sigma = (np.sqrt(n_new) - np.sqrt(n_old)) / ALPHA
            z_new = z[at] + g - sigma * w[at]
            z[at], n[at] = z_new, n_new
            w[at] = np.maximum(-L1 - z_new, 0.0) / ((BETA + np.sqrt(n_new)) / ALPHA + L2)
    used = w != 0
    return bias, keys[used], w[used]


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, train_rows: int = TRAIN_ROWS) -> Model:
    """Fits on at most train_rows rows of docs (doc_id, text) that have a label (doc_id, toxic) and are `usable`."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(usable) if usable is not None else known
    # of labels that differ the greater one counts
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # bounded by train_rows
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = Words(MARKS)
        for pdf in batches(frames):
            own = [features(w).tobytes() for w in cut.of(pdf["text"].tolist())]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "features": own})

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, rows, held = [], [], 0
        for pdf in frames:
            for toxic, own in zip(pdf["toxic"], pdf["features"], strict=True):
                if held + len(own) // 4 > TRAIN_FEATURES:
                    continue  # texts that still have room are learned
                held += len(own) // 4
                y.append(float(toxic == 1))
                rows.append(np.frombuffer(own, np.uint32))
        classes = np.array(y)
        if np.isfinite(log_odds(classes)):
            bias, keys, weights = fit(rows, classes)
            yield pd.DataFrame({"feature": [-1, *keys.astype(np.int64).tolist()], "weight": [bias, *weights.tolist()]})
        else:
            yield pd.DataFrame({"feature": [-1], "weight": [log_odds(classes)]})

    vectors = texts.mapInPandas(extract, "doc_id long, toxic int, features binary")
    one = vectors.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")  # one task, bounded by train_rows
    found = one.mapInPandas(learn, "feature long, weight double").collect()  # the weights that are not zero
    bias = next((r["weight"] for r in found if r["feature"] < 0), -np.inf)
    pairs = sorted((r["feature"], r["weight"]) for r in found if r["feature"] >= 0)
    return Model(bias, np.array([f for f, _ in pairs], np.uint32), np.array([w for _, w in pairs], np.float64))


def with_score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget_memos()
        cut, own = Words(MARKS), shared.value
        for texts in parts:
            yield pd.Series([own.score(w) for at in range(0, len(texts), 512) for w in cut.of(texts.iloc[at : at + 512].tolist())], dtype=float)

    return docs.withColumn(name, score(F.col(text)))


def filter_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs whose score is below the threshold, with their own columns."""
    model = train(docs, labels, train_rows=train_rows)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text"))
    return with_score(own, model).where(F.col("score") < threshold).select("__row.*")


def held_out(doc_id: Column) -> Column:
    """The fold that learning never sees: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; learned from labelled rows outside the held-out fold, TRAIN_ROWS at most."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), ~held_out(F.col("doc_id")))
    out = with_score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op4_ftrl_toxicity": op4_ftrl_toxicity}
ORACLE_SQL: dict[str, str] = {}
