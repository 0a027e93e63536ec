"""Mixing sources to target weights by pivotal dependent rounding.

A source of weight w gets the share of the mix that its weight asks for, but at most `most` copies of its rows; what it
cannot take is shared again by weight.  With rate r = target / source size each row starts with floor(r) copies and the
fraction x = r - floor(r).  Fractions become whole by pivotal steps: two rows of a source exchange words until one
fraction is 0 or 1, with odds that keep each expected value; the words that the two take together never change.  Blocks
of a source are rounded side by side and leave one fraction each; those meet in the next layer of a reduction tree.  So a
source's taken words miss its target by part of a single row.

Rows that are alike are counted before they are dealt and travel in chunks, so a repeated or absent identifier is no
burden to one block.  Choices are hashes of seed and key, so runs agree whatever the partitions.

Defined cases: the doc_id -2 ** 63 counts as null; a null source is a source of its own, with the last place; a null or empty text has size 0 and takes
0 words; an empty table gives an empty mix; rows that repeat are rounded one by one; other columns are ignored by `mix`
and pass through `mix_documents`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget_memos, identity, materialize, n_words, table

#: Rows that one task rounds together, residuals that meet in one node of the tree, and equal rows that travel as one.
BLOCK, FANOUT, CHUNK = 8192, 512, 1024
_EPS = 1e-9
#: Stands for a null doc_id while rows are in pandas, which would make the column one of floats.
_NO_ID = -(1 << 63)
_ROWS = "doc_id long, source string, size long, tag long, source_size long, target double, base int, x double, block long, open boolean"


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source (source, n_rows, source_size, target); sizes has source and size.

    Sources stand in code-point order, null last, and weigh `weights`, repeating.  The shares that are not above their
    limit follow one common rate per weight, which the running sums over the sources in order of limit / weight give.
    The table of sources, not of rows, is ordered in one task: some tens of bytes for each source, so up to some tens of millions of
    sources.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most))
    by = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    onward = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("mix", F.sum("source_size").over(whole) * float(share))
    rate = (F.col("mix") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    per = per.withColumn("rate", rate)
    # the common rate is the one with just the full sources ahead; with fewer or more of them ahead it comes out lower
    target = F.least(F.col("cap"), F.max("rate").over(whole) * F.col("w"))
    return per.select("source", "n_rows", "source_size", target.alias("target"))


def _unit(seed: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number in [0, 1) from seed and two keys."""
    with np.errstate(over="ignore"):
        h = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return (h >> np.uint64(11)).astype(np.float64) / 2.0**53


def _pivot(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Rounds one block of rows of one source; at most one row stays open.

    Large rows go first.  A fraction that stays with a row of over 4 times the size of the next steps against all fractions
    still to come at once, where these have room: it becomes 1 with odds x, and they give its missing words, or 0, and they
    take its words.  Each gives 1 - x and takes x parts of one amount, so every expected value is kept, and the fraction left
    at the end is one of a small row.
    """
    if "n" in pdf:
        pdf = pdf.loc[pdf.index.repeat(pdf["n"])].drop(columns="n")
    pdf = pdf.sort_values(["size", "doc_id", "tag"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    x, size, opened = pdf["x"].to_numpy(float).copy(), pdf["size"].to_numpy(float), pdf["open"].to_numpy(bool).copy()
    rows = np.flatnonzero(opened)
    key = pdf["doc_id"].to_numpy(np.int64).view(np.uint64)
    pairs = key[np.roll(rows, 1)] + np.arange(len(rows), dtype=np.uint64) if len(rows) else key[rows]
    luck, alone = (_unit(s, key[rows], pairs).tolist() for s in (seed, seed ^ 0x5851F42D))
    held = -1
    for n, i in enumerate(rows.tolist()):
        if held >= 0 and size[held] > 4 * size[i]:
            rest, own = rows[n:], x[held]
            room = np.minimum(x[rest] / (1 - own), (1 - x[rest]) / own)
            if (total := float((room * size[rest]).sum())) >= 2 * size[held]:
                amount = room * (size[held] / total)
                x[rest] += -(1 - own) * amount if alone[n] < own else own * amount
                x[held] = float(alone[n] < own)
                opened[held], held = False, -1
        if held < 0:
            held = i
            continue
        j = held
        to_i = min((1 - x[i]) * size[i], x[j] * size[j])  # words that can go from j to i
        to_j = min(x[i] * size[i], (1 - x[j]) * size[j])
        moved = to_i if luck[n] * (to_i + to_j) < to_j else -to_j
        x[i] += moved / size[i]
        x[j] -= moved / size[j]
        held = -1
        for k in (j, i):
            if x[k] <= _EPS or x[k] >= 1 - _EPS:
                x[k], opened[k] = round(x[k]), False
            else:
                held = k
    return pdf.assign(x=x, open=opened)


def _node(seed: int):
    def round_block(pdf: pd.DataFrame) -> pd.DataFrame:
        forget_memos()
        return _pivot(pdf, seed)

    return round_block


def mix(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 20_231) -> DataFrame:
    """doc_id, size, tag, source, source_size, target, copies, taken for each row of sizes (doc_id, source, size, and tag if rows of
    equal values are to be told apart by it).

    sizes is read several times: hand in a table, not a long plan.
    """
    aims = materialize(targets(sizes, weights, share, most), "mix_targets")
    largest = aims.agg(F.max("n_rows")).first()[0] or 0
    n_blocks = F.ceil(F.col("n_rows") / BLOCK)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.least(F.floor(rate + _EPS), F.lit(most)).cast("int")
    x = F.greatest(rate - base, F.lit(0.0))
    tag = F.col("tag") if "tag" in sizes.columns else F.lit(0).cast("long")
    alike = sizes.groupBy(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "source", "size", tag.alias("tag")).agg(F.count("*").alias("m"))
    chunks = alike.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / CHUNK).cast("long"))))
    rows = (
        chunks.alias("s").join(F.broadcast(aims.alias("a")) if _small(aims) else aims.alias("a"), F.col("s.source").eqNullSafe(F.col("a.source")))
        .select("doc_id", "s.source", "s.size", "tag", "a.source_size", "a.target", base.alias("base"), x.alias("x"),
                F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "tag", "chunk"), n_blocks).alias("block"),
                F.least(F.col("m") - F.col("chunk") * CHUNK, F.lit(CHUNK)).cast("int").alias("n"))
        .withColumn("open", (F.col("size") > 0) & (F.col("x") > _EPS) & (F.col("x") < 1 - _EPS))
        .withColumn("x", F.when(F.col("open"), F.col("x")).otherwise(F.round("x")))
    )
    blocks = max(1, -(-largest // BLOCK))
    done, layer = [], 0
    while True:
        rounded = materialize(rows.groupBy("source", "block").applyInPandas(_node(seed + layer), _ROWS), f"mix_layer{layer}")
        if blocks == 1:
            done.append(rounded)
            break
        done.append(rounded.where(~F.col("open")))
        rows = rounded.where("open").withColumn("block", F.floor(F.col("block") / FANOUT))
        blocks, layer = -(-blocks // FANOUT), layer + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    lucky = (F.pmod(F.xxhash64(F.lit(seed), F.lit("last"), "doc_id", "tag"), F.lit(1 << 30)) / float(1 << 30)) < F.col("x")
    copies = (F.col("base") + F.when(F.col("open"), lucky.cast("int")).otherwise(F.col("x").cast("int"))).cast("int")
    return out.withColumn("copies", copies).select(
        F.nullif("doc_id", F.lit(_NO_ID)).alias("doc_id"), "size", "tag", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


def _small(df: DataFrame, limit: int = 10_000) -> bool:
    """Whether df has at most so many rows; reads no more than that."""
    return len(df.select(F.lit(1)).limit(limit + 1).collect()) <= limit


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, source and number of words of each row, as a table of the shared folder: texts are read once."""
    return materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix_sizes")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs, each as often as the mix takes it, with all their columns.

    Rows are told apart by a hash of all their columns, nulls and maps included; those that are wholly alike are one row with
    the copies of all, so no order among them is needed.
    """
    names = [f"`{n}`" for n in docs.columns]
    rows = docs.select(F.struct(*names).alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"), identity(docs).alias("tag"))
    key = {"id": F.coalesce("doc_id", F.lit(_NO_ID)), "src": F.coalesce("source", F.lit(""))}  # one shuffle serves both below
    by = [*key, "size", "tag"]
    chosen = mix(materialize(rows.drop("row"), "mix_sizes"), **options).withColumns(key)
    chosen = chosen.groupBy(*by).agg(F.sum("copies").alias("copies")).where("copies > 0")
    taken = rows.withColumns(key).groupBy(*by).agg(F.first("row").alias("row")).join(chosen, by).select("row", "copies")
    # in two steps, so that no array grows with the copies of one row
    some = taken.select("row", "copies", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / CHUNK))).alias("part"))
    each = F.sequence(F.lit(1), F.least(F.col("copies") - F.col("part") * CHUNK, F.lit(CHUNK)))
    return some.select("row", F.explode(each)).select("row.*")


def op2_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, weights 5, 2, 1, 150 % of all words, at most twice."""
    out = mix(sizes_of(table(spark, sf_dir, "documents", "doc_id", "text", "source")))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {"op2_pivotal_mixing": op2_pivotal_mixing}
ORACLE_SQL: dict[str, str] = {}
