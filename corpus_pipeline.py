"""The corpus pipeline: quality rules, toxicity, near-duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and returns the columns of documents; the last
returns the pieces of the packed sequences.  A row that the mix takes twice goes on twice.

Defined cases, for each stage: a null text counts as an empty one, which the quality rules reject; a null doc_id stays null and has no
labels; rows that repeat are judged alike, near-duplicates keep one of them; texts of any length are read whole; an empty table gives
an empty result; columns beyond those of documents pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import dedup, mixing, packing, quality, toxicity
from skein.llm.common import materialize, table
from skein.llm.tokens import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or a learned rule reject."""
    return quality.filter_documents(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored toxic."""
    return toxicity.filter_documents(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group."""
    return dedup.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes rows as often as the target weights ask for."""
    return mixing.mix_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json")).drop("ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("packing", packed_sequences),
]
#: The learned stages and the packing have no SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
