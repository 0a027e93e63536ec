"""Connected components of a graph of links, by contraction to least neighbours.

Defined cases: links that repeat, or stand both ways round, are one; a link of a node to itself, or with a null end, says nothing and
names no node; an empty table of links has no nodes; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """node and comp, the least node that it reaches, for each node of links (a, b).

    Each round a node goes to its least neighbour, then on to where that one goes, and links follow their ends; links
    inside a group vanish, so the graph shrinks and a star is done in one round.  The minimum is partly taken before the
    shuffle, so a node of very many links is no burden to one task.  What a round leaves is a table of the shared folder.
    """
    edges = materialize(_distinct(links.select("a", "b")), "links")
    labels = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    labels = labels.withColumn("comp", F.col("node"))
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up"))
        further = step.select(F.col("a").alias("up"), F.col("up").alias("top"))
        step = materialize(step.join(further, "up").select("a", "top"), "links_up")
        goes = step.select(F.col("a").alias("comp"), "top")
        labels = labels.join(goes, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
        labels = materialize(labels, "labels")
        moved = edges.join(step, "a").select("b", F.col("top").alias("x"))
        moved = moved.join(step, F.col("b") == F.col("a")).select(F.col("x").alias("a"), F.col("top").alias("b"))
        edges = materialize(_distinct(moved), "links")
    return labels


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
