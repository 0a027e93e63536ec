"""Places and neighbours in the order of a few large groups, without a task that holds a group.

Rows are sorted into ranges of (group, order); each range numbers its own rows, and a table of one row per range and group
says how many come before.  So a group that holds a third of all rows is spread over as many tasks as it fills.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, partitions


def _ranged(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """row, g (the group), o (the order's values) and p (the range), as a table: both passes see the same ranges."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    rows = df.select(row, F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"g{i}") for i, c in enumerate(group)], F.lit(0).alias("g")).alias("g"), *[_bare(o).alias(f"o{i}") for i, o in enumerate(order)])
    n = partitions(df.sparkSession)
    return materialize(rows.repartitionByRange(n, "g", *_sorted(order)).withColumn("p", F.spark_partition_id()), "ranges")


def _bare(o: Column) -> Column:
    return o[0] if isinstance(o, tuple) else o


def _sorted(order) -> list[Column]:
    return [F.desc(f"o{i}") if isinstance(o, tuple) else F.asc(f"o{i}") for i, o in enumerate(order)]


def _columns(order: Sequence[str]) -> list:
    """Names as columns; one with a leading minus is descending."""
    return [(F.col(o[1:]), "desc") if o.startswith("-") else F.col(o) for o in order]


def with_place(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "place", total: str | None = None) -> DataFrame:
    """df with each row's place, from 1, in its group by order (a leading minus is descending), and if asked the group's size.

    Defined cases: a null group is a group; nulls come first in ascending and last in descending order; rows of equal order
    have different places in no fixed order; an empty table gives an empty result; columns of any names pass through.
    """
    keys = _columns(order)
    rows = _ranged(df, group, keys)
    counts = rows.groupBy("g", "p").agg(F.count("*").alias("n"))
    own = Window.partitionBy("g").orderBy("p")  # a row per range and group
    before = F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.select("g", "p", before.alias("before"), F.sum("n").over(Window.partitionBy("g")).alias("all"))
    local = rows.withColumn("k", F.row_number().over(Window.partitionBy("g", "p").orderBy(*_sorted(keys))))
    out = local.join(parts, ["g", "p"]).select("row.*", (F.col("before") + F.col("k")).cast("long").alias(name), F.col("all").alias("__all"))
    return out.withColumnRenamed("__all", total) if total else out.drop("__all")


def with_previous(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """df with the value of the row before in its group by order; null for the first, and where that value is null."""
    keys = _columns(order)
    rows = _ranged(df, group, keys).withColumn("v", F.struct(F.col("row").getField(value).alias("v")))
    sequence = F.struct(*[c for c in rows.columns if c.startswith("o")])
    if any(isinstance(k, tuple) for k in keys):
        raise ValueError("descending orders have no previous row here")
    last = rows.groupBy("g", "p").agg(F.max_by("v", sequence).alias("last"))
    own = Window.partitionBy("g").orderBy("p")
    parts = last.select("g", "p", F.lag("last").over(own).alias("carried"))
    by = Window.partitionBy("g", "p").orderBy(*_sorted(keys))
    out = rows.withColumn("b", F.lag("v").over(by)).join(parts, ["g", "p"])
    return out.select("row.*", F.coalesce("b", "carried").getField("v").alias(name))
