"""Agent-session analytics: turns, checkpoints, key facts, lists, notes, tool-call guards."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.python import canonical_json
from ..functions.text import has_all_tags, has_any_tag, slugify, trim_white
from ..storage import materialize, partitions
from .ranks import with_place, with_previous


def latest_turn(turns: DataFrame, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last row of each session and the turn before it; of each session the turn numbers are held, not the rows."""
    rest = [c for c in turns.columns if c != session]
    best = turns.groupBy(session).agg(F.max_by(F.struct(*rest), turn).alias("l"), F.count("*").alias("n_turns"), F.slice(F.sort_array(F.collect_set(turn), asc=False), 2, 1).alias("p"))
    return best.select(session, "l.*", "n_turns", F.try_element_at("p", F.lit(1)).alias("previous_turn"))


def turns_up_to(turns: DataFrame, anchors: DataFrame, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Turns of the sessions in anchors (session, anchor) that are not after the anchor: the history a branch starts with."""
    return turns.join(anchors, session).where(F.col(turn) <= F.col("anchor")).drop("anchor")


def call_signature(tool: Column | str, arguments: Column | str) -> Column:
    """The tool and its arguments as canonical JSON: the order of names and white space make no other call."""
    return F.concat_ws(":", F.col(tool) if isinstance(tool, str) else tool, F.coalesce(canonical_json(arguments), F.lit("")))


def loop_guard(calls: DataFrame, session: str, order: Sequence[str], signature: Column, warn: int = 2, suppress: int = 3, result: Column | None = None) -> DataFrame:
    """calls with nth (how often the session has made this call) and action: none, warn, suppress.

    With `result`, which tells the rows that bring a tool's result, there is no action before a session's first result; calls
    before it count, and rows with a result are calls too if they have a signature.
    """
    out = calls.withColumn("signature", signature)
    nth = F.row_number().over(Window.partitionBy(session, "signature").orderBy(*order))
    out = out.withColumn("nth", nth)
    active = F.lit(True)
    if result is not None:  # the first result of a session as a maximum of one row, partly taken before the shuffle
        at = F.struct(*order)
        first = out.where(result).groupBy(F.col(session).alias("__session")).agg(F.min(at).alias("__first"))
        out = out.join(first, F.col(session).eqNullSafe(F.col("__session")), "left")
        active = F.coalesce(at > F.col("__first"), F.lit(False))
    action = F.when(~active, "none").when(F.col("nth") >= suppress, "suppress").when(F.col("nth") >= warn, "warn").otherwise("none")
    return out.withColumn("action", action).drop("__session", "__first")


def active_facts(facts: DataFrame, session: str, kind: str, order: Sequence[str], exclusive: Sequence[str]) -> DataFrame:
    """facts with is_active: of an exclusive kind only a session's newest is."""
    n = F.row_number().over(Window.partitionBy(session, kind).orderBy(*[F.desc(c) for c in order]))
    return facts.withColumn("is_active", ~F.col(kind).isin(list(exclusive)) | (n == 1))


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key, as a maximum that is partly taken before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def newest(df: DataFrame, order: Sequence[str], limit: int = 100) -> DataFrame:
    """The newest rows by several keys."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(limit)


def move_item(items: DataFrame, group: str, order: str, item: Column, to: int, step: int = 10) -> DataFrame:
    """items with new_order 10, 20 .. after the item of each group moves to the 1-based position `to`, clamped."""
    w = Window.partitionBy(group)
    ranked = items.withColumn("__moved", item).withColumn("__r", F.row_number().over(w.orderBy(order)))
    ranked = ranked.withColumn("__n", F.count("*").over(w)).withColumn("__from", F.max(F.when(F.col("__moved"), F.col("__r"))).over(w))
    goal = F.least(F.greatest(F.lit(to), F.lit(1)), F.col("__n"))
    rank, source = F.col("__r"), F.col("__from")
    place = (
        F.when(source.isNull(), rank).when(F.col("__moved"), goal)
        .when((rank > source) & (rank <= goal), rank - 1).when((rank < source) & (rank >= goal), rank + 1).otherwise(rank)
    )
    return ranked.withColumn("new_order", (place * step).cast("int")).drop("__moved", "__r", "__n", "__from")


def next_order(items: DataFrame, group: str, order: str) -> DataFrame:
    return items.groupBy(group).agg((F.coalesce(F.max(order), F.lit(0)) + 10).alias("next_order"))


def unique_slugs(items: DataFrame, name: str, order: str, scope: str | None = None, default: str = "item") -> DataFrame:
    """items with base_slug and slug: each in order takes its base if that is free, else base-2, base-3 .. whichever is free first.

    Bases that can meet differ in ends of -n alone.  Where a scope has one base of a stem, as of all its blank names, an item's
    number is its place among those of its base, found by ranges whatever their number.  Only items of stems with several
    bases follow each other in one partition and are folded as they stream by; a task holds the slugs of one such stem.  Ignores
    case, as bases are in lower case.
    """
    base = F.coalesce(F.nullif(slugify(name), F.lit("")), F.lit(default))
    rows = items.withColumn("base_slug", base).withColumn("__stem", F.regexp_replace("base_slug", "(?:-[0-9]+)+$", ""))
    keys = [*([scope] if scope else []), "__stem"]
    several = rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg((F.min("base_slug") != F.max("base_slug")).alias("__several"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    rows = materialize(rows.join(several, same).drop(*[f"__k{i}" for i in range(len(keys))]), "slugs")
    alone = with_place(rows.where("NOT __several").drop("__several"), [*keys[:-1], "base_slug"], [order], "__n")
    numbered = F.when(F.col("__n") == 1, F.col("base_slug")).otherwise(F.concat_ws("-", "base_slug", F.col("__n").cast("string")))
    alone = alone.withColumn("slug", numbered).drop("__n", "__stem")
    return alone.unionByName(_folded_slugs(rows.where("__several").drop("__several"), keys, order))


def _folded_slugs(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The slugs of items of stems with several bases, one after the other."""
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, order, "base_slug")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, taken, following = object(), set(), {}
        for batch in batches:
            slugs = []
            for *key, own in zip(*[batch.column(k).to_pylist() for k in (*keys, "base_slug")], strict=True):
                if key != current:
                    current, taken, following = key, set(), {}
                slug = own
                while slug in taken:
                    n = following.get(own, 2)
                    following[own] = n + 1
                    slug = f"{own}-{n}"
                taken.add(slug)
                slugs.append(slug)
            kept = [c for c in batch.schema.names if c != "__stem"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(slugs, pa.string())], names=[*kept, "slug"])

    return rows.mapInArrow(run, StructType([*[f for f in rows.schema if f.name != "__stem"], StructField("slug", StringType())]))


def reconcile_calls(calls: DataFrame, results: DataFrame, key: str = "call_id") -> DataFrame:
    """key, n_calls, n_results, status: ok, missing, unexpected or duplicate."""
    c = calls.groupBy(key).agg(F.count("*").alias("n_calls"))
    r = results.groupBy(key).agg(F.count("*").alias("n_results"))
    j = c.join(r, key, "full_outer").fillna(0, ["n_calls", "n_results"])
    status = (
        F.when(F.col("n_calls") == 0, "unexpected").when(F.col("n_results") == 0, "missing")
        .when((F.col("n_calls") > 1) | (F.col("n_results") > 1), "duplicate").otherwise("ok")
    )
    return j.withColumns({"n_calls": F.col("n_calls").cast("long"), "n_results": F.col("n_results").cast("long")}).withColumn("status", status)


def first_occurrences(df: DataFrame, value: Column, order: str, ignore_case: bool = True) -> DataFrame:
    """Distinct values in the order in which they first occur: value, first_at, in the first casing."""
    v = trim_white(value)
    key = F.lower(v) if ignore_case else v
    return df.withColumn("value", v).groupBy(key.alias("key")).agg(F.min_by("value", order).alias("value"), F.min(order).alias("first_at"))


def recall_notes(notes: DataFrame, ids: Sequence[str] = (), tag: str | None = None, kind: str | None = None, least: int | None = None,
                 limit: int = 50, details: bool = True) -> DataFrame:
    """Notes (note_id, tags array, kind, importance, created, details) that meet all given tests, newest first."""
    if not ids and not tag and not kind:
        raise ValueError("ids, tag or kind is required")
    out = notes
    if ids:
        out = out.where(F.lower("note_id").isin([i.strip().lower() for i in ids]))
    if tag:
        out = out.where(has_any_tag("tags", [tag]))
    if kind:
        out = out.where(F.lower("kind") == kind.strip().lower())
    if least is not None:
        out = out.where(F.col("importance") >= least)
    if not details:
        out = out.withColumn("details", F.lit(None).cast("string"))
    return newest(out, ["created", "note_id"], limit)


def facts_by_tags(facts: DataFrame, tags: Sequence[str], mode: str = "any", active_only: bool = True) -> DataFrame:
    test = has_all_tags("tags", list(tags)) if mode == "all" else has_any_tag("tags", list(tags))
    return facts.where(test & (F.col("is_active") if active_only else F.lit(True)))


def evict_facts(facts: DataFrame, ids: Sequence[str], force: bool = False) -> DataFrame:
    """facts with the named ones inactive; one that needs resolution is an error unless forced."""
    named = F.col("fact_id").isin(list(ids))
    blocked = named & F.col("requires_resolution") & ~F.lit(force)
    gone = F.when(blocked, F.raise_error(F.concat(F.lit("needs resolution: "), "fact_id"))).when(named, False).otherwise(F.col("is_active"))
    return facts.withColumn("is_active", gone)


def reorder_chapters(chapters: DataFrame, order: Sequence[str], key: str = "chapter_id") -> DataFrame:
    """chapters with their place in the given order; asked and existing ids must be the same set."""
    wanted = F.array(*[F.lit(x) for x in order])
    have = chapters.agg(F.collect_set(key).alias("ids"))  # the chapters of one document
    ok = (F.size(F.array_except("ids", wanted)) == 0) & (F.size(F.array_except(wanted, "ids")) == 0)
    checked = have.select(F.when(ok, True).otherwise(F.raise_error(F.lit("ids differ from the existing chapters"))).alias("ok"))
    return chapters.join(F.broadcast(checked.where("ok"))).drop("ok").withColumn("place", F.array_position(wanted, F.col(key)).cast("int"))


def with_element(df: DataFrame, array: str, test, change: dict[str, Column]) -> DataFrame:
    """df with fields of the elements of an array of structs changed where test(element) holds."""
    def edit(x):
        out = x
        for k, v in change.items():
            out = out.withField(k, v)
        return F.when(test(x), out).otherwise(x)
    return df.withColumn(array, F.transform(array, edit))


def without_element(df: DataFrame, array: str, test) -> DataFrame:
    return df.withColumn(array, F.filter(array, lambda x: ~test(x)))


def split_ordinal(df: DataFrame, order: Sequence[str], share: float = 0.8) -> DataFrame:
    """df with part train for the first share of rows by order, else test; rows equal to the last of the share go with it.

    Ranges of the order are counted, and only the one that holds the cut is ranked inside; no task has more than a range.
    """
    keys = df.select(F.struct(*order).alias("k"))
    ranged = keys.repartitionByRange(partitions(df.sparkSession), "k").withColumn("p", F.spark_partition_id())
    # a row per range, on the driver
    ranges = sorted(ranged.groupBy("p").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).collect(), key=lambda r: r["p"])
    left = int(sum(r["n"] for r in ranges) * share)
    if left == 0:
        return df.withColumn("part", F.lit("test"))
    for r in ranges:
        if left <= r["n"]:
            break
        left -= r["n"]
    ends = df.sparkSession.createDataFrame([(r["lo"], r["hi"])], StructType([StructField(c, keys.schema["k"].dataType) for c in ("lo", "hi")]))
    inside = keys.join(F.broadcast(ends), F.col("k").between(F.col("lo"), F.col("hi"))).select("k")  # one row
    cut = inside.orderBy("k").offset(left - 1).limit(1).select(F.col("k").alias("cut"))
    return df.join(F.broadcast(cut)).withColumn("part", F.when(F.struct(*order) <= F.col("cut"), "train").otherwise("test")).drop("cut")


def naive_forecast(df: DataFrame, series: str, order: Sequence[str], value: str) -> DataFrame:
    """df with forecast: the value before in its series; a series may be of any length."""
    return with_previous(df, [series], order, value, "forecast")
