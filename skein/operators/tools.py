"""Plain tools over stored rows: scopes, lists, states and the routing of typed commands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, trim_white


def of_org(df: DataFrame, org: str, column: str = "org_id") -> DataFrame:
    return df.where(F.col(column) == org)


def not_deleted(df: DataFrame, column: str = "is_deleted") -> DataFrame:
    """Rows that are not marked as deleted; an absent mark is none."""
    return df.where(~F.coalesce(F.col(column), F.lit(False)))


def of_kinds(df: DataFrame, kinds: Sequence[str], column: str = "kind") -> DataFrame:
    return df.where(F.lower(column).isin([k.lower() for k in kinds]))


def of_partition(df: DataFrame, value: str, column: str = "partition_key") -> DataFrame:
    """The rows of one partition; on a table partitioned by the column no other file is read."""
    return df.where(F.col(column) == value)


def candidates(df: DataFrame, order: Sequence[str], n: int = 3) -> DataFrame:
    """The first few to choose from."""
    return df.orderBy(*order).limit(n)


def kind_first(kind: str, *rest: str, column: str = "kind") -> list[Column]:
    """An order with one kind before all others."""
    return [F.desc(F.col(column) == kind), *[F.asc(r) for r in rest]]


def listed_chapters(chapters: DataFrame, current: str, index: str = "chapter_index", key: str = "chapter_id") -> DataFrame:
    """chapters with is_current, in the order of their index."""
    return chapters.withColumn("is_current", F.col(key) == current).orderBy(index, key)


def newest_first_without_preview(rows: DataFrame, line: str, preview: int = 2) -> DataFrame:
    """Lines of a file after its preview lines, last line first."""
    return rows.where(F.col(line) > preview).orderBy(F.desc(line))


def label_key(label: Column | str, content_type: Column | str) -> Column:
    """The partition key of samples by label and content type."""
    kind = F.col(content_type) if isinstance(content_type, str) else content_type
    return F.concat(F.col(label) if isinstance(label, str) else label, F.lit("-"), F.replace(kind, F.lit("/"), F.lit("-")))


def not_recorded(found: DataFrame, recorded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys and hash are not recorded yet; nulls are equal to each other."""
    right = recorded.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return found.join(right, same, "left_anti")


def resource_files(used: DataFrame, entries: DataFrame, key: str = "key", path: str = "path") -> DataFrame:
    """used with the first file by path that holds the key, and whether it is unresolved."""
    first = entries.groupBy(key).agg(F.min(path).alias("resource_file"))
    return used.join(first, key, "left").withColumn("unresolved", F.col("resource_file").isNull())


def with_status(df: DataFrame, status: str, allowed: Sequence[str], column: str = "status") -> DataFrame:
    """df with a status out of a list; another one is an error before anything is read."""
    match = next((a for a in allowed if a.lower() == status.strip().lower()), None)
    if match is None:
        raise ValueError(f"unknown status {status}")
    return df.withColumn(column, F.lit(match))


def with_changes(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """df with the columns of changes that are not null, by key; changes has a row per key."""
    fields = [c for c in changes.columns if c != key]
    right = changes.select(F.col(key).alias("__key"), F.struct(*fields).alias("__new"))
    out = df.join(right, F.col(key) == F.col("__key"), "left")
    return out.select(*[F.coalesce(F.col(f"__new.{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns])


#: Quoted and bare parts of an argument, with escaped quotes and backslashes; possessive, so long arguments need no stack.
_QUOTED = r'"[^"\\]*+(?:\\[\\"]?+[^"\\]*+)*+"'
_ARGUMENT = rf'((?=\S)[^\s"\\]*+(?:(?:\\[\\"]?+|{_QUOTED})[^\s"\\]*+)*+)'


def arguments(text: Column) -> Column:
    """The arguments of a command line as an array; null where a quote is not closed.

    White space parts arguments outside quotes; a backslash makes a quote or a backslash part of one.
    """
    plain = F.regexp_replace(text, r'\\[\\"]', "")
    unbalanced = F.regexp_count(plain, F.lit('"')) % 2 == 1
    raw = F.regexp_extract_all(text, F.lit(_ARGUMENT), F.lit(1))
    # quotes that are not escaped go, then escapes
    bare = F.transform(raw, lambda x: F.regexp_replace(F.regexp_replace(x, r'(\\[\\"])|"', "$1"), r'\\([\\"])', "$1"))
    return F.when(is_blank(text), F.array().cast("array<string>")).when(~unbalanced, F.filter(bare, lambda x: x != ""))


def route_commands(inputs: DataFrame, commands: DataFrame, text: str = "text", key: str = "input_id", most: int = 1000) -> DataFrame:
    """key, outcome (NoMatch, SingleMatch, MultipleMatch), command_id and args of a single match, candidates in order.

    commands: command_id, triggers, ignore_case, priority, min_args, max_args, arg_pattern (of the first argument, or null).  A
    trigger must be followed by the end, white space or a mark.  Commands are a registry: more than `most` are an error.
    """
    listed = commands.limit(most + 1).collect()
    if len(listed) > most:
        raise ValueError("more commands than a registry holds")
    # the line and what follows a trigger are columns, so that each is made once however often it is named
    inputs = inputs.select(key, trim_white(F.coalesce(F.col(text), F.lit(""))).alias("__line"))
    one, tests, rest = F.col("__line"), [], {}
    for c in listed:
        first = F.lit(None).cast("struct<command_id:string,priority:int,args:array<string>>")
        for trigger in reversed([t.strip() for t in c["triggers"] or [] if t and t.strip()]):
            head = F.substring(one, 1, len(trigger))
            same = F.lower(head) == trigger.lower() if c["ignore_case"] else head == trigger
            following = F.substring(one, len(trigger) + 1, 1)
            begins = same & ((following == "") | following.rlike(r"[\s\p{P}]"))
            name = f"__args{len(rest)}"
            rest[name], args = F.when(begins, arguments(trim_white(F.substring(one, F.lit(len(trigger) + 1), F.length(one))))), F.col(name)
            ok = args.isNotNull() & F.size(args).between(c["min_args"], c["max_args"])
            if c["arg_pattern"] is not None:
                ok = ok & F.coalesce(F.try_element_at(args, F.lit(1)).rlike(c["arg_pattern"]), F.lit(False))
            first = F.when(ok, F.struct(F.lit(c["command_id"]).alias("command_id"), F.lit(c["priority"]).cast("int").alias("priority"), args.alias("args"))).otherwise(first)
        tests.append(first)
    if not tests:
        return inputs.select(key, F.lit("NoMatch").alias("outcome"), F.lit(None).cast("string").alias("command_id"), F.lit(None).cast("array<string>").alias("args"), F.array().cast("array<string>").alias("candidates"))
    hits = F.array_sort(F.array_compact(F.array(*tests)), lambda a, b: F.when(a["priority"] > b["priority"], -1).when(a["priority"] < b["priority"], 1).when(F.lower(a["command_id"]) < F.lower(b["command_id"]), -1).otherwise(1))
    out = inputs.withColumns(rest).select(key, hits.alias("__hits"))
    n = F.size("__hits")
    return out.select(
        key, F.when(n == 0, "NoMatch").when(n == 1, "SingleMatch").otherwise("MultipleMatch").alias("outcome"),
        F.when(n == 1, F.col("__hits")[0]["command_id"]).alias("command_id"), F.when(n == 1, F.col("__hits")[0]["args"]).alias("args"),
        F.transform("__hits", lambda h: h["command_id"]).alias("candidates"),
    )
