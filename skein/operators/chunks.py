"""Splitting text: fixed windows, Markdown sections, line offsets and greedy packing under a token budget."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.text import CJK, URL, WHITE, WORD, is_blank
from .ranks import with_place

#: Budget of a chunk in tokens and lines repeated in the next (fixed values).
BUDGET, OVERLAP = 4096, 6
SECTION_TOKENS = 6500


def section_sizes(tokens: int = SECTION_TOKENS) -> tuple[int, int]:
    """Characters of a section and of the overlap for a token budget."""
    return max(512, 4 * tokens), 4 * min(256, tokens // 4)


def fixed_windows(df: DataFrame, size: int, overlap: int, text: str = "text") -> DataFrame:
    """One row per window of `size` characters: part, total, start (from 1), chunk.  An overlap not below size counts as none."""
    step = size - overlap if 0 <= overlap < size else size
    n = F.length(text)
    # the windows begin a step apart until one reaches the end
    total = F.greatest(F.ceil((n - size) / float(step)), F.lit(0)).cast("int") + 1
    parts = df.where(n > 0).withColumn("total", total).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("total"))))
    start = ((F.col("part") - 1) * step + 1).cast("int")
    return parts.withColumn("start", start).withColumn("chunk", F.substring(F.col(text), F.col("start"), F.lit(size)))


def markdown_sections(df: DataFrame, level: int = 3, text: str = "text") -> DataFrame:
    """One row per section that starts with a heading of the level, and one for what stands before; header is its first line."""
    pieces = F.split(text, rf"(?m)(?=^#{{{level}}}[ \t]+)")
    out = df.select("*", F.posexplode(F.filter(pieces, lambda p: ~is_blank(p))).alias("section", "body"))
    return out.withColumn("header", F.trim(F.regexp_extract("body", rf"^#{{{level}}}[ \t]+([^\n]*)", 1)))


def line_offsets(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line (from 1), start_char (from 0), n_chars; only lengths are shuffled, not text."""
    lengths = F.transform(F.split(text, "\n", -1), lambda x: F.length(x))
    rows = df.select(key, F.posexplode(lengths).alias("i", "n_chars"))
    before = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n_chars") + 1).over(before), F.lit(0))
    return rows.select(key, (F.col("i") + 1).alias("line"), start.cast("long").alias("start_char"), "n_chars")


def part_totals(df: DataFrame, group: str, order: str) -> DataFrame:
    """df with part (from 1) and total in its group; a group may be of any size."""
    return with_place(df, [group], [order], "part", "total").withColumn("part", F.col("part").cast("int"))


def _class(s: str) -> str:
    """A class of the column functions for Python's re, which has no \\p."""
    s = s.replace(r"\p{L}\p{Mn}\p{Nd}\p{Pc}", r"\w").replace(r"\x{85}\p{Z}", "\x85\xa0  -     　")
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), s)


_CJK, _URL = re.compile(f"[{_class(CJK)}]"), re.compile(_class(URL))
_MARK, _WORD = re.compile(f"[^{_class(WORD)}{_class(WHITE)}]"), re.compile(f"[{_class(WORD)}]+")


def estimate(s: str) -> int:
    """functions.text.estimate_tokens for one line, inside the packing loop."""
    if not s or s.isspace():
        return 0
    cjk = len(_CJK.findall(s))
    urls = sum(max(8, math.ceil(len(u) / 3)) for u in _URL.findall(s))
    by_kind = math.ceil((len(s) - cjk) / 4) + cjk + urls + math.ceil(len(_MARK.findall(s)) / 3)
    return max(by_kind, math.ceil(0.7 * len(_WORD.findall(s)))) + 2


def slices(line: str, budget: int) -> Iterator[tuple[int, str]]:
    """Parts of one long line that fit the budget, broken softly near their ends; with their places."""
    at = 0
    while at < len(line):
        size = min(len(line) - at, max(1, 4 * budget))
        while size > 1 and estimate(line[at : at + size]) > budget:
            size = max(1, int(size * 0.9))
        if at + size < len(line):
            tail = line[max(at, at + size - 80) : at + size]
            soft = max(tail.rfind(c) for c in " ,;)]}")
            if soft > 0:
                size -= len(tail) - soft - 1
        yield at, line[at : at + size]
        at += size


def pack_lines(text: str, budget: int = BUDGET, overlap: int = OVERLAP) -> Iterator[tuple[int, int, str]]:
    """Chunks of whole lines under the budget: first line, last line (from 1), text.

    A line above the budget is sliced.  A chunk starts `overlap` lines before the last one ended, so one that ends with the
    text is followed by its own tail.
    """
    lines = re.split("\r\n|\n", text)
    cursor, end = 0, len(lines)
    costs = [estimate(x) + 1 for x in lines]
    while cursor < end:
        stop, spent = cursor, 0
        while stop < end and spent + costs[stop] <= budget:
            spent += costs[stop]
            stop += 1
        if stop == cursor:
            for _, part in slices(lines[cursor], budget):
                yield cursor + 1, cursor + 1, part
            cursor += 1
            continue
        yield cursor + 1, stop, "\n".join(lines[cursor:stop])
        back = stop - overlap
        cursor = back if back > cursor else stop


def greedy_chunks(df: DataFrame, key: str, budget: int = BUDGET, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """key, part, total, first_line, last_line, tokens, chunk; rows are packed where they lie, as the order inside a text matters.

    A null or empty text has no chunks; a null key stays null, and rows of equal keys are packed each for itself.
    """
    flat = StructType([df.schema[key], *[StructField(c, IntegerType()) for c in ("part", "total", "first_line", "last_line", "tokens")], StructField("chunk", StringType())])
    ints = [pa.int32()] * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0

            def frame(batch=batch, out=out) -> pa.RecordBatch:
                rows, *columns = zip(*out, strict=True)
                values = [pa.array(c, t) for c, t in zip(columns, [*ints, pa.string()], strict=True)]
                out.clear()
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *values], names=flat.names)

            for i, t in enumerate(batch.column(1)):
                t = t.as_py()
                parts = list(pack_lines(t, budget, overlap)) if t else []
                for n, (a, b, c) in enumerate(parts, 1):
                    out.append((i, n, len(parts), a, b, estimate(c), c))
                    size += len(c)
                    if size > 4 << 20:
                        yield frame()
                        size = 0
            if out:
                yield frame()

    return df.select(key, text).mapInArrow(run, flat)


def packed_sections(df: DataFrame, group: str, order: str, tokens: Column, budget: int = SECTION_TOKENS) -> DataFrame:
    """df with the number of the section that each row of a group falls in: a section is full when the next row would not fit.

    One fold over each group's rows in order, then by tokens, as they stream by; a task holds one batch.  A null group is a
    group, a null order comes first, null tokens count as 0, and equal rows each have their own place.
    """
    # rows of a group lie in one partition and follow each other
    rows = df.withColumn("__t", F.coalesce(tokens.cast("long"), F.lit(0))).repartition(group).sortWithinPartitions(group, order, "__t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, used, now = object(), 0, 1
        for batch in batches:
            sections = []
            for g, t in zip(batch.column(group).to_pylist(), batch.column("__t").to_pylist(), strict=True):
                if g != current:
                    current, used, now = g, 0, 1
                if used > 0 and used + t > budget:
                    used, now = 0, now + 1
                used += t
                sections.append(now)
            kept = [c for c in batch.schema.names if c != "__t"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sections, pa.int32())], names=[*kept, "section"])

    return rows.mapInArrow(run, StructType([*df.schema, StructField("section", IntegerType())]))
