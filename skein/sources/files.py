"""Scans and sinks over files: discovery, CSV, RESX, JSON with a footer, transcripts, checksummed archives, state tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import truncate_utf8
from ..operators.ranks import with_place

#: Extensions that count as binary, largest file, transcript line (fixed values).
BINARY = "dll exe pdb png jpg jpeg gif bmp ico zip gz 7z tar pdf woff woff2 ttf eot mp3 mp4 avi mov so dylib bin class jar nupkg snk".split()
MAX_FILE = 50 * 1024
MAX_LINE = 2 * 1024 * 1024


def glob_regex(pattern: str) -> str:
    """A path glob as an anchored regular expression that ignores case."""
    out, i = "", 0
    pieces = {"**/": "(?:.+/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    while i < len(pattern):
        token = next((t for t in pieces if pattern.startswith(t, i)), None)
        out += pieces[token] if token else re.escape(pattern[i])
        i += len(token) if token else 1
    return f"(?i)^{out}$"


def discover(spark: SparkSession, root: str, include: list[str] = ("**/*",), exclude: list[str] = (), max_bytes: int = MAX_FILE) -> DataFrame:
    """relative, path, length, content of the text files below root; name, size and extension are tested before contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split(":")[-1].lstrip("/")
    files = files.where(F.col("length") <= max_bytes)
    files = files.withColumn("relative", F.regexp_replace("path", rf"^.*?{re.escape(base)}/", ""))
    hit = lambda globs: F.array_contains(F.array(*[F.col("relative").rlike(glob_regex(g)) for g in globs]), True)
    test = hit(include)
    if exclude:
        test = test & ~hit(exclude)
    binary = F.lower(F.regexp_extract("relative", r"\.([^./]+)$", 1)).isin(BINARY)
    return files.where(test & ~binary).select("relative", "path", "length", "content")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted commas and doubled quotes; blank is null, short rows are padded with nulls."""
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', nullValue="", multiLine=True, mode="PERMISSIVE")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Daily prices: dates as MM/dd/yyyy, numbers with thousands commas."""
    raw = read_csv(spark, path, "Date string, Open string, High string, Low string, Close string, Volume string")
    number = lambda c: F.translate(c, ",$", "").try_cast("double").alias(c.lower())
    return raw.select(F.to_date("Date", "MM/dd/yyyy").alias("date"), *[number(c) for c in ("Open", "High", "Low", "Close", "Volume")]).orderBy("date")


def resx_entries(files: DataFrame, path: str = "relative", content: str = "content") -> DataFrame:
    """path, key, value, comment, culture of each entry, with entities and CDATA read; the last of a repeated key in a file wins."""
    text = F.decode(F.col(content), "UTF-8")
    items = F.regexp_extract_all(text, F.lit(r"(?s)(<data\s[^>]*>.*?</data>)"), F.lit(1))
    each = files.select(path, F.posexplode(items).alias("n", "x"))
    entry = F.from_xml("x", "_name string, value string, comment string")
    some = lambda c: F.nullif(F.trim(F.col(f"e.{c}")), F.lit(""))
    rows = each.select(path, "n", entry.alias("e")).select(path, "n", F.col("e._name").alias("key"), some("value").alias("value"), some("comment").alias("comment"))
    last = rows.groupBy(path, "key").agg(F.max_by(F.struct("value", "comment"), "n").alias("r")).select(path, "key", "r.*")
    return last.withColumn("culture", F.nullif(F.regexp_extract(path, r"\.([a-z]{2}(?:-[A-Z]{2})?)\.resx$", 1), F.lit("")))


def resource_values(entries: DataFrame, path: str = "relative") -> DataFrame:
    """key, value over all files: the first file by path wins."""
    return entries.groupBy("key").agg(F.min_by("value", path).alias("value"))


def json_before_footer(texts: DataFrame, marker: str, schema: str, text: str = "text") -> DataFrame:
    """texts with `data`, the JSON before the marker."""
    return texts.withColumn("data", F.from_json(F.split_part(F.col(text), F.lit(marker), F.lit(1)), schema))


def append_transcript(turns: DataFrame, path: str) -> None:
    """One JSON line per turn, appended."""
    turns.write.mode("append").json(path)


def restore_transcript(spark: SparkSession, path: str, schema: str, org: str, session: str) -> DataFrame:
    """The turns of a session; a line that is no JSON or of another organisation or session is an error, blank lines are not."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    row = F.from_json("value", schema, {"mode": "FAILFAST"})
    rows = lines.select(row.alias("r")).select("r.*")
    wrong = (F.col("org") != org) | (F.col("session") != session)
    checked = F.when(F.coalesce(wrong, F.lit(True)), F.raise_error(F.lit("transcript of another session"))).otherwise(F.col("session"))
    return rows.withColumn("session", checked)


def capped_record(turns: DataFrame, max_bytes: int = MAX_LINE, note: str = " [truncated]") -> DataFrame:
    """turns (instructions, answer) whose JSON line fits: first the answer is cut, then the instructions, each with the note.

    The excess is taken off in bytes of the text; where many of its characters are escaped in JSON more is cut than needed.
    """
    out = turns
    for column in ("answer", "instructions"):
        size = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in turns.columns])))
        room = F.greatest(F.octet_length(F.col(column)) - (size - max_bytes) - len(note), F.lit(0))
        short = F.concat(truncate_utf8(F.col(column), room), F.lit(note))
        out = out.withColumn(column, F.when(size > max_bytes, short).otherwise(F.col(column)))
    return out


def write_archive(df: DataFrame, path: str) -> None:
    """Rows as JSON with their SHA-256."""
    body = F.to_json(F.struct(*df.columns))
    df.select(body.alias("body")).withColumn("sha256", F.sha2("body", 256)).write.mode("overwrite").parquet(path)


def read_archive(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of an archive; one whose checksum differs is an error."""
    raw = spark.read.parquet(path)
    ok = F.when(F.sha2("body", 256) == F.col("sha256"), F.col("body")).otherwise(F.raise_error(F.lit("checksum differs")))
    return raw.select(F.from_json(ok, schema).alias("r")).select("r.*")


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state table; an empty one where there is none yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("mergeSchema", True).schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def replace_tables(tables: dict[str, DataFrame], root: str, kept: tuple[str, ...] = ("resolution_overrides",)) -> None:
    """Overwrites the generated tables; those kept are never touched."""
    for name, df in tables.items():
        if name not in kept:
            df.write.mode("overwrite").parquet(f"{root}/{name}")


def in_batches(df: DataFrame, partition: str, order: str, size: int = 100) -> DataFrame:
    """df with the number of the batch of `size` rows in its partition, which may be of any size."""
    return with_place(df, [partition], [order], "batch").withColumn("batch", F.floor((F.col("batch") - 1) / size).cast("int"))
