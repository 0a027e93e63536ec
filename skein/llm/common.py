"""What the corpus operators share: word rules and small column helpers, and tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..storage import LARGE_ROWS, materialize, partitions, scratch_path, shared_folder

__all__ = ["LARGE_ROWS", "SPACE", "WORD", "forget_memos", "identity", "materialize", "n_words", "partitions", "remembers", "scratch_path", "shared_folder", "table"]

#: A word: a run of characters other than ASCII white space (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"
#: The white space between words, for one str.translate before str.split(" ") or a byte table.
SPACE = r"[\x20\x09-\x0D]+"


#: Drops what this Python worker remembers between tasks of one kind.
_MEMOS: list[Callable[[], None]] = []


def remembers(forget: Callable[[], None]) -> None:
    """Names what drops a memo of this process, for tasks of other kinds that need the room."""
    _MEMOS.append(forget)


def forget_memos() -> None:
    """Called where a task needs much memory and no memo: workers are reused, and a memo may fill a good part of one."""
    for forget in _MEMOS:
        forget()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table below sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def n_words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def identity(df: DataFrame) -> Column:
    """A 64-bit hash of all columns of a row that parts any two rows: nulls count, inside arrays, structures and maps too, and so does
    the column in which a value stands; maps are told apart by their entries, whatever their order."""
    return F.xxhash64(*[p for f in df.schema for p in _parts(F.col(f"`{f.name}`"), f.dataType)])


def _parts(c: Column, kind: DataType) -> list[Column]:
    """What xxhash64, which skips nulls, has to take for a column; the first says whether it is null."""
    if isinstance(kind, StructType):
        return [c.isNull(), *[p for f in kind for p in _parts(c.getField(f.name), f.dataType)]]
    if isinstance(kind, ArrayType):
        return [c.isNull(), F.size(c), F.transform(c, lambda x: F.xxhash64(*_parts(x, kind.elementType)))]
    if isinstance(kind, MapType):
        entry = lambda e: F.xxhash64(*_parts(e["key"], kind.keyType), *_parts(e["value"], kind.valueType))
        return [c.isNull(), F.size(c), F.array_sort(F.transform(F.map_entries(c), entry))]
    return [c.isNull(), c]
