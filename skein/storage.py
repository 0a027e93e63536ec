"""Tables in the folder that the driver and all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, read from the session.

    Where it is unset, a local session gets a folder of its own; a cluster gets an error, as a machine-local folder would
    not be seen by other executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file:///tmp/checkpoints/skein"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: For tables whose rows are megabytes each: Parquet's writer looks at the size of what it holds after every row, not after 100,
#: and a row group, which writers and readers hold whole, is of one or a few rows.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as a table in the shared folder, by the options of the writer, and reads it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which the cluster sizes to its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
