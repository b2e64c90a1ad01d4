"""Parquet tables kept as ``<root>/<name>.parquet``, a file or a folder of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def stream_table(
    spark: SparkSession, root: str, name: str, max_files_per_batch: int | None = None
) -> DataFrame:
    """The same table as a stream of its files, those added later included, however old.

    The driver lists the whole table at each trigger and remembers the files it has seen.
    """
    reader = (
        spark.readStream.schema(read_table(spark, root, name).schema)
        # By default a file a week older than the newest one seen is left out.
        .option("maxFileAge", "36500d")
        # Keeps the columns that a table is partitioned by.
        .option("basePath", root)
    )
    if max_files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    # A stream takes a lone file only by way of a glob; the braces match just this name.
    return reader.parquet(f"{root}/{{{name}}}.parquet")
