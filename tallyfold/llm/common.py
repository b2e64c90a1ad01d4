"""Written tables and Arrow batches, shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.sources import new_shared_folder


def written(df: DataFrame) -> DataFrame:
    """The same rows, from a parquet table in the shared folder.

    It cuts the lineage, outlives lost executors, and lets Spark know the true
    size, so that joins are broadcast only where the table is small.
    """
    path = new_shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(name: str = "text") -> Column:
    """The text; a null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def id_remainder(n: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("null"))) % n


PART_ROWS = 1024  # of a batch that become Python objects at a time


def parts(batch: pa.RecordBatch, rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def arrow_map(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], dict[str, Any]],
    schema: str,
    rows: int = PART_ROWS,
) -> DataFrame:
    """``mapInArrow`` with a function of some rows that returns columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, rows):
                columns = function(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow
                )

    return df.mapInArrow(run, schema)


def rows_where(df: DataFrame, test: Callable[[str], bool]) -> DataFrame:
    """The rows whose text passes a test (nulls as empty texts); all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                passed = [test(t or "") for t in part.column("text").to_pylist()]
                yield part.filter(pa.array(passed, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def sizes_within(lengths: list[int], limit: int) -> Iterator[slice]:
    """Slices of rows whose lengths add up to the limit at most, or hold one row."""
    first = total = 0
    for i, n in enumerate(lengths):
        if total + n > limit and i > first:
            yield slice(first, i)
            first, total = i, 0
        total += n
    if first < len(lengths):
        yield slice(first, len(lengths))
