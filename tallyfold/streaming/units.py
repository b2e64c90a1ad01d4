"""Units and order lines per brand and month, kept up to date from a stream.

Each micro-batch writes its own totals to ``<folder>/totals/batch_id=<n>`` and
the report adds them up. Nothing is dropped as late, as there is no watermark,
and no state store grows. A batch that is run again replaces its own totals, so
every line counts once. Lines whose part is not known yet are totalled by part
key, and the report joins them to the parts known by then. The result is that of
:func:`tallyfold.plans.units_by_brand_month` over the lines read so far, as long
as a part keeps its brand.

:func:`merge_totals` adds up the batches so far in ``<folder>/merged/upto=<n>``,
and a report reads the newest of those and the batches after it. Spark marks a
folder as whole by ``_SUCCESS``; folders without the mark are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyfold.operators import TOTAL_UNITS, add_up, monthly_lines, total_units

_TOTALS = (
    f"p_brand string, month date, waiting_partkey bigint, units {TOTAL_UNITS}, n_lines bigint"
)


def start_units_stream(
    lines: DataFrame,
    read_part: Callable[[SparkSession], DataFrame],
    folder: str,
    trigger: dict[str, Any],
) -> StreamingQuery:
    """Start, or take up again, the stream that keeps its totals in ``folder``.

    ``read_part`` is called for every batch, so that parts added meanwhile are
    seen. ``trigger`` is passed to ``DataStreamWriter.trigger``. The folder holds
    the stream's checkpoint as well: the two belong together.
    """

    def write_totals(batch: DataFrame, batch_id: int) -> None:
        _batch_totals(batch, read_part(batch.sparkSession)).write.mode("overwrite").parquet(
            f"{folder}/totals/batch_id={batch_id}"
        )

    return (
        # Pruning does not reach the scan from inside foreachBatch.
        monthly_lines(lines)
        .where(F.col("l_partkey").isNotNull())
        .writeStream.foreachBatch(write_totals)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**trigger)
        .start()
    )


def units_so_far(spark: SparkSession, folder: str, part: DataFrame) -> DataFrame:
    """``p_brand, month, units, n_lines`` over a whole number of batches.

    A batch being written, or written again after a crash, is left out, and so
    are those after it: the result is that of the batches before.
    """
    totals = _read(spark, _whole_batches(spark, folder))
    columns = ["p_brand", "month", "units", "n_lines"]
    settled = totals.where(F.col("waiting_partkey").isNull()).select(columns)
    waiting = add_up(
        totals.where(F.col("waiting_partkey").isNotNull()), "waiting_partkey", "month"
    )
    arrived = waiting.join(part, F.col("waiting_partkey") == F.col("p_partkey")).select(columns)
    return add_up(settled.unionByName(arrived), "p_brand", "month").withColumn(
        "month", F.col("month").cast("timestamp_ntz")
    )


def merge_totals(spark: SparkSession, folder: str) -> int:
    """Add up all batches but the newest, which may be run again; returns the last one added.

    Run it now and then, one at a time; the stream may go on meanwhile. What was
    merged before is read, and the folders it came from are removed afterwards by
    :func:`drop_merged`. Gives -1 if there is nothing to merge yet.
    """
    paths = _whole_batches(spark, folder)
    old = [p for p in paths if "/merged/" in p]
    batches = [p for p in paths if "/totals/" in p][:-1]
    if not batches:
        return _number(old[0]) if old else -1
    last = _number(batches[-1])
    merged = add_up(_read(spark, [*old, *batches]), "p_brand", "month", "waiting_partkey")
    merged.write.mode("overwrite").parquet(f"{folder}/merged/upto={last}")
    return last


def drop_merged(spark: SparkSession, folder: str) -> None:
    """Remove the folders that the newest merged one stands for; no report may be running."""
    merged = _folders(spark, f"{folder}/merged")
    if not merged:
        return
    last = max(merged)
    found = _folders(spark, f"{folder}/totals")
    for path in [p for n, p in found.items() if n <= last] + [p for n, p in merged.items() if n < last]:
        _hadoop(spark, path)[0].delete(_hadoop(spark, path)[1], True)


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path, by Spark's own Hadoop classes."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _folders(spark: SparkSession, parent: str) -> dict[int, str]:
    """Whole folders ``<name>=<n>`` of a parent, by number."""
    system, place = _hadoop(spark, parent)
    if not system.exists(place):
        return {}
    found = {}
    for status in system.listStatus(place):
        path = status.getPath().toString()
        mark = _hadoop(spark, f"{path}/_SUCCESS")
        if re.search(r"=\d+$", path) and mark[0].exists(mark[1]):
            found[_number(path)] = path
    return found


def _number(path: str) -> int:
    return int(path.rpartition("=")[2])


def _whole_batches(spark: SparkSession, folder: str) -> list[str]:
    """The newest merged folder, if any, and the whole batches after it, without a gap."""
    merged = _folders(spark, f"{folder}/merged")
    last = max(merged, default=-1)
    batches = _folders(spark, f"{folder}/totals")
    paths = [merged[last]] if merged else []
    while last + 1 in batches:
        last += 1
        paths.append(batches[last])
    return paths


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], _TOTALS)
    return spark.read.schema(_TOTALS).parquet(*paths)


def _batch_totals(lines: DataFrame, part: DataFrame) -> DataFrame:
    return total_units(
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left"),
        "p_brand",
        "month",
        F.when(F.col("p_partkey").isNull(), F.col("l_partkey")).alias("waiting_partkey"),
    )
