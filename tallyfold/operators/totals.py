"""Unit totals, and totals of totals.

Both are sums of decimals, so Spark combines them before the shuffle, and totals of any split
of the rows add up to the totals of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import exact_units

TOTAL_UNITS = "decimal(38,6)"


def total_units(lines: DataFrame, *keys: Column | str) -> DataFrame:
    """Units and number of order lines per key, from order lines."""
    return lines.groupBy(*keys).agg(
        F.sum(exact_units(F.col("l_quantity"))).cast(TOTAL_UNITS).alias("units"),
        F.count(F.lit(1)).alias("n_lines"),
    )


def add_up(totals: DataFrame, *keys: Column | str) -> DataFrame:
    """The same columns as :func:`total_units`, from rows that are totals already."""
    return totals.groupBy(*keys).agg(
        F.sum("units").cast(TOTAL_UNITS).alias("units"), F.sum("n_lines").alias("n_lines")
    )
