"""Order lines cut down to what unit totals need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import month_start


def monthly_lines(lineitem: DataFrame) -> DataFrame:
    """``l_partkey, l_quantity, month``, one row per line.

    Taken ahead of a shuffle, the month stands in for the time of shipping: it
    repeats, so the shuffled blocks compress better.
    """
    return lineitem.select(
        "l_partkey", "l_quantity", month_start(F.col("l_shipdate")).alias("month")
    )
