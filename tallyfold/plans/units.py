"""Units and order lines per brand and month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import monthly_lines, total_units


def units_by_brand_month(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """``p_brand, month, units, n_lines`` for the lines whose part is known.

    The join carries no hint. Spark broadcasts ``part`` when its size is under
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles both sides otherwise,
    and adaptive execution then splits the partition of a part that holds a large
    share of the lines; both depend on ``spark.sql.adaptive.enabled`` and
    ``spark.sql.adaptive.skewJoin.enabled`` staying on, as they are by default. Totalling per part and month ahead of the join would
    shuffle the lines twice (README, "Scale").
    """
    lines = monthly_lines(lineitem).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return total_units(lines, "p_brand", "month").withColumn(
        "month", F.col("month").cast("timestamp_ntz")
    )
