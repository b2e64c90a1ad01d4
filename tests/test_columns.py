from datetime import date, datetime
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import settings as limits
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfold.functions import UNITS, exact_units, month_start

EDGES = [
    datetime(2024, 2, 29, 23, 59, 59, 999999),
    datetime(2024, 3, 1),
    datetime(2018, 11, 4, 0, 30),
    datetime(1969, 12, 31, 23, 0),
    datetime(1995, 1, 2),
    None,
]


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo", "Pacific/Kiritimati"])
def test_month_start_ignores_the_session_zone(spark, settings, zone):
    settings(spark__sql__session__timeZone=zone)
    df = spark.createDataFrame([(x,) for x in EDGES], "x timestamp_ntz")
    result = df.select("x", month_start(F.col("x")).alias("m"))
    assert dict(result.dtypes)["m"] == "date"
    assert [(x, x and date(x.year, x.month, 1)) for x in EDGES] == list(
        map(tuple, result.collect())
    )


@limits(max_examples=10, deadline=None)
@given(values=st.lists(st.none() | st.integers(-(10**15), 10**15), min_size=1))
def test_exact_units_keeps_fractions_and_nulls(spark, values):
    """Up to three places here, as many as a double of this size holds."""
    numbers = [None if v is None else v / 1000 for v in values]
    df = spark.createDataFrame([(v,) for v in numbers], "q double")
    result = df.select(exact_units(F.col("q")).alias("q"))
    assert result.dtypes == [("q", UNITS)]
    assert [r.q for r in result.collect()] == [v if v is None else Decimal(repr(v)) for v in numbers]


def test_a_tenth_adds_up_exactly_in_any_order(spark):
    df = spark.range(0, 1000, 1, 7).select(F.lit(0.1).alias("q"))
    assert df.agg(F.sum(exact_units(F.col("q")))).first()[0] == Decimal(100)


@pytest.mark.parametrize("value", [float("nan"), float("inf"), float("-inf"), 1e30])
def test_what_is_no_decimal_counts_as_null(spark, value):
    df = spark.createDataFrame([(1.0,), (value,)], "q double")
    assert [r.q for r in df.select(exact_units(F.col("q")).alias("q")).collect()] == [1, None]
