import pytest
from helpers import LINES, PARTS, brute_force, plan_of, rows, some_lines, some_parts
from pyspark.sql import functions as F

from conftest import TESTDATA
from tallyfold.operators import add_up, monthly_lines, total_units
from tallyfold.plans import units_by_brand_month
from tallyfold.sources import read_table, stream_table
from tallyfold.streaming import units
from tallyfold.streaming.units import _batch_totals


def frames(spark, lines, parts):
    return spark.createDataFrame(lines, LINES), spark.createDataFrame(parts, PARTS)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_matches_brute_force(spark, settings, seed, threshold):
    settings(spark__sql__autoBroadcastJoinThreshold=threshold)
    lines, parts = some_lines(2000, seed), some_parts()
    assert rows(units_by_brand_month(*frames(spark, lines, parts))) == brute_force(lines, parts)


def test_empty_inputs_give_no_rows(spark):
    assert rows(units_by_brand_month(*frames(spark, [], some_parts()))) == []
    assert rows(units_by_brand_month(*frames(spark, some_lines(50), []))) == []


@pytest.mark.parametrize("pieces", [1, 2, 7])
def test_totals_of_any_split_add_up(spark, pieces):
    lines, _ = frames(spark, some_lines(500), [])
    whole = total_units(lines, "l_partkey")
    split = total_units(lines.withColumn("piece", F.col("l_orderkey") % pieces), "piece", "l_partkey")
    assert rows(add_up(split, "l_partkey").select(whole.columns)) == rows(whole)


def stream_batch(lineitem, part):
    """The totals of one micro-batch, as the stream takes them."""
    return _batch_totals(monthly_lines(lineitem), part)


def tables(spark, sf="sf0.01"):
    return [read_table(spark, f"{TESTDATA}/{sf}", name) for name in ("lineitem", "part")]


def test_scans_read_only_the_columns_used(spark):
    plan = plan_of(units_by_brand_month(*tables(spark)))
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_brand:string>" in plan


def test_a_filter_on_the_input_reaches_the_scan(spark):
    lineitem, part = tables(spark)
    recent = lineitem.where(F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp_ntz"))
    plan = plan_of(units_by_brand_month(recent, part))
    assert "GreaterThanOrEqual(l_shipdate,2001-01-01T00:00)" in plan


def test_small_parts_are_broadcast_and_only_totals_are_shuffled(spark):
    result = units_by_brand_month(*tables(spark))
    result.collect()
    plan = plan_of(result).split("Initial Plan")[0]
    assert "BroadcastHashJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Exchange hashpartitioning(p_brand" in plan
    assert "partial_sum" in plan


def test_parts_over_the_threshold_are_not_broadcast(spark, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="1k")
    lineitem, part = tables(spark)
    result = units_by_brand_month(lineitem, part)
    plan = plan_of(result)
    assert "Broadcast" not in plan and "Cartesian" not in plan
    assert "Exchange hashpartitioning(l_partkey" in plan


def hot_lines(spark, path):
    """Lines of which a third fall to one part, in several files."""
    lineitem, _ = tables(spark)
    hot = F.when(F.xxhash64("l_orderkey", "l_linenumber", "l_extendedprice") % 3 == 0, F.lit(77))
    lineitem.withColumn("l_partkey", hot.otherwise(F.col("l_partkey"))).repartition(
        8
    ).write.parquet(path)
    lineitem = spark.read.parquet(path)
    assert lineitem.where("l_partkey = 77").count() > lineitem.count() / 4
    return lineitem


SPLIT = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "20k",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "20k",
    "spark__sql__files__maxPartitionBytes": "100k",
}


@pytest.mark.parametrize("plan", [units_by_brand_month, stream_batch])
def test_a_part_with_a_third_of_all_lines_is_split(spark, settings, tmp_path, plan):
    lineitem, part = hot_lines(spark, str(tmp_path / "lineitem.parquet")), tables(spark)[1]
    expected = rows(plan(lineitem, part))
    settings(**SPLIT)
    result = plan(spark.read.parquet(str(tmp_path / "lineitem.parquet")), part)
    assert rows(result) == expected
    assert "skew=true" in plan_of(result).split("Initial Plan")[0]


def test_the_stream_splits_that_part_inside_its_batches(spark, settings, tmp_path, monkeypatch):
    lineitem, part = hot_lines(spark, str(tmp_path / "lineitem.parquet")), tables(spark)[1]
    expected = rows(units_by_brand_month(lineitem, part))
    plans = []

    def seen(lines, part):
        totals = _batch_totals(lines, part)
        totals.collect()
        plans.append(plan_of(totals).split("Initial Plan")[0])
        return totals

    monkeypatch.setattr(units, "_batch_totals", seen)
    settings(**SPLIT)
    query = units.start_units_stream(
        stream_table(spark, str(tmp_path), "lineitem"),
        lambda session: read_table(session, f"{TESTDATA}/sf0.01", "part"),
        str(tmp_path / "stream"),
        {"availableNow": True},
    )
    query.awaitTermination()
    assert len(plans) == 1 and "skew=true" in plans[0]
    assert rows(units.units_so_far(spark, str(tmp_path / "stream"), part)) == expected
