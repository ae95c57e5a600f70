"""The physical plans the design relies on."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, plan
from wattframe.operators import alerts, devices, energy, filters, ranking, standardise
from wattframe.plans import tables
from wattframe.sources import feed

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def readings(spark):
    return tables.readings(spark, SF_SMALL)


def test_totals_are_hash_aggregates_over_two_columns(readings):
    text = plan(energy.energy_by_hour(readings))
    assert "HashAggregate" in text and "SortAggregate" not in text
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in text


def test_newest_per_device_is_folded_before_the_shuffle(readings):
    tree = plan(ranking.newest_per(readings)).split("(1)")[0]
    assert "Window" not in tree and tree.count("Aggregate") == 2
    assert tree.index("Aggregate") < tree.index("Exchange") < tree.rindex("Aggregate")


def test_sample_is_cut_before_the_shuffle(readings):
    batched = readings.withColumn("batch_id", F.to_date("ts"))
    tree = plan(ranking.sample_per_batch(batched)).split("(1)")[0]
    assert tree.count("WindowGroupLimit") >= 3 and "BroadcastHashJoin" in tree


@pytest.mark.parametrize(
    "build",
    [
        lambda r: ranking.newest(r, 5),
        lambda r: ranking.top_k(energy.energy_by(r, "device_id"), 5, "device_id"),
        lambda r: ranking.page(r, 3, 7, [F.desc("ts")]).rows,
        lambda r: ranking.page_after(r, 7, last=("2024-01-15 00:00:00", 0)),
    ],
)
def test_limits_are_top_k(readings, build):
    assert "TakeOrderedAndProject" in plan(build(readings))


def test_anchored_filters_reach_the_scan(readings):
    for df in (filters.trailing(readings, "7 days"), filters.current_month(readings)):
        assert "GreaterThanOrEqual(ts,ScalarSubquery" in plan(df, "simple")
    fixed = filters.current_month(readings, anchor="2024-01-15")
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2024-01-01T00:00), LessThan(ts,2024-02-01T00:00)]" in plan(fixed)


def test_search_after_keyset_reaches_the_scan(readings):
    assert "PushedFilters: [Or(" in plan(ranking.page_after(readings, 7, last=("2024-01-15 00:00:00", 0)))


def test_quantile_band_is_a_pushed_range(readings):
    assert "PushedFilters: [IsNotNull(value), GreaterThanOrEqual(value," in plan(alerts.quantile(readings, at_once=100))


def test_next_reading_moves_the_readings_once(readings):
    tree = plan(ranking.next_reading(readings, "device_id")).split("(1)")[0]
    assert tree.count("SortMergeJoin") + tree.count("BroadcastHashJoin") + tree.count("ShuffledHashJoin") == 1


def test_activity_reads_the_window_only(readings):
    assert "GreaterThanOrEqual(ts,ScalarSubquery" in plan(devices.active_devices(readings), "simple")


def test_feed_records_are_parsed_once(frame):
    raw = frame([('{"timestamp": 1700000000}',)], "value string")
    text = plan(standardise.dashboard_readings(feed.parse_feed(raw)))
    assert text.split("== Physical Plan ==")[1].count("from_json") == 1


def test_per_batch_choices_go_to_the_readings(spark):
    """With very many batches the readings still do not move."""
    from wattframe.operators import hours, ranking

    df = spark.range(400_000).selectExpr(
        "id", "concat('s3://lake/readings/part-', id, '.csv') AS batch_id", "'2024-01-01 05:00:00' AS timestamp", "1.0 AS consumo_kwh")
    text = plan(hours.with_best_time(df), "simple")
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    text = plan(ranking.sample_per_batch(df.selectExpr("id", "concat('b', id % 50000) AS batch_id", "consumo_kwh")), "simple")
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_newest_per_does_not_sort_the_readings(readings):
    from wattframe.operators import ranking

    text = plan(ranking.newest_per(readings), "simple")
    below = text[text.index("BroadcastHashJoin"):]
    assert "Sort [" not in below and "Sort (" not in below
