import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from wattframe.operators import alerts


def _values(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id bigint, consumo_kwh double")


def test_quantile_example(spark):
    df = _values(spark, [1, 2, 3, 4, 10])
    assert alerts.quantile(df).first()[0] == pytest.approx(8.8)
    assert alerts.quantile_alerts(df).first()[0] == 1


def test_quantile_of_nothing(spark):
    df = _values(spark, [])
    assert alerts.quantile(df).first()[0] is None
    assert alerts.quantile_alerts(df).first()[0] == 0


def test_quantile_skips_nan_and_null(frame):
    df = frame([(1.0,), (None,), (float("nan"),), (3.0,)], "consumo_kwh double")
    assert alerts.quantile(df, q=0.5).first()[0] == 2.0


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.floats(-1e6, 1e6, width=32) | st.sampled_from([0.0, 5.0]), min_size=1, max_size=60),
    st.sampled_from([0.0, 0.05, 0.5, 0.95, 1.0]),
)
def test_quantile_equals_numpy(spark, values, q):
    got = alerts.quantile(_values(spark, values), q=q, accuracy=50, at_once=4).first()[0]
    assert got == pytest.approx(np.quantile(values, q), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("accuracy", [5, 100, 10_000])
def test_quantile_survives_a_poor_sketch_and_hot_values(spark, accuracy):
    rng = np.random.default_rng(1)
    values = np.round(np.concatenate([np.full(7000, 3.25), rng.lognormal(0, 3, 13000)]), 3)
    df = _values(spark, values).repartition(7)
    for q in (0.1, 0.5, 0.95, 0.999):
        got = alerts.quantile(df, q=q, accuracy=accuracy, at_once=10).first()[0]
        assert got == pytest.approx(np.quantile(values, q), rel=1e-12)


def test_zscores(spark):
    flat = _values(spark, [5.0] * 40)
    assert alerts.zscore_count(flat).first()[0] == 0
    spike = _values(spark, [1.0, 2.0] * 14 + [100.0])
    assert alerts.zscore_count(spike, min_n=30).first()[0] == 0
    assert alerts.zscore_count(spike, min_n=29).first()[0] == 1
    labels = alerts.zscore_labels(spike).filter("etiqueta = 'anomalo'").collect()
    assert [r.consumo_kwh for r in labels] == [100.0]
    stats = alerts.spread(spike).first()
    assert stats.sd == pytest.approx(np.std([1.0, 2.0] * 14 + [100.0]))


def test_zscores_skip_nan(frame):
    rows = [(1.0,), (2.0,)] * 20 + [(float("nan"),), (None,), (100.0,)]
    df = frame(rows, "consumo_kwh double")
    assert alerts.zscore_count(df).first()[0] == 1
    assert alerts.spread(df).first().n == 41


def test_zscore_pool_has_positions(spark):
    df = _values(spark, [1.0, 2.0] * 50 + [100.0]).withColumn("ts", F.timestamp_seconds("id"))
    rows = alerts.zscore_labels(df, pool=20).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(20))
    assert rows[0].consumo_kwh == 100.0 and rows[0].etiqueta == "anomalo"
    assert alerts.zscore_count(df, pool=20).first()[0] == 1


def test_histogram_matches_a_plain_count(spark):
    rng = np.random.default_rng(5)
    values = rng.exponential(3, 1200)
    rows = alerts.histogram(_values(spark, values)).orderBy("bin").collect()
    bins = 34
    step = (values.max() - values.min()) / bins
    expected = np.bincount(np.clip(((values - values.min()) / step).astype(int), 0, bins - 1), minlength=bins)
    assert [r.n for r in rows] == expected.tolist()
    assert rows[-1].upper == pytest.approx(values.max())


@pytest.mark.parametrize("n, bins", [(1, 8), (63, 8), (100, 10), (1700, 40)])
def test_histogram_bins(spark, n, bins):
    rows = alerts.histogram(_values(spark, range(n))).orderBy("bin").collect()
    assert len(rows) == bins and sum(r.n for r in rows) == n
    assert rows[0].label == f"0.0 – {rows[0].upper:.1f}" or n == 1


def test_histogram_of_equal_values(spark):
    rows = alerts.histogram(_values(spark, [4.0] * 9)).orderBy("bin").collect()
    assert [r.n for r in rows] == [9] + [0] * 7
    assert alerts.histogram(_values(spark, [])).count() == 0
    assert math.isclose(rows[0].lower, 4.0)


def test_quantile_orders_a_bounded_number_of_rows(spark):
    """One huge outlier does not widen what is sorted."""
    df = spark.range(300_000).select(F.when(F.col("id") == 7, 1e18).otherwise(F.rand(5)).alias("consumo_kwh"))
    values = sorted(r[0] for r in df.collect())
    for q in (0.5, 0.9999):
        at = q * (len(values) - 1)
        low = int(at)
        expected = values[low] + (values[low + 1] - values[low]) * (at - low)
        assert alerts.quantile(df, q=q, at_once=2_000).first()[0] == pytest.approx(expected, rel=1e-12)
