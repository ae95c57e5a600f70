import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from wattframe.functions import sums
from wattframe.operators import energy

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def readings(spark):
    rng = random.Random(7)
    rows = [
        (i, START + timedelta(minutes=rng.randrange(60 * 24 * 200)),
         "hot" if rng.random() < 0.4 else f"m{rng.randrange(9)}", round(rng.random() * 50, 3))
        for i in range(4000)
    ]
    return spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, casa_id string, consumo_kwh double")


def _sum(df, column):
    return round(df.agg(F.sum(column)).first()[0], 3)


def test_totals_agree(readings):
    whole = float(sum(Decimal(str(r[0])) for r in readings.select("consumo_kwh").collect()))
    for totals, column in [
        (energy.energy_by_hour(readings), "value"),
        (energy.energy_by_weekday(readings), "value"),
        (energy.energy_by(readings), "total"),
    ]:
        assert _sum(totals, column) == pytest.approx(whole, abs=1e-6)


def test_any_partitioning_gives_the_same_totals(readings):
    def result(df):
        return [tuple(r) for r in energy.energy_by_hour(df).orderBy("ord").collect()]

    shuffled = readings.orderBy(F.rand(3)).repartition(13)
    assert result(readings) == result(shuffled) == result(readings.coalesce(1))


def test_hours_are_dense(frame):
    df = frame([(START.replace(hour=5), 2.0), (None, 9.0)], "ts timestamp_ntz, consumo_kwh double")
    rows = energy.energy_by_hour(df).orderBy("ord").collect()
    assert [r.label for r in rows] == [f"{h:02d}" for h in range(24)]
    assert [r.value for r in rows] == [0.0] * 5 + [2.0] + [0.0] * 18


def test_weekdays_follow_the_label_then_the_date(frame):
    monday = START  # 2024-01-01
    df = frame(
        [(monday, "Sunday", 1.0), (monday, "??", 2.0), (monday, None, 4.0), (monday, "SABADO", 8.0)],
        "ts timestamp_ntz, dia string, consumo_kwh double",
    )
    rows = energy.energy_by_weekday(df, label="dia").orderBy("ord").collect()
    assert [(r.label, r.value) for r in rows] == [
        ("Lunes", 6.0), ("Martes", 0.0), ("Miércoles", 0.0), ("Jueves", 0.0), ("Viernes", 0.0),
        ("Sábado", 8.0), ("Domingo", 1.0),
    ]


def test_entity_totals_leave_out_null_entities(frame):
    df = frame([("a", 1.5), (None, 9.0), ("a", 2.0), ("b", 0.1)], "casa_id string, consumo_kwh double")
    assert {r.casa_id: r.total for r in energy.energy_by(df).collect()} == {"a": 3.5, "b": 0.1}


def test_mapped_totals_equal_joined_totals(readings, frame):
    mapping = frame([(f"m{i}", "even" if i % 2 == 0 else "odd") for i in range(9)] + [("hot", "odd")], "casa_id string, zona string")
    got = {r.zona: r.total for r in energy.energy_by_mapped(readings, "casa_id", mapping, "zona").collect()}
    joined = readings.join(mapping, "casa_id")
    assert got == {r.zona: r.total for r in energy.energy_by(joined, "zona").collect()}


def test_series_keep_the_last_points_present(frame):
    days = [0, 1, 2, 5, 9, 40, 41, 42, 75]
    df = frame([(START + timedelta(days=d), float(d)) for d in days], "ts timestamp_ntz, consumo_kwh double")
    assert [r.label for r in energy.daily_series(df, 4).collect()] == ["2024-02-10", "2024-02-11", "2024-02-12", "2024-03-16"]
    assert [tuple(r) for r in energy.monthly_series(df, 2).collect()] == [("2024-02", 123.0), ("2024-03", 75.0)]


def test_month_energy_is_the_last_monthly_point(readings):
    card = energy.month_energy(readings).first()[0]
    assert card == energy.monthly_series(readings, 7).collect()[-1].value
    assert energy.month_energy(readings, anchor="2031-05-01").first()[0] == 0.0


HOURLY = {0: 3.0, 6: 1.0, 12: 4.0, 23: 2.0}


def test_cumulative_share_ends_at_100(spark, readings):
    rows = energy.cumulative_share(energy.energy_by_hour(readings)).orderBy("ord").collect()
    shares = [r.share for r in rows]
    assert shares == sorted(shares) and shares[-1] == 100.0
    small = spark.createDataFrame([(START.replace(hour=h), v) for h, v in HOURLY.items()], "ts timestamp_ntz, consumo_kwh double")
    got = {r.ord: r.share for r in energy.cumulative_share(energy.energy_by_hour(small)).collect()}
    assert (got[0], got[5], got[6], got[12], got[22], got[23]) == (30.0, 30.0, 40.0, 80.0, 80.0, 100.0)


def test_cumulative_share_of_nothing(spark):
    empty = spark.createDataFrame([], "ts timestamp_ntz, consumo_kwh double")
    assert {r.share for r in energy.cumulative_share(energy.energy_by_hour(empty)).collect()} == {0.0}


def test_record_counts(frame):
    df = frame([("a",), ("b",), ("a",), (None,)], "casa_id string")
    assert tuple(energy.record_counts(df).first()) == (4, 2)


@pytest.mark.parametrize(
    "values, expected",
    [
        ([0.1] * 30, 3.0),
        ([-0.1, -2.5, 0.6], -2.0),
        ([1e11 + 0.25, 0.25, -1e11], 0.5),
        ([1e20, 1.5], 1e20 + 1.5),
        ([None, float("nan"), 2.0], 2.0),
        ([], 0.0),
    ],
)
def test_exact_sums(frame, values, expected):
    df = frame([(v,) for v in values], "v double")
    assert df.agg(sums.total(F.col("v"))).first()[0] == expected
    partial = df.groupBy((F.rand() * 3).cast("int").alias("k")).agg(*sums.partial(F.col("v")))
    assert partial.agg(sums.refold()).first()[0] == expected
