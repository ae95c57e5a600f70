"""One bad value costs itself, not the table."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import plan

from wattframe.functions import coerce, sums
from wattframe.operators import alerts, ranking, scoring
from wattframe.sources import feed, readings
from wattframe import schema as S


@pytest.mark.parametrize("values,digits,expected", [
    ([1e-7] * 1000, 6, 1e-4),
    ([9.99e11] * 30, 3, 9.99e11 * 30),
    ([-1e15, 1e15 + 0.5, 0.25], 3, 0.75),
    ([1e19, 1.0], 3, 1e19),
    ([float("inf"), 1.0], 3, float("inf")),
    ([float("nan"), None, 2.5], 3, 2.5),
    ([-7.125] * 3, 2, -21.38),
])
def test_totals(frame, values, digits, expected):
    df = frame([(i % 3, v) for i, v in enumerate(values)], "k int, v double")
    assert df.agg(sums.total(F.col("v"), digits)).first()[0] == expected
    folded = df.groupBy("k").agg(*sums.partial(F.col("v")))
    assert folded.agg(sums.refold(digits)).first()[0] == expected


def test_many_large_readings_do_not_overflow_and_order_does_not_matter(spark):
    df = spark.range(2_000_000).select(F.lit(9.99e17).alias("v"))
    assert df.agg(sums.total(F.col("v"))).first()[0] == 9.99e17 * 2_000_000
    mixed = spark.range(200_000).select((F.rand(1) * 1e-6 + F.when(F.col("id") % 9 == 0, 1e13).otherwise(0.0)).alias("v"))
    assert len({mixed.repartition(n).agg(sums.total(F.col("v"), 6)).first()[0] for n in (1, 3, 8)}) == 1


def test_infinity_flags_nobody(frame):
    df = frame([(i, float(i % 7)) for i in range(100)] + [(100, float("inf"))], "id int, consumo_kwh double")
    assert alerts.zscore_count(df).first()[0] == 0
    assert {r.etiqueta for r in alerts.zscore_labels(df).collect()} == {"normal"}
    bins = alerts.histogram(df).collect()
    assert sum(r.n for r in bins) == 100 and all(math.isfinite(r.lower) and math.isfinite(r.upper) for r in bins)


def test_huge_numbers_round_to_themselves(one):
    assert one(lambda c: coerce.rounded(c, 2), [1e300, 1.005, None], "double") == [1e300, 1.01, None]


def test_oversized_flag_counts_as_absent(spark):
    row = {c: "1" for c in S.SCORING_NUMERIC} | {S.SCORING_FLAG: "99999999999"}
    df = spark.createDataFrame([{n: row.get(n) for n in S.SCORING_RECORD.names}], S.SCORING_RECORD)
    assert feed.scoring_records(df).first()[S.SCORING_FLAG] == 0
    assert scoring.coerced(df).first()[S.SCORING_FLAG] == 0


def test_times_of_day_with_minutes_reach_the_vocabulary(spark):
    rows = [("7:05", 1.0), ("07:05:00", 2.0), ("18:30", 3.0), ("x", 4.0)]
    df = spark.createDataFrame(rows, "hora_dia string, consumo_kwh double")
    hours = scoring.hours_present(df)
    assert hours == ["07:05", "18:30"]
    matrix = scoring.feature_matrix(df, scoring.levels(["00:00", *hours])).collect()
    assert [r["hora_dia_07:05"] for r in matrix] == [1, 1, 0, 0]


def test_files_with_other_headers_are_read_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("fecha,consumo_kwh\n2024-01-01,5\n")
    (tmp_path / "b.csv").write_text("consumo_kwh,fecha\n7,2024-01-02\n")
    got = readings.read_readings(spark, str(tmp_path), S.DASHBOARD).collect()
    assert sorted((r.fecha, r.consumo_kwh) for r in got) == [("2024-01-01", "5"), ("2024-01-02", "7")]


def test_line_breaks_in_quotes(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('fecha,consumo_kwh,usuario\n2024-01-01,5,"Ana\nMaria"\n2024-01-02,6,Luis\n')
    got = readings.read_readings(spark, str(path), S.DASHBOARD, multi_line=True).orderBy("fecha").collect()
    assert [(r.fecha, r.usuario) for r in got] == [("2024-01-01", "Ana\nMaria"), ("2024-01-02", "Luis")]


def test_newest_per_sorts_only_the_rows_at_the_newest_time(frame):
    df = frame([("a", 1, 1, 1.0), ("a", 2, 2, 2.0), ("a", 2, 3, 3.0), ("b", None, 4, 4.0), (None, 5, 5, 5.0)],
               "device_id string, ts int, id int, v double")
    newest = ranking.newest_per(df)
    assert sorted(map(str, newest.collect())) == sorted(map(str, df.filter("id in (3, 4, 5)").collect()))


def test_unplaced_rows_skip_the_windows(frame):
    rows = [(None, i, None, 1.0, 1.0) for i in range(5)] + [("a", 10, "2024-01-01 00:00:00", 1.0, 2.0), ("a", 11, "2024-01-01 05:00:00", 3.0, 4.0),
            ("a", 12, None, 5.0, 6.0), (None, 13, "2024-01-01 00:00:00", 7.0, 8.0)]
    df = frame(rows, "casa_id string, id int, t string, consumo_kwh double, costo double").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = {r.id: r.consumo_next for r in ranking.next_reading(df).collect()}
    assert got == {**{i: None for i in [0, 1, 2, 3, 4, 11, 12, 13]}, 10: 3.0}
    text = plan(ranking.next_reading(df), "simple")
    assert "isnotnull(casa_id" in text and "Union" in text
