from pyspark.sql import functions as F

from wattframe.operators import hours
from wattframe.plans import mining

SCHEMA = "batch_id string, timestamp string, fecha string, hora_dia string, hora string"


def _day(batch, timestamp_hours, hd, ho):
    return [
        (batch, None if t is None else f"2024-01-05 {t:02d}:30:00", "2024-01-05", a, b)
        for t, a, b in zip(timestamp_hours, hd, ho)
    ]


def test_source_with_the_fewest_midnights_wins(frame):
    rows = (
        _day("midnight", [0, 0, 0], ["1", "2:30", "0"], ["0", "0", "3"])
        + _day("tie", [0, 5], ["0", "7"], ["0", "9"])
        + _day("only-hora", [None, None], ["24:00", "x"], ["4", "x"])
        + [("none", "bad", "2024-01-05", "x", None)]
    )
    df = frame(rows, SCHEMA)
    got = {r.batch_id: (r.source, r.n_valid) for r in hours.hour_sources(df).collect()}
    assert got == {
        "midnight": ("fecha+hora_dia", 3), "tie": ("timestamp", 2), "only-hora": ("fecha+hora", 1),
        "none": (None, 0),
    }
    dated = hours.with_best_time(df)
    assert {(r.batch_id, str(r.ts)) for r in dated.select("batch_id", "ts").collect()} == {
        ("midnight", "2024-01-05 01:00:00"), ("midnight", "2024-01-05 02:00:00"),
        ("midnight", "2024-01-05 00:00:00"), ("tie", "2024-01-05 00:30:00"),
        ("tie", "2024-01-05 05:30:00"), ("only-hora", "2024-01-05 04:00:00"),
    }


def test_one_batch_for_the_whole_table(frame):
    df = frame(_day("a", [0, 0], ["0", "0"], ["3", "0"]) + _day("b", [0, 7], ["0", "0"], ["5", "6"]), SCHEMA)
    dated = hours.with_best_time(df, batch=None)
    assert {r.hour_source for r in dated.collect()} == {"fecha+hora"}
    assert sorted(r.ts.hour for r in dated.collect()) == [0, 3, 5, 6]


def test_missing_columns_are_no_sources(frame):
    df = frame([("a", "2024-01-05 03:00:00")], "batch_id string, timestamp string")
    assert hours.with_best_time(df).first().hour_source == "timestamp"


def test_choice_holds_above_the_broadcast_threshold(spark, frame):
    rows = [(f"b{i % 50}", f"2024-01-05 {i % 24:02d}:00:00", "2024-01-05", "0", "0") for i in range(1000)]
    df = frame(rows, SCHEMA)
    expected = sorted(map(tuple, hours.with_best_time(df).select("batch_id", "ts").collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = hours.with_best_time(df).select("batch_id", "ts")
        assert sorted(map(tuple, shuffled.collect())) == expected and len(expected) == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_profile_shares_add_up(frame):
    df = frame(_day("a", [0, 3, 3, 9], ["0"] * 4, ["0"] * 4), SCHEMA)
    rows = {r.hour: (r.n, r.share) for r in hours.hour_profile(df).collect()}
    assert rows == {0: (1, 0.25), 3: (2, 0.5), 9: (1, 0.25)}


def test_absent_cost_columns_are_null(frame):
    df = frame([("a", "2024-01-05 03:00:00", "1.5")], "batch_id string, timestamp string, consumo_kwh string")
    row = mining.mining_readings(df).first()
    assert (row.consumo_kwh, row.costo, row.dia, row.casa_id) == (1.5, 0.0, "viernes", None)


def test_cube_spread_equals_direct_spread(frame):
    import numpy as np

    values = np.random.default_rng(3).lognormal(0, 2, 500)
    rows = [("a", f"2024-01-{1 + i % 28:02d} {i % 24:02d}:00:00", f"m{i % 5}", str(v)) for i, v in enumerate(values)]
    readings = mining.mining_readings(frame(rows, "batch_id string, timestamp string, casa_id string, consumo_kwh string"))
    got = mining.cube_spread(mining.energy_cube(readings)).first()
    assert got.n == 500
    assert abs(got.mean - values.mean()) < 1e-9 and abs(got.sd - values.std()) < 1e-9
