from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wattframe.functions import times


def test_time_of_day(one):
    raw = ["7", "123", "7:5", " 23:59h", "24:00", "12:60", "x", None, "", "00:00", "12:", "9:07:30", ":30", "12:605", "-5", "7.0"]
    assert one(times.time_of_day, raw) == [
        "07:00", "12:00", "07:05", "23:59", None, None, None, None, None, "00:00", "12:00", "09:07",
        None, None, None, "07:00",
    ]


def test_time_of_day_of_integers(one):
    assert one(times.time_of_day, [0, 7, 23, 24, None], "int") == ["00:00", "07:00", "23:00", None, None]


def test_parse_time(one):
    raw = [
        "2024-01-05", "2024-1-5 7:05", "2024/01/05 10:00:01", "1/5/2024", "2024-01-05T07:05:00Z",
        "2024-01-05T07:05:00+02:00", "2024-01-05 07:05:09.5", "2024-02-30", "12:00", "", None, "soon",
    ]
    assert one(times.parse_time, raw) == [
        datetime(2024, 1, 5), datetime(2024, 1, 5, 7, 5), datetime(2024, 1, 5, 10, 0, 1),
        datetime(2024, 1, 5), datetime(2024, 1, 5, 7, 5), datetime(2024, 1, 5, 5, 5),
        datetime(2024, 1, 5, 7, 5, 9, 500000), None, None, None, None, None,
    ]


def _event_time(frame, rows):
    df = frame(rows, "t string, d string, f string, h string")
    rule = times.event_time(F.col("t"), F.col("d"), F.col("f"), F.col("h"))
    return [r[0] for r in df.select(rule).collect()]


def test_event_time(frame):
    at = datetime(2023, 11, 14, 22, 13, 20)
    rows = [
        ("1700000000", None, None, None),
        ("1700000000000", None, None, None),
        ("", "2024-01-05 10:00:00", None, None),
        ("abc", "2024-01-05T10:00:00Z", None, None),
        (None, "bad", "2024-01-05", "10:00:59"),
        (None, None, "2024-01-05", "7:5"),
        ("", "", "", ""),
        ("99999999999999999", None, None, None),
        ("1e300", None, "2024-01-05", "10:00"),
    ]
    ten = datetime(2024, 1, 5, 10)
    assert _event_time(frame, rows) == [at, at, ten, ten, ten, None, None, None, ten]


def test_times_ignore_the_session_zone(spark, frame):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Mexico_City")
    try:
        assert _event_time(frame, [("1700000000", None, None, None), (None, "2024-01-05T10:00:00Z", None, None)]) == [
            datetime(2023, 11, 14, 22, 13, 20), datetime(2024, 1, 5, 10),
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize(
    "label, expected",
    [("Sunday", "domingo"), (" MIERCOLES ", "miércoles"), ("miércoles", "miércoles"), ("SÁBADO", "sábado"),
     ("??", "viernes"), (None, "viernes"), ("", "viernes"), ("Friday", "viernes"), ("lunes", "lunes")],
)
def test_weekday(frame, label, expected):
    df = frame([(label, datetime(2024, 1, 5))], "l string, t timestamp_ntz")  # a Friday
    assert df.select(times.weekday_label(F.col("l"), F.col("t"))).first()[0] == expected


def test_labels(frame):
    df = frame([(datetime(2024, 3, 9, 4, 5, 6),)], "t timestamp_ntz")
    t = F.col("t")
    row = df.select(
        times.hour_label(t), times.day_label(t), times.month_label(t), times.second_label(t),
        times.weekday_of(t), times.month_start(t), times.next_month_start(t),
    ).first()
    assert tuple(row) == (
        "04", "2024-03-09", "2024-03", "2024-03-09 04:05:06", "sábado", datetime(2024, 3, 1), datetime(2024, 4, 1),
    )


def test_report_time(frame):
    df = frame([(1704412800000,), (None,), (0,)], "f bigint")
    got = [r[0] for r in df.select(times.report_time(F.col("f"), "2025-01-01 00:00:00")).collect()]
    assert got == [datetime(2024, 1, 5), datetime(2025, 1, 1), datetime(2025, 1, 1)]
