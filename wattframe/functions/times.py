"""Dates and times of day.

Times are TIMESTAMP_NTZ on one clock (UTC), so no result depends on the session time zone.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, functions as F

from wattframe import schema as S
from wattframe.functions.coerce import number

NTZ = "timestamp_ntz"
# Hours 0-23 in one or two digits, then minutes 0-59 after a colon, or no colon and digit at all.
_CLOCK = r"^\s*([01]\d|2[0-3]|\d(?!\d))(?::([0-5]\d|\d(?!\d))|(?!:\d))"
_ZONE = r"(Z|UTC|[+-]\d\d:?\d\d)$"
_LAST_SECOND = 253_402_300_799  # end of year 9999


def literal(at: Column | datetime | date | str | None) -> Column:
    """A fixed moment as a column; columns pass through."""
    return at if isinstance(at, Column) else F.lit(None if at is None else str(at)).cast(NTZ)


def _after_epoch(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast(NTZ))


def from_epoch(n: Column) -> Column:
    """Epoch number to time. Fewer than 11 digits are seconds, more are milliseconds; a number
    past year 9999, an infinity or NaN is no time at all."""
    micros = F.when(F.abs(n) < 1e10, n * 1e6).when(F.abs(n) <= _LAST_SECOND * 1e3, n * 1e3)
    return _after_epoch(F.rint(micros).cast("bigint"))


def _iso(c: Column) -> Column:
    """``y/m/d`` and ``m/d/y`` as ``y-m-d``; the usual ``yyyy-`` texts pass without a pattern."""
    t = F.trim(c)
    dashed = F.replace(t, F.lit("/"), F.lit("-"))
    turned = F.regexp_replace(dashed, r"^(\d\d?)-(\d\d?)-(\d{4})", "$3-$1-$2")
    return F.when(F.substring(t, 5, 1) == "-", t).otherwise(turned)


def parse_time(c: Column) -> Column:
    """Lenient date or date-time text, else null.

    ISO forms with one- or two-digit fields, ``/`` for ``-``, month-first ``m/d/yyyy``, and a
    zone suffix, which is converted to UTC.
    """
    t = _iso(c)
    zoned = _after_epoch(F.unix_micros(t.try_cast("timestamp")))
    has_zone = c.contains(":") & F.right(F.rtrim(c), F.lit(6)).rlike(_ZONE)
    return F.when(has_zone, zoned).otherwise(t.try_cast(NTZ))


def time_of_day(c: Column) -> Column:
    """``HH:MM`` from H, HH, H:MM, HH:MM, integers and texts with trailing noise."""
    hours, minutes = hour_digits(c), F.regexp_extract(c.cast("string"), _CLOCK, 2)
    return F.when(hours != "", F.concat(_two(hours), F.lit(":"), _two(minutes)))


def hour_digits(c: Column) -> Column:
    """The hour of ``time_of_day`` as written, empty for a text that holds no valid time."""
    return F.regexp_extract(c.cast("string"), _CLOCK, 1)


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def combine(day: Column, hhmm: Column) -> Column:
    """Date text plus ``HH:MM``; null unless both are readable."""
    return F.concat(_iso(day), F.lit(" "), hhmm).try_cast(NTZ)


def event_time(timestamp: Column, moment: Column, day: Column, clock: Column) -> Column:
    """Time of a live record: epoch number, else date-time text, else date plus time of day.

    An empty field counts as absent, so the next one is tried.
    """
    paired = F.when(clock.rlike(r"^\d\d:\d\d"), combine(day, F.substring(clock, 1, 5)))
    return F.coalesce(from_epoch(number(timestamp, None)), parse_time(moment), paired)


def weekday_of(ts: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in S.WEEKDAYS]), F.weekday(ts) + 1)


_ACCENTS, _PLAIN = "áéíóúü", "aeiouu"


def weekday_label(label: Column | None, ts: Column) -> Column:
    """Canonical weekday from a Spanish or English label, accents and case ignored; a label that
    is no weekday gives the weekday of the time."""
    if label is None:
        return weekday_of(ts)
    plain = str.maketrans(_ACCENTS, _PLAIN)
    pairs = [(d.translate(plain), d) for d in S.WEEKDAYS] + list(zip(S.WEEKDAYS_EN, S.WEEKDAYS))
    known = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    key = F.lower(F.trim(label))
    bare = F.translate(key, _ACCENTS, _PLAIN)
    return F.coalesce(F.try_element_at(known, key), F.try_element_at(known, bare), weekday_of(ts))


def hour_label(ts: Column) -> Column:
    return _two(F.hour(ts))


def day_label(ts: Column) -> Column:
    return ts.cast("date").cast("string")


def month_label(ts: Column) -> Column:
    return F.substring(day_label(ts), 1, 7)


def second_label(ts: Column) -> Column:
    return F.substring(ts.cast("string"), 1, 19)


def or_dash(label: Column) -> Column:
    return F.coalesce(label, F.lit(S.NO_TEXT))


def month_start(ts: Column) -> Column:
    return F.trunc(ts, "month").cast(NTZ)


def next_month_start(ts: Column) -> Column:
    return F.add_months(F.trunc(ts, "month"), 1).cast(NTZ)


def report_time(fecha_ts: Column, now: Column | datetime | str) -> Column:
    """Report time from epoch milliseconds, else the given moment."""
    millis = F.nullif(number(fecha_ts.cast("string"), None), F.lit(0.0))
    known = F.when(F.abs(millis) <= _LAST_SECOND * 1e3, F.rint(millis * 1e3).cast("bigint"))
    return F.coalesce(_after_epoch(known), literal(now))
