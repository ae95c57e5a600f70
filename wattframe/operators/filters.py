"""Row filters over readings.

A bound that comes from the data (the newest time, say) is a scalar subquery: Spark computes it
once and pushes the comparison into the parquet scan, with no join and no trip through Python.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from wattframe.functions import times
from wattframe.functions.coerce import matches

Anchor = Column | datetime | str | None


def anchored(df: DataFrame, ts: str, anchor: Anchor, bound: Callable[[Column], Column]) -> Column:
    """``bound`` applied to the anchor; with no anchor given, to the newest time in ``df``."""
    if anchor is None:
        return df.agg(bound(F.max(ts))).scalar()
    return bound(times.literal(anchor))


def newest_time(df: DataFrame, ts: str = "ts") -> datetime | None:
    """The newest time as a value, for plans that use it as an anchor more than once."""
    return df.agg(F.max(ts)).first()[0]


def before(interval: str) -> Callable[[Column], Column]:
    return lambda anchor: anchor - F.expr(f"INTERVAL {interval}")


def drop_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols)


def valid_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows whose time is known and later than the epoch."""
    return df.filter(F.col(ts) > times.literal("1970-01-01 00:00:00"))


def current_month(df: DataFrame, ts: str = "ts", anchor: Anchor = None) -> DataFrame:
    """Rows in the anchor's calendar month, as a range so that the scan can skip files."""
    rows = df.filter(F.col(ts) >= anchored(df, ts, anchor, times.month_start))
    if anchor is None:
        return rows  # nothing is newer than the newest time
    return rows.filter(F.col(ts) < times.next_month_start(times.literal(anchor)))


def trailing(df: DataFrame, interval: str, ts: str = "ts", anchor: Anchor = None) -> DataFrame:
    """Rows no older than ``interval`` (``'7 days'``) before the anchor, bound included."""
    return df.filter(F.col(ts) >= anchored(df, ts, anchor, before(interval)))


def search(df: DataFrame, text: str, cols: list[str]) -> DataFrame:
    return df.filter(matches(text, cols))


def first_batches(df: DataFrame, n: int, batch: str = "batch_id") -> DataFrame:
    """Rows of the first ``n`` batches in key order; 0 keeps all.

    The n-th key is a scalar subquery over the distinct keys, so the scan prunes by range.
    """
    if n <= 0:
        return df
    keys = df.select(batch).where(F.col(batch).isNotNull()).distinct().orderBy(batch).limit(n)
    return df.filter(F.col(batch) <= keys.agg(F.max(batch)).scalar())
