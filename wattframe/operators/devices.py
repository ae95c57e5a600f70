"""Device activity, status tallies and one-row summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattframe import schema as S
from wattframe.functions import sums, times
from wattframe.functions.coerce import status_class
from wattframe.operators.alerts import quantile, zscore_count
from wattframe.operators.energy import month_energy, record_counts
from wattframe.operators.filters import Anchor, anchored, before, current_month, newest_time, trailing
from wattframe.operators.ranking import newest_per


def last_seen(df: DataFrame, device: str = "device_id", ts: str = "ts") -> DataFrame:
    return df.groupBy(device).agg(F.max(ts).alias("last_seen"))


def active_devices(
    df: DataFrame,
    device: str = "device_id",
    ts: str = "ts",
    interval: str = S.ACTIVE_WINDOW,
    anchor: Anchor = None,
) -> DataFrame:
    """One row: devices seen within ``interval`` before the anchor.

    Only rows inside the interval can make a device active, so the rest is never read.
    """
    recent = trailing(df, interval, ts, anchor)
    return recent.agg(F.count_distinct(device).alias("activos"))


def active_rows(
    df: DataFrame,
    ts: str = "ts",
    status: str = "estado",
    interval: str = "7 days",
    anchor: Anchor = None,
    active: str = S.DEFAULT_STATUS,
) -> DataFrame:
    """One row: readings (not devices) of the active status in the trailing interval."""
    recent = trailing(df, interval, ts, anchor)
    return recent.agg(F.count_if(F.col(status) == active).alias("activos"))


def active_split(
    df: DataFrame,
    device: str = "device_id",
    ts: str = "ts",
    status: str = "estado",
    tie: str = "id",
    interval: str = S.ACTIVE_WINDOW,
    anchor: Anchor = None,
    healthy: list[str] | None = None,
) -> DataFrame:
    """One row ``activos, inactivos``: a device counts as active if its newest reading has a
    healthy status and lies inside the interval."""
    bound = anchored(df, ts, anchor, before(interval))
    latest = newest_per(df.select(device, ts, status, tie), device, ts, tie)
    ok = status_class(F.col(status)) == "ok" if healthy is None else F.col(status).isin(healthy)
    active = F.coalesce(ok & (F.col(ts) >= bound), F.lit(False))
    return latest.agg(F.count_if(active).alias("activos"), F.count_if(~active).alias("inactivos"))


def status_tallies(df: DataFrame, status: str = "estado", ok: str = "Activo") -> DataFrame:
    return df.agg(
        F.count_if(F.col(status) == ok).alias("activos"),
        F.count_if(F.coalesce(F.col(status) != ok, F.lit(True))).alias("suspendidos"),
    )


def row_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def batch_cards(
    df: DataFrame,
    ts: str = "fecha",
    value: str = "consumo_kwh",
    status: str = "estado",
    anchor: Anchor = None,
    active: str = S.DEFAULT_STATUS,
    q: float = S.ALERT_QUANTILE,
) -> DataFrame:
    """One row: energy of the anchor's month, its values above the quantile, active readings of
    the last 7 days. One pass besides the anchor and the quantile, over the month and the week
    only."""
    if anchor is None:
        anchor = newest_time(df, ts)
    first = anchored(df, ts, anchor, times.month_start)
    after = anchored(df, ts, anchor, times.next_month_start)
    week = anchored(df, ts, anchor, before("7 days"))
    limit = quantile(current_month(df, ts, anchor), value, q).scalar()
    in_month = (F.col(ts) >= first) & (F.col(ts) < after)
    rows = df.select(ts, value, status).filter(F.col(ts) >= F.least(first, week))
    return rows.agg(
        sums.total(F.when(in_month, F.col(value)), 2).alias("consumo"),
        F.count_if(in_month & (F.col(value) > limit)).alias("alertas"),
        F.count_if((F.col(ts) >= week) & (F.col(status) == active)).alias("activos"),
    )


def live_cards(
    df: DataFrame,
    device: str = "device_id",
    ts: str = "ts",
    value: str = "consumo",
    tie: str = "id",
    anchor: Anchor = None,
    interval: str = S.ACTIVE_WINDOW,
    pool: int = S.ALERT_POOL,
    threshold: float = S.Z_THRESHOLD,
) -> DataFrame:
    """One row as the live view shows it: month energy, z-score alerts among the newest rows,
    devices seen within the interval."""
    one = df.sparkSession.range(1)
    return one.select(
        month_energy(df, ts, value, anchor).scalar().alias("consumo"),
        zscore_count(df, value, threshold, 0, pool, ts, tie).scalar().alias("alertas"),
        active_devices(df, device, ts, interval, anchor).scalar().alias("activos"),
    )


def mining_summary(
    df: DataFrame,
    entity: str = "casa_id",
    value: str = "consumo_kwh",
    threshold: float = S.Z_THRESHOLD,
    min_n: int = S.Z_MIN_POINTS,
    judged: DataFrame | None = None,
) -> DataFrame:
    """One row: readings, entities, anomalies (over ``judged``, by default all), threshold."""
    anomalies = zscore_count(df if judged is None else judged, value, threshold, min_n).scalar()
    counts = record_counts(df, entity)
    return counts.select(
        "n_registros",
        "n_municipios",
        anomalies.alias("n_anomalias"),
        F.lit(float(threshold)).alias("z_threshold"),
    )
