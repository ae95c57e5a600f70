"""Raw records to standard readings, one projection per view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from wattframe import schema as S
from wattframe.functions import coerce as C, times
from wattframe.operators.filters import drop_missing, valid_time


def dashboard_readings(raw: DataFrame, tariff: float = S.LIVE_TARIFF) -> DataFrame:
    """Live records as the dashboard shows them; rows without a time are left out."""
    kwh = C.consumption(F.col("consumo_kwh"), F.col("active_power"), F.col("consumo"))
    timed = raw.select(
        "id",
        _event_time().alias("ts"),
        C.first_text(S.DEFAULT_DEVICE, F.col("device_id"), F.col("dispositivo")).alias("device_id"),
        kwh.alias("consumo"),
        C.dashboard_status(F.col("current"), F.col("estado")).alias("estado"),
    )
    return valid_time(timed).select(
        "id",
        "ts",
        times.day_label(F.col("ts")).alias("fecha"),
        times.month_label(F.col("ts")).alias("yyyymm"),
        "device_id",
        "consumo",
        C.tariff_cost(F.col("consumo"), tariff).alias("costo"),
        "estado",
    )


def device_readings(raw: DataFrame) -> DataFrame:
    """Live records as the device list needs them: watts, owner, kind, status."""
    timed = raw.select(
        "id",
        _event_time().alias("ts"),
        C.first_text(S.DEFAULT_DEVICE, F.col("device_id"), F.col("dispositivo")).alias("device_id"),
        C.first_text(S.NO_TEXT, F.col("usuario")).alias("usuario"),
        C.first_text(S.NO_TEXT, F.col("tipo")).alias("tipo"),
        C.number(F.col("active_power")).alias("consumo_w"),
        C.device_status(F.col("current"), F.col("estado")).alias("estado"),
    )
    return valid_time(timed)


def history_rows(
    raw: DataFrame, tariff: float = S.HISTORY_TARIFF, keep_untimed: bool = True
) -> DataFrame:
    """Live records as history rows: watts as kWh, costed before the kWh are rounded.

    Rows without a time stay by default, dated with a dash; sort them last.
    """
    kwh = C.watts_to_kwh(F.col("active_power"))
    rows = raw.select(
        "id",
        times.event_time(F.col("timestamp"), F.col("datetime"), F.lit(None), F.lit(None)).alias("ts"),
        C.first_text(S.NO_TEXT, F.col("device_id")).alias("dispositivo"),
        F.lit(S.NO_TEXT).alias("usuario"),
        C.rounded(kwh, 3).alias("consumo"),
        C.rounded(C.tariff_cost(kwh, tariff), 2).alias("costo"),
        C.history_status(F.col("current")).alias("estado"),
    )
    if not keep_untimed:
        rows = valid_time(rows)
    return rows.withColumn("fecha", times.or_dash(times.day_label(F.col("ts"))))


def dashboard_batch(df: DataFrame) -> DataFrame:
    """Batch file rows (contract columns present) as typed readings with a known date."""
    kept = drop_missing(df, ["fecha", "consumo_kwh"])
    typed = kept.select(
        *[c for c in ("id", "batch_id") if c in df.columns],
        as_time(df, "fecha").alias("fecha"),
        "dispositivo",
        "usuario",
        as_number(df, "consumo_kwh").alias("consumo_kwh"),
        as_number(df, "costo_mx").alias("costo_mx"),
        C.batch_status(F.col("estado")).alias("estado"),
    )
    return drop_missing(typed, ["fecha"])


def history_columns(df: DataFrame) -> DataFrame:
    """The published history: time as text, energy and cost under their short names."""
    return df.select(
        times.second_label(F.col("fecha")).alias("fecha"),
        "dispositivo",
        "usuario",
        F.col("consumo_kwh").alias("consumo"),
        F.col("costo_mx").alias("costo"),
        "estado",
    )


def report_rows(log: DataFrame, now) -> DataFrame:
    """The report log with its date filled and empty fields dashed."""
    return log.select(
        "id",
        times.day_label(times.report_time(F.col("fecha_ts"), now)).alias("fecha"),
        C.first_text(S.NO_TEXT, F.col("tipo")).alias("tipo"),
        C.first_text(S.NO_TEXT, F.col("usuario")).alias("usuario"),
        C.first_text(S.NO_TEXT, F.col("formato")).alias("formato"),
        C.first_text(S.REPORT_PENDING, F.col("estado")).alias("estado"),
    )


def as_time(df: DataFrame, name: str) -> Column:
    """A column as TIMESTAMP_NTZ whether the source gave text, a date or a timestamp."""
    c = F.col(name)
    return times.parse_time(c) if is_text(df, name) else c.cast(times.NTZ)


def as_number(df: DataFrame, name: str, default: float | None = 0.0) -> Column:
    return C.number(F.col(name), default, text=is_text(df, name), finite=False)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def _event_time() -> Column:
    return times.event_time(F.col("timestamp"), F.col("datetime"), F.col("fecha"), F.col("hora"))
