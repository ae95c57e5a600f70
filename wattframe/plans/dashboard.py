"""The dashboard build: a readings file to its four published results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattframe import schema as S
from wattframe.functions import sums, times
from wattframe.operators.alerts import above_quantile
from wattframe.operators.devices import active_rows
from wattframe.operators.filters import current_month, newest_time
from wattframe.operators.ranking import newest, tail_k
from wattframe.operators.standardise import dashboard_batch, history_columns
from wattframe.sources.readings import read_readings
from wattframe.sources.sinks import as_series, kept, publishing, write_result


def day_table(readings: DataFrame) -> DataFrame:
    """Partial energy sums and newest time per day: one row per calendar day."""
    return readings.groupBy(F.to_date("fecha").alias("day")).agg(
        F.max("fecha").alias("newest"), *sums.partial(F.col("consumo_kwh"))
    )


def daily(days: DataFrame, k: int = 7) -> DataFrame:
    totals = days.groupBy(times.day_label(F.col("day")).alias("label")).agg(sums.refold(2).alias("value"))
    return tail_k(totals, k)


def monthly(days: DataFrame, k: int = 7) -> DataFrame:
    totals = days.groupBy(times.month_label(F.col("day")).alias("label")).agg(sums.refold(2).alias("value"))
    return tail_k(totals, k)


def cards(days: DataFrame, readings: DataFrame) -> DataFrame:
    """Month energy from the day table; the newest time in it anchors the scans for the rest,
    which read the current month and the last week only."""
    anchor = newest_time(days, "newest")
    month = days.filter(F.trunc("day", "month") == F.trunc(times.literal(anchor), "month"))
    alerts = above_quantile(current_month(readings, "fecha", anchor)).agg(F.count("*"))
    active = active_rows(readings, "fecha", anchor=anchor)
    return month.agg(sums.refold(2).alias("consumo")).select(
        "consumo", alerts.scalar().alias("alertas"), active.scalar().alias("activos")
    )


def history(readings: DataFrame, n: int = S.HISTORY_ROWS) -> DataFrame:
    """The newest ``n`` readings; equal times go by ``id`` if there is one, else by the remaining columns."""
    if "id" in readings.columns:
        return history_columns(newest(readings, n, "fecha", "id"))
    ordered = readings.withColumn(
        "_tie", F.concat_ws("|", "dispositivo", "usuario", "consumo_kwh", "costo_mx", "estado")
    )
    return history_columns(newest(ordered, n, "fecha", "_tie"))


def build(spark: SparkSession, path: str, out: str, max_batches: int = 0) -> None:
    """Reads the file at ``path`` and replaces the four results under ``out``.

    The results become visible together, when all are written. The cleaned readings and the day table
    are written there too and read back, so the raw text is parsed once.
    """
    raw = read_readings(spark, path, S.DASHBOARD, max_batches, keep=("id",))
    with publishing(spark, out) as folder:
        readings = kept(dashboard_batch(raw), folder, "_dated")
        days = kept(day_table(readings), folder, "_days")
        if days.isEmpty():
            raise ValueError("no reading has a readable date")
        write_result(cards(days, readings), folder, "cards")
        write_result(as_series(monthly(days)), folder, "mensual")
        write_result(as_series(daily(days)), folder, "semanal")
        write_result(history(readings), folder, "historico")
