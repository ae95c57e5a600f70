"""Energy totals by hour, weekday, entity, day and month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattframe import schema as S
from wattframe.functions import sums, times
from wattframe.operators.filters import Anchor, current_month
from wattframe.operators.ranking import tail_k


def dense(totals: DataFrame, labels: list[str]) -> DataFrame:
    """One row per label in order, 0 where ``totals`` (``ord``, ``value``) has none.

    The grouped side is at most ``len(labels)`` rows, so broadcasting it is safe at any scale.
    """
    spark = totals.sparkSession
    text = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("ord") + 1)
    axis = spark.range(len(labels)).select(F.col("id").cast("int").alias("ord"))
    return axis.join(F.broadcast(totals), "ord", "left").select(
        "ord", text.alias("label"), F.coalesce("value", F.lit(0.0)).alias("value")
    )


HOURS = [f"{h:02d}" for h in range(24)]
DAYS = [d.capitalize() for d in S.WEEKDAYS]


def energy_by_hour(df: DataFrame, ts: str = "ts", value: str = "consumo_kwh") -> DataFrame:
    known = df.filter(F.col(ts).isNotNull())
    totals = known.groupBy(F.hour(ts).alias("ord")).agg(sums.total(F.col(value)).alias("value"))
    return dense(totals, HOURS)


def weekday_position(label: Column) -> Column:
    """0 for Monday to 6 for Sunday, from a canonical weekday label."""
    return (F.array_position(F.array(*[F.lit(d) for d in S.WEEKDAYS]), label) - 1).cast("int")


def energy_by_weekday(
    df: DataFrame, ts: str = "ts", value: str = "consumo_kwh", label: str | None = None
) -> DataFrame:
    """By the row's own weekday label where it is one, else by the weekday of its time."""
    if label is None:
        position = F.weekday(ts)
    else:
        position = weekday_position(times.weekday_label(F.col(label), F.col(ts)))
    known = df.filter(F.col(ts).isNotNull())
    totals = known.groupBy(position.alias("ord")).agg(sums.total(F.col(value)).alias("value"))
    return dense(totals, DAYS)


def energy_by(df: DataFrame, key: str = "casa_id", value: str = "consumo_kwh") -> DataFrame:
    """Total per entity; readings of no entity are left out."""
    known = df.filter(F.col(key).isNotNull())
    return known.groupBy(key).agg(sums.total(F.col(value)).alias("total"))


def energy_by_mapped(
    df: DataFrame, on: str, mapping: DataFrame, key: str, value: str = "consumo_kwh"
) -> DataFrame:
    """Total per entity where the entity is found through a mapping ``on -> key``.

    Readings fold to one row per ``on`` before the join, so only partial sums are shuffled and a
    hot entity arrives as a handful of rows.
    """
    folded = df.filter(F.col(on).isNotNull()).groupBy(on).agg(*sums.partial(F.col(value)))
    named = folded.join(mapping.select(on, key), on).filter(F.col(key).isNotNull())
    return named.groupBy(key).agg(sums.refold().alias("total"))


def daily_totals(df: DataFrame, ts: str = "ts", value: str = "consumo_kwh") -> DataFrame:
    known = df.filter(F.col(ts).isNotNull())
    return known.groupBy(times.day_label(F.to_date(ts)).alias("label")).agg(
        sums.total(F.col(value), 2).alias("value")
    )


def monthly_totals(df: DataFrame, ts: str = "ts", value: str = "consumo_kwh") -> DataFrame:
    known = df.filter(F.col(ts).isNotNull())
    months = known.groupBy(F.trunc(ts, "month").alias("month"))
    totals = months.agg(sums.total(F.col(value), 2).alias("value"))
    return totals.select(times.month_label(F.col("month")).alias("label"), "value")


def daily_series(df: DataFrame, k: int = 7, ts: str = "ts", value: str = "consumo_kwh") -> DataFrame:
    """The last ``k`` days that have readings, oldest first."""
    return tail_k(daily_totals(df, ts, value), k, "label")


def monthly_series(df: DataFrame, k: int = 7, ts: str = "ts", value: str = "consumo_kwh") -> DataFrame:
    """The last ``k`` months that have readings, oldest first."""
    return tail_k(monthly_totals(df, ts, value), k, "label")


def month_energy(
    df: DataFrame, ts: str = "ts", value: str = "consumo_kwh", anchor: Anchor = None
) -> DataFrame:
    """One row: energy of the anchor's month, 0 without readings."""
    return current_month(df, ts, anchor).agg(sums.total(F.col(value), 2).alias("consumo"))


def cumulative_share(by_hour: DataFrame) -> DataFrame:
    """Running share of the total in percent over a dense hourly series (24 rows)."""
    upto = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    whole = F.sum("value").over(everything)
    denominator = F.when(whole > 0, whole).otherwise(F.lit(1e-9))
    return by_hour.select(
        "ord", "label", F.round(F.sum("value").over(upto) / denominator * 100, 6).alias("share")
    )


def record_counts(df: DataFrame, entity: str = "casa_id") -> DataFrame:
    """One row: readings and distinct entities (exact)."""
    return df.agg(
        F.count("*").alias("n_registros"), F.count_distinct(entity).alias("n_municipios")
    )
