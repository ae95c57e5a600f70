"""A day table that answers for any span of days: counts, energy, quantiles and distinct entities.

A day's row holds mergeable sketches of bounded size next to exact counts and sums, so months and years
fold from some hundreds of small rows and the readings are not scanned again. A day that changes is
computed again by itself. Quantiles and distinct counts have stated errors; the exact forms are
``alerts.quantile`` and ``energy.record_counts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattframe import schema as S
from wattframe.functions import sums

#: Size parameters of the sketches: a quantile sketch keeps some three times so many values, a distinct
#: sketch 2^lg registers.
QUANTILE_K, DISTINCT_LG = 2_000, 14


def rank_error(k: int = QUANTILE_K) -> float:
    """How far the rank of a sketched quantile lies from the wanted one, as a share of the rows, with 99 %
    confidence; a merged sketch keeps the bound."""
    return 2.296 / k**0.9723


def distinct_error(lg: int = DISTINCT_LG) -> float:
    """Relative error of a sketched distinct count at three standard deviations."""
    return 3 * 1.04 / 2 ** (lg / 2)


def day_rollup(
    df: DataFrame, ts: str = "ts", value: str = "consumo_kwh", entity: str = "device_id",
    k: int = QUANTILE_K, lg: int = DISTINCT_LG,
) -> DataFrame:
    """One row per calendar day; readings without a time are in none.

    Every task sketches its own readings and the sketches merge, so a day of any size is one small row per
    task. Values that are null or no number are counted in ``n`` only.
    """
    known = df.where(F.col(ts).isNotNull())
    real = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return known.groupBy(F.to_date(ts).alias("day")).agg(
        F.count("*").alias("n"), *sums.partial(F.col(value)), F.kll_sketch_agg_double(real, F.lit(k)).alias("values"),
        F.hll_sketch_agg(F.col(entity).cast("string"), F.lit(lg)).alias("entities"),
    )


def replace_days(rollup: DataFrame, path: str) -> None:
    """Writes the rows of some days into the table at ``path``; other days there stay as they are."""
    rollup.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def folded(
    days: DataFrame, period: Column | None = None, q: float = S.ALERT_QUANTILE, digits: int = 2
) -> DataFrame:
    """``period, n, energy, quantile, entities`` of spans of days; all days as one without a period.

    ``quantile`` lies within ``rank_error`` of the wanted rank, ``entities`` within ``distinct_error``.
    """
    period = F.lit(None).cast("string") if period is None else period
    spans = days.groupBy(period.alias("period")).agg(
        F.sum("n").alias("n"), sums.refold(digits).alias("energy"), F.kll_merge_agg_double("values").alias("values"),
        F.hll_sketch_estimate(F.hll_union_agg("entities")).alias("entities"),
    )
    return spans.select(
        "period", "n", "energy", F.kll_sketch_get_quantile_double("values", F.lit(float(q))).alias("quantile"), "entities")
