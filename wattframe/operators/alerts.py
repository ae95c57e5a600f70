"""Quantile and z-score alerts, histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from wattframe import schema as S
from wattframe.operators.ranking import newest, positions


def quantile(
    df: DataFrame,
    value: str = "consumo_kwh",
    q: float = S.ALERT_QUANTILE,
    accuracy: int = 10_000,
    at_once: int = 200_000,
) -> DataFrame:
    """One row ``quantile``: exact, linear between neighbouring values; null over no rows.

    ``percentile`` would keep a count per distinct value in one task. Here a range of values that
    holds the wanted rank is narrowed until it has at most ``at_once`` rows (or one value), and only
    those are put in order. Each step asks a sketch of bounded size for two values close around the
    rank and counts exactly the rows below, between and above them, which tells where the rank is
    and how many rows lie before it; the sketch decides about time only. Where it does not narrow
    the range, its middle is the cut. A table of up to ``at_once`` rows takes one pass, one of any
    larger size mostly three, of a single column; a step brings a handful of numbers to the driver.
    """
    v = F.col("v")
    rows = df.select(F.col(value).cast("double").alias("v")).filter(v.isNotNull() & ~F.isnan("v"))
    margin = 2.0 / accuracy

    def near(at: float) -> Column:
        return F.percentile_approx("v", [max(0.0, at - margin), min(1.0, at + margin)], accuracy)

    n, lo, hi, edges = rows.agg(F.count("v"), F.min("v"), F.max("v"), near(q)).first()
    if n == 0:
        return rows.agg(F.max("v").alias("quantile"))
    rank = math.floor(q * (n - 1))
    weight = q * (n - 1) - rank

    before, size, inside = 0, n, rows
    while size > at_once and lo < hi:
        if tuple(edges) == (lo, hi):
            middle = lo / 2 + hi / 2
            edges = [lo, middle if lo <= middle < hi else lo]
        a, b = edges
        parts = {"below": v < a, "between": (v >= a) & (v <= b), "above": v > b}
        found = inside.agg(
            *[F.count_if(c).alias(name) for name, c in parts.items()],
            *[f(F.when(c, v)).alias(f"{name}_{end}") for name, c in parts.items() for end, f in (("lo", F.min), ("hi", F.max))],
        ).first()
        for name in parts:
            if rank < before + found[name]:
                break
            before += found[name]
        size, lo, hi = found[name], found[f"{name}_lo"], found[f"{name}_hi"]
        inside = rows.filter((v >= lo) & (v <= hi))
        if size > at_once and lo < hi:
            edges = inside.agg(near((rank - before) / max(size - 1, 1))).first()[0]

    # The upper neighbour may be the least value above the range.
    beyond = rows.filter(v > hi).agg(F.min("v")).scalar()
    if lo == hi:
        found, follow = F.lit(lo), F.lit(lo) if rank + 1 < before + size else F.coalesce(beyond, F.lit(lo))
        return df.sparkSession.range(1).select((found + (follow - found) * weight).alias("quantile"))
    ordered = inside.agg(F.sort_array(F.collect_list("v")).alias("v"))
    found = F.get("v", F.lit(rank - before))
    follow = F.coalesce(F.get("v", F.lit(rank - before + 1)), beyond, found)
    return ordered.select((found + (follow - found) * weight).alias("quantile"))


def above_quantile(
    df: DataFrame, value: str = "consumo_kwh", q: float = S.ALERT_QUANTILE
) -> DataFrame:
    """Rows strictly above the quantile of the column."""
    return df.filter(F.col(value) > quantile(df, value, q).scalar())


def quantile_alerts(
    df: DataFrame, value: str = "consumo_kwh", q: float = S.ALERT_QUANTILE
) -> DataFrame:
    """One row: how many values lie strictly above the quantile."""
    return above_quantile(df, value, q).agg(F.count("*").alias("alertas"))


def quantile_approx(
    df: DataFrame, value: str = "consumo_kwh", q: float = S.ALERT_QUANTILE, accuracy: int = 10_000
) -> DataFrame:
    """One scan, within ``1 / accuracy`` of the wanted rank; for when exactness is not needed."""
    return df.agg(F.percentile_approx(value, q, accuracy).alias("quantile"))


def _real(value: str) -> Column:
    return F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))


def spread(df: DataFrame, value: str = "consumo_kwh") -> DataFrame:
    """One row ``n, mean, sd`` (population) of the known values; a zero deviation becomes 1e-9 so
    z stays defined."""
    v = _real(value)
    sd = F.stddev_pop(v)
    return df.agg(
        F.count(v).alias("n"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"),
        F.when(sd > 0, sd).otherwise(F.lit(1e-9)).alias("sd"),
    )


def _z(stats: DataFrame, value: str) -> tuple[Column, Column]:
    """|z| of a value against one row of ``n, mean, sd``, and that ``n``.

    NaN where an infinite value makes the spread undefined.
    """
    known = stats.select(F.struct("n", "mean", "sd")).scalar()
    return F.abs((_real(value) - known["mean"]) / known["sd"]), known["n"]


def _anomalous(z: Column, threshold: float) -> Column:
    """An undefined z is no anomaly (in Spark NaN would exceed any threshold)."""
    return F.coalesce(F.nanvl(z, F.lit(None).cast("double")) >= threshold, F.lit(False))


def _pool(df: DataFrame, pool: int | None, ts: str, tie: str) -> DataFrame:
    return df if pool is None else newest(df, pool, ts, tie)


def zscore_count(
    df: DataFrame,
    value: str = "consumo_kwh",
    threshold: float = S.Z_THRESHOLD,
    min_n: int = 0,
    pool: int | None = None,
    ts: str = "ts",
    tie: str = "id",
    stats: DataFrame | None = None,
) -> DataFrame:
    """One row ``n_anomalias``: values with |z| at or over the threshold.

    0 with fewer than ``min_n`` values. ``pool`` judges the newest rows only. ``stats`` gives
    ``n, mean, sd`` where they are known already.
    """
    judged = _pool(df, pool, ts, tie)
    z, n = _z(spread(judged, value) if stats is None else stats, value)
    return judged.agg(F.count_if(_anomalous(z, threshold) & (n >= min_n)).alias("n_anomalias"))


def zscore_labels(
    df: DataFrame,
    value: str = "consumo_kwh",
    threshold: float = S.Z_THRESHOLD,
    pool: int | None = None,
    ts: str = "ts",
    tie: str = "id",
) -> DataFrame:
    """Every row with its ``z`` and an ``anomalo`` / ``normal`` label.

    With a ``pool`` (the newest so many) rows also get their 0-based ``position`` in it; over
    a whole table there is no position, since numbering it would pass it through one task.
    """
    judged = _pool(df, pool, ts, tie)
    z, _ = _z(spread(judged, value), value)
    label = F.when(_anomalous(F.col("z"), threshold), F.lit("anomalo")).otherwise(F.lit("normal"))
    labelled = judged.withColumn("z", z).withColumn("etiqueta", label)
    return labelled if pool is None else positions(labelled, [F.desc(ts), F.desc(tie)])


def histogram(df: DataFrame, value: str = "consumo_kwh") -> DataFrame:
    """Equal-width bins, clamp(floor(sqrt(n)), 8, 40) of them, the last one closed.

    Only finite values count. Empty bins stay. Columns ``bin, lower, upper, label, n``.
    """
    values = df.select(F.col(value).cast("double").alias("v")).filter(F.abs("v") < float("inf"))
    lo, n = F.min("v"), F.count("v")
    bins = F.greatest(F.lit(8), F.least(F.lit(40), F.floor(F.sqrt(F.greatest(n, F.lit(1))))))
    span = F.greatest(F.max("v") - lo, F.lit(1e-9))
    limits = values.agg(
        lo.alias("lo"), bins.cast("int").alias("bins"), (span / bins).alias("step")
    ).filter(F.col("lo").isNotNull())
    edge = limits.select(F.struct("lo", "bins", "step")).scalar()

    place = F.floor((F.col("v") - edge["lo"]) / edge["step"]).cast("int")
    counts = values.groupBy(
        F.greatest(F.lit(0), F.least(place, edge["bins"] - 1)).alias("bin")
    ).agg(F.count("*").alias("n"))
    # At most 40 rows on either side.
    axis = limits.select("lo", "step", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    lower = F.col("lo") + F.col("bin") * F.col("step")
    upper = lower + F.col("step")
    return axis.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        lower.alias("lower"),
        upper.alias("upper"),
        F.concat(_tenth(lower), F.lit(" – "), _tenth(upper)).alias("label"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def _tenth(c: Column) -> Column:
    return F.format_string("%.1f", c)
