"""Which columns of a batch carry the real time of day.

Each batch may give its hours in ``timestamp``, in ``fecha`` + ``hora_dia`` or in ``fecha`` +
``hora``; a source that sits at midnight most of the time is the wrong one. Per batch the source
with the smallest share of hour 0 wins, in the order above on ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattframe.functions import times
from wattframe.operators.filters import drop_missing
from wattframe.operators.standardise import as_time, is_text
from wattframe.session import materialise, small


def _sources(df: DataFrame) -> dict[str, Column]:
    """Time column per available source, to the minute for ``timestamp``, to the hour otherwise."""
    found = {}
    if "timestamp" in df.columns:
        found["timestamp"] = as_time(df, "timestamp")
    for clock in ("hora_dia", "hora"):
        if "fecha" in df.columns and clock in df.columns:
            day = F.col("fecha")
            if not is_text(df, "fecha"):
                day = day.cast("date").cast("string")
            found[f"fecha+{clock}"] = times.combine(day, F.concat(times.hour_digits(F.col(clock)), F.lit(":00")))
    return found


def with_times(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Adds the time that each available source gives, and names the column per source."""
    sources = _sources(df)
    names = {name: f"_time{i}" for i, name in enumerate(sources)}
    return df.withColumns({names[name]: c for name, c in sources.items()}), names


def hour_sources(df: DataFrame, batch: str = "batch_id", times: dict[str, str] | None = None) -> DataFrame:
    """One row per batch: ``source``, its ``n_valid`` rows and its ``share_midnight``.

    ``source`` is null where no candidate gave a single readable hour. ``times`` names columns that hold
    the candidates' times already; else they are read from the text.
    """
    sources = _sources(df) if times is None else {name: F.col(c) for name, c in times.items()}
    hours = df.select(batch, *[F.hour(c).alias(f"h{i}") for i, c in enumerate(sources.values())])
    stats = hours.groupBy(batch).agg(
        *[F.count(f"h{i}").alias(f"n{i}") for i in range(len(sources))],
        *[F.count_if(F.col(f"h{i}") == 0).alias(f"z{i}") for i in range(len(sources))],
    )
    ranked = [
        F.when(
            F.col(f"n{i}") > 0,
            F.struct(
                (F.col(f"z{i}") / F.col(f"n{i}")).alias("share"),
                F.lit(i).alias("ord"),
                F.lit(name).alias("name"),
                F.col(f"n{i}").alias("n"),
            ),
        )
        for i, name in enumerate(sources)
    ]
    best = F.array_min(F.array(*ranked))
    return stats.select(batch, best.alias("best")).select(
        batch,
        F.col("best.name").alias("source"),
        F.coalesce(F.col("best.n"), F.lit(0)).cast("bigint").alias("n_valid"),
        F.col("best.share").alias("share_midnight"),
    )


def with_best_time(df: DataFrame, batch: str | None = "batch_id") -> DataFrame:
    """Adds ``ts`` and ``hour_source`` by the winning source; rows it cannot date are dropped,
    and so are batches without any source.

    The candidates' times are read from the text once and written with the rows; the choice and the pick
    both start from there, so hand over the columns that are needed and not the whole raw table.
    ``batch=None`` judges the table as one batch. Otherwise the choices are first written as a table
    of known size, a 64-bit hash of the batch and a number for the source, however long the batch's
    name is. Up to ``BROADCAST_ROWS`` batches they are sent to the readings, which then do not move.
    """
    timed, columns = with_times(df)
    timed = materialise(timed, "timed")

    def picked(choice: Column, rows: DataFrame) -> DataFrame:
        ts = F.coalesce(*[F.when(choice == name, F.col(c)) for name, c in columns.items()])
        dated = rows.withColumn("hour_source", choice).withColumn("ts", ts)
        return drop_missing(dated.select(*[c for c in df.columns if c != "ts"], "hour_source", "ts"), ["ts"])

    if batch is None:
        whole = timed.select(F.lit(0).alias("batch_id"), *columns.values())
        return picked(hour_sources(whole, "batch_id", columns).select("source").scalar(), timed)
    found = hour_sources(timed, batch, columns).filter(F.col("source").isNotNull())
    names = F.array(*[F.lit(name) for name in columns])
    code = (F.array_position(names, F.col("source")) - 1).cast("tinyint")
    choices = small(materialise(found.select(F.xxhash64(batch).alias("_batch"), code.alias("_code")), "hour-source"))
    chosen = timed.join(choices, F.xxhash64(F.col(batch)) == F.col("_batch"))
    return picked(F.get(names, F.col("_code").cast("int")), chosen)


def hour_profile(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Rows per hour of the winning source and each hour's share of its batch."""
    counts = with_best_time(df, batch).groupBy(batch, "hour_source", F.hour("ts").alias("hour")).count()
    # At most 24 rows per batch by now.
    share = F.col("count") / F.sum("count").over(Window.partitionBy(batch))
    return counts.select(batch, "hour_source", "hour", F.col("count").alias("n"), share.alias("share"))
