"""Newest, top, tail, page, sample and next-reading operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattframe import schema as S
from wattframe.session import BROADCAST_BYTES, materialise, small


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group.

    Spark trims every task's groups to ``n`` rows before the shuffle (WindowGroupLimit), so a hot
    group arrives as ``n`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n).drop("_rank")


def newest_per(df: DataFrame, key: str = "device_id", ts: str = "ts", tie: str = "id") -> DataFrame:
    """Each device's newest reading; equal times go to the larger id.

    The newest time per device is a hash aggregate of fixed width, one row per device and task
    however hot a device is; it is written, and if its counted size allows it is sent to the readings. Only rows at that time go on to the aggregate over whole rows, which Spark sorts. Where devices
    are too many for that, every task keeps the newest row of each of its devices and only these move.
    """
    rest = [c for c in df.columns if c != key]
    top = materialise(df.groupBy(F.col(key).alias("_key")).agg(F.max(ts).alias("_top")), "newest")
    n, text = top.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col("_key").cast("string"))), F.lit(0))).first()
    if 20 * n + text > BROADCAST_BYTES:
        return first_per_group(df, [key], [F.desc_nulls_last(ts), F.desc(tie)])
    at_top = df.join(F.broadcast(top), F.col(key).eqNullSafe(F.col("_key")) & F.col(ts).eqNullSafe(F.col("_top"))).select(*df.columns)
    newest_row = F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_row")
    return at_top.groupBy(key).agg(newest_row).select(*[key if c == key else F.col(f"_row.{c}") for c in df.columns])


def newest_first(df: DataFrame, ts: str = "ts", tie: str = "id") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(ts), F.asc(tie))


def newest(df: DataFrame, n: int, ts: str = "ts", tie: str = "id") -> DataFrame:
    """The newest ``n`` rows, in that order."""
    return df.orderBy(F.desc_nulls_last(ts), F.desc(tie)).limit(max(0, n))


def clamped(df: DataFrame, limit: int = 100) -> DataFrame:
    """At least one row, at most ``limit``."""
    return df.limit(max(1, limit))


def top_k(totals: DataFrame, k: int = 10, key: str = "casa_id", value: str = "total") -> DataFrame:
    """The ``k`` largest; equal totals go by name."""
    return totals.orderBy(F.desc(value), F.asc(key)).limit(k)


def tail_k(series: DataFrame, k: int, label: str = "label") -> DataFrame:
    """The last ``k`` points of a series, oldest first."""
    return series.orderBy(F.desc(label)).limit(k).orderBy(label)


def positions(pool: DataFrame, order: list[Column]) -> DataFrame:
    """0-based ``position`` within a bounded pool (a few thousand rows, already limited)."""
    return pool.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1)


@dataclass(frozen=True)
class Page:
    """One page of rows, the page it turned out to be, and how many pages there are."""

    rows: DataFrame
    number: int
    pages: int


def page(df: DataFrame, number: int, size: int, order: list[Column]) -> Page:
    """A page by number, clamped to the pages there are.

    Counts the rows first. For browsing deep into a large history use ``page_after``, whose cost
    does not grow with the page number.
    """
    total = df.count()
    pages = max(1, -(-total // size))
    at = min(max(1, number), pages)
    return Page(df.orderBy(*order).offset((at - 1) * size).limit(size), at, pages)


def page_after(
    df: DataFrame, size: int, ts: str = "ts", tie: str = "id", last: tuple | None = None
) -> DataFrame:
    """The next page, newest first, after the row whose ``(ts, id)`` is ``last``.

    ``last`` becomes a range predicate that reaches the scan. Untimed rows sort last by id; pass
    ``(None, id)`` to continue among them.
    """
    if last is not None:
        at, key = last
        same = F.col(tie) < F.lit(key)
        if at is None:
            df = df.filter(F.col(ts).isNull() & same)
        else:
            moment = F.lit(str(at)).cast(df.schema[ts].dataType)
            older = F.col(ts) < moment
            df = df.filter(older | ((F.col(ts) == moment) & same) | F.col(ts).isNull())
    return newest(df, size, ts, tie)


def sample_rank(key: Column, seed: int) -> Column:
    """Order of a row in the sample: a hash of its id and the seed, equal on every engine."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def sample_per_batch(
    df: DataFrame,
    batch: str = "batch_id",
    key: str = "id",
    per_batch: int = S.SAMPLE_PER_BATCH,
    cap: int = S.SAMPLE_CAP,
    seed: int = 42,
    spread: int = 32,
) -> DataFrame:
    """Up to ``per_batch`` rows of every batch without replacement, then ``cap`` overall.

    The rank is a hash, so the same seed picks the same rows on any partitioning. Counting rows
    by the first two digits of the hash tells exactly, per batch, after which digits enough rows
    have come; only rows up to there are ranked, so a batch is never sorted as a whole. They are
    cut within ``spread`` parts first, so that a hot batch does not meet in one task either; the
    cut in parts keeps every row the final cut can choose.
    """
    ranked = df.withColumns({
        "_hash": sample_rank(F.col(key), seed),
        "_part": F.pmod(F.xxhash64(key), F.lit(spread)),
    }).withColumn("_head", F.substring("_hash", 1, 2))

    heads = ranked.groupBy(F.col(batch).alias("_batch"), "_head").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("_batch").orderBy("_head"))
    needed = heads.select("_batch", "_head", (upto - F.col("n")).alias("before")).filter(F.col("before") < per_batch)
    cut = needed.groupBy(F.xxhash64("_batch").alias("_batch")).agg(F.max("_head").alias("_last"))
    last = small(materialise(cut, "sample-cut"))
    near = ranked.join(last, F.xxhash64(F.col(batch)) == F.col("_batch")).filter(F.col("_head") <= F.col("_last"))

    order = [F.col("_hash"), F.col(key)]
    parts = first_per_group(near.select(*df.columns, "_hash", "_part"), [batch, "_part"], order, per_batch)
    whole = first_per_group(parts, [batch], order, per_batch)
    return whole.orderBy(*order).limit(cap).drop("_hash", "_part")


def next_reading(
    df: DataFrame,
    entity: str = "casa_id",
    ts: str = "ts",
    tie: str = "id",
    values: dict[str, str] | None = None,
    span: str = "hour",
) -> DataFrame:
    """Each reading with the next one of its entity, as training targets.

    ``values`` maps source columns to target names. One entity may own a large part of all
    readings, so the window runs per entity *and* ``span`` of time; the last reading of a span
    then takes its target from the entity's next span that has any. That second window sees one
    row per entity and span only. The newest reading of an entity has null targets, and so has a
    reading without entity or time; those skip the windows, where they would meet in one task.
    """
    values = values or {"consumo_kwh": "consumo_next", "costo": "costo_next"}
    placed = F.col(entity).isNotNull() & F.col(ts).isNotNull()
    spanned = df.filter(placed).withColumn("_span", F.date_trunc(span, ts))
    current = F.struct(F.col(ts), F.col(tie), *[F.col(c).alias(n) for c, n in values.items()])

    in_span = Window.partitionBy(entity, "_span").orderBy(ts, tie)
    chained = spanned.withColumn("_next", F.lead(current).over(in_span))

    firsts = spanned.groupBy(entity, "_span").agg(F.min(current).alias("_first"))
    across = Window.partitionBy(entity).orderBy("_span")
    later = firsts.select(entity, "_span", F.lead("_first").over(across).alias("_later"))

    joined = chained.join(later, [entity, "_span"], "left")
    follow = F.coalesce("_next", "_later")
    chains = joined.select(*df.columns, *[follow[n].alias(n) for n in values.values()])
    absent = [F.lit(None).cast(df.schema[c].dataType).alias(n) for c, n in values.items()]
    return chains.unionAll(df.filter(~placed).select(*df.columns, *absent))
