"""Pages of a large history by number, at a cost that does not grow with the number.

An index holds the key of every page's first row. It is built once: the keys are put in order by ranges,
each task numbers its own, and the numbers of the tasks before it are added. A page is then a range of
keys, which reaches the scan as a pushed filter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattframe.operators.ranking import Page
from wattframe.session import materialise


@dataclass(frozen=True)
class PageIndex:
    """First keys of the pages (``page``, time and tie), rows of a page, and how many pages there are."""

    borders: DataFrame
    size: int
    pages: int
    ts: str
    tie: str


def _order(ts: str, tie: str) -> list[Column]:
    return [F.desc_nulls_last(ts), F.asc(tie)]


def page_index(df: DataFrame, size: int, ts: str = "ts", tie: str = "id") -> PageIndex:
    """Index of the pages of ``df``, newest first, equal times by ``tie``; untimed rows come last.

    ``tie`` must be known and tell rows of one time apart.
    """
    order = _order(ts, tie)
    ranged = df.select(F.col(ts).alias("ts"), F.col(tie).alias("tie"))
    ranged = ranged.repartitionByRange(*_order("ts", "tie")).sortWithinPartitions(*_order("ts", "tie"))
    keys = materialise(
        ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "page-keys")
    # One row per task.
    parts = keys.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    parts = parts.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    number = F.col("before") + F.col("at") - F.col("first")
    starts = keys.join(F.broadcast(parts), "part").where(number % size == 0)
    borders = materialise(starts.select((F.floor(number / size) + 1).alias("page"), "ts", "tie"), "page-index")
    return PageIndex(borders, size, max(1, borders.count()), ts, tie)


def _from(ts: str, tie: str, at, key) -> Column:
    """Rows at or after a key, in the order of the index."""
    later = F.col(tie) >= F.lit(key)
    if at is None:
        return F.col(ts).isNull() & later
    moment = F.lit(at)
    return (F.col(ts) < moment) | ((F.col(ts) == moment) & later) | F.col(ts).isNull()


def _upto(ts: str, tie: str, at, key) -> Column:
    """Rows before a key."""
    earlier = F.col(tie) < F.lit(key)
    if at is None:
        return F.col(ts).isNotNull() | earlier
    moment = F.lit(at)
    return (F.col(ts) > moment) | ((F.col(ts) == moment) & earlier)


def page_at(df: DataFrame, index: PageIndex, number: int) -> Page:
    """A page by number, clamped to the pages there are; ``df`` must be the rows the index was built from."""
    at = min(max(1, number), index.pages)
    keys = {r.page: (r.ts, r.tie) for r in index.borders.where(F.col("page").isin(at, at + 1)).collect()}
    if at not in keys:
        return Page(df.limit(0), 1, 1)
    rows = df.where(_from(index.ts, index.tie, *keys[at]))
    if at + 1 in keys:
        rows = rows.where(_upto(index.ts, index.tie, *keys[at + 1]))
    return Page(rows.orderBy(*_order(index.ts, index.tie)).limit(index.size), at, index.pages)
