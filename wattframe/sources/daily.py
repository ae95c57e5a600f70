"""Readings laid out by day, and the newest of them by reading days from the newest back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattframe.operators.ranking import newest
from wattframe.session import listed

_UNTIMED = "__HIVE_DEFAULT_PARTITION__"


def write_by_day(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Replaces the table at ``path``, one folder per calendar day; rows without a time have one of their own."""
    df.withColumn("day", F.to_date(ts)).write.mode("overwrite").partitionBy("day").parquet(path)


def days(spark: SparkSession, path: str) -> list[str]:
    """Folders of the table, newest day first, that of the untimed rows last."""
    found = [n for n in listed(spark, path) if n.startswith("day=")]
    return sorted(found, key=lambda n: (not n.endswith(_UNTIMED), n), reverse=True)


def newest_days(spark: SparkSession, path: str, n: int, where: Column | None = None) -> DataFrame:
    """Rows of as few of the newest days as hold ``n`` rows (that meet ``where``): a superset of the newest ``n``.

    Days are counted from the newest back, twice as many each time; without a condition a count reads
    the files' footers only. Whole days are taken, so ties at the border stay together.
    """
    folders, taken, have, step = days(spark, path), 0, 0, 1
    table = spark.read.option("basePath", path)

    def rows(some: list[str]) -> DataFrame:
        read = table.parquet(*[f"{path}/{f}" for f in some]).drop("day")
        return read if where is None else read.where(where)

    if not folders:
        raise FileNotFoundError(f"no days under {path}")
    while taken < len(folders) and have < n:
        some = folders[taken : taken + step]
        have += rows(some).count()
        taken, step = taken + len(some), 2 * step
    return rows(folders[: max(taken, 1)])


def newest_by_day(
    spark: SparkSession, path: str, n: int, ts: str = "ts", tie: str = "id", where: Column | None = None
) -> DataFrame:
    """The newest ``n`` rows of a table laid out by day, as ``newest`` gives them for the whole table."""
    return newest(newest_days(spark, path, n, where), n, ts, tie)
