"""Session settings and shared working folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot never compiles methods over 8000 bytes; larger generated stages run better split.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "wattframe", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every plan here assumes.

    ``master`` stays unset on a cluster, where spark-submit supplies it. Extra settings use
    ``__`` for dots: ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors reach, as named by ``spark.checkpoint.dir``.

    A local session without that setting works below its own ``spark.sql.warehouse.dir``. A cluster
    session without it is refused: a folder on one machine would be lost with that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return named.rstrip("/")


_made: list[str] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; nothing is created until Spark writes to it.

    What is written there serves lazily planned results, so it stays until ``discard``.
    """
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def file_system(spark: SparkSession, path: str):
    """A path of the session's file system and that system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder, in order; none if there is no such folder."""
    at, files = file_system(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of each file below a folder, by name."""
    at, files = file_system(spark, path)
    return {s.getPath().getName(): s.getLen() for s in files.listStatus(at)}


def discard(spark: SparkSession) -> int:
    """Deletes the working folders that this process has asked for so far; returns their number.

    To be called when the results built on them have been written or read. Other folders in the
    shared one are left alone.
    """
    n = len(_made)
    while _made:
        path, files = file_system(spark, _made.pop())
        files.delete(path, True)
    return n


#: Rows of a table of narrow, fixed width (some 20 bytes) that may be broadcast: 40 MB at most.
BROADCAST_ROWS = 2_000_000
#: The same limit for rows whose width is counted.
BROADCAST_BYTES = 20 * BROADCAST_ROWS


def small(df: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if its counted size allows it.

    Above the limit Spark joins by shuffle, and adaptive execution splits skewed keys.
    """
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Computes once into a table in the shared folder and continues from there.

    Reading it back cuts the lineage, keeps column pruning and filter pushdown, and gives the
    optimizer the table's true size.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
