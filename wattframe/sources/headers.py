"""CSV files grouped by their header line, so that each group is read by its own names."""

from __future__ import annotations

from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

#: Files whose first line is fetched at a time.
AT_ONCE = 32


def _first_line(spark: SparkSession, file: str) -> str:
    """The first line of a file that Spark can read, compressed or not."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(file))
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        plain = stream if codec is None else codec.createInputStream(stream)
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine()
    finally:
        stream.close()
    return (line or "").removeprefix("\ufeff").rstrip("\r")


def by_header(spark: SparkSession, files: list[str]) -> list[list[str]]:
    """The files in groups of one header line, in order of each group's first file.

    Opens every file once and reads its first line only, from the driver, as the listing does. A file
    without a line has no rows either and is left out.
    """
    groups: dict[str, list[str]] = defaultdict(list)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        for file, line in zip(files, pool.map(lambda f: _first_line(spark, f), files)):
            if line:
                groups[line].append(file)
    return list(groups.values())
