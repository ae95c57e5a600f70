"""Batches inside files: a file is cut into runs of so many rows, in the order they stand in it.

A file of millions of rows is read by many tasks, each a block of it. Where a block's rows start is the
number of rows in the blocks before it, so one pass counts the rows of every block; the second pass
numbers each row by its place in its block. The cut depends on the rows alone, not on the size of a
block or the number of tasks. Parquet files number their rows themselves and need no counting pass.
A folder may count as one file in parts, whose rows go on from part to part in name order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from wattframe.session import materialise, small

def _placed(df: DataFrame, fmt: str) -> DataFrame:
    """Rows with their file, block and place: in the file for parquet, else in order within the block."""
    block = F.lit(0).cast("bigint") if fmt == "parquet" else F.col("_metadata.file_block_start")
    row = F.col("_metadata.row_index") if fmt == "parquet" else F.monotonically_increasing_id()
    return df.select("*", F.xxhash64("_metadata.file_path").alias("_file"), block.alias("_block"), row.alias("_row"))


def _blocks(tables: list[DataFrame], fmt: str, rows: int, folders: bool) -> DataFrame:
    """Per block: the place its first row has, its rows, the rows before it in its file (or folder), and the
    chunks of the files (or folders) before in name order. One row per block, however many rows a block has."""
    counted = [
        _placed(df, fmt).groupBy("_file", "_block", F.col("_metadata.file_path").alias("path")).agg(
            F.min("_row").alias("first"), F.count("*").alias("n"))
        for df in tables
    ]
    whole = F.regexp_replace("path", "/[^/]*$", "") if folders else F.col("path")
    upto = Window.partitionBy("whole").orderBy("path", "_block")
    blocks = reduce(DataFrame.unionAll, counted).withColumn("whole", whole).withColumn(
        "before", F.sum("n").over(upto) - F.col("n"))
    wholes = blocks.groupBy("whole").agg(F.ceil(F.sum("n") / rows).alias("chunks"))
    # One row per file or folder.
    wholes = wholes.withColumn("earlier", F.sum("chunks").over(Window.orderBy("whole")) - F.col("chunks"))
    return materialise(blocks.join(wholes.drop("chunks"), "whole").drop("path", "whole"), "blocks")


def with_chunks(
    tables: list[DataFrame], fmt: str, rows: int, name: str = "batch_id", folders: bool = False
) -> list[DataFrame]:
    """Adds the number of each row's chunk, counted through the files of all tables in name order, as a BIGINT.

    With ``folders`` the files of a folder are parts of one, and a chunk may reach over their ends.

    The tables are as read from files of the format ``fmt``, with nothing done to them yet. Both passes
    plan the same blocks; a row that does not fit its counted block raises.
    """
    if rows < 1:
        raise ValueError("a chunk has at least one row")
    blocks = small(_blocks(tables, fmt, rows, folders))
    inside = F.col("_row") - F.col("first")
    checked = F.when((inside >= 0) & (inside < F.col("n")), inside).otherwise(
        F.raise_error(F.lit("the blocks of a file changed between two passes")).cast("bigint"))
    chunk = F.col("earlier") + F.floor((F.col("before") + checked) / rows)
    return [
        _placed(df, fmt).join(blocks, ["_file", "_block"]).select(*df.columns, chunk.cast("bigint").alias(name))
        for df in tables
    ]
