"""Shards along a Hilbert curve over several metadata columns.

Every document is a point in a small grid: source, language and size, each cut into ``2^bits``
steps. The curve visits the whole grid so that neighbours on it are neighbours in every dimension,
and a run of it is a compact box: a file cut from it holds few sources, few languages and a narrow
range of sizes, which readers prune by the columns' minimum and maximum. Rows are cut by count
(law ``rows``): the shards' counts differ by one at most.

Steps of a column are cut at its approximate quantiles, so a skewed column still uses the whole grid;
texts count by their first seven bytes, which keeps their order. Within a cell of the grid (one hot
source and language may fill it) rows are dealt to sub-cells by a hash, as many as the table's size
asks for, and ordered in them, so no window holds more than a small share of the rows.

Only DataFrame functions are used. The narrow table (id, size, checksum, grid cell) is written once;
the positions come from three sums over it: rows of a cell, of a sub-cell, and within a sub-cell.

Defined cases: a null source or language comes first; a null text has size 1 and the checksum of the
empty text; repeated rows each take a place of their own; fewer rows than shards leave the last
shards empty; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from wattframe.llm import common as C

SHARDS = 8
BITS = 4
#: Rows that one window orders at most, about.
RUN = 5_000


# --- the curve ---------------------------------------------------------------------------------


def _tables(dims: int) -> tuple[list[int], list[int], list[int]]:
    """By the rank of a corner on the curve's first step: its Gray code's inverse, entry and direction."""
    size = 1 << dims
    gray = [i ^ (i >> 1) for i in range(size)]
    inverse = [gray.index(c) for c in range(size)]
    entry = [0 if w == 0 else gray[2 * ((w - 1) // 2)] for w in range(size)]

    def trailing_ones(i: int) -> int:
        return (~i & (i + 1)).bit_length() - 1

    direction = [0 if w == 0 else trailing_ones(w - 1 + w % 2) % dims for w in range(size)]
    return inverse, entry, direction


def hilbert(dims: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of a point whose coordinates are integers below ``2^bits``.

    Walks down the grid's levels with the state of the curve: the corner where the current cell is
    entered and the axis along which it is left.
    """
    n = len(dims)
    full = (1 << n) - 1
    inverse, entry, direction = ([F.lit(x).cast("int") for x in t] for t in _tables(n))
    inverse, entry, direction = F.array(*inverse), F.array(*entry), F.array(*direction)

    def right(c: Column, by: Column) -> Column:
        return F.call_function("shiftright", c, by).bitwiseOR(
            F.call_function("shiftleft", c, F.lit(n) - by)).bitwiseAND(F.lit(full))

    def left(c: Column, by: Column) -> Column:
        return F.call_function("shiftleft", c, by).bitwiseOR(
            F.call_function("shiftright", c, F.lit(n) - by)).bitwiseAND(F.lit(full))

    corners = F.array(*[
        reduce(lambda a, b: a.bitwiseOR(b), [
            F.shiftleft(F.shiftright(d.cast("int"), level).bitwiseAND(F.lit(1)), axis) for axis, d in enumerate(dims)
        ]) for level in reversed(range(bits))
    ])

    def step(state: Column, corner: Column) -> Column:
        at, axis = state["at"], state["axis"]
        w = F.get(inverse, right(corner.bitwiseXOR(at), (axis + 1) % n))
        return F.struct(
            (state["index"] * (1 << n) + w.cast("long")).alias("index"),
            at.bitwiseXOR(left(F.get(entry, w), (axis + 1) % n)).cast("int").alias("at"),
            ((axis + F.get(direction, w) + 1) % n).cast("int").alias("axis"),
        )

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("at"), F.lit(0).alias("axis"))
    return F.aggregate(corners, start, step, lambda s: s["index"])


# --- the grid ----------------------------------------------------------------------------------


def ordinal(text: Column) -> Column:
    """A text's first seven bytes as a number that keeps the order of texts; null is -1."""
    first = F.rpad(F.substring(F.hex(F.encode(text, "UTF-8")), 1, 14), 14, "0")
    return F.coalesce(F.conv(first, 16, 10).cast("long"), F.lit(-1).cast("long"))


def _steps(df: DataFrame, names: list[str], bits: int) -> DataFrame:
    """Each column replaced by its number of quantile cuts below it: 0 to 2^bits - 1."""
    at = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = df.agg(*[F.percentile_approx(n, at, 10_000).alias(n) for n in names]).first()
    return df.withColumns({
        n: reduce(lambda a, b: a + b, [(F.col(n) > F.lit(c)).cast("int") for c in cuts[n]]) if cuts[n] else F.lit(0)
        for n in names
    })


def order_rows(docs: DataFrame, bits: int = BITS, run: int = RUN) -> DataFrame:
    """``doc_id, size, text_crc32, cell, position``: positions run from 0 along the curve."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        ordinal(F.col("source").cast("string")).alias("by_source"),
        ordinal(F.col("lang").cast("string")).alias("by_lang"),
    ).withColumn("by_size", F.col("size"))
    narrow = C.staged(narrow, "shards")
    grid = ["by_source", "by_lang", "by_size"]
    points = _steps(narrow, grid, bits)
    parts = max(1, -(-narrow.count() // run))
    celled = points.select(
        "doc_id", "size", "text_crc32", hilbert([F.col(c) for c in grid], bits).alias("cell"),
        F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)).alias("sub"),
    )
    sums = celled.groupBy("cell", "sub").agg(F.count("*").alias("rows"))
    cells = sums.groupBy("cell").agg(F.sum("rows").alias("rows"))
    # The grid is small (8^bits cells), so its running sum is one window over that many rows at most.
    before_cell = cells.select("cell", (F.sum("rows").over(W.orderBy("cell")) - F.col("rows")).alias("before_cell"))
    before_sub = sums.select("cell", "sub", (
        F.sum("rows").over(W.partitionBy("cell").orderBy("sub")) - F.col("rows")).alias("before_sub"))
    offsets = before_sub.join(before_cell, "cell").select(
        "cell", "sub", (F.col("before_cell") + F.col("before_sub")).alias("before"))
    within = W.partitionBy("cell", "sub").orderBy("size", "text_crc32", "doc_id")
    return celled.withColumn("nth", F.row_number().over(within)).join(offsets, ["cell", "sub"]).select(
        "doc_id", "size", "text_crc32", "cell", (F.col("before") + F.col("nth") - 1).alias("position"))


def shard(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, run: int = RUN) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, cell``; law ``rows``."""
    placed = order_rows(docs, bits, run)
    total = docs.count()
    least, more = divmod(total, shards)
    wide = more * (least + 1)  # the first ``more`` shards take one row more
    p = F.col("position")
    rest = max(least, 1)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.when(p < wide, F.floor(p / (least + 1))).otherwise(more + F.floor((p - wide) / rest)).cast("int").alias("shard"),
        F.when(p < wide, p % (least + 1)).otherwise((p - wide) % rest).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "cell",
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(C.load(spark, sf_dir, "documents"))
