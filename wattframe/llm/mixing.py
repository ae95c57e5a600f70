"""Mixing sources to target weights by Sainte-Lague apportionment.

1. Targets. Sources in code-point order (null last) weigh ``weights`` in turn and share all words;
   a target stops at ``limit`` times its source's words and the excess is shared again by weight.
2. Quotas. The mix has as many blocks of ``block`` words as fit its words. Blocks go one by one to
   the source with the highest quotient target / (2 * blocks so far + 1). The sequence of blocks is
   cut into equal shards, so each shard has whole quotas that follow the targets.
3. Selection. Each source's documents are put in a seeded order and laid end to end as one ring of
   words; its quota is read off from a seeded block on, once around and again where it exceeds the
   source. So documents are taken whole, up to ``limit`` times, but for the two at the ends.

Only the table of sources (one row each: name and words) passes through the driver, where the
quotas are computed; documents meet it by a join. Places on the ring come from sums over hashed parts
of a source and a window within each part; the number of parts follows the table, so a source that
holds a third of all rows is spread like any other.

Defined cases: null or blank texts have no words and are never taken; a source without words has
target 0; repeated rows are separate documents; with no words at all nothing is taken. The order
depends on the id, the text and the seed alone, so reruns agree on any partitioning.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from wattframe.llm import common as C

WEIGHTS = (1, 2, 3)
LIMIT = 3
BLOCK = 16
SHARDS = 8
SEED = 17
#: Rows that one window orders, about.
RUN = 1_000

_TABLE = "source string, source_size long, target double, words long, ring_start long, cuts array<long>"


# --- targets and quotas ------------------------------------------------------------------------


def targets(sizes: Sequence[int], weights: Sequence[int], limit: int = LIMIT) -> list[Fraction]:
    """Shares of all words by weight, none above ``limit`` times its size."""
    out = [Fraction(0)] * len(sizes)
    rest, free = Fraction(sum(sizes)), list(range(len(sizes)))
    while free:
        unit = rest / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] > limit * sizes[i]]
        if not full:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = Fraction(limit * sizes[i])
            rest -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def apportion(votes: Sequence[Fraction], seats: int, most: Sequence[int]) -> list[int]:
    """Seats by highest quotients votes / (2 k + 1), at most ``most`` each, ties to the earlier."""
    v, cap = np.array([float(x) for x in votes]), np.array(most, np.int64)
    seats = min(seats, int(cap[v > 0].sum()))
    if seats <= 0:
        return [0] * len(votes)

    def given(divisor: float) -> np.ndarray:
        return np.minimum(cap, np.floor(np.minimum(v / divisor + 0.5, 2.0**62)).astype(np.int64))

    low, high = 0.0, 4.0 * float(v.max())  # nobody has a seat at the upper end
    for _ in range(100):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if given(middle).sum() > seats else (low, middle)
    # One seat less each than at the divisor, then the rest by exact quotients.
    k = np.maximum(given(high) - 1, 0)
    queue = [(-votes[i] / int(2 * k[i] + 1), i) for i in range(len(votes)) if k[i] < cap[i] and votes[i] > 0]
    heapq.heapify(queue)
    for _ in range(seats - int(k.sum())):
        _, i = heapq.heappop(queue)
        k[i] += 1
        if k[i] < cap[i]:
            heapq.heappush(queue, (-votes[i] / int(2 * k[i] + 1), i))
    return k.tolist()


def plan(sources: Sequence[tuple[str | None, int]], weights: Sequence[int] = WEIGHTS, limit: int = LIMIT,
         block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> list[tuple]:
    """Per source: name, words, target, words taken, first place on its ring, and the shards' cuts."""
    own = sorted(sources, key=lambda s: (s[0] is None, (s[0] or "").encode()))
    sizes = [n for _, n in own]
    share = targets(sizes, [weights[i % len(weights)] for i in range(len(own))], limit)
    most = [limit * n // block for n in sizes]
    seats = int(sum(sizes)) // block
    houses = [apportion(share, seats * (j + 1) // shards, most) for j in range(shards)]
    out = []
    for i, (name, n) in enumerate(own):
        blocks = max(1, -(-n // block))
        start = block * (zlib.crc32(f"{seed}:{name}".encode()) % blocks)
        cuts = [block * h[i] for h in houses]
        out.append((name, n, float(share[i]), cuts[-1], start, cuts))
    return out


# --- selection ---------------------------------------------------------------------------------


def _pieces(at: Column, size: Column, total: Column, words: Column, start: Column, cuts: Column) -> Column:
    """What a document at ``at`` on its source's ring gives: array of (first_word, n_words, copy, shard).

    Seen from the ring's start the document is one stretch, or two if the start falls into it. Copy
    ``p`` of a stretch stands ``p`` rounds later; all before ``words`` is taken, cut at the shards.
    """
    zero = F.lit(0).cast("long")
    inside = (at < start) & (start < at + size)
    near = F.when(inside, start - at).otherwise(size)  # words before the ring's start, or all
    stretches = F.array(
        F.struct(zero.alias("word"), F.pmod(at - start, total).alias("place"), near.alias("n")),
        F.struct(near.alias("word"), zero.alias("place"), (size - near).alias("n")),
    )
    rounds = F.sequence(zero, F.floor((words - 1) / total).cast("long"))

    def shard_of(x: Column) -> Column:
        return F.size(F.filter(cuts, lambda c: c <= x)).cast("long")

    def taken(s: Column, p: Column) -> Column:
        low = s["place"] + p * total
        high = F.least(low + s["n"], words)

        def cut(j: Column) -> Column:
            begin = F.greatest(low, F.when(j == 0, zero).otherwise(F.get(cuts, (j - 1).cast("int"))))
            end = F.least(high, F.get(cuts, j.cast("int")))
            return F.struct((s["word"] + begin - low).alias("first_word"), (end - begin).alias("n_words"),
                            p.alias("copy"), j.cast("int").alias("shard"))

        return F.when(high > low, F.transform(F.sequence(shard_of(low), shard_of(high - 1)), cut)).otherwise(F.array())

    every = F.flatten(F.transform(rounds, lambda p: F.flatten(F.transform(stretches, lambda s: taken(s, p)))))
    return F.when((size > 0) & (words > 0), F.filter(every, lambda x: x["n_words"] > 0)).otherwise(F.array())


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, limit: int = LIMIT, block: int = BLOCK,
        shards: int = SHARDS, seed: int = SEED, run: int = RUN) -> DataFrame:
    """``doc_id, text_hash, source, size, source_size, target, pieces``, a row per document."""
    spark = docs.sparkSession
    narrow = C.staged(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
        F.col("source").cast("string").alias("source"), C.count_words(F.col("text")).alias("size"),
    ), "mix")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    table = spark.createDataFrame(plan([(r.source, r.n) for r in sizes], weights, limit, block, shards, seed), _TABLE)
    parts = max(1, -(-sum(r.rows for r in sizes) // run))
    keyed = narrow.withColumn("order", F.xxhash64("doc_id", "text_hash", F.lit(seed))).withColumn(
        "part", F.pmod("order", F.lit(parts)))
    sums = keyed.groupBy("source", "part").agg(F.sum("size").alias("n"))
    before = sums.select(F.col("source").alias("s"), F.col("part").alias("p"), (
        F.sum("n").over(W.partitionBy("source").orderBy("part")) - F.col("n")).alias("before"))
    within = W.partitionBy("source", "part").orderBy("order", "doc_id", "text_hash", "size").rowsBetween(
        W.unboundedPreceding, -1)
    placed = keyed.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(before, placed["source"].eqNullSafe(before["s"]) & (placed["part"] == before["p"]))
    sources = table.withColumnRenamed("source", "name")
    out = placed.join(sources, placed["source"].eqNullSafe(sources["name"]))
    return out.select(
        "doc_id", "text_hash", "source", "size", "source_size", "target",
        _pieces(F.col("before") + F.col("own"), F.col("size"), F.col("source_size"), F.col("words"),
                F.col("ring_start"), F.col("cuts")).alias("pieces"),
    )


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: ``docs`` with a row for each time a document is taken.

    A text taken whole stays as it is; at the two ends of a source's quota it is cut to the words
    taken, joined by one space.
    """
    names = docs.columns
    chosen = mix(docs, **settings).select(
        F.coalesce("doc_id", F.lit(C.NO_ID)).alias("k1"), F.col("text_hash").alias("k2"),
        F.col("source").alias("k3"), F.col("size").alias("all_words"),
        # Pieces of one copy and stretch that a shard's border cuts stay together here.
        F.aggregate("pieces", F.array().cast("array<struct<copy:long,first:long,n:long>>"), _joined).alias("times"),
    )
    rows = docs.select(F.struct(*names).alias("row"), F.xxhash64("text").alias("k2"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NO_ID)).alias("k1"),
                       F.col("source").cast("string").alias("k3"))
    # Repeated rows are numbered on both sides, so that each meets its own places.
    same = W.partitionBy("k1", "k2", "k3").orderBy("k1")
    rows = rows.withColumn("nth", F.row_number().over(same))
    chosen = chosen.withColumn("nth", F.row_number().over(W.partitionBy("k1", "k2", "k3").orderBy("times"))).where(
        F.size("times") > 0).select("*", F.col("k3").alias("s3")).drop("k3")
    both = rows.join(chosen, (rows["k1"] == chosen["k1"]) & (rows["k2"] == chosen["k2"])
                     & rows["k3"].eqNullSafe(chosen["s3"]) & (rows["nth"] == chosen["nth"]))
    each = both.select("row", "all_words", F.explode("times").alias("time"))
    words = F.regexp_extract_all(F.col("row.text"), F.lit(C.WORD), F.lit(0))
    text = F.when(F.col("time.n") == F.col("all_words"), F.col("row.text")).otherwise(
        F.array_join(F.slice(words, (F.col("time.first") + 1).cast("int"), F.col("time.n").cast("int")), " "))
    return each.select(*[(text if n == "text" else F.col("row")[n]).alias(n) for n in names])


def _joined(out: Column, piece: Column) -> Column:
    last = F.try_element_at(out, F.lit(-1))
    goes_on = (last["copy"] == piece["copy"]) & (last["first"] + last["n"] == piece["first_word"])
    longer = F.struct(last["copy"].alias("copy"), last["first"].alias("first"), (last["n"] + piece["n_words"]).alias("n"))
    new = F.struct(piece["copy"].alias("copy"), piece["first_word"].alias("first"), piece["n_words"].alias("n"))
    return F.when(goes_on, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(longer))).otherwise(
        F.concat(out, F.array(new)))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["n_words"])
    return mix(C.load(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"))
