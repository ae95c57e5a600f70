import zlib

import pytest
from pyspark.sql import functions as F

from llm.conftest import EDGE

from wattframe.llm import shards


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_every_cell_by_unit_steps(spark, dims, bits):
    n = 1 << (dims * bits)
    mask = (1 << bits) - 1
    names = [f"d{i}" for i in range(dims)]
    grid = spark.range(n).select(*[
        F.shiftright("id", i * bits).bitwiseAND(F.lit(mask)).cast("int").alias(c) for i, c in enumerate(names)])
    got = grid.withColumn("h", shards.hilbert([F.col(c) for c in names], bits)).orderBy("h").collect()
    assert [r.h for r in got] == list(range(n))
    for a, b in zip(got, got[1:]):
        assert sum(abs(a[c] - b[c]) for c in names) == 1


def check(pairs, got, shards_=8):
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in pairs)
    text = {}
    for i, t in pairs:
        text.setdefault(i, set()).add((t or "").encode())
    by = {}
    for r in got:
        assert (r.size, r.text_crc32) in {(len(t) + 1, zlib.crc32(t)) for t in text[r.doc_id]}
        assert r.law == "rows" and r.grown_shard is None
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(k, [])) for k in range(shards_)]
    assert sum(sizes) == len(pairs) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


@pytest.mark.parametrize("run", [3, 5000])
def test_shards(docs, run):
    pairs = [(i, "x" * (i * 7 % 31)) for i in range(205)] + [(i, "same") for i in range(300, 420)] + [(7, "twice")] * 3
    check(pairs, shards.shard(docs(pairs), run=run).collect())


def test_edges(docs):
    check(EDGE, shards.shard(docs(EDGE)).collect())
    assert shards.shard(docs([])).count() == 0
    df = docs(EDGE).withColumns({"source": F.lit(None).cast("string"), "cell": F.lit(1), "position": F.lit("p")})
    check(EDGE, shards.shard(df).collect())


def test_runs_prune(spark):
    """A shard holds a narrow part of the curve, so most shards miss most (source, size) boxes."""
    d = spark.range(6400).select(
        "id", F.concat(F.lit("s"), F.col("id") % 16).alias("source"), F.lit("en").alias("lang"),
        F.expr("repeat('x', cast(id div 16 as int))").alias("text")).withColumnRenamed("id", "doc_id")
    got = shards.shard(d).join(d.select("doc_id", "source"), "doc_id").groupBy("shard").agg(
        F.countDistinct("source").alias("sources"), (F.max("size") - F.min("size")).alias("range")).collect()
    assert sum((r.sources / 16) * (r.range / 400) for r in got) / 8 < 0.35


def test_native(spark, docs):
    plan = shards.shard(docs(EDGE))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
