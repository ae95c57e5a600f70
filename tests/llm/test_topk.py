import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every):
    own = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v):
            own.setdefault((i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)), None)
    out = set()
    for qi, q in own:
        if qi is not None and qi % every == 0:
            got = {(-sum(a * b for a, b in zip(q, v)), i) for i, v in own if i != qi and len(v) == len(q) and i is not None}
            out |= {(qi, i, -s) for s, i in got}
    best = []
    for qi in {x[0] for x in out}:
        own_ = sorted((-s, i) for q, i, s in out if q == qi)[:k]
        best += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(own_)]
    return sorted(best)


def made(seed, n=300, dims=6):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 0.4) for _ in range(dims)]) for i in range(n)]
    rows += [(1000 + i, list(rows[3][1])) for i in range(40)] + [(10, rows[10][1])]
    rows += [(2000, None), (2001, []), (2002, [0.1, None] * 3), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (2005, [0.5, 0.5])]
    return rows


@pytest.mark.parametrize("block,queries", [(37, 5), (4096, 512)])
def test_equals_brute_force(spark, block, queries):
    rows = made(block)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4)
    v = topk.integers(df)
    got = topk.search(v, v.where(F.col("vec_id") % 10 == 0), 5, block, queries)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute(rows, 5, 10)


def test_bounds_leave_few_members():
    """Reading stops early when a few members stand out, for each query its own."""
    r = np.random.default_rng(1)
    v = r.integers(-20, 20, (2000, 8))
    v[:10, :4] = r.integers(150, 200, (10, 4))
    v[10:20, 4:] = r.integers(150, 200, (10, 4))
    q = np.array([[100.0] * 4 + [0.0] * 4, [0.0] * 4 + [100.0] * 4, [-100.0] * 8])
    lists = topk.Lists(v)
    i, j, score = lists.best(np.arange(2000), q, np.array([-1, -2, -3]), 5)
    assert set(j[i == 0]) <= set(range(10)) and set(j[i == 1]) <= set(range(10, 20))
    assert min(lists.left) < 100 and len(lists.left) < len(topk.DEPTHS) + 1


def test_members_left_on_the_given_table(spark):
    """64 dimensions without structure: bounds tell few members from the best before the lists end."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    v = np.array([r.v for r in topk.integers(rows).orderBy("vec_id").collect()])
    ids = np.arange(len(v))
    lists = topk.Lists(v)
    i, j, score = lists.best(ids, v[::50].astype(float), ids[::50], 5)
    exact = v[::50] @ v.T
    exact[np.arange(len(exact)), ids[::50]] = -(1 << 60)
    fifth = np.sort(exact, axis=1)[:, -5]
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(*[x.tolist() for x in np.nonzero(exact >= fifth[:, None])]))
    print("members left after each step:", [round(x) for x in lists.left], "of", len(v))
    assert lists.left == sorted(lists.left, reverse=True) and len(lists.left) == len(topk.DEPTHS)


def test_floors_go_from_block_to_block():
    """What an earlier block has found makes outsiders of later members at once."""
    r = np.random.default_rng(2)
    v = r.integers(-20, 20, (3000, 6))
    v[:1000] *= 30
    q, q_ids, floor = np.full((2, 6), 50.0), np.array([-1, -2]), np.full(2, -np.inf)
    topk.Lists(v[:1000]).best(np.arange(1000), q, q_ids, 5, floor)
    later = topk.Lists(v[1000:])
    i, j, _ = later.best(np.arange(1000, 3000), q, q_ids, 5, floor)
    assert len(i) == 0 and later.left[-1] == 0


def test_components_too_large_are_refused(spark):
    df = spark.createDataFrame([(0, [1e300, 1.0], 0), (50, [1.0, 2.0], 0)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="too large"):
        topk.integers(df).collect()
    near = spark.createDataFrame([(0, [2.0**17, 2.0**17], 0), (1, [2.0**17, -1.0], 0)], "vec_id long, embedding array<double>, label int")
    got = topk.search(topk.integers(near), topk.integers(near), 5).collect()
    assert {(r.query_id, r.vec_id, r.score) for r in got} == {(0, 1, (1 << 25) ** 2 - 256 * (1 << 25)), (1, 0, (1 << 25) ** 2 - 256 * (1 << 25))}


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [1.0, 0.0], 0)], SCHEMA)
    v = topk.integers(df)
    assert [tuple(r) for r in topk.search(v, v.where("vec_id = 0")).collect()] == [(0, 1, 1, 65536)]
    none = topk.integers(df.limit(0))
    assert topk.search(none, none).count() == 0
    assert topk.integers(df.withColumns({"v": F.lit(1), "dims": F.lit(2), "block": F.lit(3)})).count() == 2


def found(held):
    """Rank by rank (query's place, -score, id) of what a group of queries has found."""
    return [(a, -int(held.score[a, c]), int(held.best[a, c])) for a in range(len(held.ids)) for c in range(held.k) if held.score[a, c] > -np.inf]


@pytest.mark.parametrize("queries", [50, 400])
@pytest.mark.parametrize("large,ids", [(3, 10_000), (100, 10_000), (2**20, 10_000), (1, 10_000), (1, 60)])
def test_groups_of_queries_find_the_best_over_blocks(queries, large, ids):
    """Ties, ids that come several times and scores beyond single precision; few queries at once and many."""
    r = np.random.default_rng(large + ids)
    rows = np.unique(np.column_stack([r.integers(0, ids, 2500), r.integers(-large, large + 1, (2500, 5))]), axis=0)
    rows[::7, 1:] *= 10
    rows = np.unique(rows, axis=0)[r.permutation(len(np.unique(rows, axis=0)))]
    own, v = rows[:, 0].copy(), rows[:, 1:].copy()
    held = topk.Held(4, own[:queries], v[:queries])
    for a in range(0, len(v), 900):
        held.meet(topk.Reading(own[a : a + 900], topk._narrow(v[a : a + 900])))
    score = v[:queries] @ v.T
    want = []
    for a in range(queries):
        pairs = {(-int(s), int(i)) for s, i in zip(score[a], own) if i != own[a]}
        want += [(a, *x) for x in sorted(pairs)[:4]]
    assert found(held) == want


def test_blocks_that_cannot_reach_the_floor_are_not_read():
    """Once long members are found, the lists of a block of short ones are left alone; a mixed one is read in part."""
    r = np.random.default_rng(4)
    v = r.integers(-20, 20, (6000, 6))
    v[:1000] *= 30
    v[4000:4100] *= 40
    q = r.integers(-50, 50, (300, 6))
    held = topk.Held(5, -1 - np.arange(300), q)
    held.meet(topk.Reading(np.arange(1000), v[:1000]))
    assert held.scored == 300 * 1000
    held.meet(topk.Reading(np.arange(1000, 4000), v[1000:4000]))
    assert held.scored < 301 * 1000
    held.meet(topk.Reading(np.arange(4000, 6000), v[4000:]))
    assert held.scored <= 300 * (1000 + topk.STEP) + 1000
    score = q @ v.T
    assert [(a, -x) for a, x, _ in found(held)] == [(a, int(x)) for a in range(300) for x in -np.sort(-score[a])[:5]]


def test_each_vector_moves_to_few_tasks(spark, monkeypatch):
    """Two tables of 20 and 1 blocks make no 20 meetings that carry two blocks each: candidates move once."""
    assert topk.grid(2000, 40, 10_000, 6) == (1, 1)
    for cores in (6, 100):
        for n in (600_000, 15_000_000, 75_000_000):
            shares, groups = topk.grid(n, n // 50, n // 50 * 232, cores)
            # Blocks against blocks moved every candidate n / 50 / 512 times.
            assert groups * n + shares * (n // 50) <= 8 * n and shares * groups >= min(2 * cores, 12)
            assert n // 50 * 232 / groups <= topk.HELD
    monkeypatch.setattr(topk, "FEWEST", 1 << 10)
    rows = [(i, [float(x) for x in np.random.default_rng(i).integers(-50, 50, 4)]) for i in range(900)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4)
    v = topk.integers(df)
    seen = []
    dealt = topk.grid
    monkeypatch.setattr(topk, "grid", lambda *a: seen.append(dealt(*a)) or seen[-1])
    got = topk.search(v, v.where(F.col("vec_id") % 3 == 0), 5, 50, 20)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute(rows, 5, 3)
    assert seen[0][0] > 1 and seen[0][1] > 1


def test_ids_with_several_vectors(spark):
    """Rows that share id and score take one rank, and the next ones follow."""
    rows = [(0, [1.0, 0.0])] + [(7, [0.5, float(x)]) for x in range(9)] + [(i, [0.25 / i, 1.0]) for i in range(8, 16)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    v = topk.integers(df)
    got = topk.search(v, v.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(1, 7), (2, 8), (3, 9), (4, 10), (5, 11)]
