import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.llm import covertree

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, cosine=0.98):
    ok = [v is not None and len(v) and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
          for _, v, label in rows]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows[:i]):
            if ok[i] and ok[j] and a == b and len(v) == len(w):
                v_, w_ = np.array(v, float), np.array(w, float)
                if v == w or v_ @ w_ / (np.sqrt(v_ @ v_) * np.sqrt(w_ @ w_)) >= cosine:
                    n[i] += 1
                    n[j] += 1
                    parent[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), n[i], str(least.get(find(i))), d == least.get(find(i))) for i, (d, _, _) in enumerate(rows))


def got(df):
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in df.collect())


def made(seed, dims):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(150):
        if rows and r.random() < 0.5:
            near = np.array(rows[r.integers(len(rows))][1]) + r.normal(0, r.choice([0, 0.03, 0.08]), dims)
            rows.append((i, near.tolist(), int(r.integers(0, 2))))
        else:
            rows.append((i, r.normal(0, 1, dims).tolist(), int(r.integers(0, 2))))
    tight = r.normal(0, 1, dims)
    rows += [(500 + i, (tight + r.normal(0, 0.001, dims)).tolist(), 0) for i in range(60)]
    rows += [(700 + i, rows[5][1], rows[5][2]) for i in range(30)] + [(5, rows[5][1], rows[5][2])]
    return rows + [(900, None, 1), (901, [], 1), (902, [0.0] * dims, 0), (903, [float("nan")] * dims, 0),
                   (904, [1.0, None] + [0.0] * (dims - 2), 0), (905, rows[0][1], None), (906, [float("inf")] * dims, 0), (907, [2.0], 0)]


@pytest.mark.parametrize("dims,block", [(8, 25), (8, 2048), (2, 2048)])
def test_equals_brute_force(spark, dims, block):
    rows = made(dims + block, dims)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(covertree.link(df, block=block)) == brute(rows)


def test_levels_halve_and_cover():
    r = np.random.default_rng(0)
    u = r.normal(size=(400, 4))
    u /= np.linalg.norm(u, axis=1)[:, None]
    todo, seen = [covertree.grow(u, np.arange(400), 0)], 0
    while todo:
        node = todo.pop()
        far = covertree._chord(u[node.members] @ u[node.centre])
        assert far.max() <= node.radius + 1e-7 and node.centre in node.members
        for child in node.children:
            assert child.radius <= node.radius / 2 + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.members for c in node.children])) == sorted(node.members)
            assert node.children[0].centre == node.centre
        else:
            seen += len(node.members)
        todo += node.children
    assert seen == 400


def test_none_and_clashing(spark):
    df = spark.createDataFrame(made(3, 3), SCHEMA)
    assert covertree.link(df.limit(0)).count() == 0
    more = df.withColumns({n: F.lit(1) for n in ("c", "m", "v", "grp", "block", "n_links", "root", "least")})
    assert covertree.link(more).count() == df.count()
    alone = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, None, None)], SCHEMA)
    assert got(covertree.link(alone)) == [("4", 0, "4", True), ("None", 0, "None", True)]


def clusters(n=30, size=40, dims=16, spread=0.02, seed=6):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        centre = r.normal(0, 1, dims)
        rows += [(100 * k + i, (centre + r.normal(0, spread, dims)).tolist(), 1) for i in range(size)]
    return rows


def test_blocks_far_apart_do_not_meet(spark, monkeypatch):
    """On clustered vectors most pairs of blocks are dropped on their centres and radii, and no link is lost."""
    rows = clusters()
    seen = []
    own = covertree.near_blocks
    monkeypatch.setattr(covertree, "near_blocks", lambda heads, c: seen.append((heads.count(), own(heads, c))) or seen[-1][1])
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(covertree.link(df, block=60)) == brute(rows)
    (blocks, pairs), = seen
    assert blocks >= 20 and pairs.count() < 0.2 * blocks * (blocks + 1) / 2
    assert pairs.where("a = b").count() == blocks


@pytest.mark.parametrize("block,heads,levels", [(7, 4, 2), (25, 1024, 6), (10, 3, 0)])
def test_parts_of_any_shape(spark, monkeypatch, block, heads, levels):
    for name, value in {"HEADS": heads, "LEVELS": levels, "SAMPLE": 20, "SHARE": 15}.items():
        monkeypatch.setattr(covertree, name, value)
    rows = made(3 * block, 8)
    assert got(covertree.link(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block)) == brute(rows)


def test_vectors_of_one_hash_are_told_apart(spark):
    df = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 7, 2), (4, 9, 1), (5, None, None)], "vec_id long, c long, d long")
    told = covertree._told_apart(df).where("c is not null").groupBy("c").agg(F.countDistinct("d").alias("d")).collect()
    assert len(told) == 3 and all(r.d == 1 for r in told)


def test_clashing_columns(spark):
    rows = made(5, 8)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS c", "2 AS grp", "'x' AS block", "3 AS m", "4 AS v", "5 AS part")
    assert got(covertree.link(df)) == brute(rows)
