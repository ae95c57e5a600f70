import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.llm import whiten as W

SCHEMA = "vec_id long, embedding array<float>, label int"
rng = np.random.default_rng(3)


def integers(rows):
    out = []
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, [math.floor(1024 * float(np.float32(x))) + 100_000 for x in v]))
    dims = max((len(v) for _, v in out), key=lambda d: (sum(len(w) == d for _, w in out), d), default=0)
    return [(i, v) for i, v in out if len(v) == dims]


def check(rows, got, components=8):
    x = integers(rows)
    n = len(x)
    m = np.array([v for _, v in x], float)
    sums = [sum(v[j] for _, v in x) for j in range(m.shape[1])]
    y = np.array([[float(Fraction(a * n - s, n)) for a, s in zip(v, sums)] for _, v in x])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    k = int((e[:components] > 1e-12 * e[0]).sum())
    assert len(got) == n * k and {r.n for r in got} <= {n}
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    deviation = sorted((str(i), sum((n * a - s) ** 2 for a, s in zip(v, sums))) for i, v in x)
    for c, own in by.items():
        assert sorted((str(r.vec_id), r.deviation) for r in own) == deviation
        assert all(abs(r.explained / (e[c - 1] / e.sum()) - 1) < 1e-9 + 1e-13 * e[0] / e[c - 1] and r.identity_error < 1e-8 for r in own)
        gap = min(abs(e[c - 1] - e[j]) for j in range(len(e)) if j != c - 1) if len(e) > 1 else 1.0
        if gap > 1e-6 * e[0]:
            z = y @ u[:, c - 1] / np.sqrt(e[c - 1])
            want = {i: v for (i, _), v in zip(x, z)}
            sign = np.sign(sum(want[r.vec_id] * r.whitened for r in own))
            assert max(abs(want[r.vec_id] - sign * r.whitened) for r in own) < 1e-7 * e[0] / gap


EDGE = [(900, None), (901, []), (902, [0.1, None] * 3), (903, [math.nan] * 6), (904, [math.inf] * 6), (905, [0.5, 0.5])]


@pytest.mark.parametrize("n,dims", [(400, 6), (300, 24), (12, 6), (5, 6), (2, 6)])
def test_equals_eigenvectors(spark, n, dims):
    rows = [(i, v) for i, v in enumerate((rng.standard_normal((n, dims)) @ np.diag(1 / np.arange(1, dims + 1))).tolist())]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + EDGE], SCHEMA).repartition(9)
    check(rows + EDGE, W.whiten(df).collect())


def test_constant_dependent_and_repeated(spark):
    rows = [(i, [*v, 7.0, v[0], -2 * v[1]]) for i, v in enumerate(rng.standard_normal((60, 3)).tolist())]
    rows += [rows[5]] * 4
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumns({"n": F.lit("own"), "whitened": F.lit(1)})
    got = W.whiten(df).collect()
    assert {r.component for r in got} >= {1, 2, 3} and len(got) % 64 == 0
    check(rows, [r for r in got], max(r.component for r in got))


@pytest.mark.parametrize("rows", [[], EDGE[:5], [(1, [1.0, 2.0])], [(i, [0.5, 0.25]) for i in range(9)]])
def test_no_variance_gives_no_rows(spark, rows):
    df = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)
    assert W.whiten(df).collect() == [] and len(W.whiten(df).columns) == 7


def test_large_entries(spark):
    rows = [(1, [1e9, 2.0]), (2, [-1e9, 5.0]), (3, [3e9, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = {r.vec_id: r.deviation for r in W.whiten(df, 1).collect()}
    assert got[3] is None or got[3] < 1 << 63
    with pytest.raises(Exception, match="not supported"):
        W.whiten(spark.createDataFrame([(1, [1e30, 1.0], 0)], SCHEMA)).collect()


def made(kind):
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    p = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    return {
        "random": rng.standard_normal((400, 40)), "graded": rng.standard_normal((400, 40)) * 10.0 ** np.linspace(0, -8, 40),
        "equal": q * 3, "clusters": q @ np.diag([5.0] * 10 + [4.0] * 10 + [1.0] * 20) @ p,
        "rank": rng.standard_normal((300, 5)) @ rng.standard_normal((5, 40)), "diagonal": np.diag(np.arange(1.0, 41)),
        "wilkinson": np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1),
    }[kind]


@pytest.mark.parametrize("kind", ["random", "graded", "equal", "clusters", "rank", "diagonal", "wilkinson"])
def test_solver(kind):
    rows = made(kind)
    values = np.linalg.svd(rows, compute_uv=False) ** 2
    variance, found, total = W.principal(W._triangle(rows), 1, 40)
    k = len(variance)
    assert k == (5 if kind == "rank" else rows.shape[1])
    assert np.abs(variance / values[:k] - 1).max() < 1e-8 and abs(total / values.sum() - 1) < 1e-12
    assert np.abs(found @ found.T - np.eye(k)).max() < 1e-8
    assert np.abs(rows.T @ (rows @ found.T) - found.T * variance).max() < 1e-8 * values[0]


def test_factors_join_in_any_number(spark):
    """Many factors are joined in rounds; the result is that of all rows."""
    states = [W._triangle(rng.standard_normal((7, 5))) for _ in range(70)]
    df = spark.createDataFrame([(bytearray(s.tobytes()),) for s in states], "state binary")
    r = np.frombuffer(W.tree(df, W._stacked(5), fan=3)).reshape(5, 5)
    want = sum(s.T @ s for s in states)
    assert np.abs(r.T @ r - want).max() < 1e-10 * np.abs(want).max()
