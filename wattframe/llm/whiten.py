"""Whitening of embeddings through the singular values of the centred rows.

Every entry c counts as the integer x = floor(``SCALE`` * c) + ``SHIFT``, so sums and deviations are exact.
The covariance is never formed: forming it would square the condition number. Instead

1. one pass sums the integers of every dimension;
2. a second pass centres the rows (exactly, by whole numbers and one fraction) and reduces blocks of them
   to their triangular factors R (blockwise QR); factors are stacked and reduced again, in rounds,
   until one R of d x d is left, whose singular values are those of all rows;
3. on that R: Householder reflections from both sides make it upper bidiagonal, differential quotient
   differences with shifts (dqds) give all its singular values with high relative accuracy, and a twisted
   factorisation of the shifted tridiagonal matrix gives the direction of each; directions of close values
   are told apart by steps of inverse iteration with orthogonalisation;
4. a third pass gathers the covariance of the whitened rows, and the last one returns them.

What reaches the driver is d sums and one d x d matrix, and d is bounded by ``MOST_DIMS``.

Defined cases: vectors that are null, empty, or hold null or non-finite entries take no part; if lengths
differ, the most frequent one counts (the largest of equally frequent ones) and other vectors take no
part. Entries of 2^42 and more in size are refused with an error, as their products would not be exact.
Repeated rows count and are returned each time; null ids are kept. Directions without variance (constant
or dependent dimensions, fewer rows than dimensions) have nothing to whiten and are left out, so a single
row gives none. ``deviation`` is null where it passes 64 bits. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattframe.llm import common as C

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Factors that one group joins, about.
FAN = 16
#: Rows (or four times the dimension) that one QR takes.
BLOCK = 4_096
MOST_DIMS = 2_048
_EPS = np.finfo(float).eps
_MOST = float(1 << 42)


# --- rows as integers --------------------------------------------------------------------------


def _vectors(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that take part, and their integers as a matrix."""
    column = batch.column(batch.schema.get_field_index("embedding"))
    column = column.cast(pa.list_(pa.float64()))
    right = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(right)
    flat = pc.list_flatten(column.take(pa.array(at)))
    values = flat.to_numpy(zero_copy_only=False).reshape(len(at), dims)
    fine = np.isfinite(values).all(axis=1)
    at, values = at[fine], values[fine]
    if values.size and np.abs(values).max() >= _MOST:
        raise ValueError(f"entries of {_MOST:.0f} and more are not supported")
    return at, np.floor(SCALE * values).astype(np.int64) + SHIFT


def _sums(dims: int):
    """Per batch and dimension: rows and sum, the latter in two halves that stay exact in 64 bits."""

    def run(batches):
        for batch in batches:
            _, x = _vectors(batch, dims)
            if len(x):
                high, low = (x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(dims)), pa.array(np.full(dims, len(x))), pa.array(high), pa.array(low)],
                    ["dim", "n", "high", "low"])

    return run


class Centre:
    """The exact mean of every dimension: whole part and remainder of S over n."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 over the dimensions; null if 64 bits do not hold it."""
        near = x - self.whole
        rough = np.square(self.n * np.abs(near).max(axis=1, initial=0).astype(float) + self.n) * x.shape[1]
        wide = rough >= 2.0**62
        out = np.square(self.n * near[~wide] - self.rest).sum(axis=1)
        found: list[int | None] = np.zeros(len(x), object)
        found[~wide] = out
        for i in np.flatnonzero(wide):
            exact = sum((self.n * a - b) ** 2 for a, b in zip(near[i].tolist(), self.rest.tolist()))
            found[i] = exact if exact < 1 << 63 else None
        return [None if v is None else int(v) for v in found]


# --- blockwise QR ------------------------------------------------------------------------------


def _triangle(rows: np.ndarray) -> np.ndarray:
    """d x d factor whose Gram matrix is that of the rows."""
    d = rows.shape[1]
    r = np.linalg.qr(rows, mode="r")
    return r if len(r) == d else np.vstack([r, np.zeros((d - len(r), d))])


def _factors(dims: int, centre: Centre):
    """One factor a task, updated block by block."""

    def run(batches):
        r = np.zeros((0, dims))
        block = max(BLOCK, 4 * dims)
        for batch in batches:
            _, x = _vectors(batch, dims)
            for a in range(0, len(x), block):
                r = _triangle(np.vstack([r, centre.rows(x[a : a + block])]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["state"])

    return run


def _stacked(dims: int):
    def add(a: bytes, b: bytes) -> bytes:
        return _triangle(np.vstack([np.frombuffer(x).reshape(dims, dims) for x in (a, b)])).tobytes()

    return add


def _added(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a) + np.frombuffer(b)).tobytes()


def tree(states: DataFrame, add: Callable[[bytes, bytes], bytes], fan: int = FAN) -> bytes | None:
    """All rows' ``state`` as one, about ``fan`` joined in a task and round by ``add``; none without rows.

    A round deals the states by a hash of their bytes and orders them in their group, so rounds that start
    with the same states join them alike. A task holds two of them at a time.
    """

    def join(batches) -> Iterator[pa.RecordBatch]:
        group, held = None, None
        for batch in batches:
            for g, state in zip(batch.column(0).to_pylist(), batch.column(1)):
                if g != group and held is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary())], ["state"])
                    held = None
                group = g
                held = state.as_py() if held is None else add(held, state.as_py())
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary())], ["state"])

    states = C.staged(states, "states")
    while (n := states.count()) > 1:
        groups = -(-n // fan)
        dealt = states.select(F.pmod(F.xxhash64("state"), F.lit(groups)).alias("g"), "state")
        dealt = dealt.repartition(min(groups, C.partitions(states.sparkSession)), "g").sortWithinPartitions("g", "state")
        states = C.staged(dealt.mapInArrow(join, "state binary"), "states")
    row = states.first()
    return bytes(row["state"]) if row else None


# --- singular values and directions of one small matrix ----------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a, superdiagonal b and V of R = U B V', by Householder reflections from both sides."""
    m = np.array(r, float)
    d = len(m)
    v = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        w = x.copy()
        size = np.linalg.norm(w)
        if size == 0 or not w[1:].any():
            return None
        w[0] += np.copysign(size, w[0])
        return w / np.linalg.norm(w)

    for k in range(d):
        w = reflector(m[k:, k])
        if w is not None:
            m[k:, k:] -= 2 * np.outer(w, w @ m[k:, k:])
        if k + 2 < d:
            w = reflector(m[k, k + 1 :])
            if w is not None:
                m[k:, k + 1 :] -= 2 * np.outer(m[k:, k + 1 :] @ w, w)
                v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One differential transform of the qd array; none if the shift passes the smallest value."""
    n = len(q)
    qq, ee, ds = [0.0] * n, [0.0] * (n - 1), [0.0] * n
    d = q[0] - shift
    for i in range(n - 1):
        if d < 0:
            return None
        ds[i] = d
        qq[i] = d + e[i]
        if qq[i] == 0:
            ee[i], d = 0.0, q[i + 1] - shift
            continue
        t = q[i + 1] / qq[i]
        ee[i] = e[i] * t
        d = d * t - shift
    if d < 0:
        return None
    ds[-1] = qq[-1] = d
    return qq, ee, ds


def singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared singular values of the bidiagonal matrix, falling.

    Each round transforms once without a shift, which yields the safe bound 1 / sum(1 / d) <= smallest
    value, then once with a bolder shift if that holds, else with the safe one. Negligible entries split
    the array, and a last entry that stands alone is a value.
    """
    found: list[float] = []
    top = max(float(np.max(a * a, initial=0)), float(np.max(b * b, initial=0)))
    tiny = top * np.finfo(float).tiny ** 0.5
    parts = [(list(map(float, a * a)), list(map(float, b * b)), 0.0)]
    while parts:
        q, e, done = parts.pop()
        while q:
            n = len(q)
            if n == 1:
                found.append(q[0] + done)
                break
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= _EPS**2 * (done + min(q[i], q[i + 1])) or e[i] <= tiny * _EPS), None)
            if cut is not None:
                if cut < n - 2:
                    parts.append((q[: cut + 1], e[:cut], done))
                    q, e = q[cut + 1 :], e[cut + 1 :]
                else:
                    found.append(q[-1] + done)
                    q, e = q[:-1], e[:-1]
                continue
            q, e, ds = _dqds(q, e, 0.0)
            least = min(ds)
            if least <= 0:
                # A zero value: the transform has moved it to the end.
                continue
            safe = 1 / sum(1 / x for x in ds) * (1 - 4 * n * _EPS)
            # The smallest value of the last corner, less what the rest still pulls it down by.
            bold = max(safe, q[-1] - (q[-1] * e[-1]) ** 0.5 if n > 1 else q[-1])
            for shift in (min(bold, least * (1 - 2 * _EPS)), safe):
                got = _dqds(q, e, shift)
                if got:
                    q, e, _ = got
                    done += shift
                    break
    return np.sort(np.array(found))[::-1]


def _twisted(a: np.ndarray, b: np.ndarray, value: float):
    """Factors of B'B - value, from both ends and met where the remaining pivot is smallest."""
    n = len(a)
    floor = np.finfo(float).tiny * 1e8 + _EPS**2 * float(np.max(a * a))
    dd = a * a
    lift = b * b  # D_i l_i^2
    up, p = np.zeros(max(n - 1, 0)), np.zeros(n)
    p[-1] = dd[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = lift[i] + p[i + 1]
        if pivot == 0:
            pivot = floor
        up[i] = a[i] * b[i] / pivot
        p[i] = p[i + 1] * (dd[i] / pivot) - value
    low, s = np.zeros(max(n - 1, 0)), np.zeros(n)
    plus, minus = np.zeros(n), np.append(0.0, lift + p[1:])
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + dd[i]
        if pivot == 0:
            pivot = floor
        plus[i] = pivot
        low[i] = a[i] * b[i] / pivot
        # l_i l_i+ s_i, with l_i = b_i / a_i.
        s[i + 1] = lift[i] / pivot * s[i] - value
    gamma = s + p + value
    return low, up, plus, minus, gamma, floor


def _solve(factors, k: int, rhs: np.ndarray | None) -> np.ndarray:
    """x of (B'B - value) x = rhs by the factors met at k; without rhs, the direction x with x[k] = 1."""
    low, up, plus, minus, gamma, floor = factors
    n = len(gamma)
    x = np.zeros(n)
    if rhs is None:
        x[k] = 1.0
    else:
        y = rhs.copy()
        for i in range(k):
            y[i + 1] -= low[i] * y[i]
        for i in range(n - 2, k - 1, -1):
            y[i] -= up[i] * y[i + 1]
        safe = lambda t: np.where(t == 0, floor, t)
        x[:k] = y[:k] / safe(plus[:k])
        x[k] = y[k] / safe(gamma[k])
        x[k + 1 :] = y[k + 1 :] / safe(minus[k + 1 :])
    for i in range(k - 1, -1, -1):
        x[i] -= low[i] * x[i + 1]
    for i in range(k, n - 1):
        x[i + 1] -= up[i] * x[i]
    return x / np.linalg.norm(x)


def directions(a: np.ndarray, b: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Right singular vectors of the bidiagonal matrix for the first ``count`` squared values."""
    n, out = len(a), []
    a = np.where(a == 0, _EPS**2 * np.sqrt(values[0]), a)
    start = np.random.default_rng(0)

    def without(x: np.ndarray, close: list[np.ndarray]) -> np.ndarray:
        for _ in range(2):
            for v in close:
                x = x - (v @ x) * v
        return x

    for i in range(count):
        # Values this near share a subspace in which only orthogonality tells directions apart.
        close = [out[j] for j in range(i) if values[j] - values[i] <= 1e-3 * values[j]]
        factors = _twisted(a, b, values[i])
        k = int(np.argmin(np.abs(factors[4])))
        x = without(_solve(factors, k, None), close)
        if np.linalg.norm(x) < 0.7:
            x = without(start.standard_normal(n), close)
            for _ in range(4):
                x = without(_solve(factors, k, x / np.linalg.norm(x)), close)
        out.append(x / np.linalg.norm(x))
    return np.array(out).reshape(count, n)


def principal(r: np.ndarray, n: int, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """Variances of the first components, their unit directions (rows), and the variance of all."""
    size = float(np.abs(r).max(initial=0))
    if size == 0:
        return np.zeros(0), np.zeros((0, r.shape[1])), 0.0
    a, b, v = bidiagonal(r / size)
    values = singular_values(a, b)
    held = int((values[:components] > (len(a) * _EPS) ** 2 * values[0]).sum())
    found = directions(a, b, values, held) @ v.T
    scale = size * size / n
    return values[:held] * scale, found, float(values.sum() * scale)


# --- the operator ------------------------------------------------------------------------------


def _moments(dims: int, centre: Centre, turn: np.ndarray):
    """Sums and sums of products of the whitened rows, per task."""

    def run(batches):
        k = len(turn)
        total, n = np.zeros(k + k * k), 0
        for batch in batches:
            z = centre.rows(_vectors(batch, dims)[1]) @ turn.T
            total[:k] += z.sum(axis=0)
            total[k:] += (z.T @ z).reshape(-1)
            n += len(z)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["state"])

    return run


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whitened(dims: int, centre: Centre, turn: np.ndarray, explained: np.ndarray, error: float):
    def run(batches):
        k = len(turn)
        for batch in batches:
            at, x = _vectors(batch, dims)
            if not len(at):
                continue
            z = centre.rows(x) @ turn.T
            each = pa.array(np.repeat(np.arange(len(at)), k))
            n = len(at) * k
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)).take(each), pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()),
                 pa.array(np.full(n, centre.n)), pa.array(centre.deviations(x), pa.int64()).take(each), pa.array(z.reshape(-1)),
                 pa.array(np.tile(explained, len(at))), pa.array(np.full(n, error))], [c.split()[0] for c in _OUT.split(", ")])

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, a row per vector and component."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    none = spark.createDataFrame([], _OUT)
    sane = rows.where("size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = DOUBLE('Infinity'))")
    lengths = sane.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return none
    dims = lengths["d"]
    if dims > MOST_DIMS:
        raise ValueError(f"vectors of {dims} entries; up to {MOST_DIMS} are supported")
    halves = sane.mapInArrow(_sums(dims), "dim long, n long, high long, low long").groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(20,0)")).alias("high"), F.sum(F.col("low").cast("decimal(20,0)")).alias("low"))
    sums = sorted(halves.collect())
    centre = Centre(sums[0]["n"], [(int(s["high"]) << 26) + int(s["low"]) for s in sums])
    r = np.frombuffer(tree(sane.mapInArrow(_factors(dims, centre), "state binary"), _stacked(dims))).reshape(dims, dims)
    variance, found, total = principal(r, centre.n, components)
    k = len(variance)
    if not k:
        return none
    turn = found / np.sqrt(variance)[:, None]
    moments = np.frombuffer(tree(sane.mapInArrow(_moments(dims, centre, turn), "state binary"), _added)) / centre.n
    covariance = moments[k:].reshape(k, k) - np.outer(moments[:k], moments[:k])
    error = float(np.abs(covariance - np.eye(k)).max())
    return sane.mapInArrow(_whitened(dims, centre, turn, variance / total, error), _OUT)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(C.load(spark, sf_dir, "embeddings"))
