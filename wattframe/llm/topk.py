"""Exact top-k inner products by no-random-access aggregation.

A block of candidates keeps one list per dimension, its members in the order of that component. A
query reads the lists of its positive components from the top and of its negative ones from the
bottom, all to the same depth. What has been read bounds the scores of all others: a member that no
list has shown yet scores at most what the values where reading stands would give (``Reading.above``).
Each query has its own floor, the k-th best score that it has found, in this block or in one that the task has
read before. Reading goes on in steps until no unread member can reach the floor, or to the end, and a block
whose first entries cannot reach it is not read at all; the scores of members read are resolved.
Few queries (``Lists.best``) also bound each member by the components read of it, from below by the list's last
value for every component not read, from above by the value where reading stands: a member whose upper bound falls
below the floor is an outsider. That takes four products of queries with members a step, their scores one,
so many queries at once take the scores of what they have read.

Scores are integers. They are computed in single precision where the lengths of query and member (by Cauchy and
Schwarz) keep every partial sum below 2^24, else in double precision below 2^53: exact in both.

How much reading saves depends on the data: where few members stand out, reading stops after the first steps or
before; components without structure in 64 dimensions are read to the end (figures in the README), so the
work is that of all products.

Candidates and queries are dealt to a grid of tasks. A task holds one group of queries with the k best of
each, and one share of the candidates goes by, block by block; then the best k per query are ranked
over the shares. The grid is so chosen that little moves: a query goes once to every share, a candidate once to
every group.

Defined cases: null vectors, vectors with null or non-finite components and rows without an id take no
part; vectors of
different length do not meet; rows equal in id and vector are one row; rows that share the query's id
are its own; rows that share id and score are one rank; fewer candidates than k give as many ranks; ties go to
the smaller id. A vector whose scores
might pass 2^53 (components of about 2^22 and more in 64 dimensions) is refused with an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from wattframe.llm import common as C

K = 5
EVERY = 50
_LAST, _MANY = np.iinfo(np.int64).max, 64
BLOCK = 4_096
QUERIES = 512
#: Depths of reading, as parts of a block; then to the end.
DEPTHS = (1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4)
#: Members that a step of ``Reading`` takes, and queries that take it together: their scores fit a core's cache.
STEP, TOGETHER = 1_024, 256
#: Up to so many queries bound each member by what they have read of it.
FEW = 64
#: Bytes of queries that a task holds, and products that it computes at least and at most, by the counts.
HELD = 96 << 20
FEWEST, MOST = 1 << 25, 1 << 38
#: Scores that wait to be sorted into the lists of the best.
WAITING = 1 << 18
#: Bytes of components that wait to fill their blocks.
MOST_WAITING = 64 << 20


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def integers(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, v``: floor(256 * x) of every component of the usable vectors."""
    x = F.col(vector)
    fit = F.array_max(F.transform(x, lambda c: F.abs(c.cast("double")) * 256 + 1)) < F.sqrt(F.lit(2.0**53) / F.size(x))
    checked = F.when(fit, x).otherwise(F.raise_error(F.lit("components are too large for exact scores")))
    return vectors.where(usable(x) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(checked, lambda c: F.floor(c.cast("double") * 256).cast("long")).alias("v"),
    ).distinct()


def _narrow(v: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as hold them all."""
    most = max(int(v.max(initial=0)), -int(v.min(initial=0)))
    return v.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max), copy=False)


def _packed(size: int):
    """One row per block: ids and components of its members."""

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        waiting: dict[int, list] = {}  # by length: vectors that do not fill a block yet
        held = 0

        def close(dims, least):
            nonlocal made, held
            ids, parts = (np.concatenate(x) for x in zip(*waiting.pop(dims)))
            parts = parts.reshape(-1, dims)
            for at in range(0, len(ids), size):
                if len(ids) - at < least:
                    waiting[dims] = [(ids[at:], parts[at:].ravel())]
                    break
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dims], pa.int32()), pa.array([(task << 32) + made], pa.int64()),
                     pa.array([ids[at : at + size].tobytes()], pa.binary()),
                     pa.array([_narrow(parts[at : at + size]).tobytes()], pa.binary())],
                    ["dims", "block", "ids", "v"])
                made += 1
            held += sum(p.nbytes for _, p in waiting.get(dims, [])) - parts.nbytes

        for batch in batches:
            lengths, ids, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for dims in np.unique(lengths).tolist():
                of = np.flatnonzero(lengths == dims)
                some = v if len(of) == len(lengths) else v.take(pa.array(of))
                # A copy, as numbers of 64 bits would keep the whole batch.
                part = _narrow(some.flatten().to_numpy()).copy()
                waiting.setdefault(dims, []).append((ids[of], part))
                held += part.nbytes
                if sum(len(i) for i, _ in waiting[dims]) >= size:
                    yield from close(dims, size)
            if held > MOST_WAITING:
                for dims in list(waiting):
                    yield from close(dims, 1)
        for dims in list(waiting):
            yield from close(dims, 1)

    return run


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """``dims, block, ids, v``: vectors of equal length in blocks of ``size``, each packed where its rows are."""
    return rows.select(F.size("v").alias("dims"), "vec_id", "v").mapInArrow(
        _packed(size), "dims int, block long, ids binary, v binary")


def _dealt(n: int) -> Column:
    """0 to n - 1, alike often: the blocks of one task in turn, each task from another start."""
    start = F.floor(F.pmod(F.shiftright("block", 32) * F.lit(0.6180339887498949), F.lit(1.0)) * n)
    return F.pmod(start + F.col("block").bitwiseAND((1 << 32) - 1), F.lit(n)).cast("int")


class Lists:
    """A block's members as sorted lists, one per dimension and direction."""

    def __init__(self, v: np.ndarray):
        self.v = v.astype(np.float64)  # members x dimensions
        n, dims = v.shape
        lists = np.ascontiguousarray(v.T)
        order = np.argsort(lists, axis=1, kind="stable")
        up = np.empty((dims, n), np.int32)  # place of each member in each list, from the bottom
        np.put_along_axis(up, order, np.arange(n, dtype=np.int32)[None, :], axis=1)
        self.up, self.down = up.T, (n - 1 - up).T
        self.sorted = np.take_along_axis(lists, order, axis=1).T.astype(np.float64)

    def bounds(self, some: np.ndarray, plus: np.ndarray, minus: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (queries x members) when all lists have been read to this depth."""
        n = len(self.v)
        # What has been read, and what stands for the rest: the value where reading stands bounds it
        # from above, the list's last value from below.
        v, top, bottom = self.v[some], self.sorted[n - depth], self.sorted[depth - 1]
        read_down, read_up = self.down[some] < depth, self.up[some] < depth
        high = plus @ np.where(read_down, v, top).T + minus @ np.where(read_up, v, bottom).T
        low = plus @ np.where(read_down, v, self.sorted[0]).T + minus @ np.where(read_up, v, self.sorted[-1]).T
        return low, high

    def best(self, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        """(query, member, score) of at least the k best members of each query, ties included, less what is
        below the queries' ``floor``, which is raised to the k-th best found here."""
        n = len(ids)
        floor = np.full(len(q), -np.inf) if floor is None else floor
        plus, minus = np.maximum(q, 0.0), np.minimum(q, 0.0)
        live = q_ids[:, None] != ids[None, :]
        once = np.zeros(n, bool)  # members of one id may share a rank
        once[np.unique(ids, return_index=True)[1]] = True

        def raise_floor(value: np.ndarray, some: np.ndarray) -> None:
            value = np.where(live[:, some] & once[some], value, -np.inf)
            if len(some) >= k:
                np.maximum(floor, np.partition(value, len(some) - k, axis=1)[:, len(some) - k], out=floor)

        self.left = []  # members a query has left after each step, on average
        for part in DEPTHS:
            depth, some = int(n * part), np.flatnonzero(live.any(axis=0))
            if not 0 < depth < n:
                continue
            if live.sum(axis=1).max(initial=0) <= k:
                break
            low, high = self.bounds(some, plus, minus, depth)
            raise_floor(low, some)
            live[:, some] &= high >= floor[:, None]
            self.left.append(float(live.sum(axis=1).mean()))
        some = np.flatnonzero(live.any(axis=0))
        score = np.where(live[:, some], q @ self.v[some].T, -np.inf)
        raise_floor(score, some)
        i, j = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
        return i, some[j], score[i, j]


class Reading:
    """A block of candidates in the order in which its lists, read from both ends, show them, by steps."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.lists, self.members, n = Lists(v), ids, len(ids)
        lists = self.lists
        depth = np.minimum(lists.up, lists.down).min(axis=1)
        shown = np.argsort(depth, kind="stable")
        starts = np.arange(0, n, STEP)
        # Who has not been shown before a depth lies, in every list, between the values there.
        self.top, self.bottom = lists.sorted[n - 1 - depth[shown[starts]]], lists.sorted[depth[shown[starts]]]
        for at in starts:
            step = shown[at : at + STEP]
            step[:] = step[np.argsort(ids[step], kind="stable")]
        self.ids, self.v = ids[shown], v[shown]
        self.steps = [(at, at + STEP) for at in starts.tolist()]
        self.length = float(np.sqrt((lists.v**2).sum(axis=1).max(initial=0)))

    def above(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds (queries x steps) of the scores of all that is not read before a step."""
        return np.maximum(q, 0.0) @ self.top.T + np.minimum(q, 0.0) @ self.bottom.T


class Held:
    """A group of queries, each with the k best (id, score) that it has met so far; ties to the smaller id."""

    def __init__(self, k: int, ids: np.ndarray, q: np.ndarray):
        self.k, self.ids, self.q = k, ids, q
        self.score, self.best = np.full((len(ids), k), -np.inf), np.full((len(ids), k), _LAST)
        # What a new score must pass, and the id that a score equal to it must fall below.
        self.floor, self.worst = np.full(len(ids), -np.inf), np.full(len(ids), _LAST)
        self.length = max((float(np.sqrt((q[a : a + BLOCK].astype(np.float64) ** 2).sum(axis=1).max()))
                           for a in range(0, len(q), BLOCK)), default=0.0)
        self.new: list[tuple] = []
        self.waiting = 0
        self.scored = 0  # products of queries and members so far

    def meet(self, block: Reading) -> None:
        if len(self.ids) <= FEW:
            i, j, score = block.lists.best(block.members, self.q.astype(np.float64), self.ids, self.k, self.floor)
            self.scored += len(self.ids) * len(block.members)
            self._wait(i, block.members[j], score)
        else:
            self._read(block)
        self._sort_in()

    def _read(self, block: Reading) -> None:
        kind = np.float32 if (self.length + 1) * (block.length + 1) < 1 << 24 else np.float64
        v, room = block.v.astype(kind), np.empty((STEP, TOGETHER), kind)
        for a in range(0, len(self.ids), TOGETHER):
            q = self.q[a : a + TOGETHER].astype(np.float64)
            above, asked = block.above(q), q.T.astype(kind, order="C")
            for step, (start, end) in enumerate(block.steps):
                open_ = np.flatnonzero(above[:, step] >= self.floor[a : a + TOGETHER])
                if not len(open_):
                    break
                some = asked if len(open_) == len(q) else asked.take(open_, axis=1)
                whole = len(open_) == TOGETHER and end <= len(v)
                scores = np.matmul(v[start:end], some, out=room if whole else None)
                self.scored += scores.size
                self._take(a + open_, block.ids[start:end], scores)

    def _take(self, of: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores (members x queries), members by id, that may be among the best."""
        first = np.append(True, ids[1:] != ids[:-1])
        open_ = np.flatnonzero(self.floor[of] == -np.inf)
        if len(open_) and first.sum() >= self.k:
            # The k-th best of as many other ids.
            value = scores[np.ix_(first, open_)]
            value[ids[first][:, None] == self.ids[of[open_]]] = -np.inf
            self.floor[of[open_]] = np.partition(value, len(value) - self.k, axis=0)[len(value) - self.k]
        floor, worst, most = self.floor[of], self.worst[of], scores.max(axis=0)
        near = np.flatnonzero((most > floor) | ((most == floor) & (ids[0] < worst)))
        if not len(near):
            return
        if len(near) < len(of):
            of, floor, worst, scores = of[near], floor[near], worst[near], scores.take(near, axis=1)
        hit = scores >= floor
        if first.all() and np.count_nonzero(hit) > _MANY * len(of):
            # Of equal scores those of the smallest ids are enough; one may be the query's own.
            tie = scores == floor
            hit &= ~tie | (np.cumsum(tie, axis=0) <= self.k + 1)
        at = np.flatnonzero(hit)
        j, i = np.divmod(at, len(of))
        score, m = scores.ravel()[at].astype(np.float64), ids[j]
        may = ((score > floor[i]) | (m < worst[i])) & (m != self.ids[of[i]])
        self._wait(of[i[may]], m[may], score[may])

    def _wait(self, of: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.new.append((of, ids, score))
        self.waiting += len(of)
        if self.waiting > WAITING:
            self._sort_in()

    def _sort_in(self) -> None:
        if not self.waiting:
            return
        i, ids, score = (np.concatenate(x) for x in zip(*self.new))
        self.new, self.waiting = [], 0
        of = np.unique(i)
        had = np.flatnonzero(self.score[of].ravel() > -np.inf)
        i = np.append(i, np.repeat(of, self.k)[had])
        ids, score = np.append(ids, self.best[of].ravel()[had]), np.append(score, self.score[of].ravel()[had])
        order = np.lexsort((ids, -score, i))
        i, ids, score = i[order], ids[order], score[order]
        once = np.append(True, (i[1:] != i[:-1]) | (ids[1:] != ids[:-1]) | (score[1:] != score[:-1]))
        i, ids, score = i[once], ids[once], score[once]
        head = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        nth = np.arange(len(i)) - np.repeat(head, np.diff(np.append(head, len(i))))
        i, ids, score, nth = (x[nth < self.k] for x in (i, ids, score, nth))
        self.score[i, nth], self.best[i, nth] = score, ids
        full = of[self.score[of, -1] > -np.inf]
        self.floor[full], self.worst[full] = self.score[full, -1], self.best[full, -1]

    def rows(self):
        """``query_id, vec_id, score`` of what was found."""
        for a in range(0, len(self.ids), BLOCK):
            i, nth = np.nonzero(self.score[a : a + BLOCK] > -np.inf)
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.ids[a + i]), pa.array(self.best[a + i, nth]), pa.array(self.score[a + i, nth].astype(np.int64))],
                ["query_id", "vec_id", "score"])


def _met(k: int):
    """The k best of each query group in a share of the candidates; the group's rows come first."""

    def run(batches):
        name, asked, held = None, [], None
        for batch in batches:
            for dims, candidates, ids, v in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if dims != name:
                    if held:
                        yield from held.rows()
                    name, asked, held = dims, [], None
                ids = np.frombuffer(ids, np.int64)
                v = np.frombuffer(v, f"i{len(v) // (len(ids) * dims)}").reshape(-1, dims)
                if not candidates:
                    asked.append((ids, v))
                    continue
                if asked:
                    held, asked = Held(k, *(np.concatenate(x) for x in zip(*asked))), []
                if held:
                    held.meet(Reading(ids, v))
        if held:
            yield from held.rows()

    return run


def grid(candidates: int, queries: int, held: int, cores: int) -> tuple[int, int]:
    """Shares of the candidates and groups of the queries (``held`` bytes in all), one task for each pair: as many
    as there is work for, and so that about as little as can be of both tables moves."""
    work = candidates * queries
    tasks = min(-(-work // FEWEST), max(2 * cores, -(-work // MOST)))
    groups = max(1, round((tasks * queries / max(1, candidates)) ** 0.5), -(-held // HELD))
    return max(1, -(-tasks // groups)), groups


def search(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score`` over integer vectors ``vec_id, v``."""
    most = F.greatest(F.array_max("v"), -F.array_min("v"))
    n, components, most = queries.agg(F.count("*"), F.sum(F.size("v")), F.max(most)).first()
    held = (components or 0) * _narrow(np.array([most or 0])).itemsize + n * (16 * k + 24)
    shares, groups = grid(vectors.count(), n, held, vectors.sparkSession.sparkContext.defaultParallelism)
    own = blocks(vectors, block).select(F.lit(True).alias("candidates"), "dims", "ids", "v", _dealt(shares).alias("share"),
                                        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    asked = blocks(queries, query_block).select(F.lit(False).alias("candidates"), "dims", "ids", "v",
                                                F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"),
                                                _dealt(groups).alias("group"))
    # Vectors of one length fill the tasks from a place of their own.
    task = F.pmod(F.xxhash64("dims") + F.col("share") * groups + F.col("group"), F.lit(shares * groups)).cast("int")
    met = asked.unionByName(own).withColumn("task", task)
    met = met.repartitionById(shares * groups, "task").sortWithinPartitions("dims", "candidates")
    best = met.select("dims", "candidates", "ids", "v").mapInArrow(_met(k), "query_id long, vec_id long, score long")
    # Equal id and score take one rank.
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.dense_rank().over(by).cast("int")).where(F.col("rank") <= k)
    return ranked.groupBy("query_id", "rank").agg(F.min("vec_id").alias("vec_id"), F.min("score").alias("score"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = C.staged(integers(C.load(spark, sf_dir, "embeddings")), "integers")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


ORACLE_SQL = f"""
WITH ok AS (
  SELECT DISTINCT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM ok q JOIN ok c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id
  WHERE q.vec_id % {EVERY} = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT DISTINCT * FROM scored)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {K}
"""
