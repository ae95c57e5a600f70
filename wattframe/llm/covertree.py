"""Near-duplicate vectors by a dual traversal of cover trees.

Vectors of one label and length link when their cosine is at least ``COSINE``, that is when the unit
vectors are within r = sqrt(2 - 2 cos) of each other. Equal vectors are one class with a count.

The top of the tree is grown on Spark: a part of a label that is larger than a block chooses centres far
from each other among a bounded sample of its classes, every class goes to its nearest centre, and the new
parts are split again. A part that fits is a block with a centre and a covering radius. Two blocks whose
centres are farther apart than r plus both radii hold no link; such pairs are dropped on these alone,
before any vectors move, and only the other pairs meet. (Vectors without structure lie in wide blocks of
which none can be dropped; then every two blocks of a label meet.)

A block of classes becomes a cover tree: a node covers its members within its radius, its children are
centres chosen so that every member lies within half the radius of one (its own centre again among
them), and so on down to single vectors. Two trees are walked together: a pair of nodes whose centres
are farther apart than r plus both covering radii holds no link and is dropped; one whose centres are
close enough that even the farthest members are within r links as a whole and is counted without being
opened; any other pair is replaced by the pairs of their children. Vectors that meet at the bottom are
compared in double precision. A meeting is one task that holds two blocks, whatever the size of the label.

A meeting returns, per class, the number of vectors linked and one local root, so a cluster of any size
costs one row per class and meeting; components come from joins over these roots.

Defined cases: null, zero or empty vectors, vectors with null or non-finite components and rows without
a label link with nothing and are their own component; repeated rows are separate vectors of one
class; a row without an id counts as a vector but is never the smallest id.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from wattframe.llm import common as C
from wattframe.llm.graph import components
from wattframe.llm.topk import usable
from wattframe.session import small

COSINE = 0.98
BLOCK = 2_048
LEAF = 8
#: Centres of a part, the sample they are chosen from, and the rows that one task deals to them.
CENTRES, SAMPLE, SHARE = 16, 256, 20_000
#: Times that parts are split; 16^6 blocks of a label. What is larger then is cut by a hash.
LEVELS = 6
#: Blocks whose centres are compared at a time.
HEADS = 1_024
#: Distances this close to a border are decided by the cosine itself.
_CLOSE = 1e-7


# --- the tree ----------------------------------------------------------------------------------


@dataclass
class Node:
    centre: int
    radius: float
    members: np.ndarray
    children: list["Node"] = field(default_factory=list)


def grow(u: np.ndarray, members: np.ndarray, centre: int) -> Node:
    """The tree of ``members`` (rows of the unit vectors ``u``) around one of them."""

    def node(centre: int, members: np.ndarray, far: np.ndarray) -> Node:
        return Node(centre, float(far.max()), members)

    root = node(centre, members, _chord(u[members] @ u[centre]))
    open_ = [root]
    while open_:
        top = open_.pop()
        if len(top.members) <= LEAF or top.radius <= 0:
            continue
        half, rest = top.radius / 2, top.members
        # The node's own centre comes first, then whoever is not covered yet.
        pick = top.centre
        while len(rest):
            far = _chord(u[rest] @ u[pick])
            near = far <= half
            near[rest == pick] = True
            child = node(pick, rest[near], far[near])
            top.children.append(child)
            open_.append(child)
            rest = rest[~near]
            if len(rest):
                pick = int(rest[0])
    return root


def _chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


# --- dual traversal ----------------------------------------------------------------------------


class Walk:
    """Links between the members of two trees over the same unit vectors, or within one tree."""

    def __init__(self, v: np.ndarray, u: np.ndarray, count: np.ndarray, cosine: float):
        self.v, self.u, self.count, self.cosine = v, u, count, cosine
        self.norm = np.sqrt(np.einsum("ij,ij->i", v, v))
        self.reach = float(np.sqrt(2.0 - 2.0 * cosine))
        self.links = np.zeros(len(u), np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def together(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """All members of a link with all of b."""
        if same:
            self.links[a] += self.count[a].sum() - self.count[a]
        else:
            self.links[a] += self.count[b].sum()
            self.links[b] += self.count[a].sum()
        both = np.concatenate([a, b])
        self.edges.append((both, np.full(len(both), both[0])))

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        """Pairs (a[i], b[i]) of single vectors."""
        cosine = np.einsum("ij,ij->i", self.v[a], self.v[b]) / (self.norm[a] * self.norm[b])
        hit = cosine >= self.cosine
        a, b = a[hit], b[hit]
        np.add.at(self.links, a, self.count[b])
        np.add.at(self.links, b, self.count[a])
        self.edges.append((a, b))

    def bottom(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """Members of two small or even nodes, one with another."""
        for at in range(0, len(a), 512):
            x = a[at : at + 512]
            near = _chord(self.u[x] @ self.u[b].T) <= self.reach + _CLOSE
            if same:
                near &= np.arange(at, at + len(x))[:, None] < np.arange(len(b))[None, :]
            i, j = np.nonzero(near)
            if len(i):
                self.compare(x[i], b[j])

    def walk(self, left: Node, right: Node, same: bool) -> None:
        """``same``: both are one node, whose pairs count once."""
        todo = [(left, right, same)]
        while todo:
            a, b, same = todo.pop()
            if same and 2 * a.radius <= self.reach - _CLOSE:
                self.together(a.members, a.members, True)
                continue
            if not a.children and not b.children:
                self.bottom(a.members, b.members, same)
                continue
            x = a.children or [a]
            y = x if same else b.children or [b]
            if not same and a.children and b.children and max(a.radius, b.radius) > 2 * min(a.radius, b.radius):
                # Open the wider node alone, as levels halve.
                x, y = (x, [b]) if a.radius > b.radius else ([a], y)
            far = _chord(self.u[[n.centre for n in x]] @ self.u[[n.centre for n in y]].T)
            r, s = np.array([n.radius for n in x]), np.array([n.radius for n in y])
            live = far - r[:, None] - s[None, :] <= self.reach + _CLOSE
            whole = far + r[:, None] + s[None, :] <= self.reach - _CLOSE
            if same:
                live &= np.triu(np.ones(live.shape, bool))
            i, j = np.nonzero(live)
            single = (r[i] == 0) & (s[j] == 0) & np.array([len(x[k].members) == 1 for k in i], bool) & np.array(
                [len(y[k].members) == 1 for k in j], bool)
            if same:
                single &= i != j
                own = (i == j) & np.array([len(x[k].members) == 1 for k in i], bool)
            else:
                own = np.zeros(len(i), bool)
            if single.any():
                self.compare(np.array([x[k].centre for k in i[single]]), np.array([y[k].centre for k in j[single]]))
            for k, m in zip(i[~single & ~own].tolist(), j[~single & ~own].tolist()):
                mine = same and k == m
                if whole[k, m] and not mine:
                    self.together(x[k].members, y[m].members, False)
                else:
                    todo.append((x[k], y[m], mine))


def _roots(n: int, edges) -> np.ndarray:
    """Smallest position reachable by the edges."""
    root = np.arange(n)
    if edges:
        a, b = (np.concatenate(x) for x in zip(*edges))
        while True:
            least = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, least)
            np.minimum.at(new, b, least)
            np.minimum.at(new, root[a], least)
            np.minimum.at(new, root[b], least)
            new = new[new]
            if (new == root).all():
                break
            root = new
    return root


# --- on DataFrames -----------------------------------------------------------------------------


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    """Vectors of equal length as rows, scaled to length one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _centres(sample: pa.Table) -> pa.Table:
    """Of a part's sample, ``most`` members far from each other: each the farthest from those before it."""
    sample, most = sample.sort_by("o"), sample.column("most")[0].as_py()
    u = _matrix(sample.column("v"), sample.num_rows)
    pick, far = [0], _chord(u @ u[0])
    while len(pick) < min(most, len(u)) and far.max() > 0:
        pick.append(int(far.argmax()))
        far = np.minimum(far, _chord(u @ u[pick[-1]]))
    out = sample.take(pa.array(pick))
    return pa.table({"part": out.column("part"), "i": pa.array(np.arange(len(pick), dtype=np.int32)), "v": out.column("v")})


_DEALT = pa.schema([("part", pa.int64()), ("c", pa.int64()), ("i", pa.int32())])


def _nearest(members: pa.Table, centres: pa.Table) -> pa.Table:
    """The nearest centre of each member of a part."""
    if not members.num_rows or not centres.num_rows:
        return _DEALT.empty_table()
    centres = centres.sort_by("i")
    near = (_matrix(members.column("v"), members.num_rows) @ _matrix(centres.column("v"), centres.num_rows).T).argmax(axis=1)
    return pa.table([members.column("part"), members.column("c"), pa.array(near.astype(np.int32))], schema=_DEALT)


def _parted(classes: DataFrame, block: int) -> DataFrame:
    """``grp, c, block``: the classes of each group in blocks of about ``block``, near ones together."""
    at = C.staged(classes.select("grp", "c", F.col("grp").alias("part")), "parts")
    vectors, done = classes.select("c", "v"), []
    for level in range(LEVELS + 1):
        size = C.staged(at.groupBy("part").agg(F.count("*").alias("m")), "part-sizes")
        large = size.where(F.col("m") > block)
        cut = F.ceil(F.col("m") / block).cast("int")
        if level == LEVELS or not large.take(1):
            # The last parts are cut by a hash where they are still too large.
            done.append(at.join(small(size), "part").withColumn(
                "block", F.when(cut > 1, F.xxhash64("part", F.pmod(F.xxhash64("c"), cut))).otherwise(F.col("part"))).drop("part", "m"))
            break
        done.append(at.join(small(size.where(F.col("m") <= block).select("part")), "part", "left_semi").select(
            "grp", "c", F.col("part").alias("block")))
        over = at.join(small(large), "part").join(vectors, "c")
        order = W.partitionBy("part").orderBy("o", "c")
        # About as many parts as blocks are needed: more would meet more often than they save.
        most = F.least(F.lit(CENTRES), F.ceil(1.5 * F.col("m") / block).cast("int"))
        sample = over.select("part", "c", "v", most.alias("most"), F.xxhash64("c", F.lit(level)).alias("o")).withColumn(
            "rank", F.row_number().over(order)).where(F.col("rank") <= SAMPLE).drop("rank", "c")
        centres = C.staged(sample.groupBy("part").applyInArrow(_centres, "part long, i int, v array<double>"), "centres")
        shares = F.ceil(F.col("m") / SHARE).cast("int")
        spread = centres.join(small(large), "part").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
        members = over.withColumn("share", F.pmod(F.xxhash64("c"), shares).cast("int")).select("part", "share", "c", "v")
        dealt = C.staged(members.groupBy("part", "share").cogroup(spread.select("part", "share", "i", "v").groupBy("part", "share")).applyInArrow(
            _nearest, "part long, c long, i int"), "dealt")
        at = C.staged(at.join(dealt, ["part", "c"]).select("grp", "c", F.xxhash64("part", "i", F.lit(level)).alias("part")), "parts")
    return reduce(DataFrame.unionByName, done)


def _packed(batches):
    """One row per block of sorted (grp, block): class ids, counts, vectors, and a centre with its radius."""
    name, held = None, []

    def close():
        c, m, v = (np.concatenate([h[i] for h in held]) for i in range(3))
        u = v.reshape(len(c), -1)
        u = u / np.sqrt(np.einsum("ij,ij->i", u, u))[:, None]
        centre = u.mean(axis=0)
        length = np.sqrt(centre @ centre)
        centre = centre / length if length > 1e-6 else u[0]
        radius = float(_chord(u @ centre).max())
        return pa.RecordBatch.from_arrays(
            [pa.array([name[0]], pa.int64()), pa.array([name[1]], pa.int64()), pa.array([c.tobytes()], pa.binary()),
             pa.array([m.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary()),
             pa.array([centre.tobytes()], pa.binary()), pa.array([radius])],
            ["grp", "block", "c", "m", "v", "centre", "radius"])

    for batch in batches:
        grp, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        at = np.flatnonzero(np.append(True, (grp[1:] != grp[:-1]) | (block[1:] != block[:-1]))) if len(grp) else np.zeros(0, int)
        for s, e in zip(at, np.append(at[1:], len(grp))):
            now = (int(grp[s]), int(block[s]))
            if now != name and held:
                yield close()
                held = []
            name = now
            held.append((batch.column(2).slice(s, e - s).to_numpy(), batch.column(3).slice(s, e - s).to_numpy(),
                         batch.column(4).slice(s, e - s).flatten().to_numpy()))
    if held:
        yield close()


def _near(cosine: float):
    """Pairs of blocks (a <= b) near enough for a link, from cells of up to two lots of block heads."""
    reach = float(np.sqrt(2.0 - 2.0 * cosine)) + _CLOSE

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("block")
        block = cell.column("block").to_numpy()
        centre = np.stack([np.frombuffer(x) for x in cell.column("centre").to_pylist()])
        radius, side = cell.column("radius").to_numpy(), cell.column("side").to_numpy()
        i, j = np.nonzero(np.triu(_chord(centre @ centre.T) - radius[:, None] - radius[None, :] <= reach))
        keep = (side[i] != side[j]) | (side[i] == 2)
        grp = cell.column("grp")[0].as_py()
        return pa.table({"grp": pa.array(np.full(keep.sum(), grp)), "a": pa.array(block[i[keep]]), "b": pa.array(block[j[keep]])})

    return run


def near_blocks(heads: DataFrame, cosine: float) -> DataFrame:
    """``grp, a, b``: the pairs of blocks (a <= b) of a group that can hold a link, a block with itself included."""
    lots = F.ceil(F.col("blocks") / HEADS).cast("int")
    counted = heads.join(heads.groupBy("grp").agg(F.count("*").alias("blocks")), "grp").withColumn(
        "lot", F.pmod(F.xxhash64("block"), lots).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), lots - 1)))
    side = F.when(F.col("lot") == F.col("other"), 2).when(F.col("lot") < F.col("other"), 0).otherwise(1)
    cells = counted.select("grp", F.least("lot", "other").alias("x"), F.greatest("lot", "other").alias("y"), "block", "centre", "radius", side.alias("side"))
    return cells.groupBy("grp", "x", "y").applyInArrow(_near(cosine), "grp long, a long, b long")


def _met(cosine: float):
    """Links of two blocks (or within one): per class with any, its count and a local root."""

    def run(batches):
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                same, packs = row[0], (row[1:4], row[4:7])
                sides = []
                for c, m, v in packs[: 1 if same else 2]:
                    c = np.frombuffer(c, np.int64)
                    sides.append((c, np.frombuffer(m, np.int64), np.frombuffer(v, np.float64).reshape(len(c), -1)))
                c, m, v = (np.concatenate([s[i] for s in sides]) for i in range(3))
                u = v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
                walk = Walk(v, u, m, cosine)
                n = len(sides[0][0])
                first = grow(u, np.arange(n), 0)
                walk.walk(first, first if same else grow(u, np.arange(n, len(c)), n), same)
                some = np.flatnonzero(walk.links)
                root = _roots(len(c), walk.edges)[some]
                yield pa.RecordBatch.from_arrays([pa.array(c[some]), pa.array(walk.links[some]), pa.array(c[root])], ["c", "links", "root"])

    return run


def _told_apart(rows: DataFrame) -> DataFrame:
    """Different vectors whose first hashes agree get others, made with the second, until none do."""
    turn = 0
    while True:
        shared = rows.where("c is not null").groupBy("c").agg(F.min("d").alias("x"), F.max("d").alias("y")).where("x <> y")
        shared = C.staged(shared.select("c", F.lit(True).alias("shared")), "shared")
        if not shared.take(1):
            return rows
        new = F.when(F.col("shared"), F.xxhash64("c", "d", F.lit(turn))).otherwise(F.col("c"))
        rows = C.staged(rows.join(small(shared), "c", "left").withColumn("c", new).drop("shared"), "vectors")
        turn += 1


def link(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, a row per vector."""
    spark = vectors.sparkSession
    x = F.col("embedding")
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"),
        F.transform(x, lambda e: e.cast("double")).alias("v"))
    some = F.col("label").isNotNull() & usable(F.col("v")) & F.exists("v", lambda e: e != 0)
    # Two hashes tell vectors (with labels) apart.
    names = [F.when(some, F.xxhash64(F.lit(i), "label", "v")).alias(x) for i, x in enumerate("cd")]
    rows = _told_apart(rows.select("vec_id", "label", "v", *names))
    classes = C.staged(rows.where("c is not null").groupBy("c").agg(
        F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("m"), F.min("vec_id").alias("least")), "vector-classes")
    # Labels (with lengths) in blocks; a large label has many.
    sized = classes.withColumn("grp", F.xxhash64("label", F.size("v")))
    keyed = _parted(sized, block).join(sized.select("c", "m", "v"), "c")
    parts = C.partitions(spark)
    packs = C.staged(keyed.select("grp", "block", "c", "m", "v").repartition(parts, "grp", "block").sortWithinPartitions(
        "grp", "block", "c").mapInArrow(_packed, "grp long, block long, c binary, m binary, v binary, centre binary, radius double"), "vector-blocks")
    pairs = C.staged(near_blocks(packs.select("grp", "block", "centre", "radius"), cosine), "block-pairs")
    left, right = (packs.select("grp", F.col("block").alias(x), *[F.col(y).alias(f"{y}{x}") for y in "cmv"]) for x in "ab")
    met = pairs.join(left, ["grp", "a"]).join(right, ["grp", "b"]).select(
        (F.col("a") == F.col("b")).alias("same"), "ca", "ma", "va", "cb", "mb", "vb")
    found = C.staged(met.repartition(parts).mapInArrow(_met(cosine), "c long, links long, root long"), "vector-links")
    roots = components(found.select(F.col("c").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("c").agg(F.sum("links").alias("links"))
    own = classes.join(counts, "c", "left").join(roots.withColumnRenamed("node", "c"), "c", "left").select(
        "c", "least", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "c").alias("root"))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = own.join(least, "root").select("c", "n_links", "component_id")
    return rows.select("vec_id", "c").join(labels, "c", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(C.load(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in embedding if x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {COSINE}
), reach AS (
  SELECT a AS vec_id, a AS root FROM links
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.vec_id
), comp AS (SELECT vec_id, min(root) AS root FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.root, e.vec_id) AS component_id,
  coalesce(c.root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN comp c USING (vec_id)
"""
