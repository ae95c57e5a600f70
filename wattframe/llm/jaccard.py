"""Exact self-join of documents by the Jaccard similarity of their word shingles.

A document is the set of its distinct ``SHINGLE``-word shingles (64-bit keys); equal sets are one
class, told apart by two fingerprints. Classes link when 100 * intersection >= ``percent`` * union, that
is within radius r = 1 - percent / 100 of the Jaccard metric. The join works in regions:

1. Regions. The pivots of the first level are single shingles. Shingles have one global order:
   those that partitions see often come last, long ones (mostly rare) first, then by hash. A class
   lies in the region of its first shingle, and since a partner within r misses at most
   n - ceil(percent * n / 100) of its n shingles, it is replicated into the regions of that many
   more: two linked classes share a region. A class with no other of a fitting size in a region leaves it. (Documents as first pivots would not separate texts: nearly
   all lie at distances of 0.97 to 1 from any pivot, far closer together than 2 r.)
2. Pivots in a region. In each round every region compares its members with one member, its pivot,
   exactly. Members within r join its component, so a group of copies costs one pair each and not all
   pairs. A region whose members are all connected is done, and of regions with the same members one stays.
3. Recursion. Distances are now Hamming distances of parity bitmaps (each set's shingles hashed into
   2 n bits or more, one bit flipped by each): a metric that never exceeds the symmetric difference. A
   region of over ``BLOCK`` members is split on Spark, first into rings around the empty set, whose
   distance is a set's size, then by documents as pivots: a member goes to its nearest pivot's Voronoi
   region and, as a guest, to those of the pivots that are no more than twice the radius farther; one more
   place, equally far from all, takes those that are near no pivot. Parts whose members are all connected
   go; the rest is split again. A split that does not halve the work (a region of unrelated texts lies
   equally far from every pivot) is not taken, and such a region is joined block against block. Within a cell the same is done by halves, down to cells whose bitmaps are all compared.
4. Members of a cell that bitmaps allow to link, though not connected yet, form its groups. The same
   group often comes out of many regions and counts once. Its sets meet, cut by bytes, and are compared
   exactly, a member against all that are not connected with it yet: a cell returns fewer links than it
   has members.

Components only need connectivity, so no group is expanded into its pairs. Sets are recomputed from the
texts of the classes that have a candidate; only shingles, bitmaps and class ids are shuffled for all.

Defined cases: fewer words than a shingle make one shingle of the whole sequence; null, empty or blank
texts have none, link with nothing and are their own component; equal sets always link; repeated rows
share their class; a null id takes no part in the smallest id of its component (null if alone).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from wattframe.llm import common as C
from wattframe.llm.graph import components
from wattframe.session import small

SHINGLE = 3
PERCENT = 90
ROUNDS = 2
#: Larger regions are split; what cannot be split meets in cells of about twice so many.
BLOCK = 1_000
LEVELS, PIVOTS = 3, 16
#: Members whose distances to a region's pivots one task takes.
SHARE = 4_000
LEAF = 128
#: Bytes of sets that meet in one cell, about twice.
CELL_BYTES = 1 << 24
#: Shingles seen so often among so many of a partition come last in the order. Bounds the table that is
#: broadcast; which ones are in it decides about time, never about results.
OFTEN, AMONG, MOST_OFTEN = 16, 1 << 22, 1 << 20


# --- sets --------------------------------------------------------------------------------------


def _shingles(data: np.ndarray, off: np.ndarray, width: int):
    """Hash and length in bytes (of its words alone, as the hash) of every shingle, and each document's
    shingle offsets."""
    data = C.LOWER[data]
    starts, ends, words = C.word_spans(data, off)
    keys = C.word_keys(data, starts, ends)
    n = np.diff(words)
    many = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    cut = np.append(0, np.cumsum(many))
    doc = np.repeat(np.arange(len(n)), many)
    first = np.arange(cut[-1]) - cut[doc] + words[doc]
    last = np.minimum(first + width, words[doc + 1])
    length = last - first
    h = np.zeros(len(first), np.uint64)
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        h[at] = C.mix(C.window_keys(keys, int(n))[first[at]] + np.uint64(n))
    size = np.append(0, np.cumsum(ends - starts))
    return h, size[last] - size[first], cut


def needed(n: int | np.ndarray, percent: int):
    """Least intersection with a set of n that any partner has."""
    return -(-percent * n // 100)


def _bitmap(h: np.ndarray) -> bytes:
    bits = 64
    while bits < 2 * len(h):
        bits *= 2
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


_SECOND = np.uint64(0x8CB92BA72F3D8DD7)


def _class(h: np.ndarray) -> tuple[int, int]:
    """Two fingerprints of a set given as sorted distinct keys."""
    if not len(h):
        return 0, 0
    both = [C.mix(np.sum(C.mix(x), dtype=np.uint64, keepdims=True) + np.uint64(len(h))) for x in (h.copy(), h * _SECOND)]
    return tuple(int(x.view(np.int64)[0]) for x in both)


_SETS = "k1 long, k2 long, c long, d long, n long, bits binary, w long, times long"


def _described(width: int):
    """Class, size and bitmap of each document, the last once a class and task; besides, as rows of their own,
    the shingles ``w`` that a part of the texts holds often, and how often."""
    none = {f.name: f.type for f in pa.schema([(x, pa.int64()) for x in ("k1", "k2", "c", "d", "n", "w", "times")] + [("bits", pa.binary())])}

    def batch(size: int, **columns) -> pa.RecordBatch:
        names = [c.split()[0] for c in _SETS.split(", ")]
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, none[c]) for c in names], names)

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        h, times = np.unique(np.concatenate(held), return_counts=True)
        h, times = h[times >= OFTEN], times[times >= OFTEN]
        return batch(len(h), w=pa.array(h.view(np.int64)), times=pa.array(times))

    def run(batches):
        seen: set[tuple[int, int]] = set()
        held, size = [], 0
        for rows, data, off in C.chunked(batches):
            h, _, cut = _shingles(data, off, width)
            held.append(h)
            size += len(h)
            c, d, n, bits = [], [], [], []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                own = np.unique(h[a:b])
                name = _class(own)
                c.append(name[0]), d.append(name[1])
                n.append(len(own))
                bits.append(_bitmap(own) if len(own) and name not in seen else None)
                seen.add(name)
            k1, k2 = (rows.column(rows.schema.get_field_index(x)) for x in ("k1", "k2"))
            yield batch(len(c), k1=k1, k2=k2, bits=pa.array(bits, pa.binary()),
                        **{x: pa.array(y, pa.int64()) for x, y in (("c", c), ("d", d), ("n", n))})
            if size >= AMONG:
                yield often(held)
                held, size = [], 0
        if held:
            yield often(held)

    return run


def _regions(often, width: int, percent: int):
    """``w, n, c, d``: the region shingles of each document and the size of its set, once a class and task."""

    def run(batches):
        known = often.value
        seen: set[tuple[int, int]] = set()
        for _, data, off in C.chunked(batches):
            h, length, cut = _shingles(data, off, width)
            hot = np.zeros(len(h), bool)
            if len(known):
                hot = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
            key = (hot.astype(np.uint64) << np.uint64(63)) | (
                np.uint64(255) - np.minimum(length, 255).astype(np.uint64)) << np.uint64(55) | (h >> np.uint64(9))
            names, sizes, prefix = [], [], [np.zeros(0, np.uint64)]
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                own, at = np.unique(h[a:b], return_index=True)
                name = _class(own)
                if not len(own) or name in seen:
                    continue
                seen.add(name)
                most = len(own) - int(needed(len(own), percent)) + 1
                names.append(name)
                sizes.append(len(own))
                prefix.append(own[np.argsort(key[a:b][at], kind="stable")[:most]])
            c, d = np.array(names, np.int64).reshape(-1, 2).T
            size = [len(x) for x in prefix[1:]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (np.concatenate(prefix).view(np.int64), *(np.repeat(np.array(y, np.int64), size) for y in (sizes, c, d)))],
                ["w", "n", "c", "d"])

    return run


def _crowded(percent: int):
    """Of rows ``w, n, c`` in order, each once, those whose region holds another class of a size that allows a link.

    In order of size the nearest ones stand next to each other. Rows pass through: one that has no partner
    before it waits for the next one, nothing else is held.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        wait, seen = None, None  # the row that waits, or the last row if that has a partner already
        for batch in batches:
            rows = np.stack([x.to_numpy() for x in batch.columns])
            if not rows.shape[1]:
                continue
            last = wait if wait is not None else seen
            if last is not None:
                rows = np.concatenate([last[:, None], rows], axis=1)
            new = np.append(True, (rows[:, 1:] != rows[:, :-1]).any(axis=0))
            w, n, c = rows = rows[:, new]
            near = (w[1:] == w[:-1]) & (100 * n[:-1] >= percent * n[1:])
            keep = np.append(False, near) | np.append(near, False)
            told = seen is not None  # the first row has been passed on
            end = bool(keep[-1]) or (told and len(w) == 1)
            wait, seen = (None, rows[:, -1]) if end else (rows[:, -1], None)
            if told:
                keep[0] = False
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(w[keep]), pa.array(c[keep])], ["w", "c"])

    return run


def _sets_of(width: int):
    def run(batches):
        for rows, data, off in C.chunked(batches):
            h, _, cut = _shingles(data, off, width)
            sets = [np.unique(h[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("c")), pa.array(sets, pa.binary())], ["c", "items"])

    return run


# --- distances ---------------------------------------------------------------------------------


def _exact(percent: int):
    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            keep = []
            for s, t in zip(x, y):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                both = np.concatenate([s, t])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _allowed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Largest symmetric difference of two linked sets of these sizes; negative if sizes forbid it."""
    common = -(-percent * (n + m) // (100 + percent))
    return np.where(common > np.minimum(n, m), -1, n + m - 2 * common)


def _folded(bits: bytes, width: int) -> np.ndarray:
    """Bitmap of ``width`` bits; of a wider one the parts fall on each other."""
    words = np.frombuffer(bits, np.uint8).reshape(-1, width // 8)
    return np.bitwise_xor.reduce(words, axis=0).view(np.uint64) if width >= 64 else words[0]


def _small(percent: int):
    """Pairs whose sizes and bitmaps allow a link."""

    def run(batches):
        for batch in batches:
            a, b, n, m, x, y = (batch.column(i) for i in range(6))
            most = _allowed(n.to_numpy(), m.to_numpy(), percent)
            keep = most >= 0
            for i in np.flatnonzero(keep):
                s, t = x[i].as_py(), y[i].as_py()
                width = 8 * min(len(s), len(t))
                keep[i] = np.bitwise_count(_folded(s, width) ^ _folded(t, width)).sum() <= most[i]
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep))

    return run


class Cell:
    """Members of one cell at one bitmap width, joined by pivots, Voronoi regions and windows."""

    def __init__(self, maps: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, exact: np.ndarray, percent: int):
        self.maps, self.n, self.comp, self.side, self.exact, self.percent = maps, n, comp, side, exact, percent
        # What is allowed goes up and down by one with the sum of the sizes, so an odd sum may allow more.
        self.radius = int(np.maximum(_allowed(n, n, percent), _allowed(n, n - 1, percent)).max())
        self.out: list[tuple[np.ndarray, np.ndarray]] = []

    def to(self, z: np.ndarray, pivot: int) -> np.ndarray:
        return np.bitwise_count(self.maps[z] ^ self.maps[pivot]).sum(axis=1).astype(np.int64)

    def compare(self, u: np.ndarray, v: np.ndarray) -> None:
        """All bitmaps of u with those of v."""
        for at in range(0, len(u), 64):
            x = u[at : at + 64]
            far = np.bitwise_count(self.maps[x][:, None, :] ^ self.maps[v][None, :, :]).sum(axis=2)
            hit = (far <= _allowed(self.n[x][:, None], self.n[v][None, :], self.percent)) & (
                self.comp[x][:, None] != self.comp[v][None, :])
            # Within one list every pair comes up twice; across a cell's sides only mixed pairs count,
            # and pairs of two wider members belong to the wider width.
            hit &= (self.side[x][:, None] != self.side[v][None, :]) | (self.side[x][:, None] == 2)
            hit &= self.exact[x][:, None] | self.exact[v][None, :]
            i, j = np.nonzero(hit)
            self.out.append((x[i], v[j]))

    def split(self, z: np.ndarray):
        """Distances to two far members, or None if the windows leave too little out."""
        first = z[0]
        p = z[np.argmax(self.to(z, first))]
        q = z[np.argmax(self.to(z, p))]
        return p, q

    def join(self, z: np.ndarray) -> None:
        if len(z) <= LEAF:
            return self.compare(z, z)
        p, q = self.split(z)
        nearer = self.to(z, p) - self.to(z, q)
        left, right = z[nearer <= 0], z[nearer > 0]
        border_l, border_r = left[nearer[nearer <= 0] >= -2 * self.radius], right[nearer[nearer > 0] <= 2 * self.radius]
        if max(len(left), len(right)) > 0.95 * len(z) or len(border_l) * len(border_r) > 0.2 * len(z) ** 2:
            return self.compare(z, z)
        self.join(left)
        self.join(right)
        self.across(border_l, border_r)

    def across(self, u: np.ndarray, v: np.ndarray) -> None:
        if len(u) * len(v) <= LEAF * LEAF:
            if len(u) and len(v):
                self.compare(u, v)
            return
        p, q = self.split(np.concatenate([u, v]))
        parts = []
        for z in (u, v):
            nearer = self.to(z, p) - self.to(z, q)
            parts.append((z[nearer <= 0], z[nearer > 0], z[(nearer <= 0) & (nearer >= -2 * self.radius)],
                          z[(nearer > 0) & (nearer <= 2 * self.radius)]))
        (ul, ur, ubl, ubr), (vl, vr, vbl, vbr) = parts
        work = len(ul) * len(vl) + len(ur) * len(vr) + len(ubl) * len(vbr) + len(ubr) * len(vbl)
        if work > 0.8 * len(u) * len(v):
            return self.compare(u, v)
        for x, y in ((ul, vl), (ur, vr), (ubl, vbr), (ubr, vbl)):
            self.across(x, y)


def _cell_groups(n, comp, side, bits, percent) -> np.ndarray:
    """The group of each member (a member's place), -1 if sizes and bitmaps allow it no link to another component."""
    widths = np.array([8 * len(b) for b in bits])
    group, found = np.arange(len(n)), []
    for width in np.unique(widths):
        # A partner is at most a ninth larger, so its bitmap is as wide or twice as wide.
        z = np.flatnonzero((widths >= width) & (widths <= 4 * width))
        if len(z) < 2 or len(np.unique(comp[z])) < 2:
            continue
        maps = np.stack([_folded(bits[i], int(width)) for i in z])
        cell = Cell(maps, n[z], comp[z], side[z], widths[z] == width, percent)
        cell.join(np.arange(len(z)))
        found += [(z[i], z[j]) for i, j in cell.out if len(i)]
    if not found:
        return np.full(len(n), -1)
    a, b = (np.concatenate(x) for x in zip(*found))
    while True:
        least = np.minimum(group[a], group[b])
        before = group.copy()
        np.minimum.at(group, a, least)
        np.minimum.at(group, b, least)
        group = group[group]
        if (group == before).all():
            break
    alone = np.ones(len(n), bool)
    alone[a] = alone[b] = False
    return np.where(alone, -1, group)


def _by_key(batches, keys: int) -> Iterator[pa.RecordBatch]:
    """Rows of each key (the first ``keys`` columns, sorted), together."""
    name, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(keys)], axis=1)
        at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
        for s, e in zip(at, np.append(at[1:], len(key))):
            now = tuple(key[s].tolist())
            if now != name and held:
                yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            name = now
            held.append(batch.slice(s, e - s))
    if held:
        yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _cells(percent: int):
    """Groups of each cell (rows sorted by w, i, j); sides: 0 and 1 of a mixed cell, 2 of a cell alone."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for own in _by_key(batches, 3):
            if own.num_rows < 2:
                continue
            c, n, comp, side = (own.column(i).to_numpy() for i in (3, 4, 5, 6))
            group = _cell_groups(n, comp, side, own.column(7).to_pylist(), percent)
            at = np.flatnonzero(group >= 0)
            if not len(at):
                continue
            at = at[np.argsort(group[at], kind="stable")]
            head = np.flatnonzero(np.append(True, group[at][1:] != group[at][:-1]))
            # The same members have the same name wherever they meet; groups that shared one would be one group.
            names = C.mix(np.add.reduceat(C.mix(c[at].astype(np.uint64)), head))
            names = np.repeat(names, np.diff(np.append(head, len(at)))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(x[at]) for x in (c, comp, n))], ["g", "c", "comp", "n"])

    return run


def _joined(percent: int):
    """Links between members of different components of each cell (g, i, j), fewer than its members."""

    def links(c, comp, sets) -> list[tuple[int, int]]:
        _, comp = np.unique(comp, return_inverse=True)
        size = np.array([len(x) for x in sets])
        order = np.argsort(size, kind="stable")
        c, comp, size, sets = c[order], comp[order], size[order], [sets[i] for i in order]
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.append(0, np.cumsum(size))
        own, out = np.zeros(len(names), bool), []
        for i in range(len(c) - 1):
            # Sets are in order of size, so partners lie between i and the last that is not too large.
            last = int(np.searchsorted(size, 100 * size[i] // percent, "right"))
            z = i + 1 + np.flatnonzero(comp[i + 1 : last] != comp[i])
            if not len(z):
                continue
            own[flat[at[i] : at[i + 1]]] = True
            hit = own[C.stretches(flat, at[z], size[z])]
            own[flat[at[i] : at[i + 1]]] = False
            common = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[z]) - size[z])
            for j in z[100 * common >= percent * (size[i] + size[z] - common)]:
                if comp[j] != comp[i]:
                    out.append((int(min(c[i], c[j])), int(max(c[i], c[j]))))
                    comp[comp == comp[j]] = comp[i]
        return out

    def run(batches) -> Iterator[pa.RecordBatch]:
        for own in _by_key(batches, 3):
            c, comp = (own.column(i).to_numpy() for i in (3, 4))
            if own.num_rows < 2 or (comp == comp[0]).all():
                continue
            got = links(c, comp, [np.frombuffer(x.as_buffer(), np.uint64) for x in own.column(5)])
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*got)], ["a", "b"])

    return run


# --- the join ----------------------------------------------------------------------------------


def _items(rows: DataFrame, reps: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """``c, items``: the whole sets of some classes, from the text of one document of each."""
    one = small(C.staged(reps.select("c", "k1", "k2").join(classes.distinct(), "c", "left_semi"), "one"))
    # Repeated rows have equal texts, so any of them serves.
    texts = rows.select("k1", "k2", "text").join(one, ["k1", "k2"]).dropDuplicates(["c"])
    return C.staged(texts.mapInArrow(_sets_of(width), "c long, items binary"), "sets")


def _verified(rows: DataFrame, reps: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, compared on the whole sets of their classes."""
    items = _items(rows, reps, pairs.select(F.explode(F.array("a", "b")).alias("c")), width)
    left, right = (items.select(F.col("c").alias(x), F.col("items").alias(f"{x}_items")) for x in "ab")
    return C.staged(pairs.join(left, "a").join(right, "b").select("a", "b", "a_items", "b_items").mapInArrow(
        _exact(percent), "a long, b long"), "jaccard-links")


def _with_bits(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    left, right = (reps.select(F.col("c").alias(x), F.col("n").alias(f"{x}n"), F.col("bits").alias(f"{x}_bits")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").where(f"100 * least(an, bn) >= {percent} * greatest(an, bn)")
    return both.select("a", "b", "an", "bn", "a_bits", "b_bits").mapInArrow(_small(percent), "a long, b long")


def _told_apart(sets: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Different sets whose first fingerprints agree get others, made with the second, until none do; also the
    same change for other rows with ``c, d``."""
    turns: list[DataFrame] = []

    def new(rows: DataFrame, turn: int) -> DataFrame:
        name = F.when(F.col("shared"), F.xxhash64("c", "d", F.lit(turn))).otherwise(F.col("c"))
        return rows.join(small(turns[turn]), "c", "left").withColumn("c", name).drop("shared")

    def renamed(rows: DataFrame) -> DataFrame:
        for turn in range(len(turns)):
            rows = new(rows, turn)
        return rows

    while True:
        shared = sets.where("n > 0").groupBy("c").agg(F.min("d").alias("x"), F.max("d").alias("y")).where("x <> y")
        shared = C.staged(shared.select("c", F.lit(True).alias("shared")), "shared")
        if not shared.take(1):
            return sets, renamed
        turns.append(shared)
        sets = C.staged(new(sets, len(turns) - 1), "shingles")


def _unequal(parts: DataFrame) -> DataFrame:
    """``w, m, narrow, n_max``: members, least bytes of a bitmap and largest set of the regions that are not
    connected yet; those of guests alone are left out, as guests meet each other where they live."""
    return parts.groupBy("w").agg(
        F.count("*").alias("m"), F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("home").alias("lived"),
        F.min(F.octet_length("bits")).alias("narrow"), F.max("n").alias("n_max")
    ).where("x <> y AND lived").select("w", "m", "narrow", "n_max")


def _rings(parts: DataFrame, percent: int) -> DataFrame:
    """Regions cut by size: linked sets lie in one ring or in neighbouring ones, and each visits the next."""
    wide = float(np.log(100 / percent) * 1.0001)
    ring = F.floor(F.log(F.col("n").cast("double")) / F.lit(wide))
    both = parts.withColumn("next", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("w", F.xxhash64("w", ring + F.col("next")))
    return both.withColumn("home", F.col("home") & (F.col("next") == 0)).drop("next")


def _radius(n: np.ndarray, percent: int) -> np.ndarray:
    """What a set of n may differ from any partner by, or a little more."""
    return np.maximum(_allowed(n, 100 * n // percent, percent), 0) + 2


_TARGETS = pa.schema([("w", pa.int64()), ("c", pa.int64()), ("p", pa.int32()), ("at_home", pa.bool_())])


def _targets(percent: int):
    """Of the members of a region (or a share of them): the pivots whose regions they live in or visit.

    Besides the pivots there is a place at one distance from all members, a little beyond the reach of a
    pivot's near copies: members far from every pivot live there alone and not with all pivots.
    """

    def run(members: pa.Table, pivots: pa.Table) -> pa.Table:
        if not members.num_rows or not pivots.num_rows:
            return _TARGETS.empty_table()
        width = 8 * members.column("narrow")[0].as_py()
        x, p = (np.stack([_folded(b, width) for b in t.column("bits").to_pylist()]) for t in (members, pivots.sort_by("o")))
        beyond = 3 * _radius(members.column("n_max").to_numpy(), percent)
        far = np.stack([*(np.bitwise_count(x ^ q).sum(axis=1).astype(np.int64) for q in p), beyond], axis=1)
        visits = far - far.min(axis=1, keepdims=True) <= 2 * _radius(members.column("n").to_numpy(), percent)[:, None]
        at, to = np.nonzero(visits)
        return pa.table([members.column("w").take(at), members.column("c").take(at), pa.array(to.astype(np.int32)),
                         pa.array(far.argmin(axis=1)[at] == to)], schema=_TARGETS)

    return run


def _by_pivots(parts: DataFrame, sizes: DataFrame, level: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Large regions split by members as pivots, and those where the windows are too wide for that."""
    big = parts.join(small(sizes), "w")
    shares = F.ceil(F.col("m") / SHARE).cast("int")
    order = W.partitionBy("w").orderBy("o", "c")
    pivots = big.select("w", "m", "c", "bits", F.xxhash64("c", F.lit(level)).alias("o"))
    pivots = C.staged(pivots.withColumn("r", F.row_number().over(order)).where(F.col("r") <= PIVOTS).select(
        "w", "bits", F.col("r").alias("o"), F.explode(F.sequence(F.lit(0), shares - 1)).alias("share")), "pivots")
    members = big.select("w", F.pmod(F.xxhash64("c"), shares).cast("int").alias("share"), "c", "n", "bits", "narrow", "n_max")
    to = C.staged(members.groupBy("w", "share").cogroup(pivots.groupBy("w", "share")).applyInArrow(
        _targets(percent), "w long, c long, p int, at_home boolean"), "targets")
    # Worth it if the parts need less than half the comparisons of the whole.
    gain = to.groupBy("w", "p").count().groupBy("w").agg(F.sum(F.col("count").cast("double") ** 2).alias("work")).join(
        sizes, "w").select("w", (F.col("work") < F.col("m").cast("double") ** 2 / 2).alias("worth"))
    gain = small(C.staged(gain, "gain"))
    split = to.join(gain.where("worth"), "w", "left_semi").join(parts, ["w", "c"]).withColumn(
        "w", F.xxhash64("w", "p", F.lit(level))).withColumn("home", F.col("home") & F.col("at_home")).select(*parts.columns)
    return split, parts.join(gain.where("NOT worth"), "w", "left_semi")


def _divided(parts: DataFrame, percent: int) -> DataFrame:
    """``w, m, c, n, comp, bits``: the open regions, large ones split by rings and pivots where that helps."""
    columns = ["w", "m", "c", "n", "comp", "bits"]
    parts, done, level = parts.withColumn("home", F.lit(True)), [], 0
    while True:
        sizes = C.staged(_unequal(parts), "sizes")
        open_ = parts.join(sizes, "w")
        large = sizes.where(F.col("m") > BLOCK)
        if level > LEVELS or not large.take(1):
            return reduce(DataFrame.unionByName, [*done, open_.select(columns)])
        done.append(open_.where(F.col("m") <= BLOCK).select(columns))
        over = parts.join(small(large.select("w")), "w", "left_semi")
        if level == 0:
            parts = C.staged(_rings(over, percent), "rings")
        else:
            split, whole = _by_pivots(over, large, level, percent)
            parts = C.staged(split, "voronoi")
            done.append(whole.join(small(large.select("w", "m")), "w").select(columns))
        level += 1


def _in_blocks(parts: DataFrame, blocks: Column, name: str, *rest: str) -> DataFrame:
    """Members of ``name`` in cells i <= j of two blocks each; ``side`` tells the blocks apart, 2 if they are one."""
    dealt = parts.withColumn("block", F.pmod(F.xxhash64("c"), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side")
    cells = dealt.select(name, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                         *[side if c == "side" else F.col(c) for c in rest])
    return cells.repartition(C.partitions(parts.sparkSession), name, "i", "j").sortWithinPartitions(name, "i", "j")


def join(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, k1, k2, n_shingles, class_id, component_id, group``, a row per document.

    ``group`` names the component by a class, also where ids are null; null for empty sets.
    """
    spark = docs.sparkSession
    rows = C.rows_of(docs)
    told = C.staged(rows.select("k1", "k2", "text").mapInArrow(_described(width), _SETS), "shingles")
    often = told.where("w is not null").groupBy("w").agg(F.sum("times").alias("times"))
    table = often.orderBy(F.desc("times"), "w").limit(MOST_OFTEN).select("w").toArrow().column(0).to_numpy()
    table = spark.sparkContext.broadcast(np.sort(table.view(np.uint64)))
    sets, renamed = _told_apart(told.where("w is null").drop("w", "times"))
    reps = C.staged(sets.where("bits is not null").groupBy("c").agg(
        F.first(F.struct("n", "bits", "k1", "k2")).alias("r")).select("c", "r.*"), "classes")
    regions = renamed(rows.select("text").mapInArrow(_regions(table, width, percent), "w long, n long, c long, d long"))
    members = C.staged(regions.select("w", "n", "c").repartition(C.partitions(spark), "w").sortWithinPartitions("w", "n", "c").mapInArrow(
        _crowded(percent), "w long, c long"), "regions")

    links, comp = None, None
    for turn in range(ROUNDS):
        if comp is None:
            left = members.withColumn("comp", F.col("c"))
        else:
            left = _open(members, comp)
        # A region's pivot: its first member in an order of its own for each round.
        pivots = left.groupBy("w").agg(F.min(F.xxhash64("c", F.lit(turn))).alias("o"))
        heads = left.withColumn("o", F.xxhash64("c", F.lit(turn))).join(pivots, ["w", "o"]).select(
            "w", F.col("c").alias("p"), F.col("comp").alias("p_comp")).dropDuplicates(["w"])
        pairs = left.join(heads, "w").where("comp <> p_comp").select(
            F.least("c", "p").alias("a"), F.greatest("c", "p").alias("b")).distinct()
        pairs = C.staged(_with_bits(pairs, reps, percent), "pairs")
        found = _verified(rows, reps, pairs, width, percent)
        links = found if links is None else links.unionByName(found)
        comp = components(links)

    left = C.staged(_open(members, comp, 3).select("w", "c", "comp"), "left")
    names = left.groupBy("w").agg(*[F.bit_xor(F.xxhash64("c", F.lit(i))).alias(f"x{i}") for i in range(2)], F.count("*").alias("m"))
    once = names.groupBy("x0", "x1", "m").agg(F.min("w").alias("w")).select("w")
    parts = C.staged(left.join(once, "w", "left_semi").join(reps.select("c", "n", "bits"), "c"), "cells")
    parts = _divided(parts, percent)
    cells = _in_blocks(parts, F.ceil(F.col("m") / BLOCK).cast("int"), "w", "c", "n", "comp", "side", "bits")
    groups = C.staged(cells.mapInArrow(_cells(percent), "g long, c long, comp long, n long").distinct(), "groups")
    size = groups.groupBy("g").agg(F.sum(8 * F.col("n")).alias("bytes"))
    full = groups.join(size, "g").join(_items(rows, reps, groups.select("c"), width), "c")
    cells = _in_blocks(full, F.ceil(F.col("bytes") / CELL_BYTES).cast("int"), "g", "c", "comp", "items")
    comp = components(links.unionByName(C.staged(cells.mapInArrow(_joined(percent), "a long, b long"), "jaccard-links")))

    own = F.when(F.col("k1") > C.NO_ID, F.col("k1"))
    first = sets.where("n > 0").groupBy("c").agg(F.min(own).alias("class_id"), F.count("*").alias("docs"))
    root = C.staged(first.join(comp, first["c"] == comp["node"], "left").select(
        "c", "class_id", "docs", F.coalesce("root", "c").alias("group")), "roots")
    least = C.staged(root.groupBy("group").agg(F.min("class_id").alias("component_id"), F.count("*").alias("classes")), "components")
    labels = C.staged(C.looked_up(root, least, "group", "classes").drop("classes"), "labels")
    named = C.looked_up(sets.where("n > 0").select("c", "k1", "k2", "n"), labels, "c", "docs")
    blank = sets.where("n = 0").select("k1", "k2", "n", *[F.lit(None).cast("long").alias(x) for x in ("class_id", "component_id", "group")])
    return named.select(*blank.columns).unionByName(blank).select(
        own.alias("doc_id"), "k1", "k2", F.col("n").alias("n_shingles"),
        F.coalesce("class_id", own).alias("class_id"), F.coalesce("component_id", own).alias("component_id"), "group")


def one_of_each(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of linked documents, the one with the smallest id.

    Documents without words stay; of repeated rows one stays.
    """
    groups = join(docs, width, percent).where("n_shingles > 0")
    stay = groups.groupBy("group").agg(F.min(F.struct("k1", "k2")).alias("k")).select("k.k1", "k.k2")
    rows = docs.select(F.struct(*docs.columns).alias("row"), *C.row_key())
    blank = ~F.coalesce(F.col("row.text").rlike(C.WORD), F.lit(False))
    kept = rows.where(~blank).join(stay, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return kept.select("row.*").unionAll(rows.where(blank).select("row.*"))


def _open(members: DataFrame, comp: DataFrame, least: int = 2) -> DataFrame:
    """Members of regions of ``least`` members or more that are not connected yet, with their components."""
    known = members.join(comp.withColumnRenamed("node", "c"), "c", "left").select(
        "c", "w", F.coalesce("root", "c").alias("comp"))
    known = C.staged(known, "open")
    apart = known.groupBy("w").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m"))
    return known.join(apart.where(f"x <> y AND m >= {least}").select("w"), "w", "left_semi")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(C.load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{C.WORD}') AS ws
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[s : s + {SHINGLE - 1}], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 2}, least(len(ws), 1) + 1))) AS s FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {PERCENT} * (x.n + y.n - i)
), pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a AS doc_id, a AS root FROM pairs
  UNION
  SELECT p.b, r.root FROM reach r JOIN pairs p ON p.a = r.doc_id
), comp AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.root, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp c USING (doc_id)
"""
