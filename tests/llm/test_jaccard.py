import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm.conftest import ALIKE, EDGE

from wattframe.llm import jaccard
from wattframe.llm.graph import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
UPPER = bytes(range(65, 91))


def shingles(text):
    ws = WORD.findall((text or "").encode().translate(bytes.maketrans(UPPER, UPPER.lower())))
    return {tuple(ws[i : i + 3]) for i in range(len(ws) - 2)} if len(ws) > 2 else {tuple(ws)} if ws else set()


def brute(pairs, percent=90):
    sets = [shingles(t) for _, t in pairs]
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(sets[i]), str(least.get(find(i)))) for i, (d, _) in enumerate(pairs))


def rows(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def made(seed, n=150):
    r = random.Random(seed)
    vocabulary = ["The", "of", "and", "to"] * 8 + ["w%d" % i for i in range(300)]
    line = "licensed under the common licence version two for everyone".split()
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.6:
            ws = r.choice(texts[-30:]).split()
            for _ in range(r.randrange(0, max(2, len(ws) // 40))):
                k = r.randrange(len(ws))
                ws[k : k + r.randrange(0, 2)] = [r.choice(vocabulary)]
        else:
            ws = r.choices(vocabulary, k=r.choice([1, 2, 3, 4, 12, 40, 90, 200, 400]))
            if r.random() < 0.5:
                ws += line
        texts.append(" ".join(ws))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(docs, seed):
    pairs = made(seed) + [(200 + i, t) for i, t in EDGE if i is not None] + [(300, "The OF and"), (301, "the of AND"), (302, "one two three")]
    assert rows(jaccard.join(docs(pairs).repartition(4))) == brute(pairs)


def spaced(seed, text):
    r = random.Random(seed)
    return "".join(w + r.choice([" ", " ", " ", "  ", "\r\n", "\n\n", "\t", "\n" + 30 * " "]) for w in text.split())


@pytest.mark.parametrize("seed", [3, 4])
def test_white_space_does_not_matter(docs, seed):
    pairs = [(i, spaced(i, t)) for i, t in made(seed)]
    assert rows(jaccard.join(docs(pairs).repartition(4))) == brute(pairs)


def test_order_of_shingles_ignores_white_space():
    words = ["word%d" % i for i in range(40)]
    texts = [" ".join(words), "  ".join(words), "\r\n".join(words), ("\n" + 30 * " ").join(words), spaced(1, " ".join(words))]
    data = "".join(texts).encode()
    off = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    h, length, cut = jaccard._shingles(np.frombuffer(data, np.uint8), off, 3)
    for a, b in zip(cut[:-1], cut[1:]):
        assert (h[a:b] == h[: cut[1]]).all() and (length[a:b] == length[: cut[1]]).all()


@pytest.mark.parametrize("leaf", [4, 128])
def test_cells_find_what_bitmaps_allow(monkeypatch, leaf):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    r = np.random.default_rng(leaf)
    sets = []
    for _ in range(40):
        base = r.integers(0, 1 << 60, r.integers(20, 500)).astype(np.uint64)
        for _ in range(r.integers(1, 6)):
            own = base.copy()
            own[: r.integers(0, max(1, len(own) // 15))] = r.integers(0, 1 << 60)
            sets.append(np.unique(own))
    c = np.arange(len(sets))
    n = np.array([len(s) for s in sets])
    maps = [jaccard._bitmap(s) for s in sets]
    linked = {(i, j) for j in c for i in c[:j]
              if 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))}
    group = jaccard._cell_groups(n, c, np.full(len(c), 2), maps, 90)
    assert all(group[i] == group[j] >= 0 for i, j in linked)
    assert len(np.unique(group[group >= 0])) >= 25  # unrelated sets stay apart
    side = np.arange(len(c)) % 2
    group = jaccard._cell_groups(n, c, side, maps, 90)
    assert all(group[i] == group[j] >= 0 for i, j in linked if side[i] != side[j])
    # What is connected already needs no group.
    assert (jaccard._cell_groups(n, np.zeros(len(c), np.int64), np.full(len(c), 2), maps, 90) == -1).all()


def test_cells_of_neighbouring_sizes(monkeypatch):
    """A chain of sets of 29 and 28 in turn, 27 in common with the next of 30: links of distance 3."""
    monkeypatch.setattr(jaccard, "LEAF", 4)
    own, new, sets = list(range(29)), list(range(29, 64)), []
    for step in range(19):
        sets.append(np.array(sorted(own), np.uint64))
        gone, come = (2, 1) if step % 2 == 0 else (1, 2)
        own, new = own[gone:] + new[:come], new[come:]
    c = np.arange(len(sets))
    n = np.array([len(s) for s in sets])
    assert set(n) == {28, 29}
    group = jaccard._cell_groups(n, c, np.full(len(c), 2), [jaccard._bitmap(s) for s in sets], 90)
    assert len(set(group.tolist())) == 1 and group[0] >= 0


def batch_of(sets, comp, names=("w", "i", "j")):
    bits = [jaccard._bitmap(x) for x in sets]
    n = pa.array([len(x) for x in sets])
    keys = [pa.array(np.zeros(len(sets), np.int64)) for _ in names]
    return (pa.RecordBatch.from_arrays([*keys, pa.array(np.arange(len(sets))), n, pa.array(comp), pa.array(np.full(len(sets), 2)),
                                        pa.array(bits, pa.binary())], [*names, "c", "n", "comp", "side", "bits"]),
            pa.RecordBatch.from_arrays([*keys, pa.array(np.arange(len(sets))), pa.array(comp),
                                        pa.array([x.tobytes() for x in sets], pa.binary())], [*names, "c", "comp", "items"]))


@pytest.mark.parametrize("members", [250, 2000])
def test_rows_of_a_cell_grow_with_its_members(members):
    """Near copies that are not connected yet: as many rows as members, fewer links, and all connected."""
    r = np.random.default_rng(members)
    base = r.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = []
    for _ in range(members):
        own = base.copy()
        own[r.integers(0, 300, 6)] = r.integers(0, 1 << 60, 6)
        sets.append(np.unique(own))
    maps, items = batch_of(sets, np.arange(members))
    assert sum(x.num_rows for x in jaccard._cells(90)([maps])) == members
    links = [(a, b) for x in jaccard._joined(90)([items]) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist())]
    assert len(links) == members - 1
    at = list(range(members))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        both = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both)
        at[find(a)] = find(b)
    assert len({find(x) for x in range(members)}) == 1


@pytest.mark.parametrize("block,cell", [(3, 1 << 24), (8, 4000), (40, 20000)])
def test_large_regions_are_split_without_loss(docs, monkeypatch, block, cell):
    """Small blocks send every region through rings, pivots and blocks."""
    for name, value in {"BLOCK": block, "CELL_BYTES": cell, "ROUNDS": 1, "PIVOTS": 4, "SHARE": 10}.items():
        monkeypatch.setattr(jaccard, name, value)
    line = " ".join(f"common{i}" for i in range(40))
    pairs = [(i, f"{line} {t}" if i % 2 else t) for i, t in made(11, 120)]
    assert rows(jaccard.join(docs(pairs).repartition(4))) == brute(pairs)


@pytest.mark.parametrize("cut", [1, 2, 3, 7, 1000])
@pytest.mark.parametrize("seed", range(6))
def test_crowded_regions_pass_in_any_batches(cut, seed):
    r = random.Random(seed)
    size = {c: r.choice([10, 11, 12, 50, 52, 60, 99, 110]) for c in range(40)}
    rows_ = sorted((w, size[c], c) for w, c in ((r.randrange(25), r.randrange(40)) for _ in range(120)))
    rows_ += [(40, 10, 1)] * 3 + [(41, 10, 0), (42, 10, 1), (42, 11, 2), (43, 10, 1), (43, 12, 2)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows_[a : a + cut])], ["w", "n", "c"]) for a in range(0, len(rows_), cut)]
    got = [(w, c) for b in jaccard._crowded(90)(batches) for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    want = {(w, c) for w, n, c in rows_ for v, m, e in rows_ if v == w and e != c and 100 * min(n, m) >= 90 * max(n, m)}
    assert len(got) == len(set(got)) and set(got) == want


def test_pivots_split_clusters(spark):
    """Clusters far from each other end in parts of their own: far fewer meetings than all with all."""
    r = np.random.default_rng(8)
    members = []
    for k in range(12):
        base = r.integers(0, 1 << 60, 300).astype(np.uint64)
        for i in range(200):
            own = base.copy()
            own[r.integers(0, 300, 5)] = r.integers(0, 1 << 60, 5)
            own = np.unique(own)
            members.append((7, 1000 * k + i, len(own), 1000 * k + i, bytearray(jaccard._bitmap(own))))
    df = spark.createDataFrame(members, "w long, c long, n long, comp long, bits binary")
    got = jaccard._divided(df, 90).groupBy("w").count().collect()
    assert sum(x["count"] ** 2 for x in got) < len(members) ** 2 / 4
    assert sum(x["count"] for x in got) >= len(members)


def test_equal_fingerprints_are_told_apart(spark):
    rows_ = [(i, 0, 5 if i < 4 else 6, i % 4, 3) for i in range(8)] + [(9, 0, 0, 0, 0)]
    sets = spark.createDataFrame(rows_, "k1 long, k2 long, c long, d long, n long")
    told, renamed = jaccard._told_apart(sets)
    got = {(r.c, r.d) for r in told.where("n > 0").collect()}
    assert len({c for c, _ in got}) == 8
    assert {(r.c, r.d) for r in renamed(sets.where("n > 0").select("c", "d")).collect()} == got


def test_long_words_that_a_polynomial_takes_for_one(docs):
    x, y = ALIKE
    rest = " ".join(f"w{i}" for i in range(18))
    pairs = [(1, f"{x} {rest}"), (2, f"{y} {rest}"), (3, f"{x} {rest}"), (4, f"{x} {y}"), (5, "w " * 100_000)]
    assert rows(jaccard.join(docs(pairs))) == brute(pairs)


def test_hot_class_and_empty_texts(docs):
    pairs = made(5, 30) + [(1000 + i, "the same text in very many places") for i in range(300)] + [(2000 + i, " ") for i in range(300)]
    assert rows(jaccard.join(docs(pairs).repartition(6))) == brute(pairs)


def test_clashing_columns(docs):
    df = docs(EDGE).selectExpr("*", "1 AS c", "2 AS w", "'x' AS items", "3 AS k1", "4 AS n", "'g' AS `group`")
    assert rows(jaccard.join(df)) == brute(EDGE)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns and kept.where("k1 = 3 AND items = 'x'").count() == kept.count()


@pytest.mark.parametrize("percent", [50, 80, 90, 99])
def test_radius_covers_every_pair_of_sizes(percent):
    for most in range(1, 200):
        n = np.arange(1, most + 1)
        cell = jaccard.Cell(np.zeros((1, 1), np.uint64), np.array([most]), n[:1], n[:1], n[:1] > 0, percent)
        assert cell.radius >= jaccard._allowed(n[:, None], n[None, :], percent).max()


def test_edges(docs):
    assert rows(jaccard.join(docs(EDGE))) == brute(EDGE)
    assert jaccard.join(docs([])).count() == 0


def test_components(spark):
    r = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(50)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in got} and set(got) == {x for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
