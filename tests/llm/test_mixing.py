from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from wattframe.llm import mixing


def seats_one_by_one(votes, seats, most):
    k = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if k[i] < most[i] and votes[i] > 0]
        if not open_:
            break
        i = max(open_, key=lambda i: (votes[i] / (2 * k[i] + 1), -i))
        k[i] += 1
    return k


@pytest.mark.parametrize("votes,seats", [([53, 24, 23], 7), ([1, 1, 1, 1], 6), ([0, 5, 100], 40), ([7], 9), ([0, 0], 3)])
def test_apportion_equals_one_by_one(votes, seats):
    votes = [Fraction(v) for v in votes]
    for most in ([10**6] * len(votes), [3] * len(votes)):
        for n in range(seats + 1):
            assert mixing.apportion(votes, n, most) == seats_one_by_one(votes, n, most)


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    # 600 words: the first stops at 30, the rest share 570 as 2 : 3.
    assert mixing.targets([10, 290, 300], [3, 2, 3]) == [30, 228, 342]
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [1, 2]) == [0, 0]


def sample(spark, n=400, seed=3):
    import random

    r = random.Random(seed)
    rows = [(i, " ".join("w" * r.randrange(1, 5) for _ in range(r.randrange(0, 60))),
             r.choices(["a", "b", "c", "é", None, "tiny"], [50, 20, 10, 10, 9, 1])[0]) for i in range(n)]
    rows += [(500, None, "a"), (501, "", "none"), (502, " \t", "none"), (None, "x y z", "a"), (7, "again and again", "b"), (7, "again and again", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_mix_follows_targets(spark):
    df, rows = sample(spark)
    got = mixing.mix(df.repartition(5), run=20).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        n = sum(p.n_words for p in r.pieces)
        assert n <= 3 * r.size
        assert all(0 <= p.first_word and p.first_word + p.n_words <= r.size for p in r.pieces)
        by.setdefault(r.source, []).append((r.size, n, r.source_size, r.target))
    words = sum(len(t.split()) for _, t, _ in rows if t)
    order = sorted((s for s in by if s is not None)) + [None]
    share = mixing.targets([sum(x[0] for x in by[s]) for s in order], [1, 2, 3] * 3)
    assert sum(sum(x[0] for x in v) for v in by.values()) == words
    for s, t in zip(order, share):
        assert {x[2] for x in by[s]} == {sum(x[0] for x in by[s])}
        assert {x[3] for x in by[s]} == {float(t)}
        assert abs(sum(x[1] for x in by[s]) - t) <= 2 * mixing.BLOCK
    # Shards get equal blocks, and the quotas of every source add up in them.
    per = {}
    for r in got:
        for p in r.pieces:
            per[p.shard] = per.get(p.shard, 0) + p.n_words
    assert max(per.values()) - min(per.values()) <= 2 * mixing.BLOCK


def test_reruns_agree_on_any_partitioning(spark):
    df, _ = sample(spark)
    once = sorted(map(str, mixing.mix(df.repartition(3)).collect()))
    again = sorted(map(str, mixing.mix(df.repartition(11), run=5000).collect()))
    assert once == again


def test_mixed_rows_hold_the_words_taken(spark):
    df, _ = sample(spark)
    taken = {}
    for r in mixing.mix(df).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + sum(p.n_words for p in r.pieces)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    have = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum(mixing.C.count_words(F.col("text"))).alias("n")).collect()}
    assert have == {k: v for k, v in taken.items() if v}


def test_empty_and_clashing(spark):
    df, rows = sample(spark, 30)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0
    more = df.withColumns({n: F.lit(1) for n in ("size", "words", "part", "order", "k1", "row", "times", "target", "name")})
    assert mixing.mix(more).count() == len(rows)
    assert mixing.mixed(more).columns == more.columns
