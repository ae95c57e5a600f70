import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from llm.test_substrings import brute as substring_brute, sha

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's documents over the smallest tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(P.C.staged(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(stages):
    assert all(s.columns == COLUMNS for s in stages[:-1])
    assert [n for n, _ in P.STAGES] == ["toxicity", "jaccard_join", "substring_dedup", "mixing", "sentencepiece"]


def test_toxic_documents_go_and_others_stay(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {i for i, _ in pairs(stages[1])}
    clean = [i for i, t in labels.items() if t == 0]
    assert sum(i in kept for i in clean) >= 0.9 * len(clean)
    assert kept < {i for i, _ in pairs(stages[0])}


def shingled(text, n):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set()


def test_one_of_each_group_stays(stages):
    rows = pairs(stages[1])
    sets = [shingled(t, 5) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    assert sorted(i for i, _ in pairs(stages[2])) == sorted(least.values())


def test_passages_are_cut(stages):
    want = {i: k for i, _, _, k in substring_brute(pairs(stages[2]))}
    got = {r.doc_id: r for r in stages[3].collect()}
    assert set(got) == set(want)
    before = dict(pairs(stages[2]))
    for i, r in got.items():
        assert sha(b" ".join(r.text.encode().split())) == want[i]
        assert r.n_chars == len(r.text)
        if sha(b" ".join(before[i].encode().split())) == want[i]:
            assert r.text == before[i]


def test_mix_is_near_targets(stages):
    words = F.coalesce(F.regexp_count("text", F.lit(P.C.WORD)), F.lit(0))
    size = {r.source: r.n for r in stages[3].groupBy("source").agg(F.sum(words).alias("n")).collect()}
    have = {r.source: r.n for r in stages[4].groupBy("source").agg(F.sum(words).alias("n")).collect()}
    order = sorted(size)
    share = P.mixing.targets([size[s] for s in order], [1 + i % 3 for i in range(len(order))])
    assert all(abs(have[s] - t) <= 2 * P.mixing.BLOCK for s, t in zip(order, share))


def test_tokens_decode_to_the_texts(stages):
    before = sorted((r.doc_id, r.text.replace("▁", " ")) for r in stages[4].collect())
    assert sorted((r.doc_id, r.decoded) for r in stages[5].collect()) == before
    assert all(r.n_tokens == len(r.ids) for r in stages[5].limit(50).collect())


def test_nulls_repeats_and_empty(spark, docs):
    r = random.Random(1)
    text = " ".join(r.choices(["a", "b", "c", "dd"], k=60))
    rows = docs([(1, None), (2, ""), (3, text), (3, text), (4, text), (None, text + " x"), (5, "one two")])
    once = P.drop_near_copies(spark, rows, SF)
    assert sorted(str(x.doc_id) for x in once.collect()) == ["1", "2", "5", "None"]
    cut = P.cut_passages(spark, rows, SF)
    assert cut.count() == 7 and cut.columns == COLUMNS
    assert P.mix_sources(spark, once, SF).columns == COLUMNS
    for _, stage in P.STAGES[1:]:
        assert stage(spark, rows.limit(0), SF).count() == 0


def test_every_stage_keeps_other_columns_and_takes_nulls(spark, docs):
    """Columns of the names that the stages use inside, nulls in every column, a long text."""
    r = random.Random(2)
    words = ["a", "b", "c", "dd", "eee"]
    text = " ".join(r.choices(words, k=60))
    rows = docs([(1, None), (2, ""), (3, text), (None, text + " x"), (5, "one two"), (6, " ".join(f"w{i}" for i in range(200_000)))])
    rows = rows.unionByName(rows.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]))
    names = ["k1", "k2", "_spans", "c", "n", "group", "score", "held_out", "h", "taken", "row", "ids", "w", "size"]
    wide = rows.selectExpr("*", *[f"'{n}' AS `{n}`" for n in names])
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns, name
        got = out.collect()
        assert got and all(r[n] == n for r in got for n in names), name
        assert max(len(r.text or "") for r in got) > 1_000_000, name
    tokens = P.encode(spark, wide, SF)
    assert tokens.count() == rows.count() and max(r.n_tokens for r in tokens.collect()) > 200_000


def test_toxicity_stage_without_rows_or_labels(spark, docs):
    rows = docs([(1, None), (2, ""), (None, "x y"), (4, "one two")])
    assert P.drop_toxic(spark, rows.limit(0), SF).count() == 0
    kept = P.drop_toxic(spark, rows, SF)
    assert kept.columns == COLUMNS and kept.count() == 4
