import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.llm import langid

SF = "/root/testdata/sf0.01"


def test_grams_equal_brute_force():
    texts = ["", "a", "Ab", "éÉx\U0001f600yz", "the end", ""]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    off = np.cumsum([0] + [len(r) for r in raw])
    together = list(langid.grams(data, off))
    for i, r in enumerate(raw):
        alone = list(langid.grams(np.frombuffer(r, np.uint8), np.array([0, len(r)])))
        for order in range(langid.ORDERS):
            f, at = together[order]
            own = f[at[i] : at[i + 1]]
            assert len(own) == max(0, len(texts[i]) - order)
            assert own.tolist() == (alone[order][0].tolist() if len(alone) > order else [])


def test_leader_is_sparse_and_right():
    r = np.random.default_rng(0)
    rows = []
    for i in range(300):
        y = i % 3
        idx = np.unique(np.append(r.integers(3, 200, 10), y))
        rows.append((y, idx, np.ones(len(idx)) / 3))
    w, b = langid.follow(rows, 3, 200)
    assert all((w[idx].T @ x + b).argmax() == y for y, idx, x in rows)
    assert (w == 0).mean() > 0.02


def test_temperature_calibrates():
    r = np.random.default_rng(1)
    z = r.normal(0, 1, (4000, 3))
    y = np.array([r.choice(3, p=p) for p in langid._softmax(z)])
    assert abs(langid.temperature(4 * z, y) - 4) < 0.5


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.97


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "de"), (4, "the", None), (None, "der die das", "de"), (5, "the of and", "en"), (6, "der", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"h": F.lit(1), "held_out": F.lit("x")})
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert all(got[i][0] in ("en", "de") for i in (4, 5, 6, None))
    assert langid.identify(df.limit(0)).count() == 0
    none = langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
