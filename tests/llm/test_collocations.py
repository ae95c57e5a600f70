import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm.conftest import EDGE

from wattframe.llm import collocations as M

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, absorb, first):
    """rows: (lang, text)."""
    counts = {}
    for lang, text in rows:
        for piece in re.split(M.BREAKS, (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                counts.setdefault(lang or "und", Counter()).update(
                    tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in cand.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= absorb * f[q]}
        found = []
        for p, a in cand.items():
            if p in gone:
                continue
            s, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(c for p, c in f.items() if len(p) == 1)
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:first])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None) for i, (lang, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long")


def made(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Über", "ÉTÉ", "a\x0b", "zz"]
    weights = [1 / (i + 1) for i in range(len(words))]

    def text():
        own = r.choices(words, weights, k=r.randint(0, 60))
        return "".join(w + r.choice([" "] * 9 + ["  ", "\t", ", ", ".", "\n", "\r\n", "; ", "!?"]) for w in own)

    rows = [(r.choice(["en", "de", None, "und"]), text()) for _ in range(250)]
    rows += [("en", "New York City is not new york."), ("en", "the same line again and again")] * 40
    rows += [("fr", None), (None, None), ("fr", ""), ("fr", "x y " * 5000), ("tie", "a b. c d. e f. g h " * 12)]
    return rows


@pytest.mark.parametrize("least,first,head", [(10, 2000, 8000), (3, 12, 5), (2, 5, 1), (10, 3, 1), (1, 40, 30)])
def test_equals_brute_force(spark, least, first, head):
    rows = made(least + first)
    got = M.mine(frame(spark, rows).repartition(5), least, 50, first, head)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least, 50, first)


def test_unexpanded_branches_are_not_counted(spark, monkeypatch):
    """Bounds settle the list although most branches never grew."""
    r = random.Random(4)
    rows = [("en", " ".join(r.choice("abcdefghijklmnopqrst") for _ in range(4000)) + " q1 q2 q3 q1 q2 q3 q4 q5 q4 q5")] * 12
    seen = []
    own = M._field
    monkeypatch.setattr(M, "_field", lambda nodes, n: seen.append(n) or own(nodes, n))
    got = M.mine(frame(spark, rows), first=3, head=4)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 50, 3)
    assert sum(seen) < 40


def test_counts_beyond_64_bits(spark):
    values = [(10**12 + 7, 3 * 10**13 + 1, 10**13 + 9), (999_999_999_999_999, 999_999_999_999_999, 10**15 + 5), (10, 11, 12)]
    df = spark.createDataFrame(values, "a long, l long, r long").select("a", "l", "r", M.score("a", "l", "r").alias("s"))
    assert {tuple(x) for x in df.collect()} == {(a, l, r, 10**6 * a * a // (l * r)) for a, l, r in values}


def test_flushed_counts_add_up(monkeypatch):
    rows = [(lang or "und", text or "") for lang, text in made(9)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["lang", "text"])

    field = lambda: None
    field.value = b"\xff" * 8192  # every pair is expanded

    def total():
        out = Counter()
        for got in [*M._short([batch]), *M._long(field)([batch])]:
            for lang, k, phrase, n in zip(*(c.to_pylist() for c in got.columns)):
                out[lang, k, phrase] += n
        return out

    whole = total()
    monkeypatch.setattr(M, "HELD", 50)
    assert total() == whole


def test_edges(docs):
    edge = docs(EDGE).withColumns({"lang": F.lit(None).cast("string"), "phrase": F.lit("p"), "n": F.lit(1), "k": F.lit(2)})
    assert sorted(map(tuple, M.mine(edge, 1).collect())) == brute([(None, t) for _, t in EDGE], 1, 50, 2000)
    assert M.mine(docs([])).collect() == []
    long = docs([(1, "a b c. " * 200_000)])
    assert sorted(map(tuple, M.mine(long).collect())) == brute([("en", "a b c. " * 200_000)], 10, 50, 2000)
