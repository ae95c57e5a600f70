import random
import re

from llm.conftest import ALIKE, EDGE, sha

from wattframe.llm import substrings

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(pairs, width=20):
    texts = [(i, WORD.findall((t or "").encode())) for i, t in pairs]
    first = {}
    for i, ws in texts:
        for s in range(len(ws) - width + 1):
            key = tuple(ws[s : s + width])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for i, ws in texts:
        gone = set()
        for s in range(len(ws) - width + 1):
            if first[tuple(ws[s : s + width])] < (i, s):
                gone.update(range(s, s + width))
        out.append((i, len(ws), len(gone), sha(b" ".join(w for k, w in enumerate(ws) if k not in gone))))
    return sorted(out)


def made(seed=1):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(50)]
    passage = [" ".join(r.choices(words, k=n)) for n in (19, 20, 21, 70)]
    pairs = []
    for i in range(120):
        t = " ".join(r.choices(words, k=r.randrange(0, 90)))
        for p in r.sample(passage, r.randrange(0, 3)):
            t += r.choice([" ", "\n", "\t "]) + p + " " + " ".join(r.choices(words, k=r.randrange(0, 30)))
        pairs.append((i, t))
    pairs += [(200 + i, pairs[3][1]) for i in range(4)] + [(300, "a " * 500), (301, "b a " * 300), (302, "a " * 25)]
    return pairs


def test_words_that_a_polynomial_takes_for_one(docs):
    x, y = ALIKE
    rest = " ".join(f"w{i}" for i in range(19))
    pairs = [(1, f"{x} {rest}"), (2, f"{y} {rest}"), (3, f"{x} {rest}"), (4, f"{rest} {y} {rest} {x}")]
    assert rows(substrings.deduplicate(docs(pairs), texts=False)) == brute(pairs)


def rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def test_equals_brute_force(docs):
    pairs = made()
    assert rows(substrings.deduplicate(docs(pairs).repartition(5), texts=False)) == brute(pairs)


def test_small_sketch_loses_nothing(docs):
    pairs = made(2)
    assert rows(substrings.deduplicate(docs(pairs).repartition(3), bits=12, texts=False)) == brute(pairs)


def test_edges(docs):
    got = substrings.deduplicate(docs(EDGE)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == sorted([
        ("1", 0, 0, ""), ("2", 0, 0, ""), ("3", 0, 0, ""), ("4", 1, 0, "one"), ("4", 1, 0, "one"),
        ("None", 3, 0, "one two three"), ("5", 4, 0, "ünï çødé \U0001f600 x")])


def test_empty_table_and_clashing_columns(docs):
    from pyspark.sql import functions as F

    df = docs(made()).withColumns({n: F.lit(1) for n in ("k1", "k2", "span", "spans", "bucket", "words", "kept")})
    assert substrings.deduplicate(df.limit(0)).count() == 0
    assert substrings.deduplicate(df).count() == len(made())
