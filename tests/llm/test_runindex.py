import random

import numpy as np
import pytest

from llm.conftest import EDGE, sha

from wattframe.llm import runindex


def brute(pairs, width):
    texts = [(i, (t or "").encode()) for i, t in pairs]
    count = {}
    for _, t in texts:
        for s in range(len(t) - width + 1):
            count[t[s : s + width]] = count.get(t[s : s + width], 0) + 1
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - width + 1):
            if count[t[s : s + width]] > 1:
                gone[s : s + width] = True
        runs = int((gone[1:] < gone[:-1]).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((str(i), len(t), int(gone.sum()), runs, sha(kept)))
    return sorted(out)


def rows(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def made(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choices("abcdé ", k=n))
    passage = [text(n) for n in (30, 60, 150, 400, 2000)]
    pairs = []
    for i in range(80):
        t = text(r.randrange(0, 400))
        for p in r.sample(passage, r.randrange(0, 3)):
            p = list(p)
            for _ in range(r.randrange(0, 3)):
                p[r.randrange(len(p))] = r.choice("xyzä")
            t += "".join(p) + text(r.randrange(0, 200))
        pairs.append((i, t))
    pairs += [(200 + i, pairs[5][1]) for i in range(3)]
    return pairs + [(300, "a" * 900), (301, "ab" * 300 + "c"), (302, "q" * 200), (303, "q" * 199)]


@pytest.mark.parametrize("seed", range(5))
def test_index_gives_longest_matches(seed):
    r = random.Random(seed)
    texts = [bytes(r.choices(b"ab\x00", k=r.randrange(1, 60))) for _ in range(12)]
    texts += [texts[0], texts[1][1:] or b"a", b"a" * 50]
    places = [t[s:] for t in texts for s in range(len(t))]

    def lcp(x, y):
        k = 0
        while k < min(len(x), len(y)) and x[k] == y[k]:
            k += 1
        return k

    want = [max(lcp(x, y) for j, y in enumerate(places) if j != i) for i, x in enumerate(places)]
    index = runindex.build(texts)
    assert index.matching_lengths().tolist() == want
    assert index.runs <= index.size


@pytest.mark.parametrize("width,bits,hot", [(40, 27, 4096), (200, 27, 3), (40, 12, 20), (40, 27, 5)])
def test_equals_brute_force(docs, width, bits, hot):
    pairs = made(width)
    got = runindex.deduplicate(docs(pairs).repartition(4), width, bits, contents=False, hot=hot)
    assert rows(got) == brute(pairs, width)


def test_edges(docs):
    got = runindex.deduplicate(docs(EDGE), width=5, contents=False)
    assert rows(got) == brute(EDGE, 5)
    assert runindex.deduplicate(docs(EDGE).limit(0)).count() == 0
    twice = [(7, "x" * 3 + "y" * 300), (7, "x" * 3 + "y" * 300)]
    kept = [(r.n_removed, r.n_spans, bytes(r.kept)) for r in runindex.deduplicate(docs(twice)).collect()]
    assert kept == [(303, 1, b"")] * 2
