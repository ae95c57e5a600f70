import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.llm import toxicity as T

TEXTS = ["", "One two, three!! four", "a" * 300, "stupid$$$ thing\n\nidiot. ümläut", " ".join("w%d" % i for i in range(75))]


def flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])


def test_windows_cover_every_word():
    r = T.read(*flat(TEXTS))
    n = [len(t.split()) for t in TEXTS]
    ends = np.cumsum(n)
    covered = np.zeros(ends[-1], int)
    for s, k, t in zip(r.start, r.length, r.text):
        assert ends[t] - n[t] <= s and s + k <= ends[t] and 1 <= k <= T.WINDOW
        covered[s : s + k] += 1
    assert (covered >= 1).all() and covered.max() >= 2
    assert 0 not in r.text


def test_reading_does_not_depend_on_the_neighbours():
    together = T.logits(T.Network(), T.read(*flat(TEXTS)))
    r = T.read(*flat(TEXTS))
    for i, t in enumerate(TEXTS):
        alone = T.read(*flat([t]))
        assert np.allclose(T.logits(T.Network(), alone), together[r.text == i], atol=1e-5)


def plain_score(net, text):
    """A text's highest window logit, word by word and step by step, from the bytes on."""
    p, h = net.p, T.HIDDEN
    words = text.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()

    def word_input(word):
        r = T.read(*flat([word.decode()]))
        grams = r.gram[r.gram_at[0] : r.gram_at[1]]
        return np.concatenate([p["word"][r.word[0]], sum(p["gram"][g] for g in grams) / np.sqrt(len(grams))])

    def layer(xs, way):
        state, out = np.zeros(h), []
        for x in xs:
            gate = x @ p[f"in_{way}"] + p[f"bias_{way}"]
            rec = p[f"rec_{way}"]
            z = 1 / (1 + np.exp(-(gate[:h] + state @ rec[:, :h])))
            r = 1 / (1 + np.exp(-(gate[h : 2 * h] + state @ rec[:, h : 2 * h])))
            c = np.tanh(gate[2 * h :] + (r * state) @ rec[:, 2 * h :])
            state = (1 - z) * state + z * c
            out.append(state)
        return out

    best, at = -np.inf, 0
    while words:
        xs = [word_input(w) for w in words[at : at + T.WINDOW]]
        states = [np.concatenate(s) for s in zip(layer(xs, "f"), layer(xs[::-1], "b")[::-1])]
        e = np.array([np.tanh(s @ p["att"] + p["att_b"]) @ p["att_v"] for s in states])
        w = np.exp(e - e.max())
        best = max(best, float((w / w.sum()) @ np.array(states) @ p["out"] + p["out_b"][0]))
        if at + T.WINDOW >= len(words):
            break
        at += T.STRIDE
    return best


def test_scores_equal_a_plain_reading():
    net = T.Network(3)
    r = random.Random(2)
    texts = TEXTS + [" ".join(r.choices(["Idiot,", "the", "and", "wörd", "x" * 40, "(ok)"], k=k)) for k in (1, 31, 32, 33, 57, 200)]
    z = T.highest(*(lambda read: (read, T.logits(net, read), len(texts)))(T.read(*flat(texts))))
    want = [plain_score(net, t.encode()) for t in texts]
    assert np.allclose(z[np.isfinite(z)], [w for w in want if np.isfinite(w)], atol=1e-4) and (np.isfinite(z) == np.isfinite(want)).all()


def test_training_reads_a_bounded_part_of_long_texts():
    words = [f"wört{i}" for i in range(40_000)]
    raw = " ".join(words).encode()
    thin = T.thinned(raw)
    got = [int(w.decode()[4:]) for w in thin.split()]
    assert len(thin) <= T.TRAIN_BYTES < len(raw) and got == sorted(set(got))
    assert got[0] < 200 and got[-1] > 39_800 and max(b - a for a, b in zip(got, got[1:])) < 1000
    assert T.thinned(raw[:1000]) == raw[:1000] and T.thinned(b"x" * 1_000_000).split() == []


def test_gradient():
    net = T.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = T.read(*flat(TEXTS))
    ids, mask, small = T._part(r, np.arange(len(r.start)))
    x = net.embed(small).astype(np.float64)
    weight = np.random.default_rng(0).normal(size=len(ids))
    z, cache = net.forward(net.gates(x), ids, mask, keep=True)
    g, d_x = net.backward(x, ids, mask, cache, weight)
    for name in ("in_f", "in_b", "rec_f", "rec_b", "bias_b", "att", "att_v", "out", "out_b"):
        p = net.p[name]
        for at in list(np.ndindex(p.shape))[:: max(1, p.size // 5)]:
            old = p[at]
            p[at] = old + 1e-3
            up = net.forward(net.gates(x), ids, mask) @ weight
            p[at] = old - 1e-3
            down = net.forward(net.gates(x), ids, mask) @ weight
            p[at] = old
            assert abs((up - down) / 2e-3 - g[name][at]) < 1e-3 * max(1, abs(g[name][at])), name
    for at in ((0, 0), (3, 7), (5, 19)):
        old = x[at]
        x[at] = old + 1e-3
        up = net.forward(net.gates(x), ids, mask) @ weight
        x[at] = old - 1e-3
        down = net.forward(net.gates(x), ids, mask) @ weight
        x[at] = old
        assert abs((up - down) / 2e-3 - d_x[at]) < 1e-3 * max(1, abs(d_x[at]))


def made(n=700, seed=0):
    r = random.Random(seed)
    words = ["w" + "".join(r.choices("abcdefgh", k=4)) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        ws = r.choices(words, k=r.randrange(5, 160))
        toxic = int(r.random() < 0.3)
        if toxic:
            ws[r.randrange(len(ws))] = r.choice(["Idiot,", "moron", "scum!"])
        docs.append((i, " ".join(ws)))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = made()
    docs += [(5000, None), (5001, ""), (5002, "  "), (None, "nobody"), (5003, "moron"), (3, docs[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"h": F.lit(1), "toxic": F.lit(2), "score": F.lit("x")})
    l = spark.createDataFrame(labels + [(None, 1, 1), (9000, 1, None), (3, labels[3][1], labels[3][2])], "doc_id long, quality int, toxic int")
    got = T.score(d, l).collect()
    assert len(got) == len(docs)
    truth = {i: t for i, _, t in labels}
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.9
    by = {r.doc_id: r for r in got}
    assert by[5000].score == by[5001].score == by[5002].score < 0.5


@pytest.mark.parametrize("labels,score", [([], 0.0), ([(1, 1, 0)], 0.0), ([(1, 1, 1)], 1.0)])
def test_without_two_labels(spark, labels, score):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert [r.score for r in T.score(d, l).collect()] == [score, score]
    assert T.score(d.limit(0), l).count() == 0
