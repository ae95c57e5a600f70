"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is read in windows of ``WINDOW`` words, a new one every ``STRIDE`` words, so that they overlap
and every word is read with words on both sides. A word enters as the embedding of its hash (lower
case, outer punctuation off) next to the scaled sum of its hashed byte n-grams (of 3 and 5, with marks at its
ends), so unseen spellings and compounds of a stem still say something. Two gated recurrent layers run over the window in both directions,
attention weighs their states, and a logistic unit scores the pooled state. A text scores as its
highest window does.

Labels belong to whole texts. Training first takes every window of a text for its label and then, as
scoring does, only the highest windows (several for texts without toxicity, whose highest ones are
the likeliest false alarms). It runs on at most ``SAMPLE`` labelled texts in equal parts per label,
chosen by hash, and of a text of over ``TRAIN_BYTES`` on runs spread evenly over its whole length (scoring
reads every text whole); the first epochs draw ``EPOCH_WINDOWS`` windows per label at most; a quarter of them is kept out of the fit and sets the scale and offset that turn
a text's logit into a probability at the labels' true rate.

Scoring computes the input part of the gates once per different word of a chunk and runs all windows
of the chunk side by side.

Defined cases: null, empty or blank texts have no window and score the labels' rate; without labels, or
with one label only, every text scores that rate (0 without any); null ids count as the empty text in
the split and meet no label; conflicting labels of one id count as toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattframe.llm import common as C
from wattframe.llm.langid import bounded, remainder

WINDOW, STRIDE = 32, 24
SAMPLE = 3_000
#: Bytes of a text that training reads at most, and of the runs, spread evenly over it, that make them up.
TRAIN_BYTES, TRAIN_RUN = 1 << 16, 1 << 9
#: Windows of each label in one of the first epochs at most, drawn anew each time.
EPOCH_WINDOWS = 6 * SAMPLE
WORDS, GRAM_ROWS = 1 << 13, 1 << 14
GRAMS = (3, 5)
WORD_DIM, CHAR_DIM, HIDDEN = 12, 8, 8
EPOCHS, ALL_EPOCHS, BATCH, RATE = 12, 4, 256, 0.01
SEED = 7

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


# --- inputs ------------------------------------------------------------------------------------


@dataclass
class Read:
    """Words of several texts and the windows over them."""

    word: np.ndarray  # of each different word: its row in the word table
    gram: np.ndarray  # n-gram rows of the different words, end to end
    gram_at: np.ndarray
    which: np.ndarray  # of each word: which different word it is
    start: np.ndarray  # of each window: its first word
    length: np.ndarray
    text: np.ndarray  # of each window: its text


def _grams(data: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of each word's ``width``-grams of bytes with a mark before and after, and their offsets."""
    count = np.maximum(end - start + 3 - width, 1)
    at = np.append(0, np.cumsum(count))
    first = np.arange(at[-1]) - np.repeat(at[:-1], count) + np.repeat(start, count) - 1
    low, high = np.repeat(start, count), np.repeat(end, count)
    h = np.full(len(first), width, np.uint32)
    for j in range(width):
        pos = first + j
        byte = data[np.clip(pos, 0, max(len(data) - 1, 0))].astype(np.uint32)
        h = (h ^ np.where(pos < low, 1, np.where(pos == high, 2, np.where(pos > high, 3, byte))).astype(np.uint32)) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - (GRAM_ROWS.bit_length() - 1))).astype(np.int64), at


def read(data: np.ndarray, off: np.ndarray) -> Read:
    data = C.LOWER[data]
    starts, ends, words = C.word_spans(data, off)
    keys = C.word_hashes(data, starts, ends)
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    # Outer punctuation off, unless nothing would be left.
    solid = np.flatnonzero(_ALNUM[data])
    a, b = np.searchsorted(solid, s), np.searchsorted(solid, e)
    inner = b > a
    cs, ce = s.copy(), e.copy()
    cs[inner], ce[inner] = solid[a[inner]], solid[b[inner] - 1] + 1
    # Letters further in than a mark (stupid$$$x) stay with the word: only its ends are cut.
    row = (C.word_hashes(data, cs, ce) % np.uint64(WORDS)).astype(np.int64) if len(first) else first
    grams = [_grams(data, cs, ce, n) for n in GRAMS]
    count = sum(np.diff(at) for _, at in grams)
    at = np.append(0, np.cumsum(count))
    rows = np.empty(at[-1], np.int64)
    put = at[:-1].copy()
    for own, own_at in grams:
        n = np.diff(own_at)
        rows[np.arange(len(own)) - np.repeat(own_at[:-1] - put, n)] = own
        put += n
    n = np.diff(words)
    windows = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), windows)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = words[text] + nth * STRIDE
    return Read(row, rows, at, which, start, np.minimum(WINDOW, words[text + 1] - start), text)


def read_all(column: pa.Array) -> Read:
    """Many texts, read in parts of bounded size."""
    data, off = C.flat(column)
    parts, words, different, grams = [], 0, 0, 0
    for a, b in C.pieces(off):
        r = read(data[off[a] : off[b]], off[a : b + 1] - off[a])
        parts.append((r.word.astype(np.int32), r.gram.astype(np.int32), r.gram_at[:-1] + grams,
                      (r.which + different).astype(np.int32), r.start + words, r.length, r.text + a))
        words, different, grams = words + len(r.which), different + len(r.word), grams + len(r.gram)
    if not parts:
        return read(data, off)
    word, gram, gram_at, which, start, length, text = (np.concatenate(x) for x in zip(*parts))
    return Read(word, gram, np.append(gram_at, grams), which, start, length, text)


# --- the network -------------------------------------------------------------------------------


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters by name; the forward and backward pass over windows of equal, masked length."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        d = WORD_DIM + CHAR_DIM
        small = lambda *shape: (r.normal(0, 1 / np.sqrt(shape[0]), shape)).astype(np.float32)
        self.p = {
            "word": r.normal(0, 0.3, (WORDS, WORD_DIM)).astype(np.float32),
            "gram": r.normal(0, 0.1, (GRAM_ROWS, CHAR_DIM)).astype(np.float32),
            "in_f": small(d, 3 * HIDDEN), "in_b": small(d, 3 * HIDDEN),
            "rec_f": small(HIDDEN, 3 * HIDDEN), "rec_b": small(HIDDEN, 3 * HIDDEN),
            "bias_f": np.zeros(3 * HIDDEN, np.float32), "bias_b": np.zeros(3 * HIDDEN, np.float32),
            "att": small(2 * HIDDEN, HIDDEN), "att_b": np.zeros(HIDDEN, np.float32), "att_v": small(HIDDEN, 1)[:, 0],
            "out": small(2 * HIDDEN, 1)[:, 0], "out_b": np.zeros(1, np.float32),
        }

    def embed(self, r: Read) -> np.ndarray:
        """Input of each different word; a bounded number of them at a time."""
        out = np.zeros((len(r.word), WORD_DIM + CHAR_DIM), np.float32)
        for a in range(0, len(r.word), 32_768):
            part = slice(a, min(a + 32_768, len(r.word)))
            at = r.gram_at[part.start : part.stop + 1]
            chars = np.add.reduceat(self.p["gram"][r.gram[at[0] : at[-1]]], at[:-1] - at[0], axis=0)
            out[part, :WORD_DIM] = self.p["word"][r.word[part]]
            out[part, WORD_DIM:] = chars / np.sqrt(np.diff(at))[:, None]
        return out

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The input part of both directions' gates, once per different word."""
        return tuple(x @ self.p[f"in_{d}"] + self.p[f"bias_{d}"] for d in "fb")

    def _direction(self, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray, rec: np.ndarray, back: bool, keep: bool):
        """States of a gated recurrent layer at every step; with ``keep`` what its gradient needs."""
        n, steps = ids.shape
        h = np.zeros((n, HIDDEN), np.float32)
        states = np.empty((steps, n, HIDDEN), np.float32)
        saved = []
        for t in reversed(range(steps)) if back else range(steps):
            x = gates[ids[:, t]]
            zr = _sigmoid(x[:, : 2 * HIDDEN] + h @ rec[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + (r * h) @ rec[:, 2 * HIDDEN :])
            m = mask[:, t : t + 1]
            new = h + m * z * (c - h)
            if keep:
                saved.append((t, h, z, r, c, m))
            h = new
            states[t] = h
        return states, saved

    def forward(self, gates: tuple[np.ndarray, np.ndarray], ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logit of each window; ``gates``: of the different words, ``ids``: windows x steps."""
        p = self.p
        f, sf = self._direction(gates[0], ids, mask, p["rec_f"], False, keep)
        b, sb = self._direction(gates[1], ids, mask, p["rec_b"], True, keep)
        s = np.concatenate([f, b], axis=2)  # steps x windows x 2 hidden
        a = np.tanh(s @ p["att"] + p["att_b"])
        e = a @ p["att_v"] + np.where(mask.T > 0, 0.0, -1e4).astype(np.float32)
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", w, s)
        logit = pooled @ p["out"] + p["out_b"][0]
        return (logit, (s, a, w, pooled, sf, sb)) if keep else logit

    def backward(self, x, ids, mask, cache, grad):
        """Gradients of the parameters and of ``x`` given that of the logits."""
        p = self.p
        s, a, w, pooled, sf, sb = cache
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "gram")}
        g["out"], g["out_b"] = pooled.T @ grad, np.array([grad.sum()], np.float32)
        d_pool = grad[:, None] * p["out"][None, :]
        d_w = np.einsum("nk,tnk->tn", d_pool, s)
        d_s = w[:, :, None] * d_pool[None]
        d_e = w * (d_w - (w * d_w).sum(axis=0))
        g["att_v"] = np.einsum("tn,tnk->k", d_e, a)
        d_a = d_e[:, :, None] * p["att_v"] * (1 - a * a)
        g["att"], g["att_b"] = np.einsum("tni,tnj->ij", s, d_a), d_a.sum(axis=(0, 1))
        d_s = d_s + d_a @ p["att"].T
        d_x = np.zeros_like(x)
        for name, saved, part in (("f", sf, d_s[:, :, :HIDDEN]), ("b", sb, d_s[:, :, HIDDEN:])):
            rec, carry = p[f"rec_{name}"], np.zeros((ids.shape[0], HIDDEN), np.float32)
            d_gates = np.zeros((len(x), 3 * HIDDEN), np.float32)
            d_rec = g[f"rec_{name}"]
            for t, h, z, r, c, m in reversed(saved):
                d = (carry + part[t])
                d_c, d_z = d * m * z * (1 - c * c), d * m * (c - h) * z * (1 - z)
                d_h = d * (1 - m * z)
                d_rh = d_c @ rec[:, 2 * HIDDEN :].T
                d_r = d_rh * h * r * (1 - r)
                zr = np.concatenate([d_z, d_r], axis=1)
                d_h = d_h + d_rh * r + zr @ rec[:, : 2 * HIDDEN].T
                d_rec[:, 2 * HIDDEN :] += (r * h).T @ d_c
                d_rec[:, : 2 * HIDDEN] += h.T @ zr
                np.add.at(d_gates, ids[:, t], np.concatenate([zr, d_c], axis=1))
                carry = d_h
            g[f"bias_{name}"] = d_gates.sum(axis=0)
            g[f"in_{name}"] = x.T @ d_gates
            d_x += d_gates @ p[f"in_{name}"].T
        return g, d_x


def windows(r: Read, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different-word numbers and mask of the chosen windows."""
    step = np.arange(WINDOW)
    at = r.start[some][:, None] + step
    mask = (step[None, :] < r.length[some][:, None]).astype(np.float32)
    return r.which[np.minimum(at, len(r.which) - 1)], mask


def logits(net: Network, r: Read, some: np.ndarray | None = None) -> np.ndarray:
    """Logits of the windows, a bounded number side by side, over only the words they hold."""
    some = np.arange(len(r.start)) if some is None else some
    out = np.zeros(len(some), np.float32)
    for a in range(0, len(some), 2_048):
        ids, mask, small = _part(r, some[a : a + 2_048])
        out[a : a + 2_048] = net.forward(net.gates(net.embed(small)), ids, mask)
    return out


# --- training ----------------------------------------------------------------------------------


class _Adam:
    def __init__(self, p):
        self.p, self.t = p, 0
        self.m, self.v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}

    def step(self, g: dict, rows: dict) -> None:
        """``rows``: for tables, the rows that have a gradient."""
        self.t += 1
        fix = RATE * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, d in g.items():
            at = rows.get(k, slice(None))
            self.m[k][at] += 0.1 * (d - self.m[k][at])
            self.v[k][at] += 0.001 * (d * d - self.v[k][at])
            self.p[k][at] -= fix * self.m[k][at] / (np.sqrt(self.v[k][at]) + 1e-8)


def _part(r: Read, some: np.ndarray):
    """The chosen windows over only the words they hold: numbers, mask and a smaller ``Read``."""
    ids, mask = windows(r, some)
    used, ids = np.unique(ids, return_inverse=True)
    n = np.diff(r.gram_at)[used]
    at = np.append(0, np.cumsum(n))
    gram = r.gram[np.arange(at[-1]) - np.repeat(at[:-1], n) + np.repeat(r.gram_at[used], n)]
    none = np.zeros(0, np.int64)
    return ids.reshape(mask.shape), mask, Read(r.word[used], gram, at, none, none, none, none)


def _summed(rows: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, which = np.unique(rows, return_inverse=True)
    out = np.zeros((len(at), grad.shape[1]), np.float32)
    np.add.at(out, which, grad)
    return at, out


def train(r: Read, label: np.ndarray, weight: np.ndarray, seed: int = SEED) -> Network:
    """``label, weight`` per text; weight 0 leaves a text out."""
    net, rng = Network(seed), np.random.default_rng(seed)
    adam = _Adam(net.p)
    own = np.flatnonzero(weight[r.text] > 0)
    if not len(own):
        return net
    for epoch in range(EPOCHS):
        if epoch < ALL_EPOCHS:
            # All windows, at most as many as keep the two labels' parts equal and the epoch short.
            pick = [w[rng.permutation(len(w))[:EPOCH_WINDOWS]] for w in (own[label[r.text[own]] == y] for y in (0, 1))]
            some = np.concatenate(pick)
        else:
            z = logits(net, r, own)
            order = np.lexsort((-z, r.text[own]))
            text = r.text[own][order]
            head = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            nth = np.arange(len(text)) - np.repeat(head, np.diff(np.append(head, len(text))))
            some = own[order[nth < np.where(label[text] == 1, 1, 3)]]
        some = some[rng.permutation(len(some))]
        balance = np.bincount(label[r.text[some]], minlength=2)
        scale = len(some) / (2.0 * np.maximum(balance, 1))
        for a in range(0, len(some), BATCH):
            b = some[a : a + BATCH]
            ids, mask, small = _part(r, b)
            x = net.embed(small)
            z, cache = net.forward(net.gates(x), ids, mask, keep=True)
            y = label[r.text[b]]
            grad = ((_sigmoid(z) - y) * scale[y] / len(b)).astype(np.float32)
            g, d_x = net.backward(x, ids, mask, cache, grad)
            rows = {}
            rows["word"], g["word"] = _summed(small.word, d_x[:, :WORD_DIM])
            n = np.diff(small.gram_at)
            rows["gram"], g["gram"] = _summed(small.gram, np.repeat(d_x[:, WORD_DIM:] / np.sqrt(n)[:, None], n, axis=0))
            adam.step(g, rows)
    return net


def highest(r: Read, z: np.ndarray, texts: int) -> np.ndarray:
    """Each text's highest window, -inf without one."""
    out = np.full(texts, -np.inf)
    np.maximum.at(out, r.text, z)
    return out


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through weighted labels (Newton steps, small ridge)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * z + b)
        s = weight * p * (1 - p)
        g = np.array([(weight * (p - y) * z).sum() + 1e-3 * (a - 1), (weight * (p - y)).sum()])
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    return max(float(a), 1e-3), float(b)


@dataclass
class Model:
    net: Network | None
    slope: float
    offset: float
    rate: float


def thinned(text: bytes) -> bytes:
    """The text, or of a long one whole words in runs spread evenly over it, ``TRAIN_BYTES`` in all at most."""
    if len(text) <= TRAIN_BYTES:
        return text
    runs = TRAIN_BYTES // TRAIN_RUN
    out = []
    for at in np.linspace(0, len(text) - TRAIN_RUN, runs).astype(int).tolist():
        # Words cut by the run's ends go.
        words = text[at : at + TRAIN_RUN].split()
        out.append(b" ".join(words[1:-1]))
    return b"\n".join(out)


def _thinned(batches):
    for batch in batches:
        texts = [thinned(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.binary())], ["h", "toxic", "text"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """``docs``: ``doc_id, text`` to learn from; ``labels``: ``doc_id, toxic``."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = C.staged(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn(
        "h", F.xxhash64("doc_id")), "labels")
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    rate = counts.get(1, 0) / total if total else 0.0
    if len(counts) < 2:
        return Model(None, 1.0, 0.0, rate)
    chosen = F.broadcast(bounded(known, "toxic", "h", sample))  # at most ``sample`` rows
    texts = docs.join(chosen, "doc_id").select("h", "toxic", F.coalesce("text", F.lit("")).alias("text"))
    # At most ``sample`` texts, and ``TRAIN_BYTES`` of each.
    rows = texts.mapInArrow(_thinned, "h long, toxic int, text binary").toArrow()
    rows = rows.sort_by([("h", "ascending"), ("toxic", "ascending"), ("text", "ascending")])
    label = rows.column("toxic").to_numpy().astype(np.int64)
    r = read_all(rows.column("text"))
    out = np.arange(len(label)) % 4 == 0
    net = train(r, label, (~out).astype(float))
    z = highest(r, logits(net, r), len(label))
    use = out & np.isfinite(z)
    share = np.maximum(np.bincount(label[use], minlength=2), 1)
    weight = np.where(label == 1, rate / share[1], (1 - rate) / share[0]) * use.sum()
    slope, offset = calibrate(z[use], label[use], weight[use]) if use.any() else (1.0, 0.0)
    return Model(net, slope, offset, rate)


# --- scoring -----------------------------------------------------------------------------------


def _scores(m: Model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    out = np.full(n, m.rate)
    if m.net is not None:
        r = read(data, off)
        z = highest(r, logits(m.net, r), n)
        some = np.isfinite(z)
        out[some] = _sigmoid(m.slope * z[some] + m.offset)
    return out


def _scored(model):
    def run(batches):
        m: Model = model.value
        for rows, data, off in C.chunked(batches):
            score = _scores(m, data, off)
            yield pa.RecordBatch.from_arrays(
                [rows.column(rows.schema.get_field_index(c)) for c in ("doc_id", "held_out")]
                + [pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score below one half, with all their columns."""
    rows = split(docs)
    model = docs.sparkSession.sparkContext.broadcast(fit(rows.where(~F.col("held_out")), labels, sample))
    at = docs.columns.index("text")

    def run(batches):
        m: Model = model.value
        for batch in batches:
            data, off = C.flat(batch.column(at))
            for a, b in C.pieces(off):
                score = _scores(m, data[off[a] : off[b]], off[a : b + 1] - off[a])
                yield batch.slice(a, b - a).filter(pa.array(score < 0.5))

    return docs.mapInArrow(run, docs.schema)


def split(docs: DataFrame) -> DataFrame:
    """``doc_id, text, held_out``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn(
        "held_out", remainder(F.col("doc_id"), 5) == 0)


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted``; ``rows`` as ``split`` gives them."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_scored(shared), "doc_id long, held_out boolean, score double, predicted int")


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learns from the labelled documents that are not held out and scores all."""
    rows = split(docs)
    return predict(rows, fit(rows.where(~F.col("held_out")), labels, sample))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(C.load(spark, sf_dir, "documents"), C.load(spark, sf_dir, "labels"))
