"""Language identification by sparse multinomial logistic regression on character n-grams.

Characters (lower case) give n-grams of 1 to ``ORDERS`` hashed into ``2^BITS`` features. A document's
value of a feature is its share of the document's n-grams times the feature's inverse document
frequency, counted over all learning documents. The weights are fitted with the
follow-the-regularised-leader rule per coordinate, whose elastic net (``L1`` and ``L2``) leaves most of
them zero, on at most ``SAMPLE`` learning documents in equal parts per language, chosen by hash. A fifth
of these is kept out of the fit and sets the temperature that makes the probabilities honest.

As the values are shares, a document's logits are the mean over its n-grams of weight times inverse
frequency: scoring needs one gather per n-gram and no table of counts, over whole texts of any length.

Defined cases: ``und`` with score 0 for null texts, texts without a letter, and if no language was
learned; null languages are not learned from; a null id counts as the empty text in the split.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from wattframe.llm import common as C

ORDERS = 3
BITS = 16
SAMPLE = 4_000
SCALE = 50.0
ALPHA, BETA, L1, L2 = 0.3, 0.1, 0.05, 1e-3
EPOCHS = 4
UNKNOWN = "und"

_LOWER = np.arange(1 << 16, dtype=np.uint32)
for _c in range(1 << 16):
    if len(_l := chr(_c).lower()) == 1 and ord(_l) < 1 << 16:
        _LOWER[_c] = ord(_l)


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text modulo ``of``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(of))


def grams(data: np.ndarray, off: np.ndarray):
    """For each order: the feature of every n-gram, and the texts' offsets among them."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    points = np.where(points < 1 << 16, _LOWER[np.minimum(points, (1 << 16) - 1)], points)
    lead = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    at = lead[off]
    h = np.zeros(len(points), np.uint32)
    for order in range(1, ORDERS + 1):
        if order > 1:
            h = h[:-1]
        if not len(h):
            break
        h = (h ^ points[order - 1 :]) * np.uint32(0x9E3779B1) + np.uint32(order)
        feature = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
        # N-grams across the end of a text are dropped.
        keep = np.ones(len(feature), bool)
        for j in range(1, order):
            border = at[1:-1] - j
            keep[border[(border >= 0) & (border < len(keep))]] = False
        count = np.maximum(np.diff(at) - order + 1, 0)
        yield feature[keep] if order > 1 else feature, np.append(0, np.cumsum(count))


def _frequencies(batches):
    """Documents of the partition that hold each feature."""
    df, mark, docs = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, bool), 0
    for _, data, off in C.chunked(batches):
        every = list(grams(data, off))
        docs += len(off) - 1
        for i in range(len(off) - 1):
            for feature, at in every:
                mark[feature[at[i] : at[i + 1]]] = True
            some = np.flatnonzero(mark)
            df[some] += 1
            mark[some] = False
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], docs))], ["feature", "n"])


def _counted(batches):
    """Features and counts of each text."""
    for rows, data, off in C.chunked(batches):
        every = list(grams(data, off))
        idx, n = [], []
        for i in range(len(off) - 1):
            f, c = np.unique(np.concatenate([x[at[i] : at[i + 1]] for x, at in every] or [np.zeros(0, np.uint32)]), return_counts=True)
            idx.append(f.astype(np.int32).tobytes())
            n.append(c.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [rows.column(rows.schema.get_field_index("lang")), rows.column(rows.schema.get_field_index("h")),
             pa.array(idx, pa.binary()), pa.array(n, pa.binary())], ["lang", "h", "features", "counts"])


def bounded(rows: DataFrame, by: str, key: str, total: int) -> DataFrame:
    """At most ``total`` rows, in equal parts per value of ``by``: those with the smallest ``key``.

    ``key`` is a hash, so a cut at a share of its range leaves little more than is wanted, and only
    that little is ranked.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    if not counts:
        return rows.limit(0)
    each = max(1, total // len(counts))
    low = F.lit(None).cast("double")
    for value, n in counts.items():
        low = F.when(F.col(by) == F.lit(value), F.lit(float(min(1.0, 1.5 * each / n + 50 / n)))).otherwise(low)
    share = F.col(key) / float(1 << 64) + 0.5
    nth = F.row_number().over(W.partitionBy(by).orderBy(key))
    return rows.where(share <= low).withColumn("_nth", nth).where(F.col("_nth") <= each).drop("_nth")


# --- fitting -----------------------------------------------------------------------------------


@dataclass
class Model:
    names: list[str]
    weights: np.ndarray  # features x languages, times inverse frequency and scale, over the temperature
    bias: np.ndarray


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases fitted by follow-the-regularised-leader, one document at a time.

    ``rows``: (class, features, values). Per coordinate z sums the gradients (corrected for the steps
    taken) and n their squares; the weight is the leader's: 0 while |z| <= L1, else shrunk by L1 and L2.
    """
    z, n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))

    def leader(z, n):
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for y, idx, x in rows:
            at, x = np.append(idx, features), np.append(x, 1.0)
            zi, ni = z[at], n[at]
            w = leader(zi, ni)
            p = _softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] = zi + g - step * w
            n[at] = ni + g * g
    w = leader(z, n)
    return w[:features], w[features]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least negative log likelihood (golden section)."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return -float(np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean())

    a, b, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(learn: DataFrame, sample: int = SAMPLE) -> Model:
    """``learn``: ``text, lang`` without nulls, and a hash ``h``."""
    counts = learn.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    features, n = counts.column(0).to_numpy(), counts.column(1).to_numpy()
    docs = int(n[features == -1].sum())
    df = np.zeros(1 << BITS)
    df[features[features >= 0]] = n[features >= 0]
    idf = np.log((1.0 + docs) / (1.0 + df)) + 1.0
    rows = bounded(learn, "lang", "h", sample).mapInArrow(
        _counted, "lang string, h long, features binary, counts binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["h"], r["lang"]))
    names = sorted({r["lang"] for r in rows}, key=str.encode)
    if not names:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0))
    made = []
    for r in rows:
        idx, c = np.frombuffer(r["features"], np.int32), np.frombuffer(r["counts"], np.float32).astype(np.float64)
        if len(idx):
            made.append((names.index(r["lang"]), idx, SCALE * c / c.sum() * idf[idx]))
    kept = [r for i, r in enumerate(made) if i % 5]
    out = [r for i, r in enumerate(made) if i % 5 == 0]
    w, b = follow(kept, len(names), 1 << BITS)
    logits = np.array([x @ w[idx] + b for _, idx, x in out]).reshape(len(out), len(names))
    t = temperature(logits, np.array([y for y, *_ in out], np.int64))
    return Model(names, w * (SCALE * idf)[:, None] / t, b / t)


# --- scoring -----------------------------------------------------------------------------------


def _scored(model):
    def run(batches):
        m: Model = model.value
        table = np.ascontiguousarray(m.weights.astype(np.float32))
        for rows, data, off in C.chunked(batches):
            docs = len(off) - 1
            col = {n: rows.column(i) for i, n in enumerate(rows.schema.names)}
            lettered = np.asarray(col["lettered"].to_numpy(zero_copy_only=False), bool)
            total, count = np.zeros((docs, len(m.names))), np.zeros(docs)
            for feature, at in grams(data, off) if len(m.names) else ():
                n = np.diff(at)
                some = np.flatnonzero(n)
                if len(some):
                    for k in range(len(m.names)):
                        total[some, k] += np.add.reduceat(table[:, k][feature], at[:-1][some], dtype=np.float64)
                count += n
            if len(m.names):
                p = _softmax(total / np.maximum(count, 1)[:, None] + m.bias)
                best = p.argmax(axis=1)
                name = [m.names[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
                score = np.where(lettered, p[np.arange(docs), best], 0.0)
            else:
                name, score = [UNKNOWN] * docs, np.zeros(docs)
            yield pa.RecordBatch.from_arrays(
                [col["doc_id"], col["held_out"], pa.array(name, pa.string()), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; ``docs`` with ``doc_id, text, held_out``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "held_out", F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return rows.mapInArrow(_scored(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learns from the documents that are not held out and predicts all."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).withColumn(
        "held_out", remainder(F.col("doc_id"), 4) == 2)
    learn = rows.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    return predict(rows, fit(learn, sample))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(C.load(spark, sf_dir, "documents"))
