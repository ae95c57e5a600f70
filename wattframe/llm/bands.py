"""Quality rules: compression bands after a few counted ones.

A text that repeats itself compresses too well, noise hardly at all. Texts are judged by the ratio of
their bytes to their zstandard frame, twice: as a whole, and cut into fixed chunks of ``CHUNK`` bytes
(the last one is what remains), so that a long text cannot hide a stretch of either kind. What ratio is
usual depends on the length, since a short text has little to refer back to; every length has its own
band, and whole texts and chunks are held against the band of their own length. A text is rejected if
its whole ratio leaves its band, or if more than ``SHARE`` percent of its bytes lie in chunks that leave
theirs. Before that the counted rules apply: at least ``LEAST_WORDS`` words, and at most
``REPEATED`` percent of the words in windows of ``WINDOW`` words that the text holds twice or more.

Everything is decided by a text alone, so documents are judged where they are read: one pass, no
shuffle, memory bounded by a batch of texts or the longest single one. Words and lines are told apart
by their bytes.

Defined cases: a null text counts as empty and fails the counted rules, as does any text without
words; its ratios are null. Texts and chunks shorter than the first band's length are not judged by
their ratio. Invalid numbers do not arise. Repeated rows are each judged; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattframe.llm import common as C

LEAST_WORDS = 20
WINDOW = 8
REPEATED = 30
LEVEL = 3
CHUNK = 4096
SHARE = 20
#: From so many bytes on: least and largest ratio.
BANDS = (
    (64, 0.8, 2.5),
    (256, 1.1, 3.0),
    (1_024, 1.3, 3.5),
    (4_096, 1.5, 4.0),
    (16_384, 1.6, 4.5),
    (65_536, 1.6, 5.0),
)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
VERDICT = "base_failed boolean, ratio double, chunk_share double, reason string, kept boolean"


def in_band(size: np.ndarray, ratio: np.ndarray, bands=BANDS) -> np.ndarray:
    """Whether texts of these sizes may have these ratios; true below the first band."""
    at = np.searchsorted([b[0] for b in bands], size, "right") - 1
    low, high = np.array([b[1:] for b in bands]).T[:, np.maximum(at, 0)]
    return (at < 0) | ((ratio >= low) & (ratio <= high))


def _compressed(press: zstandard.ZstdCompressor, text) -> int:
    return len(press.compress(text))


def chunk_share(press: zstandard.ZstdCompressor, text: bytes, chunk: int, bands) -> float:
    """Percentage of the bytes in chunks whose ratio leaves the band of their length."""
    view = memoryview(text)
    size = np.array([min(chunk, len(text) - at) for at in range(0, len(text), chunk)])
    packed = np.array([_compressed(press, view[at : at + chunk]) for at in range(0, len(text), chunk)])
    return float(100 * size[~in_band(size, size / packed, bands)].sum() / len(text))


def repeated_words(ids: np.ndarray, doc: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Which words lie in a window of ``width`` word numbers that its document holds twice or more.

    Windows get exact numbers by doubling: those of one word, of two, of four, and the last from two
    that overlap or touch.
    """
    out = np.zeros(len(ids), bool)
    if len(ids) < width:
        return out
    have, name = 1, np.unique(ids, return_inverse=True)[1].astype(np.int64)
    while have < width:
        step = min(have, width - have)
        left, right = name[: len(name) - step], name[step:]
        name = np.unique(left * (int(name.max()) + 1) + right, return_inverse=True)[1].astype(np.int64)
        have += step
    inside = np.flatnonzero(doc[: len(name)] == doc[width - 1 :])
    if not len(inside):
        return out
    pair = doc[inside] * (int(name.max()) + 1) + name[inside]
    _, back, times = np.unique(pair, return_inverse=True, return_counts=True)
    at = inside[times[back] > 1]
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return np.cumsum(cover)[:-1] > 0


def counted(data: np.ndarray, off: np.ndarray, texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Per text: words, code points in them, symbols, repeated lines, words in repeated windows."""
    vocabulary: dict[bytes, int] = {}
    number = vocabulary.setdefault
    ids, n_words, n_dup = [], [], []
    for text in texts:
        words = text.split()
        ids += [number(w, len(vocabulary)) for w in words]
        n_words.append(len(words))
        lines = [line for line in text.split(b"\n") if line.strip()]
        n_dup.append(len(lines) - len(set(lines)))
    doc = np.repeat(np.arange(len(texts)), n_words)
    repeats = np.bincount(doc[repeated_words(np.array(ids, np.int64), doc, window)], minlength=len(texts))

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[off])

    points = ((data & 0xC0) != 0x80) & ~C.space(data)
    return np.array(n_words, np.int64), per_text(points), per_text(_SYMBOLS[data]), np.array(n_dup, np.int64), repeats


def _judged(least_words: int, repeated: int, window: int, chunk: int, share: float, bands, level: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        for rows, data, off in C.chunked(batches):
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            counts = counted(data, off, texts, window)
            n, repeats = counts[0], counts[4]
            few, again = n < least_words, 100 * repeats > repeated * n
            ratio = [len(t) / _compressed(press, t) if t else None for t in texts]
            size = np.diff(off)
            whole = in_band(size, np.array([r or 0.0 for r in ratio]), bands)
            inner = [chunk_share(press, t, chunk, bands) if t else None for t in texts]
            off_band = np.array([x is not None and x > share for x in inner], bool)
            failed = few | again
            reason = np.select([few, again, ~whole, off_band], ["few_words", "repeated_words", "ratio", "chunks"], "")
            columns = [pa.array(c, pa.int64()) for c in counts]
            columns += [pa.array(failed), pa.array(ratio, pa.float64()), pa.array(inner, pa.float64()),
                        pa.array([r or None for r in reason.tolist()], pa.string()), pa.array(reason == "")]
            own = [rows.column(i) for i in range(rows.num_columns - 1)]
            names = rows.schema.names[:-1] + [c.split()[0] for c in f"{COUNTS}, {VERDICT}".split(", ")]
            yield pa.RecordBatch.from_arrays(own + columns, names)

    return run


def judge(
    docs: DataFrame, least_words: int = LEAST_WORDS, repeated: int = REPEATED, window: int = WINDOW, chunk: int = CHUNK,
    share: float = SHARE, bands: tuple = BANDS, level: int = LEVEL,
) -> DataFrame:
    """``doc_id``, the counts, ``base_failed, ratio, chunk_share, reason`` (of a rejection) and ``kept``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    run = _judged(least_words, repeated, window, chunk, share, bands, level)
    return rows.mapInArrow(run, f"doc_id long, {COUNTS}, {VERDICT}")


def passing(docs: DataFrame, **rules) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; ``rules`` as for ``judge``."""
    names, schema = docs.columns, docs.schema
    run = _judged(*({"least_words": LEAST_WORDS, "repeated": REPEATED, "window": WINDOW, "chunk": CHUNK, "share": SHARE,
                     "bands": BANDS, "level": LEVEL} | rules).values())

    def filtered(batches):
        for batch in batches:
            text = batch.column(names.index("text"))
            kept = [v.column(v.num_columns - 1) for v in run([pa.RecordBatch.from_arrays([text, text], ["own", "text"])])]
            if kept:
                yield batch.filter(pa.concat_arrays(kept))

    return docs.mapInArrow(filtered, schema)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(C.load(spark, sf_dir, "documents"))
