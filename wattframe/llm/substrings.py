"""Substring deduplication on word windows with a count-min prefilter.

A window is ``width`` consecutive words of one document. Every word covered by a window whose word
sequence also starts earlier (smaller ``doc_id``, or the same document further left) goes.

1. Each window is represented by its smallest hashed ``GRAM``-gram, so that neighbouring windows
   share one and equal windows agree. Partition sketches count these and are merged: the estimate
   is never below the count of any window they stand for.
2. A second pass over the texts keeps the windows estimated as repeated. A partition drops what it
   has itself seen earlier, and sends each different window once, with its earliest place, to the
   window's bucket; there windows are grouped by two independent 64-bit keys of their words and all but
   the earliest place are marked.
3. Marks return to their documents by key and the kept words are joined.

Defined cases: null text has no words; fewer words than ``width`` keep everything; repeated rows
(same id and text) are one document and get the same result; rows that share an id with different
texts are ordered by a hash of the text; a null id comes before all others.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattframe.llm import common as C, sketch

WIDTH = 20
GRAM = 8
_FLUSH = 1 << 19


def _grams(data: np.ndarray, off: np.ndarray, width: int):
    """Words (key, start, end), gram keys, valid windows and each one's anchor, of one chunk."""
    starts, ends, words = C.word_spans(data, off)
    if len(starts) < width:
        return None
    wh = C.word_keys(data, starts, ends)
    gram = min(GRAM, width)
    grams = C.window_keys(wh, gram)
    valid = np.flatnonzero(C.window_mask(words, width, len(wh)))
    anchor = C.anchors(grams, width - gram + 1)[valid]
    return (wh, starts, ends), words, grams, valid, anchor


def _items(width: int):
    def run(batches):
        for _, data, off in C.chunked(batches):
            got = _grams(data, off, width)
            if got and len(got[4]):
                anchor = got[4]
                new = np.ones(len(anchor), bool)
                new[1:] = anchor[1:] != anchor[:-1]
                yield got[2][anchor[new]]

    return run


def _first(h1, h2, k1, k2, start):
    """Order of the windows, group number along it, and whether each stands at its group's first place."""
    order = np.lexsort((start, k2, k1, h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    same = (k1[order] == k1[head]) & (k2[order] == k2[head]) & (start[order] == start[head])
    return order, new, same


def _sent(h1, h2, doc, start, k1, k2, buckets: int, parts: int, width: int) -> Iterator[pa.RecordBatch]:
    """Marks known already (with their ``part``), and each different window once, by bucket."""
    names = ["bucket", "part", "pack"]
    order, new, same = _first(h1, h2, k1[doc], k2[doc], start)
    later = order[~same]
    if len(later):
        part, pack = C.mark_rows(k1[doc[later]], k2[doc[later]], start[later], start[later] + width, parts)
        yield pa.RecordBatch.from_arrays([part, part, pack], names)
    first = order[new]
    bucket = (h1[first] % np.uint64(buckets)).astype(np.int32)
    by = np.argsort(bucket, kind="stable")
    first, bucket = first[by], bucket[by]
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    packs = []
    for a, b in zip(at, np.append(at[1:], len(first))):
        w = first[a:b]
        docs, ref = np.unique(doc[w], return_inverse=True)
        packs.append(b"".join([
            np.array([len(w), len(docs)], np.int64).tobytes(), k1[docs].tobytes(), k2[docs].tobytes(),
            h1[w].tobytes(), h2[w].tobytes(), ref.astype(np.int32).tobytes(), start[w].astype(np.int32).tobytes(),
        ]))
    yield pa.RecordBatch.from_arrays(
        [pa.array(bucket[at]), pa.nulls(len(packs), pa.int32()), pa.array(packs, pa.binary())], names)


def _candidates(table, width: int, buckets: int, marks: int):
    def run(batches):
        held, n = [], 0
        for rows, data, off in C.chunked(batches):
            got = _grams(data, off, width)
            if not got or not len(got[4]):
                continue
            (wh, starts, ends), words, grams, valid, anchor = got
            new = np.ones(len(anchor), bool)
            new[1:] = anchor[1:] != anchor[:-1]
            seen = sketch.repeated(table.value, grams[anchor[new]])
            w = valid[seen[np.cumsum(new) - 1]]
            if not len(w):
                continue
            h1 = C.window_keys(wh, width)[w]
            h2 = C.window_keys(C.word_keys(data, starts, ends, 1), width)[w]
            doc = np.searchsorted(words, w, "right") - 1
            k1, k2 = (rows.column(rows.schema.get_field_index(k)).to_numpy() for k in ("k1", "k2"))
            held.append((h1, h2, doc, w - words[doc], k1, k2))
            n += len(w)
            if n >= _FLUSH:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    def flush(held):
        base = np.cumsum([0] + [len(x[4]) for x in held])
        columns = [np.concatenate([x[i] + base[j] if i == 2 else x[i] for j, x in enumerate(held)]) for i in range(6)]
        yield from _sent(*columns, buckets, marks, width)

    return run


def _unpacked(pack: bytes):
    n, d = np.frombuffer(pack, np.int64, 2)
    at, out = 16, []
    for kind, size in ((np.int64, d), (np.int64, d), (np.uint64, n), (np.uint64, n), (np.int32, n), (np.int32, n)):
        out.append(np.frombuffer(pack, kind, size, at))
        at += out[-1].nbytes
    k1, k2, h1, h2, ref, start = out
    return h1, h2, k1[ref], k2[ref], start.astype(np.int64)


def _grouped(width: int, parts: int):
    """Marks all but the earliest place of each window of a bucket; passes marks through."""

    def close(packs):
        h1, h2, k1, k2, start = (np.concatenate(x) for x in zip(*map(_unpacked, packs)))
        order = np.argsort(h1)
        same = h1[order][1:] == h1[order][:-1]
        some = np.zeros(len(order), bool)
        some[1:] |= same
        some[:-1] |= same
        at = order[some]
        h1, h2, k1, k2, start = (x[at] for x in (h1, h2, k1, k2, start))
        order, _, first = _first(h1, h2, k1, k2, start)
        later = order[~first]
        return k1[later], k2[later], start[later], start[later] + width

    def run(batches):
        bucket, packs, held, n = None, [], [], 0
        names = ["part", "marks"]
        for batch in batches:
            known = batch.filter(batch.column(1).is_valid())
            if known.num_rows:
                yield pa.RecordBatch.from_arrays(known.columns[1:], names)
            rest = batch.filter(batch.column(1).is_null())
            for b, pack in zip(rest.column(0).to_pylist(), rest.column(2).to_pylist()):
                if b != bucket and packs:
                    held.append(close(packs))
                    n += len(held[-1][0])
                    packs = []
                    if n >= _FLUSH:
                        yield pa.RecordBatch.from_arrays([*C.mark_rows(*map(np.concatenate, zip(*held)), parts)], names)
                        held, n = [], 0
                bucket = b
                packs.append(pack)
        if packs:
            held.append(close(packs))
        if held:
            yield pa.RecordBatch.from_arrays([*C.mark_rows(*map(np.concatenate, zip(*held)), parts)], names)

    return run


def marks(docs: DataFrame, width: int = WIDTH, bits: int = sketch.BITS) -> DataFrame:
    """``k1, k2, spans``: packed word intervals that go."""
    rows = C.rows_of(docs).select("k1", "k2", "text")
    table = sketch.build(rows.select("text"), _items(width), bits)
    parts = C.partitions(docs.sparkSession)
    sent = rows.mapInArrow(_candidates(table, width, 4 * parts, parts), "bucket int, part int, pack binary")
    found = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(
        _grouped(width, parts), "part int, marks binary")
    return C.gathered(found, parts)


def _kept(text: bytes, spans) -> tuple[int, int, bytes]:
    """Number of words, of removed words, and the kept words joined by one space."""
    words = text.split()
    s, e = C.unpack(spans)
    removed = int((e - s).sum())
    if removed:
        keep = np.ones(len(words), bool)
        for a, b in zip(s, e):
            keep[a:b] = False
        kept = b" ".join([words[i] for i in np.flatnonzero(keep)])
    else:
        kept = b" ".join(words)
    return len(words), removed, kept


def _result(texts: bool):
    def run(batches):
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            got = [_kept(t, s) for t, s in zip(col["text"].cast(pa.binary()).to_pylist(), col["spans"].to_pylist())]
            last = [t for *_, t in got] if texts else [hashlib.sha256(t).hexdigest() for *_, t in got]
            yield pa.RecordBatch.from_arrays(
                [col["doc_id"], pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()),
                 pa.array(last, pa.binary()).cast(pa.string()) if texts else pa.array(last, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept" if texts else "kept_sha256"],
            )

    return run


def deduplicate(docs: DataFrame, width: int = WIDTH, bits: int = sketch.BITS, texts: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed`` and the kept text (``kept``) or its digest (``kept_sha256``)."""
    rows = C.with_spans(C.rows_of(docs), marks(docs, width, bits)).select("doc_id", "text", "spans")
    last = "kept" if texts else "kept_sha256"
    return rows.mapInArrow(_result(texts), f"doc_id long, n_words long, n_removed long, {last} string")


_WORDS = re.compile(C.WORD.encode())


def _cut(text: bytes, spans: bytes | None) -> bytes:
    """The text without its marked words and the space after them; the rest as it was."""
    s, e = C.unpack(spans)
    if not len(s):
        return text
    at = [m.start() for m in _WORDS.finditer(text)] + [len(text)]
    out, last = [], 0
    for a, b in zip(s.tolist(), e.tolist()):
        out.append(text[last : at[a]])
        last = at[b]
    return b"".join([*out, text[last:]])


def cleaned(docs: DataFrame, width: int = WIDTH, bits: int = sketch.BITS) -> DataFrame:
    """``docs`` with all its rows and columns, its texts without their repeated windows."""
    at, names = docs.columns.index("text"), docs.columns
    rows = docs.select(F.struct(*names).alias("row"), *C.row_key())
    rows = C.with_spans(rows, marks(docs, width, bits)).select("row", "spans")

    def run(batches):
        for batch in batches:
            columns = batch.column(0).flatten()
            texts = columns[at]
            raw = [t if t is None else _cut(t, s) for t, s in zip(texts.cast(pa.binary()).to_pylist(), batch.column(1).to_pylist())]
            columns[at] = pa.array(raw, pa.binary()).cast(texts.type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, docs.schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(C.load(spark, sf_dir, "documents"), texts=False)


ORACLE_SQL = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{C.WORD}') AS ws FROM documents
), win AS (
  SELECT doc_id, s, array_to_string(ws[s : s + {WIDTH - 1}], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WIDTH - 2})) AS s FROM w)
), marked AS (
  SELECT doc_id, s FROM win
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + {WIDTH})) AS i FROM marked),
kept AS (
  SELECT p.doc_id, count(g.i) AS n_removed, string_agg(p.word, ' ' ORDER BY p.i) FILTER (g.i IS NULL) AS kept
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w) p
  LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
