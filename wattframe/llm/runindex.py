"""Exact byte-substring deduplication with a run-length Burrows-Wheeler index.

Every byte covered by a ``width``-byte string that also starts anywhere else goes, all copies
included.

1. Candidates. Each window is represented by its smallest hashed ``GRAM``-byte string (its anchor).
   A first count-min sketch finds anchors in very many places (a line that a third of the documents
   share, say); these come last in the order, so the windows around such a line go by their own text
   and do not meet in one group. A second one drops the windows whose anchor occurs once. What remains is
   cut into pieces, one per anchor: the stretch of text that its windows cover. Pieces of one anchor
   meet in one bucket, equal pieces of a partition travel once with their places.
2. Index. The different pieces of a bucket are sorted into a Burrows-Wheeler transform, of which only
   the ends of its runs are kept, each with its place in the text, its neighbour's place and their
   common length. Matching statistics are then streamed along the text from one sampled place to the
   next: within a run the neighbour moves along with the text and the common length falls by one, so
   the samples give every position's longest match elsewhere. Matches of ``width`` bytes mark.
   A piece that was sent more than once is repeated as a whole.
3. Marks return to their documents by key; the remaining bytes are joined.

The index of a bucket holds its different pieces only (copies are counted, not stored), so a text
copied a thousand times costs what it costs once. Buckets follow the number of shuffle partitions.

Defined cases: null text is empty; texts shorter than ``width`` keep everything; repeated rows (same
id and text) are copies of each other like any other two documents; null ids are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wattframe.llm import common as C, sketch

WIDTH = 200
GRAM = 32
#: Anchors with so many places or more are given up where a window has another gram.
HOT = 1_024
_FLUSH = 16 << 20
_INDEX = 1 << 20
_MARKS = 1 << 19


# --- the index ---------------------------------------------------------------------------------


@dataclass
class RunIndex:
    """The runs of the transform of several texts laid end to end.

    ``first_at, first_len``: text places at the heads of runs in order, and the common length with the
    suffix before. ``last_at, last_len``: the same at the ends of runs, with the suffix after.
    """

    size: int
    runs: int
    first_at: np.ndarray
    first_len: np.ndarray
    last_at: np.ndarray
    last_len: np.ndarray

    def matching_lengths(self) -> np.ndarray:
        """For each place, the longest match with any other place, streamed from the samples."""
        out = np.zeros(self.size, np.int64)
        place = np.arange(self.size, dtype=np.int64)
        for at, length in ((self.first_at, self.first_len), (self.last_at, self.last_len)):
            sample = np.searchsorted(at, place, "right") - 1
            np.maximum(out, length[sample] - (place - at[sample]), out=out)
        return out


def _levels(text: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix order, and the ranks of all places by their first 7, 14, 28, ... bytes (short ones padded)."""
    n, longest = len(text), int(rest.max())
    key = np.zeros(n, np.uint64)
    for j in range(7):
        key <<= np.uint64(9)
        key[: n - j] |= np.where(rest[: n - j] > j, text[j:].astype(np.uint64) + np.uint64(1), np.uint64(0))
    order = np.argsort(key, kind="stable")
    levels, depth = [], 7
    while True:
        new = np.ones(n, bool)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(new)
        levels.append((depth, rank))
        if depth >= longest or new.all():
            return order, levels
        tail = np.zeros(n, np.int64)
        tail[: n - depth] = np.where(rest[: n - depth] > depth, rank[depth:], 0)
        key = (rank.astype(np.int64) << 32) | tail
        # Only places that are still tied need sorting again.
        tied = np.zeros(n, bool)
        tied[1:] |= ~new[1:]
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        some = order[at]
        order[at] = some[np.argsort(key[some], kind="stable")]
        depth *= 2


def _common(a, b, text, rest, levels) -> np.ndarray:
    """Length of the common start of the suffixes at a and b."""
    n = len(text)
    most = np.minimum(rest[a], rest[b])
    out = np.zeros(len(a), np.int64)
    for depth, rank in reversed(levels):
        while True:
            go = np.flatnonzero(out + depth <= most)
            x, y = a[go] + out[go], b[go] + out[go]
            same = go[rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]]
            if not len(same):
                break
            out[same] += depth
    for _ in range(6):
        go = np.flatnonzero(out < most)
        same = go[text[a[go] + out[go]] == text[b[go] + out[go]]]
        stuck = np.setdiff1d(go, same, assume_unique=True)
        out[same] += 1
        most[stuck] = out[stuck]
    return out


def build(texts: list[bytes]) -> RunIndex:
    """Index of the texts; equal suffixes of different texts are ordered by their text."""
    text = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    n = len(text)
    rest = np.repeat(ends, lengths) - np.arange(n)
    order, levels = _levels(text, rest)
    before = np.empty(n, np.int64)
    before[1:] = text[:-1]
    heads = ends - lengths
    before[heads] = 256 + np.arange(len(texts))  # no text runs on into the one before
    bwt = before[order]
    new = np.ones(n, bool)
    new[1:] = bwt[1:] != bwt[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    head, tail = order[first], order[last]
    head_len, tail_len = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    # The end of one run and the head of the next are neighbours: one common length serves both.
    both = _common(tail[:-1], head[1:], text, rest, levels)
    head_len[1:], tail_len[:-1] = both, both
    f, l = np.argsort(head), np.argsort(tail)
    return RunIndex(n, len(first), head[f], head_len[f], tail[l], tail_len[l])


# --- candidates --------------------------------------------------------------------------------


def _windows(data: np.ndarray, off: np.ndarray, width: int, often=None):
    """Per stretch of windows with one anchor: the anchor's hash, the bytes covered, the document.

    Grams that ``often`` knows as hot are taken only where a window has no other.
    """
    gram = min(GRAM, width)
    if len(data) < width:
        return None
    grams = C.mix(C.every_span(C.prefix(C.byte_hashes(data)), gram))
    order = grams >> np.uint64(1)
    if often is not None:
        order |= sketch.hot(often, grams).astype(np.uint64) << np.uint64(63)
    anchor = C.anchors(order, width - gram + 1)
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    # A stretch of windows ends where the anchor changes or the document does.
    doc_last = off[1:] - width
    mask = np.zeros(len(anchor) + 1, bool)
    mask[:-1] = new
    heads = off[:-1][doc_last >= off[:-1]]
    mask[heads] = True
    mask[np.minimum(doc_last[doc_last >= off[:-1]] + 1, len(anchor))] = True
    at = np.flatnonzero(mask)
    start, end = at[:-1], at[1:]
    doc = np.searchsorted(off, start, "right") - 1
    ok = end + width - 1 <= off[doc + 1]
    start, end, doc = start[ok], end[ok], doc[ok]
    return grams[anchor[start]], start, end + width - 1, doc


def _items(width: int, often=None):
    def run(batches):
        for _, data, off in C.chunked(batches):
            got = _windows(data, off, width, often and often.value)
            if got and len(got[0]):
                yield got[0]

    return run


def _pack(found: dict, k1: np.ndarray, k2: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Per bucket: its pieces with their anchors, and the place of each, -1 for those sent as repeated."""
    by: dict[int, list] = {}
    for (anchor, piece), places in found.items():
        by.setdefault(anchor % buckets, []).append((anchor, piece, places[0] if len(places) == 1 else (-1, 0)))
    for bucket, own in by.items():
        place = np.array([p for *_, p in own], np.int64)
        docs, ref = np.unique(place[:, 0], return_inverse=True)
        known = docs >= 0
        yield bucket, b"".join([
            np.array([len(own), len(docs)], np.int64).tobytes(),
            np.fromiter((a for a, *_ in own), np.uint64, len(own)).tobytes(),
            np.fromiter((len(p) for _, p, _ in own), np.int64, len(own)).tobytes(),
            np.where(known, k1[docs], 0).tobytes(), np.where(known, k2[docs], 0).tobytes(),
            np.where(place[:, 0] < 0, -1, ref).astype(np.int32).tobytes(), place[:, 1].astype(np.int32).tobytes(),
            *(p for _, p, _ in own),
        ])


def _unpacked(pack: bytes):
    n, d = np.frombuffer(pack, np.int64, 2)
    at, out = 16, []
    for kind, size in ((np.uint64, n), (np.int64, n), (np.int64, d), (np.int64, d), (np.int32, n), (np.int32, n)):
        out.append(np.frombuffer(pack, kind, size, at))
        at += out[-1].nbytes
    anchor, length, k1, k2, ref, start = out
    cut = np.cumsum(np.append(at, length))
    texts = [pack[a:b] for a, b in zip(cut[:-1], cut[1:])]
    return anchor.tolist(), texts, ref >= 0, k1[ref], k2[ref], start.astype(np.int64)


def _candidates(table, often, width: int, buckets: int, parts: int):
    names = ["bucket", "part", "pack"]

    def flush(found, keys):
        k1, k2 = (np.concatenate([k[i] for k in keys]) for i in (0, 1))
        # Pieces seen twice here are repeated: their places are marked and need not travel.
        twice = [(d, p, p + len(piece)) for (_, piece), places in found.items() if len(places) > 1 for d, p in places]
        if twice:
            doc, start, end = np.array(twice, np.int64).T
            part, pack = C.mark_rows(k1[doc], k2[doc], start, end, parts)
            yield pa.RecordBatch.from_arrays([part, part, pack], names)
        packs = list(_pack(found, k1, k2, buckets))
        yield pa.RecordBatch.from_arrays(
            [pa.array([b for b, _ in packs], pa.int32()), pa.nulls(len(packs), pa.int32()),
             pa.array([p for _, p in packs], pa.binary())], names)

    def run(batches):
        found, keys, docs, held = {}, [], 0, 0
        for rows, data, off in C.chunked(batches):
            got = _windows(data, off, width, often.value)
            if not got:
                continue
            anchor, start, end, doc = got
            seen = np.flatnonzero(sketch.repeated(table.value, anchor))
            if not len(seen):
                continue
            keys.append([rows.column(rows.schema.get_field_index(k)).to_numpy() for k in ("k1", "k2")])
            buffer = data.tobytes()
            place = start[seen] - off[doc[seen]]
            for a, s, e, d, p in zip(*(x.tolist() for x in (anchor[seen], start[seen], end[seen], doc[seen] + docs, place))):
                places = found.setdefault((a, buffer[s:e]), [])
                held += 120 if places else 300 + e - s
                places.append((d, p))
            docs += rows.num_rows
            if held >= _FLUSH:
                yield from flush(found, keys)
                found, keys, docs, held = {}, [], 0, 0
        if found:
            yield from flush(found, keys)

    return run


def _batches(pieces: np.ndarray, anchor: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Cuts pieces, sorted by anchor, into indexes of about ``_INDEX`` bytes; an anchor stays whole."""
    if not len(pieces):
        return
    own = anchor[pieces]
    head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    size = np.add.reduceat(lengths[pieces], head)
    number = (np.cumsum(size) - size) // _INDEX
    cut = np.append(head[np.append(True, number[1:] != number[:-1])], len(pieces))
    for a, b in zip(cut[:-1], cut[1:]):
        yield pieces[a:b]


def _indexed(width: int, parts: int):
    """Marks the repeated stretches of each bucket's pieces at all their places."""

    def close(packs):
        number: dict[tuple[int, bytes], int] = {}
        piece, single, k1, k2, start = [], [], [], [], []
        for pack in packs:
            anchors, texts, one, a, b, s = _unpacked(pack)
            piece.append(np.fromiter((number.setdefault(x, len(number)) for x in zip(anchors, texts)), np.int64, len(texts)))
            single.append(one), k1.append(a), k2.append(b), start.append(s)
        piece, single, k1, k2, start = (np.concatenate(x) for x in (piece, single, k1, k2, start))
        many = np.bincount(piece, np.where(single, 1, 2), minlength=len(number)) > 1
        piece, k1, k2, start = (x[single] for x in (piece, k1, k2, start))
        anchor = np.fromiter((a for a, _ in number), np.uint64, len(number))
        texts = [t for _, t in number]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        by = np.argsort(anchor, kind="stable")
        group = np.cumsum(np.append(True, anchor[by][1:] != anchor[by][:-1])) - 1
        shared = by[np.bincount(group)[group] > 1]
        # Stretches as (piece, from, to): all of a piece sent twice, else what the index finds.
        own, lo, hi = [np.flatnonzero(many)], [np.zeros(int(many.sum()), np.int64)], [lengths[many]]
        for some in _batches(shared, anchor, lengths):
            index = build([texts[i] for i in some])
            at = np.flatnonzero(index.matching_lengths() >= width)
            if not len(at):
                continue
            ends = np.cumsum(lengths[some])
            which = np.searchsorted(ends, at, "right")
            offset = at - (ends - lengths[some])[which]
            h = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (np.diff(which) > 0)))
            t = np.append(h[1:], len(at)) - 1
            own.append(some[which[h]]), lo.append(offset[h]), hi.append(offset[t] + width)
        own, lo, hi = (np.concatenate(x) for x in (own, lo, hi))
        by = np.argsort(own, kind="stable")
        own, lo, hi = own[by], lo[by], hi[by]
        a, b = np.searchsorted(own, piece, "left"), np.searchsorted(own, piece, "right")
        times = b - a
        place = np.repeat(np.arange(len(piece)), times)
        stretch = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(a, times)
        return k1[place], k2[place], start[place] + lo[stretch], start[place] + hi[stretch]

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
                    if n >= _MARKS:
                        yield pa.RecordBatch.from_arrays([*C.mark_rows(*map(np.concatenate, zip(*held)), parts)], names)
                        held, n = [], 0
                bucket = b
                packs.append(pack)
        if packs:
            held.append(close(packs))
        if held:
            yield pa.RecordBatch.from_arrays([*C.mark_rows(*map(np.concatenate, zip(*held)), parts)], names)

    return run


def marks(docs: DataFrame, width: int = WIDTH, bits: int = sketch.BITS, hot: int = HOT) -> DataFrame:
    """``k1, k2, spans``: packed byte intervals that go."""
    rows = C.rows_of(docs).select("k1", "k2", "text")
    often = sketch.build_hot(rows.select("text"), _items(width), hot, bits)
    table = sketch.build(rows.select("text"), _items(width, often), bits)
    parts = C.partitions(docs.sparkSession)
    sent = rows.mapInArrow(_candidates(table, often, width, 4 * parts, parts), "bucket int, part int, pack binary")
    found = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(
        _indexed(width, parts), "part int, marks binary")
    return C.gathered(found, parts)


def _kept(text: bytes, spans) -> tuple[int, int, bytes]:
    s, e = C.unpack(spans)
    if not len(s):
        return 0, 0, text
    cut, at = [], 0
    for a, b in zip(s.tolist(), e.tolist()):
        cut.append(text[at:a])
        at = b
    cut.append(text[at:])
    return int((e - s).sum()), len(s), b"".join(cut)


def _result(contents: bool):
    def run(batches):
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            texts = col["text"].cast(pa.binary()).to_pylist()
            got = [_kept(t, s) for t, s in zip(texts, col["spans"].to_pylist())]
            last = pa.array([g[2] for g in got], pa.binary()) if contents else pa.array(
                [hashlib.sha256(g[2]).hexdigest() for g in got], pa.string())
            yield pa.RecordBatch.from_arrays(
                [col["doc_id"], pa.array([len(t) for t in texts], pa.int64()), pa.array([g[0] for g in got], pa.int64()),
                 pa.array([g[1] for g in got], pa.int64()), last],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if contents else "kept_sha256"],
            )

    return run


def deduplicate(
    docs: DataFrame, width: int = WIDTH, bits: int = sketch.BITS, contents: bool = True, hot: int = HOT
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans`` and the remaining bytes (``kept``) or their digest."""
    rows = C.with_spans(C.rows_of(docs), marks(docs, width, bits, hot)).select("doc_id", "text", "spans")
    last = "kept binary" if contents else "kept_sha256 string"
    return rows.mapInArrow(_result(contents), f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(C.load(spark, sf_dir, "documents"), contents=False)


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), win AS (
  SELECT doc_id, s, md5(substr(h, (2 * s + 1)::BIGINT, {2 * WIDTH})) AS k
  FROM (SELECT doc_id, h, unnest(range(0, n - {WIDTH - 1})) AS s FROM d)
), marked AS (
  SELECT doc_id, s FROM win QUALIFY count(*) OVER (PARTITION BY k) > 1
), spans AS (
  SELECT doc_id, min(s) AS a, max(s) + {WIDTH} AS b FROM (
    SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (
      SELECT doc_id, s, (s > coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {WIDTH}, -1))::INT AS new FROM marked))
  GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM spans
), cut AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last,
    string_agg(substr(h, (2 * last + 1)::BIGINT, (2 * (a - last))::BIGINT), '' ORDER BY a) AS head
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
