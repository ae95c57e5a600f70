"""Shared pieces: row keys, staged tables, flat byte buffers, word hashing and packed spans.

Texts reach Python as Arrow batches and are handled there as one flat byte buffer with document
offsets, cut at document borders into chunks of half a MB, so memory is bounded by the chunk or by
the longest single document. Everything a plan needs again is written to the shared folder and read
back: no task depends on the local disk of another executor.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattframe.session import materialise

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CHUNK = 1 << 19
#: Stands in for a null id inside joins and orders: nulls come first.
NO_ID = -(1 << 63)
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; workers that this session starts find this package wherever the driver runs."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [_ROOT])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and continues from there."""
    return materialise(df, f"llm-{name}")


def row_key() -> tuple[Column, Column]:
    """``k1, k2``: id and hash of the text; rows that agree in both are one document."""
    return (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k1"),
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("k2"))


def rows_of(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` (null: empty) and the row's key."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *row_key())


#: Keys of so large a part of all rows are looked up by broadcast: there are at most so many of them.
HOT_KEYS = 1_000


def looked_up(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the columns of ``table`` (a written one, a row per key), of which ``count`` says how
    many rows share the key. Keys that many rows share do not meet in one task."""
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) >= max(64, -(-total // HOT_KEYS))
    often = F.broadcast(table.where(hot))
    rest = rows.join(often.select(key), key, "left_anti").join(table.where(~hot), key)
    return rows.join(often, key).unionByName(rest)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- flat buffers ------------------------------------------------------------------------------


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or o[-1] == o[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def pieces(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of documents (from, to) of at most ``limit`` bytes, or one longer document."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def chunked(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple]:
    """(batch slice, bytes, offsets) for chunks of whole documents."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = flat(batch.column(batch.schema.get_field_index(text)))
        for a, b in pieces(off):
            yield batch.slice(a, b - a), data[off[a] : off[b]], off[a : b + 1] - off[a]


# --- hashing -----------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64; kept and doubled as needed."""
    key = f"{base:x}"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length() if n > 1 else 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK:
            _powers[key] = have
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums from which ``span`` gives the hash of any stretch; len + 1 entries."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_INVERSE, len(values)), out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], which depends on the values alone."""
    return (sums[end] - sums[start]) * _power(_BASE, len(sums))[start]


def every_span(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of each stretch of ``width`` values."""
    n = len(sums) - width
    return (sums[width:] - sums[:n]) * _power(_BASE, len(sums))[:n] if n > 0 else np.zeros(0, np.uint64)


def space(data: np.ndarray) -> np.ndarray:
    """Which bytes part words."""
    return _SPACE[data]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each document's word offsets."""
    sp = _SPACE[data]
    start = ~sp
    end = start.copy()
    start[1:] &= sp[:-1]
    end[:-1] &= sp[1:]
    inner = off[:-1][off[:-1] < off[1:]]
    start[inner] = ~sp[inner]
    last = inner[1:] - 1
    end[last] = ~sp[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def byte_hashes(data: np.ndarray) -> np.ndarray:
    return _BYTES[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A cheap polynomial; some long words share it, so it serves features only. Else use ``word_keys``."""
    sums = prefix(_BYTES[data])
    return mix(span(sums, starts, ends) + (ends - starts).astype(np.uint64))


_SEEDS = (0x2545F4914F6CDD1D, 0xDA942042E4DD58B5)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Words of more bytes are hashed one at a time.
_LONG_WORD = 64


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit keys of the words, independent for seeds 0 and 1.

    Eight bytes at a time are mixed into the key, so unlike a polynomial's its collisions follow no
    pattern of the bytes.
    """
    size = ends - starts
    key = mix(size.astype(np.uint64) * np.uint64(_BASE) + np.uint64(_SEEDS[seed]))
    padded = np.append(data, np.zeros(8, np.uint8))
    blocks = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    go, at = np.flatnonzero(size <= _LONG_WORD), 0
    while len(go):
        rest = size[go] - at
        block = blocks[starts[go] + at]
        last = rest < 8
        block[last] &= (np.uint64(1) << (8 * rest[last]).astype(np.uint64)) - np.uint64(1)
        key[go] = mix(key[go] ^ block)
        at += 8
        go = go[rest > 8]
    for i in np.flatnonzero(size > _LONG_WORD):
        key[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].data, _SEEDS[seed])
    return key


def window_keys(keys: np.ndarray, width: int) -> np.ndarray:
    """Key of each ``width`` consecutive keys, from those of its two halves, which overlap if they must."""
    out, have = keys, 1
    while have < width:
        step = min(have, width - have)
        n = len(out) - step
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = mix(mix(out[:n] + np.uint64(have)) + out[step:] * _STEP)
        have += step
    return out


def stretches(values: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start : start + size] of each, end to end."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts - (ends - size), size)]


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each different stretch and every stretch's number among these, told apart by bytes.

    The stretches come in order of their places.
    """
    size = ends - starts
    keys = np.zeros(len(starts), np.uint64)
    for a, b in pieces(np.append(0, np.cumsum(size))):
        keys[a:b] = word_keys(data[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a])
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    like = first[which]
    wrong = size != size[like]
    fine = np.flatnonzero(~wrong & (like != np.arange(len(like))))
    for a, b in pieces(np.append(0, np.cumsum(size[fine]))):
        at = fine[a:b]
        unequal = stretches(data, starts[at], size[at]) != stretches(data, starts[like[at]], size[at])
        if unequal.any():
            wrong[at[np.repeat(np.arange(len(at)), size[at])[unequal]]] = True
    names: dict[bytes, int] = {}
    more = []
    for i in np.flatnonzero(wrong):
        name = data[starts[i] : ends[i]].tobytes()
        if name not in names:
            names[name] = len(first) + len(more)
            more.append(i)
        which[i] = names[name]
    return np.append(first, np.array(more, first.dtype)), which


def window_mask(off: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the first n - width + 1 positions start a window inside one document."""
    ok = np.ones(max(0, n - width + 1), bool)
    for border in off[1:-1]:
        ok[max(0, border - width + 1) : border] = False
    return ok


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


_PLACE = np.uint64((1 << 31) - 1)


def anchors(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes, the position of its smallest, the leftmost on ties.

    Equal windows choose the same place within them, wherever they stand: the upper 33 bits of the
    hash decide, then the position (a text has less than 2^31 bytes).
    """
    if len(values) < width:
        return np.zeros(0, np.int64)
    keyed = (values & ~_PLACE) | np.arange(len(values), dtype=np.uint64)
    return (sliding_min(keyed, width) & _PLACE).astype(np.int64)


# --- packed spans ------------------------------------------------------------------------------


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as disjoint, maximal ones in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:], len(s)) - 1]


def mark_rows(k1: np.ndarray, k2: np.ndarray, start: np.ndarray, end: np.ndarray, parts: int) -> tuple[pa.Array, pa.Array]:
    """Columns ``part, marks``: the intervals of rows, packed by a hash of the row's key."""
    part = (mix(k1.astype(np.uint64) * np.uint64(_BASE) ^ k2.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    packs = []
    for a, b in zip(at, np.append(at[1:], len(order))):
        o = order[a:b]
        packs.append(b"".join([k1[o].astype(np.int64).tobytes(), k2[o].astype(np.int64).tobytes(),
                               start[o].astype(np.int32).tobytes(), end[o].astype(np.int32).tobytes()]))
    return pa.array(part[at], pa.int32()), pa.array(packs, pa.binary())


def _per_row(batches):
    held = [pack for batch in batches for pack in batch.column(1).to_pylist()]
    if not held:
        return
    cols = [[], [], [], []]
    for pack in held:
        n = len(pack) // 24
        for out, kind, at in zip(cols, (np.int64, np.int64, np.int32, np.int32), (0, 8 * n, 16 * n, 20 * n)):
            out.append(np.frombuffer(pack, kind, n, at))
    del held
    k1, k2, start, end = (np.concatenate(c) for c in cols)
    order = np.lexsort((start, k2, k1))
    k1, k2, start, end = k1[order], k2[order], start[order], end[order]
    new = np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))
    # Intervals of all rows on one line, a row's own after the one before it, merge at once.
    row = np.cumsum(new) - 1
    wide = int(end.max()) + 2
    s, e = merged(row * wide + start, row * wide + end)
    pairs = np.empty((len(s), 2), np.int32)
    pairs[:, 0], pairs[:, 1] = s % wide, (s % wide) + (e - s)
    cut = np.searchsorted(s // wide, np.arange(row[-1] + 2))
    heads = np.flatnonzero(new)
    raw = pairs.tobytes()
    for a in range(0, len(heads), 10_000):
        own = range(a, min(a + 10_000, len(heads)))
        h = heads[a : a + 10_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(k1[h]), pa.array(k2[h]), pa.array([raw[8 * cut[i] : 8 * cut[i + 1]] for i in own], pa.binary())],
            ["k1", "k2", "spans"],
        )


def gathered(marks: DataFrame, parts: int) -> DataFrame:
    """From ``part, marks``: one record ``k1, k2, spans`` per row, with its packed, merged intervals."""
    return marks.repartition(parts, "part").mapInArrow(_per_row, "k1 long, k2 long, spans binary")


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Every row with the ``spans`` found for its key, or null."""
    return rows.join(spans, ["k1", "k2"], "left")


def unpack(spans: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(spans or b"", np.int32).reshape(-1, 2).astype(np.int64)
    return pairs[:, 0], pairs[:, 1]


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
