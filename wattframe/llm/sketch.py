"""Count-min sketch of 64-bit items, merged from partition sketches.

Each partition counts its own items in ``ROWS`` hashed rows of ``2^bits`` cells
and sends every cell it touched once, by ranges of cells. One task per range adds the partitions'
counts as they stream in, so its memory is the range. What leaves the merge is one bit a cell:
whether it counted two or more. The estimate of an item is the least of its cells, so it never
falls below the true count: a repeated item is always found, a single one passes only if all its
cells are shared. Its size, 2^bits / 8 bytes a row (32 MB with the defaults), is fixed by the
parameter and does not grow with the data; a sketch that is too small costs time, never a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

BITS = 27
ROWS = 2
#: Cells are merged in so many ranges.
RANGES = 64
_RANGE_BITS = RANGES.bit_length() - 1
_FLUSH = 1 << 20
#: Counts stop here.
MOST = 30_000
_SALTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _cells(items: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((items * _SALTS[row]) >> np.uint64(64 - bits)).astype(np.uint32)


def _sent(items: np.ndarray, bits: int, exact: bool) -> Iterator[pa.RecordBatch]:
    """Cells touched once, cells touched more often and, if ``exact``, how often."""
    shift = np.uint32(bits - _RANGE_BITS)
    ranges, once, twice, times = [], [], [], []
    for row in range(ROWS):
        cells, counts = np.unique(_cells(items, row, bits), return_counts=True)
        many = counts > 1
        cuts = np.arange(RANGES + 1, dtype=np.uint64) << np.uint64(shift)
        at = np.searchsorted(cells[~many], cuts)
        once += [cells[~many][a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
        at = np.searchsorted(cells[many], cuts)
        twice += [cells[many][a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
        times += [counts[many][a:b].astype(np.uint32).tobytes() if exact else b"" for a, b in zip(at[:-1], at[1:])]
        ranges += [row * RANGES + g for g in range(RANGES)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(ranges, pa.int32()), *(pa.array(x, pa.binary()) for x in (once, twice, times))],
        ["range", "once", "twice", "times"],
    )


Items = Callable[[Iterable[pa.RecordBatch]], Iterator[np.ndarray]]


def _counted(
    df: DataFrame, items: Items, bits: int, exact: bool, result: Callable[[np.ndarray], np.ndarray]
) -> list[tuple[int, bytes]]:
    """Per range of cells: what ``result`` makes of its merged counts (up to two unless ``exact``)."""

    def count(batches):
        held, n = [], 0
        for x in items(batches):
            held.append(x)
            n += len(x)
            if n >= _FLUSH:
                yield from _sent(np.concatenate(held), bits, exact)
                held, n = [], 0
        if n:
            yield from _sent(np.concatenate(held), bits, exact)

    def add(batches):
        size = 1 << (bits - _RANGE_BITS)
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, once, twice, times in zip(*(batch.column(i).to_pylist() for i in range(4))):
                counts = seen.setdefault(g, np.zeros(size, np.uint16))
                one = np.frombuffer(once, np.uint32) & np.uint32(size - 1)
                counts[one] = np.minimum(counts[one] + 1, MOST)
                many = np.frombuffer(twice, np.uint32) & np.uint32(size - 1)
                counts[many] = np.minimum(counts[many] + (np.frombuffer(times, np.uint32) if exact else 2), MOST)
        for g, counts in seen.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([g], pa.int32()), pa.array([result(counts).tobytes()], pa.binary())], ["range", "result"])

    spark: SparkSession = df.sparkSession
    parts = df.mapInArrow(count, "range int, once binary, twice binary, times binary")
    tasks = min(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    merged = parts.repartition(tasks, "range").mapInArrow(add, "range int, result binary").toArrow()
    return list(zip(merged.column(0).to_pylist(), merged.column(1).to_pylist()))


def build(df: DataFrame, items: Items, bits: int = BITS) -> Broadcast:
    """The merged sketch of what ``items`` yields from each partition of ``df``, for ``repeated``."""
    table = np.zeros((ROWS * RANGES, (1 << (bits - _RANGE_BITS)) // 8), np.uint8)
    for g, packed in _counted(df, items, bits, False, lambda counts: np.packbits(counts > 1)):
        table[g] = np.frombuffer(packed, np.uint8)
    return df.sparkSession.sparkContext.broadcast(table.reshape(ROWS, -1))


#: A hot cell holds so many times the mean of its range. At most one cell in so many can.
ABOVE = 32


def _hot_cells(counts: np.ndarray, least: int) -> np.ndarray:
    """Cells of a range that count ``least`` or more and stand out from the range's mean load."""
    return np.flatnonzero(counts >= max(least, ABOVE * float(counts.mean()))).astype(np.uint32)


def build_hot(df: DataFrame, items: Items, least: int, bits: int = BITS) -> Broadcast:
    """Per row the sorted cells of ``least`` items or more, for ``hot``.

    Where so many items share the cells that chance alone brings ``least`` together, a cell must exceed the
    mean load ``ABOVE`` times, so the list holds one cell in ``ABOVE`` at most (32 MB with the defaults)
    however large the table is, and chance makes nothing hot.
    """
    rows: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
    for g, packed in _counted(df, items, bits, True, lambda counts: _hot_cells(counts, least)):
        first = np.uint32((g % RANGES) << (bits - _RANGE_BITS))
        rows[g // RANGES].append(np.frombuffer(packed, np.uint32) + first)
    cells = [np.sort(np.concatenate(r)) if r else np.zeros(0, np.uint32) for r in rows]
    return df.sparkSession.sparkContext.broadcast((bits, cells))


def hot(table: tuple[int, list[np.ndarray]], items: np.ndarray) -> np.ndarray:
    """Which items the sketch estimates at the number ``build_hot`` was given, or more."""
    bits, rows = table
    out = np.zeros(len(items), bool)
    if any(not len(r) for r in rows):
        return out
    # A small map of the cells' upper bits leaves few items to look up.
    near = np.zeros(1 << 16, bool)
    near[rows[0] >> np.uint32(max(bits - 16, 0))] = True
    at = np.flatnonzero(near[_cells(items, 0, bits) >> np.uint32(max(bits - 16, 0))])
    for row, cells in enumerate(rows):
        c = _cells(items[at], row, bits)
        at = at[cells[np.minimum(np.searchsorted(cells, c), len(cells) - 1)] == c]
    out[at] = True
    return out


def repeated(table: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Which items the sketch estimates at two or more."""
    bits = table.shape[1].bit_length() + 2
    out = np.ones(len(items), bool)
    for row in range(ROWS):
        c = _cells(items, row, bits)
        out &= (table[row][c >> np.uint32(3)] >> (7 - (c & np.uint32(7))).astype(np.uint8)) & 1 == 1
    return out
