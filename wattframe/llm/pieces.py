"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The normalised text (spaces become U+2581, one is put in front) splits into words, a run of U+2581
with the characters up to the next one: no piece of the vocabulary reaches across such a border, so
words merge independently. The different words of a chunk, told apart by their bytes, are laid out as
one flat array of symbols with the number of their word. A round

* looks up the rank of every adjacent pair within a word,
* takes each word's smallest rank (a segmented minimum),
* merges all its occurrences in the word at once, leftmost first where they overlap,
* compacts the array,

until no word has a pair left. The library merges one pair at a time; merging equal pairs together
can only differ if a new pair beats or equals the one just merged while another occurrence of it was
still to come. Words where that happens, and words of over ``LONG`` symbols, where rounds would be
many, are merged one pair at a time from a queue, so the ids are always the library's.

Decoding goes the same way back: each piece's bytes are gathered into one flat buffer by its id,
U+2581 becomes a space, byte pieces become their byte, the space put in front goes; bytes that are
not valid UTF-8 turn into U+FFFD each, as in the library.

The vocabulary is read from a model file whose path is a parameter; the file must be reachable on the
executors (it is part of an installed package by default). Models with a character map or with
pieces that reach across words are refused.

Defined cases: null text is empty and gives the begin and end ids alone.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattframe.llm import common as C

SPACE = "▁"
LONG = 256
_NONE = np.int64(1 << 40)
#: Bytes of text encoded at a time; the arrays this takes are some fifty times as large.
_UNIT = 1 << 20


@dataclass
class Vocabulary:
    """Ids of characters, ranks and results of pairs, bytes of pieces."""

    bos: int
    eos: int
    unk: int
    chars: np.ndarray  # code point -> id, -1 if none
    byte_ids: np.ndarray  # byte -> id
    slots: np.ndarray  # hashed pairs: keys
    merged: np.ndarray  # hashed pairs: id of the union
    rank: np.ndarray  # id -> order of merging, smaller first
    offsets: np.ndarray  # id -> where its bytes start
    bytes_: np.ndarray  # decoded bytes of all ids, end to end
    silent: np.ndarray  # id -> begin, end and the like
    spaced: np.ndarray  # id -> starts with U+2581
    table: dict[tuple[int, int], int]  # the pairs again, for single words

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each pair's union, -1 if it is no piece."""
        size = np.uint64(len(self.slots) - 1)
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = (C.mix(key.copy()) & size).astype(np.int64)
        out = np.full(len(key), -1, np.int64)
        go = np.arange(len(key))
        while len(go):
            found = self.slots[at[go]]
            hit = found == key[go]
            out[go[hit]] = self.merged[at[go[hit]]]
            go = go[~hit & (found != np.uint64(_EMPTY))]
            at[go] = (at[go] + 1) & int(size)
        return out


_EMPTY = (1 << 64) - 1


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Reads the pieces of a model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    score = [model.get_score(i) for i in range(n)]
    kind = ["byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
            else "piece" for i in range(n)]
    if model.encode("ａ a") == model.encode("a a") or model.decode(model.encode(" a")) != " a":
        raise ValueError("the model changes characters or drops spaces; only plain ones are read here")
    plain = {names[i]: i for i in range(n) if kind[i] == "piece"}
    if any(SPACE in p.lstrip(SPACE) for p in plain):
        raise ValueError("a piece reaches across words")
    chars = np.full(0x110000, -1, np.int32)
    for p, i in plain.items():
        if len(p) == 1:
            chars[ord(p)] = i
    byte_ids = np.full(256, -1, np.int32)
    for i in range(n):
        if kind[i] == "byte":
            byte_ids[int(names[i][3:5], 16)] = i
    if any(chars[ord(c)] < 0 for p in plain for c in p):
        raise ValueError("a piece holds a character that is no piece")
    left, right, union = [], [], []
    for p, i in plain.items():
        for k in range(1, len(p)):
            a, b = plain.get(p[:k]), plain.get(p[k:])
            if a is not None and b is not None:
                left.append(a), right.append(b), union.append(i)
    # On equal scores the library takes the leftmost pair, so such pieces share a rank.
    level = {s: k for k, s in enumerate(sorted(set(score), reverse=True))}
    rank = np.array([level[s] for s in score], np.int64)
    size = 1 << (4 * max(1, len(left))).bit_length()
    slots = np.full(size, _EMPTY, np.uint64)
    merged = np.full(size, -1, np.int64)
    keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
    for key, at, u in zip(keys.tolist(), (C.mix(keys.copy()) & np.uint64(size - 1)).tolist(), union):
        while slots[at] != np.uint64(_EMPTY):
            at = (at + 1) % size
        slots[at], merged[at] = key, u
    raw = [bytes([int(names[i][3:5], 16)]) if kind[i] == "byte" else names[i].replace(SPACE, " ").encode()
           if kind[i] == "piece" else " ⁇ ".encode() if i == model.unk_id() else b"" for i in range(n)]
    offsets = np.cumsum([0] + [len(b) for b in raw])
    return Vocabulary(model.bos_id(), model.eos_id(), model.unk_id(), chars, byte_ids, slots, merged, rank,
                      offsets, np.frombuffer(b"".join(raw), np.uint8), np.array([model.is_control(i) for i in range(n)]),
                      np.array([kind[i] == "piece" and names[i].startswith(SPACE) for i in range(n)]),
                      dict(zip(zip(left, right), union)))


# --- merging -----------------------------------------------------------------------------------


def _rounds(v: Vocabulary, ids: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged symbols, their words, and the words whose order of merging is in doubt."""
    doubt, done_ids, done_word = [], [], []
    last = np.full(words, -1, np.int64)
    often = np.zeros(words, bool)
    union = np.full(len(ids), -1, np.int64)
    fresh = np.ones(len(ids), bool)
    while len(ids):
        # Only pairs with a symbol made in the last round need a look-up.
        inner = np.zeros(len(ids), bool)
        inner[:-1] = word[1:] == word[:-1]
        union[~inner] = -1
        look = inner
        look[:-1] &= fresh[:-1] | fresh[1:]
        at = np.flatnonzero(look)
        union[at] = v.pairs(ids[at], ids[at + 1])
        rank = np.where(union >= 0, v.rank[union], _NONE)
        head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        least = np.minimum.reduceat(rank, head)
        length = np.diff(np.append(head, len(ids)))
        names = word[head]
        worse = often[names] & (least <= last[names])
        if worse.any():
            doubt.append(names[worse])
        active = (least < _NONE) & ~worse
        last[names] = least
        keep = np.repeat(active, length)
        if not keep.all():
            done_ids.append(ids[~keep])
            done_word.append(word[~keep])
            ids, word, union, rank = ids[keep], word[keep], union[keep], rank[keep]
            if not len(ids):
                break
            least, length, names = least[active], length[active], names[active]
        hit = np.flatnonzero(rank == np.repeat(least, length))
        # Overlapping occurrences (a a a): every second of a chain, from the left.
        chain = np.flatnonzero(np.append(True, hit[1:] != hit[:-1] + 1))
        nth = np.arange(len(hit)) - np.repeat(chain, np.diff(np.append(chain, len(hit))))
        hit = hit[nth % 2 == 0]
        own = word[hit]
        often[names] = False
        often[own[1:][own[1:] == own[:-1]]] = True
        ids[hit] = union[hit]
        fresh = np.zeros(len(ids), bool)
        fresh[hit] = True
        stay = np.ones(len(ids), bool)
        stay[hit + 1] = False
        ids, word, union, fresh = ids[stay], word[stay], union[stay], fresh[stay]
    out_ids = np.concatenate(done_ids) if done_ids else ids
    out_word = np.concatenate(done_word) if done_word else word
    return out_ids, out_word, np.concatenate(doubt) if doubt else np.zeros(0, np.int64)


def _queued(v: Vocabulary, ids: list[int]) -> list[int]:
    """One word, one pair at a time: the smallest rank, the leftmost on ties."""
    n = len(ids)
    ids, after, before = list(ids), [*range(1, n), -1], [-1, *range(n - 1)]
    queue: list[tuple[int, int, int, int, int]] = []
    rank, pairs = v.rank, v.table

    def offer(i: int) -> None:
        j = after[i]
        if i >= 0 and j >= 0 and (u := pairs.get((ids[i], ids[j]), -1)) >= 0:
            heapq.heappush(queue, (int(rank[u]), i, ids[i], ids[j], u))

    for i in range(n):
        offer(i)
    while queue:
        _, i, a, b, u = heapq.heappop(queue)
        j = after[i]
        if ids[i] != a or j < 0 or ids[j] != b:
            continue
        ids[i], ids[j], after[i] = u, -1, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [x for x in ids if x >= 0]


def encode_words(v: Vocabulary, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words given as code points end to end, and how many each has."""
    n, pieces = len(lengths), len(v.rank)
    word = np.repeat(np.arange(n), lengths)
    ids = v.chars[points].astype(np.int64)
    # Characters without a piece stand as themselves while merging and become bytes after it.
    ids = np.where(ids < 0, pieces + points, ids)
    short = np.repeat(lengths <= LONG, lengths)
    got, at, doubt = _rounds(v, ids[short], word[short], n)
    alone = np.union1d(doubt, np.flatnonzero(lengths > LONG))
    if len(alone):
        ends = np.cumsum(lengths)
        parts = [_queued(v, ids[ends[w] - lengths[w] : ends[w]].tolist()) for w in alone.tolist()]
        keep = ~np.isin(at, alone)
        got = np.concatenate([got[keep], *[np.array(p, np.int64) for p in parts]])
        at = np.append(at[keep], np.repeat(alone, [len(p) for p in parts]))
    order = np.argsort(at, kind="stable")
    got, at = got[order], at[order]
    lost = np.flatnonzero(got >= pieces)
    if len(lost):
        times = np.ones(len(got), np.int64)
        if (v.byte_ids < 0).any():
            got[lost] = v.unk
        else:
            raw = [chr(p).encode("utf-8", "replace") for p in (got[lost] - pieces).tolist()]
            times[lost] = [len(b) for b in raw]
            spread = np.repeat(got >= pieces, times)
            got, at = np.repeat(got, times), np.repeat(at, times)
            got[spread] = v.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    return got, np.bincount(at, minlength=n)


def encode_batch(v: Vocabulary, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts end to end, each with its begin and end id, and their offsets.

    ``data`` holds the texts' UTF-8 with U+2581 already read as a space.
    """
    docs = len(off) - 1
    filled = np.flatnonzero(np.diff(off) > 0)
    # A space goes in front of each text, so that every word starts with its spaces.
    text = np.insert(data, off[filled], 32)
    begin = off[filled] + np.arange(len(filled))
    gap = text == 32
    start = gap.copy()
    start[1:] &= ~gap[:-1]
    start[begin] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(text))
    first, which = C.distinct(text, starts, ends)
    size = ends[first] - starts[first]
    raw = C.stretches(text, starts[first], size)
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    points = np.where(points == 32, ord(SPACE), points)
    lead = np.cumsum((raw & 0xC0) != 0x80)
    at = np.cumsum(size)
    lengths = np.diff(np.append(0, lead[at - 1])) if len(size) else size
    ids, count = encode_words(v, points, lengths)
    begins = np.cumsum(count) - count
    flat = C.stretches(ids, begins[which], count[which])
    # Words per text, then ids per text, then room for the two marks.
    words = np.zeros(docs, np.int64)
    words[filled] = np.diff(np.append(np.searchsorted(starts, begin), len(starts)))
    per_word = np.append(0, np.cumsum(count[which]))
    cut = np.append(0, np.cumsum(words))
    tokens = per_word[cut[1:]] - per_word[cut[:-1]]
    offsets = np.append(0, np.cumsum(tokens + 2))
    out = np.empty(int(offsets[-1]), np.int64)
    marks = np.zeros(len(out), bool)
    marks[offsets[:-1]] = marks[offsets[1:] - 1] = True
    out[~marks] = flat
    out[offsets[:-1]], out[offsets[1:] - 1] = v.bos, v.eos
    return out, offsets


def decode_batch(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decoded UTF-8 of several texts end to end, and their offsets."""
    size = np.diff(v.offsets)[ids]
    data = C.stretches(v.bytes_, v.offsets[ids], size)
    at = np.append(0, np.cumsum(size))[offsets]
    # The first id that is no mark loses its leading space.
    shown = np.append(np.cumsum(~v.silent[ids]), 0)
    base = np.where(offsets[:-1] > 0, shown[offsets[:-1] - 1], 0)
    first = np.searchsorted(shown[:-1], base + 1)
    first = np.minimum(first, max(len(ids) - 1, 0))
    loses = (first < offsets[1:]) & (np.diff(offsets) > 0)
    loses[loses] = v.spaced[ids[first[loses]]]
    drop = np.cumsum(np.append(0, size))[first[loses]]
    return np.delete(data, drop), at - np.append(0, np.cumsum(loses))


def _valid(b: bytes) -> bytes:
    """As is when valid UTF-8; else every byte that starts no character becomes U+FFFD."""
    try:
        b.decode()
        return b
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(b):
        for n in (1, 2, 3, 4):
            try:
                out.append(b[at : at + n].decode().encode())
                break
            except UnicodeDecodeError:
                continue
        else:
            n = 1
            out.append("\ufffd".encode())
        at += n
    return b"".join(out)


# --- on DataFrames -----------------------------------------------------------------------------


def _units(batches, limit: int = _UNIT):
    """(batch slice, bytes, offsets) with U+2581 read as a space, as the normaliser does."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        column = batch.column(at)
        if pc.any(pc.match_substring(column, SPACE)).as_py():
            column = pc.replace_substring(column, SPACE, " ")
        data, off = C.flat(column)
        for a, b in C.pieces(off, limit):
            yield batch.slice(a, b - a), data[off[a] : off[b]], off[a : b + 1] - off[a]


def _run(path: str, digests: bool):
    def run(batches):
        v = vocabulary(path)
        for rows, data, off in _units(batches):
            ids, cut = encode_batch(v, data, off)
            ids_u = ids.astype("<u4")
            for a, b in C.pieces(cut, 1 << 19):
                text, at = decode_batch(v, ids[cut[a] : cut[b]], cut[a : b + 1] - cut[a])
                raw, buffer = ids_u[cut[a] : cut[b]].tobytes(), text.tobytes()
                part = (cut[a : b + 1] - cut[a]).tolist()
                own = [raw[4 * x : 4 * y] for x, y in zip(part[:-1], part[1:])]
                texts = [buffer[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                n = pa.array(np.diff(cut[a : b + 1]))
                doc = rows.column(0).slice(a, b - a)
                if digests:
                    sha = [pa.array([hashlib.sha256(x).hexdigest() for x in y], pa.string()) for y in (own, texts)]
                    yield pa.RecordBatch.from_arrays([doc, n, *sha], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    lists = pa.ListArray.from_arrays(pa.array(np.array(part, np.int32)), pa.array(ids[cut[a] : cut[b]].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([doc, n, lists, pa.array(texts, pa.binary()).cast(pa.string())],
                                                     ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def tokenise(docs: DataFrame, model: str | None = None, digests: bool = False) -> DataFrame:
    """``doc_id, n_tokens`` with ``ids, decoded``, or with their digests."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    last = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return rows.mapInArrow(_run(model or default_model(), digests), f"doc_id long, n_tokens long, {last}")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise(C.load(spark, sf_dir, "documents"), digests=True)
