import random
import tracemalloc

import pyarrow as pa
import pytest
import sentencepiece

from llm.conftest import ALIKE, EDGE, sha

from wattframe.llm import pieces

import numpy as np

MODEL = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def wanted(pairs):
    out = []
    for i, t in pairs:
        ids = MODEL.encode(t or "", add_bos=True, add_eos=True)
        out.append((str(i), len(ids), sha(np.array(ids, "<u4").tobytes()), sha(MODEL.decode(ids).encode())))
    return sorted(out)


def rows(df):
    return sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect())


def made():
    r = random.Random(4)
    kinds = ["ab ", "aaaa  b", "the of and ", "éßü ç ", "日本語 テキスト", "\U0001f600 \x00\x01 ▁", "\n\t\r ", "()[]{};= ", "0123456789.", "ththth eses "]
    texts = ["".join(r.choices(r.choice(kinds) + r.choice(kinds), k=r.randrange(0, 300))) for _ in range(400)]
    texts += [" " * n for n in (1, 2, 3, 5, 17, 64, 1000)] + ["▁", "▁▁a", " ▁ ", "�", "a" * 5000, "日本" * 3000, "ab" * 400, "x y"]
    return list(enumerate(texts))


def test_equals_the_library(docs):
    pairs = made() + EDGE
    assert rows(pieces.tokenise(docs(pairs).repartition(3), digests=True)) == wanted(pairs)


def test_words_are_told_apart_by_their_bytes(docs, monkeypatch):
    x, y = ALIKE
    rest = " ".join(f"w{i}" for i in range(19))
    pairs = [(1, f"{x} {rest}"), (2, f"{y} {rest}"), (3, f"{x} {y}"), (4, x + "c" * 100), (5, y + "c" * 100)]
    assert rows(pieces.tokenise(docs(pairs), digests=True)) == wanted(pairs)
    # Even if all keys were equal.
    monkeypatch.setattr(pieces.C, "word_keys", lambda data, starts, ends, seed=0: np.zeros(len(starts), np.uint64))
    data = np.frombuffer(" ".join(["one", "two", "one", "three", "two", "", "one"]).encode(), np.uint8)
    starts = np.array([0, 4, 8, 12, 18, 22, 23])
    ends = np.array([3, 7, 11, 17, 21, 22, 26])
    first, which = pieces.C.distinct(data, starts, ends)
    names = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert [names[first[w]] for w in which] == names and len(set(which.tolist())) == len(set(names)) == 4


def test_clashing_columns(docs):
    df = docs(EDGE).selectExpr("*", "'p' AS ids", "1 AS n_tokens", "'q' AS decoded")
    assert rows(pieces.tokenise(df, digests=True)) == wanted(EDGE)


def test_equals_the_library_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows(pieces.tokenise(docs, digests=True)) == wanted(pairs)


@pytest.mark.parametrize("ids", [[], [1, 2], [28705], [28705, 28705, 264], [1, 264, 2], [242, 192, 132], [242, 192], [3, 0x20 + 3, 264], [259, 264]])
def test_decodes_any_ids(ids):
    v = pieces.vocabulary(pieces.default_model())
    text, at = pieces.decode_batch(v, np.array(ids, np.int64), np.array([0, len(ids)]))
    assert pieces._valid(text[at[0] : at[1]].tobytes()).decode() == MODEL.decode(ids)


def test_general_output_and_empty(docs):
    got = {r.doc_id: (r.n_tokens, r.ids, r.decoded) for r in pieces.tokenise(docs([(1, "a b"), (2, None)])).collect()}
    assert got == {1: (4, [1, 264, 287, 2], "a b"), 2: (2, [1, 2], "")}
    assert pieces.tokenise(docs([]), digests=True).count() == 0


def test_memory_is_bounded_by_the_unit():
    """A batch of 6 MB of text takes a small multiple of one unit, not of the batch."""
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(5000)]
    texts = [" ".join(r.choices(words, k=2000)) for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(texts)], ["doc_id", "text"])
    pieces.vocabulary(pieces.default_model())
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in pieces._run(pieces.default_model(), False)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 500 and peak < 50e6
