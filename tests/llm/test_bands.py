import base64
import random
import re

import pytest
import zstandard
from pyspark.sql import functions as F

from llm.conftest import EDGE

from wattframe.llm import bands


def band_of(size):
    got = None
    for least, low, high in bands.BANDS:
        if size >= least:
            got = low, high
    return got


def outside(data):
    band = band_of(len(data))
    ratio = len(data) / len(zstandard.ZstdCompressor(level=bands.LEVEL).compress(data))
    return bool(band) and not band[0] <= ratio <= band[1]


def brute(text, chunk=bands.CHUNK):
    text = text or ""
    data = text.encode()
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    off = sum(len(data[a : a + chunk]) for a in range(0, len(data), chunk) if outside(data[a : a + chunk]))
    kept = not failed and not outside(data) and 100 * off <= bands.SHARE * len(data)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed, kept)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def made(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    noise = lambda n: " ".join(base64.b64encode(r.randbytes(12)).decode() for _ in range(n))
    texts = [prose(n) for n in (5, 19, 20, 60, 300, 3000)] + [noise(n) for n in (30, 400, 2000)]
    texts += [prose(2000) + " " + noise(500), prose(9) * 30, "\n".join([prose(30)] * 2 + [prose(40), " ", "\t", " "]),
              prose(40) + " # * $ % & | < > ", "ÄÖÜ ß 　 x " * 30, "a\x0bb\x0cc\rd " * 3, "x" * 1_000_000, prose(200_000)]
    return list(enumerate(texts)) + EDGE


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(docs, seed):
    pairs = made(seed)
    got = bands.judge(docs(pairs).repartition(3)).collect()
    assert sorted((str(r.doc_id), *(r[c] for c in COLUMNS)) for r in got) == sorted((str(i), *brute(t)) for i, t in pairs)
    assert all((r.reason is None) == r.kept for r in got)
    assert {r.reason for r in got} >= {"few_words", "repeated_words", "ratio", "chunks", None}


def test_bands_reject_both_ends():
    r = random.Random(5)
    assert outside(base64.b64encode(r.randbytes(20_000))) and outside(b"again and again " * 5000)


def test_passing_keeps_rows_whole(docs):
    pairs = made(3)
    df = docs(pairs).withColumns({"own": F.lit("o"), "kept": F.lit(1), "reason": F.col("doc_id")})
    got = bands.passing(df).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t) for i, t in pairs if brute(t)[-1])
    assert got[0].own == "o" and got[0].kept == 1 and bands.passing(df).schema == df.schema


def test_nulls_and_empty(docs):
    none = docs([(1, None), (None, None)]).withColumns({c: F.lit(None).cast("string") for c in ("lang", "source")})
    got = bands.judge(none).collect()
    assert len(got) == 2 and all(r.base_failed and not r.kept and r.ratio is None for r in got)
    assert bands.judge(docs([])).count() == 0 and bands.passing(docs([])).count() == 0
