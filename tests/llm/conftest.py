import hashlib

import pytest


@pytest.fixture
def docs(spark):
    """Documents with every column of the table, from (doc_id, text) pairs."""

    def make(pairs):
        rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


EDGE = [(1, None), (2, ""), (3, "  \t\n"), (4, "one"), (4, "one"), (None, "one two three"), (5, "ünï çødé \U0001f600 x")]


def _alike(n: int) -> tuple[str, str]:
    """Two words over a and b that every polynomial modulo a power of two takes for one."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


ALIKE = _alike(1024)
