"""Phrases of two or three words that stand together more often than their parts explain, per language.

A text (A-Z lower-cased) is split at punctuation and line breaks into pieces and those into words. A
phrase with a = f(phrase) >= ``least`` is a candidate; cut after its first k words into parts seen l
and r times it scores floor(10^6 a^2 / (l r)), and its lowest cut counts. A candidate that some longer
candidate contains and covers (``absorb`` percent of its occurrences or more) is dropped.

The best ``first`` of each language are found by best-first growth, not by counting every phrase:

1. One pass counts words and pairs of words; pairs seen often enough are the nodes of the search.
2. A node u v grows to the right into u v w and to the left into t u v. What grows from the prefix u v
   scores at most f(u v) / f(u): its count a is at most f(u v) and at most f(v w), and its first cut
   gives a a / (f(u) f(v w)). The node itself scores no more than that either. So the prefix counts
   bound a whole branch.
3. The frontier is expanded in order of that bound: first the ``HEAD`` best nodes of each language.
   A pass over the texts counts exactly the phrases of three words that begin or end with an expanded
   node; with these the node's own survival is known too, and the ``first``-th best survivor so far is
   a lower limit of the final one. Every node whose bound reaches the limit is expanded next; when no
   such node is left, ties included, the list is settled. The limit never falls, so that takes two
   passes, seldom a third.

Tasks count a fixed number of words at a time, so a frequent phrase or a hot language costs one row for
each of these. Which nodes are expanded is sent to the tasks as a bit field of bounded size; one
that is too small lets further phrases be counted (exactly, as any) and loses none. Nothing else
leaves the cluster. Products are formed in 38 decimal digits, exact for counts below 10^15.

Defined cases: a null text is empty; a null language is ``und`` and shares its list; texts without words
count nothing; repeated rows count each time; an empty table gives no rows. Order of a list: score, then
a, descending, then the phrase by its UTF-8 bytes.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from wattframe.llm import common as C
from wattframe.session import small

LEAST = 10
ABSORB = 50
FIRST = 2_000
#: Nodes of each language that are expanded before there is a limit.
HEAD = 8_000
#: A frequent word begins many pairs; they meet its count in so many places.
SALT = 8
#: Lists are cut in so many shares before they are put in order.
SHARES = 16
#: Words (and different ones) that a task holds before it sends their counts.
HELD, MOST_WORDS = 1 << 19, 1 << 19
#: Bits of a word's number; three make a code.
_BITS = 21
ROWS = 20_000
#: Bits a node in the field of expanded nodes, and the field's largest size (16 MB).
BITS_A_NODE, MOST_BITS = 16, 1 << 27
BREAKS = r"[.,;:!?\x0A-\x0D]"

_TABLE = bytearray(C.LOWER.tobytes())
for _byte in b".,;:!?\x0b\x0c\r":
    _TABLE[_byte] = 10
_TABLE = bytes(_TABLE)
_COUNTS = "lang string, k int, phrase string, n long"
#: Between the numbers of two words: a break.
_BREAK = -1


# --- counting ----------------------------------------------------------------------------------


class Texts:
    """Words of some texts as numbers, by language, with a break after every piece."""

    def __init__(self):
        self.numbers: dict[bytes, int] = defaultdict(count().__next__)
        self.words: dict[bytes, array] = defaultdict(lambda: array("q"))
        self.size = 0

    def add(self, lang: bytes, text: bytes) -> None:
        own, number = self.words[lang], self.numbers.__getitem__
        before = len(own)
        for piece in text.translate(_TABLE).split(b"\n"):
            words = piece.split()
            if words:
                own.extend(map(number, words))
                own.append(_BREAK)
        self.size += len(own) - before

    def full(self) -> bool:
        return self.size >= HELD or len(self.numbers) >= MOST_WORDS

    def languages(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for lang, own in self.words.items():
            yield lang, np.frombuffer(own, np.int64) if len(own) else np.zeros(0, np.int64)

    def counted(self, lang: bytes, k: int, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of the phrases that these codes (numbers of ``_BITS`` bits end to end) stand for."""
        names = pa.array(list(self.numbers), pa.binary())
        codes, n = np.unique(codes, return_counts=True)
        for at in range(0, len(codes), ROWS):
            part = codes[at : at + ROWS]
            words = [names.take(pa.array((part >> (_BITS * i)) & ((1 << _BITS) - 1))) for i in reversed(range(k))]
            phrase = words[0] if k == 1 else pc.binary_join_element_wise(*words, b" ")
            yield self.rows(lang, k, phrase, n[at : at + ROWS])

    @staticmethod
    def rows(lang: bytes, k: int, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        size = len(phrase)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang], pa.binary()).cast(pa.string()).take(pa.array(np.zeros(size, np.int64))),
             pa.array(np.full(size, k, np.int32)), phrase.cast(pa.string()), pa.array(n.astype(np.int64))], ["lang", "k", "phrase", "n"])


def _held(batches, counts: Callable[[Texts], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``counts`` of all texts, so many of them at a time."""
    held = Texts()
    for batch in batches:
        lang, text = (batch.column(i).cast(pa.large_binary()) for i in range(2))
        for i in range(batch.num_rows):
            held.add(lang[i].as_py(), text[i].as_py())
            if held.full():
                yield from counts(held)
                held = Texts()
    yield from counts(held)


def _short(batches) -> Iterator[pa.RecordBatch]:
    """Counts of words (k = 1) and pairs (k = 2), and of all words of a language (k = 0)."""

    def counts(held: Texts):
        for lang, ids in held.languages():
            word = ids >= 0
            yield held.rows(lang, 0, pa.array([b""], pa.binary()), np.array([word.sum()]))
            yield from held.counted(lang, 1, ids[word])
            at = np.flatnonzero(word[:-1] & word[1:])
            yield from held.counted(lang, 2, ids[at] << _BITS | ids[at + 1])

    return _held(batches, counts)


def _places(lang: np.ndarray, left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the field for each pair, given the keys of its language and words."""
    h = C.mix(C.mix(lang + left) + right * np.uint64(0x9E6C63D0876A9A47))
    return tuple((x & np.uint64(bits - 1)).astype(np.int64) for x in (h, h >> np.uint64(32)))


def _keys(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words])
    return C.word_keys(np.frombuffer(b"".join(words), np.uint8), np.append(0, ends[:-1]).astype(np.int64), ends) if words else np.zeros(0, np.uint64)


def _long(field: Broadcast):
    """Counts of three words that begin or end with an expanded pair."""

    def run(batches):
        known, bits = np.frombuffer(field.value, np.uint8), 8 * len(field.value)

        def counts(held: Texts):
            keys = _keys(list(held.numbers))
            for lang, ids in held.languages():
                word = ids >= 0
                at = np.flatnonzero(word[:-2] & word[1:-1] & word[2:]) if len(ids) > 2 else np.zeros(0, np.int64)
                grown = np.zeros(len(ids), bool)
                pairs = np.flatnonzero(word[:-1] & word[1:])
                hit = np.ones(len(pairs), bool)
                for place in _places(_keys([lang]), keys[ids[pairs]], keys[ids[pairs + 1]], bits):
                    hit &= known[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1
                grown[pairs[hit]] = True
                at = at[grown[at] | grown[at + 1]]
                yield from held.counted(lang, 3, (ids[at] << _BITS | ids[at + 1]) << _BITS | ids[at + 2])

        return _held(batches, counts)

    return run


def _summed(texts: DataFrame, run, least: int, name: str) -> DataFrame:
    counts = texts.mapInArrow(run, _COUNTS).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    return C.staged(counts.where((F.col("n") >= least) | (F.col("k") == 0)), name)


def _field(nodes: DataFrame, n: int) -> Broadcast:
    """The nodes as set bits; tasks set theirs in a field of their own range, so all of it stays bounded."""
    bits = 1 << 16
    while bits < min(BITS_A_NODE * n, MOST_BITS):
        bits *= 2
    ranges = 64
    width = bits // ranges

    def places(batches):
        for batch in batches:
            keys = [C.word_keys(data, off[:-1], off[1:]) for data, off in (C.flat(c) for c in batch.columns)]
            at = np.unique(np.concatenate(_places(*keys, bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at // width), pa.array(at % width)], ["range", "at"])

    def fill(batches):
        fields = defaultdict(lambda: np.zeros(width, bool))
        for batch in batches:
            part, at = (c.to_numpy() for c in batch.columns)
            for g in np.unique(part):
                fields[int(g)][at[part == g]] = True
        for g, flags in fields.items():
            packed = np.packbits(flags, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([packed], pa.binary())], ["range", "bits"])

    spark = nodes.sparkSession
    tasks = min(ranges, C.partitions(spark))
    pairs = nodes.select("lang", F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1))
    found = pairs.mapInArrow(places, "range long, at long").distinct().repartition(
        tasks, "range").mapInArrow(fill, "range long, bits binary").toArrow()
    table = np.zeros((ranges, width // 8), np.uint8)
    for g, packed in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
        table[g] = np.frombuffer(packed, np.uint8)
    return spark.sparkContext.broadcast(table.reshape(-1).tobytes())


# --- scores and bounds -------------------------------------------------------------------------


def score(a: str, l: str, r: str) -> Column:
    """floor(10^6 a a / (l r)) of three counts, exact."""
    return F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * CAST({a} AS DECIMAL(15,0)) * CAST({a} AS DECIMAL(15,0))) DIV "
                  f"(CAST({l} AS DECIMAL(18,0)) * CAST({r} AS DECIMAL(18,0)))")


def _nodes(counts: DataFrame) -> DataFrame:
    """Pairs with the counts of their words, their score and the bound of all that grows from them."""
    words = counts.where("k = 1").select("lang", F.col("phrase").alias("word"), F.col("n").alias("f"))
    words = words.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    pairs = counts.where("k = 2").select(
        "lang", "phrase", F.col("n").alias("a"), F.substring_index("phrase", " ", 1).alias("u"),
        F.substring_index("phrase", " ", -1).alias("v"), F.pmod(F.xxhash64("phrase"), F.lit(SALT)).cast("int").alias("salt"))
    left = words.select("lang", F.col("word").alias("u"), "salt", F.col("f").alias("l"))
    right = words.select("lang", F.col("word").alias("v"), "salt", F.col("f").alias("r"))
    known = pairs.join(left, ["lang", "u", "salt"]).join(right, ["lang", "v", "salt"])
    return C.staged(known.select("lang", "phrase", "a", "l", "r", score("a", "l", "r").alias("score"),
                                 F.expr("CAST(1000000 AS DECIMAL(7,0)) * a DIV l").alias("bound")), "nodes")


def _scored(threes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Phrases of three words with their lowest cut."""
    begin = nodes.select("lang", F.col("phrase").alias("p"), F.col("a").alias("f12"), F.col("l").alias("f1"))
    end = nodes.select("lang", F.col("phrase").alias("q"), F.col("a").alias("f23"), F.col("r").alias("f3"))
    cut = threes.select("lang", "phrase", F.col("n").alias("a"), F.substring_index("phrase", " ", 2).alias("p"),
                        F.substring_index("phrase", " ", -2).alias("q")).join(begin, ["lang", "p"]).join(end, ["lang", "q"])
    cuts = [F.struct(score("a", l, r).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))
            for k, l, r in ((1, "f1", "f23"), (2, "f12", "f3"))]
    return cut.select("lang", "phrase", "a", F.least(*cuts).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def _best(found: DataFrame, first: int, *order: Column) -> DataFrame:
    """The first rows of each language, found in shares of it beforehand so that no task orders them all."""
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    few = found.withColumn("rank", F.row_number().over(W.partitionBy("lang", share).orderBy(*order))).where(F.col("rank") <= first)
    return few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)


def _limit(found: DataFrame, first: int, by: str) -> DataFrame:
    """``lang, limit``: the value of the ``first``-th best in each language that has so many.

    Values are whole numbers up to a million: their thousands are counted, then the values of the thousand
    that holds the limit.
    """
    window = W.partitionBy("lang").orderBy(F.desc("value")).rowsBetween(W.unboundedPreceding, 0)

    def reached(values: DataFrame, need: Column) -> DataFrame:
        sums = values.groupBy("lang", "value").agg(F.count("*").alias("n"), F.max(need).alias("need")).withColumn(
            "upto", F.sum("n").over(window))
        return sums.where("upto >= need AND upto - n < need").select(
            "lang", "value", (F.col("need") - F.col("upto") + F.col("n")).alias("need"))

    values = found.select("lang", F.col(by).alias("value"))
    part = reached(values.select("lang", F.expr("value DIV 1000").alias("value")), F.lit(first))
    part = small(C.staged(part.withColumnRenamed("value", "part"), "limits"))
    inside = values.join(part, "lang").where("value DIV 1000 = part")
    return reached(inside, F.col("need")).select("lang", F.col("value").alias("limit"))


def _survivors(expanded: DataFrame, threes: DataFrame, nodes: DataFrame, absorb: int) -> DataFrame:
    """Candidates whose fate is known: all counted phrases of three words, and expanded pairs not absorbed."""
    parts = threes.select("lang", F.explode(F.array(
        F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase"), "n")
    cover = parts.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    pairs = expanded.join(cover, ["lang", "phrase"], "left").where(
        f"most IS NULL OR CAST(100 AS DECIMAL(3,0)) * most < CAST({absorb} AS DECIMAL(3,0)) * a")
    return pairs.select("lang", "phrase", "a", "l", "r", "score").unionByName(_scored(threes, nodes))


def mine(docs: DataFrame, least: int = LEAST, absorb: int = ABSORB, first: int = FIRST, head: int = HEAD) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``first`` best phrases of each language."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = _summed(texts, _short, least, "phrases")
    nodes = _nodes(counts)
    limits, threes, before = _limit(nodes, head, "bound"), None, None
    while True:
        limits = small(C.staged(limits, "limits"))
        reach = nodes.join(limits, "lang", "left").withColumn("limit", F.coalesce("limit", F.lit(0)))
        expanded = reach.where("bound >= limit").drop("limit")
        fresh = expanded
        if before is not None:
            # A language without a limit of its own has been expanded in full.
            fresh = expanded.join(before.withColumnRenamed("limit", "old"), "lang").where("bound < old").drop("old")
        n = fresh.count()
        if threes is not None and not n:
            break
        found = _summed(texts, _long(_field(fresh, n)), least, "threes") if n else counts.limit(0)
        # A phrase counted in two rounds has the same count in both.
        threes = found if threes is None else C.staged(threes.unionByName(found).dropDuplicates(["lang", "phrase"]), "threes")
        known = C.staged(_survivors(expanded, threes, nodes, absorb), "survivors")
        before, limits = limits, _limit(known, first, "score")
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    totals = small(C.staged(counts.where("k = 0").select("lang", F.col("n").alias("total")), "totals"))
    known = known.join(limits, "lang", "left").where("score >= coalesce(limit, 0)").drop("limit")
    return _best(known, first, *order).join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(C.load(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BREAKS}')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(ws[s : s + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM w, (SELECT unnest([1, 2, 3]) AS k))
), f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND n >= {LEAST}),
cuts AS (
  SELECT c.lang, c.k, c.phrase, a, j, x.n AS l, y.n AS r,
    (1000000::HUGEINT * a * a // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1 : j], ' ') AND x.k = j
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[j + 1 :], ' ') AND y.k = c.k - j
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, j) = 1
), kept AS (
  SELECT s.* FROM scored s WHERE k = 3 OR NOT EXISTS (
    SELECT 1 FROM cand t WHERE t.k = 3 AND t.lang = s.lang AND 100 * t.a >= {ABSORB} * s.a
      AND (s.phrase = array_to_string(t.ws[1 : 2], ' ') OR s.phrase = array_to_string(t.ws[2 : 3], ' ')))
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, total.n AS n, score
FROM ranked JOIN total USING (lang) WHERE rank <= {FIRST}
"""
