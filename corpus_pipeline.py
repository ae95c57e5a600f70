"""From raw documents to token ids: a pipeline of five stages.

Each stage is a function of (spark, docs, sf_dir) and works on all rows the stage before it kept;
between two stages the documents are written as Parquet and read again. All but the last return the
columns of ``documents``, further columns included. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattframe.llm import common as C, jaccard, mixing, pieces, substrings, toxicity

#: Near duplicates as documents of a training corpus: shingles of five words, similarity 0.8 or more.
SHINGLE, PERCENT = 5, 80


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` of changed texts."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; learned from ``labels`` outside the held-out fifth.

    A text that is null or has no words scores the labels' rate and stays where that is below one half;
    without labels of both kinds every text does. Each row is judged by its own text.
    """
    return toxicity.without_toxic(docs, C.load(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id (a null id is the smallest).

    Texts that are null or have no words are in no group and all stay; of repeated rows one stays.
    """
    return jaccard.one_of_each(docs, SHINGLE, PERCENT)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages of 20 words and more that stand earlier already.

    A null text stays null; a text without such a passage stays as it is, byte for byte. Rows equal in id and
    text are one document here; a null id comes before all others.
    """
    return _measured(substrings.cleaned(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time a document is taken, so that sources follow their target weights.

    A document taken in part keeps that part of its text; a null source is one of its own; documents
    without words weigh nothing and may drop out.
    """
    return _measured(mixing.mixed(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every row; a null text counts as empty."""
    return pieces.tokenise(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("substring_dedup", cut_passages),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Trained scores and merges are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
