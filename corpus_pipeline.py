"""A training corpus from ``documents`` in five stages, each one of the operators in ``ponderlake.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of ``documents``; rows and columns besides those used pass through,
whatever their names.  Every stage takes texts of any length whole, and gives an
empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ponderlake.llm import exact_dedup, mixing, near_dedup, pieces, quality_classifier, queries, shared


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards those labelled good holds.

    Texts without words (null, empty) go, unless there are no labels of both classes: then all stay.  Ties at the last
    place stay; repeated rows go or stay together.
    """
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the one of least id.

    Null and empty texts are one group.  Each row is judged by its own id and text.  Of a group without ids all stay, else
    none of its rows without one; rows that repeat the id and text that stay all do.
    """
    return exact_dedup.distinct(docs)


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least id (so there are no ties).

    Texts without words and rows without an id stay; repeated rows of an id go or stay together.
    """
    return shared.without(docs, near_dedup.near_dedup(docs).where("NOT kept"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them, in the order of training; ties in it by id.

    Texts without words are never taken; a null source is one of its own; rows alike in id, source and size are taken
    alike.
    """
    return mixing.training_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with a digest of what they decode to; null texts count as empty, repeated rows each."""
    return pieces.tokenise(docs, queries.model_path(), ("doc_id", "lang", "source"))


STAGES = [
    ("quality classifier", good),
    ("exact dedup", distinct),
    ("near dedup", different),
    ("mixing", mixed),
    ("sentencepiece", tokens),
]
#: A trained classifier and a tokenizer's merges aren't SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; of the tables on the way only the last stage's input is left."""
    docs = last = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with shared.scratch() as keep:
        for i, (name, stage) in enumerate(STAGES):
            with shared.scratch() as hand_on:
                docs = stage(spark, docs, sf_dir)
                if i < len(STAGES) - 1:
                    docs = keep(hand_on(shared.table(docs, name.replace(" ", "-"))))
                    shared.drop(last)
                    last = docs
        return docs
