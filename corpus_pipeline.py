"""A corpus from documents to packed sequences: toxicity, language, near-duplicates, packing.

Every stage takes all that its predecessor kept; run() keeps each result in the shared folder before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barlens.llm import langid, neardup, packing, toxicity
from barlens.llm.queries import BPE_FILE, CAPACITY, table, vocabulary
from barlens.llm.util import keep, small_batches


#: Score from which a document goes: below one half, since a toxic document that stays costs more than a clean one that goes.
TOXIC = 0.2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labelled ones among them, doesn't reject."""
    small_batches(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), limit=TOXIC)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a sufficient margin."""
    small_batches(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    small_batches(spark)
    return packing.pack(docs, vocabulary(BPE_FILE), CAPACITY)


STAGES = [("toxicity", drop_toxic), ("language", keep_languages), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: Trained models and numpy stages have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
