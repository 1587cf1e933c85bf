"""Documents to packed training sequences: each stage is one operator of ``tagloom.llm`` over all that is kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import langid, mixing, packing, simhash, toxicity
from tagloom.llm._base import settle, table

LEAST_SCORE = 0.3  # of the mean probability of the language that a document is taken for
MAX_REPEATS = 1.5  # times that a document of the smallest source is taken, at most two


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no language for certain, go."""
    return langid.keep_identified(docs, langid.fit_on(docs), least=LEAST_SCORE)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier toxic than not go; the model is fitted on the labels of all documents."""
    model = toxicity.fit_on(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-copies stays."""
    return simhash.keep_one(docs)


def temperature_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; those of small sources come more than once, as the mixture's weights ask."""
    return mixing.mix_rows(docs, max_repeats=MAX_REPEATS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the sequence and offset that they are packed at."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", simhash_near_dedup),
    ("temperature_mixing", temperature_mixing),
    ("best_fit_packing", best_fit_packing),
]

# The classifiers, fingerprints and ids of the stages cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
