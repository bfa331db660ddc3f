"""A training corpus from the documents table, in five stages; each works on all rows that the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs.  The first four return the columns of documents; the last returns the mixed stream's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqframe.llm.decontaminate import drop_contaminated
from seqframe.llm.exact_dedup import drop_exact_copies
from seqframe.llm.langid import drop_rejected, fit_dictionaries, held_out
from seqframe.llm.minhash import drop_near_copies
from seqframe.llm.mixing import mix_sources
from seqframe.llm.shared import Stored

#: The mix: sources' weights are tempered until they reach this share of the highest entropy.
TARGET_ENTROPY, SEED = 0.95, 7


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those that language identification rejects go."""
    return drop_rejected(docs, fit_dictionaries(docs.filter(~held_out())))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return drop_near_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by source, epoch and block to the tempered weights, with the tokens of the corpus as budget."""
    return mix_sources(docs, target_entropy=TARGET_ENTROPY, seed=SEED)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", decontaminated), ("mix", mixed)]

#: SQL can't express compression with trained dictionaries.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        now = Stored(stage(spark, docs, sf_dir), name)
        if before:
            before.drop()
        docs, before = now.df, now
    return docs
