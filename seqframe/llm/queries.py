"""Queries of the llm operators over the driver's tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import lloyd, oracle
from .cotrain import score_quality
from .decontaminate import digest_items, mark_contamination
from .exact_dedup import exact_dedup
from .langid import fit_dictionaries, held_out, identify_language
from .lm_scoring import cross_entropy_difference
from .minhash import near_duplicates
from .mixing import ORACLE_SQL as MIXING_SQL
from .mixing import mix_sources
from .piece_coding import code_pieces, digest_pieces
from .substring import substring_dedup
from .token_counts import token_counts
from .warc_zip import archive_round_trip
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled of good quality; background: all documents."""
    good = _table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return cross_entropy_difference(_table(spark, sf_dir, "documents"), good)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_items(mark_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))).drop("items", "spans")


def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(_table(spark, sf_dir, "documents"), digest_all=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), target_entropy=corpus_pipeline.TARGET_ENTROPY, seed=corpus_pipeline.SEED)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents")).drop("spans")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    test = docs.select("doc_id", "text", held_out().alias("held_out"))
    found = identify_language(test, fit_dictionaries(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages")).drop("url", "payload")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation as long, as promised; the operator's own is a decimal, which holds it for any number of vectors."""
    return whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.digest_clusters(lloyd.lloyd(_table(spark, sf_dir, "embeddings")))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_pieces(code_pieces(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_decontaminate": op2_decontaminate,
    "op3_cotraining": op3_cotraining,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_mixing": op6_mixing,
    "op7_minhash": op7_minhash,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language": op9_language,
    "op10_warc_zip": op10_warc_zip,
    "op11_whitening": op11_whitening,
    "op12_lloyd": op12_lloyd,
    "op13_sentencepiece": op13_sentencepiece,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": oracle.DECONTAMINATE,
    "op4_exact_dedup": oracle.EXACT,
    "op6_mixing": MIXING_SQL.format(target=corpus_pipeline.TARGET_ENTROPY, seed=corpus_pipeline.SEED),
    "op7_minhash": oracle.NEAR,
    "op8_substring_dedup": oracle.SUBSTRING,
    "op10_warc_zip": oracle.ARCHIVE,
    "op12_lloyd": lloyd.oracle_sql(),
}
