"""Reads derived from documents, the same in Spark and in SQL, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEX = "0123456789abcdef"
LETTERS = "AGCTAGCTAGCTAGCT"

#: SQL for the derived reads: doc_id, seq (32 letters), qual (32 values), of documents with a text.
READS_SQL = f"""reads AS (SELECT doc_id, lang, source, translate(md5(text), '{HEX}', '{LETTERS}') AS seq,
  list_transform(range(1, 33), lambda i: CAST(instr('{HEX}', substr(md5(text), i, 1)) - 1 AS INTEGER)) AS qual FROM documents WHERE text IS NOT NULL)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seq_of(digest):
    return F.translate(digest, HEX, LETTERS)


def reads(spark: SparkSession, sf_dir: str, salt: str = "") -> DataFrame:
    digest = F.md5(F.concat(F.col("text"), F.lit(salt)) if salt else F.col("text"))
    base = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "lang", "source", digest.alias("h"))
    qual = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.position(F.substring(F.col("h"), i, F.lit(1)), F.lit(HEX)) - 1)
    return base.select("doc_id", "lang", "source", seq_of(F.col("h")).alias("seq"), qual.alias("qual"))


def reads_sql(salt: str = "", name: str = "reads") -> str:
    text = f"text || '{salt}'" if salt else "text"
    return READS_SQL.replace("reads AS", f"{name} AS").replace("md5(text)", f"md5({text})")


def query(sql: str | None = None, name: str | None = None):
    """Registers a query, and its SQL if it has one."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add
