"""The registered queries agree with their SQL on the smallest tables, and their results have the columns promised."""

import os

import duckdb
import pytest

from seqframe.llm import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df, found = queries.QUERIES[name](spark, DIR), con.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    at = [found.columns.index(c) for c in df.columns]
    got = sorted(map(repr, (tuple(r) for r in df.collect())))
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall()) and got


@pytest.mark.parametrize("name, columns", [("op1_lm_scoring", {"doc_id", "ce_diff"}), ("op3_cotraining", {"doc_id", "score", "good"}), ("op5_token_counts", {"doc_id", "n_tokens", "section_tokens"}), ("op9_language", {"doc_id", "held_out", "lang_pred", "score"})])
def test_whole_tables(spark, name, columns):
    df = queries.QUERIES[name](spark, DIR)
    assert columns <= set(df.columns)
    ids = {r.doc_id for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id").collect()}
    assert sorted(r.doc_id for r in df.select("doc_id").collect()) == sorted(ids)
