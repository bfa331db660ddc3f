"""Every query runs on the smallest tables and agrees with its SQL where it has one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from seqframe.plans import catalogue

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    if isinstance(v, float):
        return round(v, 9) + 0.0 if v == v else None
    return v + 0.0 if isinstance(v, int) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    rows = df.collect()
    assert rows or name in ("anti_join", "range_join", "mutation_consensus")
    if name in catalogue.ORACLE_SQL:
        found = duck.sql(catalogue.ORACLE_SQL[name])
        assert sorted(found.columns) == sorted(df.columns)
        at = [found.columns.index(c) for c in df.columns]
        want = [[plain(r[i]) for i in at] for r in found.fetchall()]
        got = [[plain(r[c]) for c in df.columns] for r in rows]
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry(spark):
    assert entry_module.entry(spark).count() == 20
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
