"""Plans: what reaches the scan, and what must not appear."""

import os

import pytest

from seqframe.operators import dataflow as flow
from seqframe.plans import catalogue

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def plan(spark, name):
    return catalogue.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in catalogue.QUERIES if n not in ("cluster", "fastq_round_trip", "paired_fastq_round_trip", "fasta_round_trip")))
def test_no_nested_loops(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(
    "name, columns",
    [("histogram", "l_quantity"), ("semi_join", "o_custkey"), ("canonical_kmer_topk", "text"), ("cogroup_counts", "l_orderkey"), ("enum_histogram", "lang")],
)
def test_scans_read_what_is_used(spark, name, columns):
    schemas = [x.split("ReadSchema: struct<")[1].split(">")[0] for x in plan(spark, name).splitlines() if "ReadSchema" in x]
    assert any(sorted(f.split(":")[0] for f in s.split(",")) == sorted(columns.split(",")) for s in schemas)


def test_filters_reach_the_scan(spark):
    some = spark.read.parquet(f"{DIR}/lineitem.parquet").filter("l_orderkey < 3000")
    text = flow.group_by_prefix(some, ["l_orderkey"], ["l_returnflag"], ["l_linenumber"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_orderkey), LessThan(l_orderkey,3000)]" in text
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan(spark, "anti_join")


def test_one_exchange_for_a_co_group(spark):
    assert plan(spark, "cogroup_join").count("Exchange hashpartitioning") == 1
    assert plan(spark, "cogroup_counts").count("Exchange hashpartitioning") == 1
