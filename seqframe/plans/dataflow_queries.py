"""Queries of joins, sorts, groups, intervals and histograms on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as s
from ..operators import aggregates as agg
from ..operators import dataflow as flow
from ..operators import intervals as iv
from .base import query, reads, reads_sql, table

WITH = f"WITH {reads_sql()} "


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date"))
    line = table(spark, sf_dir, "lineitem")
    return line.select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 20).alias("g"), days.alias("lower"), (days + F.col("l_quantity").cast("int") % 8).alias("upper"))


INTERVALS = "iv AS (SELECT l_orderkey, l_linenumber, l_suppkey % 20 AS g, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS lower, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INTEGER) % 8 AS upper FROM lineitem)"
ORDERS = "ord AS (SELECT o_orderkey, o_custkey % 20 AS g, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS lower, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + o_custkey % 4 AS upper FROM orders)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("g"), day.alias("lower"), (day + (F.col("o_custkey") % 4).cast("int")).alias("upper"))


_LINE = "o_orderkey, l_orderkey, l_linenumber"


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.col("a_o_orderkey").alias("o_orderkey"), F.col("b_l_orderkey").alias("l_orderkey"), F.col("b_l_linenumber").alias("l_linenumber"))


@query(f"WITH {INTERVALS}, {ORDERS} SELECT {_LINE} FROM ord a JOIN iv b ON a.g = b.g AND a.lower < b.upper AND b.lower < a.upper WHERE a.lower < a.upper AND b.lower < b.upper")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(iv.range_join(_orders(spark, sf_dir), _intervals(spark, sf_dir), 16, ["g"]))


@query(f"WITH {INTERVALS}, {ORDERS} SELECT {_LINE} FROM ord a JOIN iv b ON a.g = b.g AND a.lower <= b.upper AND b.lower <= a.upper")
def range_join_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(iv.range_join(_orders(spark, sf_dir), _intervals(spark, sf_dir), 16, ["g"], touching=True))


@query(f"WITH {INTERVALS}, {ORDERS} SELECT {_LINE} FROM ord a JOIN iv b ON a.g = b.g AND a.lower >= b.lower AND a.lower < b.upper")
def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _orders(spark, sf_dir).select("o_orderkey", "g", F.col("lower").alias("day"))
    return _pairs(iv.point_join(points, _intervals(spark, sf_dir), "day", 16, keys=["g"]))


@query(f"WITH {INTERVALS} SELECT g, d AS position, count(*) AS depth FROM iv, unnest(range(lower, upper)) u(d) WHERE lower < upper GROUP BY g, d")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.coverage(_intervals(spark, sf_dir), "lower", "upper", ["g"], bin_width=64)


@query(f"WITH {INTERVALS} SELECT g, CAST(min(lower) AS INTEGER) AS lower, CAST(max(upper) AS INTEGER) AS upper FROM iv GROUP BY g")
def enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.enclosing(_intervals(spark, sf_dir), ["g"])


BOUNDS = [1.0, 5.0, 10.0, 20.0, 30.0, 45.0]


@query("WITH b AS (SELECT unnest([{'bin': 0, 'lower': 1.0, 'upper': 5.0}, {'bin': 1, 'lower': 5.0, 'upper': 10.0}, {'bin': 2, 'lower': 10.0, 'upper': 20.0}, {'bin': 3, 'lower': 20.0, 'upper': 30.0}, {'bin': 4, 'lower': 30.0, 'upper': 45.0}]) AS x) SELECT x.bin AS bin, CAST(x.lower AS DOUBLE) AS lower, CAST(x.upper AS DOUBLE) AS upper, (SELECT count(*) FROM lineitem WHERE l_quantity <= x.upper AND (l_quantity > x.lower OR x.bin = 0 AND l_quantity = x.lower)) AS n FROM b")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", BOUNDS)


@query("SELECT count(l_quantity) AS total, avg(CASE WHEN l_quantity < 1 OR l_quantity > 45 THEN NULL WHEN l_quantity <= 5 THEN 3.0 WHEN l_quantity <= 10 THEN 7.5 WHEN l_quantity <= 20 THEN 15.0 WHEN l_quantity <= 30 THEN 25.0 ELSE 37.5 END) AS mean, count(*) FILTER (WHERE l_quantity BETWEEN 1 AND 45) / count(l_quantity) AS covered FROM lineitem")
def histogram_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.histogram_summary(table(spark, sf_dir, "lineitem"), "l_quantity", BOUNDS)


@query("WITH l AS (SELECT unnest([{'ord': 0, 'label': 'de'}, {'ord': 1, 'label': 'en'}, {'ord': 2, 'label': 'tlh'}, {'ord': 3, 'label': NULL}]) AS x) SELECT x.ord AS ord, x.label AS label, (SELECT count(*) FROM documents WHERE lang IS NOT DISTINCT FROM x.label) AS n FROM l")
def enum_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.enum_histogram(table(spark, sf_dir, "documents"), "lang", ["de", "en", "tlh"])


_CODE = "translate({0}, 'AGCTNRYSWKMBDHV', 'abcdefghijklmno')"


@query(WITH + f", c AS (SELECT doc_id, substr(seq, 1, CAST(20 + doc_id % 13 AS INTEGER)) AS seq FROM reads) SELECT doc_id, seq, row_number() OVER (ORDER BY len(seq), {_CODE.format('seq')}, doc_id) AS place FROM c ORDER BY place LIMIT 500")
def sequence_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 sequences in order: a top-k report."""
    cut = reads(spark, sf_dir).select("doc_id", F.substring("seq", F.lit(1), (20 + F.col("doc_id") % 13).cast("int")).alias("seq"))
    top = flow.sort(cut, *s.order_keys(F.col("seq")), "doc_id").limit(500)
    ranked = top.agg(F.sort_array(F.collect_list(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(s.order_keys(F.col("seq")))], "doc_id", "seq"))).alias("a"))
    return ranked.select(F.posexplode("a").alias("p", "x")).select("x.doc_id", "x.seq", (F.col("p") + 1).cast("long").alias("place"))


@query(WITH + ", h AS (SELECT doc_id, seq, ('0x' || substr(md5(seq), 1, 8))::BIGINT AS h FROM reads) SELECT seq, h, h >> 28 AS bucket, count(*) AS n FROM h GROUP BY seq, h")
def hash_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.conv(F.substring(F.md5("seq"), 1, 8), 16, 10).cast("long")
    rows = reads(spark, sf_dir).select("seq", h.alias("h"))
    collated = flow.hash_collate(rows, ["seq", "h"])
    return collated.groupBy("seq", "h").agg(F.count("*").alias("n")).select("seq", "h", flow.hash_bucket(F.col("h"), 32, 4).alias("bucket"), "n")


@query("SELECT c_nationkey AS key, 0 AS src_idx, c_custkey AS id FROM customer UNION ALL SELECT s_nationkey, 1, s_suppkey FROM supplier UNION ALL SELECT n_nationkey, 2, CAST(n_regionkey AS BIGINT) FROM nation")
def merge_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    ins = [table(spark, sf_dir, t).select(F.col(k).alias("key"), F.col(i).cast("long").alias("id")) for t, k, i in (("customer", "c_nationkey", "c_custkey"), ("supplier", "s_nationkey", "s_suppkey"), ("nation", "n_nationkey", "n_regionkey"))]
    return flow.merge_sorted(ins, ["key"])


@query("SELECT l_orderkey, l_returnflag, l_linestatus, count(*) AS n, min(l_linenumber) AS first, max(l_linenumber) AS last FROM lineitem GROUP BY ALL")
def group_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order and state: groups are orders, so no list is long."""
    lists = flow.group_by_prefix(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"], ["l_linenumber"])
    items = F.col("items")
    return lists.select("l_orderkey", "l_returnflag", "l_linestatus", F.size(items).cast("long").alias("n"), items[0]["l_linenumber"].alias("first"), F.element_at(items, -1)["l_linenumber"].alias("last"))


_KEYS = "keys AS (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey + 20 FROM nation)"


@query(f"WITH {_KEYS} SELECT k, coalesce((SELECT list(c_custkey ORDER BY c_custkey) FROM customer WHERE c_nationkey = k), []) AS customers, coalesce((SELECT list(s_suppkey ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = k), []) AS suppliers, coalesce((SELECT list(n_name ORDER BY n_name) FROM nation WHERE n_nationkey + 20 = k), []) AS nations FROM keys")
def cogroup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ins = [
        table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey"),
        table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey"),
        table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 20).alias("k"), "n_name"),
    ]
    out = flow.cogroup_join(ins, ["k"])
    return out.select("k", F.col("g0.c_custkey").alias("customers"), F.col("g1.s_suppkey").alias("suppliers"), F.col("g2.n_name").alias("nations"))


@query("SELECT coalesce(d.k, l.k, o.k) AS k, coalesce(d.n, 0) AS n0, coalesce(l.n, 0) AS n1, coalesce(o.n, 0) AS n2 FROM (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1) d FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) l ON d.k = l.k FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) o ON coalesce(d.k, l.k) = o.k")
def cogroup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return flow.cogroup_counts([orders.select(F.col("o_orderkey").alias("k")), line.select(F.col("l_orderkey").alias("k")), orders.select(F.col("o_custkey").alias("k"))], ["k"])


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.semi_join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return flow.anti_join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), urgent, ["c_custkey"])


@query(f"WITH {reads_sql()}, {reads_sql('#2', 'mates')} SELECT a.doc_id, a.seq AS r1_seq, b.seq AS r2_seq FROM reads a JOIN mates b USING (doc_id)")
def paired_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.positional_zip([reads(spark, sf_dir).select("doc_id", "seq"), reads(spark, sf_dir, "#2").select("doc_id", "seq")], "doc_id")


@query("SELECT a.n_regionkey, a.n_nationkey AS c1, b.n_nationkey AS c2, c.n_nationkey AS c3 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey JOIN nation c ON c.n_regionkey = b.n_regionkey AND b.n_nationkey < c.n_nationkey")
def combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.combination_rows(table(spark, sf_dir, "nation"), "n_nationkey", ["n_regionkey"], 3)


@query("SELECT o_orderkey, o_custkey FROM orders")
def randomize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.randomize(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 17, "o_orderkey")


# mutations by their text: substitutions at two places and an insertion, by rules on the line
_MUTS = "CASE WHEN l_quantity > 25 THEN ['S' || substr('ACGT', CAST(l_partkey % 4 AS INTEGER) + 1, 1) || CAST(l_suppkey % 7 AS INTEGER) || substr('CGTA', CAST(l_partkey % 4 AS INTEGER) + 1, 1), 'I8A', 'I8C'] ELSE ['D' || 'G' || CAST(l_suppkey % 7 AS INTEGER)] END"


def _mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, part = (F.col("l_suppkey") % 7).cast("int").cast("string"), (F.col("l_partkey") % 4).cast("int")
    sub = F.concat(F.lit("S"), F.substring(F.lit("ACGT"), part + 1, F.lit(1)), at, F.substring(F.lit("CGTA"), part + 1, F.lit(1)))
    muts = F.when(F.col("l_quantity") > 25, F.array(sub, F.lit("I8A"), F.lit("I8C"))).otherwise(F.array(F.concat(F.lit("DG"), at)))
    return table(spark, sf_dir, "lineitem").select("l_linenumber", muts.alias("muts"), F.col("l_quantity").cast("long").alias("w"), F.lit(0).alias("lower"), (4 + F.col("l_linenumber")).alias("upper"))


_FUSED = f"m AS (SELECT l_linenumber, CASE WHEN l_quantity > 25 THEN [({_MUTS})[1], 'I8AC'] ELSE {_MUTS} END AS muts, CAST(l_quantity AS BIGINT) AS w, 4 + l_linenumber AS upper FROM lineitem), e AS (SELECT l_linenumber, w, unnest(muts) AS mutation FROM m)"


@query(f"WITH {_FUSED} SELECT l_linenumber, mutation, CAST(sum(w) AS BIGINT) AS weight FROM e GROUP BY ALL")
def mutation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.mutation_counts(_mutations(spark, sf_dir), "muts", "w", ["l_linenumber"])


@query(
    f"""WITH {_FUSED}, c AS (SELECT mutation, CAST(regexp_extract(mutation, '^[A-Z]+?([0-9]+)', 1) AS INTEGER) AS position, CAST(sum(w) AS BIGINT) AS weight FROM e GROUP BY ALL),
  d AS (SELECT p AS position, CAST(sum(w) AS BIGINT) AS coverage FROM m, unnest(range(0, upper)) u(p) GROUP BY p)
  SELECT mutation, position, weight, coverage FROM c JOIN d USING (position) WHERE weight > 0.02 * coverage"""
)
def mutation_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.mutation_consensus(_mutations(spark, sf_dir), "muts", "lower", "upper", "w", 0.02)
