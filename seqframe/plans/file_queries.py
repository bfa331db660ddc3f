"""Queries that go through files, and further operators on derived reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, merging, motif, mutations, quality, simulation, text
from ..functions import sequence as s
from ..functions.alignment import AffineScoring, align_columns
from ..operators import aggregates as agg
from ..operators import intervals as iv
from ..operators import reads as rd
from ..operators import views
from ..operators.storage import new_path
from ..sources import reads as src
from . import trimming_sql
from .base import query, reads, reads_sql, table

WITH = f"WITH {reads_sql()} "


def _records(spark: SparkSession, sf_dir: str, salt: str = "") -> DataFrame:
    return reads(spark, sf_dir, salt).select(F.col("doc_id").alias("read_id"), F.concat(F.lit("doc "), F.col("doc_id")).alias("description"), "seq", "qual")


@query(WITH + "SELECT 'doc ' || doc_id AS description, seq, qual FROM reads")
def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "fastq")
    src.write_fastq(_records(spark, sf_dir), path, compression="gzip")
    return src.read_fastq(spark, f"{path}/*.gz", 33).drop("read_id")


@query(f"WITH {reads_sql()}, {reads_sql('#2', 'mates')} SELECT 'doc ' || a.doc_id AS r1_description, a.seq AS r1_seq, b.seq AS r2_seq FROM reads a JOIN mates b USING (doc_id)")
def paired_fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = (_records(spark, sf_dir, salt) for salt in ("", "#2"))
    paths = [new_path(spark, "mate") for _ in range(2)]
    for d, p in zip((one, two), paths, strict=True):
        src.write_fastq(d, p)
    return _paired_by_name(spark, paths).select("r1_description", "r1_seq", "r2_seq")


def _paired_by_name(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A folder of several files has ordinals by file, so mates meet by their description."""
    a, b = (src.read_fastq(spark, f"{p}/part-*", 33).drop("read_id") for p in paths)
    from ..operators.dataflow import positional_zip

    return positional_zip([a.withColumn("name", F.col("description")), b.withColumn("name", F.col("description"))], "name")


@query(WITH + "SELECT 'doc ' || doc_id AS description, seq FROM reads")
def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "fasta")
    src.write_fasta(_records(spark, sf_dir).withColumnRenamed("read_id", "id"), path, width=10)
    return src.read_fasta(spark, f"{path}/part-*").drop("id")


@query(WITH + "SELECT doc_id AS ref_id, CAST(doc_id % 9 AS INTEGER) AS lower, CAST(20 + doc_id % 9 AS INTEGER) AS upper, doc_id % 2 = 1 AS reversed, CASE WHEN doc_id % 2 = 1 THEN reverse(translate(substr(seq, 1 + doc_id % 9, 20), 'ACGT', 'TGCA')) ELSE substr(seq, 1 + doc_id % 9, 20) END AS seq FROM reads")
def fasta_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = reads(spark, sf_dir).select(F.col("doc_id").alias("id"), F.lit("").alias("description"), "seq")
    at = (F.col("id") % 9).cast("int")
    want = refs.select(F.col("id").alias("ref_id"), at.alias("lower"), (at + 20).alias("upper"), (F.col("id") % 2 == 1).alias("reversed"))
    return src.regions(src.chunked(refs, 8), want, 8)


@query(WITH + "SELECT doc_id AS read_id, seq, list_transform(range(0, 32), lambda i: CAST(34 AS INTEGER)) AS qual FROM reads".replace("list_transform(range(0, 32), lambda i: CAST(34 AS INTEGER))", "list_resize([]::INTEGER[], 32, CAST(34 AS INTEGER))"))
def fasta_as_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.fasta_as_reads(_records(spark, sf_dir).select(F.col("read_id").alias("id"), "description", F.lower("seq").alias("seq"))).drop("description")


@query(WITH + "SELECT source, list(doc_id ORDER BY doc_id) AS ids, list(seq ORDER BY doc_id) AS seqs FROM reads GROUP BY source")
def group_to_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = agg.group_to_list(reads(spark, sf_dir), ["source"], ["doc_id"], ["seq"])
    return lists.select("source", F.col("items.doc_id").alias("ids"), F.col("items.seq").alias("seqs"))


@query(f"WITH {reads_sql()}, {reads_sql('#2', 'mates')}, t AS (SELECT doc_id, unnest([{{'l': a.seq, 'r': reverse(translate(b.seq, 'ACGT', 'TGCA'))}}, {{'l': b.seq, 'r': reverse(translate(a.seq, 'ACGT', 'TGCA'))}}]) AS x FROM reads a JOIN mates b USING (doc_id)) SELECT doc_id, x.l AS left_seq, x.r AS right_seq FROM t")
def layout_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    mate = lambda p: F.struct(F.col(f"{p}seq").alias("seq"), F.col(f"{p}qual").alias("qual"))
    both = reads(spark, sf_dir).join(reads(spark, sf_dir, "#2").select("doc_id", F.col("seq").alias("m_seq"), F.col("qual").alias("m_qual")), "doc_id")
    return both.select("doc_id", F.explode(merging.targets(mate(""), mate("m_"), "Opposite")).alias("t")).select("doc_id", F.col("t.left.seq").alias("left_seq"), F.col("t.right.seq").alias("right_seq"))


@query(WITH + "SELECT doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq, list_reverse(qual) AS qual, list_reverse(qual)[3:7] AS part FROM reads")
def read_reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = quality.read_reverse_complement(quality.read(F.col("seq"), F.col("qual")))
    out = reads(spark, sf_dir).select("doc_id", turned.alias("r"))
    return out.select("doc_id", "r.seq", "r.qual", quality.read_range(F.col("r"), F.lit(2), F.lit(7))["qual"].alias("part"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'Y' ELSE 'R' END AS w, list_has_any(['A', 'G'], CASE WHEN c_acctbal < 0 THEN ['C', 'T'] ELSE ['A', 'G'] END) AS purine FROM customer")
def wildcard_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.alphabet import basic_mask

    letter = F.when(F.col("c_acctbal") < 0, "Y").otherwise("R")
    mask = F.when(letter == "Y", basic_mask("Y")).otherwise(basic_mask("R"))
    return table(spark, sf_dir, "customer").select("c_custkey", letter.alias("w"), (mask.bitwiseAND(F.lit(basic_mask("R"))) != 0).alias("purine"))


@query(WITH + ", e AS (SELECT doc_id, unnest(range(1, 33)) AS i, seq FROM reads), c AS (SELECT doc_id, i FROM e WHERE substr(seq, i, 1) IN ('C', 'G')) SELECT doc_id, CAST(count(*) AS INTEGER) AS gc, format('{:.3f}%', count(*) * 100.0 / 32) AS share FROM c GROUP BY doc_id")
def gc_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    gc = s.gc_count(F.col("seq"))
    return reads(spark, sf_dir).filter(gc > 0).select("doc_id", gc.alias("gc"), text.percent(gc, F.length("seq"), 3).alias("share"))


@query("SELECT l_linenumber, l_returnflag, CAST(sum(l_quantity) AS BIGINT) AS weight, CAST(count(*) FILTER (WHERE l_quantity > 30) AS BIGINT) AS heavy FROM lineitem GROUP BY ALL")
def weighted_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(F.sum("l_quantity").cast("long").alias("weight"), F.count_if(F.col("l_quantity") > 30).alias("heavy"))


@query("WITH iv AS (SELECT l_orderkey AS g, l_linenumber AS id, CAST(l_partkey % 100 AS INTEGER) AS lower, CAST(l_partkey % 100 + l_quantity AS INTEGER) AS upper FROM lineitem), r AS (SELECT *, max(upper) OVER (PARTITION BY g ORDER BY lower, upper ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv) SELECT g, count(*) AS overlaps FROM r WHERE reach > lower OR lower >= upper GROUP BY g")
def overlapping_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("l_partkey") % 100).cast("int")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("id"), at.alias("lower"), (at + F.col("l_quantity").cast("int")).alias("upper"))
    return iv.overlapping_neighbours(rows, ["g"]).groupBy("g").agg(F.count("*").alias("overlaps"))


#: Least errors of the motif against a stretch that ends at each place, row by row; hits beside one with an error fewer are left out.
MOTIF = f"""WITH RECURSIVE {reads_sql()}, dp(doc_id, seq, i, row) AS (
  SELECT doc_id, seq, 0, range(0, 9) FROM reads
  UNION ALL
  SELECT doc_id, seq, i + 1, list_transform(range(0, 9), lambda j: list_min(list_slice(t, 1, j + 1)) + j) FROM (
    SELECT doc_id, seq, i, list_transform(range(0, 9), lambda j: CASE WHEN j = 0 THEN 0 ELSE least(row[j] + CASE WHEN substr('ACGTTGCA', j, 1) = substr(seq, i + 1, 1) THEN 0 ELSE 1 END, row[j + 1] + 1) - j END) AS t FROM dp WHERE i < len(seq))),
hits AS (SELECT doc_id, i - 1 AS position, row[9] AS errors FROM dp WHERE i > 0 AND row[9] <= 2)
SELECT doc_id, CAST(position AS INTEGER) AS position, CAST(errors AS INTEGER) AS errors FROM hits h
WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.doc_id = h.doc_id AND abs(o.position - h.position) = 1 AND o.errors = h.errors - 1)"""


@query(MOTIF)
def motif_indels(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = motif.indel_hits(F.col("seq"), "ACGTTGCA", 2, "last", False)
    return reads(spark, sf_dir).select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.position", "h.errors")


@query()
def simulated_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutations by a model, applied and undone."""
    model = simulation.MutationModel(simulation.uniform_substitutions(0.05), 0.02, 0.02)
    made = reads(spark, sf_dir).select("doc_id", "seq", simulation.generate_column(F.col("seq"), F.col("doc_id"), model).alias("muts"))
    changed = made.withColumn("mutated", mutations.mutate_column(F.col("seq"), F.col("muts")))
    back = mutations.mutate_column(F.col("mutated"), mutations.invert_column(F.col("muts")))
    return changed.select("doc_id", "muts", "mutated", (back == F.col("seq")).alias("undone"))


@query()
def alignment_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.concat(F.substring("seq", 1, 10), F.lit("A"), F.substring("seq", 11, 8), F.substring("seq", 20, 20))
    hit = align_columns(F.col("seq"), other, AffineScoring.nucleotide())
    out = reads(spark, sf_dir).select("doc_id", "seq", hit.alias("h"))
    return out.withColumn("v", views.alignment_summary(F.col("seq"), F.col("h"))).select("doc_id", "v.cigar", "v.similarity", "v.text")


@query()
def resolved_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("doc_id", hashing.resolve_wildcards(F.concat(F.lit("NRY"), F.col("seq")), F.col("doc_id")).alias("seq"))


MATES = f"""WITH RECURSIVE {reads_sql()}, q1 AS (SELECT doc_id, qual AS q FROM reads), q2 AS (SELECT doc_id, list_reverse(qual) AS q FROM reads),
{trimming_sql.islands('q1', 'one')}, {trimming_sql.islands('q2', 'two')},
cut AS (SELECT doc_id, coalesce(substr(seq, a.lower + 1, a.upper - a.lower), '') AS r1_seq, coalesce(substr(translate(reverse(seq), 'ACGT', 'TGCA'), b.lower + 1, b.upper - b.lower), '') AS r2_seq,
  CAST(coalesce(a.upper - a.lower, 0) AS INTEGER) AS n1 FROM reads LEFT JOIN one_best a USING (doc_id) LEFT JOIN two_best b USING (doc_id))
SELECT * FROM cut WHERE r1_seq <> '' OR r2_seq <> ''"""


@query(MATES)
def trimmed_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.trimming import TrimParameters

    pairs = reads(spark, sf_dir).select("doc_id", F.struct("seq", "qual").alias("r1"), F.struct(s.reverse_complement(F.col("seq")).alias("seq"), F.reverse("qual").alias("qual")).alias("r2"))
    cut = rd.drop_empty(rd.trim_mates(pairs, TrimParameters(8.0, 4)))
    return cut.select("doc_id", F.col("r1.seq").alias("r1_seq"), F.col("r2.seq").alias("r2_seq"), F.size("r1.qual").alias("n1"))


@query(WITH + "SELECT doc_id AS ref_id, 0 AS lower, seq FROM reads")
def merge_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads cut into overlapping stretches and put together again."""
    cut = reads(spark, sf_dir).select(F.col("doc_id").alias("ref_id"), "seq", F.explode(F.array(*[F.lit(x) for x in (0, 8, 10, 22)])).alias("lower"))
    return src.merge_fragments(cut.select("ref_id", "lower", F.substring("seq", F.col("lower") + 1, F.lit(14)).alias("seq")))
