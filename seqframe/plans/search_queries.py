"""Queries of similarity joins, alignment, trimming, merging, mutations and clustering on derived reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alignment as al
from ..functions import merging as mg
from ..functions import mutations as mu
from ..functions import trimming as tr
from ..functions.sequence import reverse_complement
from ..operators import aggregates as agg
from ..operators import batch_alignment as ba
from ..operators import chained_alignment as ca
from ..operators import clustering as cl
from ..operators import fuzzy as fz
from . import scores_sql as dp
from . import trimming_sql
from .base import HEX, LETTERS, query, reads, reads_sql, seq_of, table

WITH = f"WITH {reads_sql()} "
RECURSIVE = f"WITH RECURSIVE {reads_sql()}"
#: Distinct reads and a changed form of each read (a letter changed, and a letter lost in every second), classes of equal ones by their first id.
FUZZY = f"""WITH {reads_sql()}, k AS (SELECT seq AS s, min(doc_id) AS k_id, count(*) AS k_rows FROM reads GROUP BY seq),
p AS (SELECT doc_id, CAST(doc_id % 13 + 3 AS INTEGER) AS i, seq FROM reads),
q AS (SELECT s, min(doc_id) AS q_id, count(*) AS q_rows FROM (SELECT doc_id, substr(seq, 1, i) || translate(substr(seq, i + 1, 1), 'ACGT', 'CGTA') || substr(seq, i + 2, 8) || CASE WHEN {{lost}} THEN '' ELSE substr(seq, i + 10, 1) END || substr(seq, i + 11) AS s FROM p) GROUP BY s) """


def _classes(spark: SparkSession, sf_dir: str, lose: bool) -> tuple[DataFrame, DataFrame]:
    """Queries and keys: one row for each distinct sequence, with the smallest id that bears it and the number of its rows."""
    seq, at = F.col("seq"), (F.col("doc_id") % 13 + 3).cast("int")
    kept = F.when(F.lit(lose) & (F.col("doc_id") % 2 == 0), F.lit("")).otherwise(F.substring(seq, at + 10, F.lit(1)))
    changed = F.concat(F.substring(seq, F.lit(1), at), F.translate(F.substring(seq, at + 1, F.lit(1)), "ACGT", "CGTA"), F.substring(seq, at + 2, F.lit(8)), kept, F.substring(seq, at + 11, F.lit(32)))
    base = reads(spark, sf_dir)
    group = lambda df: df.groupBy("s").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows"))
    return group(base.select("doc_id", changed.alias("s"))), group(base.select("doc_id", seq.alias("s")))


@query(FUZZY.format(lost="doc_id % 2 = 0") + "SELECT q_id, q_rows, k_id, k_rows FROM q JOIN k ON abs(len(q.s) - len(k.s)) <= 2 AND levenshtein(q.s, k.s) <= 2")
def fuzzy_join_lev(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, k = _classes(spark, sf_dir, True)
    return fz.fuzzy_join(q, k, "s", "s", fz.SearchLimits(2, 2, 2, 2, greedy=False), explain=False).select("q_id", "q_rows", "k_id", "k_rows")


@query(FUZZY.format(lost="doc_id % 2 = 0") + "SELECT q_id, k_id, levenshtein(q.s, k.s) AS edits FROM q JOIN k ON abs(len(q.s) - len(k.s)) <= 2 AND levenshtein(q.s, k.s) <= 2")
def fuzzy_join_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact kernel's edits; at penalties of 1 each the cheapest way has as many as the edit distance."""
    q, k = _classes(spark, sf_dir, True)
    found = fz.fuzzy_join(q, k, "s", "s", fz.SearchLimits(2, 2, 2, 2, penalties=(1.0, 1.0, 1.0), greedy=False))
    return found.select("q_id", "k_id", (F.col("mismatches") + F.col("deletions") + F.col("insertions")).cast("long").alias("edits"))


@query(FUZZY.format(lost="false") + "SELECT q_id, q_rows, k_id, k_rows, hamming(q.s, k.s) AS mismatches FROM q JOIN k ON hamming(q.s, k.s) <= 2")
def fuzzy_join_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, k = _classes(spark, sf_dir, False)
    out = fz.fuzzy_join(q, k, "s", "s", fz.SearchLimits(2, 0, 0, 2)).select("q_id", "q_rows", "k_id", "k_rows", "mismatches")
    return out.withColumn("mismatches", F.col("mismatches").cast("long"))


@query(
    WITH
    + """, h AS (SELECT q.doc_id AS query_id, r.doc_id AS ref_id, 32 - 2 * hamming(q.seq, r.seq) AS score FROM reads q JOIN reads r ON q.doc_id % 100 = 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM h)
  SELECT query_id, ref_id, CAST(score AS INTEGER) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE score >= greatest(-32.0, best * 0.1) AND rank <= 5"""
)
def brute_force_tophits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query ids divisible by 100 against all references."""
    r = reads(spark, sf_dir)
    queries = r.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "seq")
    return ba.substitution_hits(queries, r.select(F.col("doc_id").alias("ref_id"), "seq"), cut=ba.HitCut(-32, 0.1, 5))


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of even ids with a substitution and a deletion at places taken from doc_id, of odd ones with themselves backwards."""
    at = (F.col("doc_id") % 13 + 3).cast("int")
    seq = F.col("seq")
    letter = F.substring(F.lit("CGTA"), F.position(F.substring(seq, at + 1, F.lit(1)), F.lit("ACGT")), F.lit(1))
    changed = F.concat(F.substring(seq, F.lit(1), at), letter, F.substring(seq, at + 2, F.lit(8)), F.substring(seq, at + 11, F.lit(32)))
    return reads(spark, sf_dir).select("doc_id", "seq", F.when(F.col("doc_id") % 2 == 0, changed).otherwise(F.reverse("seq")).alias("other"))


def _checks(scoring: al.Scoring) -> tuple[Column, Column]:
    """Whether the mutations turn the stretch of seq into that of other, and add up to the score."""
    one = F.substring("seq", F.col("from1") + 1, F.col("to1") - F.col("from1"))
    two = F.substring("other", F.col("from2") + 1, F.col("to2") - F.col("from2"))
    moved = mu.move_column(F.col("mutations"), -F.col("from1"))
    subs, gone, come = (mu.count_kind(F.col("mutations"), kind) for kind in "SDI")
    kept = F.col("to1") - F.col("from1") - subs - gone
    if scoring.open == scoring.extend:
        cost = (gone + come) * scoring.open
    else:  # opened: indels that don't go on from the one before
        cost = (gone + come) * scoring.extend + mu.count_gaps(F.col("mutations")) * (scoring.open - scoring.extend)
    total = kept * int(scoring.matrix[0, 0]) + subs * int(scoring.matrix[0, 1]) + cost
    return (mu.mutate_column(one, moved) == two).alias("rebuilt"), (total == F.col("score")).alias("adds_up")


def _aligned(spark: SparkSession, sf_dir: str, scoring: al.Scoring, mode: str, band: int | None = None) -> DataFrame:
    """Of each alignment the score, and whether its mutations turn its stretch of one sequence into that of the other and add up to the score."""
    hit = al.align_columns(F.col("seq"), F.col("other"), scoring, mode, band)
    out = _planted(spark, sf_dir).withColumn("h", hit).select("doc_id", "seq", "other", "h.*")
    return out.select("doc_id", F.col("score").cast("long").alias("score"), *_checks(scoring))


@query(RECURSIVE + dp.SQL.format(**dp.linear(-5)))
def align_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir, al.LinearScoring.nucleotide(), "global")


@query(RECURSIVE + dp.AFFINE_SQL.format(**dp.affine(-10, -1)))
def align_global_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir, al.AffineScoring.nucleotide(), "global")


@query(RECURSIVE + dp.AFFINE_SQL.format(**dp.affine(-10, -1, local=True)))
def align_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir, al.AffineScoring.nucleotide(), "local")


@query(RECURSIVE + dp.SQL.format(**dp.linear(-5, band=3)))
def align_banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir, al.LinearScoring.nucleotide(), "global", 3)


@query(RECURSIVE + dp.AFFINE_SQL.format(**dp.affine(-10, -1, band=3)))
def align_banded_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir, al.AffineScoring.nucleotide(), "global", 3)


@query(RECURSIVE + dp.SQL.format(**dp.linear(-5, band=3, free_end=True)))
def align_banded_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beginnings of both are aligned inside a band, the ends are free."""
    return _aligned(spark, sf_dir, al.LinearScoring.nucleotide(), "left", 3)


@query(RECURSIVE + dp.AFFINE_SQL.format(**dp.affine(-10, -1, band=3, free_end=True, mirrored=True)))
def align_banded_affine_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of both are aligned inside a band, the beginnings are free."""
    return _aligned(spark, sf_dir, al.AffineScoring.nucleotide(), "right", 3)


@query(RECURSIVE + dp.SQL.format(**dp.linear(-5, free_end=True)))
def align_semi_local_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beginnings of both are aligned, the ends are free."""
    return _aligned(spark, sf_dir, al.LinearScoring.nucleotide(), "left")


@query(RECURSIVE + dp.SQL.format(**dp.linear(-5, free_end=True, mirrored=True)))
def align_semi_local_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of both are aligned, the beginnings are free."""
    return _aligned(spark, sf_dir, al.LinearScoring.nucleotide(), "right")


@query(WITH + "SELECT doc_id, 5 * m - 4 * (32 - m) AS score, 32 - m AS mutations FROM (SELECT doc_id, len(list_filter(range(1, 33), lambda i: substr(seq, i, 1) = substr(reverse(seq), i, 1))) AS m FROM reads)")
def align_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = al.substitution_columns(F.col("seq"), F.reverse("seq"))
    return reads(spark, sf_dir).withColumn("h", hit).select("doc_id", F.col("h.score").cast("long").alias("score"), mu.count_kind(F.col("h.mutations"), "S").cast("long").alias("mutations"))


def _queries_and_refs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """References of 96 letters from every text; queries of 40 letters of them with one changed."""
    digest = F.concat(F.md5("text"), F.md5(F.concat("text", F.lit("#1"))), F.md5(F.concat("text", F.lit("#2"))))
    long = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", seq_of(digest).alias("seq"))
    refs = long.select(F.col("doc_id").alias("ref_id"), "seq")
    at = (F.col("doc_id") / 10 % 50).cast("int")
    part = F.substring("seq", at + 1, F.lit(40))
    queries = long.select(F.col("doc_id").alias("query_id"), F.overlay(part, F.lit("A"), F.lit(20), F.lit(1)).alias("seq"))
    return queries, refs


def _between_classes(queries: DataFrame, refs: DataFrame, aligned: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Hits between classes of equal sequences, each under its smallest id, with the numbers of their rows."""
    group = lambda df, name: df.groupBy("seq").agg(F.min(f"{name}_id").alias(f"{name}_id"), F.count("*").alias(f"{name}_rows"))
    q, r = group(queries, "query"), group(refs, "ref")
    hits = aligned(q.drop("query_rows"), r.drop("ref_rows"))
    return hits.join(q.drop("seq"), "query_id").join(r.drop("seq"), "ref_id")


@query()
def seed_vote_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _between_classes(*_queries_and_refs(spark, sf_dir), lambda q, r: ba.seed_align(q, r, ba.PRESETS["strict"]).drop("start"))


@query()
def seed_clustered_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _between_classes(*_queries_and_refs(spark, sf_dir), lambda q, r: ba.clustered_align(q, r).drop("start"))


#: Queries of 59 letters, a changed one and a lost one among them, and the references that they come from; classes of equal sequences.
CHAINED = f"""WITH RECURSIVE digests AS (SELECT doc_id, translate(md5(text) || md5(text || '#1') || md5(text || '#2'), '{HEX}', '{LETTERS}') AS seq FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, seq, substr(seq, CAST(doc_id // 10 % 36 AS INTEGER) + 1, 60) AS s FROM digests),
asked AS (SELECT doc_id, seq AS r, substr(s, 1, 19) || translate(substr(s, 20, 1), 'ACGT', 'CGTA') || substr(s, 21, 20) || substr(s, 42) AS q FROM cut),
qs AS (SELECT q, any_value(r) AS r, min(doc_id) AS query_id, count(*) AS query_rows FROM asked GROUP BY q), rs AS (SELECT r, min(doc_id) AS ref_id, count(*) AS ref_rows FROM asked GROUP BY r),
pairs AS (SELECT query_id AS doc_id, r AS a, q AS b FROM qs)"""
CHAINED_HITS = " SELECT query_id, query_rows, ref_id, ref_rows, score, rebuilt, adds_up FROM found JOIN qs ON query_id = doc_id JOIN rs USING (r)"


def _chained(spark: SparkSession, sf_dir: str, scoring: al.Scoring) -> DataFrame:
    """Hits of changed parts of every text's letters in those of all texts, between classes of equal sequences.

    The score is the best of the full local matrix of a query and the text it comes from; no other text comes near.
    """
    digest = F.concat(F.md5("text"), F.md5(F.concat("text", F.lit("#1"))), F.md5(F.concat("text", F.lit("#2"))))
    long = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", seq_of(digest).alias("r"))
    s = F.substring("r", (F.col("doc_id") / 10 % 36).cast("int") + 1, F.lit(60))
    part = lambda i, n: F.substring(s, i, n)
    asked = long.select("doc_id", "r", F.concat(part(1, 19), F.translate(part(20, 1), "ACGT", "CGTA"), part(21, 20), part(42, 60)).alias("q"))
    group = lambda seq, name: asked.groupBy(F.col(seq).alias("seq")).agg(F.min("doc_id").alias(f"{name}_id"), F.count("*").alias(f"{name}_rows"))
    q, r = group("q", "query"), group("r", "ref")
    hits = ca.chain_align(q.drop("query_rows"), r.drop("ref_rows"), ca.ChainParameters(scoring=scoring, cut=ba.HitCut(150, 0.87, 5)))
    both = hits.join(q.withColumnRenamed("seq", "other"), "query_id").join(r, "ref_id")
    return both.select("query_id", "query_rows", "ref_id", "ref_rows", F.col("score").cast("long").alias("score"), *_checks(scoring))


@query(CHAINED + dp.affine_scores(-5, -5, "found") + CHAINED_HITS)
def chain_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chained(spark, sf_dir, al.LinearScoring.nucleotide())


@query(CHAINED + dp.affine_scores(-10, -1, "found") + CHAINED_HITS)
def chain_align_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chained(spark, sf_dir, al.AffineScoring.nucleotide())


@query()
def batch_align_brute_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query ids divisible by 100 against all references."""
    queries, refs = _queries_and_refs(spark, sf_dir)
    return _between_classes(queries.filter("query_id % 100 = 0"), refs, lambda q, r: ba.brute_force(q, r, cut=ba.HitCut(60, 0.9, 3)))


SOURCE = f"{RECURSIVE}, src AS (SELECT doc_id, qual AS q FROM reads), {trimming_sql.islands('src')} "


@query(SOURCE + "SELECT doc_id, lower, upper FROM reads LEFT JOIN islands_best USING (doc_id)")
def best_island(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tr.best_island_range(F.col("qual"), tr.TrimParameters(8.0, 4))
    return reads(spark, sf_dir).select("doc_id", r.alias("r")).select("doc_id", "r.lower", "r.upper")


@query(SOURCE + "SELECT doc_id, lower, upper FROM islands")
def quality_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.explode(tr.island_ranges(F.col("qual"), tr.TrimParameters(8.0, 4)))
    return reads(spark, sf_dir).select("doc_id", r.alias("r")).select("doc_id", "r.lower", "r.upper")


@query(
    WITH
    + """, c AS (SELECT doc_id, CAST(doc_id % 5 AS INTEGER) AS lower, CAST(32 - doc_id % 3 AS INTEGER) AS upper, doc_id % 7 = 0 AS gone FROM reads)
  SELECT count(*) AS reads, count(*) FILTER (WHERE NOT gone AND lower > 0) AS left_events, CAST(coalesce(sum(lower) FILTER (WHERE NOT gone), 0) AS BIGINT) AS left_nucleotides,
  count(*) FILTER (WHERE NOT gone AND upper < 32) AS right_events, CAST(coalesce(sum(32 - upper) FILTER (WHERE NOT gone), 0) AS BIGINT) AS right_nucleotides,
  count(*) FILTER (WHERE gone) AS dropped_reads, CAST(32 * count(*) FILTER (WHERE gone) AS BIGINT) AS dropped_nucleotides FROM c"""
)
def trim_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.col("doc_id") % 7 == 0
    cut = reads(spark, sf_dir).select(F.length("seq").alias("n"), F.when(~gone, F.col("doc_id") % 5).alias("lower"), F.when(~gone, 32 - F.col("doc_id") % 3).alias("upper"))
    return agg.trimming_report(cut, "n", "lower", "upper")


def _struct(seq: Column, qual: Column) -> Column:
    return F.struct(seq.alias("seq"), qual.alias("qual"))


@query(
    f"""WITH {reads_sql()}, {reads_sql('#2', 'mates')}
  SELECT a.doc_id, true AS merged, a.seq || b.seq AS seq, a.qual[1:24] || list_transform(a.qual[25:32] || b.qual[1:8], lambda x: least(50, 2 * x)) || b.qual[9:32] AS qual,
  CAST(16 AS INTEGER) AS overlap, CAST(0 AS INTEGER) AS errors, true AS reversed, CAST(24 AS INTEGER) AS "offset", CAST(1 AS DOUBLE) AS identity, CAST(32 AS INTEGER) AS score FROM reads a JOIN mates b USING (doc_id)"""
)
def merge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mates planted on a sequence of 64 letters with an overlap of 16."""
    a, b = reads(spark, sf_dir), reads(spark, sf_dir, "#2").select("doc_id", F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    both = a.join(b, "doc_id")
    mate1 = F.concat("seq", F.substring("seq2", 1, 8))
    mate2 = F.concat(F.substring("seq", 25, 8), F.col("seq2"))
    q1, q2 = F.concat("qual", F.slice("qual2", 1, 8)), F.concat(F.slice("qual", 25, 8), F.col("qual2"))
    merged = mg.merge_reads(_struct(mate1, q1), _struct(reverse_complement(mate2), F.reverse(q2)), mg.MergeParameters(12, 0.9))
    return both.withColumn("m", merged).select("doc_id", "m.*")


MUTS = "'S' || substr(seq, 4, 1) || '3' || translate(substr(seq, 4, 1), 'ACGT', 'CGTA') || 'D' || substr(seq, 11, 1) || '10' || 'I20G'"


def _muts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.substring("seq", i, 1)
    text = F.concat(F.lit("S"), at(4), F.lit("3"), F.translate(at(4), "ACGT", "CGTA"), F.lit("D"), at(11), F.lit("10I20G"))
    return reads(spark, sf_dir).select("doc_id", "seq", text.alias("muts"))


@query(WITH + f", m AS (SELECT doc_id, seq, {MUTS} AS muts FROM reads) SELECT doc_id, muts, CAST(2 AS INTEGER) AS indels, CAST(0 AS INTEGER) AS delta, true AS fits, [3 * 4096 + (instr('AGCT', substr(seq, 4, 1)) - 1) * 128 + 32 + instr('AGCT', translate(substr(seq, 4, 1), 'ACGT', 'CGTA')) - 1, 10 * 4096 + (instr('AGCT', substr(seq, 11, 1)) - 1) * 128 + 64, 20 * 4096 + 96 + 1]::INTEGER[] AS packed FROM m")
def mutations_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("muts")
    return _muts(spark, sf_dir).select("doc_id", "muts", mu.count_kind(m, "ID").alias("indels"), mu.length_delta_column(m).alias("delta"), mu.compatible(F.col("seq"), m).alias("fits"), mu.packed(m).alias("packed"))


@query(WITH + "SELECT doc_id, substr(seq, 1, 3) || translate(substr(seq, 4, 1), 'ACGT', 'CGTA') || substr(seq, 5, 6) || substr(seq, 12, 9) || 'G' || substr(seq, 21) AS mutated, seq AS back, -11 AS deleted_to_seq2, CAST(15 AS INTEGER) AS p16 FROM reads")
def mutate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("muts")
    changed = _muts(spark, sf_dir).withColumn("mutated", mu.mutate_column(F.col("seq"), m))
    return changed.select("doc_id", "mutated", mu.mutate_column(F.col("mutated"), mu.invert_column(m)).alias("back"), mu.to_seq2_column(m, F.lit(10)).alias("deleted_to_seq2"), mu.to_seq2_column(m, F.lit(16)).alias("p16"))


_SUB = "translate(substr(seq, 4, 1), 'ACGT', 'CGTA')"


@query(WITH + f"SELECT doc_id, 'T' || substr(x, 2, 4) || substr(x, 7, 14) || 'C' || substr(x, 21) AS \"both\", true AS same FROM (SELECT doc_id, substr(seq, 1, 3) || {_SUB} || substr(seq, 5, 6) || substr(seq, 12, 9) || 'G' || substr(seq, 21) AS x FROM reads)")
def mutations_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutations of a mutated read, combined with those that made it."""
    once = _muts(spark, sf_dir).withColumn("x", mu.mutate_column(F.col("seq"), F.col("muts")))
    at = lambda i: F.substring("x", i, 1)
    first = F.when(at(1) == "T", F.lit("")).otherwise(F.concat(F.lit("S"), at(1), F.lit("0T")))
    twice = once.withColumn("more", F.concat(first, F.lit("D"), at(6), F.lit("5I20C")))
    twice = twice.withColumn("both", mu.mutate_column(F.col("seq"), mu.combine_column(F.col("muts"), F.col("more"))))
    return twice.select("doc_id", "both", (F.col("both") == mu.mutate_column(F.col("x"), F.col("more"))).alias("same"))


@query(WITH + f"SELECT doc_id, substr(seq, 3, 1) || {_SUB} || substr(seq, 5, 6) || substr(seq, 12, 1) AS part FROM reads")
def mutations_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stretch of a read becomes: letters 2 to 12."""
    inside = mu.in_range_column(F.col("muts"), F.lit(2), F.lit(12))
    return _muts(spark, sf_dir).select("doc_id", mu.mutate_column(F.substring("seq", 3, 10), inside).alias("part"))


@query(WITH + f"SELECT doc_id, {MUTS} AS muts FROM reads")
def mutations_from_btop(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.substring("seq", i, 1)
    text = F.concat(F.lit("3"), F.translate(at(4), "ACGT", "CGTA"), at(4), F.lit("6-"), at(11), F.lit("9G-"))
    return reads(spark, sf_dir).select("doc_id", mu.btop_column(text).alias("muts"))


#: Objects of the clustering: distinct reads (weight 8) and forms of them with one letter changed (weight 3) and two (weight 1).
CLUSTERS = (
    WITH
    + """, p AS (SELECT doc_id, seq, CAST(doc_id % 7 + 2 AS INTEGER) AS i FROM reads),
f AS (SELECT seq, 8 AS w FROM p UNION ALL SELECT substr(seq, 1, i) || translate(substr(seq, i + 1, 1), 'ACGT', 'CGTA') || substr(seq, i + 2), 3 FROM p
  UNION ALL SELECT substr(seq, 1, i) || translate(substr(seq, i + 1, 1), 'ACGT', 'CGTA') || substr(seq, i + 2, 9) || translate(substr(seq, i + 11, 1), 'ACGT', 'GTAC') || substr(seq, i + 12), 1 FROM p),
o AS (SELECT seq, max(w) AS weight FROM f GROUP BY seq),
k AS (SELECT seq, weight, row_number() OVER (ORDER BY weight DESC, translate(seq, 'AGCT', '3210')) AS place FROM o),
e AS (SELECT a.place AS parent, b.place AS child FROM k a JOIN k b ON a.weight > b.weight AND hamming(a.seq, b.seq) = 1),
top AS (SELECT place, place AS root, 0 AS depth FROM k WHERE weight = 8),
mid AS (SELECT k.place, min(parent) AS parent FROM k LEFT JOIN e ON child = place AND parent IN (SELECT place FROM top) WHERE weight = 3 GROUP BY k.place),
mids AS (SELECT place, coalesce(parent, place) AS root, parent, CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS depth FROM mid),
two AS (SELECT place, root, depth FROM top UNION ALL SELECT place, root, depth FROM mids),
low AS (SELECT k.place, min((t.root, t.depth, t.place)) AS best FROM k LEFT JOIN e ON child = k.place LEFT JOIN two t ON t.place = parent AND t.depth < 2 WHERE weight = 1 GROUP BY k.place),
every AS (SELECT place, root, NULL::BIGINT AS parent, 0 AS depth FROM top UNION ALL SELECT place, root, parent, depth FROM mids
  UNION ALL SELECT place, coalesce(best[1], place), best[3], CASE WHEN best[1] IS NULL THEN 0 ELSE best[2] + 1 END FROM low)
SELECT k.seq, r.seq AS root, p.seq AS parent, CAST(depth AS INTEGER) AS depth FROM every v JOIN k USING (place) JOIN k r ON r.place = v.root LEFT JOIN k p ON p.place = v.parent"""
)


@query(CLUSTERS)
def cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read of 32 letters fills the 64 bits of its id."""
    seq, at = F.col("seq"), (F.col("doc_id") % 7 + 2).cast("int")
    first, rest = F.substring(seq, F.lit(1), at), F.substring(seq, at + 2, F.lit(32))
    one = F.concat(first, F.translate(F.substring(seq, at + 1, F.lit(1)), "ACGT", "CGTA"), rest)
    two = F.concat(F.substring(one, F.lit(1), at + 10), F.translate(F.substring(one, at + 11, F.lit(1)), "ACGT", "GTAC"), F.substring(one, at + 12, F.lit(32)))
    forms = F.explode(F.array(*[F.struct(s.alias("seq"), F.lit(w).alias("w")) for s, w in ((seq, 8), (one, 3), (two, 1))]))
    objects = reads(spark, sf_dir).select(forms.alias("f")).groupBy("f.seq").agg(F.max("f.w").alias("weight"))
    coded = objects.withColumn("id", F.conv(F.translate("seq", "AGCT", "0123"), 4, -10).cast("long"))
    out = cl.cluster(coded, cl.ClusteringStrategy(fz.SearchLimits(1, 0, 0, 1), max_depth=2))
    name = lambda c: F.translate(F.lpad(F.conv(F.col(c).cast("string"), 10, 4), 32, "0"), "0123", "AGCT").alias(c.removesuffix("_id"))
    return out.select(name("id").alias("seq"), name("root_id"), name("parent_id"), "depth")
