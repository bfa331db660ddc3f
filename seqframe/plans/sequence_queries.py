"""Queries of scalar functions and aggregates on derived reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import motif, quality, ranges
from ..functions import sequence as s
from ..operators import aggregates as agg
from .base import query, reads, reads_sql, table

REVCOMP = "reverse(translate({0}, 'ACGT', 'TGCA'))"
WITH = f"WITH {reads_sql()} "
KMERS = f"WITH {reads_sql()}, k AS (SELECT doc_id, unnest(list_transform(range(1, 30), lambda i: substr(seq, i, 4))) AS kmer FROM reads) "

#: SQL for one codon's letter, by its place in the standard code (codons of A, C, G, T).
AA = "substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', 16 * (instr('TCAG', substr({s}, {i}, 1)) - 1) + 4 * (instr('TCAG', substr({s}, {i} + 1, 1)) - 1) + instr('TCAG', substr({s}, {i} + 2, 1)), 1)"
#: Lengths 20 to 32, so that all remainders occur.
CUT = "substr(seq, 1, CAST(20 + doc_id % 13 AS INTEGER))"


def _codons(seq: str, start: str, n: str) -> str:
    return f"coalesce(array_to_string(list_transform(range(0, {n}), lambda c: {AA.format(s=seq, i=f'({start} + 3 * c + 1)')}), ''), '')"


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("doc_id", F.substring("seq", F.lit(1), (20 + F.col("doc_id") % 13).cast("int")).alias("seq"))


@query(WITH + f"SELECT doc_id, seq, {REVCOMP.format('seq')} AS revcomp FROM reads")
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("doc_id", "seq", s.reverse_complement(F.col("seq")).alias("revcomp"))


@query(KMERS + "SELECT kmer, count(*) AS n FROM k GROUP BY kmer")
def kmer_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select(F.explode(s.kmers(F.col("seq"), 4)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


@query(KMERS + f"SELECT least(kmer, {REVCOMP.format('kmer')}) AS kmer, count(*) AS n FROM k GROUP BY 1 ORDER BY n DESC, kmer LIMIT 20")
def canonical_kmer_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = reads(spark, sf_dir).select(F.explode(s.kmers(F.col("seq"), 4)).alias("kmer"))
    return each.groupBy(s.canonical(F.col("kmer")).alias("kmer")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kmer").limit(20)


@query(WITH + "SELECT doc_id, CAST(len(seq) - len(replace(replace(seq, 'G', ''), 'C', '')) AS INTEGER) AS gc FROM reads")
def gc_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("doc_id", s.gc_count(F.col("seq")).alias("gc"))


@query(WITH + "SELECT doc_id, regexp_matches(t, '[^ACGT]') AS has_wildcards, regexp_full_match(t, '[AGCTNRYSWKMBDHV]*') AS valid FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN seq || 'N' WHEN 1 THEN seq ELSE seq || 'Z' END AS t FROM reads)")
def contains_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("seq", F.lit("N"))).when(F.col("doc_id") % 3 == 1, F.col("seq")).otherwise(F.concat("seq", F.lit("Z")))
    return reads(spark, sf_dir).select("doc_id", s.contains_wildcards(t).alias("has_wildcards"), s.belongs_to(t).alias("valid"))


@query(f"WITH {reads_sql()}, {reads_sql('#2', 'mates')} SELECT a.doc_id, CAST(len(list_filter(range(1, 33), lambda i: substr(a.seq, i, 1) <> substr(b.seq, i, 1))) AS INTEGER) AS mismatches FROM reads a JOIN mates b USING (doc_id)")
def mismatch_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = reads(spark, sf_dir).join(reads(spark, sf_dir, "#2").select("doc_id", F.col("seq").alias("mate")), "doc_id")
    return both.select("doc_id", s.mismatch_count(F.col("seq"), F.col("mate")).alias("mismatches"))


@query(WITH + "SELECT doc_id, CAST(instr(seq, 'ACG') - 1 AS INTEGER) AS at, -1 AS empty_at FROM reads")
def index_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("doc_id", s.index_of(F.col("seq"), F.lit("ACG")).alias("at"), s.index_of(F.col("seq"), F.lit("")).alias("empty_at"))


@query(
    WITH
    + """, letters AS (SELECT doc_id, i, substr(seq, i, 1) AS c FROM reads, unnest(range(1, 33)) u(i)),
  starts AS (SELECT *, CASE WHEN c = lag(c) OVER w THEN 0 ELSE 1 END AS s FROM letters WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  islands AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM starts),
  runs AS (SELECT doc_id, g, min(i) - 1 AS lower, max(i) AS upper FROM islands GROUP BY doc_id, g)
  SELECT doc_id, CAST(lower AS INTEGER) AS lower, CAST(upper AS INTEGER) AS upper FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY upper - lower DESC, lower) AS r FROM runs) WHERE r = 1"""
)
def longest_homopolymer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("doc_id", s.longest_homopolymer(F.col("seq")).alias("r")).select("doc_id", "r.lower", "r.upper")


N = f"len({CUT})"


@query(WITH + f"SELECT doc_id, {_codons(CUT, '1', f'({N} - 1) // 3')} AS aa FROM reads")
def translate_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir).select("doc_id", s.translate(F.col("seq"), frame=1).alias("aa"))


@query(WITH + f"SELECT doc_id, '_' || {_codons(CUT, '1', f'({N} - 1) // 3')} || CASE WHEN ({N} - 1) % 3 <> 0 THEN '_' ELSE '' END AS aa FROM reads")
def translate_from_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir).select("doc_id", s.translate(F.col("seq"), s.FROM_LEFT, frame=1).alias("aa"))


@query(WITH + f"SELECT doc_id, CASE WHEN {N} % 3 <> 0 THEN '_' ELSE '' END || {_codons(CUT, f'({N} % 3)', f'{N} // 3')} AS aa FROM reads")
def translate_from_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir).select("doc_id", s.translate(F.col("seq"), s.FROM_RIGHT).alias("aa"))


_LEFT = f"(({N} // 3 + 1) // 2)"
_RIGHT = f"({N} // 3 - {_LEFT})"


@query(WITH + f"SELECT doc_id, {_codons(CUT, '0', _LEFT)} || CASE WHEN {N} % 3 <> 0 THEN '_' ELSE '' END || {_codons(CUT, f'({N} - 3 * {_RIGHT})', _RIGHT)} AS aa FROM reads")
def translate_from_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir).select("doc_id", s.translate(F.col("seq"), s.FROM_CENTER).alias("aa"))


@query(WITH + f", aa AS (SELECT doc_id, {_codons('seq', '0', '10')} AS aa FROM reads) SELECT doc_id, CAST(len(aa) - len(replace(aa, '*', '')) AS INTEGER) AS stops, contains(aa, '*') AS has_stops FROM aa")
def count_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    aa = reads(spark, sf_dir).select("doc_id", s.translate(F.col("seq")).alias("aa"))
    return aa.select("doc_id", s.count_stops(F.col("aa")).alias("stops"), s.contains_stops(F.col("aa")).alias("has_stops"))


@query(WITH + f"SELECT doc_id, CAST(p AS INTEGER) AS nt, CAST(CASE WHEN p < {N} % 3 THEN 0 ELSE (p - {N} % 3) // 3 + CASE WHEN {N} % 3 <> 0 THEN 1 ELSE 0 END END AS INTEGER) AS aa, CAST(CASE WHEN p < {N} % 3 THEN p - {N} % 3 + 3 ELSE (p - {N} % 3) % 3 END AS INTEGER) AS in_codon FROM reads, unnest(range(0, 12)) u(p)")
def nt_to_aa_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _cut(spark, sf_dir).withColumn("nt", F.explode(F.sequence(F.lit(0), F.lit(11))))
    at = s.nt_to_aa_position(F.col("nt"), F.length("seq"), s.FROM_RIGHT)
    return each.select("doc_id", "nt", at.alias("p")).select("doc_id", "nt", "p.aa", "p.in_codon")


@query(WITH + "SELECT doc_id, seq[1 + doc_id % 8 : 10] AS part, CASE WHEN doc_id % 2 = 0 THEN seq[5:12] ELSE " + REVCOMP.format("seq[5:12]") + " END AS strand_part, seq[1:4] || seq[29:32] AS joined FROM reads")
def sub_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("seq")
    return reads(spark, sf_dir).select(
        "doc_id",
        s.sub_range(q, (F.col("doc_id") % 8).cast("int"), F.lit(10)).alias("part"),
        s.sub_range(q, F.lit(4), F.lit(12), F.col("doc_id") % 2 == 1).alias("strand_part"),
        F.concat(s.sub_range(q, F.lit(0), F.lit(4)), s.sub_range(q, F.lit(28), F.lit(32))).alias("joined"),
    )


@query(WITH + "SELECT doc_id, CASE WHEN len(t) < 24 THEN '' ELSE t[21:24] END AS key FROM (SELECT doc_id, " + CUT + " AS t FROM reads)")
def range_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir).select("doc_id", s.range_key(F.col("seq"), 20, 24).alias("key"))


@query(WITH + "SELECT doc_id, array_to_string(list_transform(range(1, 33), lambda i: ['00', '01', '10', '11'][instr('AGCT', substr(seq, i, 1))]), '') AS bits, seq AS back FROM reads")
def two_bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = reads(spark, sf_dir).select("doc_id", s.two_bit(F.col("seq")).alias("bits"))
    return bits.select("doc_id", "bits", s.from_two_bit(F.col("bits")).alias("back"))


# --- qualities ---------------------------------------------------------------------------------------------------


@query(WITH + "SELECT doc_id, list_min(qual) AS q_min, CAST(list_sum(qual) // 32 AS INTEGER) AS q_mean FROM reads")
def quality_min_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("qual")
    return reads(spark, sf_dir).select("doc_id", quality.min_value(q).alias("q_min"), quality.mean_value(q).alias("q_mean"))


@query(WITH + "SELECT doc_id, array_to_string(list_transform(qual, lambda x: chr(CAST(x + 33 AS INTEGER))), '') AS phred33, array_to_string(list_transform(list_reverse(qual), lambda x: chr(CAST(x + 64 AS INTEGER))), '') AS phred64_reversed, qual AS decoded FROM reads")
def quality_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("qual")
    return reads(spark, sf_dir).select("doc_id", quality.encode(q).alias("phred33"), quality.encode(F.reverse(q), 64).alias("phred64_reversed"), quality.decode(quality.encode(q), check="phred33").alias("decoded"))


_POINTS = WITH + ", p AS (SELECT doc_id % 50 AS k, i - 1 AS pos, qual[i] AS q FROM reads, unnest(range(1, 33)) u(i)), a AS (SELECT k, pos, {agg} AS q FROM p GROUP BY k, pos) SELECT k, list(CAST(q AS INTEGER) ORDER BY pos) AS qual FROM a GROUP BY k"


def _grouped(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return agg.aggregate_quality(reads(spark, sf_dir).withColumn("k", F.col("doc_id") % 50), ["k"], "qual", kind)

    return run


for _kind, _sql in (("min", "min(q)"), ("max", "max(q)"), ("sum", "least(50, sum(q))"), ("average", "(sum(q) + count(*) // 2) // count(*)")):
    query(_POINTS.format(agg=_sql), f"quality_agg_{_kind}")(_grouped(_kind))
query(WITH + "SELECT doc_id % 50 AS k, list_transform(range(0, 32), lambda i: max(list_min(qual))) AS qual FROM reads GROUP BY 1".replace("list_transform(range(0, 32), lambda i: max(list_min(qual)))", "list_resize([]::INTEGER[], 32, CAST(max(list_min(qual)) AS INTEGER))"), "quality_agg_minimax")(_grouped("minimax"))


# --- ranges ------------------------------------------------------------------------------------------------------

_LINES = "WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 50 AS INTEGER) AS a1, CAST(l_partkey % 50 + l_quantity AS INTEGER) AS a2, CAST(l_suppkey % 70 AS INTEGER) AS b1, CAST(l_suppkey % 70 + l_linenumber * 4 AS INTEGER) AS b2 FROM lineitem) "


def _range_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_partkey") % 50, F.col("l_suppkey") % 70
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ranges.of(a, a + F.col("l_quantity")).alias("a"), ranges.of(b, b + F.col("l_linenumber") * 4).alias("b"))


@query(_LINES + "SELECT l_orderkey, l_linenumber, greatest(a1, b1) AS lower, least(a2, b2) AS upper FROM r WHERE a1 < b2 AND b1 < a2 AND a1 < a2 AND b1 < b2")
def range_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _range_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", ranges.intersection(F.col("a"), F.col("b")).alias("i"))
    return both.filter("i IS NOT NULL").select("l_orderkey", "l_linenumber", "i.lower", "i.upper")


@query(
    _LINES
    + """SELECT l_orderkey, l_linenumber, a1 AS lower, least(a2, CASE WHEN hit THEN b1 ELSE a2 END) AS upper FROM (SELECT *, a1 < b2 AND b1 < a2 AND a1 < a2 AND b1 < b2 AS hit FROM r) WHERE NOT hit OR a1 < b1
  UNION ALL SELECT l_orderkey, l_linenumber, b2, a2 FROM r WHERE a1 < b2 AND b1 < a2 AND a1 < a2 AND b1 < b2 AND b2 < a2"""
)
def range_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _range_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", F.explode(ranges.without(F.col("a"), F.col("b"))).alias("p"))
    return pieces.select("l_orderkey", "l_linenumber", "p.lower", "p.upper")


@query(
    _LINES
    + """SELECT l_orderkey, l_linenumber, a1 <= b2 AND b1 <= a2 AS touches, b1 >= a1 AND b2 <= a2 AS holds,
  CASE WHEN a1 <= b2 AND b1 <= a2 THEN least(a1, b1) END AS merged_lower, CASE WHEN a1 <= b2 AND b1 <= a2 THEN greatest(a2, b2) END AS merged_upper,
  CASE WHEN b1 >= a1 AND b2 <= a2 THEN a2 - b1 END AS reversed_start, a1 + 7 AS moved FROM r"""
)
def range_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    merged = ranges.try_merge(a, b)
    held = ranges.contains_range(a, b)
    return _range_rows(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        ranges.intersects_or_touches(a, b).alias("touches"),
        held.alias("holds"),
        merged["lower"].alias("merged_lower"),
        merged["upper"].alias("merged_upper"),
        F.when(held, ranges.boundary_to_relative(ranges.reverse(a), b["lower"])).alias("reversed_start"),
        ranges.move(a, F.lit(7))["lower"].alias("moved"),
    )


# --- motifs ------------------------------------------------------------------------------------------------------

_MASKS = "[CT]", "G", "[AG]"


@query(WITH + "SELECT doc_id, list_transform(list_filter(range(1, 31), lambda i: regexp_full_match(substr(seq, i, 3), '[CT]G[AG]')), lambda i: CAST(i - 1 AS INTEGER)) AS positions, CAST(len(list_filter(range(1, 31), lambda i: regexp_full_match(substr(seq, i, 3), '[CT]G[AG]'))) AS INTEGER) AS n FROM reads")
def exact_motif(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = motif.exact_positions(F.col("seq"), "YGR")
    return reads(spark, sf_dir).select("doc_id", at.alias("positions"), F.size(at).alias("n"))


_MISM = "len(list_filter(range(0, 8), lambda j: substr(seq, i + j, 1) <> substr('ACGTTGCA', j + 1, 1)))"


@query(WITH + f", h AS (SELECT doc_id, i - 1 AS position, {_MISM} AS errors FROM reads, unnest(range(1, 26)) u(i)) SELECT doc_id, CAST(position AS INTEGER) AS position, CAST(errors AS INTEGER) AS errors FROM h WHERE errors <= 3")
def motif_k_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.explode(motif.substitution_hits(F.col("seq"), "ACGTTGCA", 3))
    return reads(spark, sf_dir).select("doc_id", hits.alias("h")).select("doc_id", "h.position", "h.errors")
