"""FASTQ and FASTA: scans of files of any size, and sinks.

Plain files are read as text lines with their byte offsets known to Spark's splits no more than to us, so records are found by
content: a FASTQ record is four lines by position in its file, and positions come from a running count over the file's
splits.  Compressed files (.gz, .bz2) are decoded by Hadoop's codecs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import quality
from ..functions.hashing import resolve_wildcards

FASTQ_SCHEMA = "read_id long, description string, seq string, qual array<int>"
FASTA_SCHEMA = "id long, description string, seq string"


def compression_of(path: str) -> str | None:
    """By the ending of the name."""
    return {"gz": "gzip", "bz2": "bzip2"}.get(path.rsplit(".", 1)[-1].lower())


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (0-based in its file), value.

    Lines keep their order within a split; a first pass counts lines by (file, split start), and each line's number is its
    split's offset and its place in the split. Nothing is sorted.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    tagged = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value"), F.monotonically_increasing_id().alias("mono"))
    # monotonically_increasing_id counts within a partition; a partition may hold several splits, each a run of ids
    splits = tagged.groupBy("path", "start").agg(F.count("*").alias("n"), F.min("mono").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = splits.withColumn("before", before).select("path", "start", "first", "before")
    return tagged.join(placed, ["path", "start"]).select("path", (F.col("mono") - F.col("first") + F.col("before")).alias("line"), "value")


def _fail(condition: Column, message: str) -> Column:
    return F.when(condition, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True)


def guess_quality_offset(spark: SparkSession, path: str, sample: int = 4096) -> int:
    """33 or 64 by the characters of the first records' qualities; 33 if they could be either."""
    head = spark.read.text(path).limit(4 * sample).collect()
    chars = [ord(c) for i, r in enumerate(head) if i % 4 == 3 for c in r["value"]]
    low, high = any(c < 64 for c in chars), any(c > 33 + quality.FORMATS["phred33"][2] for c in chars)
    return 64 if high and not low else 33


def read_fastq(spark: SparkSession, path: str, offset: int | None = None, replace_wildcards: bool = False) -> DataFrame:
    """read_id (ordinal in its file), description, seq, qual; errors name what is wrong with a record.

    replace_wildcards: wildcards become letters drawn by read_id, with quality 0.
    """
    offset = guess_quality_offset(spark, path) if offset is None else offset
    lines = numbered_lines(spark, path)
    last = lines.groupBy("path").agg(F.max(F.struct("line", "value")).alias("m")).filter("m.value = ''").select("path", F.col("m.line").alias("line"))
    lines = lines.join(F.broadcast(last), ["path", "line"], "left_anti")  # one row a file: a blank last line
    rec = lines.groupBy("path", F.floor(F.col("line") / 4).alias("read_id")).agg(*[F.max(F.when(F.col("line") % 4 == i, F.col("value"))).alias(n) for i, n in enumerate(("head", "seq", "plus", "q"))])
    good = (
        _fail(F.col("q").isNull(), "truncated file")
        & _fail(~F.startswith(F.col("head"), F.lit("@")), "a record must start with @")
        & _fail(~F.startswith(F.col("plus"), F.lit("+")), "a record must have a + line")
        & _fail(F.contains("seq", F.lit("\r")), "carriage returns: convert the file to Unix line ends")
        & _fail(F.length("seq") != F.length("q"), "sequence and quality differ in length")
    )
    seq = F.translate(F.upper("seq"), ".", "N")
    out = rec.filter(good).select("read_id", F.substring("head", F.lit(2), F.length("head")).alias("description"), seq.alias("seq"), quality.decode(F.col("q"), offset).alias("qual"))
    if not replace_wildcards:
        return out
    wild = F.zip_with(F.split("seq", ""), F.col("qual"), lambda c, q: F.when(c.rlike("[^ACGT]"), 0).otherwise(q))
    return out.select("read_id", "description", resolve_wildcards(F.col("seq"), F.col("read_id")).alias("seq"), F.when(F.length("seq") == 0, F.col("qual")).otherwise(wild).alias("qual"))


def read_paired_fastq(spark: SparkSession, *paths: str, **options) -> DataFrame:
    """Mates by position: read_id, r1_description, r1_seq, r1_qual, r2_ ..; an error if the files differ in length."""
    from ..operators.dataflow import positional_zip

    return positional_zip([read_fastq(spark, p, **options) for p in paths], "read_id")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id (ordinal in its file), description, seq: lines joined, blanks removed.

    Records begin at lines with `>`; each split is cut there, so one long record is one row but files split between records.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    tagged = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("mono"))
    splits = tagged.groupBy("path", "start").agg(F.count("*").alias("n"), F.min("mono").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = tagged.join(splits.withColumn("before", before).drop("n"), ["path", "start"]).select((F.col("mono") - F.col("first") + F.col("before")).alias("id"), "value")
    rows = rows.filter(~((F.col("id") == 0) & (F.trim("value") == "")))
    rows = rows.filter(_fail((F.col("id") == 0) & ~F.startswith("value", F.lit(">")), "a record must start with >"))
    body = F.when(F.col("id") == 0, F.substring("value", F.lit(2), F.length("value"))).otherwise(F.col("value"))
    split = F.split(body, "\n", 2)
    return rows.select("id", F.trim(F.regexp_replace(split[0], "\r", "")).alias("description"), F.regexp_replace(F.coalesce(F.get(split, F.lit(1)), F.lit("")), r"\s", "").alias("seq"))


def fasta_as_reads(fasta: DataFrame, replace_wildcards: bool = False) -> DataFrame:
    """read_id, description, seq, qual: good quality everywhere, 0 for replaced wildcards."""
    up = fasta.select(F.col("id").alias("read_id"), "description", F.upper("seq").alias("seq"))
    good = quality.uniform(F.length("seq"))
    if not replace_wildcards:
        return up.withColumn("qual", good)
    marks = F.when(F.length("seq") == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split("seq", ""), lambda c: F.when(c.rlike("[^ACGT]"), 0).otherwise(quality.GOOD)))
    return up.withColumns({"qual": marks, "seq": resolve_wildcards(F.col("seq"), F.col("read_id"))})


def fastq_lines(df: DataFrame, offset: int = 33, seq: str = "seq", qual: str = "qual", description: str = "description") -> DataFrame:
    return df.select(F.concat_ws("\n", F.concat(F.lit("@"), F.coalesce(description, F.lit(""))), seq, F.lit("+"), quality.encode(F.col(qual), offset)).alias("value"))


def write_fastq(df: DataFrame, path: str, order: str = "read_id", offset: int = 33, compression: str = "none", mode: str = "errorifexists") -> None:
    """A folder of text files, together in order of reads."""
    fastq_lines(df.orderBy(order), offset).write.mode(mode).option("compression", compression).text(path)


def write_paired_fastq(df: DataFrame, path1: str, path2: str, order: str = "read_id", **options) -> None:
    """Two folders whose files hold the mates in the same order: both are written from one range-partitioned table."""
    from ..operators.storage import Stored

    ranged = Stored(df.orderBy(order), "pairs").df
    for i, path in ((1, path1), (2, path2)):
        mate = ranged.select(order, *[F.col(f"r{i}_{c}").alias(c) for c in ("description", "seq", "qual")])
        write_fastq(mate, path, order, **options)


def fasta_lines(df: DataFrame, width: int = 80, seq: str = "seq", description: str = "description") -> DataFrame:
    """An empty sequence has one blank line."""
    wrapped = F.regexp_replace(F.regexp_replace(F.col(seq), "(.{%d})" % width, "$1\n"), "\n$", "")
    return df.select(F.concat(F.lit(">"), F.coalesce(description, F.lit("")), F.lit("\n"), wrapped).alias("value"))


def write_fasta(df: DataFrame, path: str, order: str = "id", width: int = 80, compression: str = "none", mode: str = "errorifexists") -> None:
    fasta_lines(df.orderBy(order), width).write.mode(mode).option("compression", compression).text(path)


# --- typed tables instead of binary streams and indexes ---------------------------------------------------------------


def write_reads(df: DataFrame, path: str, order: str = "read_id", mode: str = "errorifexists") -> None:
    """Parquet in order of reads: ranges of ids are row groups, so a lookup reads few of them."""
    df.orderBy(order).write.mode(mode).option("compression", "lz4").parquet(path)


def take(spark: SparkSession, path: str, *numbers: int, order: str = "read_id") -> DataFrame:
    """Records by number; the filter reaches the scan."""
    return spark.read.parquet(path).filter(F.col(order).isin(*numbers))


def index_fasta(fasta: DataFrame) -> DataFrame:
    """token, id for each word of each description, to look records up by."""
    return fasta.select(F.explode(F.array_distinct(F.split(F.trim("description"), r"[\s|]+"))).alias("token"), "id").filter("token <> ''")


def lookup(fasta: DataFrame, token: str) -> DataFrame:
    """The record that a token names; an error if it names several."""
    ids = index_fasta(fasta).filter(F.col("token") == token).agg(F.collect_set("id").alias("ids"))
    one = ids.select(F.when(F.size("ids") > 1, F.raise_error(F.lit(f"several records match {token}")).cast("long")).otherwise(F.get("ids", F.lit(0))).alias("id"))
    return fasta.join(F.broadcast(one), "id")


def chunked(fasta: DataFrame, size: int = 4096) -> DataFrame:
    """ref_id, chunk_start, seq: long sequences as a table of stretches, to read regions from."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(size))
    return fasta.select(F.col("id").alias("ref_id"), F.explode(starts).alias("chunk_start"), "seq").withColumn("seq", F.substring("seq", F.col("chunk_start") + 1, F.lit(size)))


def regions(chunks: DataFrame, wanted: DataFrame, size: int = 4096) -> DataFrame:
    """wanted (ref_id, lower, upper, reversed) with seq: chunks that a region meets, joined by number; reversed reads the other strand.

    A region outside its sequence is an error.
    """
    from ..functions.sequence import reverse_complement

    ask = wanted.withColumn("region", F.monotonically_increasing_id())
    first, last = F.floor(F.col("lower") / size), F.floor((F.greatest(F.col("upper"), F.col("lower") + 1) - 1) / size)
    each = ask.withColumn("chunk_start", F.explode(F.sequence(first.cast("int") * size, last.cast("int") * size, F.lit(size))))
    met = each.join(chunks.withColumnRenamed("seq", "part"), ["ref_id", "chunk_start"], "left")
    low, high = F.greatest(F.col("lower"), F.col("chunk_start")), F.least(F.col("upper"), F.col("chunk_start") + size)
    piece = F.substring("part", low - F.col("chunk_start") + 1, high - low)
    whole = met.groupBy("region", "ref_id", "lower", "upper", "reversed").agg(F.sort_array(F.collect_list(F.struct("chunk_start", piece.alias("s")))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["s"]), "")
    checked = F.when(F.length(text) == F.col("upper") - F.col("lower"), text).otherwise(F.raise_error(F.lit("region outside the sequence")))
    return whole.select("ref_id", "lower", "upper", "reversed", F.when(F.col("reversed"), reverse_complement(checked)).otherwise(checked).alias("seq"))


def schema_of(kind: str) -> T.StructType:
    return T.StructType.fromDDL({"fastq": FASTQ_SCHEMA, "fasta": FASTA_SCHEMA}[kind])


def merge_fragments(df: DataFrame) -> DataFrame:
    """ref_id, lower, seq: fragments that overlap or touch as one; an error where two disagree on a letter."""
    w = Window.partitionBy("ref_id").orderBy("lower", F.length("seq"))
    reach = F.max(F.col("lower") + F.length("seq")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.select("ref_id", "lower", "seq", F.when(reach.isNull() | (F.col("lower") > reach), 1).otherwise(0).alias("new"))
    islands = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = islands.groupBy("ref_id", "island").agg(F.sort_array(F.collect_list(F.struct("lower", "seq"))).alias("p"))

    def add(acc: Column, f: Column) -> Column:
        at = f["lower"] - F.get(F.col("p"), F.lit(0))["lower"]
        both = F.greatest(F.lit(0), F.least(F.length(acc) - at, F.length(f["seq"])))
        agree = F.substring(acc, at + 1, both) == F.substring(f["seq"], F.lit(1), both)
        return F.when(agree, F.concat(acc, F.substring(f["seq"], both + 1, F.length(f["seq"])))).otherwise(F.raise_error(F.lit("fragments disagree")))

    return parts.select("ref_id", F.get("p", F.lit(0))["lower"].alias("lower"), F.aggregate("p", F.lit(""), add).alias("seq"))
