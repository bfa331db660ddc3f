"""Operators on streams: files of reads as they arrive, and running histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality
from ..operators.aggregates import histogram_bin


def stream_fastq(spark: SparkSession, folder: str, offset: int = 33, max_files: int = 16) -> DataFrame:
    """description, seq, qual of the records of each new file in the folder; a file is whole when it appears, and one task reads it."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", max_files).load(folder)
    lines = F.split(F.regexp_replace(F.decode("content", "UTF-8"), "\n$", ""), "\n")
    records = F.transform(F.sequence(F.lit(0), F.floor(F.size(lines) / 4).cast("int") - 1), lambda i: F.slice(lines, i * 4 + 1, 4))
    r = files.filter(F.length("content") > 0).select(F.explode(records).alias("r"))
    good = F.when(F.startswith(F.col("r")[0], F.lit("@")) & (F.length(F.col("r")[1]) == F.length(F.col("r")[3])), True).otherwise(F.raise_error(F.lit("not a FASTQ record")).cast("boolean"))
    return r.filter(good).select(F.expr("substring(r[0], 2)").alias("description"), F.translate(F.upper(F.col("r")[1]), ".", "N").alias("seq"), quality.decode(F.col("r")[3], offset).alias("qual"))


def running_histogram(stream: DataFrame, value: str, boundaries: list[float]) -> DataFrame:
    """bin, n: for output mode complete or update."""
    return stream.select(histogram_bin(F.col(value), boundaries).alias("bin")).filter("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))


def running_counts(stream: DataFrame, label: str, time: str | None = None, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Counts by label, in event-time windows with a watermark if a time column is given."""
    if time is None:
        return stream.groupBy(label).agg(F.count("*").alias("n"))
    return stream.withWatermark(time, late).groupBy(F.window(time, window), label).agg(F.count("*").alias("n"))
