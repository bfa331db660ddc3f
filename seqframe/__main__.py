"""Command line: `python -m seqframe COMMAND --help`."""

from __future__ import annotations

import argparse


def _session(args):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName(f"seqframe {args.command}")
    return (builder.master(args.master) if args.master else builder).getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqframe", description="Sequence analytics on Spark")
    top.add_argument("--master", help="Spark master, if not set otherwise")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *outputs: str):
        c = commands.add_parser(name, help=text, description=text)
        for o in outputs:
            c.add_argument(o)
        c.add_argument("--overwrite", action="store_true", help="replace an output that exists")
        return c

    command("fastq-to-parquet", "Reads as a table", "input", "output").add_argument("--offset", type=int, choices=(33, 64))
    trim = command("trim", "Cuts reads to their best stretch of good quality", "input", "output")
    trim.add_argument("--average-quality", type=float, default=20.0)
    trim.add_argument("--window", type=int, default=8)
    merge = command("merge", "Merges overlapping mates", "input1", "input2", "output")
    merge.add_argument("--min-overlap", type=int, default=15)
    merge.add_argument("--min-identity", type=float, default=0.9)
    commands.add_parser("queries", help="Names of the catalogue's queries")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import functions as F

    from .functions import merging, trimming
    from .plans import catalogue
    from .sources import reads as src

    if args.command == "queries":
        print("\n".join(catalogue.QUERIES))
        return 0
    spark, mode = _session(args), "overwrite" if args.overwrite else "errorifexists"
    if args.command == "fastq-to-parquet":
        src.write_reads(src.read_fastq(spark, args.input, args.offset), args.output, mode=mode)
    elif args.command == "trim":
        p = trimming.TrimParameters(args.average_quality, args.window)
        cut = src.read_fastq(spark, args.input).withColumn("t", trimming.trim_read(F.col("seq"), F.col("qual"), p))
        kept = cut.select("read_id", "description", "t.seq", "t.qual").filter("length(seq) > 0")
        src.write_fastq(kept, args.output, mode=mode)
    elif args.command == "merge":
        p = merging.MergeParameters(args.min_overlap, args.min_identity)
        both = src.read_paired_fastq(spark, args.input1, args.input2)
        mate = lambda i: F.struct(F.col(f"r{i}_seq").alias("seq"), F.col(f"r{i}_qual").alias("qual"))
        merged = both.withColumn("m", merging.merge_reads(mate(1), mate(2), p)).filter("m.merged")
        src.write_fastq(merged.select("read_id", F.col("r1_description").alias("description"), "m.seq", "m.qual"), args.output, mode=mode)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
