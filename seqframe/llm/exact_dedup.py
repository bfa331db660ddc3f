"""Exact deduplication by progressive refinement: length, then a prefix hash, then a full hash.

One scan takes each text's length and the hash of its first characters into a narrow table; the
groups are refined on that table alone.  A second scan hashes the full content of the rows whose
(length, prefix) is shared, as told by a bitmap of bounded size.  Copies are counted by partial
aggregates, so a group that holds a third of all rows is one row a task before the shuffle, and a
group's keeper reaches its rows without gathering them.  Built-in functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ROW, Stored, bitmap, bits_for, join_unique, keep_best, with_maybe, with_row_keys

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _digests(rows: DataFrame, prefix_chars: int, digest_all: bool) -> Stored:
    """rows (with `__text`) without their text, but with hit (other rows share length and prefix) and digest (of hits, or of all)."""
    whole = F.coalesce(F.col("__text"), F.lit(""))
    shape = {"__size": F.octet_length(whole).cast("long"), "__head": F.xxhash64(_lower(F.substring(whole, 1, prefix_chars)))}
    keys = Stored(rows.select(*[c.alias(n) for n, c in shape.items()]), "shapes")
    lengths = Stored(keys.df.groupBy("__size").agg(F.count("*").alias("n")).filter("n > 1").select("__size"), "lengths")
    bits = bits_for(lengths.df.count())
    shared = with_maybe(keys.df, bitmap(lengths.df, "__size", bits=bits), "__size", bits=bits).filter("maybe")
    heads = Stored(shared.groupBy("__size", "__head").agg(F.count("*").alias("n")).filter("n > 1").select("__size", "__head"), "heads")
    bits = bits_for(heads.df.count())
    marked = with_maybe(rows.withColumns(shape), bitmap(heads.df, "__size", "__head", bits=bits), "__size", "__head", bits=bits, name="hit")
    digest = F.unhex(F.sha2(_lower(whole), 256))
    full = Stored(marked.withColumn("digest", digest if digest_all else F.when(F.col("hit"), digest)).drop("__text", *shape), "digests")
    for t in (keys, lengths, heads):
        t.drop()
    return full


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", prefix_chars: int = 64, digest_all: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest.

    Texts are equal when identical after lower-casing A-Z; of equal texts the largest doc_id stays.
    Null counts as the empty text, and empty texts equal each other.  Repeated rows (same doc_id and
    text) count in group_size, and share `kept`; doc_ids that are null lose to any other.  An empty
    table gives no rows; other columns are ignored.  digest: SHA-256 of the lower-cased text, null
    for rows that an earlier level found unique unless digest_all.
    """
    full = _digests(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("__text")), prefix_chars, digest_all)
    copies = Stored(full.df.filter("hit").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")).filter("n > 1"), "copies")
    joined = join_unique(full.df.filter("hit"), copies.df, "digest", "n", "left")
    alone = full.df.filter("NOT hit").select("digest", "doc_id", "hit", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    out = joined.unionByName(alone)
    keep = F.when(F.coalesce("n", F.lit(1)) > 1, F.col("keep_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "digest")


def drop_exact_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row for each distinct text (after lower-casing A-Z): the one with the largest doc_id; its own columns.

    Null counts as the empty text, so of null and empty texts one row stays in all.  Null doc_ids lose to any other.  Rows that
    share text and doc_id are told apart by their other columns (the larger hash stays), and of rows equal in all columns one stays.
    An empty table gives no rows; columns of any name pass through.
    """
    full = _digests(with_row_keys(docs, __id=key, __text=text).select(*ROW, "__id", "__text"), 64, False)
    return keep_best(docs, full.df.filter("hit").select(F.col("digest").alias("group"), *ROW, "__id"), ["__id"])
