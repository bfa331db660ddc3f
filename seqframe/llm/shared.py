"""Filters of bounded size for the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..operators.skew import join_unique
from ..operators.storage import Stored, new_path, shared_dir

__all__ = ["ROW", "Stored", "bitmap", "components", "join_unique", "keep_best", "maybe_in", "new_path", "shared_dir", "with_maybe", "with_membership", "with_row_keys"]


def _spot(keys: tuple[str, ...], bits: int):
    h = F.xxhash64(*keys)
    return F.shiftrightunsigned(h, 64 - bits + 6), h.bitwiseAND(F.lit(63)).cast("int")


def bitmap(keys: DataFrame, *key: str, bits: int = 22) -> DataFrame:
    """A table of at most 2**(bits - 6) rows (word, flags): one bit of it is set for each key's hash.

    Its size depends on `bits` alone, so it may be broadcast whatever the number of keys.  More keys
    only mean more false positives; users of it make an exact join or count afterwards.
    """
    word, bit = _spot(key, bits)
    rows = keys.select(word.alias("word"), bit.alias("bit")).select("word", F.expr("shiftleft(1L, bit)").alias("flag"))
    return rows.groupBy("word").agg(F.bit_or("flag").alias("flags"))


def with_maybe(df: DataFrame, flags: DataFrame, *key: str, bits: int = 22, name: str = "maybe") -> DataFrame:
    """df and a boolean: whether the key's bit is set in the bitmap."""
    names = df.columns
    word, bit = _spot(key, bits)
    side = flags.select(F.col("word").alias("__word2"), F.col("flags").alias("__flags"))
    seen = F.coalesce(F.expr("getbit(__flags, __bit)").cast("int"), F.lit(0)) == 1
    return df.withColumns({"__word": word, "__bit": bit}).join(F.broadcast(side), F.col("__word") == F.col("__word2"), "left").select(*names, seen.alias(name))


def maybe_in(df: DataFrame, flags: DataFrame, *key: str, bits: int = 22, keep: bool = True) -> DataFrame:
    """Rows whose key's bit is set in the bitmap (keep=False: those whose isn't); df's columns."""
    out = with_maybe(df, flags, *key, bits=bits, name="__maybe")
    return out.filter("__maybe" if keep else "NOT __maybe").drop("__maybe")


def bits_for(n: int) -> int:
    """Bits of a bitmap of n keys: 16 a key, from 2**16 to 2**25 (4 MB of flags, whatever n is)."""
    return min(25, max(16, (16 * n - 1).bit_length() if n else 0))


def with_membership(df: DataFrame, ids: DataFrame, key: str | list[str] = "doc_id", name: str = "member") -> DataFrame:
    """df and a boolean: whether the row's key is in ids (columns `key`). Exact, and rows outside ids are hardly ever shuffled.

    A bitmap of the ids has false positives; those are found among keys alone and get a bitmap of their own.  Only rows that both
    bitmaps claim are joined: next to none while the bitmaps, which grow with the ids up to 4 MB, are sparse, and all rows in
    one plain join beyond that.  Null keys are no members.
    """
    keys = [key] if isinstance(key, str) else key
    some = F.lit(True)
    for k in keys:
        some = some & F.col(k).isNotNull()
    known = Stored(ids.select(*keys).filter(some).distinct(), "members")
    bits = bits_for(known.df.count())
    first = bitmap(known.df, *keys, bits=bits)
    wrong = Stored(maybe_in(df.select(*keys).filter(some), first, *keys, bits=bits).join(known.df, keys, "left_anti").distinct(), "wrong")
    few = bits_for(wrong.df.count())
    marked = with_maybe(with_maybe(df, first, *keys, bits=bits, name="__first"), bitmap(wrong.df, *keys, bits=few), *keys, bits=few, name="__second")
    marked = marked.withColumn("__first", F.col("__first") & some)
    sure = marked.filter("NOT (__first AND __second)").select(*df.columns, F.col("__first").alias(name))
    unsure = marked.filter("__first AND __second").join(known.df.withColumn("__known", F.lit(True)), keys, "left")
    return sure.unionByName(unsure.select(*df.columns, F.coalesce("__known", F.lit(False)).alias(name)))


#: Names of the two longs that stand for a whole row.
ROW = ["__row1", "__row2"]


def with_row_keys(docs: DataFrame, **named: str) -> DataFrame:
    """docs with its columns called c0, c1, .., so that no name clashes, and two 64-bit hashes of all of them, nulls included:
    rows are told apart by what they hold, not by an id.  named: columns of docs to add under another name."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    every = [F.struct(F.col(c).isNull(), F.col(c)) for c in plain.columns]
    extra = {name: F.col(f"c{docs.columns.index(c)}") for name, c in named.items()}
    return plain.withColumns({ROW[0]: F.xxhash64(F.lit(1), *every), ROW[1]: F.xxhash64(F.lit(2), *every), **extra})


def keep_best(docs: DataFrame, groups: DataFrame, best: list) -> DataFrame:
    """docs with one row of each group; its own columns.

    groups: a stored table of (group, __row1, __row2, the columns of `best`), one row per row of docs that is in a group of two
    rows or more; rows of docs that it doesn't hold stay.  Of a group the row with the largest `best` stays, and of rows that are
    equal in all columns one.  Winners are found by partial aggregates, so a group of any size is one row a task.
    """
    rank = F.struct(*best, *ROW)
    won = Stored(groups.groupBy("group").agg(F.max(rank).alias("w"), F.count("*").alias("n")), "winners")
    rows = join_unique(groups, won.df, "group", "n").withColumn("__won", F.struct(*best, *ROW).eqNullSafe(F.col("w")))
    judged = Stored(rows.groupBy(*ROW).agg(F.max("__won").alias("won"), F.count("*").alias("n")), "judged")
    keyed, own = with_row_keys(docs), [f"c{i}" for i in range(len(docs.columns))]
    twins = judged.df.filter("won AND n > 1")
    out = with_membership(keyed, judged.df.filter("NOT won OR n > 1"), ROW, "__gone").filter("NOT __gone").select(*own)
    if not twins.isEmpty():
        out = out.unionByName(with_membership(keyed, twins, ROW, "__twin").filter("__twin").dropDuplicates(ROW).select(*own))
    return out.toDF(*docs.columns)
