"""Ordered dataflow: sorts, merges, groups, co-groups and shuffles, as plans."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from functools import reduce
from itertools import combinations as _combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort(df: DataFrame, *keys: Column | str) -> DataFrame:
    """A total order over all partitions (range exchange, spilling sort)."""
    return df.orderBy(*keys)


def unsigned(h: Column) -> Column:
    """A key that orders longs as unsigned."""
    return h.bitwiseXOR(F.lit(-(1 << 63)))


def hash_collate(df: DataFrame, key: list[str], partitions: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Equal keys together: partitions by key, each sorted by unsigned hash, then key. No total order, so one exchange and no sampling."""
    h = unsigned(F.xxhash64(*key))
    dealt = df.repartition(partitions, *key) if partitions else df.repartition(*key)
    return dealt.sortWithinPartitions(h, *key, *(order or []))


def hash_sort(df: DataFrame, key: list[str], hash_column: Column | None = None) -> DataFrame:
    """A total order by unsigned hash, then key."""
    return df.orderBy(unsigned(F.xxhash64(*key)) if hash_column is None else unsigned(hash_column), *key)


def hash_bucket(h: Column, skip_bits: int, bits: int) -> Column:
    """Bucket of a hash: `bits` bits after the first skip_bits."""
    return F.shiftrightunsigned(F.shiftleft(h, skip_bits) if skip_bits else h, 64 - bits)


def merge_sorted(inputs: list[DataFrame], keys: list[str]) -> DataFrame:
    """All rows in order of keys; ties by input. src_idx: the row's input."""
    tagged = [d.withColumn("src_idx", F.lit(i)) for i, d in enumerate(inputs)]
    return reduce(DataFrame.unionByName, tagged).orderBy(*keys, "src_idx")


def cogroup_join(inputs: list[DataFrame], keys: list[str], order: list[str] | None = None) -> DataFrame:
    """keys and g0 .. gn-1: each input's rows of the key as a list, empty if it has none (n-way full outer).

    One exchange whatever the number of inputs: rows are united as structs with their input's number.
    """
    parts = []
    for i, d in enumerate(inputs):
        rest = [c for c in d.columns if c not in keys]
        fields = [F.lit(None).cast(inputs[j].select(F.struct(*_rest(inputs[j], keys, order))).schema[0].dataType).alias(f"v{j}") for j in range(len(inputs))]
        fields[i] = F.struct(*_rest(d, keys, order)).alias(f"v{i}") if rest else F.lit(True).alias(f"v{i}")
        parts.append(d.select(*keys, *fields))
    united = reduce(DataFrame.unionByName, parts)
    return united.groupBy(*keys).agg(*[F.sort_array(F.collect_list(f"v{j}")).alias(f"g{j}") for j in range(len(inputs))])


def _rest(d: DataFrame, keys: list[str], order: list[str] | None) -> list[str]:
    rest = [c for c in d.columns if c not in keys]
    first = [c for c in (order or []) if c in rest]
    return [*first, *[c for c in rest if c not in first]]


def cogroup_counts(inputs: list[DataFrame], keys: list[str]) -> DataFrame:
    """keys and n0 .. nn-1: rows of the key in each input; counts are added before the exchange."""
    tagged = [d.select(*keys, F.lit(i).alias("src")) for i, d in enumerate(inputs)]
    return reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(*[F.count_if(F.col("src") == i).alias(f"n{i}") for i in range(len(inputs))])


def semi_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_anti")


def positional_zip(inputs: list[DataFrame], ordinal: str) -> DataFrame:
    """Rows with the same ordinal, columns prefixed r1_, r2_, ..; an error where an input is shorter than another."""
    named = [d.select(ordinal, *[F.col(c).alias(f"r{i}_{c}") for c in d.columns if c != ordinal], F.lit(1).alias(f"__has{i}")) for i, d in enumerate(inputs, 1)]
    out = reduce(lambda a, b: a.join(b, ordinal, "full"), named)
    whole = reduce(lambda a, b: a & b, [F.col(f"__has{i}").isNotNull() for i in range(1, len(inputs) + 1)])
    checked = F.when(whole, True).otherwise(F.raise_error(F.lit("inputs have different lengths")).cast("boolean"))
    return out.filter(checked).drop(*[f"__has{i}" for i in range(1, len(inputs) + 1)])


def group_by_prefix(df: DataFrame, prefix: list[str], rest: list[str], values: list[str]) -> DataFrame:
    """prefix, rest and items: groups by all keys, given an input that serves several groupings by the prefix.

    Partitioned by the prefix alone: groupings by (prefix, rest) and by prefix share the one exchange.
    """
    dealt = df.repartition(*prefix)
    return dealt.groupBy(*prefix, *rest).agg(F.sort_array(F.collect_list(F.struct(*values))).alias("items"))


def randomize(df: DataFrame, seed: int, *key: str) -> DataFrame:
    """A random order that depends on the seed and the key alone, not on partitions; rows without a key column use all columns."""
    return df.orderBy(F.xxhash64(F.lit(seed), *(key or df.columns)), *(key or ()))


def combinations(n: int, k: int) -> list[tuple[int, ...]]:
    """k-subsets of 0 .. n-1, in order."""
    return list(_combinations(range(n), k))


def combination_rows(df: DataFrame, item: str, keys: list[str], k: int = 2) -> DataFrame:
    """k-subsets of each group's items as columns c1 < c2 < .. : for small groups."""
    out = df.select(*keys, F.col(item).alias("c1"))
    for i in range(2, k + 1):
        step = df.select(*keys, F.col(item).alias(f"c{i}"))
        out = (out.join(step, keys) if keys else out.crossJoin(step)).filter(F.col(f"c{i - 1}") < F.col(f"c{i}"))
    return out


class Relation(Enum):
    """What sameness under one key says of sameness under another."""

    NONE = "none"
    NECESSARY = "necessary"  # equal under the other only if equal under this one
    SUFFICIENT = "sufficient"
    EQUAL = "equal"


@dataclass(frozen=True)
class Key:
    """A sort key; `depends_on` are the columns (or (column, lower, upper) stretches) that determine it."""

    name: str
    depends_on: frozenset = frozenset()

    def relation(self, other: Key) -> Relation:
        if self == other:
            return Relation.EQUAL
        mine, theirs = self.depends_on or {self.name}, other.depends_on or {other.name}
        if _covers(theirs, mine):
            return Relation.NECESSARY
        if _covers(mine, theirs):
            return Relation.SUFFICIENT
        return Relation.NONE


def _covers(big, small) -> bool:
    """Every part of `small` can be read off a part of `big`."""

    def within(a, b) -> bool:
        if a == b:
            return True
        if isinstance(a, tuple) and isinstance(b, tuple):
            return a[0] == b[0] and b[1] <= a[1] and a[2] <= b[2]
        return isinstance(a, tuple) and a[0] == b

    return all(any(within(s, b) for b in big) for s in small)


def merge_strategy(stream: list[Key], target: list[Key]) -> tuple[list[Key], list[Key]]:
    """(levels of the stream's order that serve the target grouping, keys to group by afterwards).

    Levels are used from the first on: one that equals a target key settles it, one that a target key determines is kept as
    a coarser level, and any other ends the use of the order.
    """
    used, left = [], list(target)
    for level in stream:
        if any(level.relation(t) is Relation.EQUAL for t in left):
            left = [t for t in left if level.relation(t) is not Relation.EQUAL]
        elif not any(level.relation(t) is Relation.NECESSARY for t in left):
            break
        used.append(level)
        if not left:
            break
    return used, left
