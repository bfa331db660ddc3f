"""Joins whose hot keys don't land in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the heavy side that are broadcast at most, and the fewest rows of a key that make it heavy.
HEAVY_KEYS, HEAVY_ROWS = 1024, 512


def join_unique(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner", heavy_keys: int = HEAVY_KEYS, heavy_rows: int = HEAVY_ROWS, most: int | None = None) -> DataFrame:
    """left joined with right, which has one row a key and, in `weight`, about the number of left rows of it; how: inner or left.

    The heaviest keys, at most heavy_keys whatever the tables' sizes, are broadcast, so their rows stay where they are; rows of
    all other keys are joined as Spark sees fit.  Without heavy keys it is one plain join: the largest weight, which is read from
    right unless `most` gives it, tells.  Both sides are read twice: pass stored tables.  Null keys match nothing.
    """
    if most is None:
        most = right.agg(F.max(weight)).first()[0] or 0
    if most <= heavy_rows:
        return left.join(right, key, how).select(*left.columns, *[c for c in right.columns if c != key])
    top = right.filter(F.col(weight) > heavy_rows).orderBy(F.col(weight).desc(), key).limit(heavy_keys)
    names = [c for c in right.columns if c != key]
    wide = top.select(F.col(key).alias("__key"), F.struct(*names).alias("__heavy"))
    marked = left.join(F.broadcast(wide), F.col(key) == F.col("__key"), "left").drop("__key")
    heavy = marked.filter("__heavy IS NOT NULL").select(*left.columns, *[F.col(f"__heavy.{c}").alias(c) for c in names])
    light = marked.filter("__heavy IS NULL").select(*left.columns).join(right, key, how).select(*left.columns, *names)
    return heavy.unionByName(light)
