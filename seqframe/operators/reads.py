"""Read-level operators: maps over mates, trimming, filters and metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.trimming import TrimParameters, trim_read


def map_mates(df: DataFrame, f: Callable[[Column, int], Column], mates: tuple[str, ...] = ("r1", "r2")) -> DataFrame:
    """f(mate, index) over struct columns (seq, qual)."""
    return df.withColumns({m: f(F.col(m), i) for i, m in enumerate(mates)})


def with_read_id(df: DataFrame, order: list[str]) -> DataFrame:
    """Ordinals in a total order, by a range exchange and per-partition counts."""
    from pyspark.sql import Window

    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    from .storage import Stored

    stored = Stored(ranged, "ranged").df
    before = stored.groupBy("__part").agg(F.count("*").alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return stored.join(F.broadcast(before.drop("n")), "__part").withColumn("read_id", (at + F.col("__before")).cast("long")).drop("__part", "__before")


def trim_mates(df: DataFrame, p: TrimParameters | None = None, mates: tuple[str, ...] = ("r1", "r2")) -> DataFrame:
    """Each mate cut to its best island; empty if it has none."""
    return map_mates(df, lambda m, _: trim_read(m["seq"], m["qual"], p), mates)


def drop_empty(df: DataFrame, mates: tuple[str, ...] = ("r1", "r2")) -> DataFrame:
    """Rows with any letters left in any mate."""
    some = F.lit(False)
    for m in mates:
        some = some | (F.length(F.col(m)["seq"]) > 0)
    return df.filter(some)


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df, and an observation of aggregates that fills as df is first used."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), seen
