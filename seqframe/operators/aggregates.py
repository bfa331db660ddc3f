"""Aggregates over qualities, mutations, values and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUALITY_KINDS = ("min", "max", "sum", "average", "minimax")


def aggregate_quality(df: DataFrame, keys: list[str], qual: str, kind: str, cap: int = 50) -> DataFrame:
    """keys and `qual`: element-wise aggregate of equally long quality arrays.

    sum saturates at cap; average is rounded half up; minimax is the largest of the arrays' minima at every
    position.  Positions are aggregated apart (a partial aggregate by key and position), so no key's arrays are gathered.
    """
    if kind not in QUALITY_KINDS:
        raise ValueError(f"kind is one of {QUALITY_KINDS}")
    if kind == "minimax":
        level = df.groupBy(*keys).agg(F.max(F.array_min(qual)).alias("m"), F.max(F.size(qual)).alias("n"))
        return level.select(*keys, F.array_repeat("m", F.col("n")).alias(qual))
    each = df.select(*keys, F.posexplode(qual).alias("pos", "q"))
    n, total = F.count("*"), F.sum(F.col("q").cast("long"))
    value = {"min": F.min("q"), "max": F.max("q"), "sum": F.least(F.lit(cap).cast("long"), total), "average": F.floor((total + F.floor(n / 2)) / n)}[kind]
    points = each.groupBy(*keys, "pos").agg(value.cast("int").alias("q"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "q")))
    return points.groupBy(*keys).agg(F.transform(ordered, lambda x: x["q"]).alias(qual))


def histogram_bin(value: Column, boundaries: list[float]) -> Column:
    """Bin of a value: (b[i], b[i+1]], the first one closed on both sides; null outside."""
    out = F.when((value < boundaries[0]) | (value > boundaries[-1]) | value.isNull(), F.lit(None).cast("int"))
    for i, b in enumerate(boundaries[1:]):
        out = out.when(value <= b, i)
    return out


def histogram(df: DataFrame, value: str, boundaries: list[float]) -> DataFrame:
    """bin, lower, upper, n for every bin, empty ones too."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(boundaries, boundaries[1:], strict=False))], "bin int, lower double, upper double")
    counts = df.select(histogram_bin(F.col(value), boundaries).alias("bin")).filter("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
    return F.broadcast(bins).join(counts, "bin", "left").select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_summary(df: DataFrame, value: str, boundaries: list[float]) -> DataFrame:
    """One row: all values (out of range too), the mean of bin middles, and the share that bins cover."""
    bin_ = histogram_bin(F.col(value), boundaries)
    middles = F.lit(None).cast("double")
    for i, (a, b) in enumerate(zip(boundaries, boundaries[1:], strict=False)):
        middles = F.when(bin_ == i, (a + b) / 2).otherwise(middles)
    one = df.agg(F.count(value).alias("total"), F.count(bin_).alias("inside"), F.avg(middles).alias("mean"))
    return one.select("total", "mean", (F.col("inside") / F.col("total")).alias("covered"))


def enum_histogram(df: DataFrame, label: str, labels: list[str]) -> DataFrame:
    """label, n for each label in order, zeros too, and last for null."""
    spark = df.sparkSession
    all_ = spark.createDataFrame([*((i, x) for i, x in enumerate(labels)), (len(labels), None)], "ord int, label string")
    counts = df.groupBy(F.col(label).alias("l")).agg(F.count("*").alias("n"))
    return F.broadcast(all_).join(counts, F.col("label").eqNullSafe(F.col("l")), "left").select("ord", "label", F.coalesce("n", F.lit(0)).alias("n"))


def mutation_counts(df: DataFrame, mutations: str, weight: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """keys, mutation, weight: how often each mutation stands; neighbouring insertions at one position are one (`I5AC`).

    mutations: array<string> of encoded mutations in order of position.
    """
    keys = keys or []
    w = F.col(weight) if weight else F.lit(1)
    each = df.select(*keys, w.alias("weight"), F.explode(fuse_insertions(F.col(mutations))).alias("mutation"))
    return each.groupBy(*keys, "mutation").agg(F.sum("weight").alias("weight"))


def fuse_insertions(mutations: Column) -> Column:
    """Insertions that follow one another at one position as one."""
    head = lambda m: F.regexp_extract(m, r"^(I\d+)", 1)
    return F.aggregate(
        mutations,
        F.array().cast("array<string>"),
        lambda acc, m: F.when(
            (F.size(acc) > 0) & (head(m) != "") & (head(m) == head(F.try_element_at(acc, F.lit(-1)))),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.try_element_at(acc, F.lit(-1)), F.regexp_replace(m, r"^I\d+", "")))),
        ).otherwise(F.concat(acc, F.array(m))),
    )


def mutation_consensus(df: DataFrame, mutations: str, lower: str, upper: str, weight: str | None = None, min_share: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    """keys, mutation, position, weight, coverage: the mutations with more than min_share of the weight that covers their position."""
    from .intervals import coverage

    keys = keys or []
    w = F.col(weight) if weight else F.lit(1)
    df = df.withColumn("__w", w)
    counts = mutation_counts(df, mutations, "__w", keys).withColumn("position", F.regexp_extract("mutation", r"^[A-Z*_]+?(\d+)", 1).cast("int"))
    depth = coverage(df, lower, upper, keys, "__w").withColumnRenamed("depth", "coverage")
    out = counts.join(depth, [*keys, "position"]) if keys else counts.join(depth, "position")
    return out.filter(F.col("weight") > min_share * F.col("coverage")).select(*keys, "mutation", "position", "weight", "coverage")


def group_to_list(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """keys and `items`: each group's rows as a list of struct(order, values), in order."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *[v for v in values if v not in order]))).alias("items"))


def trimming_report(df: DataFrame, before: str, lower: str, upper: str) -> DataFrame:
    """One row: reads cut on each side and nucleotides gone; a read without a kept range (null) is gone whole, and counted apart."""
    n = F.col(before)
    kept = F.col(upper).isNotNull()
    left, right = F.when(kept, F.col(lower)), F.when(kept, n - F.col(upper))
    add = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return df.agg(
        F.count("*").alias("reads"),
        add((left > 0).cast("int")).alias("left_events"),
        add(left).alias("left_nucleotides"),
        add((right > 0).cast("int")).alias("right_events"),
        add(right).alias("right_nucleotides"),
        add((~kept).cast("int")).alias("dropped_reads"),
        add(F.when(~kept, n)).alias("dropped_nucleotides"),
    )
