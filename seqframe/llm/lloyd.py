"""Plain Lloyd clustering in whole numbers.

Vectors become integers, floor(scale * component), and stay where they are: each round broadcasts the centroids (k rows of dims
numbers), a task takes its rows as pandas batches, computes the squared differences to one centroid after the other in NumPy,
takes the least (argmin: of equal ones the lowest number) and returns sums and counts by centroid alone; groupBy merges these.
Sums of whole numbers don't depend on the order of rows or tasks, so rounds give the same centroids on any cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Stored

#: Components up to this size are taken in 64-bit integers: differences are below 2**28 and up to 2**7 squares sum below 2**63.
SAFE = 1 << 27
#: Components beyond this don't fit Spark's longs once scaled.
LARGEST = float(1 << 62)


def whole_vectors(vectors: DataFrame, dims: int, scale: int, vector: str, key: str) -> DataFrame:
    """(vec_id, x: array of long) of the vectors with `dims` components, none null, non-finite or beyond 2**62 once scaled."""
    v = F.col("v")
    scaled = F.transform(v, lambda c: F.floor(c.cast("double") * scale))
    fine = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double") * scale) < LARGEST, F.lit(False)))  # NaN is above all numbers
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).alias("v"))
    return rows.filter(v.isNotNull() & (F.size(v) == dims) & fine).select("vec_id", scaled.alias("x"))


def first_centroids(x: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `seed:vec_id`, in that order; rows that repeat an id by their components, null ids never."""
    chosen = x.filter("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "x")
    return [list(r["x"]) for r in chosen.orderBy("h", "x").limit(k).collect()]


def distances(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """(rows, k) squared distances, exact: 64-bit integers, or Python's own where those might not do."""
    c = np.array(centroids, dtype=np.int64).reshape(len(centroids), -1)
    if x.shape[1] > 128 or max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) >= SAFE:
        x, c = x.astype(object), c.astype(object)
    out = np.empty((len(x), len(c)), dtype=x.dtype)
    for i in range(len(c)):
        d = x - c[i]
        out[:, i] = (d * d).sum(axis=1)
    return out


def _assigned(x: pd.Series, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, nearest centroid, squared distance) of a batch."""
    rows = np.stack(x.to_numpy()).astype(np.int64)
    all_ = distances(rows, centroids)
    near = all_.argmin(axis=1)
    return rows, near, all_[np.arange(len(rows)), near]


def _sums(batches: Iterator[pd.DataFrame], centroids: list[list[int]]) -> Iterator[pd.DataFrame]:
    """Of the rows of a partition: by centroid their number and, component by component, their sums, in two halves that can't overflow."""
    k, dims = len(centroids), len(centroids[0])
    high, low, count = np.zeros((k, dims), np.int64), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    for batch in batches:
        if len(batch):
            rows, near, _ = _assigned(batch["x"], centroids)
            for i in np.unique(near):
                mine = rows[near == i]
                count[i] += len(mine)
                high[i] += (mine >> 31).sum(axis=0)
                low[i] += (mine & 0x7FFFFFFF).sum(axis=0)
    some = np.flatnonzero(count)
    if len(some):
        at = np.repeat(some, dims)
        yield pd.DataFrame({"cluster": at, "dim": np.tile(np.arange(dims), len(some)), "high": high[some].ravel(), "low": low[some].ravel(), "n": count[at]})


def lloyd(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row per vector with `dims` components, none null or non-finite: vec_id, cluster, distance, centroid (array of long).

    Components become floor(scale * component), the component as double.  Centroids start as the k vectors with the smallest sha256
    of `seed:vec_id`; each round assigns every vector to the nearest one (ties: the smaller number) and moves each non-empty
    centroid to the componentwise floor(sum / count); after the rounds vectors are assigned once more.  Null vectors, those of
    another length or with a null, non-finite or (scaled) 2**62 or larger component are left out.  Rows that repeat a vec_id count
    each; rows without one are clustered but start no centroid.  With fewer than k vectors there are fewer centroids; an
    empty table, or one whose vectors all lack an id, gives no rows.  distance is null beyond 64 bits; other columns are ignored.
    """
    x = Stored(whole_vectors(vectors, dims, scale, vector, key), "vectors").df
    kind = f"vec_id {x.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, centroid array<long>"
    centroids = first_centroids(x, k, seed)
    if not centroids:
        return x.sparkSession.createDataFrame([], kind)
    for _ in range(rounds):
        parts = x.select("x").mapInPandas(lambda it, c=tuple(centroids): _sums(it, list(c)), "cluster int, dim int, high long, low long, n long")
        total = lambda name: F.sum(F.col(name).cast("decimal(38,0)")).alias(name)
        moved = {}
        for r in parts.groupBy("cluster", "dim").agg(total("high"), total("low"), F.sum("n").alias("n")).collect():  # k * dims rows
            moved.setdefault(r["cluster"], {})[r["dim"]] = ((int(r["high"]) << 31) + int(r["low"])) // r["n"]
        now = [[moved[i][d] for d in range(dims)] if i in moved else centroids[i] for i in range(len(centroids))]
        if now == centroids:  # further rounds would change nothing
            break
        centroids = now

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                _, near, far = _assigned(batch["x"], centroids)
                if far.dtype == object:
                    far = [int(f) if f < 1 << 63 else None for f in far]
                yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": near, "distance": pd.array(far, dtype="Int64"), "centroid": [centroids[i] for i in near]})

    return x.mapInPandas(assign, kind)


def digest_clusters(found: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of lloyd's rows; inertia sums beyond 64 bits, or of a null distance, are null."""
    rows = Stored(found, "assigned").df
    whole = F.count("distance") == F.count("*")
    sums = rows.groupBy("cluster").agg(F.when(whole, F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s"), F.first("centroid").alias("centroid"))  # k rows
    mark = F.sha2(F.array_join(F.transform("centroid", lambda c: c.cast("string")), ","), 256)
    fits = lambda c: F.expr(f"try_cast({c} AS long)")
    one = Window.partitionBy(F.lit(0))
    sums = sums.withColumn("every", F.when(F.count("s").over(one) == F.count("*").over(one), F.sum("s").over(one))).select("cluster", fits("s").alias("cluster_inertia"), fits("every").alias("inertia"), mark.alias("centroid_sha256"))
    return rows.drop("centroid").join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The digests in DuckDB SQL, a step a round, over the table embeddings."""
    steps = [
        f"x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c::DOUBLE))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1)::INTEGER AS c, x FROM x QUALIFY c < {k})",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"a{n} AS MATERIALIZED (SELECT r, min(c) AS c, min(d) AS d FROM (SELECT x.r, c.c, list_sum(list_transform(list_zip(x.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d, min(d) OVER (PARTITION BY x.r) AS low "
            f"FROM x, c{n} AS c) WHERE d = low GROUP BY r)"
        )
        if n < rounds:
            steps.append(
                f"s{n} AS MATERIALIZED (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (SELECT c, i, sum(v)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT a.c, generate_subscripts(x.x, 1) AS i, unnest(x.x) AS v FROM x JOIN a{n} AS a USING (r)) GROUP BY c, i) GROUP BY c), "
                f"c{n + 1} AS MATERIALIZED (SELECT c.c, coalesce(s.x::BIGINT[], c.x) AS x FROM c{n} AS c LEFT JOIN s{n} AS s USING (c))"
            )
    last = f"SELECT x.vec_id, a.c AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM x JOIN a{rounds} AS a USING (r) JOIN c{rounds} AS c ON c.c = a.c"
    return "WITH " + ", ".join(steps) + " " + last
