"""Connected components of edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import join_unique
from .storage import Stored

#: Edges that a task holds at a time.
CHUNK = 1 << 19


def star_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join each node to the smallest node that it reaches over u-v; fewer than nodes, and none to itself."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    least = np.arange(len(nodes))
    x, y = ends[: len(u)], ends[len(u) :]
    while True:
        x, y = least[x], least[y]
        open_ = x != y
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least[least] != least).any():
            least = least[least]
    joined = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[joined], nodes[least[joined]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done():
        u, v = star_forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        return pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += batch.num_rows
        if n >= CHUNK:
            yield done()
            held, n = [], 0
    if n:
        yield done()


def _joined(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: what a task reads is joined within the task, CHUNK edges at a time."""
    return edges.mapInArrow(_forests, "u long, v long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: (node, root), root the smallest node reachable; nodes without edges are absent.

    Alternating large-star and small-star steps (Kiveris et al., 2014).  Each step takes each node's least neighbour by a partial
    aggregate and hands it to the node's edges; edges of hubs get it by a broadcast of bounded size, so that no hub's edges are
    gathered in one task.  Neither step makes edges more, and before each is written, every task replaces its own edges by stars
    of the same components: that drops repeated edges without a shuffle and saves most steps.  The aggregate tells whether all
    edges are stars: no node with a smaller neighbour has another neighbour; then each node's root is itself or that neighbour.
    """
    given = Stored(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u > v"), "edges")
    now = Stored(_joined(given.df), "joined")
    given.drop()
    while True:
        both = now.df.union(now.df.select("v", "u"))
        below = F.count_if(F.col("v") < F.col("u"))
        low = Stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"), below.alias("below")), "low")
        seen = low.df.agg(F.max((F.col("below") > 0) & (F.col("n") > 1)).alias("open"), F.max("n").alias("most")).first()
        if not seen["open"]:
            now.drop()
            return low.df.select(F.col("u").alias("node"), F.col("m").alias("root"))
        up = join_unique(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")), low.df.select("u", "m", "n"), "u", "n", most=seen["most"])
        one = Stored(_joined(up.select(F.col("v").alias("u"), F.col("m").alias("v"))), "large")
        least = Stored(one.df.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        down = join_unique(one.df, least.df, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        two = Stored(_joined(down.union(least.df.select("u", "m"))), "small")
        for t in (now, low, one, least):
            t.drop()
        now = two
