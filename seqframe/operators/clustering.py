"""Greedy hierarchical clustering of weighted sequences.

Objects are visited by weight, heaviest first (ties: longer, then later in sequence order).  One that no cluster holds heads a
new cluster, which absorbs lighter neighbours layer by layer, up to a depth.

An object can only be absorbed by heavier neighbours, so its fate is settled as soon as theirs is: of those above the greatest depth,
it goes to the one whose cluster's head comes first, then to the shallowest, then to the first in its layer, and it heads a cluster if
there is none.  Objects are therefore settled in rounds of joins over the stored edge table, each round those whose heavier neighbours
are all settled; no cluster and no component of the neighbour graph is gathered in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import NT_CODES
from .fuzzy import SearchLimits, fuzzy_join
from .skew import join_unique
from .storage import Stored

PLACE = "struct<w:double,n:int,s:string,id:bigint>"
PATH = f"array<{PLACE}>"
OFFER = f"struct<root:{PLACE},depth:int,path:{PATH},parent_id:bigint>"
#: Letters that sort the other way round than the alphabet's codes.
_BACKWARDS = "".join(chr(ord("z") - i) for i in range(len(NT_CODES)))


@dataclass(frozen=True)
class ClusteringStrategy:
    """limits: the widest search that any step uses.  accept(head, candidate, hit) may refuse; rows have id, seq and weight."""

    limits: SearchLimits = SearchLimits(1, 1, 1, 1)
    max_depth: int = 1
    ratio: float = 0.0
    accept: Callable[[dict, dict, dict], bool] | None = None


def _place(prefix: str = "") -> Column:
    """What objects are ordered by; structs of it compare as the visits go."""
    codes = F.translate(F.col(f"{prefix}seq"), NT_CODES, _BACKWARDS)
    return F.struct((-F.col(f"{prefix}weight")).alias("w"), (-F.length(f"{prefix}seq")).alias("n"), codes.alias("s"), F.col(f"{prefix}id").alias("id"))


def _accepted(pairs: DataFrame, strategy: ClusteringStrategy) -> DataFrame:
    """Pairs (q_ the heavier) that the strategy takes."""
    pairs = pairs.filter("q_id <> k_id AND k_weight < q_weight AND k_weight >= 0")
    if strategy.ratio:
        pairs = pairs.filter(F.col("k_weight") <= F.col("q_weight") * strategy.ratio)
    if strategy.accept is None:
        return pairs
    accept = strategy.accept

    @F.pandas_udf("boolean")
    def allowed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = batch.to_dict("records")
            side = lambda r, p: {c: r[f"{p}_{c}"] for c in ("id", "seq", "weight")}
            yield pd.Series([bool(accept(side(r, "q"), side(r, "k"), r)) for r in rows], dtype=bool)

    return pairs.filter(allowed(F.struct(*pairs.columns)))


def cluster(df: DataFrame, strategy: ClusteringStrategy, key: str = "id", seq: str = "seq", weight: str = "weight") -> DataFrame:
    """id, root_id, parent_id (null for heads), depth: each object once.

    Rows are objects; ids are to be unique, and rows with a null sequence or weight head clusters of their own.  The number of
    rounds is that of the longest chain of ever lighter neighbours.
    """
    base = df.select(F.col(key).cast("long").alias("id"), F.col(seq).alias("seq"), F.col(weight).cast("double").alias("weight"))
    pairs = _accepted(fuzzy_join(base, base, "seq", "seq", strategy.limits), strategy)
    edges = Stored(pairs.select(F.col("q_id").alias("parent"), F.col("k_id").alias("child"), _place("k_").alias("place"), _place("q_").alias("above")), "edges")
    degree = edges.df.groupBy("parent").agg(F.count("*").alias("out"))
    # waiting: the unsettled, with the number of heavier neighbours not settled yet and the best offer so far
    waiting = Stored(edges.df.groupBy("child").agg(F.count("*").alias("left"), F.max("place").alias("place")).select("child", "left", "place", F.lit(None).cast(OFFER).alias("best")), "waiting")
    free = edges.df.select(F.col("parent").alias("id"), F.col("above").alias("place")).dropDuplicates(["id"]).join(waiting.df.select(F.col("child").alias("id")), "id", "left_anti")
    none = F.lit(None).cast("long")
    settled = Stored(free.select("id", F.col("place").alias("root"), F.lit(0).alias("depth"), F.array().cast(PATH).alias("path"), none.alias("parent_id")), "settled")
    every = [settled]
    while not settled.df.isEmpty():
        told = settled.df.join(degree, F.col("id") == F.col("parent")).select(F.col("parent"), "out", "root", "depth", "path")
        offers = join_unique(edges.df.select("parent", "child", "place"), Stored(told, "told").df, "parent", "out")
        offer = F.when(F.col("depth") < strategy.max_depth, F.struct("root", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("place")).alias("path"), F.col("parent").alias("parent_id")))
        # places in a layer go by the path of places down to the parent, so the object's own place comes last and decides nothing
        met = Stored(offers.groupBy("child").agg(F.count("*").alias("n"), F.min(offer).alias("offer")), "offers")
        both = waiting.df.join(met.df, "child", "left")
        now = both.select("child", (F.col("left") - F.coalesce("n", F.lit(0))).alias("left"), "place", F.when(F.col("best").isNull() | (F.col("offer") < F.col("best")), F.coalesce("offer", "best")).otherwise(F.col("best")).alias("best"))
        before, waiting = waiting, Stored(now, "waiting")
        ready, best = waiting.df.filter("left = 0"), F.col("best")
        heads = F.when(best.isNull(), F.struct(F.col("place").alias("root"), F.lit(0).alias("depth"), F.array().cast(PATH).alias("path"), none.alias("parent_id")).cast(OFFER)).otherwise(best)
        settled = Stored(ready.select(F.col("child").alias("id"), heads.alias("b")).select("id", "b.root", "b.depth", "b.path", "b.parent_id"), "settled")
        every.append(settled)
        before.drop()
        met.drop()
        waiting = _Rest(waiting)
    out = every[0].df
    for s in every[1:]:
        out = out.unionByName(s.df)
    found = out.select("id", F.col("root.id").alias("root_id"), "parent_id", "depth")
    alone = base.join(found.select("id"), "id", "left_anti").select("id", F.col("id").alias("root_id"), none.alias("parent_id"), F.lit(0).alias("depth"))
    return found.unionByName(alone)


class _Rest:
    """A stored table without its settled rows."""

    def __init__(self, stored: Stored):
        self.stored, self.df = stored, stored.df.filter("left > 0")

    def drop(self) -> None:
        self.stored.drop()


def cluster_totals(clusters: DataFrame) -> DataFrame:
    """root_id and the number of objects in its tree."""
    return clusters.groupBy("root_id").agg(F.count("*").alias("total"))


