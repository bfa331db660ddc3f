"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Texts become sets of word shingles and signatures of `coords` minima; texts with the same set
   are one class from here on.
2. Classes are posted under each (coordinate, value).  Values that one class alone has are dropped.
   A pair above the match threshold T shares T of K coordinates, so a class with fewer than T shared
   values has no partner, and any such pair shares one of the K - T + 1 rarest values of each side
   (the prefix); longer lists are skipped.
3. Lists of the prefixes tie classes into candidate clusters (connected components of star edges,
   one per posting, never all pairs of a list).
4. Each cluster is cut into blocks of bounded rows and bytes; a task takes two blocks, counts
   coordinate collisions by merging the short posting lists and probing the long ones, and confirms
   links on full shingle sets.  It returns a spanning forest of the links, not the links.
5. Components of the confirmed links are the result.

T is chosen so that a pair at the similarity threshold has less than `miss` chance to fall below it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .shared import ROW, Stored, bitmap, bits_for, components, join_unique, keep_best, maybe_in, with_membership, with_row_keys

_SEEDS = tc.mix64(np.arange(1, 4097, dtype=tc.U64) * tc.U64(0x9E3779B97F4A7C15))


def match_threshold(coords: int, similarity: float, miss: float = 1e-8) -> int:
    """The largest T with P(Binomial(coords, similarity) < T) <= miss; 1 at least."""
    total = 0.0
    for t in range(coords + 1):
        total += math.comb(coords, t) * similarity**t * (1 - similarity) ** (coords - t)
        if total > miss:
            return max(1, t)
    return coords


def signatures(values: np.ndarray, first: np.ndarray, coords: int) -> np.ndarray:
    """(sets, coords) int32 minima of the hashed values; set i is values[first[i]:first[i+1]], none empty."""
    out = np.empty((len(first) - 1, coords), dtype=np.int32)
    at, n = 0, len(first) - 1
    while at < n:  # pieces that fit the cache
        to = max(at + 1, int(np.searchsorted(first, first[at] + 32768, side="right")) - 1)
        piece, where = values[first[at] : first[to]], (first[at:to] - first[at]).astype(np.int64)
        for k in range(coords):
            x = piece ^ _SEEDS[2 * k]
            x *= _SEEDS[2 * k + 1] | tc.U64(1)
            x ^= x >> tc.U64(32)
            x *= tc.U64(0xD6E8FEB86659FD93)
            low = np.minimum.reduceat(x, where)
            out[at:to, k] = (low >> tc.U64(32)).astype(np.uint32).view(np.int32)
        at = to
    return out


def _sketch(batches, k: int, coords: int):
    for block in tc.blocks(batches, "text"):
        sets = list(tc.shingle_sets(tc.space_words(block.column("text"), lower=True), k))
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        some = np.flatnonzero(sizes)
        sigs = np.zeros((len(sets), coords), dtype=np.int32)
        if len(some):
            first = np.concatenate([[0], np.cumsum(sizes[some])])
            sigs[some] = signatures(np.concatenate([sets[i] for i in some]), first, coords)
        whole = np.array([tc.sequence_hash(s) for s in sets], dtype=tc.U64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * coords), pa.array(sigs.ravel()))
        yield pa.record_batch([block.column("doc_id"), pa.array(sizes), pa.array(tc.signed(whole)), lists], names=["doc_id", "n", "whole", "sig"])


def _full_sets(batches, k: int):
    for block in tc.blocks(batches, "text"):
        sets = list(tc.shingle_sets(tc.space_words(block.column("text"), lower=True), k))
        whole = np.array([tc.sequence_hash(s) for s in sets], dtype=tc.U64)
        yield pa.record_batch([block.column("doc_id"), pa.array(tc.signed(whole)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "whole", "items"])


def collisions(sigs: np.ndarray, left: np.ndarray, threshold: int):
    """For each row of sigs in turn: the earlier rows (of the other side, if `left` marks two) with `threshold` equal coordinates at least.

    Of a row's posting lists the longest threshold - 1 are skipped; rows found in the others are the only ones that can
    reach the threshold, and the skipped lists are probed for them alone.
    """
    m, coords = sigs.shape
    order = np.argsort(sigs, axis=0, kind="stable")
    ranked = np.take_along_axis(sigs, order, axis=0)
    lo = np.stack([np.searchsorted(ranked[:, c], sigs[:, c], side="left") for c in range(coords)], axis=1)
    hi = np.stack([np.searchsorted(ranked[:, c], sigs[:, c], side="right") for c in range(coords)], axis=1)
    lists = np.argsort(hi - lo, axis=1, kind="stable")
    two = bool(left.any()) and not bool(left.all())
    for u in range(m):
        seen = np.zeros(m, dtype=bool)
        for c in lists[u, : coords - threshold + 1]:
            if hi[u, c] - lo[u, c] > 1:
                seen[order[lo[u, c] : hi[u, c], c]] = True
        if two:
            if left[u]:
                continue
            seen &= left
        else:
            seen[u:] = False
        found = np.flatnonzero(seen)
        if len(found):
            found = found[(sigs[found] == sigs[u]).sum(axis=1) >= threshold]
        yield u, found


def spanning_links(nodes: list, sets: list[np.ndarray], sigs: np.ndarray, left: np.ndarray, percent: int, threshold: int):
    """Edges of a spanning forest of the confirmed links: 100 * |intersection| >= percent * |union|."""
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    for u, found in collisions(sigs, left, threshold):
        found = found[100 * np.minimum(sizes[found], sizes[u]) >= percent * np.maximum(sizes[found], sizes[u])]
        for v in found.tolist():
            a, b = root(u), root(v)
            if a == b:
                continue
            mine, other = (sets[u], sets[v]) if sizes[u] <= sizes[v] else (sets[v], sets[u])
            at = np.searchsorted(other, mine)
            both = int((other[np.minimum(at, len(other) - 1)] == mine).sum())
            if 100 * both >= percent * (int(sizes[u] + sizes[v]) - both):
                parent[a] = b
                yield nodes[u], nodes[v]


def _confirm(batches, percent: int, threshold: int):
    """Rows come sorted by unit, so units are whole one after the other; sets and signatures stay views of the Arrow buffers."""
    unit, nodes, sets, sigs, left = None, [], [], [], []

    def done():
        if len(nodes) > 1:
            yield from spanning_links(nodes, sets, np.concatenate(sigs), np.array(left, dtype=bool), percent, threshold)

    def batch_of(edges):
        return pa.record_batch([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

    for batch in batches:
        edges, n = [], batch.num_rows
        if not n:
            continue
        keys = batch.column("unit").to_numpy(zero_copy_only=False)
        ids, first = batch.column("node").to_pylist(), batch.column("is_left").to_pylist()
        lists = batch.column("sig")
        coords = lists.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        items = batch.column("items").cast(pa.large_binary())
        _, offsets, data = items.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64, count=items.offset + n + 1)[items.offset :]
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), n]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if keys[a] != unit:
                edges += done()
                unit, nodes, sets, sigs, left = keys[a], [], [], [], []
            nodes += ids[a:b]
            left += first[a:b]
            sigs.append(coords[a:b])
            sets += [np.frombuffer(data, dtype=tc.U64, count=(y - x) // 8, offset=x) for x, y in zip(ends[a:b].tolist(), ends[a + 1 : b + 1].tolist(), strict=True)]
        yield batch_of(edges)
    yield batch_of(list(done()))
    tc.give_back()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, coords: int = 96, text: str = "text", key: str = "doc_id", block_rows: int = 512, block_items: int = 1 << 20) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Words are runs of other bytes than ASCII white space, A-Z lower-cased; a text of fewer than `shingle`
    words is one shingle.  Null, empty and blank texts have no shingles, link with nothing and are kept.
    Equal sets are always linked.  component_id is the smallest doc_id reachable over links; kept marks the
    row that bears it.  doc_id must be an integer; rows that repeat a doc_id are in its component, and rows without
    a doc_id get a null component and are kept.  An empty table gives no rows; other columns are ignored.
    """
    threshold = match_threshold(coords, percent / 100)
    cls = ["rep", "whole"]  # a class: a doc_id may stand on several texts
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = Stored(base.mapInArrow(lambda it: _sketch(it, shingle, coords), "doc_id long, n long, whole long, sig array<int>"), "sketch")
    named = sketch.df.filter("n > 0 AND doc_id IS NOT NULL")
    classes = Stored(named.groupBy("whole", "n", "sig").agg(F.min("doc_id").alias("rep")), "classes")
    postings = classes.df.select(*cls, F.posexplode("sig").alias("coord", "value"))
    lists = Stored(postings.groupBy("coord", "value").agg(F.count("*").alias("len")).filter("len > 1"), "lists")
    bits = bits_for(lists.df.count())
    shared = maybe_in(postings, bitmap(lists.df, "coord", "value", bits=bits), "coord", "value", bits=bits).join(lists.df, ["coord", "value"])
    mine = Window.partitionBy(*cls)
    ranked = shared.withColumns({"have": F.count("*").over(mine), "at": F.row_number().over(mine.orderBy("len", "coord"))})
    prefix = Stored(ranked.filter(F.col("at") <= F.col("have") - threshold + 1).select(*cls, "coord", "value"), "prefix")
    heads = prefix.df.groupBy("coord", "value").agg(F.min("rep").alias("head"), F.count("*").alias("len")).filter("len > 1")
    stars = prefix.df.join(heads, ["coord", "value"]).select(F.col("rep").alias("a"), F.col("head").alias("b")).filter("a <> b")
    cluster = Stored(components(stars).join(classes.df.select(F.col("rep").alias("node"), "whole", "n", "sig"), "node"), "clusters")
    prefix.drop()
    lists.drop()
    sized = cluster.df.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("n") / block_items)).cast("int").alias("cut"))
    placed = cluster.df.join(sized, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("cut")).cast("int"))
    bits = bits_for(cluster.df.count())
    sets = maybe_in(base.withColumnRenamed("doc_id", "node"), bitmap(cluster.df, "node", bits=bits), "node", bits=bits).withColumnRenamed("node", "doc_id")
    sets = sets.mapInArrow(lambda it: _full_sets(it, shingle), "node long, whole long, items binary").dropDuplicates(["node", "whole"])
    other = F.explode(F.sequence(F.lit(0), F.col("cut") - 1))
    units = placed.join(sets, ["node", "whole"]).select("root", "node", "sig", "items", "block", other.alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    units = units.select(F.xxhash64("root", low, high).alias("unit"), "node", (F.col("block") < F.col("other")).alias("is_left"), "items", "sig")
    # a doc_id on several texts ties their classes
    texts = named.groupBy("doc_id").agg(F.min("whole").alias("low"), F.max("whole").alias("high")).filter("low <> high").select("doc_id")
    ties = named.join(texts, "doc_id").select("doc_id", "whole", "n").join(classes.df.select("whole", "n", "rep"), ["whole", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = units.repartition("unit").sortWithinPartitions("unit").mapInArrow(lambda it: _confirm(it, percent, threshold), "a long, b long")
    found = components(links.unionByName(ties.filter("a <> b")))
    cluster.drop()
    kin = classes.df.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("whole", "n", "sig", F.coalesce("root", "rep").alias("root"))
    linked = sketch.df.join(kin.select("whole", "n", "root"), ["whole", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return linked.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one document of each component (five-word shingles, similarity 0.8 or more): the one with the smallest doc_id; its own columns.

    Rows are told apart by a hash of all their columns, not by doc_id: rows without a doc_id take part and go before any other stays.
    Rows that share a doc_id are told apart by the rest, and of rows equal in all columns one stays if they have shingles.  Null, empty
    and blank texts are near to nothing and all stay.  An empty table gives no rows; columns of any name pass through.
    """
    rows = with_row_keys(docs, __id=key, __text=text)
    ids = rows.select(*ROW, "__id")
    found = near_duplicates(rows.select(F.col(ROW[0]).alias("doc_id"), F.col("__text").alias("text")), shingle, percent)
    found = Stored(found.filter("n_shingles > 0").groupBy("doc_id").agg(F.min("component_id").alias("group"), F.count("*").alias("n")), "near")
    # components of one node that one row bears have nothing to drop
    sizes = Stored(found.df.groupBy("group").agg(F.sum("n").alias("n")).filter("n > 1"), "sizes")
    members = Stored(join_unique(found.df.select("doc_id", "group"), sizes.df, "group", "n").select(F.col("doc_id").alias(ROW[0]), "group"), "kin")
    grouped = with_membership(ids, members.df, ROW[0], "__kin").filter("__kin").drop("__kin").join(members.df, ROW[0])
    groups = Stored(grouped.select("group", *ROW, F.col("__id").isNotNull().alias("__some"), (-F.col("__id")).alias("__low")), "groups")
    return keep_best(docs, groups.df, ["__some", "__low"])
