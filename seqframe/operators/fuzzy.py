"""Fuzzy joins of sequences within limits on mismatches, deletions and insertions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mutations import Mutation, encode
from ..functions.sequence import mismatch_count

#: Default penalties of a mismatch, a deletion and an insertion.
PENALTIES = (0.1, 0.21, 0.32)
MISMATCH, DELETION, INSERTION = 0, 1, 2
HIT = "struct<penalty:double,mismatches:int,deletions:int,insertions:int>"


@dataclass(frozen=True)
class SearchLimits:
    """A deletion is a letter of the query that the key lacks, an insertion one of the key that the query lacks."""

    mismatches: int = 0
    deletions: int = 0
    insertions: int = 0
    total: int | None = None
    max_penalty: float | None = None
    penalties: tuple[float, float, float] = PENALTIES
    greedy: bool = True

    @property
    def edits(self) -> int:
        every = self.mismatches + self.deletions + self.insertions
        return every if self.total is None else min(every, self.total)

    @property
    def only_total(self) -> bool:
        """Whether any edits do, up to a number of them."""
        return not self.greedy and self.max_penalty is None and min(self.mismatches, self.deletions, self.insertions) >= self.edits

    @property
    def bound(self) -> float:
        return float("inf") if self.max_penalty is None else self.max_penalty


#: Up to 1 .. 4 edits: mismatches alone, indels alone, or both.
PRESETS = {f"{word}{kind}": limits for n, word in enumerate(("One", "Two", "Three", "Four"), 1) for kind, limits in (("Mismatch", SearchLimits(n, 0, 0, n)), ("Indel", SearchLimits(0, n, n, n)), ("MismatchOrIndel", SearchLimits(n, n, n, n)))}


@lru_cache(maxsize=64)
def edit_sequences(limits: SearchLimits) -> list[tuple[int, ...]]:
    """All sequences of edit kinds within the limits, by penalty, length, penalties in order, kinds in order."""
    caps, cost = (limits.mismatches, limits.deletions, limits.insertions), limits.penalties
    out: list[tuple[int, ...]] = []
    level: list[tuple[int, ...]] = [()]
    while level:
        out += level
        level = [s + (k,) for s in level for k in range(3) if len(s) < limits.edits and s.count(k) < caps[k] and sum(cost[x] for x in s) + cost[k] <= limits.bound + 1e-9]
    return sorted(out, key=lambda s: (round(sum(cost[k] for k in s), 9), len(s), [cost[k] for k in s], s))


Guide = Callable[[str, int, int, str | None], bool]


def best_match(query: str, key: str, limits: SearchLimits, guide: Guide | None = None, came: dict | None = None) -> tuple[float, int, int, int] | None:
    """(penalty, mismatches, deletions, insertions) of the cheapest way from query to key within the limits, or None.

    An insertion never follows a deletion directly (that is a mismatch); when greedy, neither a deletion nor a mismatch follows
    an insertion.  guide(query, position, kind, letter) may refuse an edit.  came, if given, is filled with the step that first led
    to each (place in query, place in key, state).
    """
    caps = (limits.mismatches, limits.deletions, limits.insertions)
    # states: (mismatches, deletions, insertions, last edit or -1 for a match) by cell, row by row
    n, m = len(query), len(key)
    row: dict[int, set] = {0: {(0, 0, 0, -1)}}

    def reach(cells: dict[int, set], to: tuple, step: tuple) -> None:
        cells.setdefault(to[1], set()).add(to[2])
        if came is not None:
            came.setdefault(to, step)

    for i in range(n + 1):
        following: dict[int, set] = {}
        for j in range(max(0, i - limits.deletions), min(m, i + limits.insertions) + 1):
            for state in list(row.get(j, ())):
                counts, last = state[:3], state[3]
                todo = [(counts, last, j)]
                while todo:  # insertions stay in this row
                    c, l, at = todo.pop()
                    if at < m and c[2] < caps[2] and sum(c) < limits.edits and l != DELETION and (guide is None or guide(query, i, INSERTION, key[at])):
                        nc = (c[0], c[1], c[2] + 1)
                        if (*nc, INSERTION) not in row.setdefault(at + 1, set()):
                            reach(row, (i, at + 1, (*nc, INSERTION)), (i, at, (*c, l)))
                            todo.append((nc, INSERTION, at + 1))
        if i == n:
            break
        for j, states in row.items():
            for a, d, x, last in sorted(states):
                here = (i, j, (a, d, x, last))
                if j < m and query[i] == key[j]:
                    reach(following, (i + 1, j + 1, (a, d, x, -1)), here)
                elif j < m and a < caps[0] and a + d + x < limits.edits and not (limits.greedy and last == INSERTION) and (guide is None or guide(query, i, MISMATCH, key[j])):
                    reach(following, (i + 1, j + 1, (a + 1, d, x, MISMATCH)), here)
                if d < caps[1] and a + d + x < limits.edits and not (limits.greedy and last == INSERTION) and (guide is None or guide(query, i, DELETION, None)):
                    reach(following, (i + 1, j, (a, d + 1, x, DELETION)), here)
        row = following
    cost = limits.penalties
    ends = [(round(a * cost[0] + d * cost[1] + x * cost[2], 9), a, d, x) for a, d, x, _ in row.get(m, ())]
    return min((e for e in ends if e[0] <= limits.bound + 1e-9), default=None)


def hit_mutations(query: str, key: str, limits: SearchLimits, guide: Guide | None = None) -> list[Mutation] | None:
    """The mutations of best_match's way, which turn query into key; None where nothing is within the limits."""
    came: dict = {}
    best = best_match(query, key, limits, guide, came)
    if best is None:
        return None
    at = min((to for to in came if to[:2] == (len(query), len(key)) and to[2][:3] == best[1:]), default=(0, 0, (0, 0, 0, -1)))
    out = []
    while at[:2] != (0, 0):
        (i, j, counts), at = at, came[at]
        if at[0] == i:
            out.append(Mutation("I", i, None, key[j - 1]))
        elif at[1] == j:
            out.append(Mutation("D", i - 1, query[i - 1], None))
        elif counts[0] > at[2][0]:
            out.append(Mutation("S", i - 1, query[i - 1], key[j - 1]))
    return out[::-1]


def _segments(length: Column, parts: int) -> Column:
    """array<struct(part, start, size)> that cut a sequence into parts of nearly equal size."""
    at = lambda i: F.floor(length * i / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(i.alias("part"), at(i).alias("start"), (at(i + 1) - at(i)).alias("size")))


def candidates(queries: DataFrame, keys: DataFrame, limits: SearchLimits) -> DataFrame:
    """Distinct (query, key) pairs that may match, from columns query and key of distinct sequences.

    With e edits at most, one of e + 1 parts of the key stands whole in the query, shifted by e at most: pairs meet by an
    equi-join on (key length, part, letters).  Keys of up to e letters have empty parts and meet all queries of fitting length.
    """
    e = limits.edits
    k = keys.select("key", F.length("key").alias("n"), F.explode(_segments(F.length("key"), e + 1)).alias("s"))
    k = k.select("key", "n", F.col("s.part").alias("part"), F.substring("key", F.col("s.start") + 1, F.col("s.size")).alias("letters"))
    size = F.length("query")
    low, high = F.greatest(F.lit(0), size - min(limits.deletions, e)), size + min(limits.insertions, e)
    q = queries.select("query", F.explode(F.sequence(low, high)).alias("n"))
    q = q.select("query", "n", F.explode(_segments(F.col("n"), e + 1)).alias("s"))
    drift = min(e, limits.deletions) if limits.deletions else 0, min(e, limits.insertions) if limits.insertions else 0
    q = q.select("query", "n", F.col("s.part").alias("part"), F.col("s.size").alias("size"), F.explode(F.sequence(F.col("s.start") - drift[1], F.col("s.start") + drift[0])).alias("start"))
    q = q.filter((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.length("query")))
    q = q.select("query", "n", "part", F.substring("query", F.col("start") + 1, F.col("size")).alias("letters")).distinct()
    return q.join(k, ["n", "part", "letters"]).select("query", "key").distinct()


def fuzzy_join(queries: DataFrame, keys: DataFrame, query: str, key: str, limits: SearchLimits, guide: Guide | None = None, explain: bool = True) -> DataFrame:
    """All pairs of rows within the limits: queries' columns prefixed q_, keys' k_, and penalty, mismatches, deletions, insertions.

    Equal sequences are searched once; edit distance, a built-in, sorts candidates out before the exact check.  Built-ins
    alone decide where they can: for mismatches without indels, and, with explain=False (pairs and nothing else), where only the
    total of edits is limited.
    """
    qs = queries.select(F.col(query).alias("query")).filter("query IS NOT NULL").distinct()
    ks = keys.select(F.col(key).alias("key")).filter("key IS NOT NULL").distinct()
    near = candidates(qs, ks, limits)
    e = limits.edits
    if limits.deletions or limits.insertions:
        near = near.filter(F.levenshtein("query", "key", e) >= 0)
    else:
        near = near.filter(mismatch_count(F.col("query"), F.col("key")) <= e)
    if guide is None and not (limits.deletions or limits.insertions):
        errors = mismatch_count(F.col("query"), F.col("key"))
        cost = F.round(errors * limits.penalties[MISMATCH], 9)
        found = near.select("query", "key", cost.alias("penalty"), errors.alias("mismatches"), F.lit(0).alias("deletions"), F.lit(0).alias("insertions"))
        found = found.filter(F.col("penalty") <= limits.bound + 1e-9)
    elif not explain and guide is None and limits.only_total:
        found = near.select("query", "key")
    else:
        found = near.withColumn("hit", hit_column(F.col("query"), F.col("key"), limits, guide)).filter("hit.penalty IS NOT NULL")
        found = found.select("query", "key", "hit.*") if explain else found.select("query", "key")
    a = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    b = keys.select(*[F.col(c).alias(f"k_{c}") for c in keys.columns])
    out = a.join(found, F.col(f"q_{query}") == F.col("query")).join(b, F.col(f"k_{key}") == F.col("key"))
    return out.drop("query", "key")


def hit_column(query: Column, key: Column, limits: SearchLimits, guide: Guide | None = None) -> Column:
    @F.pandas_udf(HIT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for qs, ks in batches:
            rows = [best_match(a, b, limits, guide) or (None,) * 4 for a, b in zip(qs, ks, strict=True)]
            out = pd.DataFrame(rows, columns=["penalty", "mismatches", "deletions", "insertions"])
            yield out.astype({"penalty": "Float64", "mismatches": "Int32", "deletions": "Int32", "insertions": "Int32"})

    return run(query, key)


def hit_mutations_column(query: Column, key: Column, limits: SearchLimits, guide: Guide | None = None) -> Column:
    """hit_mutations as text, for pairs that a fuzzy join found; null for nulls and pairs beyond the limits."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for qs, ks in batches:
            found = [None if a is None or b is None else hit_mutations(a, b, limits, guide) for a, b in zip(qs, ks, strict=True)]
            yield pd.Series([None if x is None else encode(x) for x in found], dtype=object)

    return run(query, key)


def neighbours_in_order(hits: DataFrame, by: list[str]) -> DataFrame:
    """Hits of each query by penalty, then by key order."""
    return hits.orderBy(*by, "penalty")
