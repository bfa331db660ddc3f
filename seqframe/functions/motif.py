"""Motifs: one set of allowed letters a position; exact, mismatch and indel search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import ALPHABETS, matching_letters

HITS = "array<struct<position:int,errors:int>>"


@dataclass(frozen=True)
class Motif:
    """Allowed letters of each position."""

    sets: tuple[frozenset, ...]

    @staticmethod
    def of(sequence: str, alphabet: str = "nucleotide") -> Motif:
        """A position takes each letter that its letter matches, wildcards too."""
        return Motif(tuple(frozenset(matching_letters(c, alphabet)) for c in sequence))

    def __or__(self, other: Motif) -> Motif:
        if len(self.sets) != len(other.sets):
            raise ValueError("motifs differ in length")
        return Motif(tuple(a | b for a, b in zip(self.sets, other.sets, strict=True)))

    def __len__(self) -> int:
        return len(self.sets)

    def allows(self, letter: str, position: int) -> bool:
        return letter in self.sets[position]

    def matches(self, sequence: str, start: int) -> bool:
        return start + len(self) <= len(sequence) and all(sequence[start + i] in x for i, x in enumerate(self.sets))

    def regex(self) -> str:
        return "".join("[" + "".join(sorted(x)) + "]" for x in self.sets)

    def table(self, alphabet: str = "nucleotide") -> np.ndarray:
        """(positions, letters) of booleans."""
        return np.array([[c in x for c in ALPHABETS[alphabet]] for x in self.sets], dtype=bool)


class MotifBuilder:
    """Builds a motif letter by letter; a position may take several."""

    def __init__(self, size: int):
        self.sets: list[set] = [set() for _ in range(size)]

    def allow(self, position: int, letters: str) -> MotifBuilder:
        self.sets[position].update(letters)
        return self

    def build(self) -> Motif:
        return Motif(tuple(map(frozenset, self.sets)))


def two_sequence_motif(a: str, from_a: int, b: str, from_b: int, length: int) -> Motif:
    return Motif.of(a[from_a : from_a + length]) | Motif.of(b[from_b : from_b + length])


def _motif(m: Motif | str) -> Motif:
    return Motif.of(m) if isinstance(m, str) else m


def exact_positions(seq: Column, motif: Motif | str) -> Column:
    """All starts of exact matches."""
    m = _motif(motif)
    n = len(m)
    starts = F.sequence(F.lit(0), F.length(seq) - n)
    found = F.filter(starts, lambda i: F.substring(seq, i + 1, F.lit(n)).rlike("^" + m.regex() + "$"))
    return F.when(F.length(seq) >= n, found).when(seq.isNotNull(), F.array().cast("array<int>"))


def first_exact(seq: Column, motif: Motif | str) -> Column:
    return F.regexp_instr(seq, F.lit(_motif(motif).regex())) - 1


def matches_at(seq: Column, motif: Motif | str, start: Column) -> Column:
    m = _motif(motif)
    return F.substring(seq, start + 1, F.lit(len(m))).rlike("^" + m.regex() + "$")


def substitution_hits(seq: Column, motif: Motif | str, k: int) -> Column:
    """(position, errors) of all starts with k substitutions at most, ascending; built-in expressions only."""
    m = _motif(motif)
    n = len(m)
    sets = F.array(*[F.lit("".join(sorted(x))) for x in m.sets])
    starts = F.sequence(F.lit(0), F.length(seq) - n)
    scored = F.transform(
        starts,
        lambda i: F.struct(
            i.alias("position"),
            F.size(F.filter(F.zip_with(F.split(F.substring(seq, i + 1, F.lit(n)), ""), sets, lambda c, x: F.position(c, x) == 0), lambda d: d)).alias("errors"),
        ),
    )
    return F.when(F.length(seq) >= n, F.filter(scored, lambda h: h["errors"] <= k)).when(seq.isNotNull(), F.array().cast(HITS))


def _indel_rows(sequence: str, sets: list[frozenset]) -> list[int]:
    """Least errors of the motif against a stretch that ends at each position (Sellers)."""
    n = len(sets)
    row = list(range(n + 1))
    out = []
    for c in sequence:
        previous, row = row, [0] * (n + 1)
        for j in range(1, n + 1):
            row[j] = min(previous[j - 1] + (c not in sets[j - 1]), previous[j] + 1, row[j - 1] + 1)
        out.append(row[n])
    return out


def indel_hits_last(sequence: str, motif: Motif, k: int) -> list[tuple[int, int]]:
    """(last position, errors) of stretches within k edits of the motif, ascending by end."""
    return [(i, e) for i, e in enumerate(_indel_rows(sequence, list(motif.sets))) if e <= k]


def indel_hits_first(sequence: str, motif: Motif, k: int) -> list[tuple[int, int]]:
    """(first position, errors), descending by start."""
    n = len(sequence)
    return [(n - 1 - i, e) for i, e in enumerate(_indel_rows(sequence[::-1], list(motif.sets)[::-1])) if e <= k]


def filtered(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Without hits that have a neighbour at distance 1, one back or one ahead, with exactly one error fewer."""
    out = []
    for i, (at, e) in enumerate(hits):
        near = [hits[j] for j in (i - 1, i + 1) if 0 <= j < len(hits)]
        if not any(abs(p - at) == 1 and other == e - 1 for p, other in near):
            out.append((at, e))
    return out


def indel_hits(seq: Column, motif: Motif | str, k: int, by: str = "last", keep_neighbours: bool = True) -> Column:
    """array<struct(position, errors)>; an Arrow batch function, since each cell depends on the one before."""
    m = _motif(motif)
    search = indel_hits_last if by == "last" else indel_hits_first

    @F.pandas_udf(HITS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for s in batch:
                hits = [] if s is None else search(s, m, k)
                out.append([{"position": a, "errors": e} for a, e in (hits if keep_neighbours else filtered(hits))])
            yield pd.Series(out)

    return run(seq)
