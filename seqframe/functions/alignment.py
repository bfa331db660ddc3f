"""Pairwise alignment, a batch of pairs at a time.

The dynamic programme runs over the cells of the largest pair's matrix, and each step works on one cell of all pairs at
once as a vector, so a batch costs about as many Python steps as one pair.  Pairs are put into batches of similar size.
Banded alignments keep the diagonals of the band alone and step from one anti-diagonal to the next, all its cells of all pairs at once:
memory and time are of length times band.
Trace-backs follow the order of preference that each kind of alignment states for equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import ALPHABETS, basic_letters
from .mutations import Mutation, encode

RESULT = "struct<score:int,mutations:string,from1:int,to1:int,from2:int,to2:int>"
LOW = -(1 << 28)
DIAGONAL, DELETE, INSERT = 0, 1, 2


def simple_matrix(match: int, mismatch: int, alphabet: str = "nucleotide") -> np.ndarray:
    """Scores by code; a wildcard's are the mean over the letters it stands for, truncated."""
    codes = ALPHABETS[alphabet]
    basics = [basic_letters(c, alphabet) for c in codes]
    out = np.zeros((len(codes), len(codes)), dtype=np.int64)
    for i, a in enumerate(basics):
        for j, b in enumerate(basics):
            each = [match if x == y else mismatch for x in a for y in b]
            out[i, j] = int(sum(each) / len(each))
    return out


def parse_matrix(text: str, alphabet: str = "aminoacid", default: int = 0) -> np.ndarray:
    """A matrix in the BLAST text form (# comments, a line of letters, then a line for each letter)."""
    codes = ALPHABETS[alphabet]
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    head = lines[0]
    out = np.full((len(codes), len(codes)), default, dtype=np.int64)
    for row in lines[1:]:
        for letter, score in zip(head, row[1:], strict=False):
            if row[0] in codes and letter in codes:
                out[codes.index(row[0]), codes.index(letter)] = int(score)
    return out


@dataclass(frozen=True)
class LinearScoring:
    matrix: np.ndarray
    gap: int
    alphabet: str = "nucleotide"

    @staticmethod
    def nucleotide(match: int = 5, mismatch: int = -4, gap: int = -5) -> LinearScoring:
        return LinearScoring(simple_matrix(match, mismatch), gap)

    @staticmethod
    def amino(match: int = 5, mismatch: int = -4, gap: int = -5) -> LinearScoring:
        return LinearScoring(simple_matrix(match, mismatch, "aminoacid"), gap, "aminoacid")

    @property
    def open(self) -> int:
        return self.gap

    @property
    def extend(self) -> int:
        return self.gap


@dataclass(frozen=True)
class AffineScoring:
    matrix: np.ndarray
    open: int
    extend: int
    alphabet: str = "nucleotide"

    def __post_init__(self):
        if self.open >= 0 or self.extend >= 0:
            raise ValueError("gap penalties must be negative")

    @staticmethod
    def nucleotide(match: int = 5, mismatch: int = -4, open_: int = -10, extend: int = -1) -> AffineScoring:
        return AffineScoring(simple_matrix(match, mismatch), open_, extend)

    @staticmethod
    def igblast() -> AffineScoring:
        """Nucleotide scores for V genes."""
        #: Match, mismatch, opening and extension of a gap.
        return AffineScoring.nucleotide(10, -30, -40, -10)


Scoring = LinearScoring | AffineScoring


@dataclass(frozen=True)
class Ends:
    """Where an alignment may begin and end, beside its mode.

    added1, added2 (modes added_right, added_left): letters at the end of each sequence that need not be aligned, if all of
    the other is.  bound1, bound2 (mode left): whether gaps before the first letters of seq1 and seq2 cost.
    stop_penalty (mode left): rows are tried while their best score, less the reward of as many matches as rows went before,
    isn't below it.
    """

    added1: int = 0
    added2: int = 0
    bound1: bool = True
    bound2: bool = True
    stop_penalty: int | None = None


ALL = Ends()


@dataclass
class Alignment:
    """seq1, its mutations to seq2 (absolute positions), both ranges and the score."""

    seq1: str
    mutations: list[Mutation]
    range1: tuple[int, int]
    range2: tuple[int, int]
    score: int
    extra: dict = field(default_factory=dict)

    # coordinates
    def to_seq2(self, position: int) -> int:
        """Position in seq2, -1 outside, -2 - p for a deleted letter."""
        from .mutations import to_seq2

        if not self.range1[0] <= position <= self.range1[1]:
            return -1
        p, shift = to_seq2(self.mutations, position), self.range2[0] - self.range1[0]
        return p + shift if p >= 0 else -2 - (-1 - p + shift)

    def to_seq1(self, position: int) -> int:
        from .mutations import to_seq1

        if not self.range2[0] <= position <= self.range2[1]:
            return -1
        p = to_seq1(self.mutations, position - self.range2[0] + self.range1[0])
        return p if p >= 0 else -2 - (-1 - p)

    def range_to_seq2(self, lower: int, upper: int) -> tuple[int, int] | None:
        ends = [-2 - p if p < -1 else p for p in (self.to_seq2(lower), self.to_seq2(upper))]
        return None if -1 in ends else (ends[0], ends[1])

    # columns
    def columns(self) -> Iterator[tuple[int, int, str]]:
        """(position in seq1, position in seq2, kind) of each column, kind `M`, `S`, `I` or `D`."""
        i, j = self.range1[0], self.range2[0]
        for m in [*self.mutations, None]:
            stop = m.position if m else self.range1[1]
            while i < stop:
                yield i, j, "M"
                i, j = i + 1, j + 1
            if m:
                yield i, j, m.kind
                i, j = i + (m.kind != "I"), j + (m.kind != "D")

    def elements(self) -> list[tuple[str, int]]:
        """Runs of (type, length): Deletion, Insertion, and what lies between, Match if it has no substitution."""
        out: list[list] = []
        for _, _, kind in self.columns():
            group = kind if kind in "ID" else "M"
            if out and out[-1][0] == group:
                out[-1][1] += 1
                out[-1][2] |= kind == "S"
            else:
                out.append([group, 1, kind == "S"])
        return [({"I": "Insertion", "D": "Deletion"}.get(g, "Mismatch" if s else "Match"), n) for g, n, s in out]

    def cigar(self) -> str:
        return "".join(f"{n}{kind[0].upper()}" for kind, n in self.elements())

    def similarity(self) -> float:
        """Matches by all columns."""
        kinds = [k for _, _, k in self.columns()]
        return kinds.count("M") / len(kinds) if kinds else 0.0

    def seq2_part(self) -> str:
        from .mutations import mutate

        a, b = self.range1
        return mutate(self.seq1[a:b], [m.moved(-a) for m in self.mutations])

    def rescored(self, scoring: Scoring) -> int:
        """The score under another scoring; neighbouring letters of one kind of gap extend it."""
        codes = ALPHABETS[scoring.alphabet]
        total, last = 0, None
        part, base = self.seq2_part(), self.range2[0]
        for i, j, kind in self.columns():
            if kind in "MS":
                total += int(scoring.matrix[codes.index(self.seq1[i]), codes.index(part[j - base])])
            else:
                total += scoring.extend if last == kind else scoring.open
            last = kind
        return total

    def inverted(self) -> Alignment:
        """The same from seq2's side; letters of seq2 outside the alignment are unknown and shown as N."""
        from .mutations import invert

        shift = self.range2[0] - self.range1[0]
        return Alignment("N" * self.range2[0] + self.seq2_part(), [m.moved(shift) for m in invert(self.mutations)], self.range2, self.range1, self.score)

    def text(self, width: int = 80) -> str:
        """Three lines a block: seq1, `|` for matches, seq2."""
        part, base = self.seq2_part(), self.range2[0]
        top, mid, low = [], [], []
        for i, j, kind in self.columns():
            top.append("-" if kind == "I" else self.seq1[i])
            low.append("-" if kind == "D" else part[j - base])
            mid.append("|" if kind == "M" else " ")
        lines = []
        for at in range(0, max(1, len(top)), width):
            lines += ["".join(x[at : at + width]) for x in (top, mid, low)]
        return "\n".join(lines)

    def trimmed(self, scoring: Scoring) -> Alignment:
        """Without ends whose best cumulative score isn't positive; of equal cuts the longest."""
        codes = ALPHABETS[scoring.alphabet]
        part, base = self.seq2_part(), self.range2[0]
        cols = list(self.columns())

        def scores(cs):
            last, out = None, []
            for i, j, kind in cs:
                out.append(int(scoring.matrix[codes.index(self.seq1[i]), codes.index(part[j - base])]) if kind in "MS" else scoring.extend if last == kind else scoring.open)
                last = kind
            return out

        def lead(cs) -> int:
            total, low, cut = 0, 0, 0
            for n, x in enumerate(scores(cs), 1):
                total += x
                if total <= low:
                    low, cut = total, n
            return cut

        cols = cols[lead(cols) :]
        cut = lead(cols[::-1])
        cols = cols[: len(cols) - cut]
        if not cols:
            at = (self.range1[0], self.range1[0]), (self.range2[0], self.range2[0])
            return Alignment(self.seq1, [], *at, 0)
        first, last = cols[0], cols[-1]
        r1 = first[0], last[0] + (last[2] != "I")
        r2 = first[1], last[1] + (last[2] != "D")
        kept = [Mutation(k, i, self.seq1[i] if k != "I" else None, part[j - base] if k != "D" else None) for i, j, k in cols if k != "M"]
        out = Alignment(self.seq1, kept, r1, r2, 0)
        out.score = out.rescored(scoring)
        return out


def _codes(pairs: list[tuple[str, str]], alphabet: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    table = np.full(256, 0, dtype=np.int64)
    for i, c in enumerate(ALPHABETS[alphabet]):
        table[ord(c)] = table[ord(c.lower())] = i
    n1, n2 = (np.array([len(p[k]) for p in pairs], dtype=np.int64) for k in (0, 1))
    a, b = (np.zeros((len(pairs), int(n.max(initial=0))), dtype=np.int64) for n in (n1, n2))
    for r, (x, y) in enumerate(pairs):
        a[r, : len(x)] = table[np.frombuffer(x.encode(), dtype=np.uint8)]
        b[r, : len(y)] = table[np.frombuffer(y.encode(), dtype=np.uint8)]
    return a, b, n1, n2


def align(pairs: list[tuple[str, str]], scoring: Scoring, mode: str = "global", band: int | None = None, order: tuple[int, ...] | None = None, ends: Ends = ALL) -> list[Alignment | None]:
    """Alignments of all pairs, in order.

    mode: global, local (null without a positive cell; the first strictly best cell ends it), left (both sequences
    begin the alignment, which ends at the best cell), right (both end it, and it begins at the best cell), added_right
    (both begin it, and it ends with the end of one of them, in the added letters of the other; the end of seq2 wins ties),
    added_left (the mirror image).
    band: at most so many indels beyond the difference in length; memory is of length times band, unless gaps before the first
    letters are free (ends), which takes the whole matrix.  order: moves by preference among equal scores.
    """
    if mode in ("right", "added_left"):
        back = align([(x[::-1], y[::-1]) for x, y in pairs], scoring, {"right": "left", "added_left": "added_right"}[mode], band, order, ends)
        return [_mirrored(x, y, r) for (x, y), r in zip(pairs, back, strict=True)]
    out: list[Alignment | None] = [None] * len(pairs)
    by_size = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    in_band = band is not None and ends.bound1 and ends.bound2
    run = _banded_batch if in_band else _batch
    at = 0
    while at < len(by_size):
        to, tall, wide = at, 0, 0
        while to < len(by_size):
            n, m = map(len, pairs[by_size[to]])
            tall, wide = (max(tall, n + m + 1), max(wide, _diagonals(n, m, band))) if in_band else (max(tall, n + 1), max(wide, m + 1))
            if to > at and (to + 1 - at) * tall * wide > 4_000_000:
                break
            to += 1
        chosen = by_size[at:to]
        for i, r in zip(chosen, run([pairs[i] for i in chosen], scoring, mode, band, order, ends), strict=True):
            out[i] = r
        at = to
    return out


def local_scores(refs: list[str], queries: list[str], scoring: Scoring) -> np.ndarray:
    """The best local score of every query (row) against every reference (column), as of align in mode local, 0 where it has none.

    References of similar length are the lanes; a row of the matrix is a few vector steps.  Gaps along it are a running maximum
    of its other cells, each less the extensions up to there.
    """
    letters = ALPHABETS[scoring.alphabet]
    open_, extend = scoring.open, max(scoring.open, scoring.extend)  # a gap may also be opened anew
    longest = min(max(map(len, refs), default=0), max(map(len, queries), default=0))
    span = longest * int(np.abs(scoring.matrix).max()) + (max(map(len, queries), default=0) + 2) * -min(open_, extend)
    kind, low = (np.int16, -16000) if span < 16000 else (np.int32, -(1 << 29))
    worth = np.full((len(letters), len(letters) + 1), low, dtype=kind)  # by letters of query and reference; a last one stands beyond a reference's end
    worth[:, :-1] = scoring.matrix.T
    out = np.zeros((len(queries), len(refs)), dtype=np.int64)
    codes = [_codes([("", q)], scoring.alphabet)[1][0, : len(q)] for q in queries]
    order = np.argsort([len(r) for r in refs], kind="stable")
    width = max(128, (1 << 16) // max(1, max(map(len, queries), default=0)))
    for start in range(0, len(refs), width):
        lanes = order[start : start + width]
        a, _, n, _ = _codes([(refs[i], "") for i in lanes], scoring.alphabet)
        a = np.where(np.arange(a.shape[1]) < n[:, None], a, len(letters)).T
        rows = [np.ascontiguousarray(worth[:, x]) for x in a]
        for number, q in enumerate(codes):
            if not len(q) or not rows:
                continue
            out[number, lanes] = _local_best(rows, q, len(lanes), open_, extend, kind, low)
    return out


def _local_best(rows: list[np.ndarray], q: np.ndarray, lanes: int, open_: int, extend: int, kind: type, low: int) -> np.ndarray:
    """The best cell of one query against the references that rows hold, a table of the letters' worths for each of their places."""
    best, dele, diagonal, side, top, zero = (np.zeros((len(q), lanes), dtype=kind) for _ in range(6))
    dele += low // 2
    most = np.zeros_like(best)
    ahead = (-extend * np.arange(len(q)))[:, None].astype(kind)
    behind = (open_ + extend * np.arange(len(q) - 1))[:, None].astype(kind)
    opened, extended = kind(open_), kind(extend)
    pairs = list(zip(side, side[1:], strict=False))
    for row in rows:
        np.add(dele, extended, out=dele)
        np.add(best, opened, out=side)
        np.maximum(dele, side, out=dele)
        np.take(row, q, axis=0, out=diagonal, mode="clip")
        np.add(diagonal[1:], best[:-1], out=diagonal[1:])
        np.maximum(most, diagonal, out=most)
        np.maximum(diagonal, dele, out=top)
        np.maximum(top, zero, out=top)
        np.add(top, ahead, out=side)
        for x, y in pairs:
            np.maximum(x, y, out=y)
        np.add(side[:-1], behind, out=side[:-1])
        best[0] = top[0]
        np.maximum(top[1:], side[:-1], out=best[1:])
    return most.max(axis=0)


def _move_order(affine: bool, band: int | None) -> tuple[int, ...]:
    return ((DELETE, INSERT, DIAGONAL) if band is not None else (INSERT, DELETE, DIAGONAL)) if affine else (DIAGONAL, DELETE, INSERT)


def _added_ends(n1: np.ndarray, n2: np.ndarray, ends: Ends, at) -> tuple[np.ndarray, np.ndarray]:
    """The best end of each pair in mode added_right; at(i, j): the values of one cell of each pair, of cells that exist."""
    end1, end2, top = n1.copy(), n2.copy(), np.full(len(n1), LOW - 1)
    for i, j in [(n1 - k, n2) for k in range(ends.added1, -1, -1)] + [(n1, n2 - k) for k in range(ends.added2, -1, -1)]:
        here = np.where((i >= 0) & (j >= 0), at(np.maximum(i, 0), np.maximum(j, 0)), LOW - 1)
        better = here > top
        top, end1, end2 = np.where(better, here, top), np.where(better, i, end1), np.where(better, j, end2)
    return end1, end2


def _diagonals(n: int, m: int, band: int) -> int:
    """Cells of an anti-diagonal inside the band, at most, and the spare ones beside them."""
    return (abs(m - n) + 2 * band + 1) // 2 + 4


class _Band:
    """Cells of a band by (i, j).

    Cells are kept by anti-diagonal s = i + j; on one, every second diagonal d = j - i has a cell.  The lowest diagonal of a pair is
    taken down to an even number, low, so that in all pairs alike the t-th cell of an even s lies on low + 2 t and that of
    an odd s on low + 2 t + 1.  A spare column on each side holds LOW.
    """

    def __init__(self, cells: np.ndarray, low: int):
        self.cells, self.low = cells, low

    def __getitem__(self, cell: tuple[int, int]):
        i, j = cell
        t = (j - i - self.low) >> 1
        return self.cells[i + j, t + 1] if 0 <= t < self.cells.shape[1] - 2 else LOW


def _banded_batch(pairs, scoring: Scoring, mode: str, band: int, order, ends: Ends) -> list[Alignment | None]:
    """_batch in the diagonals of a band; gaps before the first letters cost, except in mode local."""
    affine, local = isinstance(scoring, AffineScoring), mode == "local"
    order = order or _move_order(affine, band)
    a, b, n1, n2 = _codes(pairs, scoring.alphabet)
    a, b = (x if x.shape[1] else np.zeros((len(pairs), 1), np.int64) for x in (a, b))
    count, lane = len(pairs), np.arange(len(pairs))
    lowest, highest = np.minimum(0, n2 - n1) - band, np.maximum(0, n2 - n1) + band
    half = lowest // 2
    width, steps = int(((highest - 2 * half) // 2).max()) + 1, int((n1 + n2).max()) + 1
    t = np.arange(width)[:, None]
    best = np.full((steps, width + 2, count), LOW, dtype=np.int32)
    dele, ins = (np.full_like(best, LOW) for _ in range(2)) if affine else (None, None)
    scores, open_, extend = scoring.matrix.astype(np.int32), scoring.open, scoring.extend

    def places(s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and columns of an anti-diagonal's cells, and which of these are inside the matrix and the band."""
        i = s // 2 - half - t
        j = s - i
        return i, j, (i >= 0) & (i <= n1) & (j >= 0) & (j <= n2) & (j - i >= lowest) & (j - i <= highest)

    best[0, 1:-1] = np.where(places(0)[0] == 0, 0, LOW)
    for s in range(1, steps):
        i, j, inside = places(s)
        above, beside = (slice(2, None), slice(1, -1)) if s % 2 else (slice(1, -1), slice(0, -2))  # (i - 1, j) and (i, j - 1) on s - 1
        if affine:
            d = np.maximum(best[s - 1, above] + open_, dele[s - 1, above] + extend)
            n = np.maximum(best[s - 1, beside] + open_, ins[s - 1, beside] + extend)
        else:
            d, n = best[s - 1, above] + open_, best[s - 1, beside] + open_
        top = np.maximum(d, n)
        if s > 1:
            letters = scores[a[lane, np.clip(i - 1, 0, a.shape[1] - 1)], b[lane, np.clip(j - 1, 0, b.shape[1] - 1)]]
            inner = (i > 0) & (j > 0)
            top = np.where(inner, np.maximum(top, best[s - 2, 1:-1] + letters), top)
        if local:
            top = np.maximum(top, 0)
        best[s, 1:-1] = np.where(inside, top, LOW)
        if affine:
            dele[s, 1:-1], ins[s, 1:-1] = np.where(inside, d, LOW), np.where(inside, n, LOW)

    def at(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        k = (j - i - 2 * half) >> 1
        return np.where((k >= 0) & (k < width), best[i + j, np.clip(k, -1, width) + 1, lane], LOW)

    end1, end2 = n1.copy(), n2.copy()
    if mode == "added_right":
        end1, end2 = _added_ends(n1, n2, ends, at)
    elif mode != "global":
        last_row = _rows_tried(best, places, n1, scoring, ends) if ends.stop_penalty is not None else n1
        top, end1, end2 = np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64)
        for s in range(1, steps):
            i, _, inside = places(s)
            here = np.where(inside & (i <= last_row), best[s, 1:-1], LOW)[::-1]  # by rows
            k = here.argmax(axis=0)
            value, row = here[k, lane], i[::-1][k, lane]
            better = (value > top) | (value == top) & (top > 0) & (row < end1)  # of equals the first by rows
            top, end1, end2 = np.where(better, value, top), np.where(better, row, end1), np.where(better, s - row, end2)
    views = lambda m, r: None if m is None else _Band(m[:, :, r], int(2 * half[r]))
    return [_trace(pairs[r], a[r], b[r], int(end1[r]), int(end2[r]), views(best, r), views(dele, r), views(ins, r), scoring, order, local, local, local) for r in range(count)]


def _rows_tried(best, places, n1: np.ndarray, scoring: Scoring, ends: Ends) -> np.ndarray:
    """The last row that each pair's search comes to: the first whose best cell is too low (Ends.stop_penalty), or the last of all."""
    rows = np.full((int(n1.max()) + 1, len(n1)), LOW, dtype=np.int64)
    for s in range(2, len(best)):
        i, j, inside = places(s)
        cell, lane = np.nonzero(inside & (i > 0) & (j > 0))
        row = i[cell, lane]
        rows[row, lane] = np.maximum(rows[row, lane], best[s, cell + 1, lane])
    low = rows[1:] - np.arange(len(rows) - 1)[:, None] * int(scoring.matrix[0, 0]) < ends.stop_penalty
    return np.where(low.any(axis=0), low.argmax(axis=0) + 1 if len(low) else 0, n1)


def _mirrored(x: str, y: str, r: Alignment | None) -> Alignment | None:
    if r is None:
        return None
    n, m = len(x), len(y)
    flipped = [Mutation(k.kind, n - k.position - (k.kind != "I"), k.from_, k.to) for k in reversed(r.mutations)]
    return Alignment(x, flipped, (n - r.range1[1], n - r.range1[0]), (m - r.range2[1], m - r.range2[0]), r.score)


def _batch(pairs, scoring: Scoring, mode: str, band: int | None, order, ends: Ends) -> list[Alignment | None]:
    affine = isinstance(scoring, AffineScoring)
    order = order or _move_order(affine, band)
    a, b, n1, n2 = _codes(pairs, scoring.alphabet)
    count, rows, cols = len(pairs), a.shape[1] + 1, b.shape[1] + 1
    open_, extend = scoring.open, scoring.extend
    best = np.full((rows, cols, count), LOW, dtype=np.int32)
    dele, ins = (np.full((rows, cols, count), LOW, dtype=np.int32) for _ in range(2)) if affine else (None, None)
    edge = lambda n: open_ + (n - 1) * extend
    free1, free2 = mode == "local" or not ends.bound1, mode == "local" or not ends.bound2
    best[0, 0] = 0
    reach_low = np.minimum(0, n2 - n1) - band if band is not None else None
    reach_high = np.maximum(0, n2 - n1) + band if band is not None else None
    local = mode == "local"
    for i in range(1, rows):
        if free1:
            best[i, 0] = 0
        else:
            best[i, 0] = edge(i) if band is None else np.where(-i >= reach_low, edge(i), LOW)
        if affine and not free1:
            dele[i, 0] = best[i, 0]
    for j in range(1, cols):
        if free2:
            best[0, j] = 0
        else:
            best[0, j] = edge(j) if band is None else np.where(j <= reach_high, edge(j), LOW)
        if affine and not free2:
            ins[0, j] = best[0, j]
    lane = np.arange(count)
    scores = scoring.matrix.astype(np.int32)
    for i in range(1, rows):
        for j in range(1, cols):
            diagonal = best[i - 1, j - 1] + scores[a[:, i - 1], b[:, j - 1]]
            if affine:
                d = np.maximum(best[i - 1, j] + open_, dele[i - 1, j] + extend)
                n = np.maximum(best[i, j - 1] + open_, ins[i, j - 1] + extend)
            else:
                d, n = best[i - 1, j] + open_, best[i, j - 1] + open_
            top = np.maximum(diagonal, np.maximum(d, n))
            if local:
                top = np.maximum(top, 0)
            if band is not None:
                outside = (j - i < reach_low) | (j - i > reach_high)
                top[outside] = LOW
                if affine:
                    d[outside], n[outside] = LOW, LOW
            best[i, j] = top
            if affine:
                dele[i, j], ins[i, j] = d, n
    end1, end2 = n1.copy(), n2.copy()
    if mode == "added_right":
        end1, end2 = _added_ends(n1, n2, ends, lambda i, j: best[i, j, lane])
    elif mode != "global":
        floor = 0
        inside = (np.arange(rows)[:, None, None] <= n1) & (np.arange(cols)[None, :, None] <= n2)
        if ends.stop_penalty is not None:
            reward = int(scoring.matrix[0, 0])
            row_best = np.where(inside, best, LOW)[1:, 1:].max(axis=1)
            low = row_best - np.arange(rows - 1)[:, None] * reward < ends.stop_penalty
            # the edge and the first row are always tried, a later one if no row before it was too low
            tried = np.vstack([np.ones((min(2, rows), count), bool), np.cumsum(low, axis=0)[:-1] == 0])
            inside = inside & tried[:, None, :]
        masked = np.where(inside, best, LOW).reshape(rows * cols, count)
        where = masked.argmax(axis=0)  # the first of equals by rows
        top = masked[where, lane]
        end1, end2 = where // cols, where % cols
        nothing = top <= floor
        end1[nothing] = end2[nothing] = 0
    return [_trace(pairs[r], a[r], b[r], int(end1[r]), int(end2[r]), best[:, :, r], dele[:, :, r] if affine else None, ins[:, :, r] if affine else None, scoring, order, local, free1, free2) for r in range(count)]


def _trace(pair, a, b, i, j, best, dele, ins, scoring, order, local, free1, free2) -> Alignment | None:
    if local and i == 0:
        return None
    to1, to2, score = i, j, int(best[i, j])
    codes, matrix = ALPHABETS[scoring.alphabet], scoring.matrix
    out: list[Mutation] = []
    state = None  # inside which gap the path is
    now = score
    while i or j:
        if state is None and (local and now == 0 or (free2 and i == 0) or (free1 and j == 0)):
            break
        moves = (state,) if state is not None else order
        for move in moves:
            if move == DIAGONAL and i and j and now == best[i - 1, j - 1] + matrix[a[i - 1], b[j - 1]]:
                if a[i - 1] != b[j - 1]:
                    out.append(Mutation("S", i - 1, codes[a[i - 1]], codes[b[j - 1]]))
                i, j = i - 1, j - 1
                now = int(best[i, j])
                break
            if move == DELETE and i and (state == DELETE or now == (dele[i, j] if dele is not None else best[i - 1, j] + scoring.gap)):
                out.append(Mutation("D", i - 1, codes[a[i - 1]], None))
                stays = dele is not None and now == dele[i - 1, j] + scoring.extend
                i -= 1
                state, now = (DELETE, int(dele[i, j])) if stays else (None, int(best[i, j]))
                break
            if move == INSERT and j and (state == INSERT or now == (ins[i, j] if ins is not None else best[i, j - 1] + scoring.gap)):
                out.append(Mutation("I", i, None, codes[b[j - 1]]))
                stays = ins is not None and now == ins[i, j - 1] + scoring.extend
                j -= 1
                state, now = (INSERT, int(ins[i, j])) if stays else (None, int(best[i, j]))
                break
        else:
            raise AssertionError("no move leads to this cell")
    return Alignment(pair[0].upper(), out[::-1], (i, to1), (j, to2), score)


def align_substitutions(a: str, b: str, scoring: Scoring | None = None) -> Alignment:
    """Position by position; both of one length."""
    if len(a) != len(b):
        raise ValueError("sequences differ in length")
    scoring = scoring or LinearScoring(simple_matrix(1, -1), -1)
    codes = ALPHABETS[scoring.alphabet]
    muts = [Mutation("S", i, x, y) for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y]
    return Alignment(a, muts, (0, len(a)), (0, len(b)), sum(int(scoring.matrix[codes.index(x), codes.index(y)]) for x, y in zip(a, b, strict=True)))


def substitution_columns(seq1: Column, seq2: Column, match: int = 5, mismatch: int = -4) -> Column:
    """struct(score, mutations) of align_substitutions, of built-in expressions; null for sequences of different lengths."""
    letters = F.arrays_zip(F.split(F.upper(seq1), "").alias("a"), F.split(F.upper(seq2), "").alias("b"))
    muts = F.filter(F.transform(letters, lambda x, i: F.when(x["a"] != x["b"], F.concat(F.lit("S"), x["a"], i.cast("string"), x["b"]))), lambda m: m.isNotNull())
    n = F.length(seq1)
    score = (n - F.size(muts)) * match + F.size(muts) * mismatch
    return F.when(n == F.length(seq2), F.struct(score.cast("int").alias("score"), F.array_join(muts, "").alias("mutations")))


def align_columns(seq1: Column, seq2: Column, scoring: Scoring | None = None, mode: str = "global", band: int | None = None, ends: Ends = ALL) -> Column:
    """struct(score, mutations, from1, to1, from2, to2); null without an alignment or for nulls. Arrow batches."""
    scoring = scoring or LinearScoring.nucleotide()

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, y in batches:
            some = [i for i, (p, q) in enumerate(zip(x, y, strict=True)) if p is not None and q is not None]
            rows: list[tuple] = [(None,) * 6] * len(x)
            for i, r in zip(some, align([(x.iloc[i], y.iloc[i]) for i in some], scoring, mode, band, None, ends), strict=True):
                if r is not None:
                    rows[i] = (r.score, encode(r.mutations), *r.range1, *r.range2)
            out = pd.DataFrame(rows, columns=["score", "mutations", "from1", "to1", "from2", "to2"])
            yield out.astype({c: "Int32" for c in out.columns if c != "mutations"})

    return run(seq1, seq2)
