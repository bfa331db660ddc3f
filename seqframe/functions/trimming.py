"""Quality trimming: windows of sufficient mean quality, from the edges or as islands inside a read.

Positions follow one rule throughout: a scan returns the last position outside the region it looked for, and
-2 - position if it found none.  Scans run over all reads of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = "struct<lower:int,upper:int>"


@dataclass(frozen=True)
class TrimParameters:
    average_quality: float = 20.0
    window: int = 8

    def __post_init__(self):
        if self.window <= 0:
            raise ValueError("the window must have a positive size")


def absolute(position: int) -> int:
    return position if position >= -1 else -2 - position


class Reads:
    """Qualities of a batch of reads as a padded matrix, with what every scan needs: sums, windows and the nearest of each kind."""

    def __init__(self, quals: list[np.ndarray], p: TrimParameters):
        self.p, self.sizes = p, np.array([len(q) for q in quals], dtype=np.int64)
        widest = int(self.sizes.max(initial=0))
        self.q = np.zeros((len(quals), widest), dtype=np.int64)
        self.q[np.arange(widest) < self.sizes[:, None]] = np.concatenate([np.zeros(0, np.int64), *quals])
        self.total = np.zeros((len(quals), widest + 1), dtype=np.int64)
        np.cumsum(self.q, axis=1, out=self.total[:, 1:])
        good, places = self.q >= p.average_quality, np.arange(widest)
        # last place up to here that isn't of the kind looked for, by kind
        self.last_other = {rise: np.maximum.accumulate(np.where(good != rise, places, -1), axis=1) for rise in (True, False)}
        # next window from here on that is of the kind looked for; windows that hang over the end are none
        windows = max(0, widest - p.window + 1)
        high = self.total[:, p.window :] - self.total[:, : windows] >= self.need(p.window) if windows else np.zeros((len(quals), 0), dtype=bool)
        self.next_window = {}
        for rise in (True, False):
            at = np.full((len(quals), widest + 2), widest + 1, dtype=np.int64)
            at[:, :windows] = np.where(high == rise, np.arange(windows), widest + 1)
            self.next_window[rise] = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1]

    def need(self, width):
        """The least sum of qualities of a good window."""
        return np.ceil(np.float32(self.p.average_quality) * np.asarray(width, dtype=np.float32)).astype(np.int64)

    def mirrored(self) -> Reads:
        return Reads([self.q[i, :n][::-1] for i, n in enumerate(self.sizes.tolist())], self.p)

    def forward(self, rows: np.ndarray, left: np.ndarray, right: np.ndarray, rise: bool) -> np.ndarray:
        """Scans [left, right) of each row to the right; none is of an empty read.

        The border lies at the last place not of the kind looked for, within a window: where the window at `left` is of that
        kind already, the nearest window to its left that isn't (or the read's begin) bounds it, else the first to its right that is.
        """
        p, width = self.p, np.minimum(right - left, self.p.window)
        need = self.need(width)
        high = lambda at: self.total[rows, at + width] - self.total[rows, at] >= need
        start = np.where(width < p.window, left, np.minimum(self.next_window[rise][rows, left], right - width))
        reached = high(start) == rise
        edge = start + width - 1
        inside = high(left) == rise
        if inside.any():
            edge = np.where(inside, left - 1, edge)
            open_ = inside.copy()
            for back in range(1, p.window + 1):
                open_ &= back <= width
                if not open_.any():
                    break
                ends = open_ & ((left < back) | (high(np.maximum(left - back, 0)) != rise))
                edge = np.where(ends, left + width - back, edge)
                open_ &= ~ends
        found = np.maximum(left - 1, np.where(edge >= 0, self.last_other[rise][rows, np.maximum(edge, 0)], -1))
        return np.where(inside | reached, found, -2 - found)

    def islands(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, lower, upper) of the good ranges of a window's size at least, in order; ranges that touch are one."""
        rows, at = np.flatnonzero(self.sizes), np.zeros(int((self.sizes > 0).sum()), dtype=np.int64)
        pieces = []
        while len(rows):
            ends = self.sizes[rows]
            outside = self.forward(rows, at, ends, True)
            on = outside >= -1
            rows, outside, ends = rows[on], outside[on], ends[on]
            beyond = self.forward(rows, outside + 1, ends, False)
            beyond = np.where(beyond >= -1, beyond, -2 - beyond)
            wide = beyond - outside >= self.p.window
            pieces.append((rows[wide], outside[wide] + 1, beyond[wide] + 1))
            at, on = beyond + 1, beyond + 1 < ends
            rows, at = rows[on], at[on]
        if not pieces:
            return (np.zeros(0, dtype=np.int64),) * 3
        row, lower, upper = (np.concatenate(x) for x in zip(*pieces, strict=True))
        order = np.argsort(row, kind="stable")
        row, lower, upper = row[order], lower[order], upper[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (lower[1:] != upper[:-1])
        first = np.flatnonzero(new)
        return row[first], lower[first], upper[np.append(first[1:], len(row))[: len(first)] - 1]

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, lower, upper) of each read's island with the largest sum of qualities, the first of equals."""
        row, lower, upper = self.islands()
        weight = self.total[row, upper] - self.total[row, lower]
        order = np.lexsort((lower, -weight, row))
        first = order[np.unique(row[order], return_index=True)[1]]
        return row[first], lower[first], upper[first]

    def trimmed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, lower, upper) of what is left between the first good windows from both edges."""
        rows = np.flatnonzero(self.sizes)
        size = self.sizes[rows]
        low = self.forward(rows, np.zeros_like(size), size, True)
        low = np.where(low >= -1, low, -2 - low) + 1
        rows, size, low = rows[low < size], size[low < size], low[low < size]
        back = self.mirrored().forward(rows, np.zeros_like(size), size - low, True) if len(rows) else low
        high = size - 1 - np.where(back >= -1, back, -2 - back)
        some = high != low
        return rows[some], low[some], high[some]


def scan(q: np.ndarray, left: int, right: int, step: int, rise: bool, p: TrimParameters) -> int:
    """Scans [left, right) with `step` +1 or -1 for the first window that is good enough (rise) or isn't (fall).

    A scan to the left is one to the right over the mirrored read.
    """
    if step not in (1, -1):
        raise ValueError("step is +1 or -1")
    n = len(q)
    if n == 0:
        return -1 if step == 1 else 0
    one = lambda q, a, b: int(Reads([np.asarray(q)], p).forward(np.array([0]), np.array([a]), np.array([b]), rise)[0])
    if step == 1:
        return one(q, left, right)
    found = one(q[::-1], n - right, n - left)
    inner = n - 1 - absolute(found)
    return inner if found >= -1 else -2 - inner


def extend_range(q: np.ndarray, p: TrimParameters, lower: int, upper: int) -> tuple[int, int]:
    """The largest range around [lower, upper) that stays good on both sides."""
    return absolute(scan(q, 0, lower, -1, False, p)), absolute(scan(q, upper, len(q), 1, False, p)) + 1


def islands(q: np.ndarray, p: TrimParameters, start: int = 0, step: int = 1) -> list[tuple[int, int]]:
    """Good ranges of a window's size at least, in order, from `start` on in the direction of `step`; ranges that touch are one."""
    n = len(q)
    found: list[tuple[int, int]] = []
    at = start
    while 0 <= at < n:
        outside = scan(q, at, n, 1, True, p) if step == 1 else scan(q, 0, at, -1, True, p)
        if outside < -1 or (step == -1 and outside == 0):  # none, or no room for one
            break
        beyond = absolute(scan(q, outside + 1, n, 1, False, p) if step == 1 else scan(q, 0, outside - 1, -1, False, p))
        if abs(beyond - outside) >= p.window:
            found.append((outside + 1, beyond + 1) if step == 1 else (beyond, outside))
        at = beyond + step
    return _joined(sorted(found))


def _joined(pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lower, upper in pieces:
        if out and out[-1][1] == lower:
            lower = out.pop()[0]
        out.append((lower, upper))
    return out


def islands_around(q: np.ndarray, p: TrimParameters, lower: int, upper: int) -> list[tuple[int, int]]:
    """The extended range and the islands on both sides of it, in order."""
    low, high = extend_range(q, p, lower, upper)
    before = islands(q, p, low - 1, -1) if low > p.window - 1 else []
    after = islands(q, p, high, 1) if high <= len(q) - p.window else []
    return [*before, *_joined([(low, high), *after])]


def trim(q: np.ndarray, p: TrimParameters, lower: int = 0, upper: int | None = None) -> tuple[int, int] | None:
    """Cuts both edges up to the first good window; None if nothing is left."""
    upper = len(q) if upper is None else upper
    low = absolute(scan(q, lower, upper, 1, True, p)) + 1
    if low == upper:
        return None
    high = absolute(scan(q, low, upper, -1, True, p))
    return None if high == low else (low, high)


def best_island(q: np.ndarray, p: TrimParameters) -> tuple[int, int] | None:
    """The island with the largest sum of qualities, the first of equals."""
    found = islands(q, p)
    return max(found, key=lambda r: (int(np.sum(q[r[0] : r[1]])), -r[0]), default=None)


#: Places of the padded matrix of a batch.
BATCH_CELLS = 1 << 21


def _batches(quals: pd.Series, p: TrimParameters) -> Iterator[tuple[np.ndarray, Reads]]:
    """(rows of the series, their reads), reads of like lengths together; nulls are left out."""
    some = np.array([i for i, q in enumerate(quals) if q is not None], dtype=np.int64)
    sizes = np.array([len(quals.iloc[i]) for i in some.tolist()], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * sizes[order[to]] <= BATCH_CELLS:
            to += 1
        chosen = some[order[at:to]]
        yield chosen, Reads([np.asarray(quals.iloc[i], dtype=np.int64) for i in chosen.tolist()], p)
        at = to


def _ranges(find):
    def column(qual: Column, p: TrimParameters | None = None) -> Column:
        p = p or TrimParameters()

        @F.pandas_udf(RANGE)
        def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for quals in series:
                out = np.full((len(quals), 2), -1, dtype=np.int64)
                for rows, batch in _batches(quals, p):
                    row, lower, upper = find(batch)
                    out[rows[row], 0], out[rows[row], 1] = lower, upper
                none = out[:, 0] < 0
                yield pd.DataFrame({c: pd.arrays.IntegerArray(out[:, i].astype(np.int32), none.copy()) for i, c in enumerate(("lower", "upper"))})

        return run(qual)

    return column


#: struct(lower, upper) with null fields where nothing is left.
trimmed_range = _ranges(Reads.trimmed)
best_island_range = _ranges(Reads.best)


def island_ranges(qual: Column, p: TrimParameters | None = None) -> Column:
    """array<struct(lower, upper)> of all islands."""
    p = p or TrimParameters()

    @F.pandas_udf(f"array<{RANGE}>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for quals in series:
            out: list[list | None] = [None if q is None else [] for q in quals]
            for rows, batch in _batches(quals, p):
                for row, lower, upper in zip(*(x.tolist() for x in batch.islands()), strict=True):
                    out[rows[row]].append({"lower": lower, "upper": upper})
            yield pd.Series(out)

    return run(qual)


def trim_read(seq: Column, qual: Column, p: TrimParameters | None = None) -> Column:
    """struct(seq, qual) of the best island; an empty read if there is none."""
    r = best_island_range(qual, p)
    low, n = F.coalesce(r["lower"], F.lit(0)), F.coalesce(r["upper"] - r["lower"], F.lit(0))
    return F.struct(F.substring(seq, low + 1, n).alias("seq"), F.slice(qual, low + 1, n).alias("qual"))
