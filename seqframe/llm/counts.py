"""Tables of counts over hashed cells: summed in each task, then by segment, then brought together.

A table has 2**bits cells whatever the corpus.  A task adds up what it reads and sends, for each segment of
2**16 cells, only the cells that it met; segments are summed by streams that hold one segment's sums at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SEGMENT = 1 << 16
SCHEMA = "name string, segment int, cells binary, counts binary"


def emit(tables: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The non-zero cells of a task's tables."""
    for name, table in tables.items():
        for s in range(0, len(table), SEGMENT):
            part = table[s : s + SEGMENT]
            cells = np.flatnonzero(part)
            if len(cells):
                n = part[cells].astype(np.int64)
                yield pa.record_batch([pa.array([name]), pa.array([s // SEGMENT], pa.int32()), pa.array([_planes(np.diff(cells, prepend=0), 2)], pa.binary()), pa.array([_planes(n, 8 if n.max() >> 32 else 4 if n.max() >> 8 else 1)], pa.binary())], names=["name", "segment", "cells", "counts"])


def _planes(x: np.ndarray, width: int) -> bytes:
    """Numbers as their first bytes, then their second ones, and so on: high bytes are mostly 0, which the shuffle's compression likes."""
    return np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def _numbers(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes."""
    return pa.compress(_planes(x, 8), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    """The n numbers that packed() took."""
    return _numbers(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), 8).view(np.int64)


def _unpacked(cells: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    at = np.cumsum(_numbers(cells, 2).astype(np.int64))
    return at, _numbers(counts, len(counts) // len(at)).astype(np.int64)


def _sum_segments(batches):
    key, total = None, np.zeros(SEGMENT, dtype=np.int64)
    for batch in batches:
        for name, segment, cells, counts in zip(*(batch.column(c).to_pylist() for c in ("name", "segment", "cells", "counts")), strict=True):
            if (name, segment) != key:
                if key:
                    yield from _one(key, total)
                key, total = (name, segment), np.zeros(SEGMENT, dtype=np.int64)
            at, n = _unpacked(cells, counts)
            total[at] += n
    if key:
        yield from _one(key, total)


def _one(key, total):
    for batch in emit({key[0]: total}):
        yield batch.set_column(1, "segment", pa.array([key[1]], pa.int32()))


def gather(parts: DataFrame, sizes: dict[str, int]) -> dict[str, np.ndarray]:
    """The summed tables, at most sum(sizes) cells whatever the corpus."""
    summed = parts.repartition("name", "segment").sortWithinPartitions("name", "segment").mapInArrow(_sum_segments, SCHEMA)
    out = {name: np.zeros(n, dtype=np.int64) for name, n in sizes.items()}
    for r in summed.toLocalIterator():
        at, n = _unpacked(bytes(r["cells"]), bytes(r["counts"]))
        out[r["name"]][r["segment"] * SEGMENT + at] = n
    return out
