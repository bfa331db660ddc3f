"""Arrow and numpy kernels that the text operators share.

Texts arrive as Arrow string columns.  Everything here works on whole batches: one flat
byte buffer, document offsets, and vectorised word boundaries and hashes, so that no Python
code runs per word.  Hashes are 64 bits wide; equality of 64-bit hashes stands for equality
of the hashed words throughout (expected false matches over 10^9 distinct values: 0.03).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)  # odd, hence invertible modulo 2**64
_WORD_MULT = U64(0xD6E8FEB86659FD93)

#: Character classes over UTF-8 bytes; every byte of a non-ASCII character is 0x80 or more.
_b = np.arange(256)
ALNUM_BYTES = ((_b >= 0x30) & (_b <= 0x39)) | ((_b >= 0x41) & (_b <= 0x5A)) | ((_b >= 0x61) & (_b <= 0x7A)) | (_b >= 0x80)
SPACE_BYTES = (_b == 0x20) | ((_b >= 0x09) & (_b <= 0x0D))
LOWER = np.where((_b >= 0x41) & (_b <= 0x5A), _b + 32, _b).astype(np.uint8)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=U64)
    have = 1
    while have < n:
        take = min(have, n - have)
        np.multiply(out[:take], U64(pow(base, have, 1 << 64)), out=out[have : have + take])
        have += take
    return out[:n]


#: Bytes that are hashed at a time.
PIECE = 1 << 18


class _PowerTable:
    def __init__(self, base: U64):
        self.base, self.pos, self.neg = int(base), np.ones(1, U64), np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > 4 * PIECE:  # a single word, or a set hashed as a whole: not worth keeping
            return _powers(self.base, n), _powers(_inverse(self.base), n)
        if len(self.pos) < n:
            size = 1 << (n - 1).bit_length()
            self.pos, self.neg = _powers(self.base, size), _powers(_inverse(self.base), size)
        return self.pos[:n], self.neg[:n]


_BYTE_POWERS, _WORD_POWERS = _PowerTable(_MULT), _PowerTable(_WORD_MULT)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit (in place on a copy)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUES = mix64((np.arange(256, dtype=U64) + U64(1)) * U64(0xA24BAED4963EE407))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offsets, dtype=np.int64, count=column.offset + n + 1)[column.offset :] if n else np.zeros(1, np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    body = body[offs[0] : offs[-1]]
    return body, offs - offs[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most max_bytes of text, or a single longer row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _LIBC = None


def give_back() -> None:
    """Returns freed memory to the system: workers live on from task to task and share an executor's limit."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


class Words:
    """Words of a block of texts: where each lies, and where each document's words begin.

    starts/ends: byte positions in `body`; first: index of each document's first word, with
    the total at the end.
    """

    __slots__ = ("body", "offsets", "starts", "ends", "first")

    def __init__(self, column: pa.Array, inside: np.ndarray, lower: bool):
        body, self.offsets = flat(column)
        self.body = LOWER[body] if lower else body
        n = len(body)
        mask = inside[body]
        bounds = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        begin, stop = mask.copy(), mask.copy()
        if n:
            begin[1:] &= ~mask[:-1]
            stop[:-1] &= ~mask[1:]
            begin[bounds] |= mask[bounds]
            stop[bounds - 1] |= mask[bounds - 1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes. Texts of any length are taken in pieces, so that tables of powers stay small."""
        out = np.zeros(len(self.starts), dtype=U64)
        at = 0
        while at < len(out):
            base = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, base + PIECE, side="right")))
            begin, end = self.starts[at:to] - base, self.ends[at:to] - base
            n = int(end[-1])
            pos, neg = _BYTE_POWERS.upto(n + 1)
            total = np.zeros(n + 1, dtype=U64)
            np.cumsum(_BYTE_VALUES[self.body[base : base + n]] * pos[:n], out=total[1:])
            out[at:to] = mix64((total[end] - total[begin]) * neg[begin] ^ (end - begin).astype(U64) * _WORD_MULT)
            at = to
        return out

    def text(self, i: int) -> bytes:
        return self.body[self.starts[i] : self.ends[i]].tobytes()


def space_words(column: pa.Array, lower: bool = False) -> Words:
    """Words [^\\x20\\x09-\\x0D]+; lower: A-Z only."""
    return Words(column, ~SPACE_BYTES, lower)


def alnum_words(column: pa.Array) -> Words:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z."""
    return Words(column, ALNUM_BYTES, True)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i:i+k] for each i with i + k <= len(words)."""
    n = len(words)
    if n < k:
        return np.zeros(0, U64)
    out = np.empty(n - k + 1, dtype=U64)
    step = PIECE // 8 if k < PIECE // 16 else n
    for at in range(0, len(out), step):
        part = words[at : at + step + k - 1]
        m = len(part)
        pos, neg = _WORD_POWERS.upto(m + 1)
        total = np.zeros(m + 1, dtype=U64)
        np.cumsum(part * pos[:m], out=total[1:])
        out[at : at + step] = mix64((total[k:] - total[:-k]) * neg[: m - k + 1] + U64(k))
    return out


def sequence_hash(words: np.ndarray) -> int:
    """Hash of the whole sequence, of any length."""
    return int(window_hashes(words, len(words))[0]) if len(words) else 0


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """For each document its distinct k-word shingles, sorted; a shorter text is one shingle, none without words."""
    hashes = words.hashes()
    windows = window_hashes(hashes, k)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(windows[a : b - k + 1])
        elif b > a:
            yield window_hashes(hashes[a:b], b - a)
        else:
            yield np.zeros(0, U64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def spans_of(flags: np.ndarray) -> np.ndarray:
    """(n, 2) int32: [start, end) of the runs of true flags."""
    padded = np.zeros(len(flags) + 2, dtype=np.int8)
    padded[1:-1] = flags
    d = np.diff(padded)
    return np.stack([np.flatnonzero(d == 1), np.flatnonzero(d == -1)], axis=1).astype(np.int32)
