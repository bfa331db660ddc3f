"""Integer hashes with fixed definitions, over arrays, and what is drawn with them. Partitioning uses Spark's own hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import basic_letters, is_wildcard

_U64, _U32 = np.uint64, np.uint32


def wang64(key: np.ndarray) -> np.ndarray:
    """Thomas Wang's 64-bit mix (2007) over int64."""
    k = np.atleast_1d(np.asarray(key, dtype=np.int64)).view(_U64).copy()
    k = ~k + (k << _U64(21))
    for right, factor in ((24, 265), (14, 21)):
        k ^= k >> _U64(right)
        k *= _U64(factor)
    k ^= k >> _U64(28)
    k += k << _U64(31)
    return k.view(np.int64)


def wang32(key: np.ndarray) -> np.ndarray:
    """Wang's 32-bit mix with a multiplication."""
    k = np.atleast_1d(np.asarray(key, dtype=np.int32)).view(_U32).copy()
    k = (k ^ _U32(61)) ^ (k >> _U32(16))
    k *= _U32(9)
    k ^= k >> _U32(4)
    k *= _U32(0x27D4EB2D)
    k ^= k >> _U32(15)
    return k.view(np.int32)


def jenkins_wang32(key: np.ndarray) -> np.ndarray:
    """Wang's 32-bit mix of shifts and additions."""
    k = np.atleast_1d(np.asarray(key, dtype=np.int32)).view(_U32).copy()
    k = ~k + (k << _U32(15))
    k ^= k >> _U32(12)
    k *= _U32(5)
    k ^= k >> _U32(4)
    k *= _U32(2057)
    k ^= k >> _U32(16)
    return k.view(np.int32)


def wang64to32(key: np.ndarray) -> np.ndarray:
    """Wang's mix of int64 to int32."""
    k = np.atleast_1d(np.asarray(key, dtype=np.int64)).view(_U64).copy()
    k = ~k + (k << _U64(18))
    k ^= k >> _U64(31)
    k *= _U64(21)
    k ^= k >> _U64(11)
    k += k << _U64(6)
    k ^= k >> _U64(22)
    return k.astype(_U32).view(np.int32)


def jenkins_mix(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Bob Jenkins's reversible mix of three int32 (1997): the last of them."""
    a, b, c = (np.atleast_1d(np.asarray(x, dtype=np.int32)).view(_U32).copy() for x in (a, b, c))
    #: Shifts right, left, right of each round.
    for right, left, back in ((13, 8, 13), (12, 16, 5), (3, 10, 15)):
        a = (a - b - c) ^ (c >> _U32(right))
        b = (b - c - a) ^ (a << _U32(left))
        c = (c - a - b) ^ (b >> _U32(back))
    return c.view(np.int32)


def fnv64to32(key: int) -> int:
    """FNV-1a, 32 bits, of a signed 64-bit number's bytes from the highest on; a signed number."""
    h = fnv(int(key).to_bytes(8, "big", signed=True), 32)
    return h - (h >> 31 << 32)


def fnv(data: bytes, bits: int = 64) -> int:
    """FNV-1a."""
    #: Offset basis and prime.
    basis, prime = {32: (0x811C9DC5, 0x01000193), 64: (0xCBF29CE484222325, 0x100000001B3)}[bits]
    h = basis
    for b in data:
        h = (h ^ b) * prime % (1 << bits)
    return h


def murmur2(data: bytes, seed: int = 0) -> int:
    """MurmurHash2, 32 bits."""
    m, mask = 0x5BD1E995, 0xFFFFFFFF
    h, whole = (seed ^ len(data)) & mask, len(data) // 4 * 4
    for k in np.frombuffer(data[:whole], dtype="<u4").tolist():
        k = k * m & mask
        h = (h * m & mask) ^ ((k ^ k >> 24) * m & mask)
    if data[whole:]:
        h = (h ^ int.from_bytes(data[whole:], "little")) * m & mask
    h = (h ^ h >> 13) * m & mask
    return h ^ h >> 15


def draw_letter(letter: str, seed: int, alphabet: str = "nucleotide") -> str:
    """One of the letters that a wildcard stands for, by seed."""
    from .alphabet import ALPHABETS

    letters = sorted(basic_letters(letter, alphabet), key=ALPHABETS[alphabet].index)
    return letters[abs(int(wang64(seed)[0])) % len(letters)]


def wildcards_to_letters(seq: str, seed: int, alphabet: str = "nucleotide") -> str:
    """Each wildcard replaced by a letter it stands for; the seed moves on from wildcard to wildcard."""
    out = []
    for i, c in enumerate(seq):
        if is_wildcard(c, alphabet):
            seed = int(wang64(np.int64((seed + i + (1 << 63)) % (1 << 64) - (1 << 63)))[0])
            c = draw_letter(c, seed, alphabet)
        out.append(c)
    return "".join(out)


def resolve_wildcards(seq: Column, seed: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for s, k in batches:
            yield pd.Series([x if x is None or pd.isna(n) else wildcards_to_letters(x, int(n)) for x, n in zip(s, k, strict=True)])

    return run(seq, seed)
