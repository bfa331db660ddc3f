"""Phred qualities: array<int> inside, text with an offset at the edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Good, best and worst quality, and the offset and range of each text format.
GOOD, MAX, BAD = 34, 58, 0
FORMATS = {"phred33": (33, 0, 50), "phred64": (64, 0, 41)}


def decode(text: Column, offset: int = 33, check: str | None = None) -> Column:
    q = F.when(F.length(text) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(text, ""), lambda c: F.ascii(c) - offset))
    if check is None:
        return q
    _, low, high = FORMATS[check]
    return F.when(F.forall(q, lambda x: x.between(low, high)), q).otherwise(F.when(text.isNotNull(), F.raise_error(F.lit(f"quality out of the range of {check}"))))


def encode(q: Column, offset: int = 33) -> Column:
    return F.array_join(F.transform(q, lambda x: F.char(x + offset)), "")


def uniform(n: Column, value: int = GOOD) -> Column:
    return F.array_repeat(F.lit(value), n)


def min_value(q: Column) -> Column:
    return F.array_min(q)


def total(q: Column) -> Column:
    return F.aggregate(q, F.lit(0), lambda a, x: a + x)


def mean_value(q: Column) -> Column:
    """Rounded towards zero; 0 for no values."""
    return F.when(F.size(q) == 0, 0).otherwise((total(q) / F.size(q)).cast("int"))


def value_at(q: Column, position: Column) -> Column:
    return F.get(q, position)


def log10_p(value: Column, legacy: bool = False) -> Column:
    """log10 of the chance of an error; legacy divides as integers."""
    return -(F.floor(value / 10) if legacy else value / 10)


def p_error(value: Column, legacy: bool = False) -> Column:
    return F.pow(F.lit(10.0), log10_p(value, legacy))


def sub_range(q: Column, lower: Column, upper: Column, reverse: Column | None = None) -> Column:
    part = F.slice(q, lower + 1, upper - lower)
    return part if reverse is None else F.when(reverse, F.reverse(part)).otherwise(part)


def read(seq: Column, q: Column) -> Column:
    """struct(seq, qual); an error where the lengths differ."""
    return F.when(F.length(seq) == F.size(q), F.struct(seq.alias("seq"), q.alias("qual"))).otherwise(F.raise_error(F.lit("sequence and quality differ in length")))


def read_reverse_complement(r: Column) -> Column:
    from .sequence import reverse_complement

    return F.struct(reverse_complement(r["seq"]).alias("seq"), F.reverse(r["qual"]).alias("qual"))


def read_range(r: Column, lower: Column, upper: Column, reverse: Column | None = None) -> Column:
    from .sequence import sub_range as letters

    return F.struct(letters(r["seq"], lower, upper, reverse).alias("seq"), sub_range(r["qual"], lower, upper, reverse).alias("qual"))


def read_concat(a: Column, b: Column) -> Column:
    return F.struct(F.concat(a["seq"], b["seq"]).alias("seq"), F.concat(a["qual"], b["qual"]).alias("qual"))
