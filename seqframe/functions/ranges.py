"""Range algebra: struct(lower, upper, reversed), lower inclusive, upper exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "struct<lower:int,upper:int,reversed:boolean>"


def make(start: Column, end: Column) -> Column:
    """start > end makes a reversed range."""
    return F.struct(F.least(start, end).alias("lower"), F.greatest(start, end).alias("upper"), (start > end).alias("reversed"))


def of(lower: Column, upper: Column, reverse: Column | bool = False) -> Column:
    reverse = F.lit(reverse) if isinstance(reverse, bool) else reverse
    return F.struct(lower.cast("int").alias("lower"), upper.cast("int").alias("upper"), reverse.alias("reversed"))


def start(r: Column) -> Column:
    return F.when(r["reversed"], r["upper"]).otherwise(r["lower"])


def end(r: Column) -> Column:
    return F.when(r["reversed"], r["lower"]).otherwise(r["upper"])


def length(r: Column) -> Column:
    return r["upper"] - r["lower"]


def is_empty(r: Column) -> Column:
    return r["upper"] == r["lower"]


def reverse(r: Column) -> Column:
    return of(r["lower"], r["upper"], ~r["reversed"])


inverse = reverse


def move(r: Column, offset: Column) -> Column:
    return of(r["lower"] + offset, r["upper"] + offset, r["reversed"])


def expand(r: Column, left: Column, right: Column) -> Column:
    """In the range's own direction."""
    low, high = F.when(r["reversed"], right).otherwise(left), F.when(r["reversed"], left).otherwise(right)
    return of(r["lower"] - low, r["upper"] + high, r["reversed"])


def contains(r: Column, position: Column) -> Column:
    return (position >= r["lower"]) & (position < r["upper"])


def contains_boundary(r: Column, position: Column) -> Column:
    return (position >= r["lower"]) & (position <= r["upper"])


def contains_range(r: Column, other: Column) -> Column:
    return (other["lower"] >= r["lower"]) & (other["upper"] <= r["upper"])


def intersects(a: Column, b: Column) -> Column:
    """Empty ranges intersect nothing."""
    return ~is_empty(a) & ~is_empty(b) & (a["lower"] < b["upper"]) & (b["lower"] < a["upper"])


def intersects_or_touches(a: Column, b: Column) -> Column:
    return (a["lower"] <= b["upper"]) & (b["lower"] <= a["upper"])


def _both(a: Column, b: Column) -> Column:
    return a["reversed"] & b["reversed"]


def intersection(a: Column, b: Column) -> Column:
    """Null where they don't intersect; reversed if both are."""
    return F.when(intersects(a, b), of(F.greatest(a["lower"], b["lower"]), F.least(a["upper"], b["upper"]), _both(a, b)))


def intersection_with_touch(a: Column, b: Column) -> Column:
    return F.when(intersects_or_touches(a, b), of(F.greatest(a["lower"], b["lower"]), F.least(a["upper"], b["upper"]), _both(a, b)))


def try_merge(a: Column, b: Column) -> Column:
    """Null unless they intersect or touch."""
    return F.when(intersects_or_touches(a, b), of(F.least(a["lower"], b["lower"]), F.greatest(a["upper"], b["upper"]), _both(a, b)))


def without(a: Column, b: Column) -> Column:
    """0 to 2 pieces of a outside b, in a's direction."""
    left = of(a["lower"], F.least(a["upper"], b["lower"]), a["reversed"])
    right = of(F.greatest(a["lower"], b["upper"]), a["upper"], a["reversed"])
    pieces = F.filter(F.array(left, right), lambda p: p["upper"] > p["lower"])
    return F.when(intersects(a, b), pieces).otherwise(F.array(a))


def _checked(ok: Column, value: Column) -> Column:
    return F.when(ok, value).when(ok.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("position outside the range")))


def to_relative(r: Column, position: Column) -> Column:
    return _checked(contains(r, position), F.when(r["reversed"], r["upper"] - 1 - position).otherwise(position - r["lower"]))


def to_absolute(r: Column, relative: Column) -> Column:
    position = F.when(r["reversed"], r["upper"] - 1 - relative).otherwise(r["lower"] + relative)
    return _checked(contains(r, position), position)


def boundary_to_relative(r: Column, boundary: Column) -> Column:
    return _checked(contains_boundary(r, boundary), F.when(r["reversed"], r["upper"] - boundary).otherwise(boundary - r["lower"]))


def boundary_to_absolute(r: Column, relative: Column) -> Column:
    boundary = F.when(r["reversed"], r["upper"] - relative).otherwise(r["lower"] + relative)
    return _checked(contains_boundary(r, boundary), boundary)


def relative_range(r: Column, other: Column) -> Column:
    """`other`, which lies in r, by r's own coordinates."""
    return make(boundary_to_relative(r, start(other)), boundary_to_relative(r, end(other)))


def absolute_range(r: Column, relative: Column) -> Column:
    return make(boundary_to_absolute(r, start(relative)), boundary_to_absolute(r, end(relative)))


def order_keys(r: Column) -> list[Column]:
    return [r["lower"], r["upper"], r["reversed"]]
