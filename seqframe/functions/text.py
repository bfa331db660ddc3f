"""Parsing and formatting helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PAIRS = {"(": ")", "[": "]", "{": "}"}


def split_outside_brackets(text: str, separator: str) -> list[str]:
    """Parts between separators that no bracket encloses; brackets that don't match are an error."""
    parts, closers = [""], []
    for c in text:
        if c in _PAIRS:
            closers.append(_PAIRS[c])
        elif c in _PAIRS.values() and (not closers or closers.pop() != c):
            raise ValueError(f"unbalanced {c} in {text!r}")
        if c == separator and not closers:
            parts.append("")
        else:
            parts[-1] += c
    if closers:
        raise ValueError(f"unclosed bracket in {text!r}")
    return parts


def split_outside_brackets_column(text: Column, separator: str) -> Column:
    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else split_outside_brackets(t, separator) for t in batch])

    return run(text)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.when(whole == 0, F.lit("0%")).otherwise(F.format_string(f"%.{digits}f%%", part * 100.0 / whole))


def byte_size(n: Column) -> Column:
    """With the largest of B, KiB, MiB, GiB, TiB that leaves a number of 1 at least."""
    out = F.format_string("%dB", n.cast("long"))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1 << 10 * i, F.format_string(f"%.1f{unit}", n / float(1 << 10 * i))).otherwise(out)
    return out


def duration(nanos: Column) -> Column:
    """With the largest of ns, us, ms, s, m, h that leaves a number of 1 at least."""
    out = F.format_string("%dns", nanos.cast("long"))
    for unit, size in (("us", 1e3), ("ms", 1e6), ("s", 1e9), ("m", 60e9), ("h", 3600e9)):
        out = F.when(nanos >= size, F.format_string(f"%.2f{unit}", nanos / size)).otherwise(out)
    return out


def read_text(seq: Column, qual: Column, width: int = 80) -> Column:
    """A read as lines of letters above lines of Phred+33 characters."""
    from .quality import encode

    pieces = F.sequence(F.lit(0), F.greatest(F.length(seq) - 1, F.lit(0)), F.lit(width))
    text = encode(qual)
    return F.array_join(F.transform(pieces, lambda i: F.concat_ws("\n", F.substring(seq, i + 1, F.lit(width)), F.substring(text, i + 1, F.lit(width)))), "\n\n")
