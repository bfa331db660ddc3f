"""Alignments as rows and as text: columns, elements, stacked views."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alignment import Alignment
from ..functions.mutations import decode

COLUMNS = "array<struct<pos1:int,pos2:int,kind:string,letter1:string,letter2:string>>"
SUMMARY = "struct<cigar:string,similarity:double,text:string>"


def _alignments(frame: pd.DataFrame, seq1: pd.Series) -> Iterator[Alignment | None]:
    for s, m, a, b, c, d in zip(seq1, frame["mutations"], frame["from1"], frame["to1"], frame["from2"], frame["to2"], strict=True):
        yield None if s is None or m is None else Alignment(s, decode(m), (int(a), int(b)), (int(c), int(d)), 0)


def alignment_columns(seq1: Column, alignment: Column) -> Column:
    """array of an alignment's columns, for explode: positions, kind (M, S, D or I) and letters (`-` for a gap)."""

    @F.pandas_udf(COLUMNS)
    def run(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.Series]:
        for s, frame in batches:
            out = []
            for al in _alignments(frame, s):
                if al is None:
                    out.append(None)
                    continue
                part, base = al.seq2_part(), al.range2[0]
                out.append([{"pos1": i, "pos2": j, "kind": k, "letter1": "-" if k == "I" else al.seq1[i], "letter2": "-" if k == "D" else part[j - base]} for i, j, k in al.columns()])
            yield pd.Series(out)

    return run(seq1, alignment)


def alignment_summary(seq1: Column, alignment: Column, width: int = 80) -> Column:
    """struct(cigar, similarity, text)."""

    @F.pandas_udf(SUMMARY)
    def run(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for s, frame in batches:
            rows = [(None, None, None) if al is None else (al.cigar(), al.similarity(), al.text(width)) for al in _alignments(frame, s)]
            yield pd.DataFrame(rows, columns=["cigar", "similarity", "text"])

    return run(seq1, alignment)


def stacked_view(df: DataFrame, subject: str, seq1: str, alignment: str, name: str) -> DataFrame:
    """subject, name, line: alignments to one subject in one grid, insertions padded in all others.

    The grid's columns are (position, place in the insertion before it): the widest insertion at each position over all rows is
    found by an aggregate, and each row's letters are laid out against it.
    """
    cells = df.select(subject, name, seq1, F.posexplode(alignment_columns(F.col(seq1), F.col(alignment))).alias("n", "c"))
    cells = cells.select(subject, name, seq1, "n", F.col("c.pos1").alias("pos"), F.col("c.kind").alias("kind"), F.col("c.letter2").alias("letter"))
    inserted = cells.filter("kind = 'I'").groupBy(subject, name, "pos").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "letter"))), lambda x: x["letter"]), "").alias("ins"))
    widths = inserted.groupBy(subject, "pos").agg(F.max(F.length("ins")).alias("width"))
    positions = df.select(subject, name, F.explode(F.sequence(F.lit(0), F.length(seq1))).alias("pos"))
    grid = positions.join(widths, [subject, "pos"], "left").join(inserted, [subject, name, "pos"], "left")
    letters = cells.filter("kind <> 'I'").select(subject, name, "pos", "letter")
    grid = grid.join(letters, [subject, name, "pos"], "left")
    filler = F.when(F.col("letter").isNotNull() | F.col("ins").isNotNull(), "-").otherwise(" ")
    cell = F.concat(F.concat(F.coalesce("ins", F.lit("")), F.repeat(filler, F.coalesce("width", F.lit(0)) - F.length(F.coalesce("ins", F.lit(""))))), F.coalesce("letter", F.lit(" ")))
    rows = grid.groupBy(subject, name).agg(F.sort_array(F.collect_list(F.struct("pos", cell.alias("cell")))).alias("cells"))
    return rows.select(subject, name, F.array_join(F.transform("cells", lambda x: x["cell"]), "").alias("line"))
