"""Alignment through an installed BLAST+: one process a batch of queries, tabular output with BTOP.

The programs are optional: without them only running is an error.
"""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.mutations import decode_btop, encode

SCHEMA = "query_id long, subject string, score int, bit_score double, e_value double, identity double, mutations string, query_from int, query_to int, subject_from int, subject_to int, subject_strand string"
FIELDS = "qseqid sseqid score bitscore evalue pident qstart qend sstart send btop"


@dataclass(frozen=True)
class BlastParameters:
    program: str = "blastn"
    database: str | None = None  # a database that all executors can open
    word_size: int | None = None
    e_value: float = 10.0
    max_targets: int = 500
    extra: tuple[str, ...] = ()

    def command(self) -> list[str]:
        if shutil.which(self.program) is None:
            raise RuntimeError(f"{self.program} isn't installed")
        out = [self.program, "-db", str(self.database), "-evalue", repr(self.e_value), "-max_target_seqs", str(self.max_targets), "-outfmt", f"7 {FIELDS}"]
        return out + (["-word_size", str(self.word_size)] if self.word_size else []) + list(self.extra)


def parse_tabular(text: str) -> list[tuple]:
    """Rows of the schema from outfmt 7; positions become 0-based and half-open, subjects on the minus strand run backwards in BLAST's columns."""
    rows = []
    for line in text.splitlines():
        if not line or line.startswith("#"):
            continue
        q, subject, score, bits, e, identity, qa, qb, sa, sb, btop = line.split("\t")
        minus = int(sa) > int(sb)
        low, high = (int(sb), int(sa)) if minus else (int(sa), int(sb))
        rows.append((int(q), subject, int(float(score)), float(bits), float(e), float(identity), encode(decode_btop(btop)), int(qa) - 1, int(qb), low - 1, high, "minus" if minus else "plus"))
    return rows


def blast(queries: DataFrame, p: BlastParameters) -> DataFrame:
    """Hits of queries (query_id, seq)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        command = p.command()
        for batch in batches:
            fasta = "".join(f">{q}\n{s}\n" for q, s in zip(batch["query_id"], batch["seq"], strict=True) if s)
            done = subprocess.run(command, input=fasta, capture_output=True, text=True, check=True)
            yield pd.DataFrame(parse_tabular(done.stdout), columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return queries.select("query_id", "seq").mapInPandas(run, SCHEMA)


def fetch(database: str, names: DataFrame, program: str = "blastdbcmd") -> DataFrame:
    """name, seq of entries of a database."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if shutil.which(program) is None:
            raise RuntimeError(f"{program} isn't installed")
        for batch in batches:
            with tempfile.NamedTemporaryFile("w", suffix=".txt") as f:
                f.write("\n".join(batch["name"]))
                f.flush()
                done = subprocess.run([program, "-db", database, "-entry_batch", f.name, "-outfmt", "%a\t%s"], capture_output=True, text=True, check=True)
            yield pd.DataFrame([x.split("\t") for x in done.stdout.splitlines()], columns=["name", "seq"])

    return names.select("name").mapInPandas(run, "name string, seq string")
