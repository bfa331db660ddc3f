"""Random mutations of sequences by models: test data with known answers."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .mutations import Mutation, encode


def uniform_substitutions(p: float, letters: str = "AGCT") -> dict[str, dict[str, float]]:
    return {a: {b: p / (len(letters) - 1) for b in letters if b != a} for a in letters}


@dataclass(frozen=True)
class MutationModel:
    """Chances by letter: of each substitution, of deletion, and of an insertion before it."""

    substitutions: dict[str, dict[str, float]] = field(default_factory=lambda: uniform_substitutions(0.01))
    deletion: float = 0.001
    insertion: float = 0.001

    def scaled(self, factor: float) -> MutationModel:
        return MutationModel({a: {b: p * factor for b, p in to.items()} for a, to in self.substitutions.items()}, self.deletion * factor, self.insertion * factor)

    def __post_init__(self):
        if any(sum(to.values()) + self.deletion > 1 for to in self.substitutions.values()) or not 0 <= self.insertion <= 1:
            raise ValueError("chances of a letter add up to more than 1")


def generate(seq: str, model: MutationModel, seed: int) -> list[Mutation]:
    """Mutations in order; an insertion never stands beside a deletion."""
    rng, out, letters = random.Random(seed), [], list(model.substitutions)
    for i, c in enumerate(seq):
        if rng.random() < model.insertion and not (out and out[-1].kind == "D" and out[-1].position == i - 1):
            out.append(Mutation("I", i, None, rng.choice(letters)))
        x = rng.random()
        if x < model.deletion:
            if not (out and out[-1].kind == "I" and out[-1].position == i):
                out.append(Mutation("D", i, c, None))
            continue
        x -= model.deletion
        for to, p in model.substitutions.get(c, {}).items():
            if x < p:
                out.append(Mutation("S", i, c, to))
                break
            x -= p
    return out


def uniform_mutations(seq: str, count: int, seed: int, kinds: str = "SDI") -> list[Mutation]:
    """`count` mutations at different places, of kinds taken evenly."""
    rng = random.Random(seed)
    places = sorted(rng.sample(range(len(seq)), min(count, len(seq))))
    out: list[Mutation] = []
    for at in places:
        kind, c = rng.choice(kinds), seq[at]
        to = rng.choice([x for x in "AGCT" if x != c or kind == "I"])
        if kind == "I" and out and out[-1].kind == "D" and out[-1].position == at - 1:
            kind, to = "S", rng.choice([x for x in "AGCT" if x != c])
        out.append(Mutation(kind, at, c if kind != "I" else None, to if kind != "D" else None))
    return out


def generate_column(seq: Column, seed: Column, model: MutationModel) -> Column:
    """Encoded mutations by a seed column, the same wherever the row is."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for s, k in batches:
            yield pd.Series([None if x is None or pd.isna(n) else encode(generate(x, model, int(n))) for x, n in zip(s, k, strict=True)], dtype=object)

    return run(seq, seed)
