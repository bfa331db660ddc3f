"""Alphabets, wildcards and the genetic code."""

from __future__ import annotations

from itertools import product

#: Letters in code order. Nucleotides are ordered A < G < C < T, definite letters before wildcards.
NT_CODES = "AGCTNRYSWKMBDHV"
#: Amino acids in code order; `_` is an incomplete codon, X, B, J and Z are wildcards.
AA_CODES = "*ACDEFGHIKLMNPQRSTVWY_XBJZ"
AA_BASIC = AA_CODES[:22]

#: Fixed values (IUPAC): the definite letters that each nucleotide wildcard stands for.
NT_WILDCARDS = {"N": "ACGT", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG"}
#: The same for amino acids.
AA_WILDCARDS = {"X": AA_BASIC[:21], "B": "DN", "J": "IL", "Z": "EQ"}

#: Each nucleotide letter and its complement.
NT_COMPLEMENT = ("ACGTRYKMBVDHNSW", "TGCAYRMKVBHDNSW")

#: Fixed value: the standard genetic code, codons in T, C, A, G order.
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODON_ORDER = "TCAG"

ALPHABETS = {"nucleotide": NT_CODES, "aminoacid": AA_CODES}


def basic_letters(letter: str, alphabet: str = "nucleotide") -> str:
    wild = NT_WILDCARDS if alphabet == "nucleotide" else AA_WILDCARDS
    return wild.get(letter, letter)


def basic_mask(letter: str, alphabet: str = "nucleotide") -> int:
    """Bit set of the definite letters that a letter stands for, by code."""
    codes = ALPHABETS[alphabet]
    return sum(1 << codes.index(x) for x in basic_letters(letter, alphabet))


def matching_letters(letter: str, alphabet: str = "nucleotide") -> str:
    """All letters, wildcards too, whose definite letters are all among those of `letter`."""
    mask = basic_mask(letter, alphabet)
    return "".join(x for x in ALPHABETS[alphabet] if basic_mask(x, alphabet) & ~mask == 0)


def intersects(a: str, b: str, alphabet: str = "nucleotide") -> bool:
    return basic_mask(a, alphabet) & basic_mask(b, alphabet) != 0


def is_wildcard(letter: str, alphabet: str = "nucleotide") -> bool:
    return letter in (NT_WILDCARDS if alphabet == "nucleotide" else AA_WILDCARDS)


def codon_table() -> dict[str, str]:
    """Amino acid of each codon that has one: a wildcard codon counts if all codons it stands for agree. Others are X."""
    basic = {"".join(c): STANDARD_CODE[i] for i, c in enumerate(product(CODON_ORDER, repeat=3))}
    out = {}
    for codon in product(NT_CODES, repeat=3):
        found = {basic["".join(c)] for c in product(*map(basic_letters, codon))}
        if len(found) == 1:
            out["".join(codon)] = found.pop()
    return out


CODONS = codon_table()
