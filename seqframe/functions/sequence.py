"""Scalar functions on sequences: columns in, columns out, all of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import ALPHABETS, CODONS, NT_COMPLEMENT

FROM_LEFT, FROM_RIGHT, FROM_CENTER = "left", "right", "center"


def _letters(codes: str) -> str:
    return "".join("\\" + c if c in "*_" else c for c in codes)


def parse(s: Column, alphabet: str = "nucleotide") -> Column:
    """Upper case; an error for letters of no meaning in the alphabet."""
    up = F.upper(s)
    return F.when(s.isNull() | belongs_to(s, alphabet), up).otherwise(F.raise_error(F.concat(F.lit(f"not a {alphabet} sequence: "), s)))


def belongs_to(s: Column, alphabet: str = "nucleotide") -> Column:
    return F.upper(s).rlike(f"^[{_letters(ALPHABETS[alphabet])}]*$")


def possible_alphabets(s: Column) -> Column:
    names = [F.when(belongs_to(s, a), F.lit(a)) for a in ALPHABETS]
    return F.array_compact(F.array(*names))


def reverse_complement(s: Column) -> Column:
    """By IUPAC: wildcards too."""
    return F.reverse(F.translate(s, *NT_COMPLEMENT))


def canonical(s: Column) -> Column:
    return F.least(s, reverse_complement(s))


def sub_range(s: Column, lower: Column, upper: Column, reverse: Column | None = None) -> Column:
    """[lower, upper); reversed ranges read the other strand."""
    part = F.substring(s, lower + 1, upper - lower)
    return part if reverse is None else F.when(reverse, reverse_complement(part)).otherwise(part)


def index_of(s: Column, needle: Column) -> Column:
    """First position, -1 if there is none; an empty needle is nowhere."""
    return F.when(F.length(needle) == 0, F.lit(-1)).otherwise(F.position(needle, s) - 1)


def letter_at(s: Column, position: Column) -> Column:
    return F.substring(s, position + 1, F.lit(1))


def code_at(s: Column, position: Column, alphabet: str = "nucleotide") -> Column:
    return F.position(letter_at(s, position), F.lit(ALPHABETS[alphabet])) - 1


def contains_wildcards(s: Column) -> Column:
    return s.rlike("[^ACGT]")


def mismatch_count(a: Column, b: Column, from_a: Column | None = None, from_b: Column | None = None, length: Column | None = None) -> Column:
    """Hamming distance of two stretches; an error where a stretch leaves its sequence."""
    zero = F.lit(0)
    from_a, from_b = zero if from_a is None else from_a, zero if from_b is None else from_b
    length = F.greatest(F.length(a), F.length(b)) if length is None else length
    inside = (from_a >= 0) & (from_b >= 0) & (from_a + length <= F.length(a)) & (from_b + length <= F.length(b))
    letters = lambda s, at: F.split(F.substring(s, at + 1, length), "")
    differ = F.size(F.filter(F.zip_with(letters(a, from_a), letters(b, from_b), lambda x, y: x != y), lambda d: d))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(length == 0, 0).when(inside, differ).otherwise(F.raise_error(F.lit("out of the sequence")))


def longest_homopolymer(s: Column) -> Column:
    """Range of the first of the longest runs of one letter: struct(lower, upper); null for an empty sequence."""
    runs = F.regexp_extract_all(s, F.lit(r"((.)\2*)"), F.lit(1))
    best = F.array_max(F.transform(runs, lambda r: F.length(r)))
    before = F.aggregate(
        runs,
        F.struct(F.lit(0).alias("at"), F.lit(-1).alias("found")),
        lambda a, r: F.struct(
            (a["at"] + F.length(r)).alias("at"),
            F.when((a["found"] < 0) & (F.length(r) == best), a["at"]).otherwise(a["found"]).alias("found"),
        ),
        lambda a: a["found"],
    )
    return F.when(F.length(s) > 0, F.struct(before.alias("lower"), (before + best).alias("upper")))


def order_keys(s: Column, alphabet: str = "nucleotide") -> list[Column]:
    """Sequences are ordered by length, then by codes."""
    codes = ALPHABETS[alphabet]
    return [F.length(s), F.translate(s, codes, "".join(chr(ord("a") + i) for i in range(len(codes))))]


def range_key(s: Column, lower: int, upper: int) -> Column:
    """Key of a stretch: empty where the sequence is too short for it."""
    return F.when(F.length(s) < upper, F.lit("")).otherwise(F.substring(s, lower + 1, upper - lower))


def kmers(s: Column, k: int) -> Column:
    return F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def gc_count(s: Column) -> Column:
    return F.length(s) - F.length(F.translate(s, "GCS", ""))


def contains_stops(aa: Column) -> Column:
    return F.contains(aa, F.lit("*"))


def count_stops(aa: Column) -> Column:
    return F.length(aa) - F.length(F.translate(aa, "*", ""))


def two_bit(s: Column) -> Column:
    """Two bits a letter by code, as a string of binary digits; an error for wildcards."""
    digits = F.transform(F.split(s, ""), lambda x: F.element_at(F.array(*map(F.lit, ("00", "01", "10", "11"))), F.position(x, F.lit("AGCT"))))
    return F.when(F.length(s) == 0, "").when(contains_wildcards(s), F.raise_error(F.lit("wildcards have no two-bit code"))).otherwise(F.array_join(digits, ""))


def from_two_bit(bits: Column) -> Column:
    at = F.sequence(F.lit(0), (F.length(bits) / 2).cast("int") - 1)
    letters = F.transform(at, lambda i: F.substring(F.lit("AGCT"), F.conv(F.substring(bits, i * 2 + 1, F.lit(2)), 2, 10).cast("int") + 1, F.lit(1)))
    return F.when(F.length(bits) == 0, "").otherwise(F.array_join(letters, ""))


# --- translation -------------------------------------------------------------------------------------------------


def _codon_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(CODONS.items()) for x in pair])


def codon_to_aa(codon: Column) -> Column:
    return F.coalesce(F.try_element_at(_codon_map(), codon), F.lit("X"))


def _in_frame(s: Column, start: Column, codons: Column) -> Column:
    table = _codon_map()
    letters = F.transform(F.sequence(F.lit(0), codons - 1), lambda i: F.coalesce(F.try_element_at(table, F.substring(s, start + i * 3 + 1, F.lit(3))), F.lit("X")))
    return F.when(codons > 0, F.array_join(letters, "")).otherwise("")


def _third(n: Column) -> Column:
    return F.floor(n / 3).cast("int")


def translate(s: Column, mode: str | None = None, frame: int = 0, incomplete: bool = True) -> Column:
    """Amino acids by the standard code.

    mode None: whole codons from `frame` on.  left: from the left with `frame` letters before the first codon.
    right: codons end at the right end.  center: codons run in from both ends, and the incomplete one is in the middle.
    incomplete: incomplete codons are shown as `_`.
    """
    n = F.length(s)
    if mode is None:
        return _in_frame(s, F.lit(frame), _third(n - frame))
    if mode == FROM_CENTER:
        whole = _third(n)
        left = F.floor((whole + 1) / 2).cast("int")
        right = whole - left
        middle = F.when(F.pmod(n, F.lit(3)) != 0, F.lit("_")).otherwise("") if incomplete else F.lit("")
        return F.concat(_in_frame(s, F.lit(0), left), middle, _in_frame(s, n - right * 3, right))
    first = F.lit(frame) if mode == FROM_LEFT else F.pmod(n, F.lit(3))
    whole = _third(n - first)
    body = _in_frame(s, first, whole)
    if not incomplete:
        return body
    head = F.when(first != 0, "_").otherwise("")
    tail = F.when(n - first - whole * 3 != 0, "_").otherwise("")
    return F.concat(head, body, tail)


def nt_to_aa_position(position: Column, n: Column, mode: str, frame: int = 0, incomplete: bool = True) -> Column:
    """struct(aa, in_codon) of a nucleotide position in a sequence of n letters translated this way; null outside."""

    def from_left(first: Column, shown: bool) -> Column:
        at = position - first + (F.when(first != 0, 3).otherwise(0) if shown else 0)
        ok = at >= 0 if shown else (at >= 0) & (_third(at) < _third(n))
        return F.when(ok, F.struct(_third(at).alias("aa"), F.pmod(at, F.lit(3)).alias("in_codon")))

    if mode == FROM_CENTER:
        whole = _third(n)
        border = n - (whole - F.floor((whole + 1) / 2).cast("int")) * 3
        return F.when(position < border, from_left(F.lit(0), True)).otherwise(from_left(F.pmod(n, F.lit(3)), True))
    return from_left(F.lit(frame) if mode == FROM_LEFT else F.pmod(n, F.lit(3)), incomplete)


def aa_to_nt_position(aa: Column, n: Column, mode: str, frame: int = 0, incomplete: bool = True) -> Column:
    """First nucleotide of an amino acid."""
    if mode == FROM_CENTER:
        whole = _third(n)
        border = n - (whole - F.floor((whole + 1) / 2).cast("int")) * 3
        left = _third(border + 2)
        return F.when(aa < left, aa * 3).otherwise(border + (aa - left) * 3)
    first = F.lit(frame) if mode == FROM_LEFT else F.pmod(n, F.lit(3))
    if not incomplete:
        return first + aa * 3
    return F.when(aa == 0, 0).otherwise(first + (aa - F.when(first != 0, 1).otherwise(0)) * 3)

