"""Golden values and algebraic laws of the sequential kernels."""

import random

import numpy as np
import pytest

from seqframe.functions import alignment as al
from seqframe.functions import merging as mg
from seqframe.functions import motif as mo
from seqframe.functions import mutations as mu
from seqframe.functions import trimming as tr

P = tr.TrimParameters(7.0, 6)


def q(text):
    return np.array([ord(c) - 48 for c in text], dtype=np.int64)


Q0 = "0123456789999999999876543210"


@pytest.mark.parametrize(
    "text, left, right, step, rise, expected",
    [
        (Q0, 0, 28, 1, True, 6),
        (Q0, 0, 28, -1, True, 21),
        (Q0, 0, 28, 1, False, -1),
        (Q0, 0, 28, -1, False, 28),
        ("0" * 28, 0, 28, 1, True, -29),
        ("0" * 28, 0, 28, -1, True, -2),
        ("0" * 28, 0, 28, 1, False, -1),
        ("0" * 28, 0, 28, -1, False, 28),
        (Q0, 14, 28, 1, True, 13),
        (Q0, 14, 28, -1, True, 21),
        (Q0, 14, 28, 1, False, 20),
        (Q0, 14, 28, -1, False, 28),
        (Q0, 2, 28, 1, False, 1),
        ("499999999941", 0, 12, 1, True, 0),
        ("4999999999429", 0, 13, 1, True, 0),
        ("9", 0, 1, 1, True, -1),
        ("9", 0, 1, -1, True, 1),
        ("9", 0, 1, 1, False, -2),
        ("9", 0, 1, -1, False, -2),
        ("0", 0, 1, 1, True, -2),
        ("0", 0, 1, -1, True, -2),
        ("0", 0, 1, 1, False, -1),
        ("0", 0, 1, -1, False, 1),
        ("", 0, 0, 1, True, -1),
        ("", 0, 0, -1, True, 0),
    ],
)
def test_scan(text, left, right, step, rise, expected):
    assert tr.scan(q(text), left, right, step, rise, P) == expected


def test_scan_ends_of_good_regions():
    assert tr.absolute(tr.scan(q("499999999941"), 4, 12, 1, False, P)) == 9
    assert tr.absolute(tr.scan(q("4999999999429"), 4, 13, 1, False, P)) == 12


@pytest.mark.parametrize("start, end", [((10, 15), (7, 21)), ((7, 21), (7, 21)), ((6, 21), (6, 21)), ((5, 21), (5, 21)), ((5, 22), (5, 22)), ((5, 23), (5, 23))])
def test_extend(start, end):
    assert tr.extend_range(q(Q0), P, *start) == end


def test_extend_small():
    assert tr.extend_range(q(""), P, 0, 0) == (0, 0)
    assert tr.extend_range(q("1"), P, 0, 0) == (0, 0)
    assert tr.extend_range(q("9"), P, 0, 0) == (0, 1)


def test_trim_and_islands():
    assert tr.trim(q(Q0), P) == (7, 21)
    assert tr.trim(q("0" * 20), P) is None
    two = q("0000999999900000099999999990000")
    found = tr.islands(two, P)
    assert len(found) == 2 and tr.best_island(two, P) == found[1]
    assert tr.best_island(q("000"), P) is None


R = "CGCACAGTGTTGTCAAAGAAAACGCGTACGACATTGAGAAGACCGGCCGTTCTCCTTTGACATGATTGGATCGGTTGCTGCCGGCCCAGAATCCTAGCAG"


def _merge(a, b, mismatches, policy="SumSubtraction"):
    # mate 1 has quality 32, mate 2 has quality 33; sums are under the cap of 60
    from_overlap = 10
    p = mg.MergeParameters(from_overlap, 1.0 - mismatches / from_overlap if mismatches else 1.0, policy, "Collinear", "Unweighted", 60)
    one, two = mg.codes_of(a), mg.codes_of(b)
    return mg.merge(one, np.full(len(a), 32), two, np.full(len(b), 33), p)


@pytest.mark.parametrize("a, b", [(R[:48], R[28:]), (R, R[10:51]), (R[:72], R[50:])])
def test_merge_exact(a, b):
    m = _merge(a, b, 0)
    assert m.seq == R and m.errors == 0
    start = m.offset
    assert set(m.qual[max(start, 0) : max(start, 0) + m.overlap]) == {60}


@pytest.mark.parametrize("policy, same, other, letter", [("SumMax", 60, 33, "T"), ("SumSubtraction", 60, 1, "T"), ("MaxSubtraction", 33, 1, "T"), ("MaxMax", 33, 33, "T")])
def test_merge_policies(policy, same, other, letter):
    a, b = R[:50] + "A" + R[51:72], R[50:]
    m = _merge(a, b, 1, policy)
    assert m.seq == R[:50] + letter + R[51:]
    assert m.qual[50] == other and set(m.qual[51:72]) == {same} and m.errors == 1
    assert _merge(a, b, 0, policy) is None


def test_merge_opposite_strand():
    rc = R[28:][::-1].translate(str.maketrans("ACGT", "TGCA"))
    m = mg.merge(mg.codes_of(R[:48]), np.full(48, 30), mg.codes_of(rc), np.full(len(rc), 30), mg.MergeParameters(10, 0.9, "MaxMax", "Opposite"))
    assert m.seq == R and m.reversed
    assert mg.merge(mg.codes_of("ACG"), np.full(3, 30), mg.codes_of("ACG"), np.full(3, 30), mg.MergeParameters()) is None


def test_merge_takes_the_best_overlap():
    """13 letters with one error agree by chance, and are met before the overlap of 16."""
    a, b = "CCAGGGTGAAGGATGAAAGATATTTCATAGTC", "TCTTGAGTCAGCGTCTCCCCCTGGGTGAAGGA"
    mate = (a[24:] + b)[::-1].translate(str.maketrans("ACGT", "TGCA"))
    m = mg.merge(mg.codes_of(a + b[:8]), np.full(40, 30), mg.codes_of(mate), np.full(40, 30), mg.MergeParameters(12, 0.9))
    assert (m.seq, m.offset, m.overlap, m.errors, m.score) == (a + b, 24, 16, 0, 32)


def _edited(rng, s, n):
    out = list(s)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("ACGT")
        elif kind == 1 and len(out) > 2:
            del out[at]
        else:
            out.insert(at, rng.choice("ACGT"))
    return "".join(out)


def _pairs(n=150, seed=5):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = "".join(rng.choice("ACGT") for _ in range(rng.randrange(3, 40)))
        out.append((a, _edited(rng, a, rng.randrange(0, 8))))
    return out


def _oracle_score(a, b, s):
    """Plain three-state recurrence."""
    c = al.ALPHABETS[s.alphabet].index
    m, d, n = ({(0, 0): 0}, {}, {})
    low = -(10**6)
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i:
                d[i, j] = max(max(m.get((i - 1, j), low), n.get((i - 1, j), low)) + s.open, d.get((i - 1, j), low) + s.extend)
            if j:
                n[i, j] = max(max(m.get((i, j - 1), low), d.get((i, j - 1), low)) + s.open, n.get((i, j - 1), low) + s.extend)
            if i and j:
                m[i, j] = max(x.get((i - 1, j - 1), low) for x in (m, d, n)) + int(s.matrix[c(a[i - 1]), c(b[j - 1])])
    return max(x.get((len(a), len(b)), low) for x in (m, d, n))


@pytest.mark.parametrize("scoring", [al.LinearScoring.nucleotide(), al.AffineScoring.nucleotide()])
def test_global_laws(scoring):
    pairs = _pairs()
    for (a, b), r in zip(pairs, al.align(pairs, scoring), strict=True):
        assert mu.mutate(a, r.mutations) == b
        assert r.score == r.rescored(scoring) == _oracle_score(a, b, scoring)
        back = mu.invert(r.mutations)
        assert mu.mutate(b, back) == a
        assert mu.mutate(a, mu.combine(r.mutations, back)) == a
        assert mu.is_sorted(r.mutations) and mu.is_compatible(a, r.mutations)
        assert mu.decode(mu.encode(r.mutations)) == r.mutations
        assert [mu.unpack(mu.pack(m)) for m in r.mutations] == r.mutations


def test_combine_law():
    rng = random.Random(9)
    for a, b in _pairs(100, 8):
        c = _edited(rng, b, 5)
        ab, bc = (r.mutations for r in al.align([(a, b), (b, c)], al.LinearScoring.nucleotide()))
        assert mu.mutate(a, mu.combine(ab, bc)) == c


@pytest.mark.parametrize("scoring", [al.LinearScoring.nucleotide(), al.AffineScoring.nucleotide()])
def test_band_reaches_global_score_when_wide(scoring):
    pairs = _pairs(60, 3)
    for w, g, (a, b) in zip(al.align(pairs, scoring, band=40), al.align(pairs, scoring), pairs, strict=True):
        assert w.score == g.score and mu.mutate(a, w.mutations) == b
    for n, (a, b) in zip(al.align(pairs, scoring, band=1), pairs, strict=True):
        assert mu.mutate(a, n.mutations) == b and n.score == n.rescored(scoring)


@pytest.mark.parametrize("scoring", [al.LinearScoring.nucleotide(), al.AffineScoring.nucleotide(), al.AffineScoring.nucleotide(open_=-3)])
@pytest.mark.parametrize("band", [0, 1, 4, 30])
@pytest.mark.parametrize("mode, ends", [("global", al.ALL), ("local", al.ALL), ("left", al.ALL), ("left", al.Ends(stop_penalty=-12)), ("added_right", al.ALL), ("added_right", al.Ends(added1=3, added2=2))])
def test_diagonals_hold_what_the_whole_matrix_does(scoring, band, mode, ends):
    pairs = [*_pairs(40, 5), ("", ""), ("", "ACG"), ("ACG", ""), ("A", "A"), ("AAAAAAA", "A"), ("ACACACAC", "CACACACA")]
    assert al._banded_batch(pairs, scoring, mode, band, None, ends) == al._batch(pairs, scoring, mode, band, None, ends)


def test_band_over_30000_letters():
    """A pair whose whole matrix would have 900 million cells."""
    rng = random.Random(4)
    a = "".join(rng.choice("ACGT") for _ in range(30_000))
    b = a[:9_000] + "GATTA" + a[9_000:20_000] + a[20_004:]
    gaps = {"I": 5, "D": 4}
    for scoring, cost in ((al.LinearScoring.nucleotide(), -5 * 9), (al.AffineScoring.nucleotide(), -10 - 4 - 10 - 3)):
        (r,) = al.align([(a, b)], scoring, band=12)
        kinds = [m.kind for m in r.mutations]
        assert r.score == 5 * (30_000 - 4) + cost and {k: kinds.count(k) for k in set(kinds)} == gaps and mu.mutate(a, r.mutations) == b


def test_global_golden():
    lin, aff = al.LinearScoring.nucleotide(), al.AffineScoring.nucleotide()
    assert al.align([("ATTAGACA", "ATTAAGA")], lin)[0].score == 21
    v = al.align([("TAGAATTAGACA", "ATTAGTAA")], lin)[0]
    assert [mu.to_seq2(v.mutations, i) for i in range(12)] == [-1, -1, -1, -1, 0, 1, 2, 3, 4, 6, -8, 7]
    e = al.align([("GAAGGAAAGCCCCAATTG", "CGTGGAGATTATGTTAGA")], lin)[0]
    assert len(mu.in_range_relative(e.mutations, 17, 18)) == 1
    for a, b, at, s in [
        ("TCCCAGTTATGTCAGGGGACACGAGCATGCAGAGAC", "AATTGCCGCCGTCGTTTTCAGCAGTATGTCAGATC", 3, aff),
        ("CGTCCCGGG", "TCCC", 2, aff),
        ("GGCGCCAG", "CA", 5, aff),
        ("GGCGCCAG", "CA", 5, lin),
        ("TCCCAGTTATGTCAGGGGACACGAGCATGCAGAGAC", "AATTGCCGCCGTCGTTTTCAGCAGTATGTCAGATC", 0, lin),
    ]:
        assert al.align([(a, b)], s, "local")[0].range1[0] == at
    assert al.align([("GGG", "CCC")], aff, "local")[0] is None


def test_local_laws():
    s = al.AffineScoring.nucleotide()
    for (a, b), r in zip(_pairs(80, 4), al.align(_pairs(80, 4), s, "local"), strict=True):
        if r:
            assert r.seq2_part() == b[slice(*r.range2)] and r.score == r.rescored(s) > 0
            assert r.trimmed(s).score == r.score


def test_positions_and_views():
    r = al.align([("ACGTACGT", "ACGTTACT")], al.LinearScoring.nucleotide())[0]
    for i in range(8):
        p = r.to_seq2(i)
        if p >= 0:
            assert r.to_seq1(p) == i
    assert r.text().count("\n") == 2
    m = al.Alignment("ACGTA", mu.decode("I2CDG2"), (0, 5), (0, 5), 0)
    assert m.cigar() == "2M1I1D2M"
    assert mu.encode(mu.shift_indels_left("AAACC", mu.decode("DA2"))) == "DA0"
    assert al.align([("ACGTTT", "ACGAAA")], al.LinearScoring.nucleotide(), "left")[0].range1 == (0, 3)
    assert al.align([("TTTACG", "AAAACG")], al.LinearScoring.nucleotide(), "right")[0].range1 == (3, 6)


def test_translated_mutations():
    assert mu.to_amino("ATTAGACAT", mu.decode("SA3C")) == []  # AGA and CGA both are R
    assert mu.encode(mu.to_amino("ATTAAACAT", mu.decode("SA4C"))) == "SK1T"
    assert mu.to_amino("ATT" * 10, mu.decode("DA0")) is None


def test_btop():
    assert mu.encode(mu.decode_btop("2-A3T-GC")) == "DA2I6TSC6G"


def test_indel_search():
    m = mo.Motif.of("ACGT")
    assert mo.indel_hits_last("TTACGTTT", m, 0) == [(5, 0)]
    assert (5, 0) in mo.indel_hits_last("TTACGTTT", m, 1) and mo.filtered(mo.indel_hits_last("TTACGTTT", m, 1)) == [(5, 0)]
    assert mo.indel_hits_first("TTACGTTT", m, 0) == [(2, 0)]
    assert mo.Motif.of("N").allows("R", 0) and not mo.Motif.of("R").allows("N", 0)
    assert (mo.Motif.of("A") | mo.Motif.of("C")).matches("C", 0)


@pytest.mark.parametrize("scoring", [al.LinearScoring.nucleotide(), al.AffineScoring.nucleotide()])
def test_ends_against_global_scores(scoring):
    pairs = _pairs(40, 6)
    added = al.Ends(added1=4, added2=3)
    for (a, b), r, back in zip(pairs, al.align(pairs, scoring, "added_right", ends=added), al.align([(x[::-1], y[::-1]) for x, y in pairs], scoring, "added_left", ends=added), strict=True):
        cells = [(len(a) - k, len(b)) for k in range(4, -1, -1)] + [(len(a), len(b) - k) for k in range(3, -1, -1)]
        cells = [(i, j) for i, j in cells if i >= 0 and j >= 0]
        scores = [_oracle_score(a[:i], b[:j], scoring) for i, j in cells]
        assert r.score == max(scores) and (r.range1[1], r.range2[1]) == cells[scores.index(max(scores))]
        assert mu.mutate(a[: r.range1[1]], r.mutations) == b[: r.range2[1]] and back.score == r.score


def test_free_edges_and_stop():
    s = al.LinearScoring.nucleotide()
    free = al.align([("TTTACGT", "ACGT")], s, "left", ends=al.Ends(bound1=False))[0]
    assert (free.range1, free.range2, free.score) == ((3, 7), (0, 4), 20)
    a, b = "ACGTACGT" + "T" * 10 + "ACGTACGTACGT", "ACGTACGT" + "G" * 10 + "ACGTACGTACGT"
    assert al.align([(a, b)], s, "left")[0].range1 == (0, 30)
    assert al.align([(a, b)], s, "left", ends=al.Ends(stop_penalty=-40))[0].range1 == (0, 8)


def test_trimming_of_batches_equals_scans_one_by_one():
    rng = np.random.default_rng(5)
    for _ in range(150):
        p = tr.TrimParameters(float(rng.integers(3, 14)), int(rng.integers(1, 7)))
        quals = [np.repeat(rng.integers(0, 16, 30), rng.integers(1, 6))[: rng.integers(0, 40)] for _ in range(5)]
        batch = tr.Reads(quals, p)
        pieces = [[] for _ in quals]
        for row, lower, upper in zip(*(x.tolist() for x in batch.islands()), strict=True):
            pieces[row].append((lower, upper))
        best, cut = ({r: (a, b) for r, a, b in zip(*(x.tolist() for x in f()), strict=True)} for f in (batch.best, batch.trimmed))
        for i, q in enumerate(quals):
            assert pieces[i] == tr.islands(q, p)
            assert best.get(i) == tr.best_island(q, p)
            assert cut.get(i) == (tr.trim(q, p) if len(q) else None)
            for lower, upper in pieces[i]:  # every window of an island's middle is good, and so are its ends
                assert upper - lower >= p.window and q[lower:upper].mean() >= p.average_quality - 1 / p.window
