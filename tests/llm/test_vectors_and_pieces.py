"""Whitening, Lloyd clustering and piece coding against plain NumPy, whole-number Python and the installed library."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from seqframe.llm import lloyd, piece_coding, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, x string, v string, cluster int, i int, c0 double, n long"


def make(spark, rows, parts=5):
    """rows of (vec_id, embedding), with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, v, 1, "x", "v", 7, 3, 0.5, 2) for i, v in rows], SCHEMA).repartition(parts)


def vectors(n, dims, seed=1, spread=True):
    """Gaussian vectors, some rows repeated, and every kind of row that is left out."""
    rng = np.random.default_rng(seed)
    scales = np.linspace(1, 3, dims) if spread else np.ones(dims)
    rows = [(i, (rng.standard_normal(dims) * scales).tolist()) for i in range(n)]
    rows += [(3, rows[3][1]), (n, rows[5][1]), (None, rows[6][1])]
    for k, odd in enumerate([math.nan, math.inf, -math.inf, None]):
        rows.append((n + 10 + k, [odd, *rows[0][1][1:]]))
    return rows + [(n + 20, None), (n + 21, []), (n + 22, rows[0][1][:-1]), (n + 23, [*rows[0][1], 1.0])]


def plain(rows, dims, scale=1024):
    return [(i, [math.floor(c * scale) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]


# ---- whitening


def moments(x):
    """n, sums and the covariance, divisor n, in whole fractions before the last division."""
    n, dims = len(x), len(x[0])
    s = [sum(v[d] for v in x) for d in range(dims)]
    c = np.array([[float(v[d] * n - s[d]) / n for d in range(dims)] for v in x])
    return n, s, c, c.T @ c / n


@pytest.mark.parametrize("dims, shift", [(12, 100_000), (5, -7)])
def test_whitening(spark, dims, shift):
    rows = vectors(150, dims)
    kept = [(i, [c + shift for c in v]) for i, v in plain(rows, dims)]
    got = whitening.whiten(make(spark, rows), shift=shift, dims=dims).collect()
    n, s, c, cov = moments([v for _, v in kept])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    wide = min(8, dims)
    assert len(got) == n * wide and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, wide + 1))
    want = c @ u[:, :wide] / np.sqrt(e[:wide])
    deviation = [sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for _, v in kept]
    for k in range(wide):
        mine = [r for r in got if r.component == k + 1]
        key = lambda t: (t[0] is None, t[0] or 0, t[1], t[2])
        found = sorted(((r.vec_id, int(r.deviation), r.whitened) for r in mine), key=key)
        for sign in (1, -1):
            hoped = sorted(((i, d, w) for (i, _), d, w in zip(kept, deviation, sign * want[:, k], strict=True)), key=key)
            if all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9 for a, b in zip(found, hoped, strict=True)):
                break
        else:
            raise AssertionError(f"component {k + 1}")
        assert all(abs(r.explained / (e[k] / e.sum()) - 1) < 1e-9 for r in mine)
    assert max(r.identity_error for r in got) < 1e-9 and max(r.residual for r in got) < whitening.LIMIT


def test_whitening_takes_the_commonest_length(spark):
    rows = [(i, [float(i % 3), float(i % 5)]) for i in range(9)] + [(i, [1.0, 2.0, 3.0]) for i in range(20, 24)]
    assert {r.n for r in whitening.whiten(make(spark, rows)).collect()} == {9}
    rows += [(i, [1.0, float(i), 3.0]) for i in range(30, 35)]  # as common: the smaller length
    assert {r.n for r in whitening.whiten(make(spark, rows)).collect()} == {9}


def test_whitening_without_spread(spark):
    assert whitening.whiten(make(spark, [])).collect() == []
    assert whitening.whiten(make(spark, [(1, None), (2, [math.nan])])).collect() == []
    assert whitening.whiten(make(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(make(spark, [(i, [1.0, 2.0]) for i in range(9)])).collect() == []
    line = whitening.whiten(make(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])).collect()  # one direction alone has spread
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12 and len(line) == 9


def test_whitening_ties(spark):
    """Equal eigenvalues: any basis of their space, still white."""
    rows = [(4 * d + k, [float(s) if j == d else 0.0 for j in range(4)]) for d in range(4) for k, s in enumerate((1, -1, 2, -2))]
    got = whitening.whiten(make(spark, rows)).collect()
    assert len(got) == 64 and {round(r.explained, 12) for r in got} == {0.25} and got[0].identity_error < 1e-9


def test_whitening_exact_deviations_of_large_numbers(spark):
    rows = [(i, [float(i) * 1e11, 1.0 - i, 2e11 * (i % 3)]) for i in range(40)]
    kept = [(i, [c + 100_000 for c in v]) for i, v in plain(rows, 3)]
    n, s, *_ = moments([v for _, v in kept])
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(make(spark, rows), dims=3).collect()}
    assert got == {i: sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for i, v in kept}


def test_lobpcg_uses_little_more_than_products():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((200, 200)))
    e = np.concatenate([[90, 80, 70, 60, 60, 50, 40, 30.0], rng.uniform(0, 20, 192)])
    v = (q * e) @ q.T
    calls = []
    values, u, residual = whitening.lobpcg(lambda b: calls.append(b.shape[1]) or v @ b, 200, 8)
    assert np.abs(values - np.sort(e)[::-1][:8]).max() < 1e-10 and np.linalg.norm(v @ u - u * values, axis=0).max() < 1e-9
    assert len(calls) < 60 and max(calls) <= 3 * (8 + whitening.SPARE) and residual.max() < 1e-9
    with pytest.raises(ArithmeticError):
        whitening.lobpcg(lambda b: v @ b, 200, 8, steps=2)


# ---- Lloyd


def lloyd_plain(kept, k, rounds, seed):
    firsts = sorted(((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None))[:k]
    centroids = [v for _, v in firsts]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(centroids)), key=lambda j: (far(v, centroids[j]), j))
    for _ in range(rounds):
        at = [near(v) for _, v in kept]
        for j in set(at):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            centroids[j] = [math.floor(Fraction(sum(c), len(mine))) for c in zip(*mine, strict=True)]
    at = [near(v) for _, v in kept]
    d = [far(v, centroids[a]) for (_, v), a in zip(kept, at, strict=True)]
    mark = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fits = lambda *n: sum(n) if all(x < 1 << 63 for x in (*n, sum(n))) else None
    return [(i, a, fits(x), fits(*(y for b, y in zip(at, d, strict=True) if b == a)), fits(*d), mark[a]) for (i, _), a, x in zip(kept, at, d, strict=True)]


def found_clusters(df):
    return sorted(map(tuple, lloyd.digest_clusters(df).collect()), key=repr)


@pytest.mark.parametrize("k, rounds, size", [(8, 10, 1.0), (3, 1, 1.0), (5, 4, 5e5), (4, 3, 2.5e6), (200, 2, 1.0)])
def test_lloyd(spark, k, rounds, size):
    rows = [(i, v if v is None else [c if c is None else c * size for c in v]) for i, v in vectors(120, 6, seed=k)]
    got = found_clusters(lloyd.lloyd(make(spark, rows), k=k, rounds=rounds, dims=6))
    assert got == sorted(lloyd_plain(plain(rows, 6), k, rounds, 3), key=repr) and got


def test_lloyd_ties_and_empty_centroids(spark):
    """Equal starts leave later centroids empty: they stay where they were, and ties go to the smaller number."""
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)] + [(99, [0.5, 0.0])]
    got = found_clusters(lloyd.lloyd(make(spark, rows), k=8, rounds=3, dims=2))
    assert got == sorted(lloyd_plain(plain(rows, 2), 8, 3, 3), key=repr)


def test_lloyd_of_next_to_nothing(spark):
    assert found_clusters(lloyd.lloyd(make(spark, []), dims=2)) == []
    assert found_clusters(lloyd.lloyd(make(spark, [(1, None), (2, [1.0]), (3, [math.nan, 1.0])]), dims=2)) == []
    assert found_clusters(lloyd.lloyd(make(spark, [(None, [1.0, 2.0])]), dims=2)) == []
    assert [r[:5] for r in found_clusters(lloyd.lloyd(make(spark, [(1, [1.0, 2.0]), (None, [1.0, 2.0])]), dims=2))] == [(1, 0, 0, 0, 0), (None, 0, 0, 0, 0)]


def test_lloyd_beyond_64_bits(spark):
    """Sums are exact where 64 bits overflow, and distances that don't fit are null."""
    rows = [(i, [4e15 * (-1) ** i, 4e15]) for i in range(30)]
    one = lloyd.lloyd(make(spark, rows), k=1, rounds=2, dims=2).collect()
    assert one[0].centroid == [0, 4096 * 10**15] and {r.distance for r in one} == {None}


# ---- pieces


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=piece_coding.DEFAULT_MODEL)


@pytest.fixture(scope="module")
def model():
    with open(piece_coding.DEFAULT_MODEL, "rb") as f:
        return piece_coding.PieceModel(f.read())


def texts(n, seed):
    rng = random.Random(seed)
    pools = ["abcdefghij ", "  \t\n .,;:'\"", "0123456789.,-", "éüßñçøåæ ", "漢字仮名交じり文 ", "кириллица ", "😀👩‍👩‍👧🏽 ​﻿", "▁ ▁", "<s></s><unk><0x41>", "aaaa", "\x00\x01\x7f\x80 ", "the ing tion er \n"]
    for _ in range(n):
        pool = "".join(rng.sample(pools, rng.randrange(1, 4)))
        yield "".join(rng.choice(pool) for _ in range(rng.randrange(0, 120)))


def test_pieces_like_the_library(model, library):
    cases = ["", " ", "  ", "▁", "a", "<s>", "</s>", "<0x0A>", "\n", " ", "ab" * 500, "a" * 5_000, " " * 3_000, "漢" * 700, "\x00", "x\x00y"]
    for t in cases + list(texts(4_000, 7)):
        want = library.encode(t, add_bos=True, add_eos=True)
        assert model.encode(t, True, True) == want, repr(t)
        assert model.decode(want) == library.decode(want), repr(t)


def test_any_ids_decode_like_the_library(model, library):
    rng = random.Random(3)
    for _ in range(3_000):
        ids = [rng.choice([rng.randrange(3), rng.randrange(3, 259), rng.randrange(259, 32_000)]) for _ in range(rng.randrange(0, 12))]
        assert model.decode(list(ids)) == library.decode(ids), ids


def test_backtracking_without_cuts(model, library):
    """The search over whole texts, which parts don't shorten, and merges done one by one."""
    for t in texts(600, 11):
        body = "".join(c for c in t.replace(" ", "▁") if c in model.characters)
        if body:
            assert [model.pieces[i][0] for i in model.search(body)] == model.merged(body)


def test_small_tables_of_parts(library):
    with open(piece_coding.DEFAULT_MODEL, "rb") as f:
        tight = piece_coding.PieceModel(f.read(), parts=3)
    for t in texts(300, 13):
        assert tight.encode(t) == library.encode(t)


def test_coded_documents(spark, library):
    rng = random.Random(5)
    long_text = " ".join("".join(rng.choice("abcdeéß漢\n.") for _ in range(rng.randrange(1, 12))) for _ in range(80_000))
    rows = [(1, None), (2, ""), (3, "Hello  world"), (3, "Hello  world"), (None, "no id"), (4, long_text), (5, "y" * 300_000), (6, " lead and trail ")]
    docs = spark.createDataFrame([(i, t, "b", 9) for i, t in rows], "doc_id long, text string, ids string, n_tokens int").repartition(3)
    got = sorted(map(tuple, piece_coding.digest_pieces(piece_coding.code_pieces(docs)).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert piece_coding.code_pieces(docs.limit(0)).collect() == []


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        piece_coding.PieceModel(b"\x0a\x05\x0a\x03abc")
