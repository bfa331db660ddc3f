"""The llm operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqframe.llm import cotrain, decontaminate, exact_dedup, langid, lm_scoring, minhash, mixing, substring, token_counts
from seqframe.llm import textcore as tc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, digest string, maybe string, rep string, hit string"
CLASS = bytes(c if (48 <= c < 58 or 97 <= c < 123 or c >= 128) else c + 32 if 65 <= c < 91 else 32 for c in range(256))
WORDS = [f"w{i}" for i in range(60)] + ["Ünder", "çà", "x-y"]


def make(spark, rows):
    """rows of (doc_id, text, lang, source), with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, None, 1, "d", "m", "r", "h") for r in rows], SCHEMA)


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.randrange(6)
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 80)))
        if rows and kind == 0:
            text = rng.choice(rows)[1]
        elif rows and kind == 1:
            words = (rng.choice(rows)[1] or "z").split() or ["z"]
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif rows and kind == 2:
            text = " ".join([rng.choice(rows)[1] or "", "tail\n\ttext", text[:50]])
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", None])))
    rows += [(n, None, None, None), (n + 1, "", "en", "a"), (n + 2, " \t\n", "en", "a"), (n + 3, None, "de", "b"), (n + 4, "ONE two", "de", "b"), (n + 5, "one TWO", "de", "b")]
    rows.append((n + 6, " ".join(rng.choice(WORDS) for _ in range(60_000)), "en", "a"))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, corpus()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [])


def byid(df, *cols):
    return {r.doc_id: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


# --- kernels -----------------------------------------------------------------------------------------------------


def test_words_and_hashes():
    texts = ["Hello, wörld foo-bar", "", None, "a b", "ab  12Z\tq", "\x0bA B"]
    for words, split in ((tc.space_words(pa.array(texts)), lambda t: t.encode().split()), (tc.alnum_words(pa.array(texts)), lambda t: t.encode().translate(CLASS).split())):
        got = [[words.text(i) for i in range(a, b)] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        assert got == [split(t or "") for t in texts]
    h = tc.space_words(pa.array(["a b a", "b a"])).hashes()
    assert h[0] == h[2] == h[4] and h[1] == h[3] != h[0]
    w = tc.window_hashes(h, 2)
    assert w[1] == w[3] and w[0] == w[2] and len(set(w.tolist())) == 2


def test_blocks_cover_all_rows():
    batch = pa.record_batch([pa.array(["x" * n for n in (5, 50, 1, 1, 0, 200)] + [None])], names=["text"])
    parts = list(tc.blocks(iter([batch]), "text", 52))
    assert sum(p.num_rows for p in parts) == 7 and [p.num_rows for p in parts][0] == 1
    assert [t for p in parts for t in p.column(0).to_pylist()] == batch.column(0).to_pylist()


# --- exact dedup -------------------------------------------------------------------------------------------------


def test_exact_dedup(spark, docs, empty):
    groups = defaultdict(list)
    for i, t, *_ in corpus():
        groups[hashlib.sha256((t or "").encode().lower()).digest()].append(i)
    want = {i: (max(v), len(v), i == max(v), h) for h, v in groups.items() for i in v}
    assert byid(exact_dedup.exact_dedup(docs, digest_all=True), "keep_id", "group_size", "kept", "digest") == want
    quick = byid(exact_dedup.exact_dedup(docs), "keep_id", "group_size", "kept")
    assert quick == {i: w[:3] for i, w in want.items()}
    assert exact_dedup.exact_dedup(empty).collect() == []
    twice = make(spark, [(1, "a", None, None), (1, "a", None, None), (None, "a", None, None), (None, "b", None, None)])
    rows = sorted(((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(twice).collect()), key=str)
    assert rows == [("1", 1, 3, True), ("1", 1, 3, True), ("None", 1, 3, False), ("None", None, 1, True)]
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, w in want.items() if w[2])


# --- near duplicates ---------------------------------------------------------------------------------------------


def near_brute(rows, k, percent):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, k, percent):
    assert byid(minhash.near_duplicates(docs, k, percent), "n_shingles", "component_id", "kept") == near_brute(corpus(), k, percent)


def test_near_duplicates_in_blocks(spark):
    """A group larger than a block, whose members mostly link through others."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(8)):
            words[rng.randrange(100)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), None, None))
    got = byid(minhash.near_duplicates(make(spark, rows), 3, 85, block_rows=16), "n_shingles", "component_id", "kept")
    assert got == near_brute(rows, 3, 85)


def test_near_duplicates_edges(spark, empty, docs):
    assert minhash.near_duplicates(empty).collect() == []
    rows = make(spark, [(1, "a b c d e f", None, None), (1, "a b c d e f", None, None), (None, "a b c d e f", None, None), (0, "a b c d e f", None, None)])
    out = sorted((str(r.doc_id), r.component_id, r.kept) for r in minhash.near_duplicates(rows).collect())
    assert out == [("0", 0, True), ("1", 0, False), ("1", 0, False), ("None", None, True)]
    assert minhash.drop_near_copies(docs).columns == docs.columns
    assert minhash.match_threshold(10, 1.0) == 10 and minhash.match_threshold(96, 0.85) > 48


def test_near_duplicates_of_ids_on_several_texts(spark):
    """Classes are told by their texts: an id on two texts loses no link of either and ties them."""
    words = [f"a{i}" for i in range(60)]
    first, second = " ".join(words), " ".join(f"b{i}" for i in range(60))
    rows = make(spark, [(5, first, None, None), (5, second, None, None), (7, second + " more", None, None), (9, first + " more", None, None), (3, first, None, None), (8, "x y z", None, None)])
    assert sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(rows, 3, 85).collect()) == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (8, 8, True), (9, 3, False)]


def test_collisions_match_a_plain_count():
    rng = np.random.default_rng(0)
    sigs = rng.integers(0, 4, (60, 12)).astype(np.int32)
    for left in (np.zeros(60, bool), np.arange(60) < 25):
        got = {(u, v) for u, found in minhash.collisions(sigs, left, 6) for v in found.tolist()}
        same = lambda a, b: (sigs[a] == sigs[b]).sum() >= 6
        want = {(u, v) for u in range(60) for v in range(60) if same(u, v) and (v < u if not left.any() else left[v] and not left[u])}
        assert got == want


# --- substring dedup ---------------------------------------------------------------------------------------------


def substring_brute(rows, window):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            if x in seen:
                gone[k : k + window] = [True] * window
            seen.add(x)
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(a for a, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("window, gram", [(20, 7), (5, 2), (3, 3)])
def test_substring_dedup(docs, window, gram):
    rows = corpus()
    loop = " ".join(["again", "and"] * 40)
    both = docs.union(make(docs.sparkSession, [(900, loop, None, None)])).repartition(5)
    got = byid(substring.substring_dedup(both, window, gram), "n_words", "n_removed", "kept_sha256")
    assert got == substring_brute([*rows, (900, loop)], window)


def test_substring_edges(spark, empty):
    assert substring.substring_dedup(empty).collect() == []
    text = " ".join(f"t{i}" for i in range(30))
    out = substring.substring_dedup(make(spark, [(None, text, None, None), (5, text, None, None), (3, text, None, None)])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in out) == [("3", 0), ("5", 30), ("None", 0)]
    assert [tuple(s) for s in next(r for r in out if r.doc_id == 5).spans] == [(0, 30)]
    twice = make(spark, [(5, text, None, None), (5, text, None, None), (7, text + " end", None, None), (7, "x " + text, None, None), (7, None, None, None)])
    out = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.substring_dedup(twice).collect())
    assert out == [(5, 30, 0), (5, 30, 0), (7, 0, 0), (7, 31, 30), (7, 31, 30)]


@pytest.mark.parametrize("hot, size", [(2, 1 << 18), (2, 40), (10**6, 40)])
def test_substring_hot_anchors(spark, hot, size):
    """A passage that most documents hold, among words of their own, over many blocks."""
    rng = random.Random(8)
    line = [f"l{i}" for i in range(30)]
    rows = [(i, " ".join([f"a{rng.randrange(50)}" for _ in range(rng.randrange(30))] + line + [f"b{rng.randrange(3)}" for _ in range(rng.randrange(40))]), None, None) for i in range(300)]
    got = byid(substring.substring_dedup(make(spark, rows).repartition(40), hot=hot, reference_windows=size), "n_words", "n_removed", "kept_sha256")
    assert got == substring_brute(rows, 20)


def test_substring_of_long_repetitive_texts(spark):
    """Two copies of a text of one word half a million times and then another, in either order of hashes: linear, not quadratic."""
    for one, two in (("k", "l"), ("l", "k")):
        text = " ".join([one] * 250_000 + [two] * 250_000)
        start = time.time()
        got = byid(substring.substring_dedup(make(spark, [(1, text, None, None), (2, text, None, None)]).coalesce(1)), "n_words", "n_removed")
        # the first copy keeps the first window of each run and those on the border; only repeats go
        assert got[2] == (500_000, 500_000) and got[1][0] == 500_000 and 499_900 < got[1][1] < 500_000
        assert time.time() - start < 60


def test_nearest_smaller():
    rng = np.random.default_rng(3)
    for values in (np.concatenate([np.arange(300), np.arange(300)[::-1]]), rng.integers(0, 5, 400), rng.permutation(500)):
        want = [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(len(values))]
        assert substring._nearest_smaller(values).tolist() == want


@pytest.mark.parametrize("ties", [False, True])
def test_factors_are_longest_earlier_matches(ties):
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(2, 60))
        symbols = rng.integers(0, 3, n)
        when = rng.integers(0, n, n) if ties else rng.permutation(n)
        length, source = substring.SuffixArray(symbols).longest_earlier(when)

        def common(i, j, s=symbols.tolist()):
            k = 0
            while max(i, j) + k < len(s) and s[i + k] == s[j + k]:
                k += 1
            return k

        for i in range(n):
            assert length[i] == max([common(i, j) for j in range(n) if when[j] < when[i]], default=0)
            assert source[i] == -1 if not length[i] else when[source[i]] < when[i] and common(i, source[i]) == length[i]
        begin, at = substring.greedy(length), 0
        for b in begin.tolist():
            assert not length[at:b].any() and length[b]
            at = b + length[b]
        assert not length[at:].any()


# --- decontamination ---------------------------------------------------------------------------------------------


def contaminated_brute(rows, items, window=10):
    windows = defaultdict(set)
    for i, t in items:
        w = (t or "").encode().translate(CLASS).split()
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows[tuple(w[k : k + window])].add(str(i))
    out = {}
    for i, t, *_ in rows:
        w = (t or "").encode().translate(CLASS).split()
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out[i] = (len(w), len(hit), sorted(found))
    return out


ITEMS = [(1, "w1 w2 w3"), (2, None), (3, ""), (10, "tail text"), (4, "W7"), (5, "w1 w2 w3"), (6, " ".join(f"p{i}" for i in range(14))), (7, "... !!")]


@pytest.mark.parametrize("block_chars", [1 << 20, 8])
def test_decontamination(spark, docs, block_chars):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    planted = [(950, "x " + " ".join(f"P{i}" for i in range(2, 13)) + " y", None, None), (951, " ".join(f"p{i}" for i in range(9)), None, None)]
    both = docs.union(make(spark, planted))
    got = byid(decontaminate.mark_contamination(both, items, block_chars=block_chars), "n_words", "n_hit", "items")
    assert got == contaminated_brute([*corpus(), *planted], ITEMS)
    assert got[950][1] == 11 and got[951][1] == 0
    span = next(r for r in decontaminate.mark_contamination(both, items).collect() if r.doc_id == 950).spans[0]
    assert planted[0][1].encode()[span.start_byte : span.end_byte].decode() == " ".join(f"P{i}" for i in range(2, 13))
    clean = decontaminate.drop_contaminated(both, items)
    assert clean.columns == both.columns and {r.doc_id for r in clean.collect()} == {i for i, v in got.items() if not v[1]}


def test_decontamination_edges(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 for r in decontaminate.mark_contamination(docs, none).collect())
    assert decontaminate.mark_contamination(empty, none).collect() == []
    d = decontaminate.digest_items(decontaminate.mark_contamination(make(spark, [(1, "q", None, None)]), none)).first()
    assert d.items_sha256 == hashlib.sha256(b"").hexdigest() and d.contaminated is False


def test_fm_index_against_find():
    rng = np.random.default_rng(3)
    step = decontaminate.SAMPLE_STEP
    stretches = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(20)] + [np.ones(40, int)]
    text = np.concatenate([np.concatenate([s, np.zeros(step - len(s) % step, int)]) for s in stretches])
    index = decontaminate.FMIndex(text, 5)
    phrases = np.array([[0, 1, 2], [3, 3, 1], [0, 0, 1], [1, 1, 1], [5, 1, 1], [0, 0, 4]])
    lo, hi = index.search(phrases, (phrases > 0).sum(axis=1))
    for p, a, b in zip(phrases, lo, hi, strict=True):
        p = p[p > 0]
        want = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist() if a < b else []) == want


# --- language models, language, quality, tokens ------------------------------------------------------------------


def test_lm_scores_against_a_plain_model(spark, docs, empty):
    bits, pairs, strength = 6, 8, 2.0
    target = {0, 3, 5, 121}
    ids = spark.createDataFrame([(i,) for i in target] + [(None,), (77777,), (3,)], "doc_id long")
    got = byid(lm_scoring.cross_entropy_difference(docs, ids, bits, pairs, strength), "n_tokens", "ce_target", "ce_background", "ce_diff")
    grams = {}
    for i, t, *_ in corpus():
        w = tc.alnum_words(pa.array([t], pa.string()))
        grams[i] = list(zip(*(x.tolist() for x in lm_scoring.cells(w, bits, pairs)), strict=True))
    losses = []
    for chosen in (target, set(grams)):
        c, w, p = (Counter(g[k] for i in chosen for g in grams[i]) for k in range(3))
        n = sum(w.values())

        def loss(g, c=c, w=w, p=p, n=n):
            uni = (w[g[1]] + 0.5) / (n + 0.5 * 2**bits)
            return -math.log((p[g[2]] + strength * uni) / (c[g[0]] + strength))

        losses.append(loss)
    for i, g in grams.items():
        if not g:
            assert got[i] == (0, None, None, None)
            continue
        want = [sum(map(f, g)) / len(g) for f in losses]
        assert got[i][0] == len(g) and np.allclose(got[i][1:], [*want, want[0] - want[1]])
    assert lm_scoring.cross_entropy_difference(empty, ids).collect() == []


def test_lm_counts_every_distinct_word_and_bigram_apart(spark):
    """More distinct words than 2^18: with tables of fixed size they shared counts."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{i * 1500 + n}" if n % 2 else f"c{rng.randrange(40)}" for n in range(1500)), None, None) for i in range(400)]
    target = set(range(0, 400, 7))
    got = byid(lm_scoring.cross_entropy_difference(make(spark, rows), spark.createDataFrame([(i,) for i in target], "doc_id long"), chunk_bytes=1 << 18), "n_tokens", "ce_target", "ce_background", "ce_diff")
    texts = {i: t.split() for i, t, *_ in rows}
    grams = {i: list(zip([None, *t[:-1]], t, strict=True)) for i, t in texts.items()}
    vocabulary = len({x for t in texts.values() for x in t})
    assert vocabulary > 2**18
    means = []
    for chosen in (target, set(texts)):
        c, w, p = (Counter(k(g) for i in chosen for g in grams[i]) for k in (lambda g: g[0], lambda g: g[1], lambda g: g))
        n = sum(w.values())
        loss = lambda g, c=c, w=w, p=p, n=n: math.log(c[g[0]] + 8) - math.log(p[g] + 8 * (w[g[1]] + 0.5) / (n + 0.5 * vocabulary))
        means.append({i: sum(map(loss, g)) / len(g) for i, g in grams.items()})
    for i in texts:
        assert got[i][0] == 1500 and np.allclose(got[i][1:], [means[0][i], means[1][i], means[0][i] - means[1][i]], rtol=1e-9)


def test_language(spark, empty):
    rng = random.Random(0)
    vocab = {"xx": ["abra", "kadab", "rass", "umba", "zel"], "yy": ["frotz", "nitfol", "gnus", "to", "plugh"], "zz": ["été", "où", "çava", "naïf", "eau"]}
    rows = []
    for i in range(600):
        lang = rng.choice(list(vocab))
        rows.append((i, " ".join(rng.choice(vocab[lang]) for _ in range(rng.randrange(6, 60))), lang, None))
    rows += [(600, None, "xx", None), (601, "123 !!", "yy", None), (602, "", None, None)]
    df = make(spark, rows)
    models = langid.fit_dictionaries(df.filter(~langid.held_out()))
    assert list(models) == ["xx", "yy", "zz"] and all(len(m) <= 4 * langid.SLOTS * langid.LONGEST_CHARS for m in models.values())
    got = byid(langid.identify_language(df, models), "lang_pred", "score", "rejected")
    test = [r for r in rows[:600] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(test) > 100 and np.mean([got[i][0] == lang for i, _, lang, _ in test]) > 0.98
    assert all(got[i] == ("und", 0.0, True) for i in (600, 601, 602)) and all(0 <= v[1] <= 1 for v in got.values())
    kept = langid.drop_rejected(df, models)
    assert kept.columns == df.columns and not {600, 601, 602} & {r.doc_id for r in kept.collect()} and kept.count() > 590
    assert langid.identify_language(empty, models).collect() == [] and langid.fit_dictionaries(empty) == {}
    assert langid.identify_language(df, {}).filter("lang_pred <> 'und'").count() == 0


def test_cotraining(spark, empty):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(800):
        good = rng.random() < 0.6
        words = [rng.choice(["plain", "prose", "reads", "well", "and", "calm"] if good else ["BUY", "now!!", "$$", "click", "here!!"]) for _ in range(20)]
        rows.append((i, " ".join(words), "en", ("s" if good else "t") + str(rng.randrange(3))))
        if i % 4 == 0:
            labels.append((i, int(good)))
    truth = {i: r[3][0] == "s" for i, r in enumerate(rows)}
    rows += [(900, None, None, None), (901, "", "en", "s1")]
    marks = spark.createDataFrame([*labels, (None, 1), (5000, 1), (8, None)], "doc_id long, quality int")
    got = byid(cotrain.score_quality(make(spark, rows), marks), "score", "good", "p_text", "p_meta")
    unseen = [i for i in truth if i % 4]
    assert np.mean([got[i][1] == truth[i] for i in unseen]) > 0.97
    assert all(0 <= x <= 1 for v in got.values() for x in (v[0], v[2], v[3])) and len(got) == 802
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r.score, 6) for r in cotrain.score_quality(make(spark, rows), none).collect()} == {0.5}
    assert cotrain.score_quality(empty, marks).collect() == []


def test_token_counts(spark, docs, empty):
    encoder = token_counts.Encoder(open(token_counts.DEFAULT_RANKS, "rb").read())
    got = byid(token_counts.token_counts(docs), "n_tokens", "section_tokens", "n_crossing")
    for i, t, *_ in corpus():
        assert got[i][0] == len(encoder.encoding.encode_ordinary(t or "")) == sum(got[i][1])
        assert len(got[i][1]) == (len((t or "").splitlines()) if (t or "").strip(" ") and "\x0b" not in (t or "") else len(got[i][1]))
    assert token_counts.token_counts(empty).collect() == []
    text = "naïve 🙂 café\n\n  two  words\nend"
    for rule in token_counts.RULES:
        ids, first, end = encoder.spans(text)
        borders = token_counts.line_borders(text)
        want = Counter()
        for a, b in zip(first, end, strict=True):
            share = [max(0, min(b, y) - max(a, x)) for x, y in zip(borders, borders[1:], strict=False)]
            hit = [k for k, n in enumerate(share) if n]
            want[hit[0] if rule == "start" else hit[-1] if rule == "end" else share.index(max(share))] += 1
        counts, _ = token_counts.attribute(first, end, borders, rule)
        assert counts.tolist() == [want[k] for k in range(len(borders) - 1)]
    f = token_counts.token_counts(make(spark, [(1, "some text", "en", None)]), fields=["lang", "source", "text"]).first()
    assert len(f.section_tokens) == 3 and sum(f.section_tokens) == f.n_tokens == len(encoder.encoding.encode_ordinary("en\n\nsome text"))


@pytest.mark.parametrize("run", [" ", "\n", "a", "é", "\t \n"])
def test_token_counts_of_very_long_runs(spark, run):
    encoder = token_counts.Encoder(open(token_counts.DEFAULT_RANKS, "rb").read())
    for tail in ("", "b c", ". d"):
        text = "x" + run * (1 << 17) + tail
        assert encoder.ids(text).tolist() == encoder.encoding.encode_ordinary(text)
    row = token_counts.token_counts(make(spark, [(1, "x" + run * (5_000_000 // len(run)) + "b", None, None)])).first()
    assert row.n_tokens == sum(row.section_tokens) > 10**6


# --- mixing ------------------------------------------------------------------------------------------------------


def test_weights(spark):
    tokens = {"a": 800, "b": 150, "c": 50, "d": 0}
    df = spark.createDataFrame(list(tokens.items()), "source string, tokens long")
    p = np.array([800, 150, 50]) / 1000
    r = {x.source: x for x in mixing.source_weights(df, target_entropy=0.9).collect()}
    w = np.array([r[k].weight for k in "abc"])
    assert abs(-(w * np.log(w)).sum() / np.log(3) - 0.9) < 1e-9 and np.allclose(w, p ** r["a"].alpha / (p ** r["a"].alpha).sum())
    assert r["d"].budget == 0
    r = {x.source: x for x in mixing.source_weights(df, max_repeats=3.0).collect()}
    assert abs(r["c"].weight * 1000 / 50 - 3.0) < 1e-9
    assert {x.alpha for x in mixing.source_weights(df.filter("tokens > 0"), target_entropy=0.1).collect()} == {1.0}
    with pytest.raises(ValueError):
        mixing.source_weights(df)


@pytest.mark.parametrize("budget", [None, 300, 20_000])
def test_mix(spark, docs, budget):
    small = docs.filter("doc_id <> 126")
    counts = {i: len((t or "").encode().split()) for i, t, *_ in corpus() if i != 126}
    source = {i: s for i, _, _, s in corpus()}
    weights = {r.source: r for r in mixing.source_weights(spark.createDataFrame([(s, sum(c for i, c in counts.items() if source[i] == s)) for s in (None, "a", "b")], "source string, tokens long"), 0.99, budget=budget).collect()}
    want = set()
    for s, w in weights.items():
        whole, rest = divmod(w.budget, w.tokens)
        for epoch in range(whole + 1):
            order = sorted((int(hashlib.md5(f"7:{epoch}:{i}".encode()).hexdigest()[:8], 16), i) for i in counts if source[i] == s)
            total = 0
            for place, i in order:
                total += counts[i]
                if epoch == whole and (total > rest or not rest):
                    break
                want.add((i, s, counts[i], epoch, place >> 24, place))
    got = [tuple(r) for r in mixing.mix_sources(small, 0.99, budget=budget).select("doc_id", "source", "n_tokens", "epoch", "block", "place").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_mix_by_a_column_of_tokens(docs):
    counted = docs.withColumn("tokens", F.col("doc_id") % 7 - 1)
    got = {(r.doc_id, r.n_tokens) for r in mixing.mix_sources(counted, 0.99, n_tokens="tokens").collect()}
    assert got and all(n == max(0, i % 7 - 1) for i, n in got)


def test_mix_empty(empty):
    assert mixing.mix_sources(empty, 0.9).collect() == []
