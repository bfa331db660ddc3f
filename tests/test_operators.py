"""Joins against brute force, clustering, batch alignment and the merge planner."""

import random
import time
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqframe.functions import alignment as al
from seqframe.functions import mutations as mu
from seqframe.functions import quality, ranges
from seqframe.functions import sequence as s
from seqframe.functions.merging import targets
from seqframe.operators import batch_alignment as ba
from seqframe.operators import clustering as cl
from seqframe.operators import dataflow as flow
from seqframe.operators import fuzzy as fz
from seqframe.operators import graph
from seqframe.operators import intervals as iv
from seqframe.operators.graph import components
from seqframe.operators.skew import join_unique
from seqframe.plans import catalogue


def _column(spark, text, *exprs):
    return spark.createDataFrame([(text,)], "s string").select(*exprs).first()


@pytest.mark.parametrize("seq, mode, expected", [("ATGTCACA", s.FROM_RIGHT, "_VT"), ("ATTAGACA", s.FROM_LEFT, "IR_"), ("ATTAGACA", s.FROM_CENTER, "I_T"), ("", s.FROM_LEFT, ""), ("AC", s.FROM_CENTER, "_"), ("TAR", s.FROM_LEFT, "*"), ("RAY", s.FROM_LEFT, "X")])
def test_translation(spark, seq, mode, expected):
    assert _column(spark, seq, s.translate(F.col("s"), mode)).asDict().popitem()[1] == expected


def test_reverse_complement_of_all_codes(spark):
    r = _column(spark, "AGCTNRYSWKMBDHV", s.reverse_complement(F.col("s")).alias("a"), s.reverse_complement(s.reverse_complement(F.col("s"))).alias("b"))
    assert (r.a, r.b) == ("BDHVKMWSRYNAGCT", "AGCTNRYSWKMBDHV")


def test_errors_and_edges(spark):
    with pytest.raises(Exception, match="not a nucleotide"):
        _column(spark, "AXZ", s.parse(F.col("s")))
    with pytest.raises(Exception, match="out of the sequence"):
        _column(spark, "ACG", s.mismatch_count(F.col("s"), F.col("s"), F.lit(1), F.lit(0), F.lit(3)))
    with pytest.raises(Exception, match="outside the range"):
        _column(spark, "A", ranges.to_relative(ranges.of(F.lit(2), F.lit(5)), F.lit(5)))
    r = _column(spark, "ACGR", s.possible_alphabets(F.col("s")).alias("a"), ranges.to_relative(ranges.of(F.lit(2), F.lit(5), True), F.lit(2)).alias("r"), quality.p_error(F.lit(20)).alias("p"))
    assert r.a == ["nucleotide", "aminoacid"] and r.r == 2 and abs(r.p - 0.01) < 1e-12


def test_layout_targets(spark):
    df = spark.createDataFrame([("AC", [1, 2], "GG", [3, 4])], "a string, p array<int>, b string, q array<int>")
    one = F.struct(F.col("a").alias("seq"), F.col("p").alias("qual"))
    two = F.struct(F.col("b").alias("seq"), F.col("q").alias("qual"))
    t = df.select(targets(one, two, "Opposite").alias("t")).first().t
    assert [(x.left.seq, x.right.seq) for x in t] == [("AC", "CC"), ("GG", "GT")] and t[1].right.qual == [2, 1]


def _mutated(rng, seq):
    out = list(seq)
    for _ in range(rng.randrange(3)):
        k, at = rng.randrange(3), rng.randrange(max(1, len(out)))
        if at >= len(out):
            continue
        out[at : at + 1] = [[rng.choice("ACGT")], [], [out[at], rng.choice("ACGT")]][k]
    return "".join(out)


@pytest.mark.parametrize("limits", [fz.SearchLimits(1, 1, 1, 2, greedy=False), fz.SearchLimits(0, 2, 1), fz.SearchLimits(2, 0, 0), fz.SearchLimits(1, 1, 1, 3, 0.33)])
def test_fuzzy_join_is_complete(spark, limits):
    rng = random.Random(7)
    keys = ["".join(rng.choice("ACGT") for _ in range(rng.choice([1, 2, 3, 8, 9, 10]))) for _ in range(120)]
    queries = [_mutated(rng, k) for k in keys] + ["", "A"]
    q = spark.createDataFrame(list(enumerate(queries)), "id long, seq string")
    k = spark.createDataFrame(list(enumerate(keys)), "id long, seq string")
    got = {(r.q_id, r.k_id): (round(r.penalty, 6), r.mismatches, r.deletions, r.insertions) for r in fz.fuzzy_join(q, k, "seq", "seq", limits).collect()}
    want = {}
    for i, a in enumerate(queries):
        for j, b in enumerate(keys):
            hit = fz.best_match(a, b, limits)
            if hit:
                want[i, j] = (round(hit[0], 6), *hit[1:])
    assert got == want and len(want) > 50


def test_edit_sequences_are_ordered():
    seqs = fz.edit_sequences(fz.SearchLimits(1, 1, 1, 2))
    costs = [sum(fz.PENALTIES[k] for k in x) for x in seqs]
    assert costs == sorted(costs) and seqs[0] == () and (0, 1) in seqs and (0, 0) not in seqs
    assert len(fz.PRESETS) == 12


def test_clusters(spark):
    rows = [(1, "AAAAAAAA", 100.0), (2, "AAAAAAAC", 10.0), (3, "AAAAAACC", 5.0), (4, "GGGGGGGG", 50.0), (5, "GGGGGGGT", 60.0), (6, "TTTTTTTT", 1.0)]
    df = spark.createDataFrame(rows, "id long, seq string, weight double")
    one = cl.ClusteringStrategy(fz.SearchLimits(1, 0, 0, 1), max_depth=1)
    got = {r.id: (r.root_id, r.parent_id, r.depth) for r in cl.cluster(df, one).collect()}
    assert got == {1: (1, None, 0), 2: (1, 1, 1), 3: (3, None, 0), 5: (5, None, 0), 4: (5, 5, 1), 6: (6, None, 0)}
    two = cl.ClusteringStrategy(fz.SearchLimits(1, 0, 0, 1), max_depth=2)
    deep = cl.cluster(df, two)
    assert {r.id: (r.root_id, r.parent_id, r.depth) for r in deep.collect()}[3] == (1, 2, 2)
    assert {r.root_id: r.total for r in cl.cluster_totals(deep).collect()} == {1: 3, 5: 2, 6: 1}


def _greedy(rows, edits, depth, ratio=0.0, accept=None):
    """Visits objects one by one, as the rule says."""
    letters = "AGCTNRYSWKMBDHV"
    order = sorted(rows, key=lambda r: (-r[2], -len(r[1]), [-letters.index(c) for c in r[1]], r[0]))
    place = {r[0]: n for n, r in enumerate(order)}
    near = lambda a, b: len(a[1]) == len(b[1]) and sum(x != y for x, y in zip(a[1], b[1], strict=True)) <= edits
    out = {}
    for head in order:
        if head[0] in out:
            continue
        out[head[0]] = (head[0], None, 0)
        layer = [head]
        for d in range(1, depth + 1):
            following = []
            for parent in layer:
                mine = [c for c in order if c[0] not in out and c[2] < parent[2] and near(parent, c) and (not ratio or c[2] <= ratio * parent[2]) and (not accept or accept(parent[0], c[0]))]
                for c in sorted(mine, key=lambda c: place[c[0]]):
                    out[c[0]] = (head[0], parent[0], d)
                following += sorted(mine, key=lambda c: place[c[0]])
            layer = following
    return out


@pytest.mark.parametrize("edits, depth, ratio, odd", [(1, 1, 0.0, False), (1, 3, 0.0, False), (2, 2, 0.6, False), (1, 2, 0.0, True)])
def test_clusters_against_visits_one_by_one(spark, edits, depth, ratio, odd):
    rng = random.Random(edits * 10 + depth)
    seqs = sorted({"".join(rng.choice("ACG") for _ in range(5)) for _ in range(130)})
    rows = [(i, s, float(rng.randrange(1, 12))) for i, s in enumerate(seqs)]
    accept = (lambda a, b: (a + b) % 3 > 0) if odd else None
    by_row = (lambda head, other, hit: (head["id"] + other["id"]) % 3 > 0) if odd else None
    strategy = cl.ClusteringStrategy(fz.SearchLimits(edits, 0, 0, edits), max_depth=depth, ratio=ratio, accept=by_row)
    got = {r.id: (r.root_id, r.parent_id, r.depth) for r in cl.cluster(spark.createDataFrame(rows, "id long, seq string, weight double"), strategy).collect()}
    assert got == _greedy(rows, edits, depth, ratio, accept)


def test_join_unique_keeps_heavy_keys_whole(spark):
    left = spark.range(5000).selectExpr("CASE WHEN id < 3000 THEN 1 ELSE id % 50 END AS k", "id AS v").union(spark.sql("SELECT cast(NULL AS long), -1L"))
    right = left.groupBy("k").count().filter("k IS NOT NULL AND k <> 49").withColumnRenamed("count", "n").withColumn("name", F.concat(F.lit("k"), "k"))
    for how in ("inner", "left"):
        got = sorted(map(str, join_unique(left, right, "k", "n", how, heavy_keys=2, heavy_rows=30).select("k", "v", "name").collect()))
        assert got == sorted(map(str, left.join(right, "k", how).select("k", "v", "name").collect()))


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def _linked_lists(lists=400, nodes=3000, hub=600):
    """Stars as op7_minhash ties its posting lists: many repeated edges, one large group, some chains."""
    rng = random.Random(5)
    edges = [(rng.randrange(hub), rng.randrange(hub)) for _ in range(4 * hub)]
    for _ in range(lists):
        group = [rng.randrange(hub, nodes) for _ in range(3)]
        edges += [(x, min(group)) for x in group] * 5
    return edges + [(i, i + 1) for i in range(nodes, nodes + 60)]


def test_components_write_few_tables(spark, monkeypatch):
    written = []

    class Counted(graph.Stored):
        def __init__(self, df, name):
            super().__init__(df, name)
            written.append((name, self.df.count()))

    monkeypatch.setattr(graph, "Stored", Counted)
    edges = _linked_lists()
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for x in sorted(near):
        front = [] if x in want else [x]
        while front:
            y = front.pop()
            if y not in want:
                want[y] = x
                front += near[y]
    assert got == {x: want[x] for x in near if near[x] != {x}}
    assert len(written) <= 16, written
    edge_tables = [n for name, n in written if name in ("joined", "large", "small")]
    assert edge_tables == sorted(edge_tables, reverse=True)


def test_star_forest():
    u, v = graph.star_forest(np.array([9, 7, 5, 30, 20, 9, 9]), np.array([7, 5, 2, 20, 11, 7, 2]))
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {5: 2, 7: 2, 9: 2, 20: 11, 30: 11}
    assert len(graph.star_forest(np.zeros(0, np.int64), np.zeros(0, np.int64))[0]) == 0
    path = np.random.default_rng(3).permutation(5000)
    u, v = graph.star_forest(np.maximum(path[1:], path[:-1]), np.minimum(path[1:], path[:-1]))
    assert sorted(u.tolist()) == list(range(1, 5000)) and not v.any()


def test_range_join_against_theta_join(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(a), int(a + w)) for i, (a, w) in enumerate(zip(rng.integers(0, 300, 200), rng.integers(0, 40, 200), strict=True))]
    df = spark.createDataFrame(rows, "id long, lower int, upper int")
    for touching in (False, True):
        got = sorted((r.a_id, r.b_id) for r in iv.range_join(df, df, 16, touching=touching).collect())
        if touching:
            want = sorted((a, b) for a, x, y in rows for b, u, v in rows if x <= v and u <= y)
        else:
            want = sorted((a, b) for a, x, y in rows for b, u, v in rows if x < v and u < y and x < y and u < v)
        assert got == want
    assert iv.overlapping_neighbours(df).count() > 0
    with pytest.raises(Exception, match="overlapping"):
        iv.checked_map(df).collect()


def test_seed_alignment_finds_targets(spark):
    refs, queries = ba.challenge(spark, refs=15, queries=80)
    hits = ba.seed_align(queries, refs, ba.PRESETS["strict"])
    best = hits.filter("rank = 1").join(queries.select("query_id", "target_id"), "query_id")
    assert best.filter("ref_id = target_id").select("query_id").distinct().count() >= 0.97 * 80
    spaced = ba.clustered_align(queries, refs).filter("rank = 1").join(queries.select("query_id", "target_id"), "query_id")
    assert spaced.filter("ref_id = target_id").count() >= 0.97 * 80
    brute = ba.brute_force(queries.filter("query_id < 10"), refs, cut=ba.HitCut(50, 0.9, 3), block_letters=500)
    assert brute.filter("rank = 1").join(queries, "query_id").filter("ref_id = target_id").count() == 10
    sub = {r.ref_id: r.seq for r in refs.collect()}
    for r in brute.join(queries.select("query_id", "seq"), "query_id").collect():
        part = sub[r.ref_id][r.from1 : r.to1]
        assert mu.mutate(part, [m.moved(-r.from1) for m in mu.decode(r.mutations)]) == r.seq[r.from2 : r.to2]


def test_best_hit_among_many_candidates(spark):
    """More references with most votes than any fixed number of candidates; the best score has fewer votes."""
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    q = letters(60)
    change = lambda s, *at: "".join("ACGT"["ACGT".index(c) ^ 1] if i in at else c for i, c in enumerate(s))
    # four changes side by side spoil fewer words than two apart, but cost four mismatches
    refs = [(i, letters(20) + change(q, 28, 29, 30, 31) + letters(20)) for i in range(40)] + [(99, letters(20) + change(q, 22, 40) + letters(20))]
    queries = spark.createDataFrame([(1, q)], "query_id long, seq string")
    p = replace(ba.PRESETS["default"], relative_votes=0.7)
    table = spark.createDataFrame(refs, "ref_id long, seq string")
    votes = {x.ref_id: x.votes for x in ba.map_seeds(queries, table, p).collect()}
    assert sum(v > votes[99] for v in votes.values()) == 40
    assert {x.ref_id for x in ba.seed_align(queries, table, p).filter("rank = 1").collect()} == {99}


@pytest.mark.parametrize("greedy", [False, True])
def test_mutations_of_a_hit_lead_from_query_to_key(greedy):
    rng = random.Random(17)
    found = 0
    for _ in range(300):
        a = "".join(rng.choice("ACG") for _ in range(rng.randint(0, 8)))
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "A", "C"])
        b = "".join(b)
        limits = fz.SearchLimits(2, 2, 2, 3, greedy=greedy)
        best, way = fz.best_match(a, b, limits), fz.hit_mutations(a, b, limits)
        assert (best is None) == (way is None)
        if best:
            found += 1
            assert mu.mutate(a, way) == b and mu.is_compatible(a, way)
            assert tuple(sum(m.kind == k for m in way) for k in "SDI") == best[1:]
    assert found > 200


def test_mutations_of_hits_as_a_column(spark):
    pairs = spark.createDataFrame([("ACGT", "AGGT"), ("ACGT", "ACG"), ("ACGT", "ACGT"), ("ACGT", "TTTT"), (None, "A")], "q string, k string")
    got = [r.m for r in pairs.select(fz.hit_mutations_column(F.col("q"), F.col("k"), fz.SearchLimits(1, 1, 1, 1)).alias("m")).collect()]
    assert got == ["SC1G", "DT3", "", None, None]


@pytest.mark.parametrize(("holes", "drift"), [(0, 4), (1, 2), (0, 0)])
def test_votes_of_blocks_against_a_join_of_all_seeds(spark, holes, drift):
    """Any cut into blocks gives what counting every pair of equal words gives; null, empty and short sequences meet nothing."""
    refs, queries = ba.challenge(spark, refs=12, queries=30, query_size=40, edits=5, seed=holes + drift)
    extra = spark.createDataFrame([(90, None), (91, ""), (92, "ACG"), (93, "A" * 60)], "id long, seq string")
    refs = refs.union(extra)
    queries = queries.select("query_id", "seq").union(extra)
    p = ba.SeedParameters(k=4, holes=holes, max_drift=drift, min_votes=2, relative_votes=0.5)
    seeds = lambda df, key: {r[0]: [(s.at, s.word) for s in r[1] or ()] for r in df.select(key, ba.seeds(F.col("seq"), p.k, p.holes)).collect()}
    asked, against, width = seeds(queries, "query_id"), seeds(refs, "ref_id"), 2 * drift + 1
    want = []
    for q, mine in asked.items():
        found = {}
        for r, theirs in against.items():
            windows = {}
            for at, word in mine:
                for place in (x for x, other in theirs if other == word):
                    for w in {(0, (place - at) // width), (1, (place - at + drift) // width)}:
                        windows.setdefault(w, []).append((at, place - at))
            each = [(len({at for at, _ in x}), min(s for _, s in x), max(s for _, s in x)) for x in windows.values()]
            if each and max(each)[0] >= p.min_votes:
                found[r] = max(each)
        want += [(q, r, *v) for r, v in found.items() if v[0] >= 0.5 * max(f[0] for f in found.values())]
    assert want
    for letters in (1 << 17, 300):
        assert sorted(tuple(x) for x in ba.map_seeds(queries, refs, p, block_letters=letters).collect()) == sorted(want)
    none = refs.limit(0)
    assert ba.map_seeds(queries, none, p).count() == ba.map_seeds(queries.limit(0), refs, p).count() == 0


@pytest.mark.parametrize(("holes", "letters"), [(0, "ACGT"), (1, "ACGT"), (1, "AC")])
def test_blocks_of_seeds_hold_letters_and_lose_no_pair(spark, holes, letters):
    """Every pair that has as many votes as its query needs is counted; blocks are sent as letters, words (13 to 80 times as large) stay in tasks."""
    rng = random.Random(holes)
    rs = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(60)]
    qs = [r[5:35] for r in rs[:20]] + ["".join(rng.choice(letters) for _ in range(30)) for _ in range(20)]
    p = ba.SeedParameters(k=4, holes=holes, max_drift=3, min_votes=2)
    for least in (2, 7, 12, 18, 26):
        near = {(i, int(j)) for i, found in ba._near(qs, np.full(len(qs), least), rs, p) for j in found}
        pairs = [(i, j) for i in range(len(qs)) for j in range(len(rs))]
        number, votes, *_ = ba._pair_votes([qs[i] for i, _ in pairs], [rs[j] for _, j in pairs], p)
        assert {pairs[n] for n, v in zip(number, votes, strict=True) if v >= least} <= near
    df = spark.createDataFrame(list(enumerate(rs)), "ref_id long, seq string")
    plan = ba.map_seeds(df.withColumnRenamed("ref_id", "query_id"), df, p)._jdf.queryExecution().optimizedPlan().toString()
    assert "word" not in plan and "Generate explode" in plan


def test_alignment_queries_read_every_document(spark, tmp_path):
    """A reference whose id 50 does not divide is the best hit of query 100, and queries of other ids are answered."""
    rows = [(i, f"text {i}") for i in range(1, 60)] + [(100, "text 7")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {name: catalogue.QUERIES[name](spark, str(tmp_path)).collect() for name in ("batch_align_brute_force", "seed_vote_align", "seed_clustered_align")}
    assert {r.ref_id for r in got["batch_align_brute_force"] if r.rank == 1} == {7}
    for name in ("seed_vote_align", "seed_clustered_align"):
        assert {r.query_id for r in got[name]} == {i for i, _ in rows}, name


@pytest.mark.parametrize("ties", [False, True])
def test_brute_force_in_blocks_finds_what_one_block_finds(spark, ties):
    refs, queries = ba.challenge(spark, refs=12, queries=20)
    cut = ba.HitCut(10, 0.3, 3, ties)
    whole, blocks = ([tuple(r) for r in ba.brute_force(queries, refs, cut=cut, block_letters=n).collect()] for n in (1 << 20, 300))
    assert whole and sorted(whole) == sorted(blocks)
    short = lambda df, key: df.select(key, F.substring("seq", 1, 8).alias("seq"))
    whole, blocks = ([tuple(r) for r in ba.substitution_hits(short(queries, "query_id"), short(refs, "ref_id"), cut=ba.HitCut(-8, 0.8, 3, ties), block_letters=n).collect()] for n in (1 << 20, 16))
    assert whole and sorted(whole) == sorted(blocks)


@pytest.mark.parametrize("ties", [False, True])
def test_substitution_hits_against_every_pair(spark, ties):
    """Letters beyond four, several lengths (one of more than 64 letters), nulls and empty sequences."""
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice("ACGTé-") for _ in range(rng.choice([0, 5, 9, 70])))) for i in range(80)] + [(200, None)]
    df = spark.createDataFrame(rows, "id long, seq string")
    cut = ba.HitCut(-40, 0.5, 3, ties)
    got = sorted(tuple(x) for x in ba.substitution_hits(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "ref_id"), 2, -1, cut, 300).select("query_id", "ref_id", "score").collect())
    want = []
    for i, x in rows[:-1]:
        hits = [(s, j) for j, y in rows[:-1] if len(x) == len(y) and (s := sum(2 if a == b else -1 for a, b in zip(x, y, strict=True))) >= -40]
        want += [(i, j, s) for s, j in cut.best(hits)]
    assert got == sorted(want)


def test_substitution_hits_of_many_references(spark):
    """Every pair of 400 queries and 200,000 references of 32 letters within a minute: a step for each letter of a pair took some minutes."""
    refs = spark.range(200000).select(F.col("id").alias("ref_id"), F.translate(F.md5(F.col("id").cast("string")), "0123456789abcdef", "AGCTAGCTAGCTAGCT").alias("seq"))
    queries = refs.filter("ref_id % 500 = 0").select(F.col("ref_id").alias("query_id"), "seq")
    start = time.time()
    hits = ba.substitution_hits(queries, refs, cut=ba.HitCut(-32, 0.1, 5)).collect()
    assert len(hits) == 2000 and all(h.rank > 1 or h.score == 32 for h in hits) and time.time() - start < 60


@pytest.mark.parametrize("scoring", [al.AffineScoring.nucleotide(), al.LinearScoring.nucleotide(), al.AffineScoring.nucleotide(open_=-1, extend=-3)])
def test_local_scores_are_those_of_alignments(scoring):
    rng = random.Random(5)
    for letters in ("AC", "ACGT", "ACGTNacgt"):
        refs = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(150)]
        queries = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(12)] + [refs[3][2:20]]
        want = [[hit.score if hit else 0 for hit in al.align([(r, q) for r in refs], scoring, "local")] for q in queries]
        assert al.local_scores(refs, queries, scoring).tolist() == want


def test_brute_force_of_many_pairs(spark):
    """20 queries against 20,000 references within a minute: with the moves of every pair it took some minutes."""
    letters = lambda key: F.translate(F.concat(F.md5(F.concat(F.lit("a"), key)), F.md5(F.concat(F.lit("b"), key)), F.md5(F.concat(F.lit("c"), key))), "0123456789abcdef", "AGCTAGCTAGCTAGCT")
    refs = spark.range(20000).select(F.col("id").alias("ref_id"), letters(F.col("id").cast("string")).alias("seq"))
    queries = refs.filter("ref_id % 1000 = 0").select(F.col("ref_id").alias("query_id"), F.substring("seq", 11, 40).alias("seq"))
    start = time.time()
    hits = ba.brute_force(queries, refs, cut=ba.HitCut(60, 0.9, 3)).collect()
    assert [(h.query_id, h.ref_id, h.score, h.mutations) for h in sorted(hits)] == [(i * 1000, i * 1000, 200, "") for i in range(20)]
    assert time.time() - start < 60


def test_cluster_query_takes_whole_reads(spark, tmp_path):
    """Every distinct read is an object of its own, though more reads than prefixes of 7 letters."""
    spark.range(20000).selectExpr("id AS doc_id", "concat('text ', id % 17000) AS text", "'en' AS lang", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["cluster"](spark, str(tmp_path)).collect()
    assert len(got) == len({r.seq for r in got}) and len({r.root for r in got if r.depth == 0}) == 17000 > 4**7


def test_merge_strategy():
    whole, part, other = flow.Key("s", frozenset({("s", 0, 10)})), flow.Key("p", frozenset({("s", 2, 5)})), flow.Key("o")
    assert part.relation(whole) is flow.Relation.NECESSARY and whole.relation(part) is flow.Relation.SUFFICIENT
    assert flow.merge_strategy([part, whole], [whole]) == ([part, whole], [])
    assert flow.merge_strategy([other, whole], [whole]) == ([], [whole])
    assert flow.merge_strategy([part], [whole, other]) == ([part], [whole, other])


def test_ordered_operators_do_not_depend_on_partitions(spark):
    df = spark.range(500).select((F.col("id") * 7 % 13).alias("k"), "id")
    for n in (1, 8):
        rows = [tuple(r) for r in flow.merge_sorted([df.repartition(n), df.filter("id < 50").repartition(n)], ["k", "id"]).collect()]
        assert rows == sorted(rows)
        mixed = [r.id for r in flow.randomize(df.repartition(n), 3, "id").collect()]
        assert sorted(mixed) == list(range(500)) and mixed != sorted(mixed)
        if n == 1:
            first = mixed
    assert first == mixed
    assert flow.combinations(4, 2) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
