"""Mixing sources to target weights, in DataFrame and SQL functions only.

1. Tokens (words between ASCII white space, or a column of counts) are summed by source; shares are p.
2. Weights are p**alpha, normalised.  alpha in [0, 1] is bisected: the largest one whose weights reach a target entropy
   (entropy falls as alpha grows), or the smallest one that repeats no source more than a limit (repetition of the
   smallest source falls as alpha grows).
3. A source's budget is its weight times the total budget.  It is met by epochs: whole passes over its documents and a last
   part of one.  Each epoch has its own permutation, a hash of (seed, epoch, document).  The permutation is cut into blocks of
   equal hash width; whole blocks are taken while they fit, and documents of the next block while those fit.

No step gathers a source: budgets need sums by source, the last part of an epoch sums by (source, coarse block), then by
(source, fine block) within the one coarse block where the budget ends, then ranks the documents of the one fine block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Stored

#: A mix is set by source; more sources than this raise an error, so the weights fit one row.
MAX_SOURCES = 1 << 16
BISECTIONS = 60
COARSE, FINE = 256, 256


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def order_hash(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The document's place in an epoch's permutation: the first 32 bits of an MD5 of (seed, epoch, id), as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string"))), 1, 8), 16, 10).cast("long")


def source_weights(tokens: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None) -> DataFrame:
    """One row per source: source, tokens, weight, alpha, budget (tokens to draw), from tokens (source, tokens).

    target_entropy: a share of the highest possible entropy, ln(number of sources with tokens), in 0 .. 1.
    max_repeats: no source is drawn more than so many times its tokens.  One of the two is to be given.
    budget: tokens in all; those of the corpus if None.  If even alpha = 1 misses a repetition limit (a budget beyond the
    limit times the corpus), alpha is 1; if alpha = 1 reaches the entropy already, it stays 1.  Sources without tokens have
    weight and budget 0.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give either target_entropy or max_repeats")
    used = tokens.filter("tokens > 0")
    row = used.limit(MAX_SOURCES + 1).agg(F.array_sort(F.collect_list(F.struct(F.col("tokens"), F.col("source")))).alias("all"))
    row = row.withColumn("all", F.when(F.size("all") > MAX_SOURCES, F.raise_error(F.lit("too many sources"))).otherwise(F.col("all")))
    row = row.withColumn("total", F.expr("aggregate(all, 0L, (a, x) -> a + x.tokens)"))
    row = row.withColumn("p", F.expr("transform(all, x -> x.tokens / cast(total AS double))"))
    row = row.withColumn("draw", F.lit(budget).cast("long") if budget is not None else F.col("total"))
    z = "aggregate(p, 0D, (a, x) -> a + pow(x, {m}))"
    if target_entropy is not None:
        # H = ln Z - alpha * sum(p**alpha ln p) / Z
        entropy = f"(ln({z}) - {{m}} * aggregate(p, 0D, (a, x) -> a + pow(x, {{m}}) * ln(x)) / {z})"
        low_side = f"{entropy} >= {float(target_entropy)!r}D * ln(cast(size(p) AS double))"
    else:
        low_side = f"draw * pow(element_at(p, 1), {{m}}) / {z} > {float(max_repeats)!r}D * element_at(all, 1).tokens"
    mid = "((s.lo + s.hi) / 2D)"
    test = low_side.format(m=mid)
    step = f"named_struct('lo', IF({test}, {mid}, s.lo), 'hi', IF({test}, s.hi, {mid}))"
    ends = f"aggregate(sequence(1, {BISECTIONS}), named_struct('lo', 0D, 'hi', 1D), (s, i) -> {step})"
    at_one = low_side.format(m="1D")
    row = row.withColumn("alpha", F.expr(f"CASE WHEN {at_one} THEN 1D ELSE ({ends}).{'lo' if target_entropy is not None else 'hi'} END"))
    row = row.withColumn("z", F.expr("aggregate(p, 0D, (a, x) -> a + pow(x, alpha))"))
    out = row.select("alpha", "z", "draw", "total", F.explode("all").alias("x"))
    weight = F.pow(F.col("x.tokens") / F.col("total").cast("double"), F.col("alpha")) / F.col("z")
    out = out.select(F.col("x.source").alias("source"), F.col("x.tokens").alias("tokens"), weight.alias("weight"), "alpha", F.floor(weight * F.col("draw")).cast("long").alias("budget"))
    idle = tokens.filter("tokens = 0").select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(None).cast("double").alias("alpha"), F.lit(0).cast("long").alias("budget"))
    return out.unionByName(idle)


def _cut(rows: DataFrame, by: list[str], unit: str, need: str) -> tuple[DataFrame, DataFrame]:
    """Of sums by (by, unit): the first unit that doesn't fit, with what is left for it, and the sums before."""
    sums = rows.groupBy(*by, need, unit).agg(F.sum("tokens").alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy(*by).orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before)
    return sums.filter((F.col("before") <= F.col(need)) & (F.col("before") + F.col("tokens") > F.col(need))).select(*by, F.col(unit).alias("edge"), (F.col(need) - F.col("before")).alias("left"))


def mix_sources(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None, seed: int = 7, text: str = "text", key: str = "doc_id", source: str = "source", n_tokens: str | None = None) -> DataFrame:
    """One row per document and epoch that draws it: doc_id, source, n_tokens, epoch, block, place.

    Reading a source's rows by (epoch, block, place, doc_id) is its shuffled stream; block is a range of the epoch's
    permutation, place the document's hash in it.  Documents without words (null, empty or blank texts) are drawn with
    their block in every epoch, at no cost; so is every document of a source without words, never (budget 0).  A null
    source is a source of its own.  Ties of `place` are taken by doc_id, and rows that repeat a doc_id stand for
    themselves.  A budget that ends within a document leaves that document out, so a source stays under its budget by less
    than its longest document.  An empty table gives no rows; other columns are ignored.  Tokens are words between ASCII white
    space, or what the column `n_tokens` says where it is given (token_counts makes one); null and negative counts are 0.
    """
    size = word_count(text) if n_tokens is None else F.greatest(F.coalesce(F.col(n_tokens).cast("long"), F.lit(0)), F.lit(0))
    base = Stored(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("n_tokens")), "counts")
    tokens = base.df.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    weights = Stored(source_weights(tokens, target_entropy, max_repeats, budget).filter("budget > 0").select("source", "tokens", "budget"), "weights")
    plan = weights.df.select(
        F.col("source").alias("s"),
        F.floor(F.col("budget") / F.col("tokens")).cast("long").alias("whole"),
        F.pmod("budget", "tokens").cast("long").alias("rest"),
    )
    rows = base.df.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("s"))).drop("s")  # one row a source, at most MAX_SOURCES
    width = 32
    first, second = F.shiftrightunsigned("place", width - 8).cast("int"), F.shiftrightunsigned("place", width - 16).bitwiseAND(F.lit(FINE - 1)).cast("int")
    full = rows.filter("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1))).withColumn("place", order_hash(seed, F.col("epoch"), F.col("doc_id"))).withColumn("block", first)
    full = full.select("doc_id", "source", "n_tokens", "epoch", "block", "place")
    last = rows.filter("rest > 0").withColumn("epoch", F.col("whole")).withColumn("place", order_hash(seed, F.col("epoch"), F.col("doc_id")))
    last = Stored(last.select("doc_id", "source", F.col("n_tokens").alias("tokens"), "epoch", "rest", "place", first.alias("block"), second.alias("fine")), "last")
    key_of = lambda edges, n: F.broadcast(edges.select(F.col("source").alias("s"), F.col("edge").alias(f"edge{n}"), F.col("left").alias(f"left{n}")))
    same = F.col("source").eqNullSafe(F.col("s"))
    coarse = Stored(_cut(last.df, ["source"], "block", "rest"), "coarse").df
    marked = last.df.join(key_of(coarse, 1), same).drop("s")
    within = marked.filter("block = edge1")
    fine = Stored(_cut(within, ["source"], "fine", "left1"), "fine").df
    marked = marked.join(key_of(fine, 2), same).drop("s")
    edge = marked.filter("block = edge1 AND fine = edge2")
    order = Window.partitionBy("source").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    ends = edge.withColumn("upto", F.sum("tokens").over(order)).filter("upto <= left2")
    before = marked.filter("block < edge1 OR (block = edge1 AND fine < edge2)")
    names = ["doc_id", "source", F.col("tokens").alias("n_tokens"), "epoch", "block", "place"]
    return full.unionByName(before.select(*names)).unionByName(ends.select(*names))


ORACLE_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
src AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM docs GROUP BY source HAVING sum(n_tokens) > 0),
ordered AS (SELECT list(tokens ORDER BY tokens, source NULLS FIRST) AS t, CAST(sum(tokens) AS BIGINT) AS total FROM src),
shares AS (SELECT list_transform(t, lambda x: x / CAST(total AS DOUBLE)) AS p, total FROM ordered),
bisect(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN h >= goal THEN mid ELSE lo END, CASE WHEN h >= goal THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, mid, {target} * ln(len(p)::DOUBLE) AS goal,
          ln(list_sum(list_transform(p, lambda x: pow(x, mid)))) - mid * list_sum(list_transform(p, lambda x: pow(x, mid) * ln(x))) / list_sum(list_transform(p, lambda x: pow(x, mid))) AS h
        FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid FROM bisect WHERE i < 60) b, shares)),
alpha AS (SELECT CASE WHEN -list_sum(list_transform(p, lambda x: x * ln(x))) >= {target} * ln(len(p)::DOUBLE) THEN 1.0::DOUBLE ELSE (SELECT lo FROM bisect WHERE i = 60) END AS a,
          p, total FROM shares),
plan AS (SELECT source, tokens, CAST(floor(pow(tokens / CAST(total AS DOUBLE), a) / list_sum(list_transform(p, lambda x: pow(x, a))) * total) AS BIGINT) AS budget FROM src, alpha),
epochs AS (SELECT d.doc_id, d.source, d.n_tokens, unnest(range(0, CAST(budget // tokens AS BIGINT) + 1)) AS epoch, budget // tokens AS whole, budget % tokens AS rest
           FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source WHERE budget > 0),
placed AS (SELECT *, ('0x' || substr(md5('{seed}:' || epoch || ':' || doc_id), 1, 8))::BIGINT AS place FROM epochs),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY place, doc_id) AS upto FROM placed)
SELECT doc_id, source, n_tokens, CAST(epoch AS BIGINT) AS epoch, CAST(place >> 24 AS INTEGER) AS block, place
FROM summed WHERE epoch < whole OR (epoch = whole AND upto <= rest)"""
