"""Quality classification by co-training (Blum and Mitchell, 1998) on a text view and a metadata view.

Both classifiers are naive Bayes over hashed features, so that training is counting and counts of all
documents add up in any order.  The text view has a document's distinct words, its distinct
word shapes (classes of the first and last character, length) and how much it repeats itself; the metadata view has its source,
language and shape (length, lines, mean length of lines and words), no words.  In each round one pass over all
documents scores them by both views; a document of which one view is confident is counted, with that view's label, for
the other.  Scores are calibrated (Platt) and combined by logistic regression on labelled documents that no
count has seen.

Labels come from a bounded sample: the `max_labels` labelled documents with the smallest hash of their id, half to
count and half to calibrate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .counts import SCHEMA, emit, gather

MAX_LABELS = 8192
TEXT_BITS, META_BITS = 18, 14
#: Copies of the repetition feature in a text's mean, beside its words and shapes.
SHAPE_WEIGHT = 8
#: Classes of bytes for word shapes: lower case, upper case, digit, other characters of ASCII by themselves, the rest.
CLASS = np.array([0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b >= 128 else 4 + b % 32 for b in range(256)], dtype=np.int64)


def _hash_of(value: str) -> int:
    h = 14695981039346656037
    for b in value.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 1099511628211 % (1 << 64)
    return int(tc.mix64(np.array([h], dtype=tc.U64))[0])


class Views:
    """Feature cells of a block: (document rows, cells) by view."""

    def __init__(self, batch: pa.RecordBatch):
        words = tc.space_words(batch.column("text"))
        n = batch.num_rows
        rows = np.repeat(np.arange(n), words.counts)
        key = np.unique((words.hashes() >> tc.U64(64 - TEXT_BITS)).astype(np.int64) + (rows << TEXT_BITS))  # each word once a document
        shape = CLASS[words.body[words.starts]] * 4096 + CLASS[words.body[words.ends - 1]] * 64 + np.minimum(words.ends - words.starts, 63)
        repeats = np.floor(20 * np.bincount(key >> TEXT_BITS, minlength=n) / np.maximum(words.counts, 1)).astype(np.int64) + (1 << 20)
        kind = np.concatenate([shape, np.repeat(repeats, SHAPE_WEIGHT)])
        of = np.concatenate([rows, np.repeat(np.arange(n), SHAPE_WEIGHT)])
        kind[len(shape) :] += np.tile(np.arange(SHAPE_WEIGHT) << 24, n)
        cell = (tc.mix64(kind.astype(tc.U64) + tc.U64(77)) >> tc.U64(64 - TEXT_BITS)).astype(np.int64)
        key = np.concatenate([key, np.unique(cell + (of << TEXT_BITS))])
        self.text = key >> TEXT_BITS, key & ((1 << TEXT_BITS) - 1)
        size = np.diff(words.offsets)
        lines = np.add.reduceat(np.append(words.body == 10, False), np.minimum(words.offsets[:-1], len(words.body))) * (size > 0) + 1
        letters = np.zeros(n)
        some = words.counts > 0
        letters[some] = np.add.reduceat(words.ends - words.starts, words.first[:-1][some]) / words.counts[some]
        log = lambda x: np.floor(2 * np.log2(np.maximum(x, 1))).astype(int)
        shape = [log(size), log(lines), log(size / lines), np.floor(2 * letters).astype(int)]
        names = [[f"source={s}" for s in batch.column("source").to_pylist()], [f"lang={s}" for s in batch.column("lang").to_pylist()], *[[f"{k}={v}" for v in x.tolist()] for k, x in zip(("size", "lines", "line", "word"), shape, strict=True)]]
        known = {v: _hash_of(v) >> (64 - META_BITS) for column in names for v in set(column)}
        self.meta = np.repeat(np.arange(n), len(names)), np.array([[known[v] for v in row] for row in zip(*names, strict=True)], dtype=np.int64).ravel()
        self.n = n


class View:
    """Naive Bayes: the log-odds of quality from counts by cell of good and bad documents."""

    def __init__(self, good: np.ndarray, bad: np.ndarray, n_good: int, n_bad: int):
        self.weights = np.log((good + 0.5) / (n_good + 1.0)) - np.log((bad + 0.5) / (n_bad + 1.0))
        unseen = (good + bad) < 2  # a word met once tells of its document only
        self.weights[unseen] = 0.0
        self.a, self.b = 1.0, 0.0

    def raw(self, features: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
        """Mean log-odds of a document's features; 0 without any."""
        rows, cells = features
        total = np.bincount(rows, weights=self.weights[cells], minlength=n)
        return total / np.maximum(np.bincount(rows, minlength=n), 1)

    def logit(self, features: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
        return self.a * self.raw(features, n) + self.b


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Coefficients and intercept of a logistic regression, by Newton's method."""
    scale = np.maximum(x.std(axis=0), 1e-9) if len(x) else np.ones(x.shape[1])
    z = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = ridge * np.eye(len(w)) * max(1, len(x)) / 100
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w)), z.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    w[:-1] /= scale
    return w


class State:
    """What a pass needs: both views, who is labelled, and how sure a view must be."""

    def __init__(self, labels: dict[int, int], confident: float):
        self.train = {i: y for i, y in labels.items() if tc.mix64(np.array([i & (2**64 - 1)], dtype=tc.U64))[0] & tc.U64(1)}
        self.held = {i: y for i, y in labels.items() if i not in self.train}
        self.views: dict[str, View] | None = None
        self.mix = np.array([1.0, 1.0, 0.0])
        self.margin = float(np.log(confident / (1 - confident)))


TABLES = {f"{v}_{c}": 1 << b for v, b in (("text", TEXT_BITS), ("meta", META_BITS)) for c in ("good", "bad")} | {"n": 4}


def _count(batches, state: State):
    """Counts by view and class: true labels for both views, confident labels of each view for the other."""
    tables = {name: np.zeros(size, dtype=np.int64) for name, size in TABLES.items()}
    for block in tc.blocks(batches, "text"):
        views = Views(block)
        ids = block.column("doc_id").to_pylist()
        true = np.array([state.train.get(i, -1) for i in ids])
        free = np.array([i not in state.train and i not in state.held for i in ids])
        give = {"text": true.copy(), "meta": true.copy()}
        if state.views:
            for view, other in (("text", "meta"), ("meta", "text")):
                logit = state.views[view].logit(getattr(views, view), views.n)
                give[other][free & (logit >= state.margin)] = 1
                give[other][free & (logit <= -state.margin)] = 0
        for v, (name, label) in enumerate(give.items()):
            rows, cells = getattr(views, name)
            for c, y in (("good", 1), ("bad", 0)):
                mine = label == y
                tables["n"][2 * v + (1 - y)] += int(mine.sum())
                np.add.at(tables[f"{name}_{c}"], cells[mine[rows]], 1)
    yield from emit(tables)


def _held_scores(batches, state: State):
    for block in tc.blocks(batches, "text"):
        views = Views(block)
        yield pa.record_batch([block.column("doc_id"), *[pa.array(state.views[v].raw(getattr(views, v), views.n)) for v in ("text", "meta")]], names=["doc_id", "text", "meta"])


def _predict(batches, state: State):
    for block in tc.blocks(batches, "text"):
        views = Views(block)
        t, m = (state.views[v].logit(getattr(views, v), views.n) for v in ("text", "meta"))
        squash = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
        score = squash(state.mix[0] * t + state.mix[1] * m + state.mix[2])
        yield pa.record_batch([block.column("doc_id"), pa.array(squash(t)), pa.array(squash(m)), pa.array(score), pa.array(score >= 0.5)], names=["doc_id", "p_text", "p_meta", "score", "good"])


def fit_cotraining(docs: DataFrame, labels: DataFrame, rounds: int = 2, confident: float = 0.998, max_labels: int = MAX_LABELS) -> State:
    """docs: doc_id, text, lang, source; labels: doc_id, quality (0/1; other values and nulls are ignored; of several the largest counts)."""
    spark = docs.sparkSession
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = chosen.orderBy(F.xxhash64(F.lit("labels"), "doc_id"), "doc_id").limit(max_labels).collect()  # bounded by max_labels
    state = State({r["doc_id"]: int(r["quality"]) for r in sample}, confident)
    ids = spark.createDataFrame([(r["doc_id"],) for r in sample], "id long")
    known = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).drop("id")
    for turn in range(rounds + 1):
        now = spark.sparkContext.broadcast(state)
        t = gather((docs if turn else known).mapInArrow(lambda it, now=now: _count(it, now.value), SCHEMA), TABLES)
        n = t["n"]
        state.views = {v: View(t[f"{v}_good"], t[f"{v}_bad"], int(n[2 * i]), int(n[2 * i + 1])) for i, v in enumerate(("text", "meta"))}
        _calibrate(known, state)
    return state


def _calibrate(known: DataFrame, state: State) -> None:
    now = known.sparkSession.sparkContext.broadcast(state)
    scores = known.mapInArrow(lambda it: _held_scores(it, now.value), "doc_id long, text double, meta double")
    rows = scores.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("meta").alias("meta")).collect()  # one row a labelled id, so max_labels at most
    rows = sorted((r["doc_id"], r["text"], r["meta"]) for r in rows if r["doc_id"] in state.held)
    y = np.array([state.held[r[0]] for r in rows], dtype=float)
    raw = np.array([r[1:] for r in rows], dtype=float).reshape(-1, 2)
    if len(set(y.tolist())) < 2:
        return  # nothing to calibrate on: log-odds as they are
    for i, v in enumerate(("text", "meta")):
        state.views[v].a, state.views[v].b = logistic(raw[:, i : i + 1], y)
    logits = np.column_stack([state.views[v].a * raw[:, i] + state.views[v].b for i, v in enumerate(("text", "meta"))])
    state.mix = logistic(logits, y)


def score_quality(docs: DataFrame, labels: DataFrame, rounds: int = 2, confident: float = 0.998, max_labels: int = MAX_LABELS, text: str = "text", key: str = "doc_id", source: str = "source", lang: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, p_text, p_meta (calibrated views), score (both combined), good (score >= 0.5).

    Whole texts are read.  Null, empty and wordless texts are scored by their metadata and the text view's prior; null
    sources and languages are values of their own.  Repeated rows get equal scores and count as often as they stand.  Without
    labels every score is 0.5; with labels of one class only, views aren't calibrated.  An empty table gives no rows; other columns are ignored.
    """
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"))
    state = docs.sparkSession.sparkContext.broadcast(fit_cotraining(base, labels, rounds, confident, max_labels))
    return base.mapInArrow(lambda it: _predict(it, state.value), "doc_id long, p_text double, p_meta double, score double, good boolean")
