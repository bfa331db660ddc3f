"""Benchmark decontamination with an FM-index for each shard of the training documents.

A shard is a bounded slice of the documents that one task reads.  Its words become symbols: a word
of the benchmark has its own, every stretch of other words (and every document border) is a
separator.  Stretches of benchmark words shorter than the shortest test phrase cannot hold one and
are left out.  The index has the Burrows-Wheeler transform of the symbols as a wavelet tree and every
8th suffix position; test phrases are searched backwards through wavelet ranks, occurrences are
located from the sampled positions, and their word ranges are merged into removal spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .shared import Stored

SAMPLE_STEP = 8
#: Text of a shard; a longer document is a shard of its own.
SHARD_BYTES = 4 << 20


class WaveletTree:
    """Ranks over a sequence of symbols < 2**bits, level by level from the highest bit (a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[np.ndarray, int]] = []
        now = symbols
        for bit in range(bits - 1, -1, -1):
            ones = ((now >> bit) & 1).astype(bool)
            count = np.zeros(len(now) + 1, dtype=np.int32)
            np.cumsum(ones, out=count[1:])
            zeros = len(now) - int(count[-1])
            self.levels.append((count, zeros))
            now = np.concatenate([now[~ones], now[ones]])
        self.bits = bits
        self.start = np.zeros(1 << bits, dtype=np.int64)  # where each symbol's run begins in the last level
        values, where = np.unique(now, return_index=True)
        self.start[values] = where

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[i] before position at[i]."""
        at = at.astype(np.int64)
        for depth, (count, zeros) in enumerate(self.levels):
            one = ((symbol >> (self.bits - 1 - depth)) & 1).astype(bool)
            ones = count[at]
            at = np.where(one, zeros + ones, at - ones)
        return at - self.start[symbol]

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.int64)
        for count, zeros in self.levels:
            ones = count[at]
            one = count[at + 1] - ones
            out = (out << 1) | one
            at = np.where(one == 1, zeros + ones, at - ones)
        return out


class FMIndex:
    """Index of symbols (1 .. top) in stretches that zeros end; each zero is a separator smaller than all symbols, the earlier the smaller."""

    def __init__(self, text: np.ndarray, top: int):
        n = len(text)
        zero = text == 0
        separators = int(zero.sum())
        rank = text.astype(np.int64) + separators
        rank[zero] = np.arange(separators)
        width = 1
        while True:  # prefix doubling; separators are unique, so it ends once the longest stretch is covered
            after = np.zeros(n, dtype=np.int64)
            after[: n - width] = rank[width:] + 1
            key = rank * (n + top + 2) + after
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            fresh = np.empty(n, dtype=np.int64)
            step = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            fresh[order] = step
            rank, width = fresh, width * 2
            if int(step[-1]) == n - 1 or width > n:
                break
        self.separators, self.n = separators, n
        self.first = np.searchsorted(np.sort(text), np.arange(top + 2))  # rows whose suffix starts with each symbol
        self.tree = WaveletTree(text[order - 1], max(1, int(top).bit_length()))
        sampled = order % SAMPLE_STEP == 0
        self.sampled = np.zeros(n + 1, dtype=np.int32)
        np.cumsum(sampled, out=self.sampled[1:])
        self.positions = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each phrase; phrases: one row each, right-aligned."""
        lo, hi = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        width = phrases.shape[1]
        for back in range(1, width + 1):
            live = np.flatnonzero((lengths >= back) & (lo < hi))
            if not len(live):
                break
            symbol = phrases[live, width - back]
            lo[live] = self.first[symbol] + self.tree.rank(symbol, lo[live])
            hi[live] = self.first[symbol] + self.tree.rank(symbol, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the rows: steps back in the text until a sampled one. Rows are of symbols, and a
        separator before them ends the walk, since stretches begin at positions that are multiples of the step."""
        out, steps = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        left = np.arange(len(rows))
        rows = rows.astype(np.int64)
        while len(left):
            known = self.sampled[rows + 1] > self.sampled[rows]
            out[left[known]] = self.positions[self.sampled[rows[known]]] + steps[left[known]]
            left, rows = left[~known], rows[~known]
            if len(left):
                symbol = self.tree.access(rows)
                rows = self.first[symbol] + self.tree.rank(symbol, rows)
                steps[left] += 1
        return out


class Phrases:
    """Windows of the test items: `window` consecutive words, or the whole of a shorter item."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.window, rows, owner = window, [], []
        self.names = [str(i) for i, _ in items]
        words = tc.alnum_words(pa.array([t for _, t in items], pa.large_string()))
        hashes = words.hashes()
        self.vocab = np.unique(hashes)
        ids = np.searchsorted(self.vocab, hashes) + 1
        for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            for at in range(a, max(a + 1, b - window + 1) if b > a else a):
                rows.append(ids[at : min(at + window, b)])
                owner.append(i)
        padded = np.zeros((len(rows), window), dtype=np.int64)
        for row, r in zip(padded, rows, strict=True):
            row[window - len(r) :] = r
        self.phrases, which = np.unique(padded, axis=0, return_inverse=True) if rows else (padded, np.zeros(0, np.int64))
        self.lengths = (self.phrases > 0).sum(axis=1)
        self.shortest = int(self.lengths.min()) if rows else 0
        order = np.argsort(which.ravel(), kind="stable")
        self.owners = np.array(owner, dtype=np.int64)[order]  # items of each phrase, one phrase after the other
        self.owner_first = np.searchsorted(which.ravel()[order], np.arange(len(self.phrases) + 1))

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocab):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        return np.where(self.vocab[at] == hashes, at + 1, 0)


def occurrences(words: tc.Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(word index, phrase index) of each occurrence of a phrase in the shard."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbols = phrases.symbols(words.hashes())
    if not phrases.shortest or not len(symbols):
        return none
    known = symbols > 0
    starts, stops = known.copy(), known.copy()
    starts[1:] &= ~known[:-1]
    stops[:-1] &= ~known[1:]
    borders = words.first[(words.first > 0) & (words.first < len(symbols))]
    starts[borders] |= known[borders]
    stops[borders - 1] |= known[borders - 1]
    begin, end = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    long = end - begin >= phrases.shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return none
    # each stretch, then at least one separator, up to a multiple of the sampling step
    room = (end - begin + SAMPLE_STEP) // SAMPLE_STEP * SAMPLE_STEP
    at = np.concatenate([[0], np.cumsum(room)])
    text = np.zeros(int(at[-1]), dtype=np.int64)
    inner = np.arange(int((end - begin).sum())) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin)
    text[np.repeat(at[:-1], end - begin) + inner] = symbols[np.repeat(begin, end - begin) + inner]
    index = FMIndex(text, len(phrases.vocab))
    lo, hi = index.search(phrases.phrases, phrases.lengths)
    count = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(count)), count)
    if not len(which):
        return none
    rows = np.repeat(lo, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    place = index.locate(rows)
    stretch = np.searchsorted(at, place, side="right") - 1
    return begin[stretch] + place - at[stretch], which


def _scan(batches, phrases: Phrases, keep: list[str]):
    for block in tc.blocks(batches, "text", SHARD_BYTES):
        words = tc.alnum_words(block.column("text"))
        place, which = occurrences(words, phrases)
        doc = np.searchsorted(words.first, place, side="right") - 1
        spans: list[list] = [[] for _ in range(block.num_rows)]
        items: list[list[str]] = [[] for _ in range(block.num_rows)]
        hits = np.zeros(block.num_rows, dtype=np.int64)
        order = np.argsort(doc, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(doc[order], prepend=-1)), len(order)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            mine = order[a:b]
            d = int(doc[mine[0]])
            base, n = words.first[d], words.first[d + 1] - words.first[d]
            edge = np.zeros(n + 1, dtype=np.int64)
            np.add.at(edge, place[mine] - base, 1)
            np.add.at(edge, place[mine] - base + phrases.lengths[which[mine]], -1)
            merged = tc.spans_of(np.cumsum(edge[:-1]) > 0)
            hits[d] = int((merged[:, 1] - merged[:, 0]).sum())
            spans[d] = [{"first_word": x, "end_word": y, "start_byte": int(words.starts[base + x] - words.offsets[d]), "end_byte": int(words.ends[base + y - 1] - words.offsets[d])} for x, y in merged.tolist()]
            found = {o for p in np.unique(which[mine]).tolist() for o in phrases.owners[phrases.owner_first[p] : phrases.owner_first[p + 1]].tolist()}
            items[d] = sorted({phrases.names[i] for i in found})
        span_type = pa.list_(pa.struct([(n, pa.int32()) for n in ("first_word", "end_word", "start_byte", "end_byte")]))
        extra = [pa.array(words.counts.astype(np.int64)), pa.array(hits), pa.array(items, pa.list_(pa.string())), pa.array(spans, span_type)]
        yield pa.record_batch([block.column(c) for c in keep] + extra, names=[*keep, "n_words", "n_hit", "items", "spans"])


def _blocks(benchmark: DataFrame, block_chars: int, item_text: str, item_key: str) -> Iterator[list]:
    """The test items in blocks of at most block_chars characters, or of one longer item; at least one block."""
    batch, size = [], 0
    for r in benchmark.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).toLocalIterator():
        n = len(r["t"] or "")
        if batch and size + n > block_chars:
            yield batch
            batch, size = [], 0
        batch.append((r["i"], r["t"]))
        size += n
    yield batch


def mark_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = 4 << 20, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, items (ids as strings, sorted), spans (word and byte ranges to remove).

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z.  Null and empty texts have no words and no hits;
    items without words match nothing; items that repeat a text are all named.  Rows that repeat a doc_id, and rows without one, stand
    for themselves.  Empty tables give no rows, or rows without hits; other columns are ignored.  The benchmark is taken in blocks of at
    most block_chars characters (an item longer than that is a block of its own), one broadcast and one pass over docs each, so that no
    broadcast grows with its size; the passes' marks meet by doc_id and a hash of the text, and give the same rows as one pass would.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    spark, passes = docs.sparkSession, []
    spans = "array<struct<first_word:int,end_word:int,start_byte:int,end_byte:int>>"
    for block in _blocks(benchmark, block_chars, item_text, item_key):
        phrases = spark.sparkContext.broadcast(Phrases(block, window))
        keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
        schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, n_words long, n_hit long, items array<string>, spans {spans}"
        passes.append(keyed.mapInArrow(lambda it, p=phrases: _scan(it, p.value, ["doc_id", "h"]), schema))
    if len(passes) == 1:
        return passes[0].drop("h")
    return _merged(passes)


def _merged(passes: list[DataFrame]) -> DataFrame:
    """Marks of several blocks of the benchmark: items united, overlapping spans joined.

    Rows of one doc_id and text have one pass's marks in common, so each pass sends one of them and their number.
    """
    every = None
    for p in passes:
        one = p.groupBy("doc_id", "h").agg(F.count("*").alias("rows"), F.first("n_words").alias("n_words"), F.first("items").alias("items"), F.first("spans").alias("spans"))
        every = one if every is None else every.unionByName(one)
    spans = F.array_sort(F.flatten(F.collect_list("spans")))  # of as many rows as there are passes
    out = every.groupBy("doc_id", "h").agg(F.max("rows").alias("rows"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), spans.alias("spans"))
    joined = F.expr(
        "aggregate(spans, cast(array() as array<struct<first_word:int,end_word:int,start_byte:int,end_byte:int>>), (acc, s) -> "
        "CASE WHEN size(acc) > 0 AND element_at(acc, -1).end_word >= s.first_word THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct("
        "'first_word', element_at(acc, -1).first_word, 'end_word', greatest(element_at(acc, -1).end_word, s.end_word), "
        "'start_byte', element_at(acc, -1).start_byte, 'end_byte', greatest(element_at(acc, -1).end_byte, s.end_byte)))) "
        "ELSE concat(acc, array(s)) END)"
    )
    out = out.withColumn("spans", joined).withColumn("copy", F.explode(F.expr("sequence(1L, rows)")))
    return out.select("doc_id", "n_words", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end_word - s.first_word)").alias("n_hit"), "items", "spans")


def digest_items(marks: DataFrame) -> DataFrame:
    return marks.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items", "spans")


def _clean(phrases):
    """A column function: whether a text holds none of the broadcast phrases."""

    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            flags = [np.zeros(0, dtype=bool)]
            for part in tc.blocks(iter([pa.record_batch([column], names=["text"])]), "text", SHARD_BYTES):
                words = tc.alnum_words(part.column("text"))
                place, _ = occurrences(words, phrases.value)
                flags.append(np.ones(part.num_rows, dtype=bool))
                flags[-1][np.searchsorted(words.first, place, side="right") - 1] = False
            yield pa.array(np.concatenate(flags))

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = 4 << 20, text: str = "text", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """docs without the rows whose text holds a window of a benchmark item; its own columns.

    Each row is judged by its own text in the task that reads it, block of the benchmark after block, so nothing is joined and doc_ids
    don't matter.  Null and empty texts stay, as do all texts if the benchmark is empty; repeated rows share their fate, columns of any
    name pass through, an empty table gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    for i, block in enumerate(_blocks(benchmark, block_chars, item_text, item_key)):
        if i:  # one pass at a time, so that a task holds one block's phrases
            docs = Stored(docs, "clean").df
        docs = docs.filter(_clean(sc.broadcast(Phrases(block, window)))(F.col(f"`{text}`")))
    return docs
