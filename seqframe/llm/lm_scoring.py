"""Language-model scoring by cross-entropy difference (Moore and Lewis, 2010).

Two bigram models are counted, of target documents and of all documents (the background), matched in
order, smoothing and vocabulary: both count the words and bigrams of all documents.
p(w | v) = (c(v, w) + k p(w)) / (c(v) + k), and p(w) = (c(w) + 1/2) / (N + V/2), V the number of distinct words.
A document's score is the mean over its words of the target loss less the background loss, in nats: the
lower, the more it reads like the target.

Counts cover every word of every document, one for each distinct word, context and bigram (by 63-bit hashes).  No table of them is
in one place: texts are stored as chunks of word codes, a chunk sends each of its distinct keys once, in sorted runs by segment of
the key space, to the task that sums the segment and sends the sums back in the same order, and the chunk then scores its documents.
The number of segments grows with the corpus, so that a segment stays small.  word_bits and pair_bits, where given, shorten the hashes,
and different words or bigrams then share counts; V is then 2**word_bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textcore as tc
from .counts import packed, unpacked
from .shared import Stored, with_membership

WHOLE = 63
CHUNK_BYTES = 8 << 20
#: Words of the corpus for each segment of the bigrams, and the least number of segments; words and contexts have a quarter.
SEGMENT_WORDS, LEAST_SEGMENTS = 1 << 22, 256
CONTEXT, WORD, PAIR, BODY = range(4)
KEYS = "part int, segment int, chunk long, n int, keys binary, every binary, target binary"
SUMS = "chunk long, part int, segment int, n int, every binary, target binary"


def cells(words: tc.Words, word_bits: int, pair_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context id, word id, pair cell) of each word; a document's first word has context 0, which no word has."""
    return _cells(words.hashes(), words.counts, word_bits, pair_bits)


def _cells(hashes: np.ndarray, counts: np.ndarray, word_bits: int, pair_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = (hashes >> tc.U64(64 - word_bits)).astype(np.int64)
    ids = np.maximum(ids, 1)
    before = np.zeros(len(hashes), dtype=tc.U64)
    before[1:] = hashes[:-1]
    context = np.zeros(len(ids), dtype=np.int64)
    context[1:] = ids[:-1]
    firsts = (np.cumsum(counts) - counts)[counts > 0]
    before[firsts], context[firsts] = 0, 0
    pair = tc.mix64(before * tc.U64(0x9E3779B97F4A7C15) ^ hashes) >> tc.U64(64 - pair_bits)
    return context, ids, pair.astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of texts of about `size` bytes, of several batches where those are small."""
    held, total = [], 0
    for block in tc.blocks(batches, "text", size):
        n = block.column("text").nbytes
        if held and total + n > size:
            yield pa.concat_batches(held)
            held, total = [], 0
        held.append(block)
        total += n
    if held:
        yield pa.concat_batches(held)


def _pack(batches, size: int):
    """A row for each chunk: its documents, its distinct words' hashes, commonest first, and every word as its place among those."""
    first = TaskContext.get().partitionId() << 32
    for i, block in enumerate(_chunks(batches, size)):
        words = tc.alnum_words(block.column("text"))
        counts = words.counts
        found, codes, times = np.unique(words.hashes(), return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        targets = block.column("is_target").to_numpy(zero_copy_only=False).astype(np.int64)
        ids = pa.ListArray.from_arrays(pa.array([0, block.num_rows], pa.int32()), block.column("doc_id"))
        row = [[first + i], ids, [int(counts.sum())], [int(counts[targets > 0].sum())], [len(found)], *([packed(x)] for x in (counts, targets, tc.signed(found[order]), place[codes]))]
        names = ["chunk", "ids", "n_words", "n_target", "n_distinct", "counts", "targets", "words", "codes"]
        kinds = [pa.int64(), None, pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
        yield pa.record_batch([x if k is None else pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=names)


def _unpack(row: dict, bits: tuple[int, int]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words of each document, keys of each word by part) of a chunk."""
    counts = unpacked(row["counts"], row["n_docs"])
    hashes = unpacked(row["words"], row["n_distinct"]).view(tc.U64)[unpacked(row["codes"], row["n_words"])]
    return counts, _cells(hashes, counts, *bits)


def _keys(batches, bits: tuple[int, int], segment_bits: tuple[int, int]):
    """Each chunk's distinct keys and their counts, by part and segment."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            counts, keys = _unpack(row, bits)
            mine = np.repeat(unpacked(row["targets"], row["n_docs"]) > 0, counts)
            for part, of_words in enumerate(keys):
                if not len(of_words):
                    continue
                wide = part == PAIR
                found, at = np.unique(of_words, return_inverse=True)
                every, target = np.bincount(at), np.bincount(at[mine], minlength=len(found))
                segments = found >> max(0, bits[wide] - segment_bits[wide])
                cuts = [0, *(np.flatnonzero(np.diff(segments)) + 1).tolist(), len(found)]
                rows = [(part, int(segments[a]), row["chunk"], b - a, packed(np.diff(found[a:b], prepend=0)), packed(every[a:b]), packed(target[a:b])) for a, b in zip(cuts, cuts[1:])]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3), strict=True)], names=["part", "segment", "chunk", "n", "keys", "every", "target"])
    tc.give_back()


def _sum_segments(batches):
    """For each chunk the sums over all chunks, in the order of its keys; a row of chunk -1 tells the number of distinct keys."""

    def one(key, rows):
        keys = np.concatenate([np.cumsum(unpacked(r["keys"], r["n"])) for r in rows])
        found, at = np.unique(keys, return_inverse=True)
        sums = []
        for name in ("every", "target"):
            total = np.zeros(len(found), dtype=np.int64)
            np.add.at(total, at, np.concatenate([unpacked(r[name], r["n"]) for r in rows]))
            sums.append(total[at])
        ends = np.cumsum([r["n"] for r in rows]).tolist()
        out = [(r["chunk"], *key, r["n"], *(packed(x[e - r["n"] : e]) for x in sums)) for r, e in zip(rows, ends, strict=True)]
        out.append((-1, *key, len(found), None, None))
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), *[pa.int32()] * 3, pa.binary(), pa.binary()), strict=True)], names=["chunk", "part", "segment", "n", "every", "target"])

    key, rows = None, []
    for batch in batches:
        for row in _rows(batch):
            if (row["part"], row["segment"]) != key:
                if rows:
                    yield one(key, rows)
                key, rows = (row["part"], row["segment"]), []
            rows.append(row)
    if rows:
        yield one(key, rows)
    tc.give_back()


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for at in range(0, batch.num_rows, 64):
        yield from batch.slice(at, 64).to_pylist()


def _losses(context: np.ndarray, word: np.ndarray, pair: np.ndarray, total: int, vocabulary: int, strength: float) -> np.ndarray:
    unigram = (word + 0.5) / (total + 0.5 * vocabulary) * strength
    return np.log(context + strength) - np.log(pair + unigram)


def _score(batches, bits: tuple[int, int], totals: tuple[int, int], vocabulary: int, strength: float, kind: pa.DataType):
    """Rows come by chunk, sums before the chunk itself."""
    sums = {}
    for batch in batches:
        for i, part in enumerate(batch.column("part").to_pylist()):
            row = batch.slice(i, 1)
            if part != BODY:
                n = row.column("n")[0].as_py()
                for name in ("every", "target"):
                    sums.setdefault((name, part), []).append(unpacked(row.column(name)[0].as_py(), n))
                continue
            counts, keys = _unpack(row.select(["n_docs", "n_words", "n_distinct", "counts", "words", "codes"]).to_pylist()[0], bits)
            some = counts > 0
            means = [np.zeros(len(counts)), np.zeros(len(counts))]
            if some.any():
                places = [np.unique(k, return_inverse=True)[1] for k in keys]
                starts = (np.cumsum(counts) - counts)[some]
                for mean, name, total in zip(means, ("target", "every"), totals, strict=True):
                    losses = _losses(*(np.concatenate(sums[name, p])[at] for p, at in enumerate(places)), total, vocabulary, strength)
                    mean[some] = np.add.reduceat(losses, starts) / counts[some]
            sums = {}
            ids = row.column("ids").flatten().cast(kind)
            columns = [means[0], means[1], means[0] - means[1]]
            yield pa.record_batch([ids, pa.array(counts.astype(np.int64)), *[pa.array(c, mask=~some) for c in columns]], names=["doc_id", "n_tokens", "ce_target", "ce_background", "ce_diff"])
    tc.give_back()


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, word_bits: int | None = None, pair_bits: int | None = None, strength: float = 8.0, text: str = "text", key: str = "doc_id", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ce_target, ce_background, ce_diff.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z.  Null, empty and wordless texts have 0 tokens and null
    losses.  Repeated rows count as often as they stand; target ids that are null or of no document are ignored; without target
    documents the target model is the uniform one.  An empty table gives no rows; other columns are ignored.  Target documents are told by
    bitmaps of fixed size, so no text is shuffled for that.
    """
    base = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    id_type = base.schema["doc_id"].dataType.simpleString()
    bits = (word_bits or WHOLE, pair_bits or WHOLE)
    told = with_membership(base, target_ids, "doc_id", "is_target").select("doc_id", "text", "is_target")
    schema = f"chunk long, ids array<{id_type}>, n_words long, n_target long, n_distinct int, counts binary, targets binary, words binary, codes binary"
    chunks = Stored(told.mapInArrow(lambda it: _pack(it, chunk_bytes), schema), "chunks").df.withColumn("n_docs", F.size("ids"))
    n, n_target = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_target"), F.lit(0))).first()
    wide = (max(LEAST_SEGMENTS, n // SEGMENT_WORDS) - 1).bit_length()
    runs = chunks.select("chunk", "n_docs", "n_words", "n_distinct", "counts", "targets", "words", "codes").mapInArrow(lambda it: _keys(it, bits, (wide - 2, wide)), KEYS)
    sums = Stored(runs.repartition("part", "segment").sortWithinPartitions("part", "segment").mapInArrow(_sum_segments, SUMS), "sums").df
    vocabulary = 2**word_bits if word_bits else sums.filter(f"chunk = -1 AND part = {WORD}").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bodies = chunks.select("chunk", F.lit(BODY).alias("part"), F.lit(0).alias("segment"), "ids", "n_docs", "n_words", "n_distinct", "counts", "words", "codes")
    both = sums.filter("chunk >= 0").unionByName(bodies, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", "part", "segment")
    kind = to_arrow_type(base.schema["doc_id"].dataType)
    out = f"doc_id {id_type}, n_tokens long, ce_target double, ce_background double, ce_diff double"
    return both.mapInArrow(lambda it: _score(it, bits, (n_target, n), vocabulary, strength, kind), out)
