"""Substring deduplication by relative Lempel-Ziv parsing.

The corpus is its own reference, cut into blocks.  A text's symbols are its windows of `window` words, one for each word that a
window starts at, so a match of n symbols is a match of n + window - 1 words, and shorter ones don't show.  A block is
indexed by a suffix array over the symbols, and its documents are parsed against it greedily: a factor is the longest stretch that
also starts at an earlier place (smaller doc_id, or same document and earlier start), found between a suffix's nearest earlier
neighbours on both sides in the array.  The parse goes on with the first window that the factor doesn't hold whole, so the windows
across a factor's border are looked up like all others.  The words of factors are the words to remove.

1. A task parses each block of documents that it reads against that block.  Only the first copy of a window in the block
   goes on, so a passage that all documents share is one row a block.
2. What goes on is parsed against reference blocks made of other blocks' first copies.  A document meets those that can
   match it, and no others: among the `gram`-word grams of a window the one with the smallest hash is its anchor, equal windows
   have equal anchors, and a stretch of windows goes to the block of its anchor.  Anchors that the corpus holds once go nowhere
   (told by a bitmap of bounded size).  A stretch under an anchor that it holds more than `hot` times goes window by window,
   first to blocks by window and salt and from there, one row a salt, to the block of the window; so no block grows
   beyond hot stretches of one anchor or the copies of one window, which are dropped as they are met.
3. Spans are joined by doc_id and a hash of the text, and kept words are hashed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .shared import Stored, bits_for, bitmap, with_maybe

BLOCK_BYTES = 4 << 20
#: Windows that a reference block of the second parse is filled up to; salts of a hot window; the widest bitmap of anchors (8 MB).
REFERENCE_WINDOWS, SALTS, MAX_BITS = 1 << 18, 64, 26
_SPREAD = tc.U64(0x9E3779B97F4A7C15)


def window_anchors(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window, hash of its anchor) for one sequence of word hashes."""
    grams = tc.window_hashes(words, gram)
    width = window - gram + 1
    n = len(words) - window + 1
    low, span = grams, 1
    while span * 2 <= width:  # minima over power-of-two spans, then over the whole width
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[width - span : width - span + n])
    return tc.window_hashes(words, window), low


#: Vector rounds of _nearest_smaller before what is left is settled by a stack.
JUMPS = 24


def _nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one to its left with a smaller value, or -1.

    Most places need a few jumps over places known to be no smaller.  Orders that rise and then fall would need one jump a
    place each, so after JUMPS rounds one pass with a stack, in time linear in the places, settles the rest.
    """
    cur = np.arange(len(values)) - 1
    todo = np.arange(len(values))
    for _ in range(JUMPS):
        at = cur[todo]
        todo = todo[(at >= 0) & (values[np.maximum(at, 0)] >= values[todo])]
        if not len(todo):
            return cur
        cur[todo] = cur[cur[todo]]
    every, out, stack = values.tolist(), [], []
    for i, v in enumerate(every):
        while stack and every[stack[-1]] >= v:
            stack.pop()
        out.append(stack[-1] if stack else -1)
        stack.append(i)
    return np.array(out, dtype=np.int64)


class SuffixArray:
    """Suffixes of a sequence of symbols in order, with ranks by their first 1, 2, 4, ... symbols."""

    def __init__(self, symbols: np.ndarray):
        self.n = n = len(symbols)
        found, rank = np.unique(symbols, return_inverse=True)
        self.ranks, width = [rank.astype(np.int32)], 1
        while len(found) < n:
            after = np.zeros(n, dtype=np.int64)
            after[: n - width] = rank[width:] + 1
            found, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
            self.ranks.append(rank.astype(np.int32))
            width *= 2
        self.order = np.empty(n, dtype=np.int64)
        self.order[rank] = np.arange(n)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at a[i] and b[i] have in common; 0 where b[i] is -1."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
        live = np.flatnonzero(b >= 0)
        for level in range(len(self.ranks) - 1, -1, -1):
            live = live[(a[live] < self.n) & (b[live] < self.n)]
            same = live[self.ranks[level][a[live]] == self.ranks[level][b[live]]]
            a[same] += 1 << level
            b[same] += 1 << level
            total[same] += 1 << level
        return total

    def longest_earlier(self, when: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, place) of the longest match of each suffix among those with a smaller `when`; 0 and -1 without one."""
        sides = []
        for row in (self.order, self.order[::-1]):
            near = _nearest_smaller(when[row])
            place = np.empty(self.n, dtype=np.int64)
            place[row] = np.where(near >= 0, row[np.maximum(near, 0)], -1)
            sides.append((self.common(np.arange(self.n), place), place))
        (one, at_one), (two, at_two) = sides
        length = np.maximum(one, two)
        return length, np.where(length == 0, -1, np.where(one >= two, at_one, at_two))


def greedy(length: np.ndarray) -> np.ndarray:
    """First places of the factors of a greedy parse, given the longest match at each place; places without one are literals."""
    some = np.flatnonzero(length)
    out, at = [], 0
    while True:
        k = int(np.searchsorted(some, at))
        if k == len(some):
            return np.array(out, dtype=np.int64)
        out.append(int(some[k]))
        at = out[-1] + int(length[out[-1]])


def parse(windows: np.ndarray, text: np.ndarray, start: np.ndarray, when: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Factors of texts against the block that they are in: (rows where a factor starts, its windows, rows of its source), and which rows are of a factor.

    A row is a window: its hash, its text, its start there, and when it stands (ties: neither is earlier).  Rows of a text
    come in order of start.  Windows that the block holds once match nothing and are left out of the index.
    """
    n = len(windows)
    none = np.zeros(0, dtype=np.int64)
    found, symbol, count = np.unique(windows, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[symbol] > 1)
    if not len(at):
        return none, none, none, np.zeros(n, dtype=bool)
    ends = np.ones(len(at), dtype=bool)  # a separator, like no other, follows each stretch
    ends[:-1] = (np.diff(at) != 1) | (text[at[1:]] != text[at[:-1]]) | (start[at[1:]] != start[at[:-1]] + 1)
    to = np.arange(len(at)) + np.cumsum(ends) - ends
    size = len(at) + int(ends.sum())
    symbols, times = len(found) + np.arange(size), np.full(size, np.iinfo(np.int64).max)
    symbols[to], times[to] = symbol[at], when[at]
    length, source = SuffixArray(symbols).longest_earlier(times)
    begin = greedy(length)
    back = np.full(size, -1)
    back[to] = at
    covered = np.zeros(n, dtype=bool)
    covered[back[to[length[to] > 0]]] = True
    return back[begin], length[begin], back[source[begin]], covered


def _ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense ranks of the pairs (first, second), equal pairs alike."""
    order = np.lexsort((second, first))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def _flagged(flags: np.ndarray, keys: np.ndarray) -> np.ndarray:
    spot = (keys * _SPREAD) >> tc.U64(64 - 3 - int(len(flags)).bit_length() + 1)
    return (flags[(spot >> tc.U64(3)).astype(np.int64)] >> (spot & tc.U64(7)).astype(np.uint8)) & 1 == 1


class Block:
    """The windows of a block of documents: hash, anchor, document row, start (in words)."""

    def __init__(self, batch: pa.RecordBatch, window: int, gram: int):
        self.words = tc.space_words(batch.column("text"))
        hashes = self.words.hashes()
        n = len(hashes)
        self.window = window
        if n < window:
            self.hash = self.anchor = np.zeros(0, tc.U64)
            self.doc = self.start = np.zeros(0, np.int64)
            return
        whole, anchors = window_anchors(hashes, window, gram)
        doc = np.repeat(np.arange(batch.num_rows), self.words.counts)
        inside = doc[: n - window + 1] == doc[window - 1 :]  # the window lies in one document
        at = np.flatnonzero(inside)
        self.hash, self.anchor, self.doc = whole[at], anchors[at], doc[at]
        self.start = at - self.words.first[self.doc]


def _anchor_counts(batches, window: int, gram: int):
    for part in tc.blocks(batches, "text"):
        block = Block(part, window, gram)
        # one count for each run of windows with one anchor, that is for each place where the anchor stands
        if len(block.anchor):
            new = np.ones(len(block.anchor), dtype=bool)
            new[1:] = (block.anchor[1:] != block.anchor[:-1]) | (block.doc[1:] != block.doc[:-1])
            anchors, counts = np.unique(block.anchor[new], return_counts=True)
            yield pa.record_batch([pa.array(tc.signed(anchors)), pa.array(counts)], names=["anchor", "n"])


def _joined(spans: np.ndarray, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching spans of one owner as one, sorted by owner and start, and their owners."""
    owner = np.zeros(len(spans), dtype=np.int64) if owner is None else owner.astype(np.int64)
    if not len(spans):
        return spans.reshape(0, 2).astype(np.int32), owner
    order = np.lexsort((spans[:, 1], spans[:, 0], owner))
    owner, begin, end = owner[order], spans[order, 0].astype(np.int64), spans[order, 1].astype(np.int64)
    shift = owner * (int(end.max()) + 2)  # each owner has places of its own
    reach = np.maximum.accumulate(end + shift)
    new = np.ones(len(order), dtype=bool)
    new[1:] = (begin + shift)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return np.stack([begin[first], np.maximum.reduceat(end, first)], axis=1).astype(np.int32), owner[first]


ROWS = "route long, salt int, doc_id long, h long, start int, items binary"
_KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())


def _batch(columns: list[list]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=["route", "salt", "doc_id", "h", "start", "items"])


def _span_rows(out: list[list], texts: np.ndarray, begin: np.ndarray, words: np.ndarray, ids: np.ndarray, h: np.ndarray) -> None:
    """Appends a row without a route for each text: the spans of its factors."""
    spans, owner = _joined(np.stack([begin, begin + words], axis=1), texts)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    body, cuts, mine = spans.tobytes(), [*first.tolist(), len(owner)], owner[first]
    out[0] += [None] * len(first)
    out[1] += [0] * len(first)
    out[2] += ids[mine].tolist()
    out[3] += h[mine].tolist()
    out[4] += [0] * len(first)
    out[5] += [body[8 * a : 8 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _parse_blocks(batches, window: int, gram: int, again: np.ndarray, hot: np.ndarray):
    """Rows without a route: spans of factors within the block.  Rows with one: stretches of first copies that may occur elsewhere."""
    for part in tc.blocks(batches, "text", BLOCK_BYTES):
        block = Block(part, window, gram)
        if not len(block.hash):
            continue
        ids, h = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "h"))
        begin, length, _, covered = parse(block.hash, block.doc, block.start, _ranks(ids[block.doc], block.start))
        out: list[list] = [[] for _ in _KINDS]
        _span_rows(out, block.doc[begin], block.start[begin], length + window - 1, ids, h)
        at = np.flatnonzero(~covered & _flagged(again, block.anchor))
        if len(at):
            alone = _flagged(hot, block.anchor[at])
            new = np.ones(len(at), dtype=bool)  # a row for each run of neighbouring windows with one anchor, or for each window
            new[1:] = (np.diff(at) != 1) | (block.anchor[at[1:]] != block.anchor[at[:-1]]) | (block.doc[at[1:]] != block.doc[at[:-1]]) | alone[1:]
            first = np.flatnonzero(new)
            cuts = np.append(first, len(at)).tolist()
            route = np.where(alone[first], block.hash[at[first]] * _SPREAD, block.anchor[at[first]])
            salt = np.where(alone[first], 1 + (ids[block.doc[at[first]]].view(tc.U64) * _SPREAD >> tc.U64(33)).astype(np.int64) % SALTS, 0)
            body = block.hash[at].tobytes()
            out[0] += tc.signed(route).tolist()
            out[1] += salt.tolist()
            out[2] += ids[block.doc[at[first]]].tolist()
            out[3] += h[block.doc[at[first]]].tolist()
            out[4] += block.start[at[first]].tolist()
            out[5] += [body[8 * a : 8 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if out[0]:
            yield _batch(out)


class Reference:
    """The stretches of one or more whole routes, and of a route that goes on the first copies met so far."""

    def __init__(self, window: int):
        self.window, self.rows, self.held = window, [], 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.held += len(row[5]) // 8

    def parsed(self, out: list[list], known: int) -> list[tuple]:
        """Parses the rows but the first `known`, which are there as a source only; returns the rows with windows that stand nowhere earlier."""
        body = np.frombuffer(b"".join(r[5] for r in self.rows), dtype=tc.U64)
        sizes = np.array([len(r[5]) // 8 for r in self.rows])
        text = np.repeat(np.arange(len(self.rows)), sizes)
        ids, h, start = (np.array([r[c] for r in self.rows], dtype=np.int64) for c in (2, 3, 4))
        at = start[text] + np.arange(len(body)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        begin, length, _, covered = parse(body, text, at, _ranks(ids[text], at))
        mine = text[begin] >= known
        begin, length = begin[mine], length[mine]
        _span_rows(out, text[begin], at[begin], length + self.window - 1, ids, h)
        fresh = np.unique(text[~covered])
        rows, self.rows, self.held = [self.rows[i] for i in fresh.tolist()], [], 0
        return rows


def _meet(batches, window: int, size: int):
    """Rows sorted by route, salt, doc_id, start: spans, and of salted routes the rows with first copies, for the next meeting."""
    block, route, known = Reference(window), None, 0
    for batch in batches:
        out: list[list] = [[] for _ in _KINDS]

        def flush(goes_on: bool, out=out):
            nonlocal known
            fresh = block.parsed(out, known) if block.rows else []
            for r in fresh if not goes_on else ():
                if r[1]:
                    for column, x in zip(out, (r[0], 0, *r[2:]), strict=True):
                        column.append(x)
            known = 0
            if goes_on:
                for r in fresh:
                    if r[:2] == route:
                        block.add(r)
                    elif r[1]:
                        for column, x in zip(out, (r[0], 0, *r[2:]), strict=True):
                            column.append(x)
                known = len(block.rows)

        for row in zip(*(batch.column(c).to_pylist() for c in ("route", "salt", "doc_id", "h", "start", "items")), strict=True):
            if block.held >= size:
                flush(row[:2] == route)
            route = row[:2]
            block.add(row)
        yield _batch(out)
    out = [[] for _ in _KINDS]
    if block.rows:
        for r in block.parsed(out, known):
            if r[1]:
                for column, x in zip(out, (r[0], 0, *r[2:]), strict=True):
                    column.append(x)
    yield _batch(out)
    tc.give_back()


def _cut(batches):
    """Kept words of each document, given its spans."""
    for block in tc.blocks(batches, "text"):
        words = tc.space_words(block.column("text"))
        body, starts, ends = words.body.tobytes(), words.starts, words.ends
        removed, digests, merged = [], [], []
        lists = block.column("spans").to_pylist() if "spans" in block.schema.names else [None] * block.num_rows
        for a, b, spans in zip(words.first[:-1].tolist(), words.first[1:].tolist(), lists, strict=True):
            keep = np.ones(b - a, dtype=bool)
            every = _joined(np.frombuffer(b"".join(spans or ()), dtype=np.int32).reshape(-1, 2))[0]
            for s, e in every.tolist():
                keep[s:e] = False
            kept = np.flatnonzero(keep) + a
            text = b" ".join([body[s:e] for s, e in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True)])
            removed.append(b - a - len(kept))
            digests.append(hashlib.sha256(text).hexdigest())
            merged.append([{"start": s, "end": e} for s, e in every.tolist()])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.record_batch([block.column("doc_id"), pa.array(words.counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(merged, kind)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits of the column `anchor`."""

    def pack(batches):
        flags = np.zeros(1 << (bits - 3), dtype=np.uint8)
        for b in batches:
            spot = (b.column("anchor").to_numpy(zero_copy_only=False).view(tc.U64) * _SPREAD) >> tc.U64(64 - bits)
            np.bitwise_or.at(flags, (spot >> tc.U64(3)).astype(np.int64), np.left_shift(np.uint8(1), (spot & tc.U64(7)).astype(np.uint8)))
        words = flags.view(np.int64)
        at = np.flatnonzero(words)
        yield pa.record_batch([pa.array(at), pa.array(words[at])], names=["word", "flags"])

    flags = np.zeros(1 << (bits - 6), dtype=np.int64)
    table = keys.select("anchor").mapInArrow(pack, "word long, flags long").groupBy("word").agg(F.bit_or("flags").alias("flags")).toArrow()
    flags[table.column("word").to_numpy()] = table.column("flags").to_numpy()
    return flags.view(np.uint8)


def _anchors(base: DataFrame, window: int, gram: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the anchors that occur twice or more, and of those that occur more than `hot` times: 16 bits a key, 8 MB at most."""
    counts = base.mapInArrow(lambda it: _anchor_counts(it, window, gram), "anchor long, n long")
    again = Stored(counts.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor", (F.col("n") > hot).alias("hot")), "anchors")
    n, n_hot = again.df.agg(F.count("*"), F.count_if("hot")).first()
    out = tuple(_bitmap(df, min(MAX_BITS, max(bits_for(m), (16 * m).bit_length()))) for df, m in ((again.df, n), (again.df.filter("hot"), n_hot)))
    again.drop()
    return out


def substring_dedup(docs: DataFrame, window: int = 20, gram: int = 7, hot: int = 1024, text: str = "text", key: str = "doc_id", reference_windows: int = REFERENCE_WINDOWS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, spans (word ranges removed).

    Words are runs of other bytes than ASCII white space, unchanged.  A word goes if a window of `window` words
    that covers it also starts earlier; windows are judged on the input.  Null, empty and short texts have no windows
    and lose nothing; of equal texts the smallest doc_id stays whole.  doc_id must be an integer.  Rows that repeat a doc_id count as
    one document: of equal windows those at its smallest start stay in all of them, so rows that repeat doc_id and text all stay.
    Rows without a doc_id keep all words and are no one's source.  An empty table gives no rows; other columns are ignored.  Words and
    windows are compared by 64-bit hashes.
    """
    sc = docs.sparkSession.sparkContext
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    named = base.filter("doc_id IS NOT NULL")
    again, often = map(sc.broadcast, _anchors(named, window, gram, hot))
    rows = Stored(named.mapInArrow(lambda it: _parse_blocks(it, window, gram, again.value, often.value), ROWS), "stretches")
    first = rows.df.filter("route IS NOT NULL").repartition("route", "salt").sortWithinPartitions("route", "salt", "doc_id", "start")
    met = Stored(first.mapInArrow(lambda it: _meet(it, window, reference_windows), ROWS), "met")
    second = met.df.filter("route IS NOT NULL").repartition("route").sortWithinPartitions("route", "doc_id", "start")
    second = second.mapInArrow(lambda it: _meet(it, window, reference_windows), ROWS)
    every = rows.df.filter("route IS NULL").unionByName(met.df.filter("route IS NULL")).unionByName(second)
    spans = Stored(every.groupBy("doc_id", "h").agg(F.collect_set("items").alias("spans")), "spans")
    rows.drop()
    met.drop()
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>"
    bits = bits_for(spans.df.count())
    marked = with_maybe(base, bitmap(spans.df, "doc_id", "h", bits=bits), "doc_id", "h", bits=bits)
    whole = marked.filter("NOT maybe").select("doc_id", "text").mapInArrow(_cut, schema)
    cut = marked.filter("maybe").join(spans.df, ["doc_id", "h"], "left").select("doc_id", "text", "spans").mapInArrow(_cut, schema)
    return whole.unionByName(cut)
