"""Token counts by offset-mapped attribution: a document is encoded once, and its tokens are joined to sections by character spans.

The tokens of a byte-level vocabulary spell the text, so their byte lengths give each token's span; spans are mapped to
characters, where a token that holds part of a character spans that character.  Sections are intervals of characters
that cut the document up; the join is a merge of two sorted interval lists.  A token that crosses a border goes by the rule:
`start` (the section of its first character), `end` (of its last), `majority` (most of its characters; ties go to the earlier
section).
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc

#: Runs of white space from this length on are cut out before the split pattern sees them, as its look-ahead gives up near 10^6 characters.
LONG_RUN = 1 << 16
#: Fixed value: white space as the pattern has it.
_LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)
RULES = ("start", "end", "majority")
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that the public byte-level vocabularies were made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """A vocabulary of byte ranks (lines of base64 token and rank), with its tokens' lengths."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.long_runs = pattern == PATTERN  # what the cut relies on; another pattern sees the whole text
        self.lengths = np.zeros(max(table.values()) + 1, dtype=np.int64)
        for token, rank in table.items():
            self.lengths[rank] = len(token)

    def ids(self, text: str) -> np.ndarray:
        """Tokens of the text. A long run of white space is one piece to the pattern, but for its last character if a text follows,
        so the three parts are encoded on their own and the tokens stay the same."""
        parts, at = [], 0
        for run in _LONG_SPACE.finditer(text) if self.long_runs else ():
            end = run.end() if run.end() == len(text) else run.end() - 1
            parts.append(self.encoding.encode_to_numpy(text[at : run.start()], disallowed_special=()))
            parts.append(np.array(self.encoding._core_bpe.encode_single_piece(text[run.start() : end].encode()), dtype=np.uint32))
            at = end
        parts.append(self.encoding.encode_to_numpy(text[at:], disallowed_special=()))
        return np.concatenate(parts).astype(np.int64)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token ids, first characters, ends in characters)."""
        ids = self.ids(text)
        body = np.frombuffer(text.encode(), dtype=np.uint8)
        ends = np.cumsum(self.lengths[ids])
        char = np.cumsum((body & 0xC0) != 0x80) - 1
        return ids, char[ends - self.lengths[ids]], char[ends - 1] + 1


def attribute(first: np.ndarray, end: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """(tokens of each section, tokens that cross a border); section i is [borders[i], borders[i + 1]), and none is empty."""
    a = np.searchsorted(borders, first, side="right") - 1
    b = np.searchsorted(borders, end - 1, side="right") - 1
    crossing = a != b
    to = a if rule == "start" else b if rule == "end" else a.copy()
    if rule == "majority":
        for t in np.flatnonzero(crossing).tolist():
            cuts = np.clip(borders[a[t] : b[t] + 2], first[t], end[t])
            to[t] = a[t] + int(np.argmax(np.diff(cuts)))
    return np.bincount(to, minlength=len(borders) - 1), int(crossing.sum())


def line_borders(text: str) -> np.ndarray:
    """Sections are lines, each with the line feed that ends it."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    cuts = np.flatnonzero(code == 10) + 1
    return np.unique(np.concatenate([[0], cuts, [len(code)]]))


def _attribute(batches, ranks: bytes, pattern: str, rule: str, fields: list[str] | None):
    encoder = Encoder(ranks, pattern)
    for block in tc.blocks(batches, "text" if fields is None else fields[0]):
        columns = [block.column(c).to_pylist() for c in (fields or ["text"])]
        n_tokens, sections, crossings = [], [], []
        for parts in zip(*columns, strict=True):
            parts = [p or "" for p in parts]
            whole = "\n".join(parts)
            if fields is None:
                borders, shown = line_borders(whole), None
            else:  # each field with the line feed that parts it from the next
                borders = np.concatenate([[0], np.cumsum([len(p) + (i < len(parts) - 1) for i, p in enumerate(parts)])])
                shown = np.diff(borders) > 0
                borders = np.unique(borders)
            if not whole:
                n_tokens.append(0)
                sections.append([0] * len(parts) if fields else [])
                crossings.append(0)
                continue
            ids, first, end = encoder.spans(whole)
            counts, crossed = attribute(first, end, borders, rule)
            if shown is not None:
                full = np.zeros(len(parts), dtype=np.int64)
                full[shown] = counts
                counts = full
            n_tokens.append(len(ids))
            sections.append(counts.tolist())
            crossings.append(crossed)
        yield pa.record_batch([block.column("doc_id"), pa.array(n_tokens, pa.int64()), pa.array(crossings, pa.int64()), pa.array(sections, pa.list_(pa.int64()))], names=["doc_id", "n_tokens", "n_crossing", "section_tokens"])


def token_counts(docs: DataFrame, rule: str = "majority", fields: list[str] | None = None, ranks_path: str = DEFAULT_RANKS, pattern: str = PATTERN, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_crossing, section_tokens (tokens of each section in order; their sum is n_tokens).

    Without `fields` the sections are the lines of the text, each with its line feed; with it, the document is those columns
    joined by line feeds, and each is a section with the line feed behind it.  Null counts as the empty text; an empty
    document has no tokens and, by lines, no sections.  Repeated rows get equal results; an empty table gives no rows; other
    columns are not read.  The vocabulary is read by the driver from ranks_path and sent to the tasks (about 1 MB).
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    chosen = [F.col(text).alias("text")] if fields is None else [F.col(c).cast("string").alias(f"field{i}") for i, c in enumerate(fields)]
    names = None if fields is None else [f"field{i}" for i in range(len(fields))]
    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, n_tokens long, n_crossing long, section_tokens array<long>"
    return docs.select(F.col(key).alias("doc_id"), *chosen).mapInArrow(lambda it: _attribute(it, ranks.value, pattern, rule, names), schema)
