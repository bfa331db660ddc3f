"""Language identification by compression: zstandard with a raw-content dictionary for each language.

A text is cut into pieces of bounded length; each piece is compressed once with each language's
dictionary, and the language whose dictionary leaves the fewest bytes over the whole text wins.  The margin
is the saving against the runner-up as a share of the best size; a text with a narrower margin than
`min_margin` is rejected.

The dictionaries are fitted on a bounded sample of rows: of each language's labelled documents of `longest` characters at most,
the `slots` documents that win a slot by smallest hash of their id, each with its whole text.  zstandard reaches back over the
whole of a dictionary that its window covers, and the window is set to hold the largest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc

#: Limits of the fitted model: at most SLOTS texts of LONGEST_CHARS characters a language reach the driver.  Every text is compressed
#: once a language, so a column of more values than MAX_LANGUAGES is taken for no column of languages and raises an error.
MAX_LANGUAGES, SLOTS, LONGEST_CHARS = 512, 96, 2048
#: Short matches count in prose, which the levels' own settings pass over.
ZSTD = {"compression_level": 3, "strategy": zstandard.STRATEGY_GREEDY, "min_match": 4, "window_log": 20, "hash_log": 16, "chain_log": 16, "search_log": 3}
_FOLD = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def folded(text: str) -> bytes:
    """Lower case, with one space for each run of ASCII characters that aren't letters; a text of other characters alone stays as it is."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split())


def fit_dictionaries(docs: DataFrame, slots: int = SLOTS, longest: int = LONGEST_CHARS, text: str = "text", key: str = "doc_id", lang: str = "lang") -> dict[str, bytes]:
    """Raw-content dictionaries by language; rows with a null id, text or language are left out, as are texts over `longest`
    characters, unless a language has no other: then its shortest text stands for it.

    Each language's documents are dealt to slots by a hash of the id, and the smallest hash in a slot wins:
    a partial aggregate of one long a slot, whatever the number of rows.  Rows that repeat an id count once.
    """
    own = F.xxhash64(F.lit("dictionary"), F.col(key))
    rows = docs.filter(F.col(key).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), own.alias("h"), F.length(text).alias("size"), F.col(text).alias("text"))
    fits = F.when(F.col("size") <= longest, F.col("h"))
    picks = rows.groupBy("lang", F.pmod("h", F.lit(slots)).alias("slot")).agg(F.min(fits).alias("h"), F.min(F.struct("size", "h")).alias("least"))
    picks = picks.limit(MAX_LANGUAGES * slots + 1).collect()
    if len({p["lang"] for p in picks}) > MAX_LANGUAGES or len(picks) > MAX_LANGUAGES * slots:
        raise ValueError(f"more than {MAX_LANGUAGES} languages are labelled")
    chosen = {(p["lang"], p["h"]) for p in picks if p["h"] is not None}
    for lone in {p["lang"] for p in picks} - {name for name, _ in chosen}:
        chosen.add((lone, min(tuple(p["least"]) for p in picks if p["lang"] == lone)[1]))
    if not chosen:
        return {}
    ids = docs.sparkSession.createDataFrame(sorted(chosen), "lang string, h long")
    sample = rows.join(F.broadcast(ids), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    found: dict[str, dict[int, str]] = {}
    for r in sample.orderBy("lang", "h").collect():  # one row a language and slot
        found.setdefault(r["lang"], {})[r["h"]] = r["text"]
    return {k: b" ".join(folded(t) for t in v.values()) for k, v in sorted(found.items())}


class Compressors:
    """One compressor a language, of one worker."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)
        self.each = []
        for body in dictionaries.values():
            how = zstandard.ZstdCompressionParameters(**ZSTD)
            d = zstandard.ZstdCompressionDict(body.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.each.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))

    def sizes(self, text: bytes, piece: int) -> np.ndarray:
        out = np.zeros(len(self.each))
        cuts = [*range(0, len(text), piece), len(text)]
        for a, b in pairwise(cuts):
            part = text[a:b]
            for i, c in enumerate(self.each):
                out[i] += len(c.compress(part))
        return out


def classify(text: str | None, models: Compressors, piece: int, min_margin: float) -> tuple[str, float, float, bool]:
    """(language, score, margin, rejected) of a text; the score is the margin."""
    if text is None or not any(map(str.isalpha, text)):
        return "und", 0.0, 0.0, True
    if not models.names:
        return "und", 0.0, 0.0, False
    sizes = models.sizes(folded(text), piece)
    order = np.argsort(sizes, kind="stable")  # ties go to the language whose name sorts first, and have no margin
    if len(order) == 1:
        return models.names[0], 1.0, 1.0, False
    best, second = float(sizes[order[0]]), float(sizes[order[1]])
    margin = (second - best) / second
    return models.names[order[0]], margin, margin, margin < min_margin


def _label(batches, dictionaries: dict[str, bytes], piece: int, min_margin: float):
    models = Compressors(dictionaries)
    for block in tc.blocks(batches, "text"):
        got = [classify(t, models, piece, min_margin) for t in block.column("text").to_pylist()]
        names, scores, margins, rejected = zip(*got, strict=True)
        yield pa.record_batch([block.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "margin", "rejected"])


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes], piece_bytes: int = 8192, min_margin: float = 0.002, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score, margin, rejected.

    The whole text is compressed, in pieces of piece_bytes.  Null texts and texts without a letter (any script)
    are `und` with score 0 and rejected; where no language was learned, the others are `und` too but not rejected.  With one
    language learned everything else is that one with score 1.  Repeated rows get equal results; an empty table gives no rows; other columns are not read.
    """
    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, lang_pred string, score double, margin double, rejected boolean"
    model = docs.sparkSession.sparkContext.broadcast(dictionaries)  # SLOTS texts of LONGEST_CHARS a language
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lambda it: _label(it, model.value, piece_bytes, min_margin), schema)


def drop_rejected(docs: DataFrame, dictionaries: dict[str, bytes], piece_bytes: int = 8192, min_margin: float = 0.002, text: str = "text") -> DataFrame:
    """docs without the rows that language identification rejects; its own columns.

    Each row is judged by its own text in the task that reads it, so nothing is joined and doc_ids don't matter: null texts and
    texts without a letter go, repeated rows share their fate, columns of any name pass through, an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(dictionaries)

    @F.arrow_udf("boolean")
    def clear(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        models = Compressors(model.value)
        for column in texts:
            out = [not classify(t.as_py(), models, piece_bytes, min_margin)[3] for t in column]
            tc.give_back()
            yield pa.array(out, pa.bool_())

    return docs.filter(clear(F.col(f"`{text}`")))


def held_out(key: str = "doc_id"):
    """crc32 of the id as text modulo 4 is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))
