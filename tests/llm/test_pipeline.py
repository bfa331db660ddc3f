"""The pipeline's stages on the smallest documents, against what each should keep."""

import os

import pytest

import corpus_pipeline
from seqframe.llm import decontaminate, exact_dedup, langid, minhash, queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert after.columns == docs.columns
            assert after.subtract(docs).count() == 0 and after.count() <= docs.count()
        kept[name] = {r.doc_id for r in after.collect()}
        docs = after
    assert len(kept["language"]) > 190
    assert kept["mix"] <= kept["decontaminate"] <= kept["near_dedup"] <= kept["exact_dedup"] <= kept["language"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, DIR).collect()} == kept["mix"]


def test_registered():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert [k.split("_")[0] for k in queries.QUERIES] == [*(f"op{n}" for n in range(1, 11)), "pipeline"]


ROWS = "doc_id long, text string, lang string, source string, n_chars long, `__gone` boolean, digest string, word long"


def _rows(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, None, "d", 1) for i, t, lang, s in rows], ROWS)


def _kept(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)


#: Stages that need no fitted model, as they are called.
DROPS = {
    "exact": exact_dedup.drop_exact_copies,
    "near": minhash.drop_near_copies,
    "clean": lambda d: decontaminate.drop_contaminated(d, d.sparkSession.createDataFrame([(1, "secret words"), (2, "other thing"), (3, None)], "item_id long, text string"), block_chars=10),
    "language": lambda d: langid.drop_rejected(d, {"en": b"some words", "de": b"ganz anders"}, min_margin=-1.0),
}


@pytest.mark.parametrize("name", sorted(DROPS))
def test_stages_on_nothing_and_on_columns_of_any_name(spark, name):
    empty = _rows(spark, [])
    assert DROPS[name](empty).collect() == [] and DROPS[name](empty).columns == empty.columns
    docs = _rows(spark, [(1, "a few words of text here", "en", "s"), (None, "a second text that stays whole", None, None), (1, "one more text, of the same id", "de", "t")])
    assert _kept(DROPS[name](docs)) == _kept(docs) and DROPS[name](docs).schema == docs.schema


def test_exact_keeps_one_row_of_each_text(spark):
    docs = _rows(spark, [(1, "a", None, "x"), (5, "A", None, "x"), (1, "unique", None, "x"), (7, "q", None, "x"), (7, "q", None, "x"), (None, "q", None, "x"), (7, "Q", None, "y"), (2, None, None, "x"), (3, "", None, "x"), (None, "lone", None, "x"), (9, "z" * 3_000_000, None, "x"), (8, "z" * 2_999_999 + "Z", None, "x")])
    kept = _kept(DROPS["exact"](docs))
    assert sorted((t or "").lower()[:9] for _, t, _ in kept) == ["", "a", "lone", "q", "unique", "zzzzzzzzz"]
    assert {(i, (t or "")[:9]) for i, t, _ in kept} >= {(5, "A"), (1, "unique"), (3, ""), (None, "lone"), (9, "zzzzzzzzz")} and [i for i, t, _ in kept if t and t.lower() == "q"] == [7]


def test_near_keeps_one_row_of_each_group(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*base[:k], "changed", *base[k + 1 :]])
    whole = " ".join(base)
    docs = _rows(spark, [(4, whole, None, "x"), (4, near(59), None, "x"), (None, near(0), None, "x"), (None, whole, None, "y"), (9, near(59), None, "x"), (4, "other text altogether, of six words", None, "x"), (5, None, None, "x"), (6, " ", None, "x"), (6, " ", None, "x"), (None, "two words", None, "z"), (None, "two words", None, "z")])
    kept = _kept(DROPS["near"](docs))
    grouped = [r for r in kept if r[1] and "w20" in r[1]]
    assert len(grouped) == 1 and grouped[0][0] == 4
    assert sorted(str(r[1])[:5] for r in kept) == sorted(["None", " ", " ", "other", "two w", grouped[0][1][:5]])


def test_contaminated_rows_go_whatever_their_id(spark):
    docs = _rows(spark, [(1, "has Secret, words", None, "x"), (1, "clean", None, "x"), (None, "clean", None, "x"), (None, "an OTHER thing", None, "x"), (2, None, None, "x"), (3, "secret thing", None, "x"), (4, "x " * 500_000 + "secret words", None, "x")])
    assert [(i, t) for i, t, _ in _kept(DROPS["clean"](docs))] == [(1, "clean"), (2, None), (3, "secret thing"), (None, "clean")]


def test_language_rejects_rows_whatever_their_id(spark):
    docs = _rows(spark, [(1, "123", None, "x"), (1, "letters", None, "x"), (None, None, None, "x"), (None, "letters too", None, "x"), (2, "½ ²", None, "x")])
    want = [(1, "letters"), (None, "letters too")]
    assert [(i, t) for i, t, _ in _kept(DROPS["language"](docs))] == want
    assert [(i, t) for i, t, _ in _kept(langid.drop_rejected(docs, {}))] == want


@pytest.mark.parametrize("block_chars", [1 << 20, 12])
def test_marks_are_by_row_whatever_the_blocks(spark, block_chars):
    items = spark.createDataFrame([(1, "secret words"), (2, "other thing"), (3, "w " * 12)], "item_id long, text string")
    docs = _rows(spark, [(1, "secret words", None, "x"), (1, "other thing", None, "x"), (None, "secret words here", None, "x"), (None, "other thing", None, "x"), (1, "secret words", None, "x"), (2, None, None, "x")])
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in decontaminate.mark_contamination(docs, items, block_chars=block_chars).collect())
    assert got == [("1", 2, 2, ["1"]), ("1", 2, 2, ["1"]), ("1", 2, 2, ["2"]), ("2", 0, 0, []), ("None", 2, 2, ["2"]), ("None", 3, 2, ["1"])]
