"""Round trips and errors of readers and writers, random access, streams and kept steps."""

import bz2
import gzip
import random

import pytest
from pyspark.sql import functions as F

from seqframe.functions import hashing
from seqframe.plans.pipeline import run_step
from seqframe.sources import reads as src
from seqframe.streaming import reads as stream


def _records(n=500, seed=3):
    rng = random.Random(seed)
    return [(i, f"read {i} x", "".join(rng.choice("ACGTN") for _ in range(k)), "".join(chr(33 + rng.randrange(41)) for _ in range(k))) for i, k in ((i, rng.randrange(1, 60)) for i in range(n))]


def _text(records):
    return "".join(f"@{d}\n{s}\n+\n{q}\n" for _, d, s, q in records)


@pytest.mark.parametrize("kind", ["plain", "gz", "bz2"])
def test_fastq_scan(spark, tmp_path, kind):
    records = _records()
    path = tmp_path / f"a.fastq{'' if kind == 'plain' else '.' + kind}"
    data = _text(records).encode()
    path.write_bytes({"plain": bytes, "gz": gzip.compress, "bz2": bz2.compress}[kind](data))
    got = src.read_fastq(spark, str(path), 33).orderBy("read_id").collect()
    assert [(r.read_id, r.description, r.seq, r.qual) for r in got] == [(i, d, s, [ord(c) - 33 for c in q]) for i, d, s, q in records]


def test_fastq_over_many_splits(spark, tmp_path):
    records = _records(3000, 4)
    (tmp_path / "a.fastq").write_text(_text(records))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = src.read_fastq(spark, str(tmp_path / "a.fastq"), 33).orderBy("read_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r.read_id, r.description, r.seq) for r in got] == [(i, d, s) for i, d, s, _ in records]


@pytest.mark.parametrize("text, message", [("x\nA\n+\nI\n", "start with @"), ("@x\nA\n-\nI\n", r"\+ line"), ("@x\nAC\n+\nI\n", "differ in length"), ("@x\nA\n+\n", "truncated"), ("@x\nA\r\n+\nII\n", "carriage")])
def test_fastq_errors(spark, tmp_path, text, message):
    (tmp_path / "a.fastq").write_bytes(text.encode())
    with pytest.raises(Exception, match=message):
        src.read_fastq(spark, str(tmp_path / "a.fastq"), 33).collect()


def test_fastq_write_and_pairs(spark, tmp_path):
    records = _records(100)
    (tmp_path / "a.fastq").write_text(_text(records))
    df = src.read_fastq(spark, str(tmp_path / "a.fastq"), 33)
    src.write_fastq(df, str(tmp_path / "out"))
    lines = "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / "out").glob("part-*")) if p.stat().st_size)
    assert lines + "\n" == _text(records)
    (tmp_path / "b.fastq").write_text(_text(records[:-1]))
    pair = src.read_paired_fastq(spark, str(tmp_path / "a.fastq"), str(tmp_path / "a.fastq"), offset=33)
    assert pair.filter("r1_seq = r2_seq").count() == 100
    src.write_paired_fastq(pair, str(tmp_path / "o1"), str(tmp_path / "o2"))
    assert sorted(p.read_text() for p in (tmp_path / "o1").glob("part-*")) == sorted(p.read_text() for p in (tmp_path / "o2").glob("part-*"))
    with pytest.raises(Exception, match="different lengths"):
        src.read_paired_fastq(spark, str(tmp_path / "a.fastq"), str(tmp_path / "b.fastq"), offset=33).collect()


def test_wildcards_and_quality_guess(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@x\nAC.N\n+\nhhhh\n")
    assert src.guess_quality_offset(spark, str(tmp_path / "a.fastq")) == 64
    r = src.read_fastq(spark, str(tmp_path / "a.fastq"), replace_wildcards=True).first()
    assert r.seq[:2] == "AC" and set(r.seq) <= set("ACGT") and r.qual == [40, 40, 0, 0]
    assert hashing.wildcards_to_letters("ANNRC", 5) == hashing.wildcards_to_letters("ANNRC", 5)
    assert hashing.draw_letter("R", 9) in "AG"


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nacgt ac\ngt\n>two\n\n>three|t3\nAAA\n")
    fa = src.read_fasta(spark, str(tmp_path / "a.fa"))
    assert [tuple(r) for r in fa.orderBy("id").collect()] == [(0, "one first", "acgtacgt"), (1, "two", ""), (2, "three|t3", "AAA")]
    assert src.lookup(fa, "t3").first().seq == "AAA"
    with pytest.raises(Exception, match="several records"):
        src.lookup(fa.withColumn("description", F.lit("same")), "same").collect()
    assert src.fasta_as_reads(fa).filter("read_id = 2").first().qual == [34, 34, 34]
    src.write_fasta(fa, str(tmp_path / "out"), width=3)
    back = src.read_fasta(spark, str(tmp_path / "out" / "part-*"))
    assert sorted(r.seq for r in back.collect()) == ["", "AAA", "acgtacgt"]
    assert ">one first\nacg\ntac\ngt\n" in "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    (tmp_path / "bad.fa").write_text("ACGT\n")
    with pytest.raises(Exception, match="start with >"):
        src.read_fasta(spark, str(tmp_path / "bad.fa")).collect()


def test_random_access_and_regions(spark, tmp_path):
    rng = random.Random(2)
    seqs = {i: "".join(rng.choice("ACGT") for _ in range(100)) for i in range(5)}
    fa = spark.createDataFrame([(i, f"s{i}", s) for i, s in seqs.items()], src.FASTA_SCHEMA)
    src.write_reads(fa, str(tmp_path / "p"), order="id")
    assert src.take(spark, str(tmp_path / "p"), 3, order="id").first().seq == seqs[3]
    want = spark.createDataFrame([(1, 5, 40, False), (2, 30, 64, True), (4, 7, 8, False)], "ref_id long, lower int, upper int, reversed boolean")
    got = {r.ref_id: r.seq for r in src.regions(src.chunked(fa, 16), want, 16).collect()}
    rc = seqs[2][30:64][::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert got == {1: seqs[1][5:40], 2: rc, 4: seqs[4][7:8]}
    with pytest.raises(Exception, match="outside"):
        src.regions(src.chunked(fa, 16), spark.createDataFrame([(1, 90, 120, False)], want.schema), 16).collect()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    records = _records(50)
    (tmp_path / "in" / "a.fastq").write_text(_text(records))
    reads = stream.stream_fastq(spark, str(tmp_path / "in"))
    q = reads.writeStream.format("memory").queryName("got").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.seq for r in spark.table("got").collect()) == sorted(s for _, _, s, _ in records)
    h = stream.running_histogram(stream.stream_fastq(spark, str(tmp_path / "in")).select(F.length("seq").cast("double").alias("n")), "n", [0.0, 20.0, 100.0])
    q = h.writeStream.format("memory").queryName("bins").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r.bin: r.n for r in spark.table("bins").collect()} == {0: sum(len(s) <= 20 for _, _, s, _ in records), 1: sum(len(s) > 20 for _, _, s, _ in records)}


def test_kept_steps(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    step = lambda: spark.read.parquet(str(tmp_path / "in")).filter("id > 1")
    args = (spark, str(tmp_path / "out"), [str(tmp_path / "in")])
    assert run_step(*args, {"a": 1}, step)[1] is True
    again, ran = run_step(*args, {"a": 1}, step)
    assert (ran, again.count()) == (False, 3)
    assert run_step(*args, {"a": 2}, step)[1] is True


def test_hash_values():
    assert hashing.fnv(b"", 32) == 0x811C9DC5 and hashing.fnv(b"a", 32) == 0xE40C292C and hashing.fnv(b"a") == 0xAF63DC4C8601EC8C
    assert hashing.wang64([0, 1]).tolist() != [0, 1] and len(set(hashing.wang64(range(1000)).tolist())) == 1000
    assert len(set(hashing.wang32(range(1000)).tolist())) == len(set(hashing.jenkins_wang32(range(1000)).tolist())) == 1000
    assert hashing.murmur2(b"hello") == hashing.murmur2(b"hello") != hashing.murmur2(b"hellp")


def test_narrowing_hashes_and_mix():
    """Against the published definitions, written with whole numbers."""
    rng = random.Random(9)
    signed = lambda x, bits: (x + (1 << bits - 1)) % (1 << bits) - (1 << bits - 1)
    for key in [0, 1, -1, (1 << 63) - 1, -(1 << 63), *(rng.randrange(-(1 << 63), 1 << 63) for _ in range(50))]:
        k, mask = key % (1 << 64), (1 << 64) - 1
        k = (~k + (k << 18)) & mask
        k ^= k >> 31
        k = k * 21 & mask
        k ^= k >> 11
        k = (k + (k << 6)) & mask
        assert hashing.wang64to32(key).tolist() == [signed(k ^ k >> 22, 32)]
        assert hashing.fnv64to32(key) == signed(hashing.fnv((key % (1 << 64)).to_bytes(8, "big"), 32), 32)
    mask = (1 << 32) - 1
    for _ in range(50):
        given = [rng.randrange(-(1 << 31), 1 << 31) for _ in range(3)]
        a, b, c = (x & mask for x in given)
        for right, left, back in ((13, 8, 13), (12, 16, 5), (3, 10, 15)):
            a = ((a - b - c) & mask) ^ c >> right
            b = ((b - c - a) & mask) ^ (a << left & mask)
            c = ((c - a - b) & mask) ^ b >> back
        assert hashing.jenkins_mix(*given).tolist() == [signed(c, 32)]


def test_fragments(spark):
    rng = random.Random(6)
    whole = "".join(rng.choice("ACGT") for _ in range(60))
    cuts = [(0, 10), (5, 20), (20, 30), (8, 12), (40, 50), (45, 60)]
    df = spark.createDataFrame([(1, a, whole[a:b]) for a, b in cuts], "ref_id long, lower int, seq string")
    got = sorted((r.lower, r.seq) for r in src.merge_fragments(df).collect())
    assert got == [(0, whole[:30]), (40, whole[40:60])]
    wrong = df.union(spark.createDataFrame([(1, 41, "N")], df.schema))
    with pytest.raises(Exception, match="disagree"):
        src.merge_fragments(wrong).collect()
