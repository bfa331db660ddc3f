"""Views, simulators, read-level operators, parameters as JSON, BLAST parsing and the command line."""

import pytest
from pyspark.sql import functions as F

from seqframe.__main__ import main, parser
from seqframe.functions import mutations as mu
from seqframe.functions import schema, simulation, text
from seqframe.functions.trimming import TrimParameters
from seqframe.operators import blast, fuzzy, reads, views


def test_stacked_view(spark):
    rows = [("s", "a", "ACGT", ("", 0, 4, 0, 4)), ("s", "b", "ACGT", ("I2T", 0, 4, 0, 5)), ("s", "c", "ACGT", ("DC1", 0, 4, 0, 3))]
    df = spark.createDataFrame(rows, "subject string, name string, seq string, h struct<mutations:string,from1:int,to1:int,from2:int,to2:int>")
    lines = {r.name: r.line.rstrip() for r in views.stacked_view(df, "subject", "seq", "h", "name").collect()}
    assert lines == {"a": "AC-GT", "b": "ACTGT", "c": "A--GT"}
    one = df.filter("name = 'b'").select(F.explode(views.alignment_columns(F.col("seq"), F.col("h"))).alias("c")).select("c.*").collect()
    assert [(r.kind, r.letter1, r.letter2) for r in one][2] == ("I", "-", "T")
    assert df.select(views.alignment_summary(F.col("seq"), F.col("h")).alias("v")).filter("v.cigar = '2M1I2M'").count() == 1


def test_simulation():
    model = simulation.MutationModel(simulation.uniform_substitutions(0.2), 0.1, 0.1)
    seq = "ACGTTGCAACGT" * 20
    for seed in range(50):
        m = simulation.generate(seq, model, seed)
        assert mu.mutate(mu.mutate(seq, m), mu.invert(m)) == seq and m == simulation.generate(seq, model, seed)
        assert not any(a.kind + b.kind in ("ID", "DI") and b.position - a.position == (a.kind == "D") for a, b in zip(m, m[1:], strict=False))
        u = simulation.uniform_mutations(seq, 9, seed)
        assert len(u) == 9 and mu.is_compatible(seq, u)
    with pytest.raises(ValueError):
        model.scaled(10)


def test_parameters_as_json(spark):
    p = fuzzy.SearchLimits(1, 2, 0, 2, 0.5, greedy=False)
    assert schema.from_json(schema.to_json(p), fuzzy.SearchLimits, TrimParameters) == p
    with pytest.raises(ValueError):
        schema.from_json('{"type": "SearchLimits", "other": 1}', fuzzy.SearchLimits)
    with pytest.raises(ValueError):
        TrimParameters(1.0, 0)
    df = spark.createDataFrame([("AC", [1, 2])], "seq string, qual array<int>")
    again = df.select(schema.decode_struct(schema.encode_struct(F.struct("seq", "qual")), schema.READ).alias("r")).first().r
    assert (again.seq, again.qual) == ("AC", [1, 2])
    tagged = df.select(schema.tag_alphabet(F.col("seq"), "seq", "nucleotide"))
    assert schema.alphabet_of(tagged.schema["seq"]) == "nucleotide"


def test_blast_output():
    line = "7\tsub1\t42\t80.1\t1e-9\t97.5\t1\t20\t30\t12\t5AC3-G10"
    (row,) = blast.parse_tabular(f"# comment\n{line}\n")
    assert row[:3] == (7, "sub1", 42) and row[6] == "SC5ADG9" and row[7:] == (0, 20, 11, 30, "minus")
    with pytest.raises(RuntimeError):
        blast.BlastParameters(program="no-such-blast").command()


def test_text():
    assert text.split_outside_brackets("a,b(c,d),[e,{f,g}]", ",") == ["a", "b(c,d)", "[e,{f,g}]"]
    for bad in ("a(b", "a)b", "(a]"):
        with pytest.raises(ValueError):
            text.split_outside_brackets(bad, ",")


def test_read_operators(spark):
    df = spark.createDataFrame([("b", "ACGT"), ("a", "GG"), ("c", "")], "name string, seq string")
    assert [(r.name, r.read_id) for r in reads.with_read_id(df.repartition(3), ["name"]).orderBy("name").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    pairs = df.select(F.struct("seq").alias("r1"), F.struct(F.lit("").alias("seq")).alias("r2"))
    assert reads.drop_empty(pairs).count() == 2
    seen_df, seen = reads.observed(df, "m", n=F.count("*"), letters=F.sum(F.length("seq")))
    seen_df.collect()
    assert seen.get == {"n": 3, "letters": 6}
    sizes = spark.createDataFrame([(10,), (3 << 20,)], "n long").select(text.byte_size(F.col("n")).alias("s"), text.duration(F.col("n")).alias("d"))
    assert [tuple(r) for r in sizes.collect()] == [("10B", "10ns"), ("3.0MiB", "3.15ms")]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.fastq").write_text("@x\nACGTACGTACGT\n+\nIIIIIIIIIIII\n@y\nACGT\n+\n!!!!\n")
    assert main(["trim", str(tmp_path / "a.fastq"), str(tmp_path / "out")]) == 0
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == "@x\nACGTACGTACGT\n+\nIIIIIIIIIIII\n"
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        main(["trim", str(tmp_path / "a.fastq"), str(tmp_path / "out")])
    assert main(["trim", str(tmp_path / "a.fastq"), str(tmp_path / "out"), "--overwrite"]) == 0
    assert main(["queries"]) == 0 and "revcomp" in capsys.readouterr().out
    assert parser().parse_args(["merge", "a", "b", "c"]).min_overlap == 15
