import random

import pytest
from pyspark.sql import functions as F

from strandloom import __main__ as command
from strandloom.plans.mapping import map_files
from strandloom.sources import text as t
from strandloom.sources.files import ReferenceReader


def joined(df):
    """ref_id to sequence, from parts that must follow each other."""
    out = {}
    for r in df.orderBy("ref_id", "from", F.length("part")).collect():
        name = r["ref_id"].rsplit("/", 1)[-1]
        assert r["from"] == len(out.setdefault(name, "")), (name, r["from"])
        out[name] += r["part"]
    return out


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(5)
    seq = lambda n, letters="ACGT": "".join(rng.choices(letters, k=n))
    (tmp_path / "refs").mkdir()
    files = {
        "a": ">" + "h" * 200 + "\n" + "".join(seq(70) + "\n" for _ in range(60)),
        "b": ">x\n" + seq(999),
        "c": ">y\nAC\r\n\n\n>GT\n" + seq(50, "aé€😀\n"),
        "d": ">only a header",
        "e": "",
        "f": ">z\n",
    }
    for k, v in files.items():
        (tmp_path / "refs" / k).write_bytes(v.encode())
    want = {k: "".join(v.split("\n")[1:]) for k, v in files.items()}
    return tmp_path / "refs", want


@pytest.mark.parametrize("size", [1, 7, 64, 100_000])
def test_ranges_give_the_whole_sequence(folder, size):
    """Ranges of any size, letters of several bytes and line breaks on their borders; without Spark."""
    path, want = folder
    got, sums = {}, {}
    for part in (1, 5, 1000):
        got, sums = {}, {}
        reader = ReferenceReader(str(path), size, part)
        for p in reader.partitions():
            for batch in reader.read(p):
                (row,) = batch.to_pylist()
                name = row["ref_id"].rsplit("/", 1)[-1]
                key = (name, row["range"])
                assert row["before"] == sums.get(key, 0) and len(row["part"]) <= part
                sums[key] = row["before"] + len(row["part"])
                got[name] = got.get(name, "") + row["part"]
        assert got == want


def test_parts_equal_whole_files(spark, folder):
    path, want = folder
    assert joined(t.reference_parts(spark, str(path), 50)) == want
    assert joined(t.reference_parts(spark, f"file://{path}")) == want
    lines = joined(t.split_parts(spark, str(path)))
    assert lines == {k: v for k, v in want.items() if k != "e"}  # an empty file has no line
    whole = {r["ref_id"].rsplit("/", 1)[-1]: r["seq"] for r in t.read_reference(spark, str(path)).collect()}
    assert {k: v for k, v in whole.items() if k != "e"} == {k: v for k, v in want.items() if k != "e"}


def test_lines_of_many_stretches(spark, folder, monkeypatch):
    path, want = folder
    monkeypatch.setattr(t, "STRETCH", 4)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert joined(t.split_parts(spark, str(path / "a"))) == {"a": want["a"]}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_one_ordered_file(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("id")).withColumn("line", F.concat(F.lit("é"), "id")).repartition(7)
    t.write_lines(rows, "line", ["id"], str(tmp_path / "deep" / "out.txt"))
    assert (tmp_path / "deep" / "out.txt").read_text() == "".join(f"é{i}\n" for i in range(3000))
    t.write_lines(rows.filter("id < 3").withColumn("line", F.when(F.col("id") != 1, F.col("line"))), "line", [F.col("id").desc()], str(tmp_path / "deep" / "out.txt"))
    assert (tmp_path / "deep" / "out.txt").read_text() == "é2\né0\n"
    t.write_lines(rows.limit(0), "line", ["id"], str(tmp_path / "deep" / "none.txt"))
    assert (tmp_path / "deep" / "none.txt").read_text() == "" and len(list((tmp_path / "deep").iterdir())) == 2
    with pytest.raises(Exception, match="deep"):
        t.write_lines(rows, "line", ["id"], str(tmp_path / "deep"))


def test_a_failing_job_leaves_nothing(spark, tmp_path):
    (tmp_path / "out.txt").write_text("before\n")
    bad = spark.range(10).withColumn("line", F.col("id").cast("string"))
    t.write_lines(bad, "line", ["id"], str(tmp_path / "out.txt"))
    assert (tmp_path / "out.txt").read_text().split() == [str(i) for i in range(10)]
    rows = spark.range(3).select((F.col("id") * 2).alias("offset"), F.when(F.col("id") == 2, F.raise_error(F.lit("broken")).cast("string")).otherwise("x").alias("line"))
    spark.dataSource.register(t.LineSink)
    with pytest.raises(Exception, match="broken"):
        rows.write.format("ordered_lines").option("path", str(tmp_path / "out.txt")).mode("overwrite").save()
    assert [p.name for p in tmp_path.iterdir()] == ["out.txt"] and (tmp_path / "out.txt").read_text().startswith("0\n")


def test_the_command(spark, tmp_path, capsys, monkeypatch):
    """A reference in 50 ranges; one output file, in order; the summary against counts by hand."""
    rng = random.Random(20)
    ref = "".join(rng.choices("ACGT", k=3000))
    (tmp_path / "ref.fa").write_text(">r\n" + "\n".join(ref[i : i + 60] for i in range(0, 3000, 60)) + "\n")
    reads = []
    for at in range(100, 2700, 130):
        for k in range(2):
            x = ref[at + k * 4 : at + k * 4 + 50]
            p = 30 - k * 4
            reads += [x[:p] + "ACGT"["CGTA".index(x[p])] + x[p + 1 :], ref[at + 70 : at + 120]]
    reads += ["".join(rng.choices("ACGT", k=50)), ref[500:550]]
    (tmp_path / "reads.fa").write_text("".join(f">{i}\n{r}\n" for i, r in enumerate(reads)))
    monkeypatch.setattr("strandloom.plans.mapping.reference_parts", lambda s, p: t.reference_parts(s, p, 61))
    out = tmp_path / "results" / "calls.txt"
    assert command.main([str(tmp_path / "ref.fa"), str(tmp_path / "reads.fa"), str(out)]) == 0
    want = [f">S{at + 30} {ref[at + 30]} {'ACGT'['CGTA'.index(ref[at + 30])]}" for at in range(100, 2700, 130)]
    assert out.read_text().splitlines() == want
    said = capsys.readouterr().out.splitlines()
    n = len(reads)
    assert said == [f"mapped {n - 1} of {n} reads ({100 * (n - 1) / n:.2f} %)", f"mean coverage {50 * (n - 1) / 3000:.4f}", "pairs left out as a read failed: 0", "indel bases left out beside another indel: 0"]


def test_one_reference_is_needed(spark, folder, tmp_path):
    (tmp_path / "reads.fa").write_text(">1\nACGT\n>2\nACGT\n")
    with pytest.raises(ValueError, match="one reference"):
        map_files(spark, str(folder[0]), str(tmp_path / "reads.fa"))
