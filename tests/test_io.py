"""Sources, sinks, plans and streams."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagwright.operators import counting
from tagwright.plans import assay
from tagwright.sources import bcl, fastq, sinks, tables
from tagwright.streaming import assign_stream

FQ = "@r1 x\nACGTAA\n+\nIIIIII\n@r2\nTTTTAA\n+\nIIIIII\n@r3\nGGGGAA\n+\nIIIIII\n"


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(FQ)
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write(FQ.replace("\n", "\r\n"))
    fastq.register(spark)
    df = spark.read.format("fastq").load(str(tmp_path))
    assert df.count() == 6 and df.select("read_id").distinct().count() == 3
    assert fastq.read_fastq(spark, str(tmp_path / "b.fastq.gz")).where("ordinal = 0").first().seq == "ACGTAA"
    (tmp_path / "bad.fastq").write_text("@r\nACGT\n+\nIII\n")
    with pytest.raises(Exception, match="malformed"):
        fastq.read_fastq(spark, str(tmp_path / "bad.fastq")).collect()


def test_fastq_columns(spark, tmp_path):
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write(FQ)
    (tmp_path / "a.fastq").write_text(FQ.replace("ACGTAA", "acgtaa").replace("IIIIII", "III", 1))
    seqs = fastq.read_fastq(spark, str(tmp_path), columns=["seq"], plain=True)
    assert seqs.columns == ["seq"] and sorted(r.seq for r in seqs.collect()) == ["ACGTAA"] * 2 + ["GGGGAA"] * 2 + ["TTTTAA"] * 2
    fastq.register(spark)
    one = spark.read.format("fastq").load(str(tmp_path / "b.fastq.gz"))
    assert {(r.ordinal, r.read_id) for r in one.select("ordinal", "read_id").collect()} == {(0, "r1"), (1, "r2"), (2, "r3")}


def _write(path, seqs):
    path.write_text("".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(seqs)))


def test_assay_modes(spark, tmp_path):
    """Each sample's own offset, indel windows, and pairs."""
    (tmp_path / "t.tsv").write_text("id\tseq\na\tACGTAC\nb\tTTGGCC\n")
    _write(tmp_path / "s1.fastq", ["GACGTACTT", "GTTGGCCTT"])
    _write(tmp_path / "s2.fastq", ["GGGACGTACT", "GGGACGTACA"])
    _write(tmp_path / "s3.fastq", ["CCACGTC", "CCTATGGCCA", "CCTTGGGCCA"])  # the last: windows of 6 and 7 are as near, the first counts
    base = {"targets": str(tmp_path / "t.tsv"), "length": 6}
    spec = assay.Spec(samples=[("S1", str(tmp_path / "s1.fastq")), ("S2", str(tmp_path / "s2.fastq"))], start=2, auto_offset=2, k=0, **base)
    got = {(r.sample, r.target_id): r["count"] for r in assay.run(spark, spec)["counts_long"].collect()}
    assert got == {("S1", "a"): 1, ("S1", "b"): 1, ("S2", "a"): 2, ("S2", "b"): 0}
    spec = assay.Spec(samples=[("S3", str(tmp_path / "s3.fastq"))], start=2, indel_window=1, **base)
    row = {r.target_id: (r.count_deletion, r.count_insertion, r.count_substitution) for r in assay.run(spark, spec)["counts_long"].collect()}
    assert row == {"a": (1, 0, 0), "b": (0, 1, 1)}
    _write(tmp_path / "p.fastq", ["ACGTACTTGGCC", "ACGTACACGTAC", "ACGTACGGGGGG", "ACG"])
    pair = assay.Spec(mode="pair-count", samples=[("P", str(tmp_path / "p.fastq"))], right_targets=base["targets"], right_start=6, right_length=6, k=0, **base)
    res = assay.run(spark, pair)
    assert {(r.left_index, r.right_index, r["count"]) for r in res["pair_counts"].collect()} == {(0, 1, 1), (0, 0, 1)}
    assert res["pair_summary"].first().invalid == 1
    assert "pair-count needs" in " ".join(assay.Spec(mode="pair-count", samples=[("P", "x")], **base).problems())


def test_barcode_autopsy(spark):
    from tagwright.sources import tables as T

    t = T.targets_from(spark, [(0, "a", "ACGTAC", ""), (1, "b", "TTGGCC", "")])
    seqs = ["GG" + s for s in ("ACGTACT", "TTGGCCA", "ACGTACG", "CCCCCCC")]
    reads = spark.createDataFrame([(i, "S", s, "I" * len(s), i) for i, s in enumerate(seqs)], "read_id long, sample string, seq string, qual string, ordinal long")
    out = assay.barcode_autopsy(reads, t, [0, 1, 2, 3])
    assert out["offset_scan"].first().start == 2 and out["summary"].first().assigned_reads == 3
    assert {r.finding for r in out["findings"].collect()} >= {"low_assignment_rate", "high_no_match_rate"}
    assert out["top_unmatched"].first().sequence == "CCCCCC"


def test_tables():
    assert tables.parse_targets(["# c", "id,gRNA.sequence,Gene", "a,acgt,G1"]) == [(0, "a", "ACGT", "G1")]
    assert tables.parse_targets(["sgRNAID\tSeq\tgene", "a\tAC\tg"]) == [(0, "a", "AC", "g")]
    assert tables.parse_targets(["ACGT", "TTTT"]) == [(0, "0", "ACGT", ""), (1, "1", "TTTT", "")]
    assert tables.parse_targets(["x\tACGT"]) == [(0, "x", "ACGT", "")]
    for bad in ([], ["a\t"]):
        with pytest.raises(ValueError):
            tables.parse_targets(bad)
    assert tables.parse_samples(["sample_id\tfastq", "S1\ta.fq"]) == [("S1", "a.fq")]


def test_matrix(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("sgRNA\tGene\tA\tB\ng1\tX\t1\t2\ng2\tX\t0\t4\n")
    long = counting.melt_matrix(tables.read_matrix(spark, str(tmp_path / "m.tsv")))
    assert {r.sample: r.total_count for r in counting.matrix_metrics(long).collect()} == {"A": 1, "B": 6}
    (tmp_path / "n.tsv").write_text("sgRNA\tGene\tA\ng1\tX\t-1\n")
    with pytest.raises(Exception, match="negative"):
        counting.melt_matrix(tables.read_matrix(spark, str(tmp_path / "n.tsv"))).collect()


def test_bcl(spark, tmp_path):
    info = bcl.parse_run_info('<R><Read Number="1" NumCycles="2"/><Read Number="2" NumCycles="2" IsIndexedRead="Y"/></R>')
    assert [r["start"] for r in info] == [0, 2]
    seqs = ["ACGT", "TTGT", "CCAA"]
    for c in range(4):
        d = tmp_path / f"C{c + 1}.1"
        d.mkdir()
        raw = bytes(("ACGT".index(s[c]) | 30 << 2) for s in seqs)
        (d / "s_1_1101.bcl").write_bytes(np.uint32(3).tobytes() + raw)
    (tmp_path / "s_1_1101.filter").write_bytes(bytes(8) + bytes([1, 1, 0]))
    reads = bcl.read_run(spark, str(tmp_path), 4)
    assert [r.seq for r in reads.orderBy("cluster").collect()] == seqs
    sheet = bcl.parse_sample_sheet("[Header]\n[Data]\nSample_ID,index\ns1,GT\ns2,AC\n")
    got = bcl.assign_samples(reads, sheet, (2, 2), None, 0)
    s = bcl.demux_stats(reads, got).first()
    assert (s.passed, s.filtered, s.assigned, s.undetermined) == (2, 1, 2, 0)
    sinks.write_bcl_fastq(list(bcl.reads_of(got, info)), str(tmp_path / "out"))
    assert (tmp_path / "out/R1/sample=s1_S1_L001_R1_001").exists()


def test_plan(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(FQ)
    (tmp_path / "t.tsv").write_text("a\tACGT\nb\tTTTT\n")
    spec = assay.Spec("demux", str(tmp_path / "t.tsv"), [("S1", str(tmp_path / "a.fastq"))], 0, 4, out=str(tmp_path / "out"))
    res = assay.run(spark, spec)
    assert "unmatched" in res and res["sample_qc"].first().assigned_reads == 2
    assert (tmp_path / "out/fastq/barcode=a").exists() and '"autopsy_triggered": true' in assay.manifest(spec, res)
    assert assay.Spec.load(assay.template()).problems() == []
    assert assay.Spec(metric="hamming", k=2).problems()
    assert "<table>" in sinks.html_report("t<", {"x": res["sample_qc"]}) and "data:" in sinks.multiqc("qc", res["sample_qc"])


def test_stream(spark, tmp_path):
    spark.createDataFrame([(0, "S0", "ACGT"), (1, "S0", "ACGT")], "read_id long, sample string, seq string").write.parquet(str(tmp_path / "in"))
    targets = tables.targets_from(spark, [(0, "a", "ACGT", "")])
    stream = spark.readStream.schema("read_id long, sample string, seq string").parquet(str(tmp_path / "in"))
    got = []
    q = assign_stream.stream_assignments(stream, targets, 1, 0, 4, lambda df, i: got.extend(r.status for r in df.collect()), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert got == ["unique", "unique"]
    q = assign_stream.running_window_counts(stream, 0, 4).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 2
