"""The command line, the checks before a run, reports, caches and indexes."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from hushgrain import cli
from hushgrain.functions import names
from hushgrain.plans import checks, reports, sinks
from hushgrain.plans import run as plans
from hushgrain.sources import bam
from test_run import C1, C2, HEADER, READS, bam_bytes, bgzf, gtf_text


def index_bytes(counts, tail=0):
    """An index of one contig per pair of counts, with no offsets."""
    out = b"BAI\x01" + struct.pack("<i", len(counts))
    for m, u in counts:
        out += struct.pack("<i", 1) + struct.pack("<Ii", 37450, 2) + struct.pack("<QQQQ", 0, 0, m, u) + struct.pack("<i", 0)
    return out + struct.pack("<Q", tail)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    (d / "a.gtf").write_text(gtf_text())
    (d / "ens.gtf").write_text(gtf_text().replace("chr1\t", "1\t"))
    for n in ("s", "t"):
        (d / f"{n}.bam").write_bytes(bam_bytes(READS))
    (d / "s.bam.bai").write_bytes(index_bytes([(20, 0), (1, 0)]))
    (d / "t.bam.bai").write_bytes(index_bytes([(0, 0)], 7))
    (d / "sites.bed").write_text("chr1\t1199\t1201\n")
    (d / "numt.bed").write_text("chr1\t1\t9\nchr2\t3\t4\n")
    (d / "p" / "P1_A1").mkdir(parents=True)
    (d / "p" / "P1_A1" / "a.bam").write_bytes(bam_bytes([r for r in READS if r[4] == C1]))
    (d / "p" / "P1_B2").mkdir(parents=True)
    (d / "p" / "P1_B2" / "a.bam").write_bytes(bam_bytes([r for r in READS if r[4] == C2]))
    return d


def common(d, out):
    return ["--gtf", str(d / "a.gtf"), "--polya-sites", str(d / "sites.bed"), "--tss-db", "none", "--output-dir", str(d / out), "--cache-dir", str(d / "cache")]


def test_run(spark, files, capsys):
    for _ in range(2):  # the second finds annotation and sites in the cache
        assert cli.main(["run", "--bam", str(files / "s.bam"), "--numt-bed", str(files / "numt.bed"), *common(files, "out")]) == 0
    assert len([x for x in os.listdir(files / "cache" / "tables") if x.startswith("annotation-")]) == 1
    page = (files / "out" / "s.report.html").read_text()
    for part in ("Noise, strict", "NUMT intervals", "Noise by read length", "Read lengths", "Artifacts", "Top intergenic loci", "a.gtf", "sites.bed", "3' ends at known sites"):
        assert part in page or part.replace("'", "&#x27;") in page
    rows = {r.metric: r.value for r in spark.read.csv(str(files / "out" / "s.read_metrics.tsv"), sep="\t", header=True).collect()}
    assert rows["n_reads_classified"] == "21" and "n_tso_invasion" in rows
    loci = spark.read.csv(str(files / "out" / "s.intergenic_loci.tsv"), sep="\t", header=True)
    assert loci.columns[:4] == ["contig", "start", "end", "strand"]
    said = capsys.readouterr()
    assert "s  21 reads  noise 0.2381" in said.out and "sort order" not in said.err


def test_run_refuses(spark, files, capsys):
    with pytest.raises(ValueError, match="style"):
        cli.main(["run", "--bam", str(files / "s.bam"), *[x.replace("a.gtf", "ens.gtf") for x in common(files, "x")]])
    assert cli.main(["run", "--bam", str(files / "t.bam"), *common(files, "x")]) == 0
    assert "no read is mapped" in capsys.readouterr().err and not os.path.exists(files / "x" / "t.report.html")
    with pytest.raises(FileNotFoundError):
        cli.main(["run", "--bam", str(files / "s.bam"), "--output-dir", "x", "--cache-dir", str(files / "empty"), "--offline"])


def test_compare(spark, files):
    assert cli.main(["compare", "--bam-a", str(files / "s.bam"), "--bam-b", str(files / "p" / "P1_A1" / "a.bam"), "--label-a", "raw", "--label-b", "cut", *common(files, "cmp")]) == 0
    page = (files / "cmp" / "comparison.report.html").read_text()
    for part in ("raw and cut", "Shares of reads", "Differences", "Cells are not compared", "Lengths of sense reads"):
        assert part in page
    rows = spark.read.csv(str(files / "cmp" / "comparison.stats.tsv"), sep="\t", header=True)
    assert rows.columns == ["category", "frac_raw", "frac_cut", "delta", "chi2", "p_value", "p_adjusted"] and rows.count() == 19
    assert spark.read.csv(str(files / "cmp" / "comparison.metrics.tsv"), sep="\t", header=True).columns == ["metric", "raw", "cut", "delta"]


def test_plate_and_discover(spark, files, capsys):
    assert cli.main(["run-plate", "--plate-dir", str(files / "p"), *common(files, "plate")]) == 0
    rows = {r.well_id: r for r in spark.read.csv(str(files / "plate" / "per_well_metrics.tsv"), sep="\t", header=True).collect()}
    assert rows["A1"].n_reads_classified == "11" and rows["B2"].n_reads_classified == "10"
    with pytest.raises(SystemExit):
        cli.main(["run-plate", "--plate-dir", str(files / "p"), "--plate-id", "P9", *common(files, "plate")])
    assert cli.main(["discover", "--bam-dir", str(files), "--select", "1", *common(files, "all")]) == 0
    assert "s.bam  ont" in capsys.readouterr().out and os.path.exists(files / "all" / "s.report.html")


def test_checks():
    assert names.style(["chr1", "chrX", "chrUn_1"]) == "ucsc" and names.style(["1", "MT", "GL1"]) == "ensembl" and names.style(["1", "chr1"]) == names.style([]) == "unknown"
    assert checks.version_gap(48, 42) and not checks.version_gap(47, 42) and not checks.version_gap(None, 42)
    assert "chr1 has 5 bases" in checks.lengths({"chr1": 5}, checks.expected_lengths(None))[0] and not checks.lengths({"chr1": 248_000_000, "other": 1}, checks.expected_lengths(None))
    assert checks.lengths({"1": 5}, checks.expected_lengths(None))
    assert checks.naming({"x": 1}, "ucsc") and checks.naming({"chr1": 1}, "ucsc") == []
    assert len(checks.barcodes(0.2, "post_filter", True, "ont")) == 2 and checks.barcodes(0.9, "post_filter", True, "ont") == [] == checks.barcodes(0.0, "post_filter", True, "smartseq")


def test_paired_report(spark, files):
    """Short paired reads have insert sizes in the place of lengths, or a warning that there are none."""
    s = plans.Settings(gtf=str(files / "a.gtf"), platform="illumina_10x")
    reads = plans.load(spark, str(files / "s.bam"))
    none = plans.run_sample(spark, reads, s)
    titles, warnings = reports.run_sections(none, s)
    assert "Read lengths" not in dict(titles) and any("insert sizes" in w for w in warnings)
    pairs = reads.withColumns({"flag": F.lit(67), "tlen": F.lit(300).cast("long")})
    titles, _ = reports.run_sections(plans.run_sample(spark, pairs, s, profile=False), s)
    assert "Insert sizes" in dict(titles)


def test_long_tables_say_so(spark):
    assert "first 5 of 9 rows" in sinks.table_html(spark.range(9), 5) and "rows" not in sinks.table_html(spark.range(5), 5)


def test_ultra_long_cigar(spark, tmp_path):
    """More operations than a record's field can count come from its tag, and survive a round trip."""
    long = "".join(f"1M{1 + i % 2}D" for i in range(33_000)) + "1M"
    n = 33_001
    df = spark.createDataFrame([("q", 0, "chr1", 5, 60, long, None, 0, "A" * n, "c", "u", 1, None), ("r", 0, "chr1", 5, 60, "3M", None, 0, "ACG", None, None, None, None)], "qname string, flag int, contig string, pos long, mapq int, cigar string, next_contig string, tlen long, seq string, cb string, umi string, nh int, sa string")
    bam.write_bam(df.coalesce(1), str(tmp_path / "b"), [("chr1", 10**6)])
    back = {r.qname: r for r in plans.load(spark, "file://" + str(tmp_path / "b")).collect()}
    assert back["q"].cigar == long and back["q"].cb == "c" and back["r"].cigar == "3M"
    # by hand: a placeholder of a clip and a skip, the operations in the tag
    name = b"h\0"
    rec = struct.pack("<iiBBHHHiiii", 0, 7, len(name), 60, 0, 2, 0, 100, -1, -1, 0) + name + struct.pack("<II", 100 << 4 | 4, 5000 << 4 | 3) + b"\x11" * 50 + b"\xff" * 100 + b"CGBI" + struct.pack("<iI", 1, 100 << 4)
    top = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 10**6)
    (tmp_path / "h.bam").write_bytes(bgzf(top + struct.pack("<i", len(rec)) + rec))
    assert plans.load(spark, str(tmp_path / "h.bam")).first().cigar == "100M"


def test_index_counts(files):
    assert bam.read_index(str(files / "s.bam"))[1] == (21, 0) and bam.read_index(str(files / "t.bam"))[1] == (0, 7) and bam.read_index(str(files / "p" / "P1_A1" / "a.bam")) is None
    assert bam.found(str(files)) == sorted([str(files / "s.bam"), str(files / "t.bam")]) == bam.found(str(files / "*.bam")) and bam.found(str(files / "s.bam")) == [str(files / "s.bam")]
    assert HEADER
