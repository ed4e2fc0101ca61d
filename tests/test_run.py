"""A whole run on the tiny annotation and alignments of FIXTURES.md, from text and binary files."""

import gzip
import json
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from hushgrain.plans import run as plans
from hushgrain.sources import bam, headers, resolve, sheets, text

GTF = [("+", "GENE_A", "ENSG00000000001", "protein_coding", (1000, 6000), [(1000, 2000), (3000, 4000), (5000, 6000)]), ("-", "GENE_B", "ENSG00000000002", "lncRNA", (15000, 25000), [(15000, 17000), (20000, 22000)])]
C1, C2 = "AAACCTGAGAAACCAT", "AAACCTGAGAAACCGG"
READS = [("read_exonic_sense", 0, "chr1", 1100, C1, 1, None, "exonic_sense"), ("read_exonic_antisense", 16, "chr1", 1300, C1, 1, None, "exonic_antisense"), ("read_multimapper", 0, "chr1", 1500, C1, 3, None, "multimapper"), ("read_chimeric", 0, "chr1", 1700, C1, 1, "chr1,50000,+,100M,60,0;", "chimeric"), ("read_intronic_boundary", 0, "chr1", 1980, C2, 1, None, "intronic_boundary"), ("read_intronic_pure", 0, "chr1", 2100, C2, 1, None, "intronic_pure"), ("read_exonic_sense_neg", 16, "chr1", 15100, C2, 1, None, "exonic_sense"), ("read_intergenic", 0, "chr1", 30000, C2, 1, None, "intergenic_sparse"), ("read_mito", 0, "chrM", 200, C1, 1, None, "mitochondrial")]
READS += [(f"read_c1_pad{i}", 0, "chr1", 1100 + i, C1, 1, None, "exonic_sense") for i in range(1, 7)] + [(f"read_c2_pad{i}", 16, "chr1", 15100 + i, C2, 1, None, "exonic_sense") for i in range(1, 7)]
HEADER = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:chr1\tLN:248956422\n@SQ\tSN:chrM\tLN:16569\n@PG\tID:minimap2\tPN:minimap2\tVN:2.26\n"


def gtf_text():
    out = ["# tiny"]
    for strand, name, gid, kind, (a, b), exons in GTF:
        attr = f'gene_id "{gid}"; gene_name "{name}"; gene_type "{kind}";'
        out += [f"chr1\tx\tgene\t{a}\t{b}\t.\t{strand}\t.\t{attr}"] + [f'chr1\tx\texon\t{s}\t{e}\t.\t{strand}\t.\t{attr} transcript_id "T"; exon_number 1;' for s, e in exons]
    return "\n".join(out) + "\n"


def bgzf(data):
    out = b""
    for i in range(0, len(data), 700):
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(data[i : i + 700]) + c.flush()
        out += b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data[i : i + 700]), len(data[i : i + 700]))
    return out + bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def bam_bytes(rows):
    names = ["chr1", "chrM"]
    data = b"BAM\x01" + struct.pack("<i", len(HEADER)) + HEADER.encode() + struct.pack("<i", 2)
    for n, ln in zip(names, (248956422, 16569)):
        data += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", ln)
    for q, flag, contig, pos, cb, nh, sa, _ in rows:
        tags = b"NHC" + bytes([nh]) + (b"CBZ" + cb.encode() + b"\0" if cb else b"") + b"UBZ" + q[-4:].encode() + b"\0XXBc" + struct.pack("<ibb", 2, 1, 2) + (b"SAZ" + sa.encode() + b"\0" if sa else b"")
        seq = bytes(("=ACMGRSVTWYHKDBN".index(a) << 4) | "=ACMGRSVTWYHKDBN".index(b) for a, b in zip("ACGT" * 25, ("ACGT" * 25)[1:]) for _ in [0])[::2]
        name = q.encode() + b"\0"
        rec = struct.pack("<iiBBHHHiiii", names.index(contig), pos, len(name), 60, 0, 1, flag, 100, -1, -1, 0) + name + struct.pack("<I", 100 << 4) + seq + b"\xff" * 100 + tags
        data += struct.pack("<i", len(rec)) + rec
    return bgzf(data)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("run")
    with gzip.open(d / "a.gtf.gz", "wt") as f:
        f.write(gtf_text())
    (d / "bams").mkdir()
    (d / "bams" / "s.bam").write_bytes(bam_bytes(READS))
    (d / "s.sam").write_text(HEADER + "".join(f"{q}\t{fl}\t{c}\t{p + 1}\t60\t100M\t*\t0\t0\t{'ACGT' * 25}\t*\tCB:Z:{cb}\tUB:Z:{q[-4:]}\tNH:i:{nh}" + (f"\tSA:Z:{sa}" if sa else "") + "\n" for q, fl, c, p, cb, nh, sa, _ in READS))
    (d / "obs.tsv").write_text(f"barcode\tleiden\n{C1}\tx\n{C2}\ty\n")
    return d


def test_tiny_run(spark, files):
    s = plans.Settings(gtf=str(files / "a.gtf.gz"), obs=str(files / "obs.tsv"))
    reads = plans.load(spark, str(files / "bams" / "s.bam"))
    assert {r.seq for r in reads.select("seq").collect()} == {"ACGT" * 25}
    info = headers.inspect(bam.header_text(str(files / "bams" / "s.bam")))
    assert info["platform"] == "ont" and info["issues"] == []
    out = plans.run_sample(spark, reads, s, name="tiny", contigs=info["contigs"])
    got = {r.qname: r for r in out["reads"].collect()}
    assert {q: r.category for q, r in got.items()} == {x[0]: x[7] for x in READS}
    assert got["read_intronic_boundary"].base_counts == {"exonic_sense": 20, "intronic_boundary": 80}
    one = out["sample"].first()
    assert one.n_reads_classified == 21 and one.n_cells == 2 and one.n_reads_total == 21
    assert one.noise_read_frac == pytest.approx(5 / 21) and one.noise_read_frac_strict == pytest.approx(3 / 21)
    assert one.noise_base_frac == pytest.approx(480 / 2100) and one.strand_concordance == pytest.approx(14 / 15)
    cells = {r.cell_barcode: r.noise_read_frac for r in out["cells"].collect()}
    assert cells == {C1: pytest.approx(2 / 11), C2: pytest.approx(3 / 10)}
    assert {r.cluster: r.n_cells for r in out["clusters"].collect()} == {"x": 1, "y": 1}
    assert out["loci"].count() == 1
    plans.write_sample(out, str(files / "out"), "tiny")
    data = json.loads((files / "out" / "tiny.summary.json").read_text())["data"]["tiny"]
    assert data["noise_read_frac"] == 0.2381
    assert "Noise" in (files / "out" / "tiny.report.html").read_text()
    back = spark.read.csv(str(files / "out" / "tiny.read_metrics.tsv"), sep="\t", header=True)
    assert {r.metric: r.value for r in back.collect()}["noise_read_frac"] == "0.238095"


def test_layers(spark, files):
    index = plans.build_index(spark, plans.Settings(gtf=str(files / "a.gtf.gz")))
    assert {(r.s, r.e) for r in index["introns"].collect()} == {(2000, 2999), (4000, 4999), (17000, 19999), (22000, 25000)}
    assert {(r.s, r.e) for r in index["intergenic"].collect()} == {(0, 999), (6000, 14999)}
    assert index["shared"].count() == 0
    with pytest.raises(ValueError):
        plans.build_index(spark, plans.Settings(gtf=str(files / "a.gtf.gz"), exclude_biotypes=["protein_coding", "lncRNA"]))


def test_sam_compare_discover(spark, files):
    a, b = plans.load(spark, str(files / "s.sam")), plans.load(spark, str(files / "bams"))
    cols = ["qname", "flag", "contig", "pos", "cigar", "cb", "umi", "nh", "sa", "strand", "seq"]
    assert sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))
    out = plans.run_compare(spark, a, b.where("qname != 'read_chimeric'"), plans.Settings(gtf=str(files / "a.gtf.gz")))
    m = {r.metric: r for r in out["metrics"].collect()}
    assert m["n_reads_classified"].delta == -1
    st = {r.category: r for r in out["stats"].collect()}
    assert len(st) == 19 and st["chimeric"].delta < 0 and st["secondary"].chi2 is None
    found = plans.discover(str(files / "bams"))
    assert found[0]["issues"] == ["no index"] and plans.select_files(found, "1")[0] is found[0] and plans.select_files(found, "all") == []
    with pytest.raises(ValueError):
        plans.select_files(found, "2")


def test_plate(spark, files, tmp_path):
    wells = spark.createDataFrame([("P1", "A1"), ("P1", "B2"), ("P1", "C3")], "plate_id string, well_id string")
    reads = plans.load(spark, str(files / "s.sam"))
    both = reads.withColumns({"plate_id": F.lit("P1"), "well_id": F.when(F.col("cb") == C1, "A1").otherwise("B2")})
    p = tmp_path / "sheet.csv"
    p.write_text('﻿Sample_Name,i7 sequence,i7_Name,i5 sequence,volume\nP1_A1,AAC,N1,GG,3\nP1_A1,AAG,N2,GG,4\n,,,,\nb2,TT,N3,"C,C",5\n')
    sheet = sheets.read_sheet(spark, str(p), "novaseqx")
    out = plans.run_plate(spark, wells, both, plans.Settings(gtf=str(files / "a.gtf.gz")), sheet)
    got = {r.well_id: r for r in out["wells"].collect()}
    assert got["A1"].n_reads_classified == 11 and got["B2"].noise_read_frac == pytest.approx(0.3) and got["C3"].n_reads_classified is None
    assert got["A1"].i7_seq == "CTT" and got["A1"].i7_name == "N2" and got["B2"].i5_seq == "C,C" and got["C3"].i7_name is None
    lonely, lost = sheets.unmatched(wells, sheet)
    assert [r.well_id for r in lonely.collect()] == ["C3"] and lost.count() == 0


def test_header_rules():
    pg = lambda *x: "".join(f"@PG\t{p}\n" for p in x)
    cases = [(pg("ID:minimap2", "ID:dorado"), "ont", "pre_filter"), (pg("ID:pbmm2", "ID:isoseq3 refine"), "pacbio", "pre_filter"), (pg("ID:isoseq3"), "pacbio", "raw"), (pg("ID:STAR\tCL:/x/cellranger/y"), "illumina_10x", "post_filter"), (pg("ID:STAR"), "smartseq", "pre_filter"), (pg("ID:STARsolo", "ID:rhapsody"), "illumina_bd", "post_filter"), (pg("ID:bwa"), "unknown", "pre_filter"), ("", "unknown", "custom")]
    for t, platform, stage in cases:
        h = headers.parse(t)
        assert (headers.platform(h), headers.stage(h)) == (platform, stage), t
    assert headers.chemistry(headers.parse("@CO\tChromium GEM-X")) == ("10x_v4", "header")
    assert headers.chemistry(headers.parse("@RG\tID:a\tDS:10x lib")) == ("10x_v3", "rg")
    assert headers.chemistry(headers.parse("@CO\tbd Rhapsody 10x"))[0] == "bd_rhapsody_wta"
    assert headers.inspect("@HD\tSO:unsorted\n", 0.7)["stage"] == "post_filter"
    with pytest.raises(ValueError):
        headers.check_order("queryname")


def test_resolve(tmp_path):
    assert resolve.address("gencode", "http://a", {"HUSHGRAIN_GENCODE_URL": "http://b"}) == "http://b" and resolve.address("gencode", "http://a", {"HUSHGRAIN_GENCODE_URL": ""}) == "http://a"
    for v in (9, 44, 45):
        (tmp_path / f"gencode.v{v}.gtf.gz").write_text("x")
    best = resolve.newest(str(tmp_path), r"gencode\.v(\d+)\.")
    assert best.endswith("v45.gtf.gz") and resolve.version_of(best) == 45
    assert resolve.choose(None, cached=best) == best and resolve.choose("x", cached=best) == "x"
    with pytest.raises(FileNotFoundError):
        resolve.choose(None, offline=True)
    assert resolve.choose_sites(None, "both", {"a": lambda: "1", "b": lambda: "2"}) == ["1", "2"] and resolve.choose_sites("f", "both", {}) == ["f"]
    assert resolve.latest_version(50, 42, "u{}", lambda u: 200 if u == "u47" else 404) == 47
    with pytest.raises(ConnectionError):
        resolve.latest_version(50, 42, "u{}", lambda u: None)
    k = resolve.cache_key([best], "v1")
    with open(best, "w") as f:
        f.write("other text")
    assert resolve.cache_key([best], "v1") != k


def test_cached_tables(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return {"t": spark.range(3)}

    for _ in range(2):
        assert resolve.cached(spark, str(tmp_path), "k", build)["t"].count() == 3
    assert len(built) == 1


def test_lists(spark, tmp_path):
    with gzip.open(tmp_path / "w.txt.gz", "wt") as f:
        f.write("AAA-1\n\n  BBB \nAAA-1\n")
    df = text.lines(spark, str(tmp_path / "w.txt.gz"))
    assert sorted(r.barcode for r in text.parse_barcodes(df).collect()) == ["AAA-1", "BBB"] and sorted(r.barcode for r in text.parse_barcodes(df, True).collect()) == ["AAA", "BBB"]
    with pytest.raises(ValueError):
        text.obs_columns(spark.range(1))
    (tmp_path / "r.fa").write_text(">c1 x\nACGTA\nCC\n>c2\nggg\n")
    assert {(r.contig, r.chunk_id): r.seq for r in text.read_fasta(spark, str(tmp_path / "r.fa"), 4).collect()} == {("c1", 0): "ACGT", ("c1", 1): "ACC", ("c2", 0): "GGG"}
    assert os.path.exists(tmp_path / "r.fa")


def test_run_of_a_decides_a_locus(spark, files):
    """A significant locus without junctions near a site is a hotspot if the sequence goes on with a run of A, else novel."""
    seq = {}
    for name, run in (("a", "A" * 6), ("c", "C" * 6)):
        bases = "ACGT" * 15_000
        seq[name] = bases[:30_105] + run + bases[30_111:]
        (files / f"{name}.fa").write_text(">chr1\n" + "\n".join(seq[name][i : i + 60] for i in range(0, 60_000, 60)) + "\n")
    (files / "sites.bed").write_text("chr1\t30099\t30101\n")
    rows = [(f"n{i}", 0, "chr1", 30_000, f"{C1[:-1]}{'ACGT'[i % 4]}", 1, None, None) for i in range(40)]
    (files / "n.sam").write_text(HEADER + "".join(f"{q}\t{fl}\t{c}\t{p + 1}\t60\t100M\t*\t0\t0\t{'ACGT' * 25}\t*\tCB:Z:{cb}\tUB:Z:{q}\tNH:i:{nh}\n" for q, fl, c, p, cb, nh, _, _ in rows))
    reads = plans.load(spark, str(files / "n.sam"))
    index = plans.build_index(spark, plans.Settings(gtf=str(files / "a.gtf.gz")))
    # a background so thin that the locus stands out
    index["intergenic"] = index["intergenic"].unionByName(index["intergenic"].limit(1).withColumns({"contig": F.lit("chr9"), "s": F.lit(0).cast("long"), "e": F.lit(2_000_000_000).cast("long")}))
    for name, want in (("a", "intergenic_hotspot"), ("c", "intergenic_novel")):
        s = plans.Settings(gtf=str(files / "a.gtf.gz"), reference=str(files / f"{name}.fa"), polya_sites=[str(files / "sites.bed")])
        out = plans.run_sample(spark, reads, s, index)
        locus = out["loci"].first()
        assert locus.category == want and locus.near_polya_site and locus.polya_run_downstream == (name == "a")
        assert {r.category for r in out["counts"].where("n_reads > 0").collect()} == {want}
