"""Metrics, loci, comparison, evaluation, figures and the stream, on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from hushgrain import constants as C
from hushgrain.functions.tails import poisson_upper
from hushgrain.operators import compare, figures, intergenic, metrics
from hushgrain.streaming import counts as stream

COUNTS = "sample_id string, cell_barcode string, category string, n_reads long, n_bases long, n_umis long"


def test_poisson_tail():
    for n, lam in ((1, 0.5), (3, 0.01), (5, 20.0), (40, 30.0), (1, 1e-12)):
        direct = 1 - sum(math.exp(-lam + k * math.log(lam) - math.lgamma(k + 1)) for k in range(n))
        assert poisson_upper(n, lam) == pytest.approx(direct, rel=1e-6, abs=1e-15)
    assert 0 < poisson_upper(50, 0.001) < 1e-150 and poisson_upper(0, 5) == 1 and poisson_upper(3, 0) == 1
    assert poisson_upper(1000, 1200.0) > 0.999 and 0 < poisson_upper(2000, 1000.0) < 1e-100


def test_cell_columns(spark):
    df = spark.createDataFrame([("s", "AACG", "exonic_sense", 80, 800, 40), ("s", "AACG", "intronic_pure", 20, 200, 0), ("s", "few", "chimeric", 9, 90, 9), ("t", "", None, 30, 0, 0)], COUNTS)
    got = {(r.sample_id, r.cell_barcode): r for r in metrics.cell_metrics(df, ["sample_id"]).collect()}
    r = got[("s", "AACG")]
    assert ("s", "few") not in got and r.read_frac_exonic_sense == 0.8 and r.base_frac_intronic_pure == 0.2 and r.noise_read_frac == 0.2
    assert r.umi_complexity_exonic_sense == 0.5 and r.umi_complexity_chimeric is None and all(f"read_frac_{c}" in r for c in C.CATEGORY_ORDER)
    s = {x.sample_id: x for x in metrics.sample_metrics(df, metrics.cell_metrics(df, ["sample_id"]), ["sample_id"]).collect()}
    assert s["s"].n_reads_classified == 109 and s["s"].n_cells == 1 and s["s"].strand_concordance == 1 and s["t"].base_frac_chimeric == 0
    n = metrics.noise_fractions(df, ["sample_id"]).where("sample_id = 's'").first()
    assert n.noise_read_frac == pytest.approx(29 / 109) and n.noise_read_frac_strict == pytest.approx(9 / 109) and n.noise_read_frac_strict <= n.noise_read_frac
    assert metrics.cell_metrics(df.limit(0), ["sample_id"]).count() == 0


def test_counts_from_reads(spark):
    rows = [("s", "c", "exonic_sense", "u1", {"exonic_sense": 20, "chimeric": 5}), ("s", "c", "exonic_sense", "u1", {"exonic_sense": 10}), ("s", "c", "exonic_sense", "", None), ("s", None, None, None, {})]
    df = spark.createDataFrame(rows, "sample_id string, cell_barcode string, category string, umi string, base_counts map<string,bigint>")
    got = {(r.cell_barcode, r.category): (r.n_reads, r.n_bases, r.n_umis) for r in metrics.cell_counts(df, ["sample_id"]).collect()}
    assert got == {("c", "exonic_sense"): (3, 30, 1), ("c", "chimeric"): (0, 5, 0), (None, None): (1, 0, 0)}
    off = {(r.cell_barcode, r.category): r.n_umis for r in metrics.cell_counts(df, ["sample_id"], dedup=False).collect()}
    assert set(off.values()) == {0}


def test_stratification(spark):
    bins = spark.createDataFrame([("s", "exonic_sense", 0, 3), ("s", "chimeric", 1, 1), ("s", "chimeric", 5, 4)], "sample_id string, category string, bin int, n_reads long")
    for median, labels in ((200.0, {"<150", "150–500", ">5000"}), (400.0, {"<500", ">5000"}), (None, {"<500", ">5000"})):
        m = spark.createDataFrame([("s", median)], "sample_id string, median_length double")
        rows = metrics.length_stratification(bins, m, ["sample_id"]).collect()
        assert {r.length_bin for r in rows} == labels and sum(r.fraction_of_total for r in rows) == pytest.approx(1)
        for b in labels:
            assert sum(r.fraction_of_bin for r in rows if r.length_bin == b) == pytest.approx(1)


def test_clusters(spark):
    rows = [("s", f"c{i}", "exonic_sense" if j < 10 - i else "chimeric", 10, 10, 1) for i in range(6) for j in range(10)]
    cells = metrics.cell_metrics(spark.createDataFrame(rows, COUNTS), ["sample_id"])
    obs = spark.createDataFrame([(f"c{i}", "T" if i < 3 else "B") for i in range(6)], "cell_barcode string, cluster string")
    got = {r.cluster: r for r in metrics.cluster_metrics(cells, obs).collect()}
    assert got["T"].n_cells == got["B"].n_cells == 3 and got["B"].median_noise_read_frac == pytest.approx(0.4) and got["T"].iqr_noise_read_frac == pytest.approx(0.1)
    assert metrics.cluster_metrics(cells, obs.where("cluster = 'x'")).count() == 0


REC = "qname string, contig string, start_pos long, end_pos long, strand string, cell_barcode string, has_junction boolean, three_prime long"


def records(spark, spec):
    rows = [(f"{name}{i}", "chr1", at + i, at + i + 100, strand, f"cb{i % bars}", junction, at + i + (100 if strand == "+" else 0)) for name, at, n, bars, strand, junction in spec for i in range(n)]
    return intergenic.records(spark.createDataFrame([*rows, ("bad", None, 1, 2, "+", "x", None, 1), ("bad2", "chr1", None, 2, "+", None, None, 1)], REC))


def test_loci(spark):
    """Repeat before significance, hotspot, novel, the rest hotspot, too few barcodes or reads sparse."""
    r = records(spark, [("rep", 100, 2, 1, "+", False), ("hot", 10_000, 20, 5, "+", False), ("new", 20_000, 20, 5, "-", True), ("one", 30_000, 20, 1, "+", True), ("few", 40_000, 4, 4, "+", True), ("oth", 50_001, 20, 5, "+", False)])
    found = intergenic.loci(intergenic.cluster(r, []), [])
    assert found.count() == 6
    repeats = spark.createDataFrame([("chr1", 50, 300)], "contig string, s long, e long")
    sites = spark.createDataFrame([("chr1", 99)], "contig string, pos long")
    s = intergenic.score(found, r, [], 2_000_000_000, repeats, sites, F.col("start_pos") == 10_000)
    got = {x.start_pos: x for x in s.collect()}
    assert {k: v.category[11:] for k, v in got.items()} == {100: "repeat", 10_000: "hotspot", 20_000: "novel", 30_000: "sparse", 40_000: "sparse", 50_001: "hotspot"}
    assert got[10_000].poisson_pvalue_adj < 1e-20 and got[20_000].n_barcodes == 5 and not got[20_000].is_monoexonic
    none = intergenic.score(found, r, [], 0).collect()
    assert all(x.poisson_pvalue == 1 and x.category == "intergenic_sparse" for x in none)
    assert intergenic.loci(intergenic.cluster(r.limit(0), []), []).count() == 0


def test_modal_end_and_reallocation(spark):
    rows = [(f"q{i}", "chr1", 10 + i, 200, "+", "CB1", True, e) for i, e in enumerate([500, 500, 600, 600, 300])]
    r = intergenic.records(spark.createDataFrame(rows, REC))
    clustered = intergenic.cluster(r, [])
    assert intergenic.loci(clustered, []).first().modal_three_prime == 500
    ten = spark.createDataFrame([(f"q{i}", "chr1", 10 + i if i < 5 else 90_000 + 2000 * i, 200 if i < 5 else 90_100 + 2000 * i, "+", "CB1", True, 1) for i in range(10)], REC)
    c = intergenic.cluster(intergenic.records(ten), [])
    scored = intergenic.loci(c, []).withColumn("category", F.when(F.col("start_pos") == 10, "intergenic_novel").otherwise("intergenic_sparse"))
    counts = spark.createDataFrame([("CB1", "intergenic_sparse", 100, 10_000), ("CB2", "intergenic_sparse", 7, 70)], "cell_barcode string, category string, n_reads long, n_bases long")
    got = {(x.cell_barcode, x.category): (x.n_reads, x.n_bases) for x in intergenic.reallocate(counts, c, scored, []).collect()}
    assert got == {("CB1", "intergenic_sparse"): (50, 5000), ("CB1", "intergenic_novel"): (50, 5000), ("CB2", "intergenic_sparse"): (7, 70)}


def test_chi2(spark):
    t = spark.createDataFrame([("a", "exonic_sense", 20), ("a", "chimeric", 10), ("b", "exonic_sense", 40), ("b", "chimeric", 30)], "side string, category string, n_reads long")
    got = {r.category: r for r in compare.chi2(t, "side", "a", "b").collect()}
    assert got["chimeric"].chi2 == pytest.approx(0.4464, abs=1e-4) and got["chimeric"].p_value == pytest.approx(0.5040, abs=1e-4) and got["chimeric"].p_adjusted == 1
    assert got["unmapped"].chi2 is None and got["unmapped"].p_value is None and len(got) == 19
    assert compare.chi2(t.where("side = 'a'"), "side", "a", "b").count() == 0


def test_figures(spark):
    df = spark.createDataFrame([("s", float(v)) for v in (0, 1, 2, 9, 10)] + [("t", 4.0), ("t", None)], "k string, v double")
    got = {(r.k, r.bin): r["count"] for r in figures.histogram(df, ["k"], "v", 5).collect()}
    assert got == {("s", 0): 2, ("s", 1): 1, ("s", 4): 2, ("t", 0): 1}
    assert figures.legend(spark).where("is_strict").count() == 5


def test_stream(spark, tmp_path):
    batch = spark.createDataFrame([("r1", "c", 10), ("r1", "c", 10), ("r2", "c", None)], "qname string, cell string, read_length int").withColumn("at", F.lit("2031-01-01").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "in"))
    s = stream.distinct_reads(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), "qname", "at")
    q = stream.running_counts(s, ["cell"]).writeStream.outputMode("complete").format("memory").queryName("hg_counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("hg_counts").collect()] == [("c", 2, 10)]


def test_least_barcodes_of_all_reads(spark):
    """Of 50,000 barcodes a locus needs 5, however few of them have intergenic reads."""
    r = records(spark, [("few", 10_000, 20, 4, "+", True), ("many", 90_000, 20, 5, "+", True)]).withColumn("sample_id", F.lit("a"))
    found = intergenic.loci(intergenic.cluster(r, ["sample_id"]), ["sample_id"])
    every = spark.range(50_000).select(F.lit("a").alias("sample_id"), F.concat(F.lit("cb"), "id").alias("cell_barcode"))
    for barcodes, want in ((every, {10_000: "sparse", 90_000: "novel"}), (every.where("sample_id = 'x'"), {10_000: "novel", 90_000: "novel"})):
        got = intergenic.score(found, r, ["sample_id"], 2_000_000_000, barcodes=barcodes).collect()
        assert {x.start_pos: x.category[11:] for x in got} == want
    whole = intergenic.score(found.drop("sample_id"), r.drop("sample_id"), [], 2_000_000_000, barcodes=every.drop("sample_id")).collect()
    assert {x.start_pos: x.min_barcodes for x in whole} == {10_000: 5, 90_000: 5}
