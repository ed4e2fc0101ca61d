"""Single-read rules: the tables of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from hushgrain.functions import names
from hushgrain.functions import reads as R
from hushgrain.operators import cascade, sequence


def values(spark, schema, rows, **cols):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in cols.items()]).collect()]


def test_junctions_blocks_ends(spark):
    rows = [("100M", 5), ("50M10000N50M", 1000), ("30M500N30M1000N30M", 0), ("5S10M2I3D10M4H", 100), ("*", 7), (None, 7)]
    got = values(spark, "cigar string, pos long", rows, j=R.junctions(), e=R.ref_end(), n=R.aligned_length(), b=R.blocks())
    assert [g[0] for g in got] == [[], [1050], [30, 560], [], [], []]
    assert [g[1] for g in got] == [105, 11100, 1590, 123, 7, 7]
    assert [g[2] for g in got] == [100, 100, 90, 22, 0, 0]
    assert [[tuple(x) for x in g[3]] for g in got][3] == [(100, 110), (113, 123)]


def test_tso(spark):
    tso = "AAGCAGTGGTATCAACGCAGAGTACATGGG"
    rows = [(tso[:20] + "ACGT" * 25, "20S100M"), ("G" * 10 + "ACGT" * 25, "10S100M"), ("ATCGATCG" * 15, "8S112M"), ("G" * 100, "100M"), ("ACGT" * 25 + "g" * 8, "100M8S"), ("G" * 110, "5H10S100M"), ("GGGGGGGGGG", "10S"), (None, "5S5M"), ("ACG", None)]
    assert [g[0] for g in values(spark, "seq string, cigar string", rows, t=R.is_tso_invasion())] == [True, True, False, False, True, False, True, False, False]


@pytest.mark.parametrize("strict", [True])
def test_chimeric_sa(spark, strict):
    rows = [("chr2,100,+,50M,60,0;", "chr1", 100, "+"), ("chr1,100,-,50M,60,0;", "chr1", 100, "+"), ("chr1,60000,+,50M,60,0;", "chr1", 1000, "+"), ("chr1,3000,+,50M,60,0;", "chr1", 1000, "+"), (None, "chr1", 1, "+"), ("chr2,x,+;chr2", "chr1", 1, "+"), ("chr1,2,+,1M;chr3,5,+,1M;", "chr1", 1, "+"), ("", "chr1", 1, "+")]
    assert [g[0] for g in values(spark, "sa string, contig string, pos long, strand string", rows, c=R.is_chimeric_sa())] == [True, True, True, False, False, False, True, False]


def test_chimeric_pair(spark):
    rows = [(1 | 8, None, "chr1", "chr1", 0), (1, None, "chr1", "chr2", 0), (1, None, "chr1", "chr1", 2_000_000), (1, None, "chr1", "chr1", 350), (0, None, "chr1", "chr2", 0), (1, None, "chr1", None, 2_000_000), (1, "chr1,1,+,1M", "chr1", "chr2", 0), (None, None, None, None, None)]
    assert [g[0] for g in values(spark, "flag int, sa string, contig string, next_contig string, tlen long", rows, c=R.is_chimeric_pair())] == [True, True, True, False, False, False, False, False]


def test_length_bins_ends_inserts(spark):
    rows = [(n,) for n in (149, 150, 499, 500, 999, 1000, 2000, 5000, 10000, None)]
    assert [g[0] for g in values(spark, "n int", rows, b=R.length_bin("n"))] == [0, 1, 1, 2, 2, 3, 4, 5, 5, None]
    ends = values(spark, "strand string, pos long, ref_end long", [("-", 1000, 6200), ("+", 1000, 6200)], a=R.five_prime(), b=R.three_prime())
    assert ends == [(6200, 1000), (1000, 6200)]
    keep = values(spark, "flag int, tlen long", [(67, 1), (67, 1999), (67, -500), (67, 0), (67, 2000), (3, 100), (2, 100), (None, None)], k=R.is_insert())
    assert [k[0] for k in keep] == [True, True, True, False, False, False, False, False]


def test_barcodes(spark):
    df = spark.createDataFrame([("A", 1), ("B", 2), (None, 3), ("", 4), ("A-1", 5)], "cb string, is_unassigned int").drop("is_unassigned")
    white = spark.createDataFrame([("A",), ("A",), (None,)], "barcode string")
    got = {r.cb: (r.cell_barcode, r.is_unassigned) for r in cascade.with_barcode(df, white).collect()}
    assert got == {"A": ("A", False), "B": ("B", True), None: ("", True), "": ("", True), "A-1": ("A-1", True)}
    assert {r.cb: r.cell_barcode for r in cascade.with_barcode(df).collect()}[None] == "NO_BARCODE"
    assert sorted(r.cb for r in cascade.called_cells(df, white).collect()) == ["A", "A-1"]
    c = cascade.counters(df.withColumn("flag", F.lit(0)), white).first()
    assert (c.n_processed, c.n_skipped, c.n_skipped_not_called) == (5, 0, 3)


def test_names(spark):
    got = values(spark, "c string", [("acg-1",), ("ACG",), (None,), ("",)], b=names.barcode(F.col("c")), u=names.umi(F.col("c")))
    assert got == [("ACG", "ACG-1"), ("ACG", "ACG"), ("", None), ("", None)]
    contigs = spark.createDataFrame([("chr1", "1"), ("chrM", "MT"), (None, "9"), ("chrZ", None)], "contig string, ensembl_name string")
    df = spark.createDataFrame([("CHR1",), ("1",), ("mt",), ("9",), (None,), ("chrz",)], "contig string")
    assert [r.contig_key for r in names.with_contig(df, contigs).orderBy("contig").collect()] == [None, "chr1", None, "chr1", "chrZ", "chrM"]


def test_sequence(spark):
    """Windows across chunk borders, at the end, and of unknown contigs."""
    seq = "ACGTTGCAAC" "AAAAAAGGTC" "GT"
    chunks = spark.createDataFrame([("c", i, seq[10 * i : 10 * i + 10]) for i in range(3)], "contig string, chunk_id long, seq string")
    df = spark.createDataFrame([("c", 8), ("c", 20), ("c", 99), ("d", 0), (None, 1), ("c", None)], "contig string, pos_at long")
    got = {(r.contig, r.pos_at): r.bases for r in sequence.fetch(df, chunks, "contig", "pos_at", 6, 10).collect()}
    assert got == {("c", 8): "ACAAAA", ("c", 20): "GT", ("c", 99): "", ("d", 0): "", (None, 1): "", ("c", None): ""}
    j = spark.createDataFrame([("c", "+", 17), ("c", "-", 0), ("c", "+", 0), ("d", "+", 5)], "contig string, strand string, junction long")
    got = {(r.contig, r.strand, r.junction): r.is_canonical for r in sequence.with_donor(j, chunks, 10).collect()}
    assert got == {("c", "+", 17): True, ("c", "-", 0): True, ("c", "+", 0): False, ("d", "+", 5): True}
