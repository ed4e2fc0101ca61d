"""Queries run over every row of their tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


def against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got = entry.queries()[name](spark, DATA)
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = [tuple(r) for r in got.collect()]
    assert plain(rows, got.columns) == plain(want.fetchall(), names)
    return [dict(zip(got.columns, r)) for r in rows]


def test_every_part_and_order(spark):
    """2,000 genes and the sites of 15,000 orders."""
    assert len({r["gene_id"] for r in against_sql(spark, "exon_union_per_gene")}) == 2000
    assert len(against_sql(spark, "scan_bed_sites")) > 10_000


@pytest.mark.parametrize("name", ["introns", "self_overlap", "nearest_within"])
def test_whole_against_sql(spark, name):
    assert against_sql(spark, name)


@pytest.mark.parametrize("name", ["locus_decision", "polya_context"])
def test_fetched_against_sql(spark, name):
    """The run of A comes from the sequence."""
    assert against_sql(spark, name)


def test_every_library(spark):
    """The cells of all libraries are evaluated."""
    assert len({r["cell_barcode"].split("/")[0] for r in against_sql(spark, "noise_dose_response")}) > 10
    assert against_sql(spark, "per_category_accuracy") and against_sql(spark, "artifact_flag_accuracy")


def test_every_contig_and_chunk(spark):
    """Five contigs with a chunk for every part."""
    rows = against_sql(spark, "scan_fasta")
    assert {r["contig"] for r in rows} == {f"chr{i}" for i in range(1, 6)} and len(rows) == 5 * 2000
