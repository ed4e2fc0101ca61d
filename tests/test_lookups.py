"""What the driver gathers and sends is bounded, whatever the tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hushgrain import storage

DATA = "/root/testdata/sf0.01"


def text_bytes(df):
    return df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]


def test_lookup_of_many_rows_is_not_broadcast(spark):
    left = spark.range(100).selectExpr("id AS k", "id AS v")
    for rows, sent in ((9_000, True), (20_000, False)):
        j = storage.lookup_join(left, spark.range(rows).selectExpr("id AS k", "id AS w"), ["k"])
        assert ("strategy=broadcast" in j._jdf.queryExecution().analyzed().toString()) == sent
        assert j.count() == 100
    wide = spark.range(5_000).selectExpr("id AS k", "repeat('x', 200) AS w")
    assert not storage.is_small(wide) and storage.is_small(wide.limit(1_000))


@pytest.mark.parametrize("where", [None, "w >= 0"])
def test_salted_copies_are_not_broadcast(spark, where):
    """A lookup of small files and many rows stays in the executors, though its file is below the planner's threshold."""
    right = storage.materialise(spark.range(30_000).selectExpr("id % 7 AS k", "cast(0 AS bigint) AS w").repartition(1), "t")
    for how in ("inner", "left", "left_semi", "left_anti"):
        j = storage.lookup_join(spark.range(100).selectExpr("id AS k", "id AS v"), right, ["k"], how, where=F.expr(where) if where else None)
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    storage.release(right)


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["junction_known", "self_overlap", "build_index", "cluster_reads"])
def test_lookups_of_queries(spark, monkeypatch, name):
    """No side above half a megabyte is broadcast by a query on genes, exons or loci."""
    sent, measure = [], storage.is_small

    def spy(df, *limits):
        small = measure(df, *limits)
        if small:
            sent.append(text_bytes(df))
        return small

    monkeypatch.setattr(storage, "is_small", spy)
    assert not entry.queries()[name](spark, DATA).isEmpty()
    assert max([0, *sent]) <= 512 << 10


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_alignments_beyond_31_bits(spark, tmp_path):
    """At sixty times the parts some reads lie at positions that a record can't hold; they come back from the pieces of their contig."""
    shifted = spark.read.parquet(f"{DATA}/lineitem.parquet").where("l_orderkey < 3000").withColumn("l_partkey", F.col("l_partkey") + F.col("l_linenumber").cast("long") * 200_000)
    shifted.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = entry.queries()["scan_bam"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["scan_bam"])
    names = [c[0] for c in want.description]
    rows = want.fetchall()
    assert max(r[names.index("pos")] for r in rows) > 1 << 31
    assert sorted(map(str, ([r[n] for n in names] for r in got.collect()))) == sorted(map(str, map(list, rows)))
