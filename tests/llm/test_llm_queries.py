"""Queries of this package against their SQL on the smallest data."""

import os

import duckdb
import pytest

from hushgrain.llm import queries

SMALL = "/root/testdata/sf0.001"


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test data")
@pytest.mark.parametrize("name", ["p2_found", "p2_combinations", "p2_runs", "p2_run_combinations", "p4_length_sample", "p4_piecewise_sample", "p4_parts_sample", "p5_found", "p5_percentiles", "p5_bin_percentiles", "p7_constraints", "p8_found", "p8_shares", "p8_spans", "p8_removed", "p8_classes"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    got = queries.QUERIES[name](spark, SMALL)
    want = con.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), names)
