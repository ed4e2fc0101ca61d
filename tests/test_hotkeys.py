"""Problem 1: per-key counts and quantiles."""

import random

from pyspark.sql import functions as F

from hushgrain.operators import hotkeys
from hushgrain.storage import lookup_join, materialise, release


def test_quantiles_against_sorting(spark):
    """A hot key, ties, single values, null keys and null values, negative numbers."""
    rng = random.Random(3)
    groups = {"hot": [rng.randint(-5000, 10**9) for _ in range(4000)], "ties": [7] * 90 + [8], "one": [-3], "two": [5, 9], None: [1, 2, 3]}
    rows = [(g, v, 1) for g, vs in groups.items() for v in vs] + [("none", None, 1), ("one", None, 2)]
    df = spark.createDataFrame(rows, "k string, v long, bucket int")
    for bits in (3, 8):
        got = {(r.k, r.percent): r for r in hotkeys.keyed_quantiles(materialise(hotkeys.weighted(df, ["k"], "v"), "w"), ["k"], [1, 50, 75, 100], bits).collect()}
        for g, vs in groups.items():
            vs = sorted(vs)
            for p in (1, 50, 75, 100):
                r = got[(g, p)]
                assert (r.n_values, r.value) == (len(vs), vs[max(1, -(-len(vs) * p // 100)) - 1])
        assert got[("one", 50)].n == 2 and got[("none", 50)].value is None and got[("none", 50)].n == 1


def test_heavy_keys(spark):
    """Repeated deliveries count once; a null key counts in the total only; null identifiers count nowhere."""
    rows = [("a", f"r{i}", "x" if i < 5 else "y" if i < 9 else None, i) for i in range(10)] * 3 + [("a", None, "z", 1)] * 50 + [("b", "r1", "", None)]
    df = spark.createDataFrame(rows, "key_kind string, ident string, key_value string, value long")
    got = {(r.key_kind, r.key_value): (r.n, r.total) for r in hotkeys.heavy_keys(df, {"a": 0.4, "b": 0.4}).collect()}
    assert got == {("a", "x"): (5, 10), ("a", "y"): (4, 10), ("b", ""): (1, 1)}
    assert hotkeys.heavy_keys(df.limit(0), {"a": 0.4}).count() == 0


def test_heavy_keys_of_many(spark):
    """Among thousands of keys those at the limit and above are found, also where an identifier has several keys."""
    rows = [("a", f"k{k}", f"{k}-{i}") for k, n in enumerate([400, 300, 200, 101, 100, 99, *[1] * 800]) for i in range(n)]
    df = spark.createDataFrame(rows, "key_kind string, key_value string, ident string")
    assert {r.key_value for r in hotkeys.heavy_keys(df, {"a": 0.05}).collect()} == {"k0", "k1", "k2", "k3", "k4"}
    double = df.withColumn("key_value", F.concat(F.lit("z"), "ident")).unionByName(df)
    assert {(r.key_value, r.n, r.total) for r in hotkeys.heavy_keys(double, {"a": 0.1}).collect()} == {("k0", 400, 2000), ("k1", 300, 2000), ("k2", 200, 2000)}


def test_distinct_reads(spark):
    df = spark.createDataFrame([("r1", "k"), ("r1", "k"), ("r2", None), ("r3", None), (None, "k")], "q string, k string")
    assert {r.k: r.n_reads for r in hotkeys.distinct_reads(df, "q", ["k"]).collect()} == {"k": 1, None: 2}
    assert hotkeys.distinct_reads(df.limit(0), "q", ["k"]).count() == 0


def test_lookup_join_salted_equals_broadcast(spark):
    left = spark.createDataFrame([("hot", i) for i in range(200)] + [("c", 1), (None, 2)], "k string, v int")
    right = spark.createDataFrame([("hot", 1), ("d", 2), (None, 3)], "k string, w int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        small = sorted(map(str, lookup_join(left, right, ["k"], how).collect()))
        salted = sorted(map(str, lookup_join(left, right, ["k"], how, rows=0, salts=3).collect()))
        assert small == salted


def test_materialise_and_release(spark):
    df = materialise(spark.range(5).select(F.col("id")), "t")
    assert df.count() == 5 and "t-" in df.inputFiles()[0]
    release(df)
