"""Problems 2, 4 and 5: bitmaps, samples and percentiles."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hushgrain.llm import bitmaps, percentiles, sampling
from hushgrain.storage import materialise

# --- bitmaps ---


def test_bitmap_sizes():
    for n in (1, 1000, 10**6, 10**9):
        b = bitmaps.log_bits(n, 0.01)
        assert bitmaps.std_error(n, 2**b) <= 0.01
    with pytest.raises(ValueError):
        bitmaps.log_bits(10**17, 0.001)
    with pytest.raises(ValueError):
        bitmaps.log_bits(10, 0)


def test_bitmaps_within_error_and_mergeable(spark):
    """Estimates hold their error; merging halves gives the same bits as the whole; a hot group is no special case."""
    rows = [("hot", str(i % 4000)) for i in range(8000)] + [("a", str(i)) for i in range(300)] + [("b", None)] + [(None, "x"), (None, "x"), (None, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "g string, id string, word int").drop("word")
    bits = bitmaps.log_bits(8000, 0.01)
    whole = {r.g: r for r in bitmaps.estimate(bitmaps.bitmaps(df, ["g"], "id", bits), ["g"], bits).collect()}
    for g, n in (("hot", 4000), ("a", 300), (None, 2)):
        assert abs(whole[g].n_distinct - n) <= max(1, 4 * bitmaps.std_error(n, 2**bits) * n)
    assert "b" not in whole
    parts = [bitmaps.bitmaps(df.where(F.crc32(F.coalesce("id", F.lit(""))) % 2 == i), ["g"], "id", bits) for i in (0, 1)]
    merged = {r.g: r.n_bits_set for r in bitmaps.estimate(bitmaps.merge(parts[0].unionByName(parts[1]), ["g"]), ["g"], bits).collect()}
    assert merged == {g: r.n_bits_set for g, r in whole.items()}
    assert bitmaps.estimate(bitmaps.bitmaps(df.limit(0), ["g"], "id", bits), ["g"], bits).count() == 0


def test_combinations(spark):
    df = spark.createDataFrame([("a", "x", "1"), ("a", "y", "1"), ("b", "x", "2"), (None, "x", "3")], "g string, h string, id string")
    got = {(r.g, r.h, r.level): r.n_bits_set for r in bitmaps.estimate(bitmaps.merge_combinations(bitmaps.bitmaps(df, ["g", "h"], "id", 16), ["g", "h"]), ["g", "h", "level"], 16).collect()}
    assert got[(None, None, 3)] == 3 and got[(None, "x", 2)] == 3 and got[("a", None, 1)] == 1 and got[(None, None, 1)] == 1 and got[("a", "y", 0)] == 1


def test_folded_sizes_merge(spark):
    """A bitmap folds to what the same identifiers set in fewer bits, and results of two sizes merge."""
    df = spark.createDataFrame([("a" if i % 3 else None, f"u{i}") for i in range(3000)], "g string, id string")
    rows = lambda x: sorted((str(r.g), r.word, r.mask) for r in x.collect())
    for bits, to in ((44, 40), (20, 12), (16, 10), (15, 14), (18, 13), (34, 11), (40, 33)):
        assert rows(bitmaps.fold(bitmaps.bitmaps(df, ["g"], "id", bits), ["g"], bits, to)) == rows(bitmaps.bitmaps(df, ["g"], "id", to))
    half = F.crc32("id") % 2 == 0
    merged, bits = bitmaps.merge_sizes([(bitmaps.bitmaps(df.where(half), ["g"], "id", 20), 20), (bitmaps.bitmaps(df.where(~half), ["g"], "id", 16), 16)], ["g"])
    assert bits == 16 and rows(merged) == rows(bitmaps.bitmaps(df, ["g"], "id", 16))
    with pytest.raises(ValueError):
        bitmaps.fold(merged, ["g"], 16, 17)


# --- samples ---


def test_sample_is_bottom_k_whatever_the_pieces(spark):
    rows = [(f"r{i}", "g" if i % 10 else "few" if i < 400 else None, i) for i in range(20_000)] + [("r1", "g", 1)] * 3 + [(None, "g", 5), ("z", "g", None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id string, g string, v int, level int")
    one = sampling.fixed_sample(df.coalesce(1), ["g"], "id", "v", 25, seed=3).collect()
    many = sampling.fixed_sample(df.repartition(7), ["g"], "id", "v", 25, seed=3).collect()
    cut = df.withColumn("half", F.rand(5) < 0.3)
    parts = [sampling.partial_samples(cut.where(c), ["g"], "id", "v", 25, 3) for c in ("half", "NOT half")]
    merged = sampling.merged_sample(parts[0].unionByName(parts[1]), ["g"], 25).collect()
    want = df.where("id IS NOT NULL AND v IS NOT NULL").select("g", "id", sampling.uniform(F.col("id"), seed=3).alias("u")).distinct().collect()
    for g in ("g", "few", None):
        best = {r.id for r in sorted((r for r in want if r.g == g), key=lambda r: r.u)[:25]}
        for got in (one, many, merged):
            assert {r.ident for r in got if r.g == g} == best
    assert Counter(r.g for r in one) == {"g": 25, "few": 25, None: 25}


def test_sample_uniform(spark):
    """Over many seeds every record is taken about equally often."""
    df = spark.createDataFrame([(f"r{i}", "g", i) for i in range(200)], "id string, g string, v int")
    seen = Counter()
    for seed in range(40):
        u = df.select("v", sampling.uniform(F.col("id"), seed=seed).alias("u")).collect()
        seen.update(r.v for r in sorted(u, key=lambda r: r.u)[:50])
    chi = sum((seen[i] - 10) ** 2 / 7.5 for i in range(200))
    assert chi < 200 + 5 * math.sqrt(400)


def test_sample_thinning_never_below_size():
    import numpy as np
    import pandas as pd

    u = np.random.default_rng(1).integers(0, sampling._TOP, 5000)
    buf = pd.DataFrame({"g": "a", "ident": range(5000), "value": 0, "u": u, "level": 0})
    out = sampling._thin(buf, ["g"], 30)
    level = out["level"].iloc[0]
    assert 30 <= len(out) <= 120 and set(out["u"]) == {x for x in u if x < (sampling._TOP >> level)}


def test_sample_of_samples(spark):
    """Sizes are exact, whole parts count as their records, duplicates once; a large part gets its share."""
    rng = random.Random(2)
    parts = [("L", i, 10, [0] * 10) for i in range(30)] + [("L", 99, 600, [1] * 60)] * 2 + [("M", 1, 3, [7, 8, 9]), ("N", 1, 0, []), ("N", 2, None, [4]), ("O", 1, 5, None)]
    rng.shuffle(parts)
    df = spark.createDataFrame([(*p, 1.0) for p in parts], "g string, part int, n int, s array<int>, u double").drop("u")
    total = Counter()
    for seed in range(25):
        got = sampling.sample_of_samples(df, ["g"], ["g", "part"], "n", "s", 30, seed).collect()
        assert Counter(r.g for r in got) == {"L": 30, "M": 3}
        assert all(r.n_records == 900 for r in got if r.g == "L")
        total.update(r.value for r in got if r.g == "L")
    share = total[1] / (total[0] + total[1])
    assert abs(share - 2 / 3) < 4 * math.sqrt(2 / 9 / 750)


def test_sample_empty(spark):
    df = spark.createDataFrame([], "id string, g string, v int")
    assert sampling.fixed_sample(df, ["g"], "id", "v", 5).count() == 0
    assert sampling.sample_of_samples(spark.createDataFrame([], "g string, p int, n int, s array<int>"), ["g"], ["p"], "n", "s", 5).count() == 0


# --- percentiles ---


@pytest.mark.parametrize("halvings", [1, 4])
def test_bisection(spark, halvings):
    rng = random.Random(1)
    groups = {"hot": [rng.randint(-(10**12), 10**12) for _ in range(3000)], "ties": [5] * 50 + [6], "one": [42], None: [1, 2, 3, 4]}
    rows = [(f"{g}{i}", g, v, 1) for g, vs in groups.items() for i, v in enumerate(vs)] + [("one0", "one", 42, 2), (None, "one", 1, 3), ("n", "none", None, 4)]
    df = spark.createDataFrame(rows, "id string, g string, v long, rank int")
    w = materialise(percentiles.weights(df, ["g"], "id", "v"), "w")
    got = {(r.g, r.name): (r.n, r.value) for r in percentiles.select(w, ["g"], percentiles.percent_ranks([1, 50, 100]) | {"upper": "n div 2 + 1"}, halvings).collect()}
    for g, vs in groups.items():
        vs = sorted(vs)
        for p in (1, 50, 100):
            assert got[(g, f"p{p}")] == (len(vs), vs[max(1, -(-len(vs) * p // 100)) - 1])
        assert got[(g, "upper")][1] == vs[len(vs) // 2]
    assert not any(g == "none" for g, _ in got)
    # parts of days merge
    a, b = (percentiles.weights(df.where(F.crc32("id") % 2 == i), ["g"], "id", "v") for i in (0, 1))
    again = {(r.g, r.name): r.value for r in percentiles.select(materialise(a.unionByName(b), "w"), ["g"], percentiles.percent_ranks([50]), halvings).collect()}
    assert all(again[k] == got[k][1] for k in again)


def test_bins_and_empty(spark):
    df = spark.createDataFrame([("a", [0, 5, 5]), ("a", [1, 0, 0]), ("b", None), ("c", [0, 0, 0])], "g string, c array<long>")
    got = {(r.g, r.percent): (r.n, r.low, r.high) for r in percentiles.from_bins(df, ["g"], "c", [100, 200], [1, 50, 100]).collect()}
    assert got == {("a", 1): (11, 0, 100), ("a", 50): (11, 100, 200), ("a", 100): (11, 200, None)}
    e = spark.createDataFrame([], "g string, value long, weight long")
    assert percentiles.select(e, ["g"], {"m": "n"}).count() == 0


def test_resolution(spark):
    df = spark.createDataFrame([(str(i), "g", i / 1000) for i in range(1000)], "id string, g string, v double")
    w = materialise(percentiles.weights(df, ["g"], "id", "v", resolution=0.01), "w")
    r = percentiles.select(w, ["g"], percentiles.percent_ranks([50])).first()
    assert abs(r.value * 0.01 - 0.499) <= 0.01
