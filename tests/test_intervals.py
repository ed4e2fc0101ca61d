"""Interval algebra against sets of bases."""

import random

import pytest

from hushgrain.operators import annotation, intervals
from hushgrain.storage import lookup_join


def bases(rows):
    return {(k, p) for k, s, e in rows for p in range(s, e)}


def merged(points):
    out = []
    for k, p in sorted(points):
        if out and out[-1][0] == k and out[-1][2] == p:
            out[-1][2] = p + 1
        else:
            out.append([k, p, p + 1])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed", range(2))
def test_algebra(spark, seed):
    rng = random.Random(seed)

    def some(n):
        return [(rng.choice("ab"), s, s + rng.randint(1, 40)) for s in (rng.randint(0, 900) for _ in range(n))]

    a, b = some(30), some(12)
    da = spark.createDataFrame([(i, *r) for i, r in enumerate(a)] + [(99, "a", 5, 5), (98, None, 1, 3), (97, "a", None, 4)], "i int, k string, s long, e long")
    db = spark.createDataFrame(b, "k string, s long, e long")
    got = [(r.k, r.s, r.e) for r in intervals.islands(da.where("k IS NOT NULL"), ["k"], island_bin=64).collect()]
    assert sorted(got) == merged(bases(a))
    gaps = {(r.k, r.s, r.e) for r in intervals.complement(da.where("k IS NOT NULL"), ["k"]).collect()}
    want = merged({(k, p) for k in "ab" for p in range(max((e for j, s, e in a if j == k), default=0))} - bases(a))
    assert gaps == set(want)
    over = {r.i: r.bases for r in intervals.overlap_bases(da, db, ["i"], ["k"], 32).collect()}
    assert all(over[i] == sum(max(0, min(e, y) - max(s, x)) for j, x, y in b if j == k) for i, (k, s, e) in enumerate(a))
    hit = {r.i for r in intervals.overlapping(da, db, ["k"], 32).collect()}
    assert hit == {i for i, (k, s, e) in enumerate(a) if any(j == k and x < e and s < y for j, x, y in b)}
    left = {}
    for r in intervals.subtract(da.where("k IS NOT NULL"), db, ["i", "k"], ["k"], 32).collect():
        left.setdefault(r.i, set()).update((r.k, p) for p in range(r.s, r.e))
    for i, r in enumerate(a):
        assert left.get(i, set()) == bases([r]) - bases(b)
    near = {r.i: r.is_near for r in intervals.near(da.where("s IS NOT NULL"), db.selectExpr("k", "s AS pos"), ["k"], "s", 10).collect()}
    assert all(near[i] == any(j == k and abs(x - s) <= 10 for j, x, _ in b) for i, (k, s, _) in enumerate(a))


def test_labels_and_gap(spark):
    rows = [(1, "c", 0, 10), (2, "c", 500, 510), (3, "c", 1012, 1020), (4, "c", 1300, 1310), (5, "d", 0, 5), (6, "c", 510, 511)]
    df = spark.createDataFrame(rows, "i int, k string, s long, e long")
    got = {r.i: (r.k, r.locus_id) for r in intervals.label_islands(df, ["k"], 500, island_bin=256).collect()}
    assert got[1] == got[2] == got[6] != got[3] and got[3] == got[4] and got[5] != got[1]


def test_empty(spark):
    e = spark.createDataFrame([], "i int, k string, s long, e long")
    assert intervals.islands(e, ["k"]).count() == 0 and intervals.complement(e, ["k"]).count() == 0
    assert intervals.subtract(e, e, ["i", "k"], ["k"]).count() == 0 and intervals.overlapping(e, e, ["k"]).count() == 0


def test_site_distance(spark):
    sites = spark.createDataFrame([("chr1", p) for p in (1000, 2000, 5000, 10000)], "contig string, pos long")
    df = spark.createDataFrame([("chr1", p) for p in (1000, 1049, 1050, 1051, 1060, 1500, 950, 949)] + [("chr99", 1000), ("chr1", None)], "contig string, at long")
    got = {(r.contig, r["at"]): r.is_near for r in intervals.near(df, sites, ["contig"], "at", 50).collect()}
    assert [k[1] for k, v in got.items() if v and k[0] == "chr1"].sort() == [950, 1000, 1049, 1050].sort()
    assert not got[("chr99", 1000)] and not got[("chr1", None)] and not got[("chr1", 1051)] and got[("chr1", 1050)]


@pytest.mark.parametrize("a,b,want", [("protein_coding", "protein_coding", "shared_cod_cod"), ("protein_coding", "lncRNA", "shared_cod_ncod"), ("processed_pseudogene", "protein_coding", "shared_cod_ncod"), ("lncRNA", "lncRNA", "shared_cod_ncod")])
def test_shared_regions(spark, a, b, want):
    u = spark.createDataFrame([("chr1", "+", "g1", a, 100, 300), ("chr1", "+", "g2", b, 200, 400), ("chr1", "-", "g3", b, 0, 900), ("chr1", "+", "g4", b, 500, 600)], "contig string, strand string, gene_id string, biotype string, s long, e long")
    assert [(r.layer, r.strand, r.s, r.e) for r in annotation.shared_regions(u).collect()] == [(want, "+", 200, 300)]


@pytest.mark.parametrize("rows", [50_000, 0])
def test_hot_bin(spark, monkeypatch, rows):
    """Nine tenths of the intervals lie in one bin: only overlaps leave the join, broadcast or salted, and sums are right."""
    rng = random.Random(7)
    a = [(i, "a", s, s + 30) for i in range(900) for s in [rng.randint(0, 200)]] + [(i, "b", i, i + 30) for i in range(900, 1000)]
    b = [("a", s, s + 5, f"x{s}") for s in range(0, 250, 10)] + [("b", 0, 10_000, "y")]
    left, right = spark.createDataFrame(a, "i int, k string, s long, e long"), spark.createDataFrame(b, "k string, s long, e long, layer string")
    monkeypatch.setattr(intervals, "lookup_join", lambda *x, **k: lookup_join(*x, **k, rows=rows))
    got = intervals.overlaps(left, right, ["k"], 256, "left").collect()
    pairs = [(i, n, min(e, y) - max(s, x)) for i, k, s, e in a for j, x, y, n in b if j == k and x < e and s < y]
    sums = {}
    for r in got:
        if r.layer is not None:
            assert r.bases > 0
            sums[r.i, r.layer] = sums.get((r.i, r.layer), 0) + r.bases
    assert sums == {(i, n): o for i, n, o in pairs}
    assert len(got) <= 1.5 * len(pairs)


def test_islands_of_equal_starts(spark):
    """Many intervals of one start are one row before any window; labels and running maxima hold, null keys as well."""
    rows = [(i, "h" if i % 10 else None, 100, 100 + i % 7 + 1) for i in range(500)] + [(900, "h", 700, 710), (901, "h", 95, 100), (902, None, 650, 660)]
    df = spark.createDataFrame(rows, "i int, k string, s long, e long")
    assert sorted(map(str, ((r.k, r.s, r.e) for r in intervals.islands(df, ["k"], island_bin=64).collect()))) == sorted(map(str, [("h", 95, 107), ("h", 700, 710), (None, 100, 107), (None, 650, 660)]))
    lab = {r.i: r.locus_id for r in intervals.label_islands(df, ["k"], 10, island_bin=64).collect()}
    assert len(lab) == len(rows) and lab[901] == lab[1] != lab[900] and lab[0] == lab[10] != lab[902]
    top = {r.i: r.max_end for r in intervals.running_max(df, ["k"], island_bin=64).collect()}
    for i, k, s, e in rows:
        assert top[i] == max(y for _, j, x, y in rows if j == k and (x, y) <= (s, e))
