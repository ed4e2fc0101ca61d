"""Interval algebra on 0-based half-open intervals ``s, e``.

Everything is built from windows and equi-joins.  Range joins go through position bins:
both sides are cut at bin borders, so overlaps within bins add up to the whole without
removing duplicates.  Islands are found among distinct starts within bins first and stitched over the far fewer
partial islands, so that no task sorts all intervals of a hot contig or bin.

Rows with a null bound or ``e <= s`` are no intervals and are left out.  Bookended
intervals merge.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hushgrain.storage import lookup_join, materialise

#: Bases in a bin of range joins and of partial islands.
BIN = 1 << 14
ISLAND_BIN = 1 << 18


def _valid(df: DataFrame, s: str = "s", e: str = "e") -> DataFrame:
    return df.where(F.col(s) < F.col(e))


def islands(df: DataFrame, keys: list[str], gap: int = 0, island_bin: int = ISLAND_BIN) -> DataFrame:
    """Merge intervals of equal keys that overlap or lie at most ``gap`` apart: ``keys..., s, e``.  Null keys are a key of their own."""
    part = _partial(df, keys, gap, island_bin).groupBy(*keys, "_bin", "_island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return _runs(part, keys, gap).groupBy(*keys, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island")


def _partial(df: DataFrame, keys: list[str], gap: int, island_bin: int) -> DataFrame:
    """The farthest end from each start, numbered by runs within bins.

    Rows of equal start are one before any window sees them, so a window holds at most as
    many rows as its bin has bases, however many intervals gather there.
    """
    starts = _valid(df).withColumn("_bin", F.expr(f"s div {island_bin}")).groupBy(*keys, "_bin", "s").agg(F.max("e").alias("e"))
    return _runs(starts, [*keys, "_bin"], gap)


def _runs(df: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Number the runs: a new one starts beyond the running maximum of the ends."""
    w = W.partitionBy(*keys).orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("_new", F.when(F.col("s") <= before + gap, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w)).drop("_new")


def _keyed(keys: list[str]) -> dict[str, Column]:
    """Keys in a form that equality finds, null ones as well."""
    return {f"_k{i}": F.struct(F.col(f"`{c}`").alias("v")) for i, c in enumerate(keys)}


def label_islands(df: DataFrame, keys: list[str], gap: int, into: str = "locus_id", island_bin: int = ISLAND_BIN) -> DataFrame:
    """Each row with the island it belongs to, and the island's number within its keys.

    Islands are found among distinct starts; rows look theirs up by start.
    """
    starts = _partial(df, keys, gap, island_bin).withColumnRenamed("_island", "_local")
    part = starts.groupBy(*keys, "_bin", "_local").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    whole = _runs(part, keys, gap).withColumn(into, F.col("_island")).withColumns(_keyed(keys)).select(*_keyed(keys), "_bin", "_local", into)
    at = [*_keyed(keys), "s"]
    found = materialise(starts.withColumns(_keyed(keys)).select(*at, "_bin", "_local").join(whole.hint("merge"), [*_keyed(keys), "_bin", "_local"]).select(*at, into), "starts")  # keys are far larger than in files
    # the lookup has a row a start, up to as many as the data, so few copies
    return lookup_join(_valid(df).withColumns(_keyed(keys)), found, at, salts=4).select(*df.columns, into)


def running_max(df: DataFrame, keys: list[str], island_bin: int = ISLAND_BIN) -> DataFrame:
    """Intervals with the running maximum of the ends in the order of ``s, e``: the row's columns and ``max_end``.

    Ends are folded per start, then within bins and over bins, so no window sees a whole contig's rows.
    """
    rows = _valid(df).withColumns(_keyed(keys))
    k = list(_keyed(keys))
    starts = rows.groupBy(*k, F.expr(f"s div {island_bin}").alias("_bin"), "s").agg(F.max("e").alias("_top"))
    over = W.partitionBy(*k).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    bins = starts.groupBy(*k, "_bin").agg(F.max("_top").alias("_top")).select(*k, "_bin", F.max("_top").over(over).alias("_b0"))
    within = W.partitionBy(*k, "_bin").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    before = materialise(starts.withColumn("_b1", F.max("_top").over(within)).join(bins, [*k, "_bin"]).select(*k, "s", F.greatest("_b0", "_b1").alias("_before")), "ends")
    # of rows of one start the ends rise, so a row's own end is the largest so far among them
    return lookup_join(rows, before, [*k, "s"], salts=4).select(*df.columns, F.greatest("_before", "e").alias("max_end"))


def complement(df: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps between merged intervals from 0 to the last one; no tail, and nothing for keys without intervals."""
    w = W.partitionBy(*keys).orderBy("s")
    before = F.lag("e", 1, 0).over(w)
    gaps = islands(df, keys).withColumn("_b", before).where(F.col("s") > F.col("_b"))
    return gaps.select(*keys, F.col("_b").alias("s"), F.col("s").alias("e"))


def _binned(df: DataFrame, width: int, s: str = "s", e: str = "e") -> DataFrame:
    """One row per bin that an interval touches."""
    return df.withColumn("_bin", F.explode(F.sequence(F.expr(f"`{s}` div {width}"), F.expr(f"(`{e}` - 1) div {width}"))))


def overlaps(left: DataFrame, right: DataFrame, on: list[str], width: int = BIN, how: str = "inner") -> DataFrame:
    """Pairs of overlapping rows cut at bin borders: left's columns, right's others, and ``bases``.

    ``right`` has ``on``, ``s`` and ``e`` and columns of its own; its bounds are ``_s`` and ``_e``.
    Sums of ``bases`` over a pair are the pair's overlap.  ``how`` is ``inner`` or ``left``.  The
    overlap is a condition of the match, so neighbours in a bin never leave the join; a small right side is
    broadcast, a large one is salted against bins that hold a large part of the left one.
    """
    r = _binned(_valid(right).withColumnsRenamed({"s": "_s", "e": "_e"}), width, "_s", "_e")
    # both touch the bin and each other, so they overlap within it
    j = lookup_join(_binned(_valid(left), width), r, [*on, "_bin"], how, where=(F.col("_s") < F.col("e")) & (F.col("_e") > F.col("s")))
    start, stop = F.greatest("s", "_s", F.col("_bin") * width), F.least("e", "_e", (F.col("_bin") + 1) * width)
    return j.withColumn("bases", F.when(F.col("_s").isNull(), 0).otherwise(stop - start)).drop("_bin")


def overlap_bases(left: DataFrame, right: DataFrame, ident: list[str], on: list[str], width: int = BIN) -> DataFrame:
    """``ident..., bases``: summed over every interval of ``right``, multiplicity kept; 0 without any."""
    return overlaps(left, right, on, width, "left").groupBy(*ident).agg(F.sum("bases").alias("bases"))


def overlapping(left: DataFrame, right: DataFrame, on: list[str], width: int = BIN) -> DataFrame:
    """Rows of ``left`` that overlap any row of ``right``, repeated rows kept: a semi join by the rows' own values."""
    cols = left.columns
    hits = overlaps(left.distinct(), islands(right, on), on, width).select(*[F.col(c).alias(f"_h_{c}") for c in cols]).distinct()
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_h_{c}"))
    return left.join(hits, same, "left_semi")


def near(df: DataFrame, sites: DataFrame, on: list[str], pos: str, distance: int, into: str = "is_near") -> DataFrame:
    """Whether the nearest of ``sites`` (``on``, ``pos``) lies within ``distance``, both ends included.

    Sites are widened to merged intervals first, so a position lies in at most one and no row
    multiplies.  Positions that are null are near nothing; no rows are dropped.
    """
    zones = islands(sites.where(F.col("pos").isNotNull()).select(*on, (F.col("pos") - distance).alias("s"), (F.col("pos") + distance + 1).alias("e")), on)
    z = _binned_near(zones)
    keyed = df.withColumn("_bin", F.expr(f"cast(floor(`{pos}` / {BIN}) as bigint)"))
    j = lookup_join(keyed, z.groupBy(*on, "_bin").agg(F.collect_list(F.struct("s", "e")).alias("_z")), [*on, "_bin"], "left")
    inside = F.exists("_z", lambda x: (x["s"] <= F.col(pos)) & (F.col(pos) < x["e"]))
    return j.withColumn(into, F.coalesce(inside, F.lit(False))).drop("_bin", "_z")


def _binned_near(zones: DataFrame) -> DataFrame:
    # zones may start below 0, so bins are floors; a bin holds at most BIN / 2 merged zones
    return zones.withColumn("_bin", F.explode(F.sequence(F.expr(f"cast(floor(s / {BIN}) as bigint)"), F.expr(f"cast(floor((e - 1) / {BIN}) as bigint)"))))


def subtract(df: DataFrame, other: DataFrame, ident: list[str], on: list[str], width: int = BIN) -> DataFrame:
    """What is left of each row of ``df`` without the union of ``other`` of equal ``on``.

    ``ident`` names a row (its columns are kept, ``on`` among them).  An untouched row stays whole.
    """
    rows = _valid(df).select(*ident, "s", "e").distinct()
    merged = islands(other, on)
    cut = overlaps(rows, merged, on, width).select(*ident, F.col("s").alias("s0"), F.col("e").alias("e0"), F.greatest("s", "_s").alias("s"), F.least("e", "_e").alias("e")).distinct()
    key = [*ident, "s0", "e0"]
    w = W.partitionBy(*key).orderBy("s")
    gaps = cut.withColumn("_b", F.lag("e").over(w)).withColumn("_last", F.lead("s").over(w).isNull())
    head = gaps.select(*ident, F.coalesce("_b", "s0").alias("s1"), F.col("s").alias("e1"))
    tail = gaps.where("_last").select(*ident, F.col("e").alias("s1"), F.col("e0").alias("e1"))
    untouched = rows.join(cut.select(*ident, F.col("s0").alias("s"), F.col("e0").alias("e")).distinct(), [*ident, "s", "e"], "left_anti").select(*ident, F.col("s").alias("s1"), F.col("e").alias("e1"))
    return head.unionByName(tail).unionByName(untouched).where("s1 < e1").withColumnsRenamed({"s1": "s", "e1": "e"})


def self_overlap(df: DataFrame, on: list[str], ident: str, width: int = BIN) -> DataFrame:
    """Intersections of rows of equal ``on`` and different ``ident``, each pair once, the smaller ident first.

    Adds ``_a`` and ``_b`` copies of the other columns.
    """
    more = [c for c in df.columns if c not in (*on, "s", "e")]
    a = df.select(*on, "s", "e", *[F.col(c).alias(f"{c}_a") for c in more])
    b = df.select(*on, "s", "e", *[F.col(c).alias(f"{c}_b") for c in more])
    pairs = overlaps(a, b, on, width).where(F.col(f"{ident}_a") < F.col(f"{ident}_b"))
    return pairs.select(*on, F.greatest("s", "_s").alias("s"), F.least("e", "_e").alias("e"), *[f"{c}_a" for c in more], *[f"{c}_b" for c in more]).distinct()
