"""Exact percentiles per group by bisection over value intervals.

Each group and percentile keeps an interval that holds the wanted rank.  A pass counts the
rows below the interval's midpoints and keeps the part with the rank, until one value is
left.  Counts below midpoints add up, so partial results of partitions, runs or days merge:
put their weighted values together and call :func:`select` once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hushgrain.storage import lookup_join, materialise, release


def weights(df: DataFrame, keys: list[str], ident: str, value: str, resolution: float = 1) -> DataFrame:
    """``keys..., value, weight``: the mergeable form; each ``ident`` once per group, values in units of ``resolution``.

    It has a row for each distinct value of a group, so for real numbers ``resolution`` is what bounds it.

    Rows with a null identifier or value are left out.
    """
    once = df.where(F.col(ident).isNotNull() & F.col(value).isNotNull()).groupBy(*keys, ident).agg(F.min(value).alias("value"))
    v = F.col("value").cast("long") if resolution == 1 else F.floor(F.col("value") / F.lit(resolution))
    return once.groupBy(*keys, v.alias("value")).agg(F.count(F.lit(1)).alias("weight"))


def percent_ranks(percents: list[int]) -> dict[str, str]:
    """Ranks ``ceil(n * percent / 100)``, at least 1, as expressions of ``n``."""
    return {f"p{p}": f"greatest(1, (n * {int(p)} + 99) div 100)" for p in percents}


def select(data: DataFrame, keys: list[str], ranks: dict[str, str], halvings: int = 4) -> DataFrame:
    """``keys..., n, name, rank, value``: the value at each rank (from 1, ascending) of each group.

    ``data`` has the keys, ``value`` (long) and ``weight``, and should be a materialised table;
    ``ranks`` gives expressions of ``n`` by name.  A pass counts rows below the ``2**halvings - 1``
    midpoints that the next ``halvings`` bisections could ask for, so one pass does several.
    The result is exact in the unit of the values.  Null keys are a group of their own; weights
    below 1 and null values are left out; an empty table gives an empty one.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    named = data.where("value IS NOT NULL AND weight > 0").select(*[F.struct(F.col(f"`{c}`").alias("v")).alias(n) for c, n in zip(keys, k)], "value", "weight")
    groups = named.groupBy(*k).agg(F.sum("weight").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    ask = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.expr(e).cast("long").alias("rank")) for name, e in ranks.items()]))
    state = groups.select(*k, "n", "lo", "hi", ask.alias("_a")).select(*k, "n", "lo", "hi", F.col("_a.name").alias("name"), F.col("_a.rank").alias("rank"), F.col("_a.rank").alias("left"))
    state = materialise(state, "intervals")
    parts = 2**halvings
    while True:
        widest = state.agg(F.max(F.col("hi") - F.col("lo"))).first()[0]
        if not widest:
            break
        open_ = state.where("hi > lo")
        # intervals of a group are the same or apart, so a value lies in at most one and no row multiplies
        ask = open_.select(*k, "lo", "hi").distinct().withColumn("width", F.expr(f"(hi - lo + {parts}) div {parts}"))
        inside = lookup_join(named, ask, k, where=F.col("value").between(F.col("lo"), F.col("hi")))
        counts = inside.groupBy(*k, "lo", "width", F.expr("(value - lo) div width").alias("slot")).agg(F.sum("weight").alias("weight"))
        w = W.partitionBy(*k, "lo").orderBy("slot")  # at most 2**halvings rows
        below = counts.withColumn("below", F.sum("weight").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("weight"))
        kept = open_.join(below, [*k, "lo"]).where("below < left AND left <= below + weight")
        lo = F.col("lo") + F.col("slot") * F.col("width")
        kept = kept.select(*k, "n", lo.alias("lo"), F.least(F.col("hi"), lo + F.col("width") - 1).alias("hi"), "name", "rank", (F.col("left") - F.col("below")).alias("left"))
        new = materialise(kept.unionByName(state.where("hi = lo")), "intervals")
        release(state)
        state = new
    return state.select(*[F.col(f"{n}.v").alias(c) for c, n in zip(keys, k)], "n", "name", "rank", F.col("lo").alias("value"))


def from_bins(parts: DataFrame, keys: list[str], bins: str, edges: list[int], percents: list[int]) -> DataFrame:
    """Percentiles from arrays of bin counts: ``keys..., n, percent, low, high``.

    Bin *i* holds the values from ``edges[i - 1]`` (0 for the first) to below ``edges[i]``; the
    percentile lies in ``[low, high)``, which states its error; ``high`` is null in the last bin.
    Arrays add up over parts; null arrays and null or negative counts count nothing.
    """
    one = parts.select(*keys, F.posexplode(bins).alias("bin", "c")).where("c > 0").groupBy(*keys, "bin").agg(F.sum("c").alias("c"))
    w = W.partitionBy(*keys)
    upto = F.sum("c").over(w.orderBy("bin"))
    run = one.select(*keys, "bin", "c", upto.alias("upto"), F.sum("c").over(w).alias("n")).withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    rank = F.expr("greatest(1, (n * percent + 99) div 100)")
    hit = run.where((rank <= F.col("upto")) & (rank > F.col("upto") - F.col("c")))
    low = F.element_at(F.array(*[F.lit(e) for e in [0, *edges]]), F.col("bin") + 1)
    high = F.try_element_at(F.array(*[F.lit(e) for e in edges]), F.col("bin") + 1)
    return hit.select(*keys, "n", "percent", low.cast("long").alias("low"), high.cast("long").alias("high"))
