"""Per-key counts and quantiles where a few keys hold most of the rows.

Distributed exact selection: each key's values are counted into histograms over the
values' high bits, the bucket that holds the wanted rank is kept, and its bits are
refined in the next pass until one value is left.  Histograms are counts, so they merge:
every task sends at most one row per key and bucket, and no task sees a key's values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hushgrain.storage import lookup_join, materialise, release


def distinct_reads(df: DataFrame, ident: str, keys: list[str]) -> DataFrame:
    """``keys..., n_reads``: distinct ``ident`` per key, exact for keys of any weight.

    The first shuffle is by identifier and key, so a hot key is spread over all tasks;
    the second carries one partial count per task and key.  Rows with a null identifier
    are left out; null keys are a key of their own; no rows give an empty table.
    """
    once = df.where(F.col(ident).isNotNull()).select(ident, *keys).distinct()
    return once.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_reads"))


def weighted(df: DataFrame, keys: list[str], value: str | Column) -> DataFrame:
    """``keys..., value, weight``: how often each value occurs under each key."""
    v = F.col(value) if isinstance(value, str) else value
    return df.groupBy(*keys, v.cast("long").alias("value")).agg(F.count(F.lit(1)).alias("weight"))


def keyed_quantiles(compact: DataFrame, keys: list[str], percents: list[int], bits_per_pass: int = 8) -> DataFrame:
    """Exact quantiles per key by refining histograms of the values' bits.

    ``compact`` has the keys, ``value`` (long) and ``weight`` (as from :func:`weighted`)
    and should be a materialised table.  Returns ``keys..., n`` (weight of the key, null
    values included), ``n_values`` (without them), ``percent`` and ``value``: the value at rank
    ``ceil(n_values * percent / 100)``, at least 1, in ascending order.

    Keys may be null and are then a key of their own.  A key with null values only has
    ``n_values`` 0 and a null value.  Values may be negative.  An empty table gives an
    empty table.  Ties need no rule, since equal values are one histogram entry.
    """
    for p in percents:
        if not 0 < p <= 100:
            raise ValueError(f"percent out of range: {p}")
    wanted = _select(compact, keys, lambda t: t.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents]))).withColumn("rank", F.greatest(F.lit(1), F.expr("(n_values * percent + 99) div 100"))), bits_per_pass)
    return wanted.select(*keys, "n", "n_values", "percent", "value")


def _select(compact: DataFrame, keys: list[str], ask: Callable[[DataFrame], DataFrame], bits_per_pass: int) -> DataFrame:
    """Exact selection: ``keys..., n, n_values``, what ``ask`` adds to the keys' totals, its ``rank`` among them, and the ``value`` of that rank."""
    k = [f"_k{i}" for i in range(len(keys))]
    # null keys get a key that equality finds
    named = compact.select(*[F.struct(F.col(f"`{c}`").alias("v")).alias(n) for c, n in zip(keys, k)], "value", "weight")
    low, high = named.agg(F.min("value"), F.max("value")).first()
    low, span = (0, 0) if low is None else (low, high - low)
    bits = max(1, span.bit_length())
    data = named.withColumn("value", F.col("value") - F.lit(low))
    shift = max(0, bits - bits_per_pass)
    first = data.groupBy(*k, F.shiftright("value", shift).alias("bucket")).agg(F.sum("weight").alias("weight"))
    first = materialise(first, "histogram")
    totals = first.groupBy(*k).agg(F.sum("weight").alias("n"), F.coalesce(F.sum(F.when(F.col("bucket").isNotNull(), F.col("weight"))), F.lit(0)).alias("n_values"))
    asked = ask(totals.select(*k, *[F.col(f"{n}.v").alias(c) for c, n in zip(keys, k)], "n", "n_values"))
    wanted = asked.withColumn("_want", F.col("rank"))
    state = _narrow(wanted.select(*k, F.col("rank").alias("_want"), "rank").distinct().join(first.where("bucket IS NOT NULL"), k), k)
    used = []
    while shift > 0:
        state = materialise(state, "ranks")
        used.append(state)
        done, shift = shift, max(0, shift - bits_per_pass)
        inside = lookup_join(data.withColumn("bucket", F.shiftright("value", done)), state.select(*k, "bucket").distinct(), [*k, "bucket"])
        finer = inside.groupBy(*k, F.col("bucket").alias("above"), F.shiftright("value", shift).alias("bucket")).agg(F.sum("weight").alias("weight"))
        state = _narrow(state.withColumnRenamed("bucket", "above").join(finer, [*k, "above"]), k)
    found = materialise(state.select(*k, "_want", (F.col("bucket") + F.lit(low)).alias("value")).distinct(), "quantiles")
    release(*used)
    return wanted.join(found, [*k, "_want"], "left").drop(*k, "_want")


def _narrow(joined: DataFrame, k: list[str]) -> DataFrame:
    """The bucket that holds the rank, and the rank within it.  At most 2**bits rows a window."""
    w = W.partitionBy(*k, "_want").orderBy("bucket")
    below = F.sum("weight").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("weight")
    return joined.withColumn("_below", below).where("_below < rank AND rank <= _below + weight").select(*k, "_want", (F.col("rank") - F.col("_below")).alias("rank"), "bucket")


def heavy_keys(reads: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Keys that hold at least a share of the distinct reads of their kind.

    ``reads`` has ``key_kind, ident, key_value``; ``shares`` the least share by kind.  Returns
    ``key_kind, key_value, n, total``: the key's reads and the kind's distinct identifiers.

    Reads are put in the order of their key's hash.  A key that holds ``least`` of them fills a run of ranks
    that has a multiple of ``least``, so exact selection at these ranks, at most ``1 / share`` of them, meets
    every such key: histograms of the hashes' bits are refined only where a wanted rank lies, and no table of all
    keys is ever ordered or gathered.  The keys under the few hashes found are then compared with ``least``.

    Each identifier counts once per key; null identifiers are left out.  A null key counts in the
    total but is no key.
    """
    once = reads.where("ident IS NOT NULL").repartition("ident").select("key_kind", "ident", "key_value").distinct()
    counts = once.where("key_value IS NOT NULL").groupBy("key_kind", "key_value").agg(F.count(F.lit(1)).alias("weight"))
    totals = once.groupBy("key_kind", "ident").agg(F.lit(1).alias("one")).groupBy("key_kind").agg(F.count(F.lit(1)).alias("weight"))
    hashed = counts.withColumn("value", F.shiftrightunsigned(F.xxhash64("key_value"), 32))
    both = materialise(hashed.unionByName(totals, allowMissingColumns=True), "weights")
    keys = both.where("key_value IS NOT NULL")
    share = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.col("key_kind")]
    # one row a kind, so this side is tiny whatever the data
    total = F.broadcast(both.where("key_value IS NULL").select("key_kind", F.col("weight").alias("total"), F.greatest(F.lit(1), F.ceil(F.col("weight") * share)).cast("long").alias("least")))

    def ranks(t: DataFrame) -> DataFrame:
        steps = t.join(total, "key_kind").where("n_values >= least")
        return steps.withColumn("rank", F.explode(F.expr("sequence(least, n_values, least)")))

    found = _select(keys, ["key_kind"], ranks, 8).select("key_kind", "value").distinct()
    met = keys.join(F.broadcast(found), ["key_kind", "value"]).join(total, "key_kind")  # 1 / share rows a kind
    return met.where("weight >= least").select("key_kind", "key_value", F.col("weight").alias("n"), "total")
