"""Items of varying size into containers of fixed capacity.

Vector best fit: a container has residual capacities of tokens, of items and of attention
cost (the sum of squared sizes).  Items come in decreasing size; each goes into the open
container that it fits under every constraint and that scores best: least weighted norm of
the residual left over, or largest weighted dot-product of item and residual.  Items that
fit nowhere open a container.  An item that is too costly for a shared container has one of its own.

Items are spread by hash over shards of about ``shard_items`` each, which are packed
independently: a shard's containers are full but for its last few, so the space lost to
sharding is at most about one container a shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushgrain.storage import materialise

CAPACITY = 2048
MAX_ITEMS = 128
SHARD_ITEMS = 8192
WEIGHTS = (1.0, 0.01, 0.01)
#: Attention cost of a shared container, as a share of a full item's.
COST_SHARE = 0.8


def vector_best_fit(sizes: np.ndarray, capacity: int, max_items: int, max_cost: int, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> np.ndarray:
    """The container number of each item.  Sizes are at most ``capacity``; an item whose square exceeds ``max_cost`` is alone in its container."""
    sizes = np.asarray(sizes, np.int64)
    if len(sizes) and (sizes.max() > capacity or sizes.min() < 0):
        raise ValueError("an item exceeds the capacity")
    order = np.argsort(-sizes, kind="stable")
    where = np.empty(len(sizes), np.int64)
    left = np.empty((3, max(16, len(sizes))), np.int64)  # open containers only
    number = np.empty(left.shape[1], np.int64)
    n_open = made = 0
    scale = np.array([capacity, max_items, max_cost], float)
    w = np.asarray(weights, float)
    least = sizes[order[::-1]] if len(sizes) else sizes
    smallest = least[0] if len(sizes) else 0
    for item in order:
        s = sizes[item]
        if s * s > max_cost:
            where[item] = made
            made += 1
            continue
        need = np.array([s, 1, s * s], np.int64)
        now = left[:, :n_open]
        fits = np.flatnonzero((now[0] >= s) & (now[1] >= 1) & (now[2] >= s * s))
        if len(fits):
            rest = now[:, fits]
            if rule == "norm":
                score = -(w[:, None] * ((rest - need[:, None]) / scale[:, None]) ** 2).sum(0)
            else:
                score = (w[:, None] * (rest / scale[:, None]) * (need / scale)[:, None]).sum(0)
            at = fits[int(np.argmax(score))]
            left[:, at] -= need
            where[item] = number[at]
        else:
            at = n_open
            left[:, at] = (capacity - s, max_items - 1, max_cost - s * s)
            number[at] = where[item] = made
            made += 1
            n_open += 1
        if left[0, at] < smallest or left[1, at] < 1:  # full: no remaining item fits
            n_open -= 1
            left[:, at], number[at] = left[:, n_open], number[n_open]
    return where


def pack(sizes: DataFrame, ident: str, size: str, capacity: int = CAPACITY, max_items: int = MAX_ITEMS, max_cost: int | None = None, shard_items: int = SHARD_ITEMS, rule: str = "norm") -> DataFrame:
    """``ident, piece_no, n_tokens, container_id``: every item in exactly one container.

    An item above ``capacity`` is cut into pieces of ``capacity`` and a rest; no other item is
    split.  A null or negative size counts as 0; items of size 0 take no space but count as items.
    ``max_cost`` limits the squared sizes of a container with several items (by default
    ``COST_SHARE`` of ``capacity ** 2``); an item beyond it alone has a container of its own, since
    only the capacity splits.  Equal sizes are taken in the order of ``ident``; an empty table gives an empty one.
    """
    max_cost = int(capacity**2 * COST_SHARE) if max_cost is None else max_cost
    if max_cost < 0 or max_items < 1 or capacity < 1:
        raise ValueError("a container must take an item")
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    pieces = sizes.select(F.col(ident), n.alias("_n")).withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(_n - 1) div {capacity}")).cast("int"))))
    pieces = pieces.select(ident, "piece_no", F.least(F.lit(capacity).cast("long"), F.col("_n") - F.col("piece_no") * capacity).alias("n_tokens"))
    pieces = materialise(pieces, "pieces")
    shards = max(1, -(-pieces.count() // shard_items))
    kind = sizes.schema[ident].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([ident, "piece_no", "n_tokens"], kind="stable")
        bins = vector_best_fit(pdf["n_tokens"].to_numpy(), capacity, max_items, max_cost, rule=rule)
        return pdf.assign(container_id=pdf["_shard"] * (1 << 32) + bins)[[ident, "piece_no", "n_tokens", "container_id"]]

    sharded = pieces.withColumn("_shard", F.pmod(F.xxhash64(ident, "piece_no"), F.lit(shards)))
    # a shard is small in bytes but takes a second, so tasks are not to be joined by size
    tasks = min(shards, 3 * sizes.sparkSession.sparkContext.defaultParallelism)
    return sharded.repartition(tasks, "_shard").groupBy("_shard").applyInPandas(run, f"`{ident}` {kind}, piece_no int, n_tokens bigint, container_id bigint")


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``container_id, n_items, n_tokens, attention_cost, unused``."""
    t = F.col("n_tokens")
    return packed.groupBy("container_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum(t).alias("n_tokens"), F.sum(t * t).alias("attention_cost")).withColumn("unused", F.lit(capacity) - F.col("n_tokens"))
