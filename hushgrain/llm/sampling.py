"""Uniform samples of fixed size from data that arrive in pieces.

Adaptive Bernoulli sampling.  Every record has a uniform number ``u`` (a hash of its
identity); a buffer at level *l* holds the records with ``u < 2**-l``.  When a buffer
overflows, the inclusion probability is halved and the buffer thinned; buffers merge
after thinning to the highest level; the sample is the ``size`` records with the least
``u``.  A buffer is never thinned below ``size``, so these are the least of *all* records:
each is equally likely, however the data were cut into pieces, and a record delivered
twice, having one ``u``, counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hushgrain.storage import materialise

#: A buffer overflows at this many times the sample's size.
OVERFLOW = 4


def _hash(*idents: Column, seed: int) -> Column:
    """MD5 of a seed and an identity; a null part counts as ``\\N``."""
    return F.md5(F.encode(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(i.cast("string"), F.lit("\\N")) for i in idents]), "UTF-8"))


def uniform(*idents: Column, seed: int = 0) -> Column:
    """A uniform 60-bit number of an identity, the same in every engine."""
    return F.conv(F.substring(_hash(*idents, seed=seed), 1, 15), 16, 10).cast("long")


_BITS = 60
_TOP = 2**_BITS


def _thin(buf: pd.DataFrame, keys: list[str], size: int) -> pd.DataFrame:
    """Halve the probability of each group that overflows until it no longer does."""
    code = buf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
    level = buf["level"].to_numpy(copy=True)
    u = buf["u"].to_numpy()
    keep = np.ones(len(buf), bool)
    top = np.zeros(code.max() + 1 if len(code) else 0, dtype=level.dtype)
    np.maximum.at(top, code, level)  # groups of one task share their level
    while True:
        keep &= u < (_TOP >> top[code].astype(np.int64))
        count = np.bincount(code[keep], minlength=len(top))
        after = np.bincount(code[keep & (u < (_TOP >> (top[code].astype(np.int64) + 1)))], minlength=len(top))
        over = (count > OVERFLOW * size) & (after >= size) & (top < _BITS - 1)
        if not over.any():
            break
        top[over] += 1
    out = buf[keep].copy()
    out["level"] = top[code[keep]]
    return out


def partial_samples(df: DataFrame, keys: list[str], ident: str, value: str, size: int, seed: int = 0) -> DataFrame:
    """``keys..., ident, value, u, level``: one buffer per task and group, made in one pass.

    Tables of this form merge: put those of several pieces together with ``unionByName``.
    Rows with a null identifier or value are no records.
    """
    rows = df.where(F.col(ident).isNotNull() & F.col(value).isNotNull()).select(*keys, F.col(ident).alias("ident"), F.col(value).alias("value"), uniform(F.col(ident), seed=seed).alias("u"), F.lit(0).alias("level"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buf, new, held = None, [], 0
        for part in parts:
            if buf is not None:  # the group's level so far spares most rows the buffer
                part = part[part["u"].to_numpy() < (_TOP >> _levels(buf, part, keys))]
            new.append(part)
            held += len(part)
            if buf is None or held > max(20_000, len(buf)):
                buf = _thin(pd.concat([buf, *new] if buf is not None else new, ignore_index=True).drop_duplicates([*keys, "ident", "value"]), keys, size)
                new, held = [], 0
        if new:
            buf = _thin(pd.concat([buf, *new] if buf is not None else new, ignore_index=True).drop_duplicates([*keys, "ident", "value"]), keys, size)
        if buf is not None and len(buf):
            for i in range(0, len(buf), 50_000):
                yield buf.iloc[i : i + 50_000]

    return rows.mapInPandas(run, rows.schema)


def _levels(buf: pd.DataFrame, part: pd.DataFrame, keys: list[str]) -> np.ndarray:
    known = buf.drop_duplicates(keys)[[*keys, "level"]]
    return part[keys].merge(known, on=keys, how="left")["level"].fillna(0).to_numpy().astype(np.int64)


def merged_sample(parts: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``keys..., ident, value, u, n_taken``: exactly ``size`` records per group, or all if there are fewer.

    Rates are equalised at the highest level of the group's buffers, then thinned further by
    the merged counts per level (at most 60 a group), so that the last step, which ranks a
    group's records in one task, sees a few times ``size`` records of each group.  The buffers' records
    are written once, since both the counts and the last step read them.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    named = parts.select(*[F.struct(F.col(f"`{c}`").alias("v")).alias(n) for c, n in zip(keys, k)], "ident", "value", "u", "level")
    depth = F.lit(_BITS) - F.length(F.bin("u"))
    once = named.groupBy(*k, "ident").agg(F.min("value").alias("value"), F.min("u").alias("u"), F.max("level").alias("level")).withColumn("depth", depth)
    once = materialise(once, "buffers")
    # records at or below the group's highest level are complete in every buffer
    hist = once.groupBy(*k, "depth").agg(F.count(F.lit(1)).alias("n"), F.max("level").alias("level"))
    deepest = W.partitionBy(*k).orderBy(F.desc("depth"))
    at_least = F.sum("n").over(deepest)
    level = F.max("level").over(W.partitionBy(*k))
    cuts = hist.select(*k, "depth", at_least.alias("have"), level.alias("base"))
    cut = cuts.groupBy(*k).agg(F.greatest(F.max("base"), F.coalesce(F.max(F.when(F.col("have") >= size, F.col("depth"))), F.lit(0))).alias("cut"))
    thinned = once.join(cut, k).where("depth >= cut")
    w = W.partitionBy(*k)
    ranked = thinned.withColumn("_r", F.row_number().over(w.orderBy("u", "ident"))).where(F.col("_r") <= size)
    return ranked.select(*[F.col(f"{n}.v").alias(c) for c, n in zip(keys, k)], "ident", "value", "u", F.count(F.lit(1)).over(w).alias("n_taken"))


def fixed_sample(df: DataFrame, keys: list[str], ident: str, value: str, size: int, seed: int = 0) -> DataFrame:
    """A uniform sample of ``size`` values per group; each distinct ``ident`` is one record.

    Null keys are a group of their own; rows with a null identifier or value are left out;
    a group with fewer records gives all of them; an empty table gives an empty one.  Equal
    values are separate records.  The result depends on the records and ``seed`` only.
    """
    return merged_sample(partial_samples(df, keys, ident, value, size, seed), keys, size)


def sample_of_samples(parts: DataFrame, keys: list[str], identity: list[str], n: str, samples: str, size: int, seed: int = 0) -> DataFrame:
    """A uniform sample of records out of parts that hold a uniform sample each.

    ``identity`` names a part (parts that come twice count once), ``n`` how many records it has,
    ``samples`` its array of sampled values.  The values get the least of ``n`` uniform numbers, as
    if all had been seen; a truncated part is known only up to its largest.  Rates are equalised at
    the least such bound of the group, and the ``size`` least numbers are the sample.  The bounding
    part alone fills the sample when ``size`` is at most the parts' own size; beyond it a group can
    come out smaller, never biased: the parts hold too few records then.  Returns ``keys..., value, u, n_taken, n_records``.

    Parts with a null or non-positive ``n`` or without samples hold no records.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    part = [f"_p{i}" for i in range(len(identity))]
    sizes = F.col(n).cast("long").alias("_n")
    once = parts.where(F.col(n) > 0).where(F.size(samples) > 0).select(*[F.struct(F.col(f"`{c}`").alias("v")).alias(x) for c, x in zip([*keys, *identity], [*k, *part])], sizes, F.col(samples).alias("_v")).dropDuplicates([*part, "_n"])
    values = once.select(*k, *part, "_n", F.size("_v").alias("_s"), F.posexplode(F.col("_v").cast("array<long>")).alias("_i", "value")).withColumn("_h", _hash(*[F.col(f"{x}.v") for x in part], F.col("_i"), seed=seed))
    # in the order of a hash, the j-th of n uniform numbers follows the one before it by an exponential spacing
    within = W.partitionBy(*part, "_n")
    rank = F.row_number().over(within.orderBy("_h")) - 1
    e = -F.log((F.conv(F.substring("_h", 16, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52))
    gaps = values.withColumn("_j", rank).withColumn("_g", e / (F.col("_n") - F.col("_j")))
    drawn = gaps.withColumn("u", -F.expm1(-F.sum("_g").over(within.orderBy("_j").rowsBetween(W.unboundedPreceding, 0))))
    drawn = materialise(drawn.select(*k, "_j", "_n", "_s", "value", "u"), "drawn")
    # a truncated part is known up to its largest number
    limit = drawn.groupBy(*k).agg(F.sum(F.when(F.col("_j") == 0, F.col("_n"))).alias("n_records"), F.min(F.when((F.col("_j") == F.col("_s") - 1) & (F.col("_s") < F.col("_n")), F.col("u"))).alias("_lim"))
    rows = drawn.join(limit.withColumn("_lim", F.coalesce("_lim", F.lit(1.0))), k).select(*k, "n_records", "_lim", "value", "u").where("u <= _lim")
    depth = F.floor(-F.log2(F.greatest(F.col("u"), F.lit(1e-300)))).cast("int")
    rows = rows.withColumn("depth", depth)
    hist = rows.groupBy(*k, "depth").agg(F.count(F.lit(1)).alias("n"))
    have = F.sum("n").over(W.partitionBy(*k).orderBy(F.desc("depth")))
    cut = hist.select(*k, "depth", have.alias("have")).groupBy(*k).agg(F.coalesce(F.max(F.when(F.col("have") >= size, F.col("depth"))), F.lit(0)).alias("cut"))
    w = W.partitionBy(*k)
    ranked = rows.join(cut, k).where("depth >= cut").withColumn("_r", F.row_number().over(w.orderBy("u", "value"))).where(F.col("_r") <= size)
    return ranked.select(*[F.col(f"{x}.v").alias(c) for c, x in zip(keys, k)], "value", "u", F.count(F.lit(1)).over(w).alias("n_taken"), "n_records")
