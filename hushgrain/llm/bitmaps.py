"""Distinct counts by fixed bitmaps (linear counting).

Every identifier sets one bit of a bitmap of ``m`` bits; bitmaps of parts merge by bitwise
union; with ``V`` of ``m`` bits empty the count is ``-m ln(V / m)``.  A bitmap is kept as its
non-zero 64-bit words, one row per group and word, so merging is ``bit_or`` with map-side
combine, small groups stay small, and a hot group is spread over tasks by word.

Positions are the leading bits of one hash, so a bitmap folds into a smaller one of the same
identifiers (:func:`fold`): results of any sizes merge, at the smallest of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Log2 of the largest bitmap; bit numbers are taken from 64 bits of hash.
MAX_LOG_BITS = 48
MIN_LOG_BITS = 10


def std_error(n: float, m: int) -> float:
    """Relative standard error of linear counting at ``n`` identifiers in ``m`` bits."""
    if n <= 0:
        return 0.0
    t = n / m
    return math.sqrt(m * (math.exp(t) - t - 1)) / n if t < 700 else math.inf


def deviation(n: Column, bits: int) -> Column:
    """Standard error of an estimate of ``n`` identifiers in ``2**bits`` bits, in identifiers."""
    m = float(2**bits)
    return F.sqrt(F.greatest(F.lit(m) * (F.expm1(n / m) - n / m), F.lit(0.0)))


def log_bits(n: int, error: float) -> int:
    """Log2 of the smallest bitmap that counts up to ``n`` identifiers within ``error`` (standard error, relative).

    ``n`` is an upper bound, such as the number of rows.  Raises where even ``2**MAX_LOG_BITS`` bits (for some 10**15 identifiers) are too few.
    """
    if not 0 < error < 1:
        raise ValueError("error must be between 0 and 1")
    for b in range(MIN_LOG_BITS, MAX_LOG_BITS + 1):
        if n <= 8 * 2**b and std_error(n, 2**b) <= error:
            return b
    raise ValueError(f"{n} identifiers at error {error} need more than 2**{MAX_LOG_BITS} bits")


def position(ident: Column, bits: int) -> Column:
    """Bit number of an identifier: the leading bits of its MD5, the same in every engine.  Null for null."""
    h = F.md5(F.encode(ident, "UTF-8"))
    high, low = (F.conv(F.substring(h, i, 8), 16, 10).cast("long") for i in (1, 9))
    if bits <= 32:
        return F.shiftrightunsigned(high, 32 - bits)
    return F.shiftleft(high, bits - 32).bitwiseOR(F.shiftrightunsigned(low, 64 - bits))


def bitmaps(df: DataFrame, keys: list[str], ident: str, bits: int) -> DataFrame:
    """``keys..., word, mask``: the non-zero words of each group's bitmap.  Null identifiers set no bit."""
    at = position(F.col(ident), bits)
    rows = df.where(F.col(ident).isNotNull()).select(*keys, at.alias("_at"))
    rows = rows.select(*keys, F.shiftright("_at", 6).alias("word"), F.expr("shiftleft(1L, cast(_at % 64 as int))").alias("mask"))
    return rows.groupBy(*keys, "word").agg(F.bit_or("mask").alias("mask"))


def merge(maps: DataFrame, keys: list[str]) -> DataFrame:
    """Union of bitmaps of the same size onto fewer keys (or of several tables, put together by ``unionByName``)."""
    return maps.groupBy(*keys, "word").agg(F.bit_or("mask").alias("mask"))


def fold(maps: DataFrame, keys: list[str], bits: int, to: int) -> DataFrame:
    """The bitmaps that the same identifiers set in ``2**to`` bits, out of those in ``2**bits``."""
    if to > bits:
        raise ValueError("a bitmap can't be unfolded")
    if to == bits:
        return maps
    rows = maps.select(*keys, "word", "mask")
    if bits - to >= 6:  # a word is within one bit
        at = F.shiftright("word", bits - to - 6)
        rows = rows.withColumn("_at", at).select(*keys, F.shiftright("_at", 6).alias("word"), F.expr("shiftleft(1L, cast(_at % 64 as int))").alias("mask"))
    else:
        for _ in range(bits - to):  # neighbouring bits become one, then the word half of one
            m = F.col("mask").bitwiseOR(F.shiftrightunsigned("mask", 1)).bitwiseAND(F.lit(0x5555555555555555))
            rows = rows.withColumn("mask", m)
            for shift, keep in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
                rows = rows.withColumn("mask", F.col("mask").bitwiseOR(F.shiftrightunsigned("mask", shift)).bitwiseAND(F.lit(keep)))
            rows = rows.withColumn("mask", F.expr("shiftleft(mask, cast(32 * (word % 2) as int))")).withColumn("word", F.shiftright("word", 1))
    return rows.groupBy(*keys, "word").agg(F.bit_or("mask").alias("mask"))


def merge_sizes(maps: list[tuple[DataFrame, int]], keys: list[str]) -> tuple[DataFrame, int]:
    """Union of bitmaps of several sizes, given with the log2 of their bits, at the smallest of these."""
    to = min(bits for _, bits in maps)
    cols = [*keys, "word", "mask"]
    rows = None
    for df, bits in maps:
        part = fold(df, keys, bits, to).select(*cols)
        rows = part if rows is None else rows.unionByName(part)
    return merge(rows, keys), to


def merge_combinations(maps: DataFrame, keys: list[str]) -> DataFrame:
    """Unions for every combination of keys, with ``level``: bit *i* from the left is 1 where key *i* is merged away.

    Rows are spread by word once; a word of any combination is then within one task, so that one
    shuffle of the bitmaps serves all combinations.
    """
    spread = maps.repartition("word")
    kinds = {f.name: f.dataType for f in maps.schema}
    sets = []
    for level in range(2 ** len(keys)):
        away = [level >> (len(keys) - 1 - i) & 1 for i in range(len(keys))]
        sets.append(F.struct(*[(F.lit(None).cast(kinds[k]) if gone else F.col(f"`{k}`")).alias(k) for k, gone in zip(keys, away)], F.lit(level).alias("level")))
    rows = spread.select("word", "mask", F.explode(F.array(*sets)).alias("_s")).select(*[F.col(f"_s.`{k}`").alias(k) for k in keys], F.col("_s.level").alias("level"), "word", "mask")
    return rows.groupBy(*keys, "level", "word").agg(F.bit_or("mask").alias("mask"))


def estimate(maps: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """``keys..., n_bits_set, n_distinct``.  A full bitmap, which a sized one never is, gives null."""
    m = 2**bits
    used = maps.groupBy(*keys).agg(F.sum(F.bit_count("mask")).cast("long").alias("n_bits_set"))
    empty = F.lit(m) - F.col("n_bits_set")
    return used.withColumn("n_distinct", F.when(empty > 0, -F.lit(float(m)) * F.log(empty / F.lit(float(m)))))
