"""Counts per cell and category over a stream of classified reads.

Beyond the batch engine: counts are sums, so they need no watermark to be right; with one,
state of identifiers that can no longer come again is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_reads(stream: DataFrame, ident: str, event_time: str, delay: str = "7 days") -> DataFrame:
    """Each read once, as long as its repetitions arrive within ``delay``."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([ident])


def running_counts(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Reads and bases per key; write in ``update`` or ``complete`` mode."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_reads"), F.sum(F.greatest(F.coalesce("read_length", F.lit(0)), F.lit(0)).cast("long")).alias("n_bases"))


def windowed_counts(stream: DataFrame, event_time: str, keys: list[str], width: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Reads per window of event time; in ``append`` mode a window comes out once late reads can no longer change it."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width), *keys).agg(F.count(F.lit(1)).alias("n_reads"))
