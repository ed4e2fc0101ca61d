"""The data behind the report's figures: small queries over the metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hushgrain import constants as C

SIGNAL = ("exonic_sense",)


def category_rank(column: str = "category"):
    return F.array_position(F.array(*[F.lit(c) for c in C.CATEGORY_ORDER]), F.col(column))


def noise_overview(totals: DataFrame, keys: list[str], least: float = 0.0005) -> DataFrame:
    """Categories but sense and unassigned with a share above ``least``, with their rank in the order of categories."""
    return totals.where(~F.col("category").isin("exonic_sense", "unassigned") & (F.col("read_frac") > least)).select(*keys, "category", "read_frac", category_rank().alias("rank"))


def fraction_bar(totals: DataFrame, keys: list[str], column: str, least: float = 0.0001) -> DataFrame:
    return totals.where(F.col(column) > least).select(*keys, "category", F.col(column).alias("fraction"), category_rank().alias("rank"))


def stratified_shares(strata: DataFrame, keys: list[str]) -> DataFrame:
    """Shares within a bin, and the bin's reads."""
    return strata.withColumn("bin_total", F.sum("count").over(W.partitionBy(*keys, "length_bin"))).select(*keys, "length_bin", "category", "fraction_of_bin", "bin_total")


def violin(cells: DataFrame, keys: list[str], most_points: int = 5000) -> DataFrame:
    """Per-cell noise, and whether single points are drawn."""
    return cells.where("noise_read_frac IS NOT NULL").select(*keys, "cell_barcode", "noise_read_frac", (F.count(F.lit(1)).over(W.partitionBy(*keys)) <= most_points).alias("points"))


def histogram(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """Per cent of rows in up to ``bins`` equal bins between the keys' least and largest value.

    The bounds come from an aggregation, not a window over the values, so hot keys stay spread.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    ends = rows.groupBy(*keys).agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.count(F.lit(1)).alias("n"))
    j = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("c")).join(ends, keys)
    at = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("low")) * bins / (F.col("high") - F.col("low"))).cast("int"))).otherwise(0)
    return j.groupBy(*keys, at.alias("bin")).agg(F.sum("c").alias("count"), (F.sum("c") * 100.0 / F.max("n")).alias("percent"))


def artifact_rates(flags: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Flags over classified reads."""
    n = totals.groupBy(*keys).agg(F.greatest(F.sum("n_reads"), F.lit(1)).alias("n"))
    f = flags.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n_tso", "n_polya", "n_noncanon")])
    return f.join(n, keys).select(*keys, *[(F.col(c) / F.col("n")).alias(f"{c[2:]}_rate") for c in ("n_tso", "n_polya", "n_noncanon")])


def legend(spark) -> DataFrame:
    """Every category with its rank and whether it is noise."""
    rows = [(c, i + 1, c in C.NOISE, c in C.NOISE_STRICT, c in C.AMBIGUOUS_SET) for i, c in enumerate(C.CATEGORY_ORDER)]
    return spark.createDataFrame(rows, "category string, rank int, is_noise boolean, is_strict boolean, is_ambiguous boolean")


def top_loci(loci: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """The ``n`` loci with most reads (a top-k report), with plot coordinates."""
    order = [F.desc("n_reads"), *keys, "contig", "start_pos", "strand"]
    return loci.orderBy(*order).limit(n).withColumn("p_shown", F.greatest("poisson_pvalue", F.lit(1e-300))).withColumn("size", F.least(F.greatest(2 * F.col("n_barcodes") + 4, F.lit(6)), F.lit(24)))


def cluster_bars(clusters: DataFrame) -> DataFrame:
    """Clusters by median noise, highest first, with four components."""
    cols = ["median_noise_read_frac", "median_exonic_antisense_frac", "median_intronic_pure_frac", "median_chimeric_frac"]
    return clusters.select("cluster", *cols).orderBy(F.desc("median_noise_read_frac"), "cluster")


def cluster_heatmap(clusters: DataFrame) -> DataFrame:
    """All medians, one row per cluster and metric."""
    cols = [c for c in clusters.columns if c.startswith("median_")]
    return clusters.unpivot("cluster", cols, "metric", "value")


def compare_bars(stats: DataFrame, least: float = 0.0005) -> DataFrame:
    """Categories with a share above ``least`` on either side."""
    return stats.where((F.col("frac_a") > least) | (F.col("frac_b") > least)).select("category", "frac_a", "frac_b")


def delta_plot(stats: DataFrame) -> DataFrame:
    """Differences with stars for significance."""
    p = F.col("p_adjusted")
    return stats.select("category", "delta", F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("").alias("stars"))
