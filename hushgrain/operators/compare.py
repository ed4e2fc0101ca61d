"""Comparison of two samples, and evaluation against known truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hushgrain import constants as C
from hushgrain.functions.tails import chi2_tail


def metric_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """``metric, value_a, value_b, delta`` (b - a); a metric that one side lacks has nulls."""
    j = a.select("metric", F.col("value").alias("value_a")).join(b.select("metric", F.col("value").alias("value_b")), "metric", "full")
    return j.withColumn("delta", F.col("value_b") - F.col("value_a"))


def chi2(totals: DataFrame, side: str, a: str, b: str) -> DataFrame:
    """Per category (also those that no read has): fractions, Yates-corrected chi-squared, p and Bonferroni-adjusted p.

    ``totals`` has ``side, category, n_reads``.  Counts are the whole part of total times fraction, as
    sums of rounded products are.  A table with an empty row or column has no test; no rows if a side is empty.
    """
    spark = totals.sparkSession
    every = spark.createDataFrame([(c,) for c in (*C.CATEGORY_ORDER, *C.DROPPED)], "category string")
    t = totals.groupBy("category").agg(*[F.coalesce(F.sum(F.when(F.col(side) == s, F.col("n_reads"))), F.lit(0)).alias(f"n_{x}") for x, s in (("a", a), ("b", b))])
    whole = t.agg(F.sum("n_a").alias("total_a"), F.sum("n_b").alias("total_b")).where("total_a > 0 AND total_b > 0")  # one row
    j = F.broadcast(every).join(t, "category", "left").join(F.broadcast(whole))
    for x in "ab":
        j = j.withColumn(f"frac_{x}", F.coalesce(F.col(f"n_{x}"), F.lit(0)) / F.col(f"total_{x}"))
        j = j.withColumn(f"o_{x}", (F.col(f"total_{x}") * F.col(f"frac_{x}")).cast("long")).withColumn(f"r_{x}", (F.col(f"total_{x}") - F.col(f"total_{x}") * F.col(f"frac_{x}")).cast("long"))
    oa, ra, ob, rb = (F.col(c).cast("double") for c in ("o_a", "r_a", "o_b", "r_b"))
    n = oa + ra + ob + rb
    stat = F.lit(0.0)
    for o, row, col in ((oa, oa + ra, oa + ob), (ra, oa + ra, ra + rb), (ob, ob + rb, oa + ob), (rb, ob + rb, ra + rb)):
        e = F.try_divide(row * col, n)
        d = F.abs(o - e)
        stat = stat + F.try_divide((d - F.least(F.lit(0.5), d)) * (d - F.least(F.lit(0.5), d)), e)
    j = j.withColumn("chi2", stat).withColumn("p_value", chi2_tail("chi2"))
    tests = F.count("p_value").over(W.partitionBy())  # 19 rows
    return j.withColumn("p_adjusted", F.least(F.col("p_value") * tests, F.lit(1.0))).withColumn("delta", F.col("frac_b") - F.col("frac_a")).select("category", "frac_a", "frac_b", "delta", "chi2", "p_value", "p_adjusted")


# --- evaluation ---


def confusion_matrix(cells: DataFrame, truth: DataFrame) -> DataFrame:
    """``true_category`` by assigned category: counts as rounded products of fraction and reads, over the category's barcodes."""
    j = cells.join(truth.select("cell_barcode", F.lower("true_category").alias("true_category")).distinct(), "cell_barcode")
    return j.groupBy("true_category").agg(*[F.sum(F.bround(F.coalesce(F.col(f"read_frac_{c}"), F.lit(0.0)) * F.col("n_reads"), 0).cast("long")).alias(c) for c in C.CATEGORY_ORDER])


def category_accuracy(matrix: DataFrame) -> DataFrame:
    """Diagonal over row sum; a true category that is no column has 0."""
    total = sum((F.col(c) for c in C.CATEGORY_ORDER), F.lit(0))
    right = F.lit(0)
    for c in C.CATEGORY_ORDER:
        right = F.when(F.col("true_category") == c, F.col(c)).otherwise(right)
    return matrix.select("true_category", total.alias("total_reads"), right.cast("long").alias("correct_reads")).withColumn("accuracy", F.try_divide("correct_reads", "total_reads"))


def dose_response(cells: DataFrame, truth: DataFrame) -> DataFrame:
    """Reported against true noise per cell; ``truth`` has ``cell_barcode, true_noise``."""
    t = truth.groupBy("cell_barcode").agg(F.first("true_noise").alias("true_noise_frac"))
    return cells.join(t, "cell_barcode").select("cell_barcode", "n_reads", "true_noise_frac", F.col("noise_read_frac").alias("reported_noise_frac"), (F.col("noise_read_frac") - F.col("true_noise_frac")).alias("delta_vs_true")).orderBy("true_noise_frac", "cell_barcode")


def flag_accuracy(flags: DataFrame, truth: DataFrame) -> DataFrame:
    """Observed over expected flags per cell; ``truth`` has one row per read: ``cell_barcode, flag`` (``n_tso`` or ``n_polya``)."""
    want = truth.groupBy("cell_barcode", "flag").agg(F.count(F.lit(1)).alias("expected_count"))
    tso = F.col("flag") == "n_tso"
    j = flags.join(want, "cell_barcode")
    return j.select("cell_barcode", "flag", "expected_count", F.when(tso, F.col("n_tso")).otherwise(F.col("n_polya")).alias("observed_count"), F.when(tso, F.col("n_polya")).otherwise(F.col("n_tso")).alias("other_flag_count")).withColumn("accuracy", F.try_divide("observed_count", "expected_count"))
