"""The rule cascade: what can be decided of a read without the annotation.

The first rule that matches wins: secondary, unmapped, supplementary (all dropped), barcode,
multimapper, mitochondrial, chimeric.  The rest is ``undecided`` and goes on to the
interval classification, so the wide join sees only those rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushgrain import constants as C
from hushgrain.functions import reads as R
from hushgrain.storage import lookup_join

UNDECIDED = "undecided"


def with_barcode(df: DataFrame, whitelist: DataFrame | None = None, cb: str = "cb") -> DataFrame:
    """Add ``cell_barcode`` and ``is_unassigned``.

    Without a whitelist a missing barcode is ``NO_BARCODE`` and goes on; with one, a missing
    barcode (then ``''``) or one that is not listed, compared as it stands, is unassigned.
    ``whitelist`` has a column ``barcode``; repeated and null entries do no harm.
    """
    given = F.coalesce(F.col(cb), F.lit(""))
    if whitelist is None:
        return df.withColumn("cell_barcode", F.when(given == "", C.NO_BARCODE).otherwise(given)).withColumn("is_unassigned", F.lit(False))
    listed = whitelist.where("barcode IS NOT NULL").select(F.col("barcode").alias("cell_barcode"), F.lit(True).alias("_listed")).distinct()
    joined = lookup_join(df.withColumn("cell_barcode", given), listed, ["cell_barcode"], "left")
    return joined.withColumn("is_unassigned", (F.col("cell_barcode") == "") | F.col("_listed").isNull()).drop("_listed")


def decide(df: DataFrame, whitelist: DataFrame | None = None, paired: bool = False, distance: int = C.CHIMERIC_DISTANCE) -> DataFrame:
    """Primary reads with ``cell_barcode`` and ``decided``: a category or ``undecided``."""
    rows = with_barcode(df.where(R.is_primary()), whitelist)
    chimeric = R.is_chimeric_sa(distance=distance)
    if paired:
        chimeric = chimeric | R.is_chimeric_pair()
    decided = F.when(F.col("is_unassigned"), "unassigned").when(R.is_multimapper(), "multimapper").when(R.is_mito(), "mitochondrial").when(chimeric, "chimeric").otherwise(UNDECIDED)
    return rows.withColumn("decided", decided)


def counters(df: DataFrame, called: DataFrame | None = None) -> DataFrame:
    """One row: reads processed, skipped as not primary, skipped as not of a called cell."""
    primary = R.is_primary()
    off = F.lit(False)
    if called is not None:
        keys = called.where("barcode IS NOT NULL").select(F.col("barcode").alias("_key"), F.lit(True).alias("_called")).distinct()
        df = lookup_join(df.withColumn("_key", R.strip_suffix(F.coalesce("cb", F.lit("")))), keys, ["_key"], "left")
        off = F.col("_called").isNull()
    return df.agg(F.count(F.lit(1)).alias("n_processed"), F.count_if(~primary).alias("n_skipped"), F.count_if(primary & off).alias("n_skipped_not_called"))


def called_cells(df: DataFrame, called: DataFrame, cb: str = "cb") -> DataFrame:
    """Reads of called cells; one trailing ``-1`` of the read's barcode is ignored, and the output keeps it."""
    keys = called.where("barcode != ''").select(F.col("barcode").alias("_key")).distinct()
    return lookup_join(df.withColumn("_key", R.strip_suffix(F.coalesce(cb, F.lit("")))), keys, ["_key"], "left_semi").drop("_key")
