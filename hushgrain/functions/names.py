"""Canonical spellings of barcodes, molecular identifiers and contigs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def barcode(c: Column) -> Column:
    """Upper case without a trailing ``-1``; null and empty are both ``''``."""
    return F.coalesce(F.regexp_replace(F.upper(c), "-1$", ""), F.lit(""))


def umi(c: Column) -> Column:
    """Upper case; null where there is none."""
    return F.when(c != "", F.upper(c))


# Fixed value: the contigs by whose names a style is told.
PRIMARY = frozenset([*map(str, range(1, 23)), "X", "Y", "MT"])


def style(contigs) -> str:
    """``ucsc`` or ``ensembl`` by the majority of the main contigs, ``unknown`` for a tie or none."""
    ucsc = sum(c.startswith("chr") and (c[3:] in PRIMARY or c == "chrM") for c in contigs)
    other = sum(c in PRIMARY for c in contigs)
    return "ucsc" if ucsc > other else "ensembl" if other > ucsc else "unknown"


def contig_names(contigs: DataFrame) -> DataFrame:
    """``(name_key, canonical)``: each contig's names in either style, in upper case.

    One row per distinct name; rows of ``contigs`` with a null name are left out.
    """
    both = contigs.select(F.explode(F.array("contig", "ensembl_name")).alias("name"), F.col("contig").alias("canonical"))
    return both.where("name IS NOT NULL AND canonical IS NOT NULL").groupBy(F.upper("name").alias("name_key")).agg(F.min("canonical").alias("canonical"))


def with_contig(df: DataFrame, contigs: DataFrame, column: str = "contig", into: str = "contig_key") -> DataFrame:
    """Add the canonical name; null where the name is null or not in ``contigs``."""
    from hushgrain.storage import lookup_join

    keyed = df.withColumn("name_key", F.upper(F.col(column)))
    names = contig_names(contigs).withColumnRenamed("canonical", into)
    return lookup_join(keyed, names, ["name_key"], "left").drop("name_key")
