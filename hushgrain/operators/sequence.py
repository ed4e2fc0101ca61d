"""The reference sequence as chunks, splice sites, and contigs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hushgrain import constants as C
from hushgrain.functions import reads as R
from hushgrain.storage import lookup_join


def fetch(df: DataFrame, chunks: DataFrame, contig: str, pos: str, width: int, chunk: int) -> DataFrame:
    """Add ``bases``: ``width`` bases (at most a chunk) from ``pos`` on, upper case, fewer at the end, ``''`` where unknown.

    ``chunks`` is ``contig, chunk_id, seq`` of ``chunk`` bases each.  Every chunk is given the
    head of its successor first, so one equi-join finds a window that crosses a boundary.  The
    lookup is broadcast or salted, since the reads of a gene gather at one chunk.
    """
    if width > chunk:
        raise ValueError("a window must not exceed a chunk")
    own = chunks.select(F.col("contig").alias("_c"), F.col("chunk_id").cast("long").alias("_i"), F.upper("seq").alias("_s"))
    following = own.select("_c", (F.col("_i") - 1).alias("_i"), F.substring("_s", 1, width).alias("_n"))
    wide = own.join(following, ["_c", "_i"], "left").select("_c", "_i", F.concat("_s", F.coalesce("_n", F.lit(""))).alias("_w"))
    found = lookup_join(df.withColumns({"_c": F.col(contig), "_i": F.expr(f"`{pos}` div {chunk}")}), wide, ["_c", "_i"], "left", salts=4)  # wide rows, so few copies; beyond them adaptive execution splits a hot chunk
    bases = F.coalesce(F.substring(F.col("_w"), (F.col(pos) % chunk + 1).cast("int"), F.lit(width)), F.lit(""))
    return found.withColumn("bases", bases).drop("_c", "_i", "_w")


def with_donor(junctions: DataFrame, chunks: DataFrame, chunk: int) -> DataFrame:
    """Add ``is_canonical``: the junction's first two bases, read on its strand, are a known donor, or unknown."""
    f = fetch(junctions, chunks, "contig", "junction", 2, chunk)
    donor = F.when(F.col("strand") == "-", R.reverse_complement("bases")).otherwise(F.col("bases"))
    return f.withColumn("is_canonical", (F.length("bases") < 2) | donor.isin(*C.CANONICAL_DONORS)).drop("bases")


def splice_sites(exons: DataFrame) -> DataFrame:
    """``contig, strand, junction``: both ends of every exon, each once."""
    return exons.select("contig", "strand", F.explode(F.array("s", "e")).alias("junction")).distinct()


def with_known(junctions: DataFrame, sites: DataFrame) -> DataFrame:
    """Add ``is_known``: the junction starts at a splice site of its contig and strand."""
    return lookup_join(junctions, sites.withColumn("_k", F.lit(True)), ["contig", "strand", "junction"], "left").withColumn("is_known", F.col("_k").isNotNull()).drop("_k")


def select_contigs(contigs: DataFrame, least: int = C.MIN_CONTIG_LENGTH) -> DataFrame:
    """``contig, contig_length, read_order``: contigs of at least ``least`` bases (all, if none is), longest first, then the mitochondrial ones.

    The list comes from a file's header, so one task may order it.
    """
    mito = R.is_mito()
    any_long = F.max(F.coalesce(~mito & (F.col("contig_length") >= least), F.lit(False))).over(W.partitionBy())
    kept = contigs.withColumn("_long", any_long).where(mito | ~F.col("_long") | (F.col("contig_length") >= least))
    return kept.select("contig", "contig_length", F.rank().over(W.orderBy(mito, F.desc("contig_length"), "contig")).cast("long").alias("read_order"))


def style_vote(contig: str) -> Column:
    """Aggregate: ``ucsc``, ``ensembl``, or ``unknown`` for a tie or none."""
    u = F.count_if(F.startswith(F.col(contig), F.lit("chr")))
    e = F.count_if(F.col(contig).rlike("^([0-9]+|X|Y|MT)$"))
    return F.when(u > e, "ucsc").when(e > u, "ensembl").otherwise("unknown")


def strip_chr(contig: str) -> Column:
    return F.regexp_replace(contig, "^chr", "")


def length_differences(df: DataFrame, a: str, b: str, most: int = 1_000_000, first: int = 3) -> DataFrame:
    """The first contigs, by name, whose two lengths differ by more than ``most``."""
    diff = F.abs(F.col(a) - F.col(b))
    return df.withColumn("difference", diff).where(diff > most).orderBy("contig").limit(first).select("contig", a, b, "difference")


def first_reads(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark keeps ``n`` a group per task before the shuffle."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
