"""Intergenic reads: clustering into loci, the Poisson test, and what becomes of their counts.

Records have ``contig, start_pos, end_pos, strand, cell_barcode, has_junction, three_prime``, a
unique ``qname`` and the ``keys`` of a sample.  Records with a null place are left out; a null
junction flag is false; a null barcode is ``''`` and counts as a barcode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hushgrain import constants as C
from hushgrain.functions.tails import poisson_tail
from hushgrain.operators import intervals as I


def records(classified: DataFrame) -> DataFrame:
    """Typed, well-formed records."""
    typed = classified.withColumns({"start_pos": F.col("start_pos").try_cast("long"), "end_pos": F.col("end_pos").try_cast("long"), "three_prime": F.col("three_prime").try_cast("long"), "has_junction": F.coalesce(F.col("has_junction").try_cast("boolean"), F.lit(False)), "cell_barcode": F.coalesce("cell_barcode", F.lit(""))})
    return typed.where("contig IS NOT NULL AND start_pos IS NOT NULL AND end_pos IS NOT NULL")


def cluster(recs: DataFrame, keys: list[str], gap: int = C.LOCUS_GAP) -> DataFrame:
    """Records with ``locus_id``: on one contig and strand, within ``gap`` of the locus so far.  A locus number is unique within sample, contig and strand."""
    as_iv = recs.withColumn("s", F.col("start_pos")).withColumn("e", F.greatest(F.col("end_pos"), F.col("start_pos") + 1))
    return I.label_islands(as_iv, [*keys, "contig", "strand"], gap).drop("s", "e")


def loci(clustered: DataFrame, keys: list[str]) -> DataFrame:
    """One row per locus: place, reads, barcodes, junction evidence and the most frequent 3' end (the first seen among equals)."""
    k = [*keys, "contig", "strand", "locus_id"]
    base = clustered.groupBy(*k).agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count(F.lit(1)).alias("n_reads"), F.bool_or("has_junction").alias("has_splice_evidence"))
    barcodes = clustered.select(*k, "cell_barcode").distinct().groupBy(*k).agg(F.count(F.lit(1)).alias("n_barcodes"))
    ends = clustered.groupBy(*k, "three_prime").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("start_pos", "qname")).alias("first"))
    modal = ends.groupBy(*k).agg(F.min_by("three_prime", F.struct(-F.col("n"), F.col("first"))).alias("modal_three_prime"))
    # a row a locus each, up to one a read, so neither goes through the driver
    return base.join(barcodes.hint("merge"), k).join(modal.hint("merge"), k).withColumn("is_monoexonic", ~F.col("has_splice_evidence"))


def is_hotspot(monoexonic: Column, polya_run: Column) -> Column:
    """Internal priming: no splice and a run of A downstream; known sites play no part."""
    return monoexonic & polya_run


def is_novel(strand_consistent: Column, n_barcodes: Column, least: Column, splice: Column, near_site: Column) -> Column:
    return strand_consistent & (n_barcodes >= least) & (splice | near_site)


def score(found: DataFrame, recs: DataFrame, keys: list[str], intergenic_bases: int, repeats: DataFrame | None = None, sites: DataFrame | None = None, polya_run: Column | None = None, alpha: float = C.LOCUS_ALPHA, barcodes: DataFrame | None = None) -> DataFrame:
    """Loci with p-values and category.

    A repeat decides whatever the significance; then insignificant loci are sparse; then hotspot, novel,
    and hotspot for the rest.  ``polya_run`` tells of a run of A downstream (none without a reference).
    ``barcodes`` has ``keys`` and ``cell_barcode`` of all the sample's reads, by which the least number of
    barcodes goes; a sample that it lacks goes by its records.
    """
    per = recs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_records"))
    bars = recs.select(*keys, "cell_barcode").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_barcodes"))
    tests = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_tests"))
    sample = per.join(bars, keys).join(tests, keys) if keys else per.join(F.broadcast(bars)).join(F.broadcast(tests))
    if barcodes is not None:
        every = barcodes.select(*keys, F.coalesce("cell_barcode", F.lit("")).alias("_b")).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_every"))
        sample = sample.join(every, keys, "left") if keys else sample.join(F.broadcast(every))
        sample = sample.withColumn("_barcodes", F.greatest("_barcodes", "_every")).drop("_every")
    df = found.join(sample, keys) if keys else found.join(F.broadcast(sample))
    lam = F.col("_records") / F.lit(float(intergenic_bases)) * F.greatest(F.col("end_pos") - F.col("start_pos"), F.lit(1)) if intergenic_bases > 0 else F.lit(0.0)
    df = df.withColumn("expected", lam).withColumn("poisson_pvalue", F.when(F.col("expected") > 0, poisson_tail("n_reads", "expected")).otherwise(1.0))
    df = df.withColumn("poisson_pvalue_adj", F.least(F.col("poisson_pvalue") * F.col("_tests"), F.lit(1.0)))
    df = df.withColumn("min_barcodes", F.greatest(F.lit(C.LOCUS_MIN_BARCODES), F.floor(F.col("_barcodes") * C.LOCUS_BARCODE_FRACTION).cast("int")))
    df = df.withColumn("significant", (F.col("poisson_pvalue_adj") < alpha) & (F.col("n_reads") >= C.LOCUS_MIN_READS) & (F.col("n_barcodes") >= F.col("min_barcodes")))
    df = df.withColumn("polya_run_downstream", polya_run if polya_run is not None else F.lit(False))
    df = I.near(df, sites, ["contig"], "modal_three_prime", C.POLYA_SITE_DISTANCE, "near_polya_site") if sites is not None else df.withColumn("near_polya_site", F.lit(False))
    if repeats is not None:
        k = [*keys, "contig", "strand", "locus_id"]
        hit = I.overlapping(df.select(*k, F.col("start_pos").alias("s"), F.col("end_pos").alias("e")), repeats.select("contig", "s", "e"), ["contig"]).select(*k, F.lit(True).alias("_rep"))
        df = df.join(hit, k, "left").withColumn("overlaps_repeat", F.col("_rep").isNotNull()).drop("_rep")
    else:
        df = df.withColumn("overlaps_repeat", F.lit(False))
    hot = is_hotspot(F.col("is_monoexonic"), F.col("polya_run_downstream"))
    new = is_novel(F.lit(True), F.col("n_barcodes"), F.col("min_barcodes"), F.col("has_splice_evidence"), F.col("near_polya_site"))
    category = F.when(F.col("overlaps_repeat"), "intergenic_repeat").when(~F.col("significant"), "intergenic_sparse").when(hot, "intergenic_hotspot").when(new, "intergenic_novel").otherwise("intergenic_hotspot")
    return df.withColumn("category", category).drop("_records", "_barcodes", "_tests")


def reallocate(counts: DataFrame, clustered: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """Counts with the sparse reads and bases of each cell moved in proportion to its records' loci.

    Categories take their share in the order in which the cell's records first have them, each
    rounded half to even and all together at most what there is.  Returns the counts' columns.
    """
    k = [*keys, "cell_barcode"]
    lk = [*keys, "contig", "strand", "locus_id"]
    r = clustered.join(scored.select(*lk, "category"), lk)
    per = r.groupBy(*k, "category").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("contig", "start_pos", "qname")).alias("first"))
    per = per.withColumn("total", F.sum("n").over(W.partitionBy(*k))).where("category != 'intergenic_sparse'")
    sparse = counts.where("category = 'intergenic_sparse' AND n_reads > 0").select(*k, F.col("n_reads").alias("sr"), F.col("n_bases").alias("sb"))
    w = W.partitionBy(*k).orderBy("first").rowsBetween(W.unboundedPreceding, 0)
    m = per.join(sparse, k)
    for have, move in (("sr", "n_reads"), ("sb", "n_bases")):
        part = F.bround(F.col(have) * (F.col("n") / F.col("total")), 0).cast("long")
        m = m.withColumn("_p", part).withColumn("_cum", F.sum("_p").over(w))
        m = m.withColumn(move, F.least("_cum", have) - F.least(F.col("_cum") - F.col("_p"), F.col(have))).drop("_p", "_cum")
    moved = m.select(*k, "category", "n_reads", "n_bases").where("n_reads > 0 OR n_bases > 0")
    taken = moved.groupBy(*k).agg((-F.sum("n_reads")).alias("n_reads"), (-F.sum("n_bases")).alias("n_bases")).withColumn("category", F.lit("intergenic_sparse"))
    both = counts.select(*k, "category", "n_reads", "n_bases").unionByName(moved).unionByName(taken)
    return both.groupBy(*k, "category").agg(F.sum("n_reads").alias("n_reads"), F.sum("n_bases").alias("n_bases"))
