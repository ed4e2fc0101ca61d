"""Counts per cell and category, and the metrics of cells, samples, clusters and wells.

The long table of counts (``keys..., cell_barcode, category, n_reads, n_bases, n_umis``) is the
hinge: it is a few rows per cell, it adds up over contigs, wells and runs, and everything
after it is arithmetic on it.  Sums stay integers until the one division.

Undefined ratios are null.  Null barcodes count as ``''``; null categories are left out of the
wide tables; ``keys`` name the sample (or plate and well) and may be empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hushgrain import constants as C
from hushgrain.functions import reads as R

FLAGS = ("n_tso", "n_polya", "n_noncanon")


def noise_set(strict: bool = False, unstranded: bool = False) -> tuple[str, ...]:
    return {(False, False): C.NOISE, (True, False): C.NOISE_STRICT, (False, True): C.NOISE_UNSTRANDED, (True, True): C.NOISE_STRICT_UNSTRANDED}[(strict, unstranded)]


# --- counts ---


def category_reads(reads: DataFrame, keys: list[str]) -> DataFrame:
    return reads.groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("n_reads"))


def category_bases(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Bases per base category; it may differ from the read's category."""
    return reads.select(*keys, F.explode("base_counts").alias("category", "bases")).groupBy(*keys, "category").agg(F.sum("bases").alias("n_bases"))


def category_umis(reads: DataFrame, keys: list[str], dedup: bool = True) -> DataFrame:
    """Distinct molecules per read category, exact; empty and null ones count nothing; without ``dedup`` 0.

    The first step is by molecule, so a hot cell or category is spread over tasks.
    """
    if not dedup:
        return reads.groupBy(*keys, "category").agg(F.lit(0).cast("long").alias("n_umis"))
    return reads.where("umi != ''").select(*keys, "category", "umi").distinct().groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("n_umis"))


def cell_flags(reads: DataFrame, keys: list[str]) -> DataFrame:
    return reads.groupBy(*keys).agg(F.count_if("is_tso").alias("n_tso"), F.count_if("is_polya").alias("n_polya"), F.count_if("is_noncanon").alias("n_noncanon"))


def cell_counts(reads: DataFrame, keys: list[str], dedup: bool = True) -> DataFrame:
    """The long table of counts out of single reads: a union of three sums, added up in one shuffle."""
    k = [*keys, "cell_barcode"]
    zero = F.lit(0).cast("long")
    parts = [
        category_reads(reads, k).withColumns({"n_bases": zero, "n_umis": zero}),
        category_bases(reads, k).withColumns({"n_reads": zero, "n_umis": zero}),
        category_umis(reads, k, dedup).withColumns({"n_reads": zero, "n_bases": zero}),
    ]
    return merge_counts(parts[0].unionByName(parts[1]).unionByName(parts[2]), keys)


def merge_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Add up counts of parts.  Molecules add only over parts that share none."""
    cols = [c for c in ("n_reads", "n_bases", "n_umis") if c in counts.columns]
    return counts.groupBy(*keys, "cell_barcode", "category").agg(*[F.sum(c).alias(c) for c in cols])


def length_bins(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Exact counts per category and length bin of reads of known length."""
    return reads.where("read_length > 0").groupBy(*keys, "category", R.length_bin("read_length").alias("bin")).agg(F.count(F.lit(1)).alias("n_reads"))


def hashed_sample(reads: DataFrame, keys: list[str], ident: str, size: int) -> DataFrame:
    """Up to ``size`` rows per key, those with the least hash of ``ident``: uniform and the same on every run.

    Spark limits each task to ``size`` rows a key before the shuffle.
    """
    w = W.partitionBy(*keys).orderBy(F.md5(F.col(ident)), ident)
    return reads.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size).drop("_r")


# --- cells ---


def _wide(counts: DataFrame, keys: list[str]) -> DataFrame:
    def per(col: str) -> list[Column]:
        return [F.sum(F.when(F.col("category") == c, F.col(col)).otherwise(0)).alias(f"{col}_{c}") for c in C.CATEGORY_ORDER]

    return counts.groupBy(*keys).agg(F.sum("n_reads").alias("n_reads"), F.sum("n_bases").alias("n_bases"), *per("n_reads"), *per("n_bases"), *per("n_umis"))


def _share(top: str | Column, bottom: str | Column, default: float | None = 0.0) -> Column:
    x = F.try_divide(top, bottom)
    return x if default is None else F.coalesce(x, F.lit(default))


def _noise(prefix: str, strict: bool, unstranded: bool) -> Column:
    return sum((F.col(f"{prefix}_{c}") for c in noise_set(strict, unstranded)), F.lit(0))


def cell_metrics(counts: DataFrame, keys: list[str], flags: DataFrame | None = None, least: int = C.MIN_CELL_READS, unstranded: bool = False) -> DataFrame:
    """One row per cell of at least ``least`` reads: totals, fractions, complexity, noise and flags."""
    k = [*keys, "cell_barcode"]
    w = _wide(counts, k).where(F.col("n_reads") >= least)
    out = w.select(
        *k,
        "n_reads",
        "n_bases",
        *[_share(f"n_reads_{c}", "n_reads").alias(f"read_frac_{c}") for c in C.CATEGORY_ORDER],
        *[_share(f"n_bases_{c}", "n_bases").alias(f"base_frac_{c}") for c in C.CATEGORY_ORDER],
        *[_share(f"n_umis_{c}", f"n_reads_{c}", None).alias(f"umi_complexity_{c}") for c in C.CATEGORY_ORDER],
        _share(_noise("n_reads", False, unstranded), "n_reads").alias("noise_read_frac"),
        _share(_noise("n_bases", False, unstranded), "n_bases").alias("noise_base_frac"),
    )
    if flags is not None:
        out = out.join(flags, k, "left")
    return out.withColumns({f: F.coalesce(F.col(f), F.lit(0)).cast("long") if flags is not None else F.lit(0).cast("long") for f in FLAGS})


# --- samples ---


def sample_totals(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Reads and bases per category over all barcodes, and their fractions."""
    t = counts.groupBy(*keys, "category").agg(F.sum("n_reads").alias("n_reads"), F.sum("n_bases").alias("n_bases"))
    w = W.partitionBy(*keys)
    return t.withColumn("read_frac", _share("n_reads", F.sum("n_reads").over(w))).withColumn("base_frac", _share("n_bases", F.sum("n_bases").over(w)))


def noise_fractions(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Noise fractions per sample, each conservative and strict, stranded and unstranded."""
    t = counts.groupBy(*keys)
    cols = []
    for unit in ("read", "base"):
        n = F.col(f"n_{unit}s")
        for strict in (False, True):
            for unstranded in (False, True):
                name = f"noise_{unit}_frac{'_strict' if strict else ''}{'_unstranded' if unstranded else ''}"
                cols.append(_share(F.sum(F.when(F.col("category").isin(*noise_set(strict, unstranded)), n).otherwise(0)), F.sum(n)).alias(name))
    return t.agg(*cols)


def sample_metrics(counts: DataFrame, cells: DataFrame, keys: list[str], unstranded: bool = False) -> DataFrame:
    """One row per sample: totals, fractions, noise, concordance, rates, and the spread over cells."""
    s = _wide(counts, keys)
    es, ea = F.col("n_reads_exonic_sense"), F.col("n_reads_exonic_antisense")
    one = s.select(
        *keys,
        F.col("n_reads").alias("n_reads_classified"),
        F.col("n_reads_unassigned"),
        *[_share(f"n_reads_{c}", "n_reads").alias(f"read_frac_{c}") for c in C.CATEGORY_ORDER],
        *[_share(f"n_bases_{c}", "n_bases").alias(f"base_frac_{c}") for c in C.CATEGORY_ORDER],
        *[_share(_noise(f"n_{u}s", strict, unstranded), f"n_{u}s").alias(f"noise_{u}_frac{'_strict' if strict else ''}") for u in ("read", "base") for strict in (False, True)],
        _share(es, es + ea, None).alias("strand_concordance"),
        _share("n_reads_chimeric", "n_reads").alias("chimeric_read_frac"),
        _share("n_reads_multimapper", "n_reads").alias("multimapper_read_frac"),
    )
    spread = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), F.percentile("noise_read_frac", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"), *[F.avg(f"umi_complexity_{c}").alias(f"umi_complexity_{c}") for c in C.CATEGORY_ORDER])
    spread = spread.withColumn("per_cell_noise_median", F.col("_q")[1]).withColumn("per_cell_noise_iqr", F.col("_q")[2] - F.col("_q")[0]).drop("_q")
    joined = one.join(spread, keys, "left") if keys else one.join(F.broadcast(spread))
    return joined.withColumn("n_cells", F.coalesce("n_cells", F.lit(0)))


def full_length(reads: DataFrame, keys: list[str], near: str | None = None, least: int = C.FULL_LENGTH_MIN_DEFAULT) -> DataFrame:
    """The share of sense reads whose end lies at a known site (column ``near``), or without sites of at least ``least`` bases."""
    ok = F.col(near) if near else F.col("read_length") >= least
    rows = reads.where("category = 'exonic_sense'")
    rows = rows if near else rows.where("read_length > 0")
    return rows.groupBy(*keys).agg(F.count_if(ok).alias("n_full"), F.count(F.lit(1)).alias("n_sense")).withColumn("full_length_read_frac", _share("n_full", "n_sense", None))


def length_stratification(bins: DataFrame, medians: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per length bin and category with shares of the bin and of all.

    ``medians`` has ``keys..., median_length``; short reads keep six bins, others merge the first two.
    """
    short = F.coalesce("median_length", F.lit(float(C.DEFAULT_MEDIAN))) < C.SHORT_READ_MEDIAN
    long_label = F.element_at(F.array(*[F.lit(x) for x in C.LENGTH_LABELS]), F.col("bin") + 1)
    merged = F.element_at(F.array(*[F.lit(x) for x in C.LENGTH_LABELS_MERGED]), F.greatest(F.col("bin"), F.lit(1)))
    j = bins.join(medians, keys, "left").withColumn("length_bin", F.when(short, long_label).otherwise(merged)).withColumn("bin_order", F.when(short, F.col("bin")).otherwise(F.greatest(F.col("bin"), F.lit(1))))
    t = j.groupBy(*keys, "length_bin", "bin_order", "category").agg(F.sum("n_reads").alias("count")).where("count > 0")
    return t.withColumn("fraction_of_bin", _share("count", F.sum("count").over(W.partitionBy(*keys, "length_bin")))).withColumn("fraction_of_total", _share("count", F.sum("count").over(W.partitionBy(*keys))))


def median_length(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Exact over all reads of known length, where the original samples."""
    return reads.where("read_length > 0").groupBy(*keys).agg(F.percentile("read_length", F.lit(0.5)).alias("median_length"))


CLUSTER_COLUMNS = {
    "noise_read_frac": "noise_read_frac",
    "noise_base_frac": "noise_base_frac",
    "read_frac_exonic_sense": "exonic_sense_frac",
    "read_frac_intronic_pure": "intronic_pure_frac",
    "read_frac_chimeric": "chimeric_frac",
    "read_frac_exonic_antisense": "exonic_antisense_frac",
    "read_frac_ambiguous_cod_cod": "ambiguous_cod_cod_frac",
}


def cluster_metrics(cells: DataFrame, obs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per cluster: number of cells, medians and quartile ranges, medians of flag rates.  Barcodes match exactly; no match gives no rows."""
    j = cells.join(obs.select("cell_barcode", "cluster"), "cell_barcode")
    cols = [F.count(F.lit(1)).alias("n_cells")]
    for col, name in CLUSTER_COLUMNS.items():
        q = F.percentile(col, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        cols += [q[1].alias(f"median_{name}"), (q[2] - q[0]).alias(f"iqr_{name}")]
    cols += [F.percentile(F.try_divide(f, "n_reads"), F.lit(0.5)).alias(f"median_{f[2:]}_rate") for f in FLAGS]
    return j.groupBy(*(keys or []), "cluster").agg(*cols)


def long_metrics(one: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., metric, value``: the numbers of a wide row."""
    cols = [c for c, t in one.dtypes if c not in keys and t in ("int", "bigint", "double")]
    return one.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(keys, cols, "metric", "value")
