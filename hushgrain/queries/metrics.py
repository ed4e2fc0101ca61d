"""Queries of counts and metrics over the delivered alignments."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrain import constants as C
from hushgrain.functions import names
from hushgrain.functions import reads as R
from hushgrain.operators import intervals as I
from hushgrain.operators import metrics as M
from hushgrain.queries.common import table
from hushgrain.standins import duck, view

QUERIES, SQL = {}, {}
S = ["sample_id"]
_TYPED = ("bigint", "double")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles to some digits, so that engines that interpolate differently agree."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def once(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Each delivered read once."""
    a = table(spark, d, "alignments").where("qname IS NOT NULL").select("qname", "sample_id", "category", "read_length", names.barcode(F.col("cb")).alias("cell_barcode"), names.umi(F.col("ub")).alias("umi"), *more).distinct()
    return a.withColumn("base_counts", F.create_map(F.coalesce("category", F.lit("")), F.when(F.col("read_length") > 0, F.col("read_length")).otherwise(0).cast("long")))


ONCE = """WITH once AS (SELECT DISTINCT qname, sample_id, category, read_length, coalesce(regexp_replace(upper(cb), '-1$', ''), '') AS cell_barcode, CASE WHEN ub <> '' THEN upper(ub) END AS umi, contig, flag FROM alignments WHERE qname IS NOT NULL),
cnt AS (SELECT sample_id, cell_barcode, category, count(*) AS n_reads, CAST(sum(CASE WHEN read_length > 0 THEN read_length ELSE 0 END) AS BIGINT) AS n_bases, count(DISTINCT umi) AS n_umis FROM once GROUP BY 1, 2, 3)"""


def counts(spark: SparkSession, d: str) -> DataFrame:
    return M.cell_counts(once(spark, d), S)


@query("cell_category_reads", ONCE + " SELECT sample_id, cell_barcode, category, n_reads FROM cnt")
def cell_category_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads per cell and category."""
    return M.category_reads(once(spark, d), [*S, "cell_barcode"])


@query("cell_category_bases", ONCE + " SELECT sample_id, cell_barcode, category, n_bases FROM cnt")
def cell_category_bases(spark: SparkSession, d: str) -> DataFrame:
    """Bases per cell and category."""
    return M.category_bases(once(spark, d), [*S, "cell_barcode"])


@query("cell_category_umis", ONCE + " SELECT sample_id, cell_barcode, category, n_umis FROM cnt WHERE n_umis > 0")
def cell_category_umis(spark: SparkSession, d: str) -> DataFrame:
    """Distinct molecules per cell and category."""
    return M.category_umis(once(spark, d), [*S, "cell_barcode"])


@query("umi_set_union", "SELECT sample_id, category, count(DISTINCT umi) AS n_umis FROM (SELECT sample_id, category, unnest(umi_set) AS umi FROM contig_results) u WHERE umi <> '' GROUP BY 1, 2")
def umi_set_union(spark: SparkSession, d: str) -> DataFrame:
    """Distinct molecules over the union of partial sets."""
    u = table(spark, d, "contig_results").select(*S, "category", F.explode("umi_set").alias("umi"))
    return M.category_umis(u, S)


@query("cell_counts", ONCE + " SELECT * FROM cnt")
def cell_counts(spark: SparkSession, d: str) -> DataFrame:
    """The long table of counts."""
    return counts(spark, d)


@query("length_bin_histogram", ONCE + " SELECT sample_id, category, (read_length >= 150)::INT + (read_length >= 500)::INT + (read_length >= 1000)::INT + (read_length >= 2000)::INT + (read_length >= 5000)::INT AS bin, count(*) AS n_reads FROM once WHERE read_length > 0 GROUP BY 1, 2, 3")
def length_bin_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Reads per category and length bin."""
    return M.length_bins(once(spark, d), S)


SQL["reservoir"] = SQL["reservoir_sample"] = ONCE + " SELECT sample_id, category, qname, read_length FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, category ORDER BY md5(qname), qname) AS rn FROM once WHERE read_length > 0) x WHERE rn <= 200"
QUERIES["reservoir"] = QUERIES["reservoir_sample"] = lambda spark, d: M.hashed_sample(once(spark, d).where("read_length > 0"), [*S, "category"], "qname", 200).select("sample_id", "category", "qname", "read_length")


@query("contig_partial_agg", ONCE + " SELECT sample_id, contig, category, count(*) AS n_reads FROM once GROUP BY 1, 2, 3")
def contig_partial_agg(spark: SparkSession, d: str) -> DataFrame:
    """One partial state per contig."""
    return M.category_reads(once(spark, d, "contig"), [*S, "contig"])


_PARTS = "SELECT DISTINCT worker_run, sample_id, run_day, contig, cell_barcode, category, read_count, base_count FROM contig_results"


def _parts(spark, d):
    return table(spark, d, "contig_results").drop("umi_set").distinct().withColumnsRenamed({"read_count": "n_reads", "base_count": "n_bases"})


@query("merge_final_agg", f"SELECT sample_id, cell_barcode, category, CAST(sum(read_count) AS BIGINT) AS n_reads, CAST(sum(base_count) AS BIGINT) AS n_bases FROM ({_PARTS}) p GROUP BY 1, 2, 3")
def merge_final_agg(spark: SparkSession, d: str) -> DataFrame:
    """Partial states of contigs, days and runs added up."""
    return M.merge_counts(_parts(spark, d), S)


@query("merge_samples", f"SELECT cell_barcode, category, CAST(sum(read_count) AS BIGINT) AS n_reads, CAST(sum(base_count) AS BIGINT) AS n_bases FROM ({_PARTS}) p GROUP BY 1, 2")
def merge_samples(spark: SparkSession, d: str) -> DataFrame:
    """The same over libraries."""
    return M.merge_counts(_parts(spark, d), [])


def _in(cats) -> str:
    return "(" + ", ".join(f"'{c}'" for c in cats) + ")"


def _sum(unit: str, cats) -> str:
    return f"CAST(sum(CASE WHEN category IN {_in(cats)} THEN {unit} ELSE 0 END) AS DOUBLE)"


_CELL_COLS = ", ".join(
    [f"{_sum('n_reads', [c])} / sum(n_reads) AS read_frac_{c}" for c in C.CATEGORY_ORDER]
    + [f"coalesce({_sum('n_bases', [c])} / nullif(sum(n_bases), 0), 0) AS base_frac_{c}" for c in C.CATEGORY_ORDER]
    + [f"{_sum('n_umis', [c])} / nullif(CAST(sum(CASE WHEN category = '{c}' THEN n_reads ELSE 0 END) AS BIGINT), 0) AS umi_complexity_{c}" for c in C.CATEGORY_ORDER]
    + [f"{_sum('n_reads', C.NOISE)} / sum(n_reads) AS noise_read_frac", f"coalesce({_sum('n_bases', C.NOISE)} / nullif(sum(n_bases), 0), 0) AS noise_base_frac"]
)
_FLAG_SQL = "SELECT sample_id, cell_barcode, count(*) FILTER (flag & 16 <> 0) AS n_tso, count(*) FILTER (read_length >= 1500) AS n_polya, count(*) FILTER (read_length > 0 AND read_length < 300) AS n_noncanon FROM once GROUP BY 1, 2"
CELLS = ONCE + f""", flg AS ({_FLAG_SQL}),
cell AS (SELECT sample_id, cell_barcode, CAST(sum(n_reads) AS BIGINT) AS n_reads, CAST(sum(n_bases) AS BIGINT) AS n_bases, {_CELL_COLS} FROM cnt GROUP BY 1, 2 HAVING sum(n_reads) >= 10),
cells AS (SELECT cell.*, n_tso, n_polya, n_noncanon FROM cell JOIN flg USING (sample_id, cell_barcode))"""


def _flags(spark, d):
    """Flags out of fields that the delivered alignments have, to show how they are summed."""
    r = once(spark, d, "flag").withColumns({"is_tso": R.has_flag("flag", 16), "is_polya": F.coalesce(F.col("read_length") >= 1500, F.lit(False)), "is_noncanon": F.coalesce((F.col("read_length") > 0) & (F.col("read_length") < 300), F.lit(False))})
    return M.cell_flags(r, [*S, "cell_barcode"])


def cells(spark: SparkSession, d: str) -> DataFrame:
    return M.cell_metrics(counts(spark, d), S, _flags(spark, d))


def rounded_sql(sql: str, cols: list[str], keep: str, src: str) -> str:
    return f"{sql} SELECT {keep}, {', '.join(f'round({c}, 9) AS {c}' for c in cols)} FROM {src}"


_FRACS = [*[f"read_frac_{c}" for c in C.CATEGORY_ORDER], *[f"base_frac_{c}" for c in C.CATEGORY_ORDER], *[f"umi_complexity_{c}" for c in C.CATEGORY_ORDER], "noise_read_frac", "noise_base_frac"]


@query("cell_metrics", rounded_sql(CELLS, _FRACS, "sample_id, cell_barcode, n_reads, n_bases, n_tso, n_polya, n_noncanon", "cells"))
def cell_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The wide table of cells."""
    return rounded(cells(spark, d))


SQL["sample_totals"] = (
    ONCE
    + " SELECT sample_id, category, n_reads, n_bases, round(n_reads / CAST(sum(n_reads) OVER (PARTITION BY sample_id) AS DOUBLE), 9) AS read_frac, round(coalesce(n_bases / nullif(CAST(sum(n_bases) OVER (PARTITION BY sample_id) AS DOUBLE), 0), 0), 9) AS base_frac FROM (SELECT sample_id, category, CAST(sum(n_reads) AS BIGINT) AS n_reads, CAST(sum(n_bases) AS BIGINT) AS n_bases FROM cnt GROUP BY 1, 2) t"
)


@query("sample_totals", SQL["sample_totals"])
def sample_totals(spark: SparkSession, d: str) -> DataFrame:
    """Reads and bases per library and category with fractions."""
    return rounded(M.sample_totals(counts(spark, d), S))


_NOISES = {f"noise_{u}_frac{'_strict' if st else ''}{'_unstranded' if un else ''}": (f"n_{u}s", M.noise_set(st, un)) for u in ("read", "base") for st in (False, True) for un in (False, True)}


@query("noise_fractions", ONCE + " SELECT sample_id, " + ", ".join(f"round(coalesce({_sum(u, c)} / nullif(sum({u}), 0), 0), 9) AS {n}" for n, (u, c) in _NOISES.items()) + " FROM cnt GROUP BY 1")
def noise_fractions(spark: SparkSession, d: str) -> DataFrame:
    """Noise fractions per library."""
    return rounded(M.noise_fractions(counts(spark, d), S))


def sample_row(spark: SparkSession, d: str) -> DataFrame:
    return M.sample_metrics(counts(spark, d), cells(spark, d), S)


_ES, _EA = _sum("n_reads", ["exonic_sense"]), _sum("n_reads", ["exonic_antisense"])


@query("strand_concordance", ONCE + f" SELECT sample_id, round({_ES} / nullif({_ES} + {_EA}, 0), 9) AS strand_concordance FROM cnt GROUP BY 1")
def strand_concordance(spark: SparkSession, d: str) -> DataFrame:
    """Sense among sense and antisense reads."""
    return rounded(sample_row(spark, d).select(*S, "strand_concordance"))


@query("chimeric_multimapper_rates", ONCE + f" SELECT sample_id, round({_sum('n_reads', ['chimeric'])} / sum(n_reads), 9) AS chimeric_read_frac, round({_sum('n_reads', ['multimapper'])} / sum(n_reads), 9) AS multimapper_read_frac FROM cnt GROUP BY 1")
def chimeric_multimapper_rates(spark: SparkSession, d: str) -> DataFrame:
    """Shares of chimeric reads and multimappers."""
    return rounded(sample_row(spark, d).select(*S, "chimeric_read_frac", "multimapper_read_frac"))


_SPREAD = "SELECT sample_id, count(*) AS n_cells, round(quantile_cont(noise_read_frac, 0.5), 9) AS per_cell_noise_median, round(quantile_cont(noise_read_frac, 0.75) - quantile_cont(noise_read_frac, 0.25), 9) AS per_cell_noise_iqr FROM cells GROUP BY 1"


@query("cell_noise_median_iqr", CELLS + " SELECT sample_id, per_cell_noise_median, per_cell_noise_iqr FROM (" + _SPREAD + ") s")
def cell_noise_median_iqr(spark: SparkSession, d: str) -> DataFrame:
    """Median and quartile range of the cells' noise."""
    return rounded(sample_row(spark, d).where("n_cells > 0").select(*S, "per_cell_noise_median", "per_cell_noise_iqr"))


@query("n_cells", CELLS + " SELECT s.sample_id, coalesce(n, 0) AS n_cells FROM (SELECT DISTINCT sample_id FROM cnt) s LEFT JOIN (SELECT sample_id, count(*) AS n FROM cells GROUP BY 1) c USING (sample_id)")
def n_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells with enough reads."""
    return sample_row(spark, d).select(*S, "n_cells")


@query("umi_complexity_mean", CELLS + " SELECT sample_id, " + ", ".join(f"round(avg(umi_complexity_{c}), 6) AS umi_complexity_{c}" for c in C.CATEGORY_ORDER) + " FROM cells GROUP BY 1")
def umi_complexity_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean molecules per read over cells."""
    return rounded(sample_row(spark, d).where("n_cells > 0").select(*S, *[f"umi_complexity_{c}" for c in C.CATEGORY_ORDER]), 6)


_MQ = ["noise_read_frac", "noise_base_frac", "noise_read_frac_strict", "noise_base_frac_strict", "strand_concordance", "chimeric_read_frac", "multimapper_read_frac"]


@query("multiqc_scalars", CELLS + f", s AS (SELECT sample_id, {', '.join(f'coalesce({_sum(u, c)} / nullif(sum({u}), 0), 0) AS {n}' for n, (u, c) in _NOISES.items() if 'unstranded' not in n)}, {_ES} / nullif({_ES} + {_EA}, 0) AS strand_concordance, {_sum('n_reads', ['chimeric'])} / sum(n_reads) AS chimeric_read_frac, {_sum('n_reads', ['multimapper'])} / sum(n_reads) AS multimapper_read_frac, CAST(sum(n_reads) AS BIGINT) AS n_reads_classified FROM cnt GROUP BY 1) SELECT sample_id, n_reads_classified, {', '.join(f'round({c}, 6) AS {c}' for c in _MQ)} FROM s")
def multiqc_scalars(spark: SparkSession, d: str) -> DataFrame:
    """The scalars that the summary sink rounds further."""
    return rounded(sample_row(spark, d).select(*S, "n_reads_classified", *_MQ), 6)


@query("full_length_frac", ONCE + " SELECT sample_id, round(count(*) FILTER (read_length >= 500) / CAST(count(*) AS DOUBLE), 9) AS full_length_read_frac FROM once WHERE category = 'exonic_sense' AND read_length > 0 GROUP BY 1")
def full_length_frac(spark: SparkSession, d: str) -> DataFrame:
    """Share of long sense reads where there are no sites."""
    return rounded(M.full_length(once(spark, d), S).select(*S, "full_length_read_frac"))


def _anchored(name: str, end: str, distance: int, duck_end: str) -> None:
    SQL[name] = duck("reads", "sites") + f" SELECT contig, round(count(*) FILTER (EXISTS (SELECT 1 FROM sites s WHERE s.contig = r.contig AND s.pos BETWEEN {duck_end} - {distance} AND {duck_end} + {distance})) / CAST(count(*) AS DOUBLE), 9) AS fraction FROM reads r WHERE flag & 2308 = 0 AND cigar NOT LIKE '%N%' AND cigar NOT LIKE '%D%' GROUP BY contig"

    def run(spark: SparkSession, d: str) -> DataFrame:
        r = view(spark, d, "reads").where(R.is_primary() & ~F.col("cigar").contains("N") & ~F.col("cigar").contains("D")).withColumn("category", F.lit("exonic_sense")).withColumn("ref_end", R.ref_end())
        r = I.near(r.withColumn("end_pos", (R.three_prime if end == "three" else R.five_prime)()), view(spark, d, "sites"), ["contig"], "end_pos", distance)
        return rounded(M.full_length(r, ["contig"], "is_near").select("contig", F.col("full_length_read_frac").alias("fraction")))

    run.__doc__ = f"Share of reads whose {end}-prime end lies within {distance} bases of a site."
    QUERIES[name] = run


_E3 = "CASE WHEN strand = '-' THEN r.pos ELSE r.pos + read_length END"
_E5 = "CASE WHEN strand = '-' THEN r.pos + read_length ELSE r.pos END"
_anchored("site_anchored_frac", "three", C.POLYA_SITE_DISTANCE, f"({_E3})")
_anchored("tss_anchored_frac", "five", C.TSS_DISTANCE, f"({_E5})")


@query("numt_interval_count", duck("repeats") + " SELECT CAST(count(*) AS DOUBLE) AS numt_interval_count FROM repeats")
def numt_interval_count(spark: SparkSession, d: str) -> DataFrame:
    """The number of loaded intervals."""
    return view(spark, d, "repeats").agg(F.count(F.lit(1)).cast("double").alias("numt_interval_count"))


_BINS = "SELECT sample_id, category, (read_length >= 150)::INT + (read_length >= 500)::INT + (read_length >= 1000)::INT + (read_length >= 2000)::INT + (read_length >= 5000)::INT AS bin, count(*) AS n FROM once WHERE read_length > 0 GROUP BY 1, 2, 3"
_STRAT = f"""{ONCE}, b AS ({_BINS}), m AS (SELECT sample_id, quantile_cont(read_length, 0.5) AS med FROM once WHERE read_length > 0 GROUP BY 1),
l AS (SELECT sample_id, category, CASE WHEN med < 300 THEN {list(C.LENGTH_LABELS)!r}[bin + 1] ELSE {list(C.LENGTH_LABELS_MERGED)!r}[greatest(bin, 1)] END AS length_bin, CAST(sum(n) AS BIGINT) AS count FROM b JOIN m USING (sample_id) GROUP BY 1, 2, 3)
SELECT sample_id, length_bin, category, count, round(count / CAST(sum(count) OVER (PARTITION BY sample_id, length_bin) AS DOUBLE), 9) AS fraction_of_bin, round(count / CAST(sum(count) OVER (PARTITION BY sample_id) AS DOUBLE), 9) AS fraction_of_total FROM l"""


@query("length_stratification", _STRAT)
def length_stratification(spark: SparkSession, d: str) -> DataFrame:
    """Counts and shares per length bin."""
    r = once(spark, d)
    return rounded(M.length_stratification(M.length_bins(r, S), M.median_length(r, S), S).drop("bin_order"))


SQL["share_of_partition"] = _STRAT
QUERIES["share_of_partition"] = length_stratification

_OBS = "SELECT DISTINCT cell_barcode, concat('C', CAST(ascii(cell_barcode) % 4 AS VARCHAR)) AS cluster FROM cells WHERE cell_barcode <> ''"


def obs(cells_: DataFrame) -> DataFrame:
    """A cluster for each barcode, by its first letter."""
    return cells_.where("cell_barcode != ''").select("cell_barcode", F.concat(F.lit("C"), (F.ascii("cell_barcode") % 4).cast("string")).alias("cluster")).distinct()


_CL = []
for _col, _name in M.CLUSTER_COLUMNS.items():
    _CL += [f"round(quantile_cont({_col}, 0.5), 9) AS median_{_name}", f"round(quantile_cont({_col}, 0.75) - quantile_cont({_col}, 0.25), 9) AS iqr_{_name}"]
_CL += [f"round(quantile_cont({f} / CAST(n_reads AS DOUBLE), 0.5), 9) AS median_{f[2:]}_rate" for f in M.FLAGS]
CLUSTERS = CELLS + f", cl AS (SELECT cluster, count(*) AS n_cells, {', '.join(_CL)} FROM cells JOIN ({_OBS}) o USING (cell_barcode) GROUP BY 1)"


def clusters(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    return rounded(M.cluster_metrics(c, obs(c)))


@query("cluster_metrics", CLUSTERS + " SELECT * FROM cl")
def cluster_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Medians and quartile ranges per cluster."""
    return clusters(spark, d)


@query("obs_join", CELLS + f" SELECT sample_id, cell_barcode, cluster, n_reads FROM cells JOIN ({_OBS}) o USING (cell_barcode)")
def obs_join(spark: SparkSession, d: str) -> DataFrame:
    """Cells with their cluster."""
    c = cells(spark, d)
    return c.join(obs(c), "cell_barcode").select("sample_id", "cell_barcode", "cluster", "n_reads")





@query("per_well_metrics", ONCE + " SELECT " + "substr(sample_id, 1, 2) AS plate_id, substr(sample_id, 3) AS well_id, CAST(sum(n_reads) AS BIGINT) AS n_reads_classified, " + f"round({_sum('n_reads', C.NOISE)} / sum(n_reads), 9) AS noise_read_frac, round({_sum('n_reads', C.NOISE_STRICT)} / sum(n_reads), 9) AS noise_read_frac_strict, round({_ES} / nullif({_ES} + {_EA}, 0), 9) AS strand_concordance FROM cnt GROUP BY 1, 2")
def per_well_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The sample metrics of each well of a plate."""
    k = ["plate_id", "well_id"]
    r = once(spark, d).withColumn("plate_id", F.substring("sample_id", 1, 2)).withColumn("well_id", F.expr("substring(sample_id, 3)"))
    c = M.cell_counts(r, k)
    s = M.sample_metrics(c, M.cell_metrics(c, k), k)
    return rounded(s.select(*k, "n_reads_classified", "noise_read_frac", "noise_read_frac_strict", "strand_concordance"))
