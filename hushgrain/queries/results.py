"""Queries of intergenic loci, reallocation, comparison, evaluation and figures."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrain import constants as C
from hushgrain.functions import names
from hushgrain.functions import reads as R
from hushgrain.operators import compare as P
from hushgrain.operators import figures as V
from hushgrain.operators import intergenic as G
from hushgrain.operators import metrics as M
from hushgrain.operators import sequence
from hushgrain.queries import metrics as Q
from hushgrain.queries import reads
from hushgrain.queries.reads import _fetch_sql
from hushgrain.queries.common import table
from hushgrain.storage import materialise
from hushgrain.standins import CHUNK, duck, view

QUERIES, SQL = {}, {}
S = ["sample_id"]
#: Bases between genes that the background rate assumes: the whole genome.
_BASES = "(SELECT CAST(sum(contig_length) AS BIGINT) FROM contigs)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_NAMES = "SELECT name_key, min(contig) AS canonical FROM (SELECT upper(contig) AS name_key, contig FROM contigs UNION ALL SELECT upper(ensembl_name), contig FROM contigs) u GROUP BY name_key"
_MODAL = "SELECT sample_id AS s_, contig, strand AS t_, locus_id AS l_, modal_three_prime AS pos_at FROM mod"
RECORDS = duck("chunks") + f""", rec AS (SELECT DISTINCT qname, sample_id, canonical AS contig, start_pos + d_ AS start_pos, end_pos + d_ AS end_pos, strand, coalesce(regexp_replace(upper(cell_barcode), '-1$', ''), '') AS cell_barcode, coalesce(has_junction, false) AS has_junction, three_prime + d_ AS three_prime
  FROM (SELECT *, CASE WHEN start_pos % 3 = 0 THEN (start_pos % 2) * 1000000 + start_pos % 400 - start_pos ELSE 0 END AS d_ FROM intergenic_reads) i JOIN ({_NAMES}) n ON upper(contig) = name_key),
iv AS (SELECT *, start_pos AS s, greatest(end_pos, start_pos + 1) AS e FROM rec),
lab AS (SELECT *, sum(n_) OVER (PARTITION BY sample_id, contig, strand ORDER BY s, e) AS locus_id FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY sample_id, contig, strand ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 500 THEN 0 ELSE 1 END AS n_ FROM iv) x),
loc AS (SELECT sample_id, contig, strand, locus_id, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS n_reads, count(DISTINCT cell_barcode) AS n_barcodes, bool_or(has_junction) AS has_splice_evidence FROM lab GROUP BY 1, 2, 3, 4),
mod AS (SELECT sample_id, contig, strand, locus_id, three_prime AS modal_three_prime FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, contig, strand, locus_id ORDER BY n DESC, first_) AS rn FROM
  (SELECT sample_id, contig, strand, locus_id, three_prime, count(*) AS n, min(ROW(start_pos, qname)) AS first_ FROM lab GROUP BY 1, 2, 3, 4, 5) y) z WHERE rn = 1),
smp AS (SELECT sample_id, count(*) AS n_rec, count(DISTINCT cell_barcode) AS n_bar FROM rec GROUP BY 1),
tst AS (SELECT sample_id, count(*) AS n_tests FROM loc GROUP BY 1),
rep AS (SELECT DISTINCT contig, (start_pos // 100000) * 100000 + 50000 AS s, (start_pos // 100000) * 100000 + 53000 AS e FROM rec),
sit AS (SELECT DISTINCT contig, three_prime AS pos FROM rec WHERE three_prime % 5 = 0),
ctx AS ({_fetch_sql(_MODAL, C.POLYA_WINDOW)}),
lam AS (SELECT l.*, m.modal_three_prime, n_tests, n_rec / CAST({_BASES} AS DOUBLE) * greatest(end_pos - start_pos, 1) AS expected, greatest(3, CAST(floor(n_bar * 0.0001) AS INT)) AS min_barcodes FROM loc l JOIN mod m USING (sample_id, contig, strand, locus_id) JOIN smp USING (sample_id) JOIN tst USING (sample_id)),
prob AS (SELECT *, CASE WHEN expected > 0 THEN 1 - list_sum(list_transform(range(0, n_reads), lambda k: exp(-expected + k * ln(expected) - lgamma(k + 1)))) ELSE 1.0 END AS p FROM lam),
sig AS (SELECT *, least(p * n_tests, 1) < 0.01 AND n_reads >= 5 AND n_barcodes >= min_barcodes AS significant, EXISTS (SELECT 1 FROM ctx WHERE ctx.s_ = prob.sample_id AND ctx.contig = prob.contig AND ctx.t_ = prob.strand AND ctx.l_ = prob.locus_id AND contains(ctx.bases, '{'A' * C.POLYA_RUN}')) AS polya_run,
  EXISTS (SELECT 1 FROM sit WHERE sit.contig = prob.contig AND sit.pos BETWEEN modal_three_prime - 50 AND modal_three_prime + 50) AS near_polya_site, EXISTS (SELECT 1 FROM rep WHERE rep.contig = prob.contig AND rep.s < end_pos AND rep.e > start_pos) AS overlaps_repeat FROM prob),
dec AS (SELECT *, CASE WHEN overlaps_repeat THEN 'intergenic_repeat' WHEN NOT significant THEN 'intergenic_sparse' WHEN NOT has_splice_evidence AND polya_run THEN 'intergenic_hotspot' WHEN n_barcodes >= min_barcodes AND (has_splice_evidence OR near_polya_site) THEN 'intergenic_novel' ELSE 'intergenic_hotspot' END AS category FROM sig)"""
_PLACE = "sample_id, contig, strand, start_pos, end_pos"


def recs(spark: SparkSession, d: str) -> DataFrame:
    """Each intergenic read once.  Every third is moved to one of two places of its contig, since the test reads gather nowhere by themselves."""
    r = names.with_contig(table(spark, d, "intergenic_reads").withColumn("cell_barcode", names.barcode(F.col("cell_barcode"))), table(spark, d, "contigs"))
    r = r.where("contig_key IS NOT NULL").select("qname", *S, F.col("contig_key").alias("contig"), "start_pos", "end_pos", "strand", "cell_barcode", "has_junction", "three_prime")
    to = F.when(F.col("start_pos") % 3 == 0, (F.col("start_pos") % 2) * 1000000 + F.col("start_pos") % 400 - F.col("start_pos")).otherwise(0)
    moved = r.withColumn("_d", to).withColumns({c: F.col(c) + F.col("_d") for c in ("start_pos", "end_pos", "three_prime")}).drop("_d")
    return G.records(moved).distinct()


def _loci(spark, d):
    return G.loci(G.cluster(recs(spark, d), S), S)


def scored(spark: SparkSession, d: str, r: DataFrame | None = None, clustered: DataFrame | None = None) -> DataFrame:
    """Loci with category; the run of A is looked up in the sequence."""
    r = materialise(recs(spark, d), "records") if r is None else r
    bases = table(spark, d, "contigs").agg(F.sum("contig_length")).first()[0]
    repeats = r.select("contig", F.expr("(start_pos div 100000) * 100000 + 50000").alias("s")).distinct().withColumn("e", F.col("s") + 3000)
    sites = r.where("three_prime % 5 = 0").select("contig", F.col("three_prime").alias("pos")).distinct()
    found = materialise(G.loci(G.cluster(r, S) if clustered is None else clustered, S), "loci")
    found = sequence.fetch(found, reads._chunks(spark, d), "contig", "modal_three_prime", C.POLYA_WINDOW, CHUNK)
    every = table(spark, d, "alignments").where("qname IS NOT NULL").select(*S, names.barcode(F.col("cb")).alias("cell_barcode"))
    return G.score(found, r, S, bases, repeats, sites, R.has_a_run("bases"), barcodes=every)


def _moved(spark, d, counts):
    """Counts after reallocation; records and their clusters are made once."""
    r = materialise(recs(spark, d), "records")
    clustered = materialise(G.cluster(r, S), "clustered")
    return G.reallocate(counts, clustered, scored(spark, d, r, clustered), S)


@query("record_extract", RECORDS + " SELECT * FROM rec")
def record_extract(spark: SparkSession, d: str) -> DataFrame:
    """Typed intergenic records, each read once."""
    return recs(spark, d)


@query("cluster_reads", RECORDS + " SELECT qname, sample_id, contig, strand, CAST(locus_id AS BIGINT) AS locus_id FROM lab")
def cluster_reads(spark: SparkSession, d: str) -> DataFrame:
    """Each record's locus."""
    return G.cluster(recs(spark, d), S).select("qname", *S, "contig", "strand", "locus_id")


@query("locus_aggregate", RECORDS + f" SELECT {_PLACE}, n_reads, n_barcodes, has_splice_evidence FROM loc")
def locus_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Loci with reads, barcodes and junction evidence."""
    return _loci(spark, d).select(*_PLACE.split(", "), "n_reads", "n_barcodes", "has_splice_evidence")


@query("modal_three_prime", RECORDS + " SELECT sample_id, contig, strand, CAST(locus_id AS BIGINT) AS locus_id, modal_three_prime FROM mod")
def modal_three_prime(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent 3' end of each locus."""
    return _loci(spark, d).select(*S, "contig", "strand", "locus_id", "modal_three_prime")


@query("poisson_locus_test", RECORDS + f" SELECT {_PLACE}, n_reads, significant FROM sig")
def poisson_locus_test(spark: SparkSession, d: str) -> DataFrame:
    """Which loci stand out of the background."""
    return scored(spark, d).select(*_PLACE.split(", "), "n_reads", "significant")


@query("locus_decision", RECORDS + f" SELECT {_PLACE}, category, near_polya_site, overlaps_repeat FROM dec")
def locus_decision(spark: SparkSession, d: str) -> DataFrame:
    """Each locus's category."""
    return scored(spark, d).select(*_PLACE.split(", "), "category", "near_polya_site", "overlaps_repeat")


def _rule(name: str, category: str) -> None:
    SQL[name] = RECORDS + f" SELECT {_PLACE} FROM dec WHERE category = '{category}'"
    QUERIES[name] = lambda spark, d: scored(spark, d).where(F.col("category") == category).select(*_PLACE.split(", "))


_rule("is_hotspot", "intergenic_hotspot")
_rule("is_novel", "intergenic_novel")
_rule("polya_context_repeat", "intergenic_repeat")


@query("polya_context", RECORDS + f" SELECT {_PLACE}, polya_run AS polya_run_downstream FROM sig WHERE polya_run")
def polya_context(spark: SparkSession, d: str) -> DataFrame:
    """Loci with a run of A downstream."""
    return scored(spark, d).where("polya_run_downstream").select(*_PLACE.split(", "), "polya_run_downstream")


_MOVES = (
    RECORDS
    + f""", a AS (SELECT DISTINCT qname, sample_id, category, read_length, coalesce(regexp_replace(upper(cb), '-1$', ''), '') AS cell_barcode FROM alignments WHERE qname IS NOT NULL),
cnt AS (SELECT sample_id, cell_barcode, category, count(*) AS n_reads, CAST(sum(CASE WHEN read_length > 0 THEN read_length ELSE 0 END) AS BIGINT) AS n_bases FROM a GROUP BY 1, 2, 3),
rc AS (SELECT l.sample_id, l.cell_barcode, d.category, count(*) AS n, min(ROW(l.contig, l.start_pos, l.qname)) AS first_ FROM lab l JOIN dec d USING (sample_id, contig, strand, locus_id) GROUP BY 1, 2, 3),
tt AS (SELECT *, CAST(sum(n) OVER (PARTITION BY sample_id, cell_barcode) AS BIGINT) AS total FROM rc),
mv AS (SELECT t.sample_id, t.cell_barcode, t.category, first_, c.n_reads AS sr, c.n_bases AS sb, CAST(round_even(c.n_reads * (n / CAST(total AS DOUBLE)), 0) AS BIGINT) AS pr, CAST(round_even(c.n_bases * (n / CAST(total AS DOUBLE)), 0) AS BIGINT) AS pb
  FROM tt t JOIN cnt c ON c.sample_id = t.sample_id AND c.cell_barcode = t.cell_barcode AND c.category = 'intergenic_sparse' WHERE t.category <> 'intergenic_sparse'),
cu AS (SELECT *, sum(pr) OVER w AS cr, sum(pb) OVER w AS cbs FROM mv WINDOW w AS (PARTITION BY sample_id, cell_barcode ORDER BY first_ ROWS UNBOUNDED PRECEDING)),
mo AS (SELECT sample_id, cell_barcode, category, CAST(least(cr, sr) - least(cr - pr, sr) AS BIGINT) AS n_reads, CAST(least(cbs, sb) - least(cbs - pb, sb) AS BIGINT) AS n_bases FROM cu),
al AS (SELECT sample_id, cell_barcode, category, n_reads, n_bases FROM cnt UNION ALL SELECT * FROM mo WHERE n_reads > 0 OR n_bases > 0 UNION ALL SELECT sample_id, cell_barcode, 'intergenic_sparse', -n_reads, -n_bases FROM mo WHERE n_reads > 0 OR n_bases > 0)"""
)


@query("intergenic_reallocate", _MOVES + " SELECT sample_id, cell_barcode, category, CAST(sum(n_reads) AS BIGINT) AS n_reads, CAST(sum(n_bases) AS BIGINT) AS n_bases FROM al GROUP BY 1, 2, 3")
def intergenic_reallocate(spark: SparkSession, d: str) -> DataFrame:
    """Counts after sparse reads moved to their loci's categories."""
    return _moved(spark, d, Q.counts(spark, d))


SQL["sequential_rounded_move"] = _MOVES + " SELECT sample_id, cell_barcode, category, n_reads, n_bases FROM mo WHERE n_reads > 0 OR n_bases > 0"


@query("sequential_rounded_move", SQL["sequential_rounded_move"])
def sequential_rounded_move(spark: SparkSession, d: str) -> DataFrame:
    """What each category was given."""
    c = materialise(Q.counts(spark, d), "counts")
    new = _moved(spark, d, c).where("category != 'intergenic_sparse'")
    k = [*S, "cell_barcode", "category"]
    j = new.join(c.select(*k, F.col("n_reads").alias("r0"), F.col("n_bases").alias("b0")), k, "left")
    out = j.select(*k, (F.col("n_reads") - F.coalesce("r0", F.lit(0))).alias("n_reads"), (F.col("n_bases") - F.coalesce("b0", F.lit(0))).alias("n_bases"))
    return out.where("n_reads > 0 OR n_bases > 0")


@query("top20_loci", RECORDS + f" SELECT {_PLACE}, n_reads, least(greatest(2 * n_barcodes + 4, 6), 24) AS size FROM dec ORDER BY n_reads DESC, sample_id, contig, start_pos, strand LIMIT 20")
def top20_loci(spark: SparkSession, d: str) -> DataFrame:
    """The loci with most reads (a top-k report)."""
    return V.top_loci(scored(spark, d), S).select(*_PLACE.split(", "), "n_reads", "size")


SQL["fig_top20_loci"], QUERIES["fig_top20_loci"] = SQL["top20_loci"], top20_loci

# --- comparison ---

_SIDES = Q.ONCE + ", tot AS (SELECT CASE WHEN sample_id < 'LB0000010' THEN 'a' ELSE 'b' END AS side, category, count(*) AS n_reads FROM once GROUP BY 1, 2)"
_CATS = ", ".join(f"'{c}'" for c in (*C.CATEGORY_ORDER, *C.DROPPED))
_CHI = (
    _SIDES
    + f""", cats AS (SELECT unnest([{_CATS}]) AS category), t AS (SELECT category, sum(CASE WHEN side = 'a' THEN n_reads ELSE 0 END) AS na, sum(CASE WHEN side = 'b' THEN n_reads ELSE 0 END) AS nb FROM tot GROUP BY 1),
w AS (SELECT CAST(sum(na) AS DOUBLE) AS ta, CAST(sum(nb) AS DOUBLE) AS tb FROM t),
f AS (SELECT category, coalesce(na, 0) / ta AS fa, coalesce(nb, 0) / tb AS fb, ta, tb FROM cats LEFT JOIN t USING (category), w),
o AS (SELECT *, trunc(ta * fa) AS oa, trunc(ta - ta * fa) AS ra, trunc(tb * fb) AS ob, trunc(tb - tb * fb) AS rb FROM f),
e AS (SELECT *, oa + ra + ob + rb AS n FROM o),
x AS (SELECT category, fa, fb, oa, ra, ob, rb, (oa + ra) * (oa + ob) / n AS e1, (oa + ra) * (ra + rb) / n AS e2, (ob + rb) * (oa + ob) / n AS e3, (ob + rb) * (ra + rb) / n AS e4 FROM e),
chi AS (SELECT category, fa AS frac_a, fb AS frac_b, fb - fa AS delta, CASE WHEN e1 > 0 AND e2 > 0 AND e3 > 0 AND e4 > 0 THEN power(abs(oa - e1) - least(0.5, abs(oa - e1)), 2) / e1 + power(abs(ra - e2) - least(0.5, abs(ra - e2)), 2) / e2 + power(abs(ob - e3) - least(0.5, abs(ob - e3)), 2) / e3 + power(abs(rb - e4) - least(0.5, abs(rb - e4)), 2) / e4 END AS chi2 FROM x)"""
)


def _sides(spark, d):
    return Q.once(spark, d).groupBy(F.when(F.col("sample_id") < "LB0000010", "a").otherwise("b").alias("side"), "category").agg(F.count(F.lit(1)).alias("n_reads"))


def _stats(spark, d):
    return P.chi2(_sides(spark, d), "side", "a", "b")


@query("chi2_compare", _CHI + " SELECT category, round(frac_a, 9) AS frac_a, round(frac_b, 9) AS frac_b, round(delta, 9) AS delta, round(chi2, 5) AS chi2 FROM chi")
def chi2_compare(spark: SparkSession, d: str) -> DataFrame:
    """Yates-corrected chi-squared per category between two halves of the libraries."""
    s = _stats(spark, d).select("category", "frac_a", "frac_b", "delta", F.round("chi2", 5).alias("chi2"))
    return s.select("category", *[F.round(c, 9).alias(c) for c in ("frac_a", "frac_b", "delta")], "chi2")


@query("chi2_pvalues")
def chi2_pvalues(spark: SparkSession, d: str) -> DataFrame:
    """The same with p-values, which have no SQL."""
    return _stats(spark, d)


SQL["fig_compare_bars"] = _CHI + " SELECT category, round(frac_a, 9) AS frac_a, round(frac_b, 9) AS frac_b FROM chi WHERE frac_a > 0.0005 OR frac_b > 0.0005"
QUERIES["fig_compare_bars"] = lambda spark, d: Q.rounded(V.compare_bars(_stats(spark, d)))
QUERIES["fig_delta_plot"] = lambda spark, d: Q.rounded(V.delta_plot(_stats(spark, d)))
_SCALARS = ["noise_read_frac", "noise_base_frac", "strand_concordance", "n_reads_classified"]
_SIDE_ROW = f"""s AS (SELECT sample_id, {Q._sum('n_reads', C.NOISE)} / sum(n_reads) AS noise_read_frac, coalesce({Q._sum('n_bases', C.NOISE)} / nullif(sum(n_bases), 0), 0) AS noise_base_frac, {Q._ES} / nullif({Q._ES} + {Q._EA}, 0) AS strand_concordance, CAST(sum(n_reads) AS DOUBLE) AS n_reads_classified FROM cnt WHERE sample_id IN ('LBX00000', 'LB0000001') GROUP BY 1),
u AS (SELECT sample_id, metric, v FROM s UNPIVOT (v FOR metric IN ({', '.join(_SCALARS)})))"""


@query("metrics_full_outer", Q.ONCE + f", {_SIDE_ROW}, p AS (SELECT metric, max(CASE WHEN sample_id = 'LBX00000' THEN v END) AS a, max(CASE WHEN sample_id = 'LB0000001' THEN v END) AS b FROM u GROUP BY 1) SELECT metric, round(a, 9) AS value_a, CASE WHEN metric <> 'noise_base_frac' THEN round(b, 9) END AS value_b, CASE WHEN metric <> 'noise_base_frac' THEN round(b - a, 9) END AS delta FROM p")
def metrics_full_outer(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of two libraries side by side; one metric is missing on one side."""
    m = M.long_metrics(Q.sample_row(spark, d).select(*S, *_SCALARS), S)
    a, b = m.where("sample_id = 'LBX00000'"), m.where("sample_id = 'LB0000001' AND metric != 'noise_base_frac'")
    return Q.rounded(P.metric_deltas(a, b))


SQL["key_union"] = Q.ONCE + f", {_SIDE_ROW} SELECT DISTINCT metric FROM u"
QUERIES["key_union"] = lambda spark, d: metrics_full_outer(spark, d).select("metric").distinct()

# --- evaluation over all libraries, a cell named by library and barcode; its true category is its most frequent one, by name on ties ---

_TRUTH = "truth AS (SELECT sample_id, cell_barcode, category AS true_category FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, cell_barcode ORDER BY n_reads DESC, category) AS rn FROM cnt) x WHERE rn = 1 AND cell_barcode <> '')"


def _key():
    return F.concat("sample_id", F.lit("/"), "cell_barcode")


def _cells(spark, d):
    return Q.cells(spark, d).where("cell_barcode != ''").withColumns({"plain": F.col("cell_barcode"), "cell_barcode": _key()}).where("cell_barcode IS NOT NULL")


def _truth(spark, d):
    c = Q.counts(spark, d).where("sample_id IS NOT NULL AND cell_barcode != ''")
    most = c.groupBy("sample_id", "cell_barcode").agg(F.min_by("category", F.struct(-F.col("n_reads"), "category")).alias("true_category"))
    return most.select(_key().alias("cell_barcode"), "true_category")


_MATRIX = Q.CELLS + f", {_TRUTH}, mat AS (SELECT true_category, {', '.join(f'CAST(sum(CAST(round_even(read_frac_{c} * n_reads, 0) AS BIGINT)) AS BIGINT) AS {c}' for c in C.CATEGORY_ORDER)} FROM cells JOIN truth USING (sample_id, cell_barcode) GROUP BY 1)"


@query("confusion_matrix", _MATRIX + " SELECT * FROM mat")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Assigned categories per true category."""
    return P.confusion_matrix(_cells(spark, d), _truth(spark, d))


_RIGHT = "CASE true_category " + " ".join(f"WHEN '{c}' THEN {c}" for c in C.CATEGORY_ORDER) + " ELSE 0 END"
_ALL = " + ".join(C.CATEGORY_ORDER)


@query("per_category_accuracy", _MATRIX + f" SELECT true_category, {_ALL} AS total_reads, {_RIGHT} AS correct_reads, round({_RIGHT} / CAST(({_ALL}) AS DOUBLE), 9) AS accuracy FROM mat")
def per_category_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Diagonal over row sum."""
    return Q.rounded(P.category_accuracy(confusion_matrix(spark, d)))


@query("noise_dose_response", Q.CELLS + " SELECT concat(sample_id, '/', cell_barcode) AS cell_barcode, n_reads, (ascii(cell_barcode) % 4) / 10.0 AS true_noise_frac, round(noise_read_frac, 9) AS reported_noise_frac, round(noise_read_frac - CAST((ascii(cell_barcode) % 4) / 10.0 AS DOUBLE), 9) AS delta_vs_true FROM cells WHERE cell_barcode <> ''")
def noise_dose_response(spark: SparkSession, d: str) -> DataFrame:
    """Reported against assumed noise."""
    c = _cells(spark, d)
    return Q.rounded(P.dose_response(c, c.select("cell_barcode", ((F.ascii("plain") % 4) / 10.0).alias("true_noise"))))


SQL["dose_sorted"], QUERIES["dose_sorted"] = SQL["noise_dose_response"], noise_dose_response


@query("artifact_flag_accuracy", Q.ONCE + f" SELECT concat(sample_id, '/', cell_barcode) AS cell_barcode, 'n_tso' AS flag, e.n AS expected_count, f.n_tso AS observed_count, f.n_polya AS other_flag_count, round(f.n_tso / CAST(e.n AS DOUBLE), 9) AS accuracy FROM ({Q._FLAG_SQL}) f JOIN (SELECT sample_id, cell_barcode, count(*) AS n FROM once GROUP BY 1, 2) e USING (sample_id, cell_barcode)")
def artifact_flag_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Observed over expected flags per cell."""
    truth = Q.once(spark, d).select(_key().alias("cell_barcode"), F.lit("n_tso").alias("flag"))
    return Q.rounded(P.flag_accuracy(Q._flags(spark, d).withColumn("cell_barcode", _key()), truth))


# --- figures ---

_TOTALS = Q.ONCE + f", tot AS ({Q.SQL['sample_totals'][len(Q.ONCE):]})"
_RANK = "list_position([" + ", ".join(f"'{c}'" for c in C.CATEGORY_ORDER) + "], category)"


def _totals(spark, d):
    return Q.rounded(M.sample_totals(Q.counts(spark, d), S))


@query("fig_noise_overview", _TOTALS + f" SELECT sample_id, category, read_frac, {_RANK} AS rank FROM tot WHERE category NOT IN ('exonic_sense', 'unassigned') AND read_frac > 0.0005")
def fig_noise_overview(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the categories but sense."""
    return V.noise_overview(_totals(spark, d), S)


@query("fig_fraction_bar", _TOTALS + f" SELECT sample_id, category, base_frac AS fraction, {_RANK} AS rank FROM tot WHERE base_frac > 0.0001")
def fig_fraction_bar(spark: SparkSession, d: str) -> DataFrame:
    """Base fractions."""
    return V.fraction_bar(_totals(spark, d), S, "base_frac")


@query("fig_length_stratified", f"SELECT sample_id, length_bin, category, fraction_of_bin, CAST(sum(count) OVER (PARTITION BY sample_id, length_bin) AS BIGINT) AS bin_total FROM ({Q._STRAT}) s")
def fig_length_stratified(spark: SparkSession, d: str) -> DataFrame:
    """Shares within length bins."""
    return V.stratified_shares(Q.length_stratification(spark, d), S)


@query("fig_cell_violin", Q.CELLS + " SELECT sample_id, cell_barcode, round(noise_read_frac, 9) AS noise_read_frac, count(*) OVER (PARTITION BY sample_id) <= 5000 AS points FROM cells")
def fig_cell_violin(spark: SparkSession, d: str) -> DataFrame:
    """Noise per cell."""
    return Q.rounded(V.violin(Q.cells(spark, d), S))


def _hist_sql(src: str, key: str, bins: int) -> str:
    return f"b AS (SELECT {key}, CAST(min(v) AS DOUBLE) AS low, CAST(max(v) AS DOUBLE) AS high, count(*) AS n FROM {src} GROUP BY {key}) SELECT {key}, CASE WHEN high > low THEN least({bins - 1}, CAST(floor((v - low) * {bins} / (high - low)) AS INT)) ELSE 0 END AS bin, count(*) AS count, round(count(*) * 100.0 / max(n), 6) AS percent FROM {src} JOIN b USING ({key}) GROUP BY 1, 2"


@query("fig_length_hist", Q.ONCE + ", v AS (SELECT category, read_length AS v FROM once WHERE read_length > 0), " + _hist_sql("v", "category", 50))
def fig_length_hist(spark: SparkSession, d: str) -> DataFrame:
    """Read lengths per category in 50 bins."""
    h = V.histogram(Q.once(spark, d).where("read_length > 0"), ["category"], "read_length", 50)
    return h.withColumn("percent", F.round(F.col("percent").cast("double"), 6))


SQL["fig_compare_lengths"] = Q.ONCE + ", v AS (SELECT CASE WHEN sample_id < 'LB0000010' THEN 'a' ELSE 'b' END AS side, read_length AS v FROM once WHERE read_length > 0 AND category = 'exonic_sense'), " + _hist_sql("v", "side", 60)


@query("fig_compare_lengths", SQL["fig_compare_lengths"])
def fig_compare_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Sense read lengths of two sides in 60 bins."""
    r = Q.once(spark, d).where("read_length > 0 AND category = 'exonic_sense'").withColumn("side", F.when(F.col("sample_id") < "LB0000010", "a").otherwise("b"))
    return V.histogram(r, ["side"], "read_length", 60).withColumn("percent", F.round(F.col("percent").cast("double"), 6))


@query("fig_compare_violin", Q.CELLS + " SELECT CASE WHEN sample_id < 'LB0000010' THEN 'a' ELSE 'b' END AS side, cell_barcode, sample_id, round(noise_read_frac, 9) AS noise_read_frac FROM cells")
def fig_compare_violin(spark: SparkSession, d: str) -> DataFrame:
    """Noise per cell of two sides."""
    c = Q.cells(spark, d).withColumn("side", F.when(F.col("sample_id") < "LB0000010", "a").otherwise("b"))
    return Q.rounded(c.select("side", "cell_barcode", "sample_id", "noise_read_frac"))


@query("fig_artifact_rates", Q.ONCE + f" SELECT sample_id, round(n_tso / CAST(n AS DOUBLE), 9) AS tso_rate, round(n_polya / CAST(n AS DOUBLE), 9) AS polya_rate, round(n_noncanon / CAST(n AS DOUBLE), 9) AS noncanon_rate FROM (SELECT sample_id, sum(n_tso) AS n_tso, sum(n_polya) AS n_polya, sum(n_noncanon) AS n_noncanon FROM ({Q._FLAG_SQL}) f GROUP BY 1) g JOIN (SELECT sample_id, count(*) AS n FROM once GROUP BY 1) t USING (sample_id)")
def fig_artifact_rates(spark: SparkSession, d: str) -> DataFrame:
    """Flags over reads."""
    return Q.rounded(V.artifact_rates(Q._flags(spark, d), _totals(spark, d), S))


_LEGEND = ", ".join(f"('{c}', {i + 1}, {str(c in C.NOISE).lower()}, {str(c in C.NOISE_STRICT).lower()}, {str(c in C.AMBIGUOUS_SET).lower()})" for i, c in enumerate(C.CATEGORY_ORDER))


@query("fig_category_legend", f"SELECT * FROM (VALUES {_LEGEND}) t(category, rank, is_noise, is_strict, is_ambiguous)")
def fig_category_legend(spark: SparkSession, d: str) -> DataFrame:
    """The table of categories."""
    return V.legend(spark)


@query("fig_cluster_bars", Q.CLUSTERS + " SELECT cluster, median_noise_read_frac, median_exonic_antisense_frac, median_intronic_pure_frac, median_chimeric_frac FROM cl")
def fig_cluster_bars(spark: SparkSession, d: str) -> DataFrame:
    """Components of noise per cluster."""
    return V.cluster_bars(Q.clusters(spark, d))


SQL["clusters_sorted"] = Q.CLUSTERS + " SELECT cluster, row_number() OVER (ORDER BY median_noise_read_frac DESC, cluster) AS place FROM cl"


@query("clusters_sorted", SQL["clusters_sorted"])
def clusters_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Clusters by noise; a window over a few rows."""
    from pyspark.sql import Window as W

    return V.cluster_bars(Q.clusters(spark, d)).select("cluster", F.row_number().over(W.orderBy(F.desc("median_noise_read_frac"), "cluster")).cast("long").alias("place"))


_MEDIANS = [f"median_{n}" for n in M.CLUSTER_COLUMNS.values()] + [f"median_{f[2:]}_rate" for f in M.FLAGS]


@query("fig_cluster_heatmap", Q.CLUSTERS + f" SELECT cluster, metric, value FROM (SELECT cluster, {', '.join(_MEDIANS)} FROM cl) x UNPIVOT (value FOR metric IN ({', '.join(_MEDIANS)}))")
def fig_cluster_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """All medians per cluster."""
    return V.cluster_heatmap(Q.clusters(spark, d))


@query("fig_insert_hist", duck("reads") + ", v AS (SELECT CASE WHEN strand = '+' THEN 'signal' ELSE 'noise' END AS panel, abs(tlen) AS v FROM reads WHERE flag & 2308 = 0 AND flag & 67 = 67 AND abs(tlen) > 0 AND abs(tlen) < 2000), " + _hist_sql("v", "panel", 100))
def fig_insert_hist(spark: SparkSession, d: str) -> DataFrame:
    """Insert sizes of two panels in 100 bins."""
    r = view(spark, d, "reads").where(R.is_primary() & R.is_insert()).select(F.when(F.col("strand") == "+", "signal").otherwise("noise").alias("panel"), F.abs("tlen").alias("v"))
    return V.histogram(r, ["panel"], "v", 100).withColumn("percent", F.round(F.col("percent").cast("double"), 6))
