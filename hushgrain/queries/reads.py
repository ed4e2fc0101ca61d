"""Queries over single reads: predicates, projections and the rule cascade."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrain import constants as C
from hushgrain.functions import reads as R
from hushgrain.operators import cascade, sequence
from hushgrain.plans import checks
from hushgrain.queries.common import table
from hushgrain.standins import CHUNK, duck, view
from hushgrain.storage import materialise

QUERIES, SQL = {}, {}


def per_read(name: str, expr, sql: str, column: str = "result", keep: str = "") -> None:
    """A query of one expression over every derived read."""
    QUERIES[name] = lambda spark, d: view(spark, d, "reads").select("read_id", *keep.split(), expr().alias(column))
    SQL[name] = duck("reads") + f" SELECT read_id, {keep + ',' if keep else ''} {sql} AS {column} FROM reads"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_CHIM_SA = f"""coalesce(len(list_filter(string_split(sa, ';'), lambda x: len(string_split(x, ',')) >= 3 AND TRY_CAST(string_split(x, ',')[2] AS BIGINT) IS NOT NULL
  AND (string_split(x, ',')[1] <> contig OR string_split(x, ',')[3] <> strand OR abs(TRY_CAST(string_split(x, ',')[2] AS BIGINT) - pos) > {C.CHIMERIC_DISTANCE}))) > 0, false)"""
_CHIM_PAIR = "coalesce(sa, '') = '' AND flag & 1 <> 0 AND (flag & 8 <> 0 OR coalesce(next_contig <> contig OR abs(tlen) > 1000000, false) AND next_contig IS NOT NULL)"
_LEAD, _TRAIL = "coalesce(TRY_CAST(regexp_extract(cigar, '^([0-9]+)S', 1) AS INT), 0)", "coalesce(TRY_CAST(regexp_extract(cigar, '[A-Z=]([0-9]+)S$', 1) AS INT), 0)"
_HIT = "(contains({0}, 'AAGCAGTGGTAT') OR contains({0}, 'GGGGGG'))"
_OPS = """, o AS (SELECT read_id, contig, strand, pos, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) AS op, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), 1) AS i FROM reads),
y AS (SELECT *, CAST(regexp_extract(op, '[0-9]+') AS BIGINT) AS n, right(op, 1) AS c FROM o),
z AS (SELECT *, pos + coalesce(CAST(sum(CASE WHEN c IN ('M', 'D', 'N', '=', 'X') THEN n ELSE 0 END) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS p FROM y)"""

per_read("filter_primary", R.is_primary, "flag & 2308 = 0")
per_read("extract_tags", lambda: F.coalesce("cb", F.lit("")), "coalesce(cb, '')", "cell_barcode", "umi")
per_read("is_multimapper", R.is_multimapper, "coalesce(nh > 1, false)")
per_read("is_mito", R.is_mito, "contig IN ('chrM', 'MT', 'chrMT', 'mitochondrion')")
per_read("is_chimeric_sa", R.is_chimeric_sa, _CHIM_SA)
per_read("is_chimeric_pair", R.is_chimeric_pair, _CHIM_PAIR)
per_read("is_tso_invasion", R.is_tso_invasion, f"{_HIT.format(f'upper(substr(seq, 1, {_LEAD}))')} OR {_HIT.format(f'upper(right(seq, {_TRAIL}))')}")
per_read("length_bin", lambda: R.length_bin("read_length"), "CASE WHEN read_length < 150 THEN 0 WHEN read_length < 500 THEN 1 WHEN read_length < 1000 THEN 2 WHEN read_length < 2000 THEN 3 WHEN read_length < 5000 THEN 4 ELSE 5 END", "bin")
per_read("insert_size_filter", R.is_insert, "flag & 67 = 67 AND abs(tlen) > 0 AND abs(tlen) < 2000")
per_read("reverse_complement", lambda: R.reverse_complement("seq"), "reverse(translate(seq, 'ACGTacgt', 'TGCAtgca'))", "rc")


@query("cigar_reference", duck("reads") + _OPS + " SELECT read_id, CAST(any_value(pos) + sum(CASE WHEN c IN ('M', 'D', 'N', '=', 'X') THEN n ELSE 0 END) AS BIGINT) AS ref_end, CAST(sum(CASE WHEN c IN ('M', 'I', '=', 'X') THEN n ELSE 0 END) AS BIGINT) AS aligned_length FROM z GROUP BY read_id")
def cigar_reference(spark: SparkSession, d: str) -> DataFrame:
    """End on the reference and aligned length."""
    return view(spark, d, "reads").select("read_id", R.ref_end().alias("ref_end"), R.aligned_length().alias("aligned_length"))


@query("junction_positions", duck("reads") + _OPS + " SELECT read_id, p AS junction FROM z WHERE c = 'N'")
def junction_positions(spark: SparkSession, d: str) -> DataFrame:
    """Starts of skipped regions on the reference."""
    return view(spark, d, "reads").select("read_id", F.explode(R.junctions()).alias("junction"))


@query("aligned_blocks", duck("reads") + _OPS + " SELECT read_id, row_number() OVER (PARTITION BY read_id ORDER BY i) - 1 AS block, p AS s, p + n AS e FROM z WHERE c IN ('M', '=', 'X')")
def aligned_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Gapless blocks, one per match operation."""
    b = view(spark, d, "reads").select("read_id", F.posexplode(R.blocks()).alias("block", "b"))
    return b.select("read_id", F.col("block").cast("long").alias("block"), "b.s", "b.e")


_ENDS = duck("reads") + _OPS + ", x AS (SELECT read_id, any_value(strand) AS strand, any_value(pos) AS pos, CAST(any_value(pos) + sum(CASE WHEN c IN ('M', 'D', 'N', '=', 'X') THEN n ELSE 0 END) AS BIGINT) AS e FROM z GROUP BY read_id)"


@query("read_ends", _ENDS + " SELECT read_id, CASE WHEN strand = '-' THEN pos ELSE e END AS three_prime, CASE WHEN strand = '-' THEN e ELSE pos END AS five_prime FROM x")
def read_ends(spark: SparkSession, d: str) -> DataFrame:
    """3' and 5' ends by strand."""
    r = view(spark, d, "reads").withColumn("ref_end", R.ref_end())
    return r.select("read_id", R.three_prime().alias("three_prime"), R.five_prime().alias("five_prime"))


_LISTED = "SELECT concat('CB', CAST(n_nationkey AS VARCHAR)) AS barcode FROM nation"


def _whitelist(spark, d):
    return table(spark, d, "nation").select(F.concat(F.lit("CB"), F.col("n_nationkey").cast("string")).alias("barcode"))


@query("barcode_validate", duck("reads") + f" SELECT read_id, coalesce(cb, '') AS cell_barcode, cb IS NULL OR cb NOT IN ({_LISTED}) AS is_unassigned FROM reads")
def barcode_validate(spark: SparkSession, d: str) -> DataFrame:
    """Barcodes against a whitelist."""
    return cascade.with_barcode(view(spark, d, "reads"), _whitelist(spark, d)).select("read_id", "cell_barcode", "is_unassigned")


@query("barcode_without_whitelist", duck("reads") + " SELECT read_id, coalesce(cb, 'NO_BARCODE') AS cell_barcode FROM reads")
def barcode_without_whitelist(spark: SparkSession, d: str) -> DataFrame:
    """Barcodes where there is no whitelist."""
    return cascade.with_barcode(view(spark, d, "reads")).select("read_id", "cell_barcode")


SQL["whitelist_join"] = duck("reads") + f" SELECT read_id FROM reads WHERE cb IN ({_LISTED})"
QUERIES["whitelist_join"] = lambda spark, d: cascade.with_barcode(view(spark, d, "reads"), _whitelist(spark, d)).where("NOT is_unassigned").select("read_id")

_CASCADE = f"CASE WHEN cb IS NULL OR cb NOT IN ({_LISTED}) THEN 'unassigned' WHEN coalesce(nh > 1, false) THEN 'multimapper' WHEN contig = 'chrM' THEN 'mitochondrial' WHEN {_CHIM_SA} OR ({_CHIM_PAIR}) THEN 'chimeric' ELSE 'undecided' END"


@query("rule_cascade", duck("reads") + f" SELECT read_id, coalesce(cb, '') AS cell_barcode, {_CASCADE} AS decided FROM reads WHERE flag & 2308 = 0")
def rule_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The category that the rules alone decide."""
    return cascade.decide(view(spark, d, "reads"), _whitelist(spark, d), paired=True).select("read_id", "cell_barcode", "decided")


_CALLED = "SELECT DISTINCT regexp_replace(upper(cb), '-1$', '') AS barcode FROM alignments WHERE cb <> '' AND ascii(upper(cb)) IN (65, 67)"


def _called(spark, d):
    a = table(spark, d, "alignments").where("cb != ''")
    return a.select(R.strip_suffix(F.upper("cb")).alias("barcode")).distinct().where(F.substring("barcode", 1, 1).isin("A", "C"))


@query("called_cell_filter", f"SELECT qname, piece_no, cb FROM alignments WHERE regexp_replace(cb, '-1$', '') IN ({_CALLED})")
def called_cell_filter(spark: SparkSession, d: str) -> DataFrame:
    """Alignments of called cells; the barcode keeps its spelling."""
    return cascade.called_cells(table(spark, d, "alignments"), _called(spark, d)).select("qname", "piece_no", "cb")


SQL["called_cell_join"] = f"SELECT regexp_replace(cb, '-1$', '') AS barcode, count(*) AS n FROM alignments WHERE regexp_replace(cb, '-1$', '') IN ({_CALLED}) GROUP BY 1"
QUERIES["called_cell_join"] = lambda spark, d: cascade.called_cells(table(spark, d, "alignments"), _called(spark, d)).groupBy(R.strip_suffix("cb").alias("barcode")).agg(F.count(F.lit(1)).alias("n"))


@query("read_counters", f"SELECT count(*) AS n_processed, count(*) FILTER (flag & 2308 <> 0) AS n_skipped, count(*) FILTER (flag & 2308 = 0 AND regexp_replace(coalesce(cb, ''), '-1$', '') NOT IN ({_CALLED})) AS n_skipped_not_called FROM alignments")
def read_counters(spark: SparkSession, d: str) -> DataFrame:
    """Reads processed and skipped."""
    return cascade.counters(table(spark, d, "alignments"), _called(spark, d))


@query("scan_index_counts", "SELECT contig, count(*) FILTER (flag & 4 = 0) AS n_mapped, count(*) FILTER (flag & 4 <> 0) AS n_unmapped FROM alignments GROUP BY contig")
def scan_index_counts(spark: SparkSession, d: str) -> DataFrame:
    """Mapped and unmapped reads per contig."""
    u = R.has_flag("flag", C.FLAG_UNMAPPED)
    return table(spark, d, "alignments").groupBy("contig").agg(F.count_if(~u).alias("n_mapped"), F.count_if(u).alias("n_unmapped"))


@query("idxstats_count", "SELECT count(*) FILTER (flag & 4 = 0) AS n_mapped FROM alignments")
def idxstats_count(spark: SparkSession, d: str) -> DataFrame:
    """Mapped reads of a file."""
    return table(spark, d, "alignments").agg(F.count_if(~R.has_flag("flag", C.FLAG_UNMAPPED)).alias("n_mapped"))


# --- the reference sequence ---


def _chunks(spark, d):
    """The derived sequence as a table, as a run has it."""
    return materialise(view(spark, d, "chunks"), "reference")


_AT = f"(pos_at // {CHUNK})"


def _fetch_sql(src: str, width: int) -> str:
    return f"""SELECT q.*, coalesce(substr(concat(a.seq, coalesce(b.seq, '')), CAST(pos_at % {CHUNK} AS INT) + 1, {width}), '') AS bases FROM ({src}) q
LEFT JOIN chunks a ON a.contig = q.contig AND a.chunk_id = {_AT} LEFT JOIN chunks b ON b.contig = q.contig AND b.chunk_id = {_AT} + 1"""


_P9 = _ENDS.replace("x AS (SELECT read_id,", "x AS (SELECT read_id, any_value(contig) AS contig,")


def _with_chunks(sql: str) -> str:
    return duck("reads", "chunks") + sql[len(duck("reads")) :]


@query("is_polya_priming", _with_chunks(_P9) + f", f AS ({_fetch_sql('SELECT read_id, contig, e AS pos_at FROM x', C.POLYA_WINDOW)}) SELECT read_id, contains(bases, 'AAAAAA') AS result FROM f")
def is_polya_priming(spark: SparkSession, d: str) -> DataFrame:
    """A run of A downstream of the read's reference end, on either strand."""
    r = view(spark, d, "reads").select("read_id", "contig", R.ref_end().alias("pos_at"))
    f = sequence.fetch(r, _chunks(spark, d), "contig", "pos_at", C.POLYA_WINDOW, CHUNK)
    return f.select("read_id", R.has_a_run("bases").alias("result"))


_JX = duck("reads", "chunks") + _OPS + ", j AS (SELECT read_id, contig, strand, p AS pos_at FROM z WHERE c = 'N')"
_DONOR = "CASE WHEN strand = '-' THEN reverse(translate(bases, 'ACGT', 'TGCA')) ELSE bases END"


@query("junction_canonical", _JX + f", f AS ({_fetch_sql('SELECT * FROM j', 2)}) SELECT read_id, pos_at AS junction, length(bases) < 2 OR {_DONOR} IN ('GT', 'GC', 'AT') AS is_canonical FROM f")
def junction_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Whether a junction's donor is canonical; it is where the sequence is unknown."""
    j = view(spark, d, "reads").select("read_id", "contig", "strand", F.explode(R.junctions()).alias("junction"))
    return sequence.with_donor(j, _chunks(spark, d), CHUNK).select("read_id", "junction", "is_canonical")


_SPLICE = "SELECT DISTINCT contig, strand, unnest([s, e]) AS junction FROM exons"


def _splice_sites(spark, d):
    return sequence.splice_sites(view(spark, d, "exons"))


def _junctions(spark, d):
    r = view(spark, d, "reads")
    # three more junctions on each annotated exon end, so that some are known
    more = view(spark, d, "exons").select(F.concat(F.lit("x"), "gene_id", F.lit("-"), F.col("e").cast("string")).alias("read_id"), "contig", "strand", F.col("e").alias("junction"))
    return r.select("read_id", "contig", "strand", F.explode(R.junctions()).alias("junction")).unionByName(more)


_JALL = duck("reads", "chunks", "exons") + _OPS + ", j AS (SELECT read_id, contig, strand, p AS junction FROM z WHERE c = 'N' UNION ALL SELECT concat('x', gene_id, '-', CAST(e AS VARCHAR)), contig, strand, e FROM exons)"


@query("junction_known", _JALL + f" SELECT read_id, j.junction, s.junction IS NOT NULL AS is_known FROM j LEFT JOIN ({_SPLICE}) s USING (contig, strand, junction)")
def junction_known(spark: SparkSession, d: str) -> DataFrame:
    """Whether a junction starts at an annotated splice site of its strand."""
    return sequence.with_known(_junctions(spark, d), _splice_sites(spark, d)).select("read_id", "junction", "is_known")


@query("splice_site_join", _JALL + f" SELECT read_id, junction FROM j WHERE NOT EXISTS (SELECT 1 FROM ({_SPLICE}) s WHERE s.contig = j.contig AND s.strand = j.strand AND s.junction = j.junction)")
def splice_site_join(spark: SparkSession, d: str) -> DataFrame:
    """Junctions at no annotated splice site."""
    return sequence.with_known(_junctions(spark, d), _splice_sites(spark, d)).where("NOT is_known").select("read_id", "junction")


@query(
    "has_noncanon",
    _JALL
    + f", k AS (SELECT j.*, s.junction IS NOT NULL AS is_known FROM j LEFT JOIN ({_SPLICE}) s USING (contig, strand, junction)), f AS ({_fetch_sql('SELECT *, junction AS pos_at FROM k', 2)}) SELECT read_id, bool_or(NOT is_known AND NOT (length(bases) < 2 OR {_DONOR} IN ('GT', 'GC', 'AT'))) AS result FROM f GROUP BY read_id",
)
def has_noncanon(spark: SparkSession, d: str) -> DataFrame:
    """Whether a read has an unknown junction with a non-canonical donor."""
    j = sequence.with_known(_junctions(spark, d), _splice_sites(spark, d))
    return sequence.with_donor(j, _chunks(spark, d), CHUNK).groupBy("read_id").agg(F.bool_or(~F.col("is_known") & ~F.col("is_canonical")).alias("result"))


@query("fasta_lookup", duck("sites", "chunks") + f" SELECT contig, pos_at, bases FROM ({_fetch_sql('SELECT DISTINCT contig, pos AS pos_at FROM sites', 30)}) f")
def fasta_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The 30 bases from each site on."""
    s = view(spark, d, "sites").select("contig", F.col("pos").alias("pos_at")).distinct()
    return sequence.fetch(s, _chunks(spark, d), "contig", "pos_at", 30, CHUNK).select("contig", "pos_at", "bases")


# --- contigs ---


@query("contig_select", "SELECT contig, contig_length, rank() OVER (ORDER BY is_mito, contig_length DESC, contig) AS read_order FROM (SELECT contig, contig_length, contig IN ('chrM', 'MT', 'chrMT', 'mitochondrion') AS is_mito FROM contigs) c WHERE is_mito OR contig_length >= 1000000")
def contig_select(spark: SparkSession, d: str) -> DataFrame:
    """The contigs that are read, longest first, mitochondrial last."""
    return sequence.select_contigs(table(spark, d, "contigs"))


SQL["contigs_by_length_desc"] = "SELECT contig, contig_length, row_number() OVER (ORDER BY contig_length DESC, contig) AS n FROM contigs WHERE contig_length >= 1000000"


@query("contigs_by_length_desc", SQL["contigs_by_length_desc"])
def contigs_by_length_desc(spark: SparkSession, d: str) -> DataFrame:
    """Main contigs by length."""
    s = sequence.select_contigs(table(spark, d, "contigs")).where(~R.is_mito())
    return s.select("contig", "contig_length", F.col("read_order").alias("n"))


_STYLE = "CASE WHEN count(*) FILTER (starts_with({0}, 'chr')) > count(*) FILTER (NOT starts_with({0}, 'chr') AND regexp_matches({0}, '^([0-9]+|X|Y|MT)$')) THEN 'ucsc' WHEN count(*) FILTER (starts_with({0}, 'chr')) < count(*) FILTER (NOT starts_with({0}, 'chr') AND regexp_matches({0}, '^([0-9]+|X|Y|MT)$')) THEN 'ensembl' ELSE 'unknown' END"


@query("chrom_style", f"SELECT sample_id, {_STYLE.format('contig')} AS style FROM (SELECT DISTINCT sample_id, contig FROM alignments) a GROUP BY sample_id")
def chrom_style(spark: SparkSession, d: str) -> DataFrame:
    """The naming style that most of a library's contigs have."""
    names = table(spark, d, "alignments").select("sample_id", "contig").distinct()
    return names.groupBy("sample_id").agg(sequence.style_vote("contig").alias("style"))


@query("strip_chr", "SELECT CASE WHEN starts_with(contig, 'chr') THEN substr(contig, 4) ELSE contig END AS contig, contig_length FROM contigs")
def strip_chr(spark: SparkSession, d: str) -> DataFrame:
    """Contig names for an aligner without the prefix."""
    return table(spark, d, "contigs").select(sequence.strip_chr("contig").alias("contig"), "contig_length")


@query("validate_naming", f"SELECT a.sample_id, a.style, b.style AS annotation_style, a.style <> b.style AND a.style <> 'unknown' AND b.style <> 'unknown' AS is_fatal FROM ({SQL['chrom_style']}) a CROSS JOIN (SELECT {_STYLE.format('contig')} AS style FROM contigs) b")
def validate_naming(spark: SparkSession, d: str) -> DataFrame:
    """Whether a library's names clash with the annotation's."""
    one = table(spark, d, "contigs").agg(sequence.style_vote("contig").alias("annotation_style"))  # one row
    fatal = (F.col("style") != F.col("annotation_style")) & (F.col("style") != "unknown") & (F.col("annotation_style") != "unknown")
    return chrom_style(spark, d).join(F.broadcast(one)).withColumn("is_fatal", fatal)


@query("validate_lengths", "SELECT contig, contig_length, other, abs(contig_length - other) AS difference FROM (SELECT contig, contig_length, contig_length + CASE WHEN contig_length % 3 = 0 THEN 2000000 ELSE 10 END AS other FROM contigs) c WHERE abs(contig_length - other) > 1000000 ORDER BY contig LIMIT 3")
def validate_lengths(spark: SparkSession, d: str) -> DataFrame:
    """The first three contigs whose lengths differ by more than a megabase between header and reference."""
    c = table(spark, d, "contigs").withColumn("other", F.col("contig_length") + F.when(F.col("contig_length") % 3 == 0, 2_000_000).otherwise(10))
    return sequence.length_differences(c, "contig_length", "other")


@query("version_gap_warning", "SELECT n_nationkey + 30 AS a, n_regionkey + 40 AS b, abs(n_nationkey + 30 - n_regionkey - 40) > 5 AS warns FROM nation")
def version_gap_warning(spark: SparkSession, d: str) -> DataFrame:
    """Whether a run warns of two releases that lie too far apart."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect()  # a pair of releases each
    return spark.createDataFrame([(r.n_nationkey + 30, r.n_regionkey + 40, bool(checks.version_gap(r.n_nationkey + 30, r.n_regionkey + 40))) for r in rows], "a int, b int, warns boolean")


@query("sample_reads_for_tags", "SELECT sample_id, count(*) AS n_sampled, avg(CASE WHEN cb <> '' THEN 1.0 ELSE 0.0 END) AS fraction, avg(CASE WHEN cb <> '' THEN 1.0 ELSE 0.0 END) >= 0.5 AS barcode_aware FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY piece_no, arrived_at, qname, coalesce(cb, '')) AS rn FROM alignments WHERE flag & 2308 = 0) a WHERE rn <= 10000 GROUP BY sample_id")
def sample_reads_for_tags(spark: SparkSession, d: str) -> DataFrame:
    """The share of the first 10,000 primary reads of each library that have a barcode (a sampling operator)."""
    a = table(spark, d, "alignments").where(R.is_primary())
    return sequence.first_reads(a, ["sample_id"], ["piece_no", "arrived_at", "qname", F.coalesce("cb", F.lit(""))], 10_000).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_sampled"), F.avg(F.when(F.col("cb") != "", 1.0).otherwise(0.0)).alias("fraction")).withColumn("barcode_aware", F.col("fraction") >= 0.5)


SQL["first_n_reads"] = "SELECT qname, piece_no FROM alignments WHERE flag & 2308 = 0 ORDER BY piece_no, arrived_at, qname LIMIT 1000"


@query("first_n_reads", SQL["first_n_reads"])
def first_n_reads(spark: SparkSession, d: str) -> DataFrame:
    """The first 1,000 primary reads (a top-k report)."""
    return table(spark, d, "alignments").where(R.is_primary()).orderBy("piece_no", "arrived_at", "qname").select("qname", "piece_no").limit(1000)


@query("paired_end_detect", duck("reads") + " SELECT avg(flag & 1) > 0.5 AS paired_end FROM (SELECT flag FROM reads WHERE flag & 2308 = 0 ORDER BY read_id LIMIT 1000) r")
def paired_end_detect(spark: SparkSession, d: str) -> DataFrame:
    """Whether most of the first 1,000 primary reads are paired (a sampling operator)."""
    r = view(spark, d, "reads").where(R.is_primary()).orderBy("read_id").limit(1000)
    return r.agg((F.avg(R.has_flag("flag", C.FLAG_PAIRED).cast("int")) > 0.5).alias("paired_end"))
