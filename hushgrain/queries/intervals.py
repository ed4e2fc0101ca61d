"""Queries of the interval algebra, the annotation layers and the classification by intervals."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrain import constants as C
from hushgrain.functions import reads as R
from hushgrain.operators import annotation as A
from hushgrain.operators import classify, sequence
from hushgrain.operators import intervals as I
from hushgrain.operators import metrics as M
from hushgrain.queries import reads as Q
from hushgrain.queries.common import table
from hushgrain.standins import CHUNK, duck, view

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def sql_islands(src: str, keys: str, gap: int = 0, more: str = "") -> str:
    return f"""SELECT {keys}, min(s) AS s, max(e) AS e{more} FROM (SELECT *, sum(n_) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g_ FROM
(SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS n_ FROM {src} q WHERE s < e) a) b GROUP BY {keys}, g_"""


def sql_subtract(rows: str, merged: str, ident: str, on: str) -> str:
    """Rows without merged intervals, as a SELECT."""
    match = " AND ".join(f"r.{c} = m.{c}" for c in on.split(", "))
    rid = ", ".join(f"r.{c}" for c in ident.split(", "))
    return f"""SELECT {ident}, s1 AS s, e1 AS e FROM (
SELECT {ident}, coalesce(lag(ce) OVER (PARTITION BY {ident}, s, e ORDER BY cs), s) AS s1, cs AS e1 FROM (SELECT {rid}, r.s, r.e, greatest(r.s, m.s) AS cs, least(r.e, m.e) AS ce FROM {rows} r JOIN {merged} m ON {match} AND m.s < r.e AND m.e > r.s) c
UNION ALL SELECT {ident}, max(ce), e FROM (SELECT {rid}, r.s, r.e, least(r.e, m.e) AS ce FROM {rows} r JOIN {merged} m ON {match} AND m.s < r.e AND m.e > r.s) c GROUP BY {ident}, s, e
UNION ALL SELECT {rid}, r.s, r.e FROM {rows} r WHERE NOT EXISTS (SELECT 1 FROM {merged} m WHERE {match} AND m.s < r.e AND m.e > r.s)) u WHERE s1 < e1"""


# the layers as common table expressions
_LAYERS = (
    duck("reads", "exons", "repeats", "sites", "chunks")
    + f""", exon_u AS ({sql_islands("exons", "contig, strand, gene_id, biotype")}),
merged_ AS ({sql_islands("exons", "contig, strand")}),
intron_ AS ({sql_subtract("genes", "merged_", "contig, strand, gene_id, biotype", "contig, strand")}),
pair_ AS (SELECT a.contig, a.strand, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e, a.gene_id AS gene_id_a, b.gene_id AS gene_id_b, a.biotype AS biotype_a, b.biotype AS biotype_b FROM exon_u a JOIN exon_u b ON a.contig = b.contig AND a.strand = b.strand AND a.gene_id < b.gene_id AND a.s < b.e AND b.s < a.e),
typed_ AS (SELECT *, CASE WHEN biotype_a = 'protein_coding' AND biotype_b = 'protein_coding' THEN 'cod_cod' WHEN biotype_a = 'protein_coding' OR biotype_b = 'protein_coding' THEN 'cod_ncod' ELSE 'ncod_ncod' END AS overlap_type FROM pair_),
shared_ AS ({sql_islands("(SELECT CASE WHEN overlap_type = 'cod_cod' THEN 'shared_cod_cod' ELSE 'shared_cod_ncod' END AS layer, contig, strand, s, e FROM typed_)", "layer, contig, strand")}),
sharedm_ AS ({sql_islands("shared_", "contig, strand")}),
body_ AS ({sql_islands("genes", "contig")}),
gap_ AS (SELECT contig, b AS s, s AS e FROM (SELECT contig, s, coalesce(lag(e) OVER (PARTITION BY contig ORDER BY s), 0) AS b FROM body_) x WHERE s > b),
layers_ AS (SELECT contig, s, e, 'exon' AS layer, strand AS ls FROM exon_u UNION ALL SELECT contig, s, e, 'intron', strand FROM intron_ UNION ALL SELECT contig, s, e, layer, NULL FROM shared_)"""
)


def _index(spark, d):
    genes, exons = view(spark, d, "genes"), view(spark, d, "exons")
    return A.build(genes, exons)


def layer(name: str, part: str, cols: str, sql: str, doc: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _index(spark, d)[part].select(*cols.split(", "))

    run.__doc__ = doc
    QUERIES[name], SQL[name] = run, _LAYERS + f" SELECT {cols} FROM {sql}"


layer("exon_union_per_gene", "exons", "contig, strand, gene_id, biotype, s, e", "exon_u", "Exons merged within genes.")
layer("gene_bodies", "genes", "contig, strand, gene_id, biotype, s, e", "genes", "Distinct genes.")
layer("introns", "introns", "contig, strand, gene_id, biotype, s, e", "intron_", "Genes without any exon of their strand.")
layer("shared_regions", "shared", "layer, contig, strand, s, e", "shared_", "Where genes of a strand overlap.")
layer("unique_regions", "unique", "contig, strand, gene_id, biotype, s, e", "(" + sql_subtract("exon_u", "sharedm_", "contig, strand, gene_id, biotype", "contig, strand") + ") u", "Exons without shared regions.")
layer("complement", "intergenic", "contig, s, e", "gap_", "Gaps between genes.")
layer("splice_sites", "splice_sites", "contig, strand, junction", "(SELECT DISTINCT contig, strand, unnest([s, e]) AS junction FROM exons) x", "Both ends of every exon.")


@query("intergenic_bases", _LAYERS + " SELECT CAST(sum(e - s) AS BIGINT) AS intergenic_bases FROM gap_")
def intergenic_bases(spark: SparkSession, d: str) -> DataFrame:
    """Bases between genes."""
    return A.intergenic_bases(_index(spark, d)["intergenic"])


@query("build_index", _LAYERS + " SELECT layer, contig, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS bases FROM layers_ GROUP BY layer, contig")
def build_index(spark: SparkSession, d: str) -> DataFrame:
    """Rows and bases of each layer that the classification joins."""
    return A.tagged(_index(spark, d)).groupBy("layer", "contig").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e") - F.col("s")).alias("bases"))


@query("self_overlap", _LAYERS + " SELECT contig, strand, s, e, gene_id_a, gene_id_b FROM pair_")
def self_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Where exon unions of two genes of a strand overlap."""
    return I.self_overlap(A.exon_unions(view(spark, d, "exons")), ["contig", "strand"], "gene_id").select("contig", "strand", "s", "e", "gene_id_a", "gene_id_b")


QUERIES["interval_self_join"] = lambda spark, d: self_overlap(spark, d).groupBy("gene_id_a", "gene_id_b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e") - F.col("s")).alias("bases"))
SQL["interval_self_join"] = _LAYERS + " SELECT gene_id_a, gene_id_b, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS bases FROM pair_ GROUP BY 1, 2"


@query("overlap_type", _LAYERS + " SELECT gene_id_a, gene_id_b, overlap_type FROM typed_")
def overlap_type(spark: SparkSession, d: str) -> DataFrame:
    """The class of each overlap of two genes."""
    p = I.self_overlap(A.exon_unions(view(spark, d, "exons")), ["contig", "strand"], "gene_id")
    return p.select("gene_id_a", "gene_id_b", A.overlap_type().alias("overlap_type"))


@query("biotype_filter", _LAYERS + " SELECT gene_id, biotype, s, e FROM exons WHERE biotype NOT IN ('lncRNA')")
def biotype_filter(spark: SparkSession, d: str) -> DataFrame:
    """Exons without those of excluded biotypes."""
    return A.drop_biotypes(view(spark, d, "exons"), ["lncRNA"]).select("gene_id", "biotype", "s", "e")


@query("drop_mito_annotation", _LAYERS + " SELECT gene_id, contig FROM genes WHERE contig NOT IN ('chrM', 'MT', 'chrMT', 'mitochondrion')")
def drop_mito_annotation(spark: SparkSession, d: str) -> DataFrame:
    """Genes off the mitochondrial contig."""
    return A.drop_mito(view(spark, d, "genes")).select("gene_id", "contig")


_SORTED = "SELECT contig, gene_id, s, e, max(e) OVER (PARTITION BY contig ORDER BY s, e) AS max_end FROM exon_u"
SQL["sorted_lookup"] = SQL["prefix_max"] = _LAYERS + " " + _SORTED
QUERIES["sorted_lookup"] = QUERIES["prefix_max"] = lambda spark, d: I.running_max(A.exon_unions(view(spark, d, "exons")), ["contig"]).select("contig", "gene_id", "s", "e", "max_end")

SQL["merge_islands"] = _LAYERS + " SELECT contig, strand, s, e FROM merged_"
QUERIES["merge_islands"] = lambda spark, d: I.islands(view(spark, d, "exons"), ["contig", "strand"]).select("contig", "strand", "s", "e")
SQL["gap_lag"] = _LAYERS + " SELECT contig, strand, b AS s, s AS e FROM (SELECT contig, strand, s, coalesce(lag(e) OVER (PARTITION BY contig, strand ORDER BY s), 0) AS b FROM merged_) x WHERE s > b"
QUERIES["gap_lag"] = lambda spark, d: I.complement(view(spark, d, "exons"), ["contig", "strand"]).select("contig", "strand", "s", "e")
SQL["union_strands"] = _LAYERS + " SELECT * FROM (" + sql_islands("(SELECT contig, s, e FROM exons WHERE strand = '+' UNION ALL SELECT contig, s, e FROM exons WHERE strand = '-')", "contig") + ") u"


@query("union_strands", SQL["union_strands"])
def union_strands(spark: SparkSession, d: str) -> DataFrame:
    """Exons of both strands, merged."""
    x = view(spark, d, "exons")
    both = x.where("strand = '+'").select("contig", "s", "e").unionByName(x.where("strand = '-'").select("contig", "s", "e"))
    return I.islands(both, ["contig"])


@query("drop_duplicates", _LAYERS + " SELECT DISTINCT contig, s, e FROM (SELECT contig, s, e FROM exons UNION ALL SELECT contig, s, e FROM exons) x")
def drop_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Interval rows, each once."""
    x = view(spark, d, "exons").select("contig", "s", "e")
    return x.unionByName(x).dropDuplicates()


@query("union_sites", duck("sites", "repeats") + " SELECT contig, pos FROM sites UNION SELECT contig, (s + e) // 2 FROM repeats")
def union_sites(spark: SparkSession, d: str) -> DataFrame:
    """Sites of two lists, each once."""
    r = view(spark, d, "repeats").select("contig", F.expr("(s + e) div 2").alias("pos"))
    return view(spark, d, "sites").unionByName(r).distinct()


@query("sites_sorted_distinct", duck("sites") + " SELECT contig, list_sort(list(DISTINCT pos)) AS positions FROM sites GROUP BY contig")
def sites_sorted_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Each contig's sites in order."""
    return view(spark, d, "sites").groupBy("contig").agg(F.sort_array(F.collect_set("pos")).alias("positions"))


# --- range joins ---

_READ_IV = "SELECT read_id, contig, pos AS s, pos + read_length AS e FROM reads"


def _read_intervals(spark, d):
    return view(spark, d, "reads").select("read_id", "contig", F.col("pos").alias("s"), (F.col("pos") + F.col("read_length")).alias("e"))


@query("overlap_count_join", _LAYERS + f" SELECT r.read_id, CAST(sum(CASE WHEN x.s IS NULL THEN 0 ELSE least(r.e, x.e) - greatest(r.s, x.s) END) AS BIGINT) AS bases FROM ({_READ_IV}) r LEFT JOIN exon_u x ON x.contig = r.contig AND x.s < r.e AND x.e > r.s GROUP BY r.read_id")
def overlap_count_join(spark: SparkSession, d: str) -> DataFrame:
    """Bases of each read over exons, multiplicity kept."""
    return I.overlap_bases(_read_intervals(spark, d), A.exon_unions(view(spark, d, "exons")).select("contig", "s", "e"), ["read_id"], ["contig"])


@query("overlap_exists_join", _LAYERS + f" SELECT read_id FROM ({_READ_IV}) r WHERE EXISTS (SELECT 1 FROM exon_u x WHERE x.contig = r.contig AND x.s < r.e AND x.e > r.s)")
def overlap_exists_join(spark: SparkSession, d: str) -> DataFrame:
    """Reads over any exon."""
    return I.overlapping(_read_intervals(spark, d), view(spark, d, "exons").select("contig", "s", "e"), ["contig"]).select("read_id")


@query("repeat_overlap", _LAYERS + " SELECT contig, s, e FROM gap_ g WHERE EXISTS (SELECT 1 FROM repeats x WHERE x.contig = g.contig AND x.s < g.e AND x.e > g.s)")
def repeat_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Intergenic gaps that hold a repeat."""
    return I.overlapping(_index(spark, d)["intergenic"], view(spark, d, "repeats"), ["contig"]).select("contig", "s", "e")


@query("nearest_within", _LAYERS + " SELECT read_id, EXISTS (SELECT 1 FROM sites x WHERE x.contig = r.contig AND x.pos BETWEEN r.pos - 50 AND r.pos + 50) AS is_near FROM reads r")
def nearest_within(spark: SparkSession, d: str) -> DataFrame:
    """Whether a site lies within 50 bases of a read's start."""
    return I.near(view(spark, d, "reads"), view(spark, d, "sites"), ["contig"], "pos", C.POLYA_SITE_DISTANCE).select("read_id", "is_near")


# --- classification ---

_REST = f", rest_ AS (SELECT * FROM reads WHERE flag & 2308 = 0 AND {Q._CASCADE} = 'undecided')"
_BLOCKS = (
    _REST
    + """, ro AS (SELECT read_id, contig, strand, pos, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) AS op, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), 1) AS i FROM rest_),
ry AS (SELECT *, CAST(regexp_extract(op, '[0-9]+') AS BIGINT) AS n, right(op, 1) AS c FROM ro),
rz AS (SELECT *, pos + coalesce(CAST(sum(CASE WHEN c IN ('M', 'D', 'N', '=', 'X') THEN n ELSE 0 END) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS p FROM ry),
blk AS (SELECT read_id, contig, strand, row_number() OVER (PARTITION BY read_id ORDER BY i) - 1 AS block, p AS s, p + n AS e FROM rz WHERE c IN ('M', '=', 'X')),
nj AS (SELECT read_id, count(*) FILTER (c = 'N') AS n_junctions FROM rz GROUP BY read_id),
hit AS (SELECT b.read_id, b.block, b.s, b.e, b.strand, l.layer, l.ls, CASE WHEN l.s IS NULL THEN 0 ELSE least(b.e, l.e) - greatest(b.s, l.s) END AS o FROM blk b LEFT JOIN layers_ l ON l.contig = b.contig AND l.s < b.e AND l.e > b.s),
bb AS (SELECT read_id, block, s, e, sum(CASE WHEN layer = 'shared_cod_cod' THEN o ELSE 0 END) AS cc, sum(CASE WHEN layer = 'shared_cod_ncod' THEN o ELSE 0 END) AS cn, sum(CASE WHEN layer = 'exon' AND ls = strand THEN o ELSE 0 END) AS n_sense,
  sum(CASE WHEN layer = 'exon' AND ls <> strand THEN o ELSE 0 END) AS n_anti, sum(CASE WHEN layer = 'intron' THEN o ELSE 0 END) AS intronic FROM hit GROUP BY 1, 2, 3, 4),
t1 AS (SELECT *, cc + cn AS sh, e - s - cc - cn AS r0 FROM bb),
t2 AS (SELECT *, CASE WHEN r0 > 0 THEN greatest(0, n_sense - sh) ELSE 0 END AS es FROM t1),
t3 AS (SELECT *, r0 - es AS r1, CASE WHEN r0 > 0 AND r0 - es > 0 THEN greatest(0, n_anti - sh) ELSE 0 END AS ea FROM t2),
t4 AS (SELECT *, r1 - ea AS r2, CASE WHEN r0 > 0 AND r1 > 0 AND r1 - ea > 0 THEN least(r1 - ea, greatest(0, intronic - sh)) ELSE 0 END AS inn FROM t3),
t5 AS (SELECT *, CASE WHEN r0 > 0 AND r1 > 0 AND r2 > 0 THEN r2 - inn ELSE 0 END AS ig FROM t4),
lng AS (SELECT read_id, block, 'ambiguous_cod_cod' AS category, cc AS bases, 0 AS k FROM t5 UNION ALL SELECT read_id, block, 'ambiguous_cod_ncod', cn, 1 FROM t5 UNION ALL SELECT read_id, block, 'exonic_sense', es, 2 FROM t5
  UNION ALL SELECT read_id, block, 'exonic_antisense', ea, 3 FROM t5 UNION ALL SELECT read_id, block, 'intronic_pure', inn, 4 FROM t5 UNION ALL SELECT read_id, block, 'intergenic_sparse', ig, 5 FROM t5),
tal AS (SELECT read_id, category, CAST(sum(bases) AS BIGINT) AS bases, min(block * 10 + k) AS first_ FROM lng WHERE bases > 0 GROUP BY 1, 2),
ren AS (SELECT t.read_id, CASE WHEN category = 'intronic_pure' AND n_junctions > 0 THEN 'intronic_jxnspan' WHEN category = 'intronic_pure' AND s.read_id IS NOT NULL THEN 'intronic_boundary' ELSE category END AS category, bases,
  CASE WHEN category = 'intronic_pure' AND (n_junctions > 0 OR s.read_id IS NOT NULL) THEN 1000000000 ELSE first_ END AS first_ FROM tal t JOIN nj USING (read_id) LEFT JOIN (SELECT read_id FROM tal WHERE category = 'exonic_sense') s ON s.read_id = t.read_id),
al AS (SELECT read_id, CAST(sum(CASE WHEN right(op, 1) IN ('M', 'I', '=', 'X') THEN CAST(regexp_extract(op, '[0-9]+') AS BIGINT) ELSE 0 END) AS BIGINT) AS al FROM (SELECT read_id, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) AS op FROM reads) z GROUP BY 1),
bas AS (SELECT read_id, category, bases, first_ FROM ren UNION ALL SELECT r.read_id, 'ambiguous', al, 0 FROM rest_ r JOIN al USING (read_id) WHERE r.read_id NOT IN (SELECT read_id FROM ren)),
win AS (SELECT read_id, category FROM (SELECT read_id, category, row_number() OVER (PARTITION BY read_id ORDER BY bases DESC, first_) AS rn FROM bas) x WHERE rn = 1)"""
)
_CLASSIFIED = _BLOCKS + f", cls AS (SELECT r.read_id, coalesce(cb, '') AS cell_barcode, umi, coalesce(w.category, {Q._CASCADE}) AS category, al AS read_length FROM reads r JOIN al USING (read_id) LEFT JOIN win w ON w.read_id = r.read_id WHERE flag & 2308 = 0)"
CLASSIFIED_SQL = _LAYERS + _CLASSIFIED
_ALL_BASES = ", allb AS (SELECT read_id, category, bases FROM bas UNION ALL SELECT read_id, category, read_length FROM cls WHERE read_id NOT IN (SELECT read_id FROM rest_))"


def classified(spark: SparkSession, d: str, flags: bool = False) -> DataFrame:
    """All primary reads of the derived tables with category and bases, and with ``flags`` those that need the sequence."""
    index = _index(spark, d)
    return classify.classify(view(spark, d, "reads"), A.tagged(index), Q._whitelist(spark, d), True, index["splice_sites"] if flags else None, Q._chunks(spark, d) if flags else None, CHUNK)


def _blocks(spark, d):
    from hushgrain.operators import cascade

    r = cascade.decide(view(spark, d, "reads"), Q._whitelist(spark, d), True).where("decided = 'undecided'")
    return r.select("read_id", "contig", "strand", F.posexplode(R.blocks()).alias("block", "b")).select("read_id", "contig", "strand", "block", "b.s", "b.e")


@query("strand_layers", CLASSIFIED_SQL + " SELECT read_id, block, s, e, CAST(cc AS BIGINT) AS cc, CAST(cn AS BIGINT) AS cn, CAST(n_sense AS BIGINT) AS n_sense, CAST(n_anti AS BIGINT) AS n_anti, CAST(intronic AS BIGINT) AS intronic FROM bb")
def strand_layers(spark: SparkSession, d: str) -> DataFrame:
    """Each block's bases per layer relative to the read's strand."""
    return classify.block_bases(_blocks(spark, d), A.tagged(_index(spark, d))).withColumn("block", F.col("block").cast("long"))


@query("block_tally", CLASSIFIED_SQL + " SELECT read_id, category, bases FROM tal")
def block_tally(spark: SparkSession, d: str) -> DataFrame:
    """Each undecided read's bases per category before promotion."""
    return classify.tally(classify.block_bases(_blocks(spark, d), A.tagged(_index(spark, d)))).select("read_id", "category", "bases")


SQL["add_bases"] = CLASSIFIED_SQL + " SELECT category, count(*) AS n_reads, CAST(sum(bases) AS BIGINT) AS bases FROM tal GROUP BY category"
QUERIES["add_bases"] = lambda spark, d: block_tally(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n_reads"), F.sum("bases").alias("bases"))


@query("plurality_vote", CLASSIFIED_SQL + " SELECT read_id, cell_barcode, category, read_length FROM cls")
def plurality_vote(spark: SparkSession, d: str) -> DataFrame:
    """The category of every primary read."""
    return classified(spark, d).select("read_id", "cell_barcode", "category", "read_length")


@query("make_result", CLASSIFIED_SQL + _ALL_BASES + " SELECT c.read_id, c.cell_barcode, c.umi, c.category, c.read_length, b.category AS base_category, b.bases FROM cls c JOIN allb b USING (read_id)")
def make_result(spark: SparkSession, d: str) -> DataFrame:
    """The full result of every read, one row per base category."""
    return classified(spark, d).select("read_id", "cell_barcode", "umi", "category", "read_length", F.explode("base_counts").alias("base_category", "bases"))


def _promoted(name: str, category: str) -> None:
    SQL[name] = CLASSIFIED_SQL + f" SELECT read_id, bases FROM bas WHERE category = '{category}'"

    def run(spark: SparkSession, d: str) -> DataFrame:
        b = classified(spark, d).select("read_id", F.explode("base_counts").alias("base_category", "bases"))
        return b.where(F.col("base_category") == category).select("read_id", "bases")

    run.__doc__ = f"Bases that are {category} after promotion."
    QUERIES[name] = run


_promoted("jxnspan_promotion", "intronic_jxnspan")
_promoted("boundary_promotion", "intronic_boundary")
_promoted("empty_fallback", "ambiguous")


@query("no_blocks", "SELECT DISTINCT qname AS read_id, 'ambiguous' AS category, 0::BIGINT AS bases FROM alignments WHERE cigar = '*' AND qname IS NOT NULL")
def no_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Reads without aligned blocks are ambiguous with no bases."""
    a = table(spark, d, "alignments").where("qname IS NOT NULL")
    rows = a.select(F.col("qname").alias("read_id"), "pos", "cigar").distinct().withColumns({"n_blocks": F.size(R.blocks()), "n_junctions": F.size(R.junctions()), "read_length": R.aligned_length()}).where("n_blocks = 0")
    none = rows.select("read_id", F.lit("").alias("category"), F.lit(0).cast("long").alias("bases"), F.lit(0).cast("long").alias("first")).where("false")
    return classify.vote(rows, none).select("read_id", "category", F.col("base_counts")["ambiguous"].alias("bases"))


# the flags of the reads that the rules leave undecided, in SQL
_FLAGGED = (
    CLASSIFIED_SQL
    + f""", end_ AS (SELECT read_id, any_value(contig) AS contig, CAST(any_value(pos) + sum(CASE WHEN c IN ('M', 'D', 'N', '=', 'X') THEN n ELSE 0 END) AS BIGINT) AS pos_at FROM rz GROUP BY read_id),
pa_ AS (SELECT read_id FROM ({Q._fetch_sql('SELECT * FROM end_', C.POLYA_WINDOW)}) f WHERE contains(bases, '{'A' * C.POLYA_RUN}')),
jx_ AS (SELECT read_id, contig, strand, p AS pos_at FROM rz WHERE c = 'N' AND NOT EXISTS (SELECT 1 FROM ({Q._SPLICE}) s WHERE s.contig = rz.contig AND s.strand = rz.strand AND s.junction = rz.p)),
nc_ AS (SELECT DISTINCT read_id FROM ({Q._fetch_sql('SELECT * FROM jx_', 2)}) f WHERE NOT (length(bases) < 2 OR {Q._DONOR} IN ('GT', 'GC', 'AT'))),
ts_ AS (SELECT read_id FROM rest_ WHERE {Q._HIT.format(f'upper(substr(seq, 1, {Q._LEAD}))')} OR {Q._HIT.format(f'upper(right(seq, {Q._TRAIL}))')}),
flg AS (SELECT c.cell_barcode, t.read_id IS NOT NULL AS tso, p.read_id IS NOT NULL AS polya, n.read_id IS NOT NULL AS noncanon FROM cls c LEFT JOIN ts_ t USING (read_id) LEFT JOIN pa_ p ON p.read_id = c.read_id LEFT JOIN nc_ n ON n.read_id = c.read_id)"""
)
_COUNTS = "count(*) FILTER (tso) AS n_tso, count(*) FILTER (polya) AS n_polya, count(*) FILTER (noncanon) AS n_noncanon"


@query("artifact_flags", _FLAGGED + f" SELECT cell_barcode, {_COUNTS} FROM flg GROUP BY cell_barcode")
def artifact_flags(spark: SparkSession, d: str) -> DataFrame:
    """Artifact flags per cell of all primary reads."""
    return M.cell_flags(classified(spark, d, flags=True), ["cell_barcode"])


QUERIES["cell_artifact_flags"], SQL["cell_artifact_flags"] = artifact_flags, SQL["artifact_flags"]


@query("flag_totals", _FLAGGED + f" SELECT {_COUNTS} FROM flg")
def flag_totals(spark: SparkSession, d: str) -> DataFrame:
    """Artifact flags of the whole sample."""
    return artifact_flags(spark, d).agg(*[F.sum(f).alias(f) for f in M.FLAGS])
