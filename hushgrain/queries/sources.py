"""Queries of sources, sheets, headers and sinks.

Their text inputs are made of the test tables line by line and read back by the parsers, so
that SQL over the tables themselves is the expected result.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrain import constants as C
from hushgrain.operators import annotation as A
from hushgrain.operators import metrics as M
from hushgrain.plans import sinks
from hushgrain.queries import intervals as IQ
from hushgrain.queries import metrics as Q
from hushgrain.queries import results
from hushgrain.queries.common import table
from hushgrain.sources import bam, fetch, headers, resolve, sheets, text
from hushgrain.standins import duck, view
from hushgrain.storage import application_dir

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _tabbed(df: DataFrame, *cols) -> DataFrame:
    """One line of text per row."""
    return df.select(F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]).alias("value"))


def _comment(spark, *more: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in ("# comment", "", *more)], "value string")


# --- annotation and lists ---


def _gtf(spark, d):
    def rows(df, feature, tag):
        attr = F.concat(F.lit('gene_id "'), "gene_id", F.lit(f'"; {tag} "'), "biotype", F.lit('"; gene_name "N'), "gene_id", F.lit('";'))
        return _tabbed(df, F.col("contig"), F.lit("x"), F.lit(feature), F.col("s") + 1, F.col("e"), F.lit("."), F.col("strand"), F.lit("."), attr)

    return rows(view(spark, d, "genes"), "gene", "gene_type").unionByName(rows(view(spark, d, "exons"), "exon", "gene_biotype")).unionByName(_comment(spark, "chr1\tx\tgene\tnine\t3\t.\t+\t.\tgene_id \"Z\";"))


@query("scan_gtf", duck("genes", "exons") + " SELECT 'gene' AS feature, gene_id, concat('N', gene_id) AS gene_name, contig, s, e, strand, biotype FROM genes UNION ALL SELECT 'exon', gene_id, concat('N', gene_id), contig, s, e, strand, biotype FROM exons")
def scan_gtf(spark: SparkSession, d: str) -> DataFrame:
    """Annotation text."""
    return text.parse_gtf(_gtf(spark, d)).select("feature", "gene_id", "gene_name", "contig", "s", "e", "strand", "biotype")


@query("peek_gtf_style", "SELECT 'ucsc' AS style")
def peek_gtf_style(spark: SparkSession, d: str) -> DataFrame:
    """The annotation's naming style."""
    return text.gtf_style(_gtf(spark, d))


@query("scan_bed_sites", duck("sites") + " SELECT DISTINCT contig, pos FROM sites")
def scan_bed_sites(spark: SparkSession, d: str) -> DataFrame:
    """Middles of site intervals, of a list that names each twice."""
    s = view(spark, d, "sites")
    one = _tabbed(s, F.col("contig"), F.col("pos") - F.col("pos") % 7, F.col("pos") + F.col("pos") % 7)
    return text.parse_sites(one.unionByName(one).unionByName(_comment(spark, "chr1\t5", "chr1\tx\t9")))


@query("scan_bed_intervals", duck("repeats") + " SELECT contig, s, e FROM repeats")
def scan_bed_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals."""
    return text.parse_intervals(_tabbed(view(spark, d, "repeats"), F.col("contig"), F.col("s"), F.col("e")).unionByName(_comment(spark)))


@query("scan_bed_repeats", duck("repeats") + " SELECT contig, s, e, concat('R', CAST(s % 10 AS VARCHAR)) AS name, CASE WHEN s % 3 = 0 THEN '.' ELSE '-' END AS strand FROM repeats")
def scan_bed_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Repeats with name and strand."""
    r = view(spark, d, "repeats")
    return text.parse_repeats(_tabbed(r, F.col("contig"), F.col("s"), F.col("e"), F.concat(F.lit("R"), (F.col("s") % 10).cast("string")), F.lit(0), F.when(F.col("s") % 3 != 0, "-")))


@query("scan_fasta", duck("chunks") + " SELECT contig, chunk_id, seq FROM chunks")
def scan_fasta(spark: SparkSession, d: str) -> DataFrame:
    """A sequence file's lines of 61 bases back in chunks."""
    c = view(spark, d, "chunks").withColumn("at", F.substring("contig", 4, 9).cast("long") * (1 << 40))
    head = c.select("contig", "at").distinct().select(F.concat(F.lit(">"), "contig", F.lit(" x")).alias("value"), "at")
    body = c.select(F.explode(F.sequence(F.lit(0), F.lit(8))).alias("i"), "seq", "chunk_id", "at").select(F.lower(F.substring(F.col("seq"), F.col("i") * 61 + 1, F.lit(61))).alias("value"), (F.col("at") + F.col("chunk_id") * 10 + F.col("i") + 1).alias("at"))
    return text.fasta_chunks(head.unionByName(body).where("value != ''"))


_CB = "SELECT cb FROM alignments WHERE trim(cb) <> ''"


@query("scan_whitelist", f"SELECT DISTINCT trim(cb) AS barcode FROM ({_CB}) x")
def scan_whitelist(spark: SparkSession, d: str) -> DataFrame:
    """Barcodes as they stand."""
    return text.parse_barcodes(table(spark, d, "alignments").select(F.concat(F.lit(" "), F.coalesce("cb", F.lit(""))).alias("value")))


@query("scan_called_cells", f"SELECT DISTINCT regexp_replace(trim(cb), '-1$', '') AS barcode FROM ({_CB}) x")
def scan_called_cells(spark: SparkSession, d: str) -> DataFrame:
    """Barcodes without the trailing number."""
    return text.parse_barcodes(table(spark, d, "alignments").select(F.coalesce("cb", F.lit("")).alias("value")), strip=True)


@query("scan_obs_metadata", duck("obs") + " SELECT cell_barcode, cluster FROM obs")
def scan_obs_metadata(spark: SparkSession, d: str) -> DataFrame:
    """A cluster table with other column names."""
    return text.obs_columns(view(spark, d, "obs").select(F.col("cluster").alias("Leiden"), F.lit(1).alias("x"), F.col("cell_barcode").alias("CB")))


@query("fetch_polyadb4", duck("sites") + " SELECT contig, pos AS s, pos + 1 AS e FROM sites")
def fetch_polyadb4(spark: SparkSession, d: str) -> DataFrame:
    """Site names to intervals."""
    s = view(spark, d, "sites")
    return text.parse_polyadb(s.select(F.concat_ws(":", "contig", F.lit("+"), (F.col("pos") + 1).cast("string")).alias("PAS_ID")).unionByName(spark.createDataFrame([("bad",)], "PAS_ID string")))


@query("version_from_filename", "SELECT n_nationkey, n_nationkey + 20 AS gencode, n_nationkey + 18 AS polyasite FROM nation")
def version_from_filename(spark: SparkSession, d: str) -> DataFrame:
    """Versions out of file names."""
    n = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("gencode.v"), (F.col("n_nationkey") + 20).cast("string"), F.lit(".gtf.gz")).alias("a"), F.concat(F.lit("atlas.GENCODE_"), (F.col("n_nationkey") + 18).cast("string"), F.lit(".bed")).alias("b"))
    return n.select("n_nationkey", text.gencode_version(F.col("a")).alias("gencode"), text.polyasite_version(F.col("b")).alias("polyasite"))


@query("cache_lookup", "SELECT max(n_nationkey) + 20 AS version FROM nation")
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The cached file of the highest release, of a file for every nation and others beside them."""
    files = [f"gencode.v{r.n_nationkey + 20}.annotation.gtf.gz" for r in table(spark, d, "nation").select("n_nationkey").collect()]  # the names in a folder
    best = resolve.newest_name([*files, "gencode.v999.annotation.gtf.gz.tmp", "other.v77.txt"], fetch.GENCODE_NAME)
    return spark.createDataFrame([(resolve.version_of(best),)], "version int")


@query("scan_sam", duck("reads") + " SELECT read_id AS qname, flag, contig, pos, cigar, seq, cb, umi, nh, sa, strand, next_contig, CAST(tlen AS BIGINT) AS tlen FROM reads")
def scan_sam(spark: SparkSession, d: str) -> DataFrame:
    """Alignment text."""
    r = view(spark, d, "reads")
    same = F.when(F.col("next_contig").isNull(), "*").when(F.col("next_contig") == F.col("contig"), "=").otherwise(F.col("next_contig"))
    flag = F.col("flag")
    tags = [F.concat(F.lit(f"{t}:"), F.col(c).cast("string")) for t, c in (("CB:Z", "cb"), ("UB:Z", "umi"), ("NH:i", "nh"), ("SA:Z", "sa"))]
    line = F.concat_ws("\t", "read_id", flag.cast("string"), "contig", (F.col("pos") + 1).cast("string"), F.lit("60"), "cigar", same, F.lit("1"), F.col("tlen").cast("string"), "seq", F.lit("*"), *tags)
    lines = r.select(line.alias("value")).unionByName(spark.createDataFrame([("@HD\tVN:1.6\tSO:coordinate",), ("short\t1",)], "value string"))
    return text.parse_sam(lines).select("qname", "flag", "contig", "pos", "cigar", "seq", "cb", "umi", "nh", "sa", "strand", "next_contig", "tlen")


def _header(spark, d) -> str:
    """A header with a line for every contig."""
    rows = table(spark, d, "contigs").select("contig", "contig_length").collect()  # a header's contigs
    return "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{r.contig}\tLN:{r.contig_length}\n" for r in rows) + "@CO\tSN:none\tLN:1\n"


@query("scan_bam_header", "SELECT contig, contig_length FROM contigs")
def scan_bam_header(spark: SparkSession, d: str) -> DataFrame:
    """Contigs out of header text."""
    return spark.createDataFrame(list(headers.inspect(_header(spark, d))["contigs"].items()), "contig string, contig_length bigint")


@query("validate_sq", "SELECT count(*) > 0 AS has_contigs FROM contigs")
def validate_sq(spark: SparkSession, d: str) -> DataFrame:
    """Whether the header names contigs."""
    return spark.createDataFrame([("no contigs in the header" not in headers.inspect(_header(spark, d))["issues"],)], "has_contigs boolean")


@query("validate_sort", "SELECT p_partkey % 4 AS k, count(*) AS n, p_partkey % 4 IN (1, 2) AS is_fatal FROM part GROUP BY 1, 3")
def validate_sort(spark: SparkSession, d: str) -> DataFrame:
    """Which of four sort orders are fatal; a missing one is not."""
    orders = ["coordinate", "unsorted", "queryname", ""]

    def fatal(order: str) -> bool:
        try:
            headers.check_order(order)
        except ValueError:
            return True
        return False

    known = spark.createDataFrame([(i, fatal(o)) for i, o in enumerate(orders)], "k int, is_fatal boolean")
    n = table(spark, d, "part").groupBy((F.col("p_partkey") % 4).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(known), "k")  # four rows


# --- header rules over many files ---

_HINTS = "[lower(bam_path), lower(coalesce(platform, '')), CASE ascii(right(sample_id, 1)) % 5 WHEN 0 THEN 'minimap2' WHEN 1 THEN 'star' WHEN 2 THEN 'cellranger' WHEN 3 THEN 'isoseq3 refine' ELSE 'bwa' END]"


def _hints(spark, d):
    s = table(spark, d, "samples")
    k = F.ascii(F.right("sample_id", F.lit(1))) % 5
    tool = F.when(k == 0, "minimap2").when(k == 1, "star").when(k == 2, "cellranger").when(k == 3, "isoseq3 refine").otherwise("bwa")
    return s.select("sample_id", F.array(F.lower("bam_path"), F.lower(F.coalesce("platform", F.lit(""))), tool).alias("hints"), tool.alias("tool"))


def _hit(names) -> str:
    return "len(list_filter(h, lambda x: regexp_matches(x, '" + "|".join(names) + "'))) > 0"


_H = f"SELECT sample_id, {_HINTS} AS h FROM samples"


@query("platform_from_header", f"SELECT sample_id, CASE WHEN {_hit(headers.ONT)} THEN 'ont' WHEN {_hit(headers.PACBIO)} THEN 'pacbio' WHEN {_hit(headers.DROPLET)} THEN CASE WHEN {_hit(headers.BD)} THEN 'illumina_bd' ELSE 'illumina_10x' END WHEN {_hit(('star',))} THEN 'smartseq' ELSE 'unknown' END AS platform FROM ({_H}) x")
def platform_from_header(spark: SparkSession, d: str) -> DataFrame:
    """Platforms by the rules on header names."""
    return _hints(spark, d).select("sample_id", headers.platform_of(F.col("hints")).alias("platform"))


@query("stage_from_header", f"SELECT sample_id, CASE WHEN {_hit(headers.POST_FILTER)} THEN 'post_filter' WHEN {_hit(('isoseq3',))} THEN CASE WHEN {_hit(('refine',))} THEN 'pre_filter' ELSE 'raw' END WHEN {_hit([n for n, _ in headers.ALIGNERS])} THEN 'pre_filter' ELSE 'custom' END AS stage FROM ({_H}) x")
def stage_from_header(spark: SparkSession, d: str) -> DataFrame:
    """Stages by the rules on header names."""
    return _hints(spark, d).select("sample_id", headers.stage_of(F.col("hints")).alias("stage"))


_CHEM = "concat(coalesce(platform, ''), ' ', CASE ascii(right(sample_id, 1)) % 4 WHEN 0 THEN 'Chromium v4' WHEN 1 THEN '10X 3.1' WHEN 2 THEN 'BD Rhapsody' ELSE '' END)"


@query("chemistry_from_header", f"SELECT sample_id, CASE WHEN regexp_matches(t, 'rhapsody|flashbd|flash-seq|flash_seq') THEN 'bd_rhapsody_wta' WHEN regexp_matches(t, '10x|chromium|gem-x') THEN CASE WHEN regexp_matches(t, 'v4|gem-x|4\\.0') THEN '10x_v4' ELSE '10x_v3' END ELSE 'unknown' END AS chemistry FROM (SELECT sample_id, lower({_CHEM}) AS t FROM samples) x")
def chemistry_from_header(spark: SparkSession, d: str) -> DataFrame:
    """Chemistries by the rules on header text."""
    k = F.ascii(F.right("sample_id", F.lit(1))) % 4
    t = F.concat(F.coalesce("platform", F.lit("")), F.lit(" "), F.when(k == 0, "Chromium v4").when(k == 1, "10X 3.1").when(k == 2, "BD Rhapsody").otherwise(""))
    return table(spark, d, "samples").select("sample_id", headers.chemistry_of(t).alias("chemistry"))


@query("platform_normalise", "SELECT sample_id, CASE WHEN lower(platform) IN ('illumina_10x', 'illumina_bd') THEN 'illumina' ELSE lower(platform) END AS platform FROM samples")
def platform_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Platforms as shown."""
    return table(spark, d, "samples").select("sample_id", headers.normalised_platform(F.lower("platform")).alias("platform"))


@query("is_illumina", "SELECT sample_id, coalesce(starts_with(lower(platform), 'illumina') OR lower(platform) = 'smartseq', false) AS is_illumina FROM samples")
def is_illumina(spark: SparkSession, d: str) -> DataFrame:
    """Platforms with paired reads."""
    return table(spark, d, "samples").select("sample_id", headers.is_illumina(F.lower("platform")).alias("is_illumina"))


@query("discover_inspect", f"SELECT p.sample_id, p.platform, CASE WHEN fraction >= 0.5 THEN 'post_filter' WHEN s.stage IN ('pre_filter', 'raw') THEN s.stage ELSE 'pre_filter' END AS stage, p.platform = 'unknown' AS has_issue FROM ({SQL['platform_from_header']}) p JOIN ({SQL['stage_from_header']}) s USING (sample_id) JOIN (SELECT sample_id, avg(CASE WHEN cb <> '' THEN 1.0 ELSE 0.0 END) AS fraction FROM alignments GROUP BY 1) f USING (sample_id)")
def discover_inspect(spark: SparkSession, d: str) -> DataFrame:
    """Header rules and barcodes together: what each file is and whether it can be run."""
    f = table(spark, d, "alignments").groupBy("sample_id").agg(F.avg(F.when(F.col("cb") != "", 1.0).otherwise(0.0)).alias("fraction"))
    j = platform_from_header(spark, d).join(stage_from_header(spark, d), "sample_id").join(f, "sample_id")
    stage = F.when(F.col("fraction") >= headers.MIN_BARCODE_FRACTION, "post_filter").when(F.col("stage").isin("pre_filter", "raw"), F.col("stage")).otherwise("pre_filter")
    return j.select("sample_id", "platform", stage.alias("stage"), (F.col("platform") == "unknown").alias("has_issue"))


@query("discover_bams", "SELECT bam_path FROM samples WHERE ends_with(bam_path, '.bam')")
def discover_bams(spark: SparkSession, d: str) -> DataFrame:
    """Alignment files by name."""
    return table(spark, d, "samples").where(F.endswith("bam_path", F.lit(".bam"))).select("bam_path").orderBy("bam_path")


# --- files in the shared folder ---


def _folder(spark, name: str) -> str:
    """A new folder of this application, deleted with it."""
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("scan_bam", duck("reads") + " SELECT read_id AS qname, flag, contig, pos, cigar, seq, cb, umi, nh, sa, strand, next_contig, CAST(tlen AS BIGINT) AS tlen FROM reads")
def scan_bam(spark: SparkSession, d: str) -> DataFrame:
    """Binary alignments: every derived read written to files, one a partition, and read back."""
    r = view(spark, d, "reads").withColumn("qname", F.col("read_id")).withColumn("mapq", F.lit(60)).withColumn("seq", F.upper("seq"))
    folder = _folder(spark, "bam")
    length = max(1 << 30, (r.agg(F.max("pos")).first()[0] or 0) + 1)  # the derived genome grows with the tables
    bam.write_bam(r, folder, [(f"chr{i}", length) for i in (1, 2, 3, 4, 5, 9)] + [("chrM", length)])
    bam.register(spark)
    return spark.read.format("bam").load(folder).select("qname", "flag", "contig", "pos", "cigar", "seq", "cb", "umi", "nh", "sa", "strand", "next_contig", "tlen")


SQL["scan_bam"] = SQL["scan_bam"].replace(" seq, cb", " upper(seq) AS seq, cb")


@query("gzip_open", duck("sites") + " SELECT DISTINCT contig, pos FROM sites")
def gzip_open(spark: SparkSession, d: str) -> DataFrame:
    """A site list from gzipped text."""
    folder = _folder(spark, "gz")
    _tabbed(view(spark, d, "sites"), F.col("contig"), F.col("pos"), F.col("pos") + 1).write.text(folder, compression="gzip")
    return text.parse_sites(text.lines(spark, folder))


def _cached(name: str, part: str, build, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        folder = _folder(spark, "cache")
        made = [resolve.cached(spark, folder, "key", lambda: {part: build(spark, d)}) for _ in range(2)]  # built, then read
        return made[1][part]

    run.__doc__ = f"The {part} out of the cache."
    QUERIES[name], SQL[name] = run, sql


_cached("annotation_cache", "exons", lambda spark, d: A.exon_unions(view(spark, d, "exons")), IQ.SQL["exon_union_per_gene"])
_cached("site_cache", "sites", lambda spark, d: view(spark, d, "sites").distinct(), duck("sites") + " SELECT DISTINCT contig, pos FROM sites")

# --- plates ---


def _well_paths(spark, d):
    w = view(spark, d, "wells")
    a = w.select(F.concat(F.lit("/d/"), "plate_id", F.lit("_"), F.lower("well_id"), F.lit("/b.bam")).alias("path"))
    b = w.select(F.concat(F.lit("/d/"), "plate_id", F.lit("_"), F.lower("well_id"), F.lit("/a.bam")).alias("path"))
    return a.unionByName(b).unionByName(spark.createDataFrame([("/d/nowell/a.bam",), ("/d/P1_A1/x.txt",)], "path string"))


@query("discover_plate_wells", duck("wells") + " SELECT DISTINCT plate_id, well_id, concat('/d/', plate_id, '_', lower(well_id), '/a.bam') AS bam FROM wells")
def discover_plate_wells(spark: SparkSession, d: str) -> DataFrame:
    """The first file of each well's folder."""
    return sheets.plate_wells(_well_paths(spark, d))


SQL["plate_id_filter"] = duck("wells") + " SELECT DISTINCT plate_id, well_id FROM wells WHERE plate_id IN ('P0', 'P3', 'P9')"
QUERIES["plate_id_filter"] = lambda spark, d: discover_plate_wells(spark, d).where(F.col("plate_id").isin("P0", "P3", "P9")).select("plate_id", "well_id")


@query("set_difference", "SELECT 'P9' AS plate_id")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    """Requested plates that are not there."""
    return spark.createDataFrame([("P0",), ("P3",), ("P9",)], "plate_id string").exceptAll(discover_plate_wells(spark, d).select("plate_id").distinct())


_NAMES = ["Sample_Name", "i7_sequence", "i7_Name", "i5_sequence", "i5 label", "volume"]


def _sheet_rows(spark, d):
    w = view(spark, d, "wells").where("well_no % 4 != 0")
    name = F.when(F.col("well_no") % 3 == 0, F.col("well_id")).otherwise(F.concat_ws("_", "plate_id", "well_id"))
    first = w.select(F.col("well_no").cast("long").alias("row_no"), F.array(name, F.lit("ACGTT"), F.lit("N7"), F.lit("GGA"), F.lit("S5"), F.lit("1")).alias("cells"))
    last = w.select((F.col("well_no") + 100).cast("long").alias("row_no"), F.array(name, F.lit("ACGTA"), F.concat(F.lit("N"), F.col("well_no").cast("string")), F.lit("GGT"), F.lit("S5"), F.lit(" 2 ")).alias("cells"))
    blank = spark.createDataFrame([(900, ["", " ", "", "", "", ""])], "row_no long, cells array<string>")
    return first.unionByName(last).unionByName(blank)


def _sheet(spark, d):
    return sheets.parse_sheet(_sheet_rows(spark, d), _NAMES, "nextseq")


_SHEET = """SELECT CASE WHEN well_no % 3 = 0 THEN well_id ELSE concat(plate_id, '/', well_id) END AS key, CASE WHEN well_no % 3 = 0 THEN '' ELSE plate_id END AS plate_id, well_id, 'TACGT' AS i7_seq, 'GGT' AS i5_seq, concat('N', CAST(well_no AS VARCHAR)) AS i7_name, '2' AS volume, row_number() OVER (PARTITION BY CASE WHEN well_no % 3 = 0 THEN well_id ELSE concat(plate_id, '/', well_id) END ORDER BY well_no DESC) AS rn FROM wells WHERE well_no % 4 <> 0"""
_SHEET_DUCK = duck("wells") + f", sheet AS (SELECT * EXCLUDE (rn) FROM ({_SHEET}) x WHERE rn = 1)"


@query("scan_sample_sheet", _SHEET_DUCK + " SELECT * FROM sheet")
def scan_sample_sheet(spark: SparkSession, d: str) -> DataFrame:
    """A sheet with repeated wells; the last row of a well wins."""
    s = _sheet(spark, d)
    return s.select("key", "plate_id", "well_id", "i7_seq", "i5_seq", "i7_name", F.col("extras")["volume"].alias("volume"))


SQL["last_row_wins"] = _SHEET_DUCK + " SELECT key, i7_name FROM sheet"
QUERIES["last_row_wins"] = lambda spark, d: _sheet(spark, d).select("key", "i7_name")



@query("split_well", "SELECT sample_id, CASE WHEN substr(sample_id, 9, 1) = '1' THEN '' ELSE sample_id END AS plate_id, CASE WHEN substr(sample_id, 9, 1) = '1' THEN upper(concat(sample_id, '_zz')) ELSE 'C2' END AS well_id FROM samples")
def split_well(spark: SparkSession, d: str) -> DataFrame:
    """Plate and well out of a sample's name."""
    s = table(spark, d, "samples").withColumn("name", F.concat("sample_id", F.when(F.substring("sample_id", 9, 1) == "1", "_zz").otherwise("_c2")))
    plate, well = sheets.split_sample_name(F.col("name"))
    return s.select("sample_id", plate.alias("plate_id"), well.alias("well_id"))


_LOOKUP = _SHEET_DUCK + " SELECT w.plate_id, w.well_id, coalesce(a.i7_name, b.i7_name) AS i7_name FROM wells w LEFT JOIN sheet a ON a.key = concat(w.plate_id, '/', w.well_id) LEFT JOIN sheet b ON b.key = w.well_id"
SQL["lookup_well"] = SQL["well_sheet_join"] = _LOOKUP


@query("well_sheet_join", _LOOKUP)
def well_sheet_join(spark: SparkSession, d: str) -> DataFrame:
    """Wells with their sheet row, by plate and well or by well."""
    return sheets.with_sheet(view(spark, d, "wells"), _sheet(spark, d)).select("plate_id", "well_id", "i7_name")


QUERIES["lookup_well"] = well_sheet_join


@query("sheet_anti_joins", _SHEET_DUCK + " SELECT 'well' AS side, concat(plate_id, '/', well_id) AS key FROM wells w WHERE concat(plate_id, '/', well_id) NOT IN (SELECT key FROM sheet) AND well_id NOT IN (SELECT key FROM sheet) UNION ALL SELECT 'sheet', key FROM sheet WHERE key NOT IN (SELECT concat(plate_id, '/', well_id) FROM wells WHERE well_no < 12) AND key NOT IN (SELECT well_id FROM wells WHERE well_no < 12)")
def sheet_anti_joins(spark: SparkSession, d: str) -> DataFrame:
    """Wells without a row; rows without a well, of a plate of which only the first wells came."""
    w, s = view(spark, d, "wells"), _sheet(spark, d)
    lonely, _ = sheets.unmatched(w, s)
    _, lost = sheets.unmatched(w.where("well_no < 12"), s)
    return lonely.select(F.lit("well").alias("side"), F.concat_ws("/", "plate_id", "well_id").alias("key")).unionByName(lost.select(F.lit("sheet").alias("side"), "key"))


@query("find_col", "SELECT * FROM (VALUES ('i7', 1), ('i5', 3), ('sample_name', 0), ('zzz', NULL)) t(marker, position)")
def find_col(spark: SparkSession, d: str) -> DataFrame:
    """The first column whose name holds a marker."""
    low = [n.lower() for n in _NAMES]
    return spark.createDataFrame([(m, next((i for i, h in enumerate(low) if m in h), None)) for m in ("i7", "i5", "sample_name", "zzz")], "marker string, position int")


# --- sinks: the rows they write ---


def _rates(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN 'nan' ELSE printf('%.6f', {name}) END"


_FR = ", ".join(f"{Q._sum('n_reads', [c])} / sum(n_reads) AS read_frac_{c}" for c in C.CATEGORY_ORDER)
_RM = Q.ONCE + f", s AS (SELECT sample_id, CAST(sum(n_reads) AS BIGINT) AS n_reads_classified, {Q._ES} / nullif({Q._ES} + {Q._EA}, 0) AS strand_concordance, {_FR} FROM cnt GROUP BY 1), t AS (SELECT sample_id, CAST(n_reads_classified AS VARCHAR) AS n_reads_classified, {_rates('strand_concordance')} AS strand_concordance, {', '.join(f'{_rates(f"read_frac_{c}")} AS read_frac_{c}' for c in C.CATEGORY_ORDER)} FROM s)"


@query("sink_read_metrics", _RM + f" SELECT sample_id, metric, value FROM t UNPIVOT (value FOR metric IN (n_reads_classified, strand_concordance, {', '.join(f'read_frac_{c}' for c in C.CATEGORY_ORDER)}))")
def sink_read_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The metrics table's rows: counts, concordance and read fractions."""
    one = Q.sample_row(spark, d).select("sample_id", "n_reads_classified", "strand_concordance", *[f"read_frac_{c}" for c in C.CATEGORY_ORDER])
    return sinks.read_metrics(one, ["sample_id"])


_MQ = Q.CELLS + f""", s AS (SELECT sample_id, {Q._sum('n_reads', C.NOISE)} / sum(n_reads) AS noise_read_frac, coalesce({Q._sum('n_bases', C.NOISE)} / nullif(sum(n_bases), 0), 0) AS noise_base_frac, {Q._sum('n_reads', C.NOISE_STRICT)} / sum(n_reads) AS noise_read_frac_strict, {Q._ES} / nullif({Q._ES} + {Q._EA}, 0) AS strand_concordance, CAST(sum(n_reads) AS DOUBLE) AS n_reads_classified, {_FR} FROM cnt GROUP BY 1)"""
_MQ_NAMES = ["noise_read_frac", "noise_base_frac", "noise_read_frac_strict", "strand_concordance", "n_reads_classified", *[f"read_frac_{c}" for c in C.CATEGORY_ORDER]]


@query("sink_multiqc", _MQ + f" SELECT sample_id, metric, round_even(v, 4) AS value FROM s UNPIVOT (v FOR metric IN ({', '.join(_MQ_NAMES)}))")
def sink_multiqc(spark: SparkSession, d: str) -> DataFrame:
    """The summary of each library as JSON, read back."""
    j = sinks.summary_json(Q.sample_row(spark, d)).select("sample_id", F.explode(F.from_json("json", "map<string,double>")).alias("metric", "value"))
    return j.where(F.col("metric").isin(*_MQ_NAMES))


def _read_back(df: DataFrame, single: bool = True, blank: tuple[str, ...] = ()) -> DataFrame:
    """A table as the sink writes it, read again; empty text is null in it but for the columns named."""
    folder = _folder(df.sparkSession, "tsv")
    sinks.write_tsv(df, folder, single)
    back = df.sparkSession.read.csv(folder, sep="\t", header=True, schema=df.schema)
    return back.withColumns({c: F.coalesce(c, F.lit("")) for c in blank})


def _sink(name: str, source, sql: str, single: bool = True, blank: tuple[str, ...] = ()) -> None:
    QUERIES[name], SQL[name] = lambda spark, d: _read_back(source(spark, d), single, blank), sql
    QUERIES[name].__doc__ = "The table as written, read back."


_sink("sink_cell_metrics", Q.cell_metrics, Q.SQL["cell_metrics"], False, ("cell_barcode",))
_sink("sink_cluster_metrics", Q.cluster_metrics, Q.SQL["cluster_metrics"])
_sink("sink_compare_metrics", results.metrics_full_outer, results.SQL["metrics_full_outer"])
_sink("sink_compare_stats", results.chi2_compare, results.SQL["chi2_compare"])


@query("sink_length_samples", Q.ONCE + " SELECT category, read_length FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5(qname), qname) AS rn FROM once WHERE read_length > 0) x WHERE rn <= 200")
def sink_length_samples(spark: SparkSession, d: str) -> DataFrame:
    """Sampled lengths, a folder per category, read back."""
    folder = _folder(spark, "lengths")
    sinks.write_length_samples(M.hashed_sample(Q.once(spark, d).where("read_length > 0"), ["category"], "qname", 200), folder)
    return spark.read.csv(folder, sep="\t", header=True, schema="read_length int, category string")


@query("sink_length_strat", Q._STRAT)
def sink_length_strat(spark: SparkSession, d: str) -> DataFrame:
    """The stratified lengths in their written order."""
    r = Q.once(spark, d)
    return sinks.length_table(Q.rounded(M.length_stratification(M.length_bins(r, Q.S), M.median_length(r, Q.S), Q.S)))


@query("sink_per_well", Q.ONCE + f" SELECT substr(sample_id, 1, 2) AS plate_id, substr(sample_id, 3) AS well_id, CAST(sum(n_reads) AS BIGINT) AS n_reads_classified, printf('%.4f', {Q._sum('n_reads', C.NOISE)} / sum(n_reads)) AS noise_read_frac FROM cnt GROUP BY 1, 2")
def sink_per_well(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the per-well table."""
    return sinks.per_well_rows(Q.per_well_metrics(spark, d).select("plate_id", "well_id", "n_reads_classified", "noise_read_frac"))


@query("sink_loci", results.RECORDS + " SELECT contig, start_pos AS start, end_pos AS \"end\", strand, n_reads, n_barcodes, has_splice_evidence, NOT has_splice_evidence AS is_monoexonic, polya_run AS polya_run_downstream, near_polya_site, category FROM dec")
def sink_loci(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the locus table as written, but for the p-value, which engines compute to different digits."""
    return _read_back(sinks.loci_table(results.scored(spark, d)), False).drop("poisson_pvalue_adj")


@query("console_summary", Q.ONCE + f" SELECT concat(sample_id, '  ', CAST(CAST(sum(n_reads) AS BIGINT) AS VARCHAR), ' reads  noise ', printf('%.4f', {Q._sum('n_reads', C.NOISE)} / sum(n_reads))) AS line FROM cnt GROUP BY sample_id")
def console_summary(spark: SparkSession, d: str) -> DataFrame:
    """A line per library."""
    s = Q.sample_row(spark, d)
    return s.select(F.format_string("%s  %d reads  noise %.4f", "sample_id", "n_reads_classified", F.bround("noise_read_frac", 4)).alias("line"))
