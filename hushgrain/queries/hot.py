"""Queries of problem 1: keys that hold most of the rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrain.functions import names
from hushgrain.operators import hotkeys
from hushgrain.queries.common import table
from hushgrain.storage import materialise


def _alignments(spark, d, *more):
    a = table(spark, d, "alignments").select("qname", "contig", *more)
    return names.with_contig(a, table(spark, d, "contigs"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Contigs with 5 % and barcodes with 2 % of the distinct reads of their table."""
    a = _alignments(spark, d).select(F.lit("contig").alias("key_kind"), F.col("qname").alias("ident"), F.col("contig_key").alias("key_value"))
    i = table(spark, d, "intergenic_reads").select(F.lit("cell_barcode").alias("key_kind"), F.col("qname").alias("ident"), names.barcode(F.col("cell_barcode")).alias("key_value"))
    return hotkeys.heavy_keys(a.unionByName(i), {"contig": 0.05, "cell_barcode": 0.02}).select("key_kind", "key_value")


P1_FOUND = """
WITH names AS (SELECT name_key, min(contig) AS contig FROM (SELECT upper(contig) AS name_key, contig FROM contigs UNION ALL SELECT upper(ensembl_name), contig FROM contigs) u GROUP BY name_key),
a AS (SELECT 'contig' AS key_kind, qname, n.contig AS key_value FROM alignments x LEFT JOIN names n ON upper(x.contig) = n.name_key),
i AS (SELECT 'cell_barcode' AS key_kind, qname, coalesce(regexp_replace(upper(cell_barcode), '-1$', ''), '') AS key_value FROM intergenic_reads),
u AS (SELECT * FROM a UNION ALL SELECT * FROM i),
t AS (SELECT key_kind, count(DISTINCT qname) AS total FROM u GROUP BY key_kind),
k AS (SELECT key_kind, key_value, count(DISTINCT qname) AS n FROM u WHERE key_value IS NOT NULL GROUP BY key_kind, key_value)
SELECT key_kind, key_value FROM k JOIN t USING (key_kind) WHERE n >= total * CASE WHEN key_kind = 'contig' THEN 0.05 ELSE 0.02 END
"""


def p1_read_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct reads per canonical contig, cell and category."""
    a = _alignments(spark, d, "cb", "category").withColumn("cell_barcode", names.barcode(F.col("cb")))
    return hotkeys.distinct_reads(a, "qname", ["contig_key", "cell_barcode", "category"])


P1_READ_COUNTS = """
WITH names AS (SELECT name_key, min(contig) AS contig FROM (SELECT upper(contig) AS name_key, contig FROM contigs UNION ALL SELECT upper(ensembl_name), contig FROM contigs) u GROUP BY name_key)
SELECT n.contig AS contig_key, coalesce(regexp_replace(upper(cb), '-1$', ''), '') AS cell_barcode, category, count(DISTINCT qname) AS n_reads
FROM alignments x LEFT JOIN names n ON upper(x.contig) = n.name_key WHERE qname IS NOT NULL GROUP BY 1, 2, 3
"""

_QUANTILES = """
once AS (SELECT {key}, qname, min(v) AS v FROM src WHERE qname IS NOT NULL GROUP BY {key}, qname),
r AS (SELECT {key}, v, row_number() OVER (PARTITION BY {key} ORDER BY v) AS rn, count(v) OVER (PARTITION BY {key}) AS n_values FROM once WHERE v IS NOT NULL),
n AS (SELECT {key}, count(*) AS n, count(v) AS n_values FROM once GROUP BY {key}),
p AS (SELECT n.*, percent FROM n CROSS JOIN (SELECT unnest([25, 50, 75, 95]) AS percent) q)
SELECT p.{key}, p.n, p.n_values, p.percent, r.v AS value FROM p LEFT JOIN r ON p.{key} IS NOT DISTINCT FROM r.{key} AND r.rn = greatest(1, (p.n_values * p.percent + 99) // 100)
"""


def p1_contig_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles and the 95th percentile of the reads' positions per canonical contig."""
    once = _alignments(spark, d, "pos").where("qname IS NOT NULL").groupBy("contig_key", "qname").agg(F.min("pos").alias("v"))
    compact = materialise(hotkeys.weighted(once, ["contig_key"], "v"), "weights")
    return hotkeys.keyed_quantiles(compact, ["contig_key"], [25, 50, 75, 95])


P1_CONTIG_QUANTILES = (
    """
WITH names AS (SELECT name_key, min(contig) AS contig FROM (SELECT upper(contig) AS name_key, contig FROM contigs UNION ALL SELECT upper(ensembl_name), contig FROM contigs) u GROUP BY name_key),
src AS (SELECT n.contig AS contig_key, qname, pos AS v FROM alignments x LEFT JOIN names n ON upper(x.contig) = n.name_key),"""
    + _QUANTILES.format(key="contig_key")
)


def p1_cell_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles and the 95th percentile of intergenic reads' 3' ends per barcode."""
    i = table(spark, d, "intergenic_reads").withColumn("cell_key", names.barcode(F.col("cell_barcode")))
    once = i.where("qname IS NOT NULL").groupBy("cell_key", "qname").agg(F.min("three_prime").alias("v"))
    compact = materialise(hotkeys.weighted(once, ["cell_key"], "v"), "weights")
    return hotkeys.keyed_quantiles(compact, ["cell_key"], [25, 50, 75, 95])


P1_CELL_QUANTILES = "WITH src AS (SELECT coalesce(regexp_replace(upper(cell_barcode), '-1$', ''), '') AS cell_key, qname, three_prime AS v FROM intergenic_reads)," + _QUANTILES.format(key="cell_key")


def p1_result_counts(spark: SparkSession, d: str) -> DataFrame:
    """Reads and bases per contig, cell and category over all partial results; rows that come twice unchanged count once."""
    c = table(spark, d, "contig_results").drop("umi_set").distinct()
    return c.groupBy("contig", "cell_barcode", "category").agg(F.sum("read_count").alias("n_reads"), F.sum("base_count").alias("n_bases"))


P1_RESULT_COUNTS = """
SELECT contig, cell_barcode, category, CAST(sum(read_count) AS BIGINT) AS n_reads, CAST(sum(base_count) AS BIGINT) AS n_bases
FROM (SELECT DISTINCT worker_run, sample_id, run_day, contig, cell_barcode, category, read_count, base_count FROM contig_results) u GROUP BY 1, 2, 3
"""

QUERIES = {"p1_found": p1_found, "p1_read_counts": p1_read_counts, "p1_contig_quantiles": p1_contig_quantiles, "p1_cell_quantiles": p1_cell_quantiles, "p1_result_counts": p1_result_counts}
SQL = {"p1_found": P1_FOUND, "p1_read_counts": P1_READ_COUNTS, "p1_contig_quantiles": P1_CONTIG_QUANTILES, "p1_cell_quantiles": P1_CELL_QUANTILES, "p1_result_counts": P1_RESULT_COUNTS}
