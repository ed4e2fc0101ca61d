"""Reads, genes and sites derived from the general test tables.

The test data have no annotation.  These views derive one, and reads that meet it, from the
order tables by integer arithmetic, so that Spark and other engines agree on every row.
Each is one SQL text over every row of its table; ``{div}`` stands for the engine's integer division.

The derived genome has five contigs.  Every 200 parts make a block of genes; blocks lie 500,000
bases apart, and reads, sites and repeats are spread over the blocks alike, so the number of overlaps grows
as the tables do.  A contig's sequence has one chunk a part; beyond it bases are unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TSO = "AAGCAGTGGTATCAACGCAGAGTACATGGG"

TEXTS = {
    "reads": f"""
SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(l_quantity AS INT) AS STRING)) AS read_id,
  CASE WHEN l_suppkey % 50 = 7 THEN 'chrM' ELSE concat('chr', CAST(l_suppkey % 5 + 1 AS STRING)) END AS contig,
  ((l_partkey * 7919 + l_orderkey * 104729 + l_linenumber * 611953) % 400000 + (l_partkey {{div}} 200) * 500000) AS pos,
  CAST(l_quantity AS BIGINT) * 20 AS read_length,
  CASE WHEN l_linestatus = 'F' THEN '-' ELSE '+' END AS strand,
  CASE WHEN l_linestatus = 'F' THEN 16 ELSE 0 END
    + CASE WHEN l_partkey % 41 = 0 THEN 256 ELSE 0 END + CASE WHEN l_partkey % 43 = 0 THEN 4 ELSE 0 END + CASE WHEN l_partkey % 47 = 0 THEN 2048 ELSE 0 END
    + CASE WHEN l_suppkey % 2 = 0 THEN 1 + 2 * (l_linenumber % 2) + CASE WHEN l_orderkey % 37 = 0 THEN 8 ELSE 0 END + CASE WHEN l_partkey % 2 = 0 THEN 64 ELSE 128 END ELSE 0 END AS flag,
  CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE concat('CB', CAST(l_orderkey % 40 AS STRING)) END AS cb,
  concat('U', CAST(l_orderkey % 1000 AS STRING)) AS umi,
  CASE WHEN l_partkey % 23 = 0 THEN 2 WHEN l_partkey % 89 = 0 THEN NULL ELSE 1 END AS nh,
  CASE l_orderkey % 31 WHEN 0 THEN 'chr9,100,+,50M,60,0;'
    WHEN 1 THEN concat('chr', CAST(l_suppkey % 5 + 1 AS STRING), ',', CAST(((l_partkey * 7919 + l_orderkey * 104729 + l_linenumber * 611953) % 400000 + (l_partkey {{div}} 200) * 500000) + 10001 AS STRING), ',', CASE WHEN l_linestatus = 'F' THEN '-' ELSE '+' END, ',50M,60,0;')
    WHEN 2 THEN concat('chr', CAST(l_suppkey % 5 + 1 AS STRING), ',', CAST(((l_partkey * 7919 + l_orderkey * 104729 + l_linenumber * 611953) % 400000 + (l_partkey {{div}} 200) * 500000) + 10000 AS STRING), ',', CASE WHEN l_linestatus = 'F' THEN '-' ELSE '+' END, ',50M,60,0;')
    WHEN 3 THEN concat('chr', CAST(l_suppkey % 5 + 1 AS STRING), ',100,', CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END, ',50M,60,0;')
    WHEN 4 THEN 'chr1,abc;;' END AS sa,
  CASE WHEN l_linenumber = 7 THEN concat(CAST((CAST(l_quantity AS BIGINT) * 20) {{div}} 2 AS STRING), 'M500N', CAST((CAST(l_quantity AS BIGINT) * 20) - (CAST(l_quantity AS BIGINT) * 20) {{div}} 2 AS STRING), 'M')
    WHEN l_linenumber = 6 THEN concat('5M2I3D', CAST(CAST(l_quantity AS BIGINT) * 20 - 7 AS STRING), 'M')
    WHEN l_linenumber = 5 THEN concat('5H8S', CAST(CAST(l_quantity AS BIGINT) * 20 AS STRING), 'M')
    WHEN l_linenumber = 4 THEN concat(CAST(CAST(l_quantity AS BIGINT) * 20 AS STRING), 'M12S')
    WHEN l_linenumber = 3 THEN concat('20S', CAST(CAST(l_quantity AS BIGINT) * 20 AS STRING), 'M')
    ELSE concat(CAST(CAST(l_quantity AS BIGINT) * 20 AS STRING), 'M') END AS cigar,
  CASE WHEN l_linenumber = 3 THEN concat(CASE WHEN l_partkey % 3 = 0 THEN substr('{_TSO}', 1, 20) ELSE repeat('ATCG', 5) END, repeat('ACGT', CAST(l_quantity AS INT) * 5))
    WHEN l_linenumber = 4 THEN concat(repeat('ACGT', CAST(l_quantity AS INT) * 5), CASE WHEN l_partkey % 3 = 0 THEN 'AAgggggggACT' ELSE 'GGGGGACTGGGG' END)
    WHEN l_linenumber = 5 THEN concat('GGGGGGGG', repeat('ACGT', CAST(l_quantity AS INT) * 5))
    ELSE repeat('ACGT', CAST(l_quantity AS INT) * 5) END AS seq,
  CASE WHEN l_orderkey % 29 = 0 THEN NULL WHEN l_orderkey % 19 = 0 THEN 'chr9' WHEN l_suppkey % 50 = 7 THEN 'chrM' ELSE concat('chr', CAST(l_suppkey % 5 + 1 AS STRING)) END AS next_contig,
  CASE WHEN l_orderkey % 53 = 0 THEN 2000000 ELSE (l_partkey * 37 - l_orderkey * 11) % 3000 END AS tlen
FROM {{lineitem}}""",
    "genes": """
SELECT concat('G', CAST(p_partkey AS STRING)) AS gene_id, concat('chr', CAST(p_partkey % 5 + 1 AS STRING)) AS contig, ((p_partkey * 159157) % 400000 + (p_partkey {div} 200) * 500000) AS s,
  ((p_partkey * 159157) % 400000 + (p_partkey {div} 200) * 500000) + 1000 + p_size * 200 AS e, CASE WHEN (p_partkey {div} 5) % 3 = 0 THEN '-' ELSE '+' END AS strand,
  CASE WHEN p_partkey % 3 = 0 THEN 'lncRNA' ELSE 'protein_coding' END AS biotype
FROM {part}""",
    "exons": """
SELECT gene_id, contig, s + k * ((e - s) {div} 3) AS s, s + k * ((e - s) {div} 3) + (e - s) {div} 6 + CASE WHEN k = 1 THEN 40 ELSE 0 END AS e, strand, biotype
FROM {genes} g CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks""",
    "sites": "SELECT concat('chr', CAST(o_custkey % 5 + 1 AS STRING)) AS contig, (o_orderkey * 7919) % 400000 + (o_orderkey {div} 1500) * 500000 AS pos FROM {orders}",
    "repeats": "SELECT concat('chr', CAST(s_nationkey % 5 + 1 AS STRING)) AS contig, (s_suppkey * 40503) % 400000 + (s_suppkey {div} 10) * 500000 AS s, (s_suppkey * 40503) % 400000 + (s_suppkey {div} 10) * 500000 + 300 AS e FROM {supplier}",
    "obs": "SELECT concat('CB', CAST(n_nationkey AS STRING)) AS cell_barcode, concat('C', CAST(n_nationkey % 4 AS STRING)) AS cluster FROM {nation}",
    "wells": "SELECT concat('P', CAST(n_regionkey AS STRING)) AS plate_id, concat(substr('ABCDEFGH', n_nationkey % 8 + 1, 1), CAST(n_nationkey % 12 + 1 AS STRING)) AS well_id, n_nationkey AS well_no FROM {nation}",
    "chunks": "SELECT concat('chr', CAST(k AS STRING)) AS contig, p_partkey AS chunk_id, translate(concat("
    + ", ".join(f"md5(concat(CAST(k AS STRING), ':', CAST(p_partkey AS STRING), ':{i}'))" for i in range(16))
    + "), '0123456789abcdef', 'ACGTACGTACGTAAAA') AS seq FROM {part} p CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) ks",
}
#: Bases in a chunk of the derived reference sequence.
CHUNK = 512

_NEEDS = {"reads": ("lineitem",), "genes": ("part",), "exons": ("genes",), "sites": ("orders",), "repeats": ("supplier",), "obs": ("nation",), "wells": ("nation",), "chunks": ("part",)}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the views over a data folder."""
    used = {n: view(spark, folder, n) if n in TEXTS else spark.read.parquet(f"{folder}/{n}.parquet") for n in _NEEDS[name]}
    return spark.sql(TEXTS[name].replace("{div}", "div"), **used)


def _duck_text(name: str) -> str:
    return TEXTS[name].replace("{div}", "//").replace("STRING", "VARCHAR").format(**{m: m for m in _NEEDS[name]})


def duck(*names: str) -> str:
    """The views as the common table expressions of a query in DuckDB's dialect, ``WITH`` included."""
    order: list[str] = []

    def need(n):
        for m in _NEEDS[n]:
            if m in TEXTS:
                need(m)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    return "WITH " + ", ".join(f"{n} AS ({_duck_text(n)})" for n in order)
