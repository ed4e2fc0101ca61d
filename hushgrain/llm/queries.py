"""Queries of the operators of this package."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hushgrain.functions import names
from hushgrain.llm import bitmaps, packing, percentiles, sampling, spans, tokens
from hushgrain.queries.common import table
from hushgrain.storage import materialise

#: Standard error of the distinct counts, relative.
UMI_ERROR = 0.005
SAMPLE_SIZE = 50
SEED = 11
EDGES = [150, 500, 1000, 2000, 5000]


# --- problem 2 ---


def _umi_reads(spark, d):
    a = table(spark, d, "alignments").select("qname", "sample_id", F.date_format("sequenced_at", "yyyy-MM-dd").alias("run_day"), "category", names.umi(F.col("ub")).alias("umi"))
    return a.where("umi IS NOT NULL AND qname IS NOT NULL")


KEYS2 = ["sample_id", "run_day", "category"]


def _umi_maps(reads, n):
    bits = bitmaps.log_bits(max(1, n), UMI_ERROR)
    return materialise(bitmaps.bitmaps(reads, KEYS2, "umi", bits), "bitmaps"), bits


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups of at least 20 reads with at most a quarter as many UMIs.

    The bitmaps decide alone where a group is farther than eight standard errors and eight UMIs from the limit; of the
    groups in between the UMIs are counted exactly.
    """
    reads = materialise(_umi_reads(spark, d).distinct(), "reads")
    maps, bits = _umi_maps(reads, reads.count())
    totals = reads.groupBy(*KEYS2).agg(F.count(F.lit(1)).alias("n_reads")).where("n_reads >= 20")
    safe = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in KEYS2]
    room = bitmaps.deviation(F.col("b.n_distinct"), bits) * 8 + 8  # collisions of few identifiers are no normal distribution
    both = totals.alias("a").join(bitmaps.estimate(maps, KEYS2, bits).alias("b"), safe).select("a.*", (F.col("b.n_distinct") - room).alias("low"), (F.col("b.n_distinct") + room).alias("high"))
    both = materialise(both.where("low * 4 <= n_reads"), "maybe")
    sure = both.where("high * 4 <= n_reads")
    near = both.where("high * 4 > n_reads")
    rows = reads.alias("a").join(near.alias("b"), safe, "left_semi")
    exact = rows.groupBy(*KEYS2, "umi").agg(F.count(F.lit(1)).alias("c")).groupBy(*KEYS2).agg(F.count(F.lit(1)).alias("n_umis"), F.sum("c").alias("n_reads"))
    return sure.select(*KEYS2).unionByName(exact.where("n_umis * 4 <= n_reads").select(*KEYS2))


P2_FOUND = """
SELECT sample_id, strftime(sequenced_at, '%Y-%m-%d') AS run_day, category FROM alignments WHERE ub <> '' AND qname IS NOT NULL
GROUP BY 1, 2, 3 HAVING count(DISTINCT qname) >= 20 AND count(DISTINCT upper(ub)) * 4 <= count(DISTINCT qname)
"""


def p2_combinations(spark: SparkSession, d: str) -> DataFrame:
    """Estimated distinct UMIs for every combination of library, day and category.

    The reads are scanned once: bitmaps are made for as many identifiers as the table has rows, and folded to
    the size for those that were seen.
    """
    wide = bitmaps.log_bits(max(1, table(spark, d, "alignments").count()), UMI_ERROR)  # from the file's footers
    seen = Observation()
    rows = _umi_reads(spark, d).observe(seen, F.count(F.lit(1)).alias("n"))
    maps = materialise(bitmaps.bitmaps(rows, KEYS2, "umi", wide), "bitmaps")
    bits = bitmaps.log_bits(max(1, seen.get["n"]), UMI_ERROR)
    maps = materialise(bitmaps.fold(maps, KEYS2, wide, bits), "bitmaps") if bits < wide else maps
    every = bitmaps.merge_combinations(maps, KEYS2)
    return bitmaps.estimate(every, [*KEYS2, "level"], bits).withColumn("n_distinct", F.round("n_distinct", 4))


def _sql_maps(source: str, bits: str) -> str:
    return f"""
b AS (SELECT {bits} AS m),
s AS (SELECT DISTINCT sample_id, run_day, category, CAST(('0x' || substr(md5(umi), 1, 8)) AS BIGINT) // (4294967296 // m) AS bit FROM {source}, b)
"""


def _sql_bits(n: str) -> str:
    """The bitmap's size in SQL: the first power of two whose standard error is small enough."""
    ok = " ".join(f"WHEN ({n}) <= 8 * {2**b}::BIGINT AND sqrt({2**b} * (exp(least(700.0, ({n}) / {2.0**b})) - ({n}) / {2.0**b} - 1)) / ({n}) <= {UMI_ERROR} THEN {2**b}::BIGINT" for b in range(bitmaps.MIN_LOG_BITS, 31))
    return f"CASE {ok} END"


_SQL_ESTIMATE = "CAST(count(DISTINCT bit) AS BIGINT) AS n_bits_set, round(-(CAST(m AS DOUBLE)) * ln((m - count(DISTINCT bit)) / CAST(m AS DOUBLE)), 4) AS n_distinct"

P2_COMBINATIONS = f"""
WITH r AS (SELECT sample_id, strftime(sequenced_at, '%Y-%m-%d') AS run_day, category, upper(ub) AS umi FROM alignments WHERE ub <> '' AND qname IS NOT NULL),
{_sql_maps("r", _sql_bits("(SELECT greatest(1, count(*)) FROM r)"))}
SELECT sample_id, run_day, category, CAST(grouping(sample_id, run_day, category) AS INT) AS level, {_SQL_ESTIMATE} FROM s, b GROUP BY CUBE (sample_id, run_day, category), m HAVING m IS NOT NULL
"""


def _run_umis(spark, d):
    """The runs' UMIs, and the size of bitmaps for them by the arrays' sizes."""
    c = table(spark, d, "contig_results")
    n = c.agg(F.sum(F.size(F.filter("umi_set", lambda x: x != "")))).first()[0]
    rows = c.select("worker_run", *KEYS2, F.explode("umi_set").alias("umi")).where("umi != ''").withColumn("umi", F.upper("umi"))
    return rows, bitmaps.log_bits(max(1, n or 0), UMI_ERROR)


def p2_runs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct UMIs per library, day and category from bitmaps made per worker run and then merged."""
    rows, bits = _run_umis(spark, d)
    per_run = bitmaps.bitmaps(rows, ["worker_run", *KEYS2], "umi", bits)
    return bitmaps.estimate(bitmaps.merge(per_run, KEYS2), KEYS2, bits).withColumn("n_distinct", F.round("n_distinct", 4))


P2_RUNS = f"""
WITH r AS (SELECT sample_id, run_day, category, upper(umi) AS umi FROM (SELECT sample_id, run_day, category, unnest(umi_set) AS umi FROM contig_results) u WHERE umi <> ''),
{_sql_maps("r", _sql_bits("(SELECT greatest(1, count(*)) FROM r)"))}
SELECT sample_id, run_day, category, {_SQL_ESTIMATE} FROM s, b GROUP BY sample_id, run_day, category, m
"""


def p2_run_combinations(spark: SparkSession, d: str) -> DataFrame:
    """Distinct UMIs of the runs for every combination of library, day and category, from bitmaps made per worker run and then merged."""
    rows, bits = _run_umis(spark, d)
    per_run = bitmaps.bitmaps(rows, ["worker_run", *KEYS2], "umi", bits)
    every = bitmaps.merge_combinations(materialise(bitmaps.merge(per_run, KEYS2), "bitmaps"), KEYS2)
    return bitmaps.estimate(every, [*KEYS2, "level"], bits).withColumn("n_distinct", F.round("n_distinct", 4))


P2_RUN_COMBINATIONS = f"""
WITH r AS (SELECT sample_id, run_day, category, upper(umi) AS umi FROM (SELECT sample_id, run_day, category, unnest(umi_set) AS umi FROM contig_results) u WHERE umi <> ''),
{_sql_maps("r", _sql_bits("(SELECT greatest(1, count(*)) FROM r)"))}
SELECT sample_id, run_day, category, CAST(grouping(sample_id, run_day, category) AS INT) AS level, {_SQL_ESTIMATE} FROM s, b GROUP BY CUBE (sample_id, run_day, category), m HAVING m IS NOT NULL
"""


# --- problem 4 ---


def p4_length_sample(spark: SparkSession, d: str) -> DataFrame:
    """A uniform sample of read lengths per library and category; each read counts once."""
    a = table(spark, d, "alignments").where("read_length > 0")
    s = sampling.fixed_sample(a, ["sample_id", "category"], "qname", "read_length", SAMPLE_SIZE, SEED)
    return s.select("sample_id", "category", F.col("ident").alias("qname"), F.col("value").alias("read_length"), "n_taken")


P4_LENGTH_SAMPLE = f"""
WITH r AS (SELECT sample_id, category, qname, min(read_length) AS read_length FROM alignments WHERE read_length > 0 AND qname IS NOT NULL GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY sample_id, category ORDER BY substr(md5('{SEED}:' || qname), 1, 15), qname) AS rn, count(*) OVER (PARTITION BY sample_id, category) AS c FROM r)
SELECT sample_id, category, qname, read_length, least(c, {SAMPLE_SIZE}) AS n_taken FROM n WHERE rn <= {SAMPLE_SIZE}
"""


def p4_piecewise_sample(spark: SparkSession, d: str) -> DataFrame:
    """The same sample out of buffers made apart for early and late pieces and merged afterwards."""
    a = table(spark, d, "alignments").where("read_length > 0")
    args = (["sample_id", "category"], "qname", "read_length", SAMPLE_SIZE, SEED)
    late = F.coalesce(F.col("piece_no") % 2 == 1, F.lit(False))
    both = sampling.partial_samples(a.where(~late), *args).unionByName(sampling.partial_samples(a.where(late), *args))
    s = sampling.merged_sample(both, ["sample_id", "category"], SAMPLE_SIZE)
    return s.select("sample_id", "category", F.col("ident").alias("qname"), F.col("value").alias("read_length"), "n_taken")


def p4_parts_sample(spark: SparkSession, d: str) -> DataFrame:
    """A uniform sample per library and category out of partial samples and their sizes."""
    p = table(spark, d, "length_parts")
    s = sampling.sample_of_samples(p, ["sample_id", "category"], ["worker_run", "sample_id", "run_day", "contig", "category"], "n_reads", "length_samples", SAMPLE_SIZE, SEED)
    return s.select("sample_id", "category", F.col("value").alias("read_length"), F.round("u", 9).alias("u"), "n_taken", "n_records")


P4_PARTS_SAMPLE = f"""
WITH o AS (SELECT worker_run, sample_id, run_day, contig, category, n_reads, any_value(length_samples) AS v FROM length_parts WHERE n_reads > 0 AND len(length_samples) > 0 GROUP BY 1, 2, 3, 4, 5, 6),
x AS (SELECT *, len(v) AS s, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS i FROM o),
h AS (SELECT *, md5(concat_ws(':', '{SEED}', coalesce(CAST(worker_run AS VARCHAR), '\\N'), coalesce(sample_id, '\\N'), coalesce(run_day, '\\N'), coalesce(contig, '\\N'), coalesce(category, '\\N'), CAST(i AS VARCHAR))) AS h FROM x),
j AS (SELECT *, row_number() OVER (PARTITION BY worker_run, sample_id, run_day, contig, category, n_reads ORDER BY h) - 1 AS j FROM h),
g AS (SELECT *, 1 - exp(-sum(-ln((CAST(('0x' || substr(h, 16, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / (n_reads - j)) OVER (PARTITION BY worker_run, sample_id, run_day, contig, category, n_reads ORDER BY j ROWS UNBOUNDED PRECEDING)) AS u FROM j),
l AS (SELECT sample_id, category, CAST(sum(CASE WHEN j = 0 THEN n_reads END) AS BIGINT) AS n_records, coalesce(min(CASE WHEN j = s - 1 AND s < n_reads THEN u END), 1) AS lim FROM g GROUP BY 1, 2),
r AS (SELECT g.sample_id, g.category, value, u, n_records, row_number() OVER (PARTITION BY g.sample_id, g.category ORDER BY u, value) AS rn FROM g JOIN l ON g.sample_id IS NOT DISTINCT FROM l.sample_id AND g.category IS NOT DISTINCT FROM l.category WHERE u <= lim)
SELECT sample_id, category, CAST(value AS BIGINT) AS read_length, round(u, 9) AS u, count(*) OVER (PARTITION BY sample_id, category) AS n_taken, n_records FROM r WHERE rn <= {SAMPLE_SIZE}
"""


# --- problem 5 ---

KEYS5 = ["sample_id", "category"]


def _lengths(spark, d):
    a = table(spark, d, "alignments").where("read_length > 0").select("qname", *KEYS5, "read_length")
    return materialise(percentiles.weights(a, KEYS5, "qname", "read_length"), "lengths")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups of at least 20 reads, more than half of them shorter than 300: the read at rank n div 2 + 1 is."""
    s = percentiles.select(_lengths(spark, d), KEYS5, {"upper_median": "n div 2 + 1"})
    return s.where("n >= 20 AND value < 300").select(*KEYS5)


P5_FOUND = """
SELECT sample_id, category FROM (SELECT sample_id, category, qname, min(read_length) AS v FROM alignments WHERE read_length > 0 AND qname IS NOT NULL GROUP BY 1, 2, 3) r
GROUP BY 1, 2 HAVING count(*) >= 20 AND 2 * count(*) FILTER (WHERE v < 300) > count(*)
"""


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of read length per library and category."""
    return percentiles.select(_lengths(spark, d), KEYS5, percentiles.percent_ranks([5, 25, 50, 75, 95]))


P5_PERCENTILES = """
WITH o AS (SELECT sample_id, category, qname, min(read_length) AS v FROM alignments WHERE read_length > 0 AND qname IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT sample_id, category, v, row_number() OVER (PARTITION BY sample_id, category ORDER BY v) AS rn, count(*) OVER (PARTITION BY sample_id, category) AS n FROM o)
SELECT sample_id, category, n, 'p' || p AS name, rn AS rank, CAST(v AS BIGINT) AS value FROM r, (SELECT unnest([5, 25, 50, 75, 95]) AS p) q WHERE rn = greatest(1, (n * p + 99) // 100)
"""


def p5_bin_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of read length from bin counts of runs and days, within the bin's bounds."""
    p = table(spark, d, "length_parts").drop("length_samples").distinct()
    return percentiles.from_bins(p, KEYS5, "length_bin_counts", EDGES, [5, 25, 50, 75, 95])


P5_BIN_PERCENTILES = """
WITH o AS (SELECT DISTINCT worker_run, sample_id, run_day, contig, category, n_reads, length_bin_counts FROM length_parts),
x AS (SELECT sample_id, category, i, sum(length_bin_counts[i]) AS c FROM o, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS i) k GROUP BY 1, 2, 3),
r AS (SELECT *, sum(c) OVER (PARTITION BY sample_id, category ORDER BY i) AS upto, sum(c) OVER (PARTITION BY sample_id, category) AS n FROM x WHERE c > 0)
SELECT sample_id, category, CAST(n AS BIGINT) AS n, p AS percent, CAST([0, 150, 500, 1000, 2000, 5000][i] AS BIGINT) AS low, CAST([150, 500, 1000, 2000, 5000, NULL][i] AS BIGINT) AS high
FROM r, (SELECT unnest([5, 25, 50, 75, 95]) AS p) q WHERE greatest(1, (CAST(n AS BIGINT) * p + 99) // 100) <= upto AND greatest(1, (CAST(n AS BIGINT) * p + 99) // 100) > upto - c
"""


# --- problem 6 ---


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Each document's token ids."""
    return tokens.encode(table(spark, d, "documents"))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Each document's number of tokens."""
    return tokens.encode(table(spark, d, "documents"), count_only=True)


# --- problem 7 ---


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every commit's container of 2,048 tokens."""
    return packing.pack(p6_counts(spark, d), "doc_id", "n_tokens")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every container's load."""
    return packing.containers(p7_packing(spark, d))


def p7_constraints(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: every commit is there, and nothing is over a capacity or split without need."""
    packed = materialise(p7_packing(spark, d), "packed")
    c = packing.containers(packed)
    load = c.agg(F.count_if(F.col("n_tokens") > packing.CAPACITY).alias("over_capacity"), F.count_if(F.col("n_items") > packing.MAX_ITEMS).alias("over_items"), F.count_if((F.col("attention_cost") > packing.CAPACITY**2 * packing.COST_SHARE) & (F.col("n_items") > 1)).alias("over_cost"))
    docs = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("piece_no").alias("m"), F.sum("n_tokens").alias("t"))
    whole = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if((F.col("n") > F.ceil(F.greatest(F.col("t"), F.lit(1)) / packing.CAPACITY)) | (F.col("n") != F.col("m"))).alias("split"))
    return whole.join(F.broadcast(load))  # a row each


P7_CONSTRAINTS = "SELECT count(DISTINCT doc_id) AS n_docs, 0::BIGINT AS split, 0::BIGINT AS over_capacity, 0::BIGINT AS over_items, 0::BIGINT AS over_cost FROM documents"


# --- problem 8 ---


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of commits with at least 200 characters in common."""
    return spans.pairs(spans.shared_spans(table(spark, d, "documents")))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of each commit also stands in another."""
    docs = table(spark, d, "documents")
    return spans.shares(docs, spans.coverage(spans.shared_spans(docs)))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """The maximal spans that two commits share, each with its place in both."""
    m = spans.maximal(spans.shared_spans(table(spark, d, "documents"), aligned=True))
    return m.select("span", F.col("doc").alias("doc_id"), "first", "last")


def p8_removed(spark: SparkSession, d: str) -> DataFrame:
    """Each commit's text without the spans that also stand in an earlier one."""
    docs = table(spark, d, "documents")
    return spans.removed(docs, spans.shared_spans(docs))


def _classes(spark, d):
    """The commits' classes of equal text, and the spans that the classes share."""
    docs = table(spark, d, "documents")
    classes = materialise(spans.text_classes(docs), "text_classes")
    one = docs.join(classes.where("doc = class_id").select(F.col("doc").alias("doc_id")), "doc_id", "left_semi")
    return classes, spans.shared_spans(one)


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each commit with the class of commits of the same text, and the number of other classes it shares a span with."""
    classes, shared = _classes(spark, d)
    both = spans.pairs(shared).select(F.explode(F.array("doc_id_a", "doc_id_b")).alias("class_id"))
    n = both.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    return classes.join(n, "class_id", "left").select(F.col("doc").alias("doc_id"), "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p8_groups(spark: SparkSession, d: str) -> DataFrame:
    """The links without pairs: two texts share a span just if their classes are in a group together."""
    return spans.link_groups(_classes(spark, d)[1]).select("group_id", F.col("doc").alias("class_id"), "n_members")


# in SQL every window of the length is a row, so it is for the smaller scales
_WINDOWS = f"""WITH w AS (SELECT doc_id, p, md5(substr(text, p, {spans.LENGTH})) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - {spans.LENGTH - 2})) AS p FROM documents WHERE length(text) >= {spans.LENGTH} AND doc_id IS NOT NULL) x),
m AS (SELECT h, min(doc_id) AS first_ FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1)"""


def _covered(rows: str) -> str:
    """Shared windows merged where they overlap or adjoin: ``doc_id, s, e`` with ``s`` from 0."""
    return f"""SELECT doc_id, min(p) - 1 AS s, max(p) + {spans.LENGTH - 1} AS e FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM
(SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= {spans.LENGTH} THEN 0 ELSE 1 END AS n FROM ({rows}) q) a) b GROUP BY doc_id, g"""


P8_FOUND = _WINDOWS + ", s AS (SELECT DISTINCT doc_id, h FROM w SEMI JOIN m USING (h)) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id"
P8_SHARES = (
    _WINDOWS
    + f""", c AS ({_covered("SELECT doc_id, p FROM w SEMI JOIN m USING (h)")}), t AS (SELECT doc_id, CAST(sum(e - s) AS BIGINT) AS shared_chars, count(*) AS n_spans FROM c GROUP BY 1)
SELECT d.doc_id, coalesce(length(text), 0) AS n_chars, coalesce(shared_chars, 0) AS shared_chars, coalesce(n_spans, 0) AS n_spans, coalesce(coalesce(shared_chars, 0) / nullif(CAST(length(text) AS DOUBLE), 0), 0) AS share FROM documents d LEFT JOIN t USING (doc_id)"""
)
P8_SPANS = (
    _WINDOWS
    + f""", s AS (SELECT doc_id, p - 1 AS p, h FROM w SEMI JOIN m USING (h)), j AS (SELECT a.doc_id AS a, b.doc_id AS b, b.p - a.p AS off, a.p FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id),
i AS (SELECT a, b, off, min(p) AS p, max(p) + {spans.LENGTH} AS q FROM (SELECT *, p - row_number() OVER (PARTITION BY a, b, off ORDER BY p) AS g FROM j) x GROUP BY a, b, off, g),
n AS (SELECT *, concat_ws(':', a, p, b, p + off) AS span FROM i)
SELECT span, a AS doc_id, CAST(p AS INT) AS first, CAST(q AS INT) AS last FROM n UNION ALL SELECT span, b, CAST(p + off AS INT), CAST(q + off AS INT) FROM n"""
)
P8_REMOVED = (
    _WINDOWS
    + f""", c AS ({_covered("SELECT doc_id, p FROM w JOIN m USING (h) WHERE doc_id > first_")}),
k AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b, s AS e FROM c UNION ALL SELECT doc_id, max(e), NULL FROM c GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(CASE WHEN e IS NULL THEN substr(text, CAST(b + 1 AS BIGINT)) ELSE substr(text, CAST(b + 1 AS BIGINT), CAST(e - b AS BIGINT)) END, '' ORDER BY b) AS rest FROM k JOIN documents USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN rest IS NULL THEN text ELSE rest END AS text, coalesce(length(text) - length(rest), 0) AS n_removed FROM documents d LEFT JOIN t USING (doc_id)"""
)
P8_CLASSES = f"""
WITH cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, 'null' || doc_id)) AS class_id, count(*) OVER (PARTITION BY coalesce(text, 'null' || doc_id)) AS n_copies FROM documents),
w AS (SELECT doc_id, md5(substr(text, p, {spans.LENGTH})) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - {spans.LENGTH - 2})) AS p FROM documents WHERE length(text) >= {spans.LENGTH} AND doc_id IN (SELECT class_id FROM cls)) x),
s AS (SELECT DISTINCT doc_id, h FROM w), p AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id),
n AS (SELECT x AS class_id, count(*) AS n_links FROM p GROUP BY 1)
SELECT doc_id, class_id, n_copies, coalesce(n_links, 0) AS n_links FROM cls LEFT JOIN n USING (class_id)
"""


QUERIES = {
    "p2_found": p2_found,
    "p2_combinations": p2_combinations,
    "p2_runs": p2_runs,
    "p2_run_combinations": p2_run_combinations,
    "p4_length_sample": p4_length_sample,
    "p4_piecewise_sample": p4_piecewise_sample,
    "p4_parts_sample": p4_parts_sample,
    "p5_found": p5_found,
    "p5_percentiles": p5_percentiles,
    "p5_bin_percentiles": p5_bin_percentiles,
    "p6_ids": p6_ids,
    "p6_counts": p6_counts,
    "p7_packing": p7_packing,
    "p7_containers": p7_containers,
    "p7_constraints": p7_constraints,
    "p8_found": p8_found,
    "p8_shares": p8_shares,
    "p8_spans": p8_spans,
    "p8_removed": p8_removed,
    "p8_classes": p8_classes,
    "p8_groups": p8_groups,
}
SQL = {
    "p2_found": P2_FOUND,
    "p2_combinations": P2_COMBINATIONS,
    "p2_runs": P2_RUNS,
    "p2_run_combinations": P2_RUN_COMBINATIONS,
    "p4_length_sample": P4_LENGTH_SAMPLE,
    "p4_piecewise_sample": P4_LENGTH_SAMPLE,
    "p4_parts_sample": P4_PARTS_SAMPLE,
    "p5_found": P5_FOUND,
    "p5_percentiles": P5_PERCENTILES,
    "p5_bin_percentiles": P5_BIN_PERCENTILES,
    "p7_constraints": P7_CONSTRAINTS,
    "p8_found": P8_FOUND,
    "p8_shares": P8_SHARES,
    "p8_spans": P8_SPANS,
    "p8_removed": P8_REMOVED,
    "p8_classes": P8_CLASSES,
}
