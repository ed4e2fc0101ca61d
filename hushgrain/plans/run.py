"""Whole analyses: one sample, a plate, two samples, a folder of files."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrain import constants as C
from hushgrain.functions import names
from hushgrain.functions import reads as R
from hushgrain.operators import annotation, cascade, classify, compare, figures, intergenic, intervals, metrics, sequence
from hushgrain.plans import reports, sinks
from hushgrain.sources import bam, headers, resolve, sheets, text
from hushgrain.storage import lookup_join, materialise

#: Bases in a chunk of the reference sequence.
CHUNK = 512


@dataclass
class Settings:
    """What a run is given.  Paths are optional but for the annotation; ``cache`` is a folder that all executors share."""

    gtf: str
    whitelist: str | None = None
    called_cells: str | None = None
    reference: str | None = None
    polya_sites: list[str] = field(default_factory=list)
    tss_sites: list[str] = field(default_factory=list)
    repeats: str | None = None
    numt: str | None = None
    obs: str | None = None
    platform: str = "unknown"
    stage: str | None = None
    barcode_tag: str = "CB"
    umi_tag: str = "UB"
    distance: int = C.CHIMERIC_DISTANCE
    umi_dedup: bool = True
    exclude_biotypes: list[str] = field(default_factory=list)
    least_contig: int = C.MIN_CONTIG_LENGTH
    cache: str | None = None
    warnings: list[str] = field(default_factory=list)
    facts: list[tuple[str, str]] = field(default_factory=list)

    @property
    def paired(self) -> bool:
        return self.platform.startswith("illumina") or self.platform == "smartseq"


def load(spark: SparkSession, path: str | list[str], barcode_tag: str = "CB", umi_tag: str = "UB") -> DataFrame:
    """Alignments of a ``.bam`` (file, pattern, folder or list of files), ``.sam`` text or Parquet."""
    if isinstance(path, list):
        bam.register(spark)
        df = spark.read.format("bam").option("paths", json.dumps(path)).option("barcode_tag", barcode_tag).option("umi_tag", umi_tag).load()
    elif path.endswith((".sam", ".sam.gz")):
        df = text.parse_sam(text.lines(spark, path), barcode_tag, umi_tag).withColumn("file", F.lit(path))
    elif path.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        bam.register(spark)
        df = spark.read.format("bam").option("barcode_tag", barcode_tag).option("umi_tag", umi_tag).load(path)
    return df if "read_id" in df.columns else df.withColumn("read_id", F.concat_ws(":", "file", "qname", "flag", "contig", "pos"))


def header(spark: SparkSession, path: str) -> dict:
    """What the header of an alignment file tells; of SAM text its ``@`` lines are read."""
    if path.endswith((".sam", ".sam.gz")):
        top = [r.value for r in text.lines(spark, path).where(F.col("value").rlike("^@[A-Z]{2}\t")).collect()]  # a header's lines
        return headers.inspect("\n".join(top))
    if path.endswith(".bam"):
        return headers.inspect(bam.header_text(path))
    return {"platform": "unknown", "stage": "custom", "contigs": {}, "sort_order": ""}


def build_index(spark: SparkSession, s: Settings) -> dict[str, DataFrame]:
    """The annotation's layers, out of the cache if there is one for the file and the excluded biotypes."""

    def build() -> dict[str, DataFrame]:
        genes, exons = text.gtf_layers(materialise(text.parse_gtf(text.lines(spark, s.gtf)), "gtf"))
        return annotation.build(genes, exons, s.exclude_biotypes)

    if s.cache:
        return resolve.cached(spark, s.cache, "annotation-" + resolve.cache_key([s.gtf], *sorted(s.exclude_biotypes), spark=spark), build)
    return {k: materialise(v, k) for k, v in build().items()}


def site_list(spark: SparkSession, paths: list[str], s: Settings, contigs: dict[str, int] | None) -> DataFrame:
    """Sites of all lists, each once, named as the alignments name contigs; out of the cache if there is one."""
    strip = names.style(contigs or {}) == "ensembl"
    build = lambda: {"sites": text.parse_sites(text.lines(spark, *paths), strip)}
    if s.cache:
        return resolve.cached(spark, s.cache, "sites-" + resolve.cache_key(paths, str(strip), spark=spark), build)["sites"]
    return materialise(build()["sites"], "sites")


def classify_reads(spark: SparkSession, reads: DataFrame, s: Settings, index: dict[str, DataFrame], contigs: dict[str, int] | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """Classified primary reads of the contigs that are read and of the called cells."""
    if contigs:
        mito = [c for c in contigs if c in C.MITO_CONTIGS]
        main = [c for c in contigs if c not in mito]
        long = [c for c in main if contigs[c] >= s.least_contig] or main
        reads = reads.where(F.col("contig").isin(*long, *mito))
    white = text.parse_barcodes(text.lines(spark, s.whitelist)) if s.whitelist else None
    got = classify.classify(reads, annotation.tagged(index), white, s.paired, index["splice_sites"], chunks, distance=s.distance)
    if s.called_cells:
        got = cascade.called_cells(got, text.parse_barcodes(text.lines(spark, s.called_cells), strip=True), "cell_barcode")
    return got


def locus_records(got: DataFrame) -> DataFrame:
    """The side table of sparse intergenic reads; its junction flag is that of non-canonical junctions."""
    r = got.where("category = 'intergenic_sparse'")
    end = F.col("pos") + F.col("read_length")
    return intergenic.records(r.select(*[c for c in ("sample_id",) if c in got.columns], F.col("read_id").alias("qname"), "contig", F.col("pos").alias("start_pos"), end.alias("end_pos"), "strand", "cell_barcode", F.col("is_noncanon").alias("has_junction"), F.when(F.col("strand") == "-", F.col("pos")).otherwise(end).alias("three_prime")))


def _reference(spark: SparkSession, s: Settings) -> DataFrame | None:
    return materialise(text.read_fasta(spark, s.reference, CHUNK), "reference") if s.reference else None


def run_sample(spark: SparkSession, reads: DataFrame, s: Settings, index: dict[str, DataFrame] | None = None, name: str = "sample", contigs: dict[str, int] | None = None, profile: bool = True) -> dict[str, DataFrame]:
    """All tables of one sample (or of many, told apart by ``sample_id``)."""
    index = index or build_index(spark, s)
    reads = reads if "sample_id" in reads.columns else reads.withColumn("sample_id", F.lit(name))
    chunks = _reference(spark, s)
    got = materialise(classify_reads(spark, reads, s, index, contigs, chunks), "classified")
    total = reads.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_reads_total"))
    return tables(spark, got, total, s, index, contigs, chunks, profile)


def tables(spark: SparkSession, got: DataFrame, total: DataFrame, s: Settings, index: dict[str, DataFrame], contigs: dict[str, int] | None, chunks: DataFrame | None, profile: bool) -> dict[str, DataFrame]:
    """The tables of classified reads; ``total`` has the reads of each ``sample_id``."""
    keys = ["sample_id"]
    counts = materialise(metrics.cell_counts(got, keys, s.umi_dedup), "counts")
    polya = site_list(spark, s.polya_sites, s, contigs) if s.polya_sites else None
    found = None
    if profile:
        recs = materialise(locus_records(got), "records")
        clustered = materialise(intergenic.cluster(recs, keys), "clustered")
        bases = annotation.intergenic_bases(index["intergenic"]).first()[0]
        repeats = text.parse_repeats(text.lines(spark, s.repeats)) if s.repeats else None
        places, run = intergenic.loci(clustered, keys), None
        if chunks is not None:
            places, run = sequence.fetch(places, chunks, "contig", "modal_three_prime", C.POLYA_WINDOW, CHUNK), R.has_a_run("bases")
        found = materialise(intergenic.score(places, recs, keys, bases, repeats, polya, run, barcodes=counts).drop("bases"), "loci")
        umis = counts.select(*keys, "cell_barcode", "category", "n_umis")
        moved = intergenic.reallocate(counts, clustered, found, keys)
        counts = materialise(moved.join(umis, [*keys, "cell_barcode", "category"], "left").withColumn("n_umis", F.coalesce("n_umis", F.lit(0))), "counts")
    flags = metrics.cell_flags(got, [*keys, "cell_barcode"])
    unstranded = s.platform == "smartseq"
    cells = materialise(metrics.cell_metrics(counts, keys, flags, unstranded=unstranded), "cells")
    one = metrics.sample_metrics(counts, cells, keys, unstranded)
    sums = flags.groupBy(*keys).agg(*[F.sum(f).alias(f) for f in metrics.FLAGS])
    sense = got.where("category = 'exonic_sense'").withColumn("ref_end", R.ref_end())
    if polya is not None:
        sense_at = intervals.near(sense.withColumn("_p", R.three_prime()), polya, ["contig"], "_p", C.POLYA_SITE_DISTANCE)
        full = metrics.full_length(sense_at, keys, "is_near")
    else:
        full = metrics.full_length(sense, keys, None, C.FULL_LENGTH_MIN.get(s.platform, C.FULL_LENGTH_MIN_DEFAULT))
    one = one.join(total, keys, "left").join(sums, keys, "left").join(full.select(*keys, "full_length_read_frac"), keys, "left")
    if s.tss_sites:
        t = intervals.near(sense.withColumn("_p", R.five_prime()), site_list(spark, s.tss_sites, s, contigs), ["contig"], "_p", C.TSS_DISTANCE)
        one = one.join(metrics.full_length(t, keys, "is_near").select(*keys, F.col("full_length_read_frac").alias("tss_anchored_frac")), keys, "left")
    if s.numt:
        n = text.parse_intervals(text.lines(spark, s.numt)).agg(F.count(F.lit(1)).cast("double").alias("numt_interval_count"))
        one = one.join(F.broadcast(n))  # one row
    strata = metrics.length_stratification(metrics.length_bins(got, keys), metrics.median_length(got, keys), keys)
    out = {"reads": got, "counts": counts, "cells": cells, "sample": materialise(one, "sample"), "strata": strata, "totals": metrics.sample_totals(counts, keys)}
    if found is not None:
        out["loci"] = found
    if s.obs:
        out["clusters"] = metrics.cluster_metrics(cells, text.read_obs(spark, s.obs))
    if s.paired:
        pairs = got.where(R.is_insert())
        out["inserts"] = pairs.select(*keys, F.when(F.col("category") == "exonic_sense", "signal").otherwise("noise").alias("panel"), F.abs("tlen").alias("size"))
    return out


def write_sample(out: dict[str, DataFrame], folder: str, name: str, s: Settings | None = None) -> None:
    """Every file of a run."""
    at = lambda f: sinks.out(folder, f"{name}.{f}")
    sinks.write_tsv(sinks.read_metrics(out["sample"], ["sample_id"]), at("read_metrics.tsv"))
    sinks.write_tsv(out["cells"], at("cell_metrics.tsv"), single=False)
    sinks.write_summary(out["sample"], at("summary.json"))
    sinks.write_tsv(sinks.length_table(out["strata"]), at("length_stratified.tsv"))
    sinks.write_length_samples(metrics.hashed_sample(out["reads"].where("read_length > 0"), ["category"], "read_id", 5000), at("length_samples"))
    if "loci" in out:
        sinks.write_tsv(sinks.loci_table(out["loci"]), at("intergenic_loci.tsv"), single=False)
    if "clusters" in out:
        sinks.write_tsv(out["clusters"], at("cluster_metrics.tsv"))
    reports.write_run(out, at("report.html"), name, s or Settings(gtf=""))


def run_plate(spark: SparkSession, wells: DataFrame, reads: DataFrame, s: Settings, sheet: DataFrame | None = None, contigs: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """Per-well metrics of plates in one plan; ``reads`` has ``plate_id, well_id``.  Reads are classified once; loci are found per plate."""
    index, chunks = build_index(spark, s), _reference(spark, s)
    got = materialise(classify_reads(spark, reads, s, index, contigs, chunks), "classified")
    total = materialise(reads.groupBy("plate_id", "well_id").agg(F.count(F.lit(1)).alias("n_reads_total")), "totals")
    well = F.concat_ws("/", "plate_id", "well_id").alias("sample_id")
    per_well = tables(spark, got.withColumn("sample_id", well), total.select(well, "n_reads_total"), s, index, contigs, chunks, False)
    plates = total.groupBy(F.col("plate_id").alias("sample_id")).agg(F.sum("n_reads_total").alias("n_reads_total"))
    plate = tables(spark, got.withColumn("sample_id", F.col("plate_id")), plates, s, index, contigs, chunks, True)
    parts = F.split("sample_id", "/")
    rows = per_well["sample"].withColumn("plate_id", parts[0]).withColumn("well_id", parts[1]).drop("sample_id")
    full = wells.join(rows, ["plate_id", "well_id"], "left")
    return {"wells": sheets.with_sheet(full, sheet) if sheet is not None else full, **plate}


def load_plate(spark: SparkSession, wells: DataFrame, s: Settings) -> DataFrame:
    """The reads of all wells (``plate_id, well_id, bam``) in one scan, each with its well."""
    files = wells.select(F.col("bam").alias("file"), "plate_id", "well_id")
    paths = [r.file for r in files.collect()]  # a row a well
    return lookup_join(load(spark, paths, s.barcode_tag, s.umi_tag), files, ["file"])


def run_compare(spark: SparkSession, a: DataFrame, b: DataFrame, s: Settings, contigs: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """Two samples side by side, without the paired rule and without loci."""
    plain = Settings(**{**s.__dict__, "platform": "unknown"})
    both = a.withColumn("sample_id", F.lit("a")).unionByName(b.withColumn("sample_id", F.lit("b")))
    out = run_sample(spark, both, plain, contigs=contigs, profile=False)
    long = metrics.long_metrics(out["sample"], ["sample_id"])
    out["metrics"] = compare.metric_deltas(long.where("sample_id = 'a'"), long.where("sample_id = 'b'"))
    out["stats"] = compare.chi2(out["totals"].select("sample_id", "category", "n_reads"), "sample_id", "a", "b")
    return out


def write_compare(out: dict[str, DataFrame], folder: str, labels: tuple[str, str], s: Settings | None = None) -> None:
    """Both tables of a comparison and its report, with the samples' labels."""
    a, b = labels
    sinks.write_tsv(out["metrics"].orderBy("metric").withColumnsRenamed({"value_a": a, "value_b": b}), sinks.out(folder, "comparison.metrics.tsv"))
    sinks.write_tsv(out["stats"].orderBy(figures.category_rank()).withColumnsRenamed({"frac_a": f"frac_{a}", "frac_b": f"frac_{b}"}), sinks.out(folder, "comparison.stats.tsv"))
    reports.write_compare(out, sinks.out(folder, "comparison.report.html"), labels, s or Settings(gtf=""))


def discover(folder: str) -> list[dict]:
    """What each alignment file of a folder is, with what keeps it from being run."""
    found = []
    for f in sorted(os.listdir(folder)):
        if f.endswith(".bam"):
            path = os.path.join(folder, f)
            has = os.path.exists(path + ".bai")
            try:
                info = headers.inspect(bam.header_text(path), has_index=has)
            except (OSError, ValueError) as e:
                info = {"platform": "unknown", "issues": [f"inspection failed: {e}"]}
            found.append({"path": path, **info})
    return found


def format_discovery(found: list[dict]) -> str:
    """A line per file."""
    return "\n".join(f"{i + 1:>3}  {os.path.basename(x['path'])}  {x['platform']}  {x.get('stage', '')}  {'; '.join(x['issues']) or 'ready'}" for i, x in enumerate(found))


def select_files(found: list[dict], answer: str) -> list[dict]:
    """Files by an answer such as ``1,3-4`` or ``all``; unknown numbers raise."""
    ready = list(range(1, len(found) + 1))
    if answer.strip().lower() == "all":
        return [found[i - 1] for i in ready if not found[i - 1]["issues"]]
    chosen: list[int] = []
    for part in filter(None, (p.strip() for p in answer.split(","))):
        a, _, b = part.partition("-")
        chosen += range(int(a), int(b or a) + 1)
    if bad := [i for i in chosen if i not in ready]:
        raise ValueError(f"no such file: {bad}")
    return [found[i - 1] for i in dict.fromkeys(chosen)]
