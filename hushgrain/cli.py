"""Command line: ``python -m hushgrain.cli run|run-plate|compare|discover ...``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hushgrain import __version__
from hushgrain import constants as C
from hushgrain.plans import checks, sinks
from hushgrain.plans import run as plans
from hushgrain.sources import bam, fetch, sheets


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="hushgrain")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--output-dir", required=True)
    shared.add_argument("--gtf", help="annotation; without it the newest cached release or the latest published")
    shared.add_argument("--gtf-version", type=int, help="a release of the annotation")
    shared.add_argument("--barcode-whitelist")
    shared.add_argument("--whitelist-db", choices=("10x_v3", "10x_v4", "none"), default="none")
    shared.add_argument("--barcode-tag", default="CB")
    shared.add_argument("--umi-tag", default="UB")
    shared.add_argument("--chemistry", default="10x_v3", help="accepted, changes nothing")
    shared.add_argument("--platform", choices=("auto", *C.PLATFORMS), default="auto")
    shared.add_argument("--pipeline-stage", choices=("auto", *C.STAGES), default="auto")
    shared.add_argument("--chimeric-distance", type=int, default=C.CHIMERIC_DISTANCE)
    for name in ("reference", "repeats", "obs-metadata", "numt-bed"):
        shared.add_argument(f"--{name}")
    shared.add_argument("--threads", type=int, default=4, help="accepted; Spark's master sets the cores")
    shared.add_argument("--no-umi-dedup", action="store_true")
    shared.add_argument("--cache-dir", help="folder that all executors share; by default in the home directory of a local session")
    shared.add_argument("--no-cache", action="store_true", help="neither read nor write the cache of annotation and sites")
    shared.add_argument("--exclude-biotypes", action="append", default=[], help="repeatable, or separated by commas")
    shared.add_argument("--polya-sites", action="append", default=[])
    shared.add_argument("--polya-db", choices=("polyasite3", "polyadb4", "both", "none"), default="polyasite3")
    shared.add_argument("--tss-sites", action="append", default=[])
    shared.add_argument("--tss-db", choices=("fantom5", "none"), default="fantom5")
    shared.add_argument("--offline", action="store_true", help="use cached files only")
    shared.add_argument("-v", "--verbose", action="store_true")
    r = sub.add_parser("run", parents=[shared])
    r.add_argument("--bam", required=True)
    r.add_argument("--sample-name")
    r.add_argument("--cell-barcodes")
    c = sub.add_parser("compare", parents=[shared])
    for x in "ab":
        c.add_argument(f"--bam-{x}", required=True)
        c.add_argument(f"--label-{x}", default=f"sample_{x.upper()}")
    w = sub.add_parser("run-plate", parents=[shared])
    w.add_argument("--plate-dir", required=True)
    w.add_argument("--sample-sheet")
    w.add_argument("--sequencer", default="none")
    w.add_argument("--plate-id", action="append")
    w.add_argument("--parallel-wells", type=int, default=1, help="accepted; all wells are one plan")
    d = sub.add_parser("discover", parents=[shared])
    d.add_argument("--bam-dir", required=True)
    d.add_argument("--select", help="numbers of files such as 1,3-4, or all")
    d.add_argument("--run-all", action="store_true")
    return p


def cache_dir(a: argparse.Namespace) -> str:
    return a.cache_dir or os.path.join(os.path.expanduser("~"), ".cache", "hushgrain")


def warn(text: str) -> None:
    print(f"warning: {text}", file=sys.stderr)


def settings(a: argparse.Namespace, refs: fetch.References, platform: str = "unknown", stage: str | None = None) -> plans.Settings:
    biotypes = [x for part in a.exclude_biotypes for x in part.split(",") if x]
    return plans.Settings(
        gtf=refs.gtf, whitelist=refs.whitelist, called_cells=getattr(a, "cell_barcodes", None), reference=a.reference, polya_sites=refs.polya_sites, tss_sites=refs.tss_sites, repeats=a.repeats, numt=a.numt_bed, obs=a.obs_metadata,
        platform=platform if a.platform == "auto" else a.platform, stage=stage if a.pipeline_stage == "auto" else a.pipeline_stage, barcode_tag=a.barcode_tag, umi_tag=a.umi_tag, distance=a.chimeric_distance, umi_dedup=not a.no_umi_dedup,
        exclude_biotypes=biotypes, cache=None if a.no_cache or not (a.cache_dir or _is_local()) else os.path.join(cache_dir(a), "tables"),
    )


def _is_local() -> bool:
    spark = SparkSession.getActiveSession()
    return spark is not None and spark.sparkContext.master.startswith("local")


def references(a: argparse.Namespace) -> fetch.References:
    f = fetch.Fetcher(cache_dir(a), a.offline)
    refs = fetch.references(f, a.gtf, a.gtf_version, a.polya_sites, a.polya_db, a.tss_sites, a.tss_db, a.barcode_whitelist, a.whitelist_db)
    for line in f.log:
        print(line, file=sys.stderr)
    return refs


def run_file(spark: SparkSession, a: argparse.Namespace, refs: fetch.References, path: str, name: str) -> bool:
    """One file; whether there was anything to classify."""
    info = plans.header(spark, path)
    index = bam.read_index(path) if path.endswith(".bam") else None
    s = settings(a, refs, info["platform"], info.get("stage"))
    if not path.endswith(".parquet"):
        s.warnings += checks.before_run(spark, info, refs.gtf, a.reference, (refs.gtf_version, refs.polya_version), index and index[1])
        if index and index[1][0] == 0:
            warn(f"{path}: no read is mapped, nothing to classify")
            return False
    reads = plans.load(spark, path, a.barcode_tag, a.umi_tag)
    if a.pipeline_stage != "auto" or s.called_cells:
        found = checks.barcodes(checks.barcode_fraction(reads), s.stage if a.pipeline_stage != "auto" else None, bool(s.called_cells), s.platform)
        s.warnings += found
        if found:
            s.called_cells = None
    for w in s.warnings:
        warn(w)
    out = plans.run_sample(spark, reads, s, name=name, contigs=info["contigs"] or None)
    plans.write_sample(out, a.output_dir, name, s)
    one = out["sample"].first()
    print(f"{name}  {one.n_reads_classified} reads  noise {one.noise_read_frac:.4f}")
    return True


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("hushgrain").getOrCreate()
    if a.verbose:
        spark.sparkContext.setLogLevel("INFO")
    refs = references(a)
    if a.command == "run":
        run_file(spark, a, refs, a.bam, a.sample_name or os.path.splitext(os.path.basename(a.bam))[0])
    elif a.command == "compare":
        s = settings(a, refs)
        infos = [plans.header(spark, p) for p in (a.bam_a, a.bam_b)]
        for info in infos:
            if info["contigs"]:
                s.warnings += checks.before_run(spark, info, refs.gtf, a.reference, (refs.gtf_version, refs.polya_version))
        s.warnings = list(dict.fromkeys(s.warnings))
        both = [plans.load(spark, p, a.barcode_tag, a.umi_tag) for p in (a.bam_a, a.bam_b)]
        out = plans.run_compare(spark, *both, s, infos[0]["contigs"] or None)
        plans.write_compare(out, a.output_dir, (a.label_a, a.label_b), s)
    elif a.command == "run-plate":
        files = [os.path.join(d, f) for d, _, fs in os.walk(a.plate_dir) for f in fs if f.endswith(".bam")]
        wells = sheets.plate_wells(spark.createDataFrame([(f,) for f in files], "path string"))
        if a.plate_id:
            missing = set(a.plate_id) - {r.plate_id for r in wells.select("plate_id").distinct().collect()}
            if missing:
                raise SystemExit(f"no such plates: {', '.join(sorted(missing))}")
            wells = wells.where(F.col("plate_id").isin(*a.plate_id))
        first = wells.orderBy("plate_id", "well_id").first()
        if first is None:
            raise SystemExit("no wells found")
        info = plans.header(spark, first.bam)
        s = settings(a, refs, info["platform"], info["stage"])
        s.warnings += checks.before_run(spark, info, refs.gtf, a.reference, (refs.gtf_version, refs.polya_version))
        sheet = sheets.read_sheet(spark, a.sample_sheet, a.sequencer) if a.sample_sheet else None
        if sheet is not None:
            lonely, lost = sheets.unmatched(wells, sheet)
            s.warnings += [f"well {r.plate_id}/{r.well_id} is not in the sheet" for r in lonely.limit(20).collect()] + [f"{r.key} of the sheet has no file" for r in lost.limit(20).collect()]
        out = plans.run_plate(spark, wells.select("plate_id", "well_id"), plans.load_plate(spark, wells, s), s, sheet, info["contigs"] or None)
        sinks.write_tsv(sinks.per_well_rows(out["wells"]), sinks.out(a.output_dir, "per_well_metrics.tsv"))
        plans.write_sample(out, a.output_dir, "plates", s)
    else:
        found = plans.discover(a.bam_dir)
        print(plans.format_discovery(found))
        failed = 0
        for x in plans.select_files(found, a.select or "all") if a.run_all or a.select else []:
            try:
                run_file(spark, a, refs, x["path"], os.path.splitext(os.path.basename(x["path"]))[0])
            except Exception as e:  # one file's failure is no other's
                failed += 1
                warn(f"{x['path']}: {e}")
        return int(failed > 0)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
