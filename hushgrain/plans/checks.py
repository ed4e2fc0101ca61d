"""What is checked of an alignment file and its references before a run.

What makes every result wrong raises :class:`ValueError`; the rest comes back as warnings.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrain import constants as C
from hushgrain.functions import names
from hushgrain.functions import reads as R
from hushgrain.sources import headers, text

# Lengths of some contigs of the human reference, either naming.
KNOWN_LENGTHS = {"chr1": 248_956_422, "chr2": 242_193_529, "chr3": 198_295_559, "chr4": 190_214_555, "chr5": 181_538_259, "chrX": 156_040_895}


def version_gap(gtf: int | None, polya: int | None) -> list[str]:
    if gtf is None or polya is None or abs(gtf - polya) <= C.VERSION_GAP:
        return []
    return [f"the annotation is of release {gtf} but the poly-A sites are of release {polya}; ends that were annotated in between may not count as known"]


def expected_lengths(reference: str | None) -> dict[str, int]:
    """Contig lengths out of the index beside a reference sequence, else the known ones in either naming."""
    if reference and os.path.exists(reference + ".fai"):
        with open(reference + ".fai") as f:
            rows = [line.split("\t") for line in f]
        return {r[0]: int(r[1]) for r in rows if len(r) > 1 and r[1].isdigit()}
    return KNOWN_LENGTHS | {c.removeprefix("chr"): n for c, n in KNOWN_LENGTHS.items()}


def lengths(contigs: dict[str, int], expected: dict[str, int], most: int = 1_000_000, first: int = 3) -> list[str]:
    off = [f"{c} has {contigs[c]:,} bases, expected {n:,}" for c, n in expected.items() if c in contigs and abs(contigs[c] - n) > most]
    return [f"contig lengths differ, perhaps another species or assembly: {'; '.join(off[:first])}"] if off else []


def naming(contigs: dict[str, int], gtf_style: str) -> list[str]:
    """Raises if alignments and annotation name their contigs differently: then nothing would meet."""
    own = names.style(contigs)
    if "unknown" in (own, gtf_style):
        return [f"the naming of contigs is unclear (alignments {own}, annotation {gtf_style})"]
    if own != gtf_style:
        raise ValueError(f"alignments name contigs in {own} style, the annotation in {gtf_style} style")
    return []


def barcode_fraction(reads: DataFrame, n: int = 10_000) -> float:
    """The share with a barcode of the first primary reads (a sampling operator); 0 of none."""
    few = reads.where(R.is_primary()).select("cb").limit(n)
    return few.agg(F.avg(F.when(F.col("cb") != "", 1.0).otherwise(0.0))).first()[0] or 0.0


def before_run(spark: SparkSession, info: dict, gtf: str, reference: str | None, releases: tuple[int | None, int | None] = (None, None), counts: tuple[int, int] | None = None) -> list[str]:
    """All checks of one file; ``info`` is from its header (see ``headers.inspect``), ``counts`` its mapped and unmapped reads if an index tells."""
    headers.check_order(info["sort_order"].lower())
    if not info["contigs"]:
        raise ValueError("the header names no contigs: the reads are not aligned")
    if counts is not None and sum(counts) == 0:
        raise ValueError("the file has no reads")
    warnings = [] if info["sort_order"] else ["the header does not tell the sort order"]
    style = text.gtf_style(text.lines(spark, gtf)).first()[0]
    warnings += naming(info["contigs"], style) + lengths(info["contigs"], expected_lengths(reference)) + version_gap(*releases)
    if counts is not None and counts[0] == 0:
        warnings.append(f"none of {counts[1]:,} reads is mapped")
    return warnings


def barcodes(fraction: float, stage: str | None, has_list: bool, platform: str) -> list[str]:
    """Warnings where cells were promised but reads carry no barcodes."""
    if fraction >= headers.MIN_BARCODE_FRACTION or platform == "smartseq":
        return []
    found = []
    if stage == "post_filter":
        found.append(f"stage is post_filter, but only {fraction:.1%} of the reads have a barcode; all reads are taken as one cell")
    if has_list:
        found.append(f"the list of called cells is ignored, since only {fraction:.1%} of the reads have a barcode")
    return found
