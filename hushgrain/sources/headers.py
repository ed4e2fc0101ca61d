"""What an alignment file's header tells: contigs, platform, stage, chemistry, issues.

Header texts are a few kilobytes; the rules are plain functions for one file and columns
over tables of many.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names in header lines that tell tools, platforms, stages and chemistries.
ALIGNERS = (("minimap2", "ont"), ("pbmm2", "pacbio"), ("star", "illumina_10x"), ("starsolo", "illumina_10x"), ("cellranger", "illumina_10x"), ("bwa", "unknown"))
PIPELINE_NAMES = ("cellranger", "spaceranger", "starsolo", "star", "wf-single-cell", "guppy", "dorado", "bonito", "isoseq3", "pbmm2", "skera", "lima")
ONT = ("wf-single-cell", "guppy", "dorado", "bonito", "ont")
PACBIO = ("isoseq3", "pbmm2", "skera", "lima", "ccs", "kinnex")
DROPLET = ("cellranger", "starsolo", "spaceranger")
BD = ("rhapsody", "bd", "seven-bridges")
POST_FILTER = ("wf-single-cell", "cellranger", "starsolo")
BD_CHEMISTRY = ("rhapsody", "flashbd", "flash-seq", "flash_seq", "bd rhapsody")
TENX, TENX_V4 = ("10x", "chromium", "gem-x"), ("v4", "gem-x", "4.0")
MIN_BARCODE_FRACTION = 0.5


def parse(text: str) -> dict[str, list[dict[str, str]]]:
    """Header text to records by type; comments are under ``CO`` as ``{"": text}``."""
    out: dict[str, list[dict[str, str]]] = {}
    for line in text.splitlines():
        kind, _, rest = line.partition("\t")
        if kind == "@CO":
            out.setdefault("CO", []).append({"": rest})
        elif kind.startswith("@"):
            out.setdefault(kind[1:], []).append(dict(f.split(":", 1) for f in rest.split("\t") if ":" in f))
    return out


def hints(header: dict) -> list[str]:
    """Program names and identifiers in lower case, and known tools named in command lines."""
    found: list[str] = []
    for p in header.get("PG", []):
        found += [p[k].lower() for k in ("ID", "PN") if p.get(k)]
        found += [n for n in PIPELINE_NAMES if n in p.get("CL", "").lower()]
    return list(dict.fromkeys(found))


def _any(found: list[str], signals: tuple[str, ...]) -> bool:
    return any(s in h for h in found for s in signals)


def aligner(header: dict) -> tuple[str, str]:
    """The first program that is a known aligner, and the platform it stands for."""
    for p in header.get("PG", []):
        for name, platform in ALIGNERS:
            if name in p.get("ID", "").lower():
                return p["ID"], platform
    return "", "unknown"


def platform(header: dict) -> str:
    found = hints(header)
    if _any(found, ONT):
        return "ont"
    if _any(found, PACBIO):
        return "pacbio"
    if _any(found, DROPLET):
        return "illumina_bd" if _any(found, BD) else "illumina_10x"
    return "smartseq" if _any(found, ("star",)) else aligner(header)[1]


def stage(header: dict) -> str:
    found = hints(header)
    if _any(found, POST_FILTER):
        return "post_filter"
    if _any(found, ("isoseq3",)):
        return "pre_filter" if _any(found, ("refine",)) else "raw"
    return "pre_filter" if aligner(header)[0] else "custom"


def chemistry(header: dict) -> tuple[str, str]:
    """Chemistry and where it was found: ``header``, ``rg`` or ``unknown``."""
    text = " ".join([*(c[""] for c in header.get("CO", [])), *(p.get(k, "") for p in header.get("PG", []) for k in ("CL", "PN", "ID"))]).lower()
    if any(t in text for t in BD_CHEMISTRY):
        return "bd_rhapsody_wta", "header"
    if any(t in text for t in TENX):
        return ("10x_v4" if any(t in text for t in TENX_V4) else "10x_v3"), "header"
    for r in header.get("RG", []):
        d = r.get("DS", "").lower()
        if "10x" in d or "chromium" in d:
            return "10x_v3", "rg"
        if "rhapsody" in d or "bd" in d:
            return "bd_rhapsody_wta", "rg"
    return "unknown", "unknown"


def inspect(text: str, barcode_fraction: float | None = None, has_index: bool = True) -> dict:
    """One file's facts with the issues that keep it from being run."""
    if not has_index:
        return {"platform": "unknown", "stage": "custom", "chemistry": "unknown", "sort_order": "", "contigs": {}, "issues": ["no index"]}
    h = parse(text)
    order = next((r.get("SO", "") for r in h.get("HD", [])), "")
    st = stage(h)
    if barcode_fraction is not None:
        if barcode_fraction >= MIN_BARCODE_FRACTION:
            st = "post_filter"
        elif st not in ("pre_filter", "raw"):
            st = "pre_filter"
    pf = platform(h)
    contigs = {s["SN"]: int(s["LN"]) for s in h.get("SQ", [])}
    issues = [x for bad, x in ((order and order.lower() != "coordinate", f"sort order is {order}"), (pf == "unknown", "platform unknown"), (not contigs, "no contigs in the header")) if bad]
    return {"platform": pf, "stage": st, "chemistry": chemistry(h)[0], "sort_order": order, "contigs": contigs, "issues": issues}


def check_order(sort_order: str) -> None:
    if sort_order and sort_order != "coordinate":
        raise ValueError(f"alignments must be sorted by coordinate, not {sort_order}")


# --- the same rules over a column with an array of hints in lower case ---


def _has(found: Column, signals: tuple[str, ...]) -> Column:
    return F.exists(found, lambda h: h.rlike("|".join(s.replace(".", r"\.") for s in signals)))


def platform_of(found: Column) -> Column:
    return F.when(_has(found, ONT), "ont").when(_has(found, PACBIO), "pacbio").when(_has(found, DROPLET), F.when(_has(found, BD), "illumina_bd").otherwise("illumina_10x")).when(_has(found, ("star",)), "smartseq").otherwise("unknown")


def stage_of(found: Column) -> Column:
    return F.when(_has(found, POST_FILTER), "post_filter").when(_has(found, ("isoseq3",)), F.when(_has(found, ("refine",)), "pre_filter").otherwise("raw")).when(_has(found, tuple(n for n, _ in ALIGNERS)), "pre_filter").otherwise("custom")


def chemistry_of(text: Column) -> Column:
    t = F.lower(text)
    hit = lambda names: t.rlike("|".join(n.replace(".", r"\.") for n in names))
    return F.when(hit(BD_CHEMISTRY), "bd_rhapsody_wta").when(hit(TENX), F.when(hit(TENX_V4), "10x_v4").otherwise("10x_v3")).otherwise("unknown")


def normalised_platform(c: Column) -> Column:
    """The two droplet platforms are shown as one."""
    return F.when(c.isin("illumina_10x", "illumina_bd"), "illumina").otherwise(c)


def is_illumina(c: Column) -> Column:
    return F.coalesce(F.startswith(c, F.lit("illumina")) | (c == "smartseq"), F.lit(False))
