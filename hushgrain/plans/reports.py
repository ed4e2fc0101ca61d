"""The report pages of a run and of a comparison.

A page is a list of titled sections over small tables: a row per sample, category, bin, cluster, or a
top-k.  Which sections there are depends on the platform: short paired reads have insert sizes
in the place of read lengths.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushgrain.operators import figures, metrics
from hushgrain.plans import sinks

SHORT_NOTE = "Short reads: the shares of ends at known sites tell how close read ends lie, not how many transcripts were read in full; they do not compare with those of long reads."
UNSTRANDED_NOTE = "Unstranded protocol: about a third of the reads lie antisense by design, so noise leaves them out and a strand concordance near one half is expected."
PLATE_NOTE = "Both reads of a pair sample an end of the molecule, so shares of ends at known sites compare between such runs, not with long reads."


def _percent(v: float | None, note: str = "") -> str:
    return "n/a" if v is None else f"{v:.2%}{' (' + note + ')' if note else ''}"


def facts(row: dict, s) -> list[tuple[str, str]]:
    """What is known of a sample, as names and values."""
    smart, cells = s.platform == "smartseq", row.get("n_cells") or 0
    out = [("Sample", str(row["sample_id"])), ("Platform", s.platform), ("Pipeline stage", "n/a (a file per cell)" if smart else s.stage or "unknown")]
    out += [("Reads", f"{row.get('n_reads_total') or 0:,}"), ("Classified reads", f"{row['n_reads_classified']:,}"), ("Cells", f"{cells:,}" if cells > 1 else "n/a (no barcodes)")]
    out += [("Noise, conservative (reads)", _percent(row["noise_read_frac"], "with intronic reads, an upper bound")), ("Noise, strict (reads)", _percent(row["noise_read_frac_strict"], "a lower bound")), ("Noise (bases)", _percent(row["noise_base_frac"]))]
    out += [("Strand concordance", "about 50% (unstranded)" if smart else _percent(row["strand_concordance"])), ("Chimeric reads", _percent(row["chimeric_read_frac"]))]
    if row.get("full_length_read_frac") is not None:
        out.append(("3' ends at known sites", _percent(row["full_length_read_frac"], "within 50 bases")) if s.polya_sites else ("Full-length reads", _percent(row["full_length_read_frac"], "by length")))
    if row.get("tss_anchored_frac") is not None:
        out.append(("5' ends at known starts", _percent(row["tss_anchored_frac"], "within 100 bases")))
    if row.get("numt_interval_count") is not None:
        out.append(("NUMT intervals", f"{int(row['numt_interval_count']):,}"))
    for name, path in (("Called cells", s.called_cells), ("Annotation", s.gtf), ("Poly-A sites", ", ".join(map(os.path.basename, s.polya_sites))), ("Transcription starts", ", ".join(map(os.path.basename, s.tss_sites)))):
        out.append((name, os.path.basename(path) if name in ("Called cells", "Annotation") and path else path or "none"))
    return out + list(s.facts)


def _binned(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    ends = figures.histogram(df, keys, value, bins)
    return ends.select(*keys, "bin", "count", F.round("percent", 3).alias("percent")).orderBy(*keys, "bin")


def run_sections(out: dict[str, DataFrame], s) -> tuple[list[tuple[str, str]], list[str]]:
    """The sections of a run's page, and its warnings."""
    short = s.platform.startswith("illumina")
    paired = short or s.platform == "smartseq"
    k, warnings = ["sample_id"], list(s.warnings)
    totals = out["totals"].withColumn("label", F.concat_ws(" ", "sample_id", "category"))
    label = lambda df: df.withColumn("label", F.concat_ws(" ", "sample_id", "category")).orderBy("sample_id", "rank")
    sections = [(f"Sample {r['sample_id']}", sinks.pairs_html(facts(r.asDict(), s))) for r in out["sample"].orderBy("sample_id").limit(100).collect()]
    sections += [("Noise", sinks.bars_html(label(figures.noise_overview(totals, k)), "label", "read_frac")), ("Categories", sinks.table_html(figures.legend(totals.sparkSession)))]
    sections += [(f"Share of {unit}s", sinks.bars_html(label(figures.fraction_bar(totals, k, f"{unit}_frac")), "label", "fraction")) for unit in ("read", "base")]
    if not paired:
        sections.append(("Noise by read length", sinks.table_html(sinks.length_table(out["strata"]))))
    if not out["cells"].isEmpty():
        sections.append(("Noise per cell", sinks.table_html(_binned(figures.violin(out["cells"], k), k, "noise_read_frac", 20))))
    if not paired:
        sections.append(("Read lengths", sinks.table_html(_binned(out["reads"].where("read_length > 0"), ["category"], "read_length", 20), 1000)))
    rates = figures.artifact_rates(metrics.cell_flags(out["reads"], [*k, "cell_barcode"]), out["totals"], k)
    sections.append(("Artifacts", sinks.table_html(rates)))
    if paired:
        if "inserts" in out and not out["inserts"].isEmpty():
            sections.append(("Insert sizes", sinks.table_html(_binned(out["inserts"], ["panel"], "size", 50))))
        else:
            warnings.append("No read is properly paired, so there are no insert sizes.")
        warnings.append(SHORT_NOTE if short else PLATE_NOTE)
        if not short:
            warnings.append(UNSTRANDED_NOTE)
    if "loci" in out and not out["loci"].isEmpty():
        top = figures.top_loci(out["loci"], k).withColumn("place", F.format_string("%s:%d-%d", "contig", "start_pos", "end_pos"))
        sections.append(("Top intergenic loci", sinks.bars_html(top, "place", "n_reads") + sinks.table_html(sinks.loci_table(top))))
    if "clusters" in out and not out["clusters"].isEmpty():
        sections += [("Clusters", sinks.table_html(figures.cluster_bars(out["clusters"]))), ("Clusters, all medians", sinks.table_html(figures.cluster_heatmap(out["clusters"])))]
    return sections, warnings


def write_run(out: dict[str, DataFrame], path: str, name: str, s) -> None:
    sections, warnings = run_sections(out, s)
    sinks.write_report(path, name, sections, warnings)


def compare_sections(out: dict[str, DataFrame], labels: tuple[str, str], s) -> tuple[list[tuple[str, str]], list[str]]:
    """The sections of a comparison's page, and its warnings."""
    named = F.when(F.col("sample_id") == "a", labels[0]).otherwise(labels[1]).alias("sample")
    stats, warnings = out["stats"], list(s.warnings)
    wide = out["sample"].select(named, "n_reads_total", "n_cells", "noise_read_frac", "noise_base_frac", "strand_concordance", "chimeric_read_frac").orderBy("sample")
    bars = figures.compare_bars(stats).orderBy(figures.category_rank())
    sections = [("Samples", sinks.table_html(wide)), ("Shares of reads", sinks.table_html(bars.withColumnsRenamed({"frac_a": labels[0], "frac_b": labels[1]}))), ("Differences", sinks.bars_html(figures.delta_plot(stats).orderBy(figures.category_rank()).withColumn("label", F.concat_ws(" ", "category", "stars")), "label", "delta"))]
    if out["sample"].agg(F.min("n_cells")).first()[0] > 1:
        sections.append(("Noise per cell", sinks.table_html(_binned(out["cells"].select(named, "noise_read_frac"), ["sample"], "noise_read_frac", 20))))
    else:
        warnings.append("Cells are not compared: a sample has no barcodes.")
    lengths = out["reads"].where("read_length > 0 AND category = 'exonic_sense'")
    if not lengths.isEmpty():
        sections.append(("Lengths of sense reads", sinks.table_html(_binned(lengths.select(named, "read_length"), ["sample"], "read_length", 60))))
    return sections, warnings


def write_compare(out: dict[str, DataFrame], path: str, labels: tuple[str, str], s) -> None:
    sections, warnings = compare_sections(out, labels, s)
    sinks.write_report(path, f"{labels[0]} and {labels[1]}", sections, warnings)
