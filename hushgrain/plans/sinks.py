"""What a run writes: tables as TSV folders, summaries as JSON, a report as HTML.

Tables are written by Spark.  Only bounded summaries (a row per sample, category or cluster,
or a top-k) come to the driver, for JSON and the report.
"""

from __future__ import annotations

import html
import json
import math
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushgrain import constants as C

# The scalars of the metrics table, in order.
READ_METRICS = ("n_reads_total", "n_reads_classified", "n_reads_unassigned", "n_cells", "noise_read_frac", "noise_base_frac", "strand_concordance", "chimeric_read_frac", "multimapper_read_frac", "n_tso", "n_polya", "n_noncanon", "per_cell_noise_median", "per_cell_noise_iqr")
SUMMARY = ("noise_read_frac", "noise_base_frac", "noise_read_frac_strict", "noise_base_frac_strict", "strand_concordance", "chimeric_read_frac", "multimapper_read_frac", "n_cells", "n_reads_classified", "per_cell_noise_median", "per_cell_noise_iqr")
# Names in the written tables that differ from the columns'.
WRITTEN = {"n_tso": "n_tso_invasion", "n_polya": "n_polya_priming", "n_noncanon": "n_noncanon_junction", "start_pos": "start", "end_pos": "end"}
LOCI = ("contig", "start_pos", "end_pos", "strand", "n_reads", "n_barcodes", "has_splice_evidence", "is_monoexonic", "polya_run_downstream", "near_polya_site", "poisson_pvalue_adj", "category")


def write_tsv(df: DataFrame, path: str, single: bool = True) -> None:
    """One header line and tab-separated rows; null is empty.  ``single`` is for bounded tables."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="", emptyValue="")


def shown(c: str, kind: str) -> Column:
    return F.coalesce(F.format_string("%.6f", F.bround(F.col(c), 6)) if kind == "double" else F.col(c).cast("string"), F.lit("nan"))


def read_metrics(sample: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., metric, value``: scalars as they are, fractions with six digits; strict noise is no part of this table."""
    kinds = dict(sample.dtypes)
    names = [n for n in (*READ_METRICS, "full_length_read_frac", *(f"read_frac_{c}" for c in C.CATEGORY_ORDER), *(f"base_frac_{c}" for c in C.CATEGORY_ORDER)) if n in kinds]
    names = [*dict.fromkeys(names)]
    written = [WRITTEN.get(n, n) for n in names]
    return sample.select(*keys, *[shown(n, kinds[n]).alias(w) for n, w in zip(names, written)]).unpivot(keys, written, "metric", "value")


def summary_json(sample: DataFrame, name: str = "sample_id") -> DataFrame:
    """``name, json``: the summary of each sample, numbers rounded half to even to four digits."""
    kinds = dict(sample.dtypes)
    names = [n for n in (*SUMMARY, *(f"read_frac_{c}" for c in C.CATEGORY_ORDER), "full_length_read_frac") if n in kinds]
    cols = [(F.bround(n, 4) if kinds[n] == "double" else F.col(n)).alias(n) for n in names]
    return sample.select(name, F.to_json(F.struct(*cols)).alias("json"))


def write_summary(sample: DataFrame, path: str, tool: str = "read_noise", name: str = "sample_id") -> None:
    """``{"id": tool, "data": {sample: {...}}}``; one row a sample comes to the driver."""
    data = {r[name]: json.loads(r["json"]) for r in summary_json(sample, name).toLocalIterator()}
    with open(path, "w") as f:
        json.dump({"id": tool, "data": data}, f, indent=2)


def per_well_rows(wells: DataFrame) -> DataFrame:
    """Fractions as text with four digits, and the extra columns of the sheet as JSON."""
    cols = []
    for c, t in wells.dtypes:
        cols.append(F.format_string("%.4f", F.bround(F.col(c), 4)).alias(c) if t == "double" else F.to_json(c).alias(c) if t.startswith("map") else F.col(c))
    return wells.select(*cols)


def length_table(strata: DataFrame) -> DataFrame:
    """The stratified lengths in the order of bins and categories."""
    rank = F.array_position(F.array(*[F.lit(c) for c in C.CATEGORY_ORDER]), F.col("category"))
    return strata.orderBy("bin_order", rank).drop("bin_order")


def loci_table(loci: DataFrame) -> DataFrame:
    return loci.select(*[F.col(c).alias(WRITTEN.get(c, c)) for c in LOCI])


def write_length_samples(reads: DataFrame, path: str) -> None:
    """One folder per category."""
    reads.select("category", "read_length").write.mode("overwrite").partitionBy("category").csv(path, sep="\t", header=True)


def _first(df: DataFrame, most: int) -> tuple[list, str]:
    """Up to ``most`` rows, and a note where there are more."""
    rows = df.limit(most + 1).collect()
    return rows[:most], f"<p>The first {most:,} of {df.count():,} rows; the tables beside this page have all.</p>" if len(rows) > most else ""


def table_html(df: DataFrame, most: int = 500) -> str:
    """A table as HTML; of a long one the first rows and a note that says so."""
    got, note = _first(df, most)
    rows = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else f'{v:.4g}' if isinstance(v, float) and not math.isnan(v) else str(v))}</td>" for v in r) + "</tr>" for r in got)
    return "<table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + f"</tr>{rows}</table>{note}"


def bars_html(df: DataFrame, label: str, value: str, most: int = 200) -> str:
    """A bar per row, in plain HTML."""
    rows, note = _first(df.select(label, value), most)
    top = max((abs(r[value] or 0) for r in rows), default=0) or 1
    return "".join(f'<div class="bar"><span>{html.escape(str(r[label]))}</span><i style="width:{100 * abs(r[value] or 0) / top:.1f}%"></i><b>{(r[value] or 0):.4f}</b></div>' for r in rows) + note


def pairs_html(rows: list[tuple[str, str]]) -> str:
    """Names and values in two columns."""
    return "<table>" + "".join(f"<tr><th>{html.escape(k)}</th><td>{html.escape(v)}</td></tr>" for k, v in rows) + "</table>"


_STYLE = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 8px}.bar span{display:inline-block;width:14em}.bar i{display:inline-block;height:.8em;background:#47a;max-width:50%}.bar b{font-weight:normal;margin-left:.5em}"


def write_report(path: str, title: str, sections: list[tuple[str, str]], warnings: list[str] = ()) -> None:
    """A self-contained page of titled sections."""
    warn = "".join(f"<li>{html.escape(w)}</li>" for w in warnings)
    body = "".join(f"<h2>{html.escape(t)}</h2>{x}" for t, x in sections)
    page = f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{_STYLE}</style></head><body><h1>{html.escape(title)}</h1>{f'<ul>{warn}</ul>' if warn else ''}{body}</body></html>"
    with open(path, "w") as f:
        f.write(page)


def out(folder: str, name: str) -> str:
    os.makedirs(folder, exist_ok=True)
    return os.path.join(folder, name)
