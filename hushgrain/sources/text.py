"""Text inputs: annotation, site lists, barcode lists, cluster tables, alignments, sequences.

Each format has a ``parse_*`` over lines (a DataFrame with a column ``value``) and is read by
:func:`lines`, which takes plain and gzipped files alike.  Malformed lines are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrain.functions import reads as R


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.text(list(paths))


def _field(i: int) -> Column:
    return F.get(F.split("value", "\t"), F.lit(i))


def _attribute(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.get(F.split("value", "\t"), F.lit(8)), f'(?:^|[;\\s]){name} "([^"]*)"', 1), F.lit(""))


def parse_gtf(df: DataFrame) -> DataFrame:
    """``contig, source, feature, s, e, strand, gene_id, gene_name, biotype, transcript_id``; 1-based inclusive becomes 0-based half-open."""
    rows = df.where(~F.startswith("value", F.lit("#")) & (F.size(F.split("value", "\t")) >= 9))
    out = rows.select(
        _field(0).alias("contig"), _field(1).alias("source"), _field(2).alias("feature"), (_field(3).try_cast("long") - 1).alias("s"), _field(4).try_cast("long").alias("e"), _field(6).alias("strand"),
        _attribute("gene_id").alias("gene_id"), _attribute("gene_name").alias("gene_name"), F.coalesce(_attribute("gene_biotype"), _attribute("gene_type")).alias("biotype"), _attribute("transcript_id").alias("transcript_id"),
    )
    return out.where("s IS NOT NULL AND e IS NOT NULL")


def gtf_layers(gtf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gene and exon rows in the form the annotation takes."""
    cols = ["gene_id", "contig", "s", "e", "strand", "biotype"]
    return gtf.where("feature = 'gene'").select(cols), gtf.where("feature = 'exon'").select(cols)


def gtf_style(df: DataFrame, n: int = 200) -> DataFrame:
    """The naming style of the first ``n`` lines that are no comments (a sampling operator)."""
    from hushgrain.operators.sequence import style_vote

    return df.where(~F.startswith("value", F.lit("#")) & (F.trim("value") != "")).limit(n).select(_field(0).alias("contig")).agg(style_vote("contig").alias("style"))


def _bed(df: DataFrame) -> DataFrame:
    rows = df.where(~F.startswith(F.trim("value"), F.lit("#")) & (F.trim("value") != ""))
    return rows.select("value", _field(0).alias("contig"), _field(1).try_cast("long").alias("s"), _field(2).try_cast("long").alias("e")).where("s IS NOT NULL AND e IS NOT NULL")


def parse_sites(df: DataFrame, strip_chr: bool = False) -> DataFrame:
    """``contig, pos``: the middles of BED intervals, each once."""
    contig = F.regexp_replace("contig", "^chr", "") if strip_chr else F.col("contig")
    return _bed(df).select(contig.alias("contig"), F.expr("(s + e) div 2").alias("pos")).distinct()


def parse_intervals(df: DataFrame) -> DataFrame:
    return _bed(df).select("contig", "s", "e")


def parse_repeats(df: DataFrame) -> DataFrame:
    """``contig, s, e, name, strand``; a missing strand is ``.``."""
    return _bed(df).select("contig", "s", "e", _field(3).alias("name"), F.coalesce(F.nullif(_field(5), F.lit("")), F.lit(".")).alias("strand"))


def parse_barcodes(df: DataFrame, strip: bool = False) -> DataFrame:
    """``barcode``: trimmed, not blank, each once; with ``strip`` without one trailing ``-1``."""
    b = F.trim("value")
    return df.where(b != "").select((R.strip_suffix(b) if strip else b).alias("barcode")).distinct()


# Accepted names of the two columns of a cluster table.
BARCODE_NAMES = ("cell_barcode", "barcode", "cellbarcode", "cb")
CLUSTER_NAMES = ("cluster", "seurat_clusters", "leiden", "louvain", "cell_type", "celltype")


def obs_columns(df: DataFrame) -> DataFrame:
    """``cell_barcode, cluster`` out of a table with any of the accepted names; raises where one is missing."""
    by = {c.lower(): c for c in reversed(df.columns)}
    found = [next((by[n] for n in names if n in by), None) for names in (BARCODE_NAMES, CLUSTER_NAMES)]
    if None in found:
        raise ValueError(f"no barcode or cluster column among {df.columns}")
    return df.select(F.col(f"`{found[0]}`").cast("string").alias("cell_barcode"), F.col(f"`{found[1]}`").cast("string").alias("cluster"))


def read_obs(spark: SparkSession, path: str) -> DataFrame:
    name = path.removesuffix(".gz")
    return obs_columns(spark.read.csv(path, header=True, sep="\t" if name.endswith((".tsv", ".txt")) else ","))


def parse_polyadb(df: DataFrame, column: str = "PAS_ID") -> DataFrame:
    """``contig, s, e`` of one base out of 1-based ``chr:strand:position`` names."""
    f = F.split(column, ":")
    pos = F.get(f, F.lit(2)).try_cast("long")
    return df.select(F.get(f, F.lit(0)).alias("contig"), (pos - 1).alias("s"), pos.alias("e")).where("e IS NOT NULL")


def gencode_version(name: Column) -> Column:
    return F.regexp_extract(name, r"[vV](\d+)", 1).try_cast("int")


def polyasite_version(name: Column) -> Column:
    return F.regexp_extract(name, r"GENCODE[_.](\d+)", 1).try_cast("int")


def parse_sam(df: DataFrame, barcode_tag: str = "CB", umi_tag: str = "UB") -> DataFrame:
    """Alignments of SAM text with 0-based positions; ``*`` is null, absent tags are null."""
    f = F.split("value", "\t")

    def tag(t: str, kind: str) -> Column:
        return F.nullif(F.regexp_extract("value", f"\t{t}:{kind}:([^\t]*)", 1), F.lit(""))

    def known(i: int) -> Column:
        return F.nullif(F.get(f, F.lit(i)), F.lit("*"))

    rows = df.where(~F.startswith("value", F.lit("@")) & (F.size(f) >= 11))
    contig, flag = known(2), F.get(f, F.lit(1)).try_cast("int")
    return rows.select(
        F.get(f, F.lit(0)).alias("qname"), flag.alias("flag"), contig.alias("contig"), (F.get(f, F.lit(3)).try_cast("long") - 1).alias("pos"), F.get(f, F.lit(4)).try_cast("int").alias("mapq"), F.get(f, F.lit(5)).alias("cigar"),
        F.when(F.get(f, F.lit(6)) == "=", contig).otherwise(known(6)).alias("next_contig"), (F.get(f, F.lit(7)).try_cast("long") - 1).alias("next_pos"), F.get(f, F.lit(8)).try_cast("long").alias("tlen"), known(9).alias("seq"),
        tag(barcode_tag, "Z").alias("cb"), tag(umi_tag, "Z").alias("umi"), tag("NH", "i").try_cast("int").alias("nh"), tag("SA", "Z").alias("sa"), F.when(flag.bitwiseAND(16) != 0, "-").otherwise("+").alias("strand"),
    )


def read_fasta(spark: SparkSession, path: str, chunk: int = 512) -> DataFrame:
    """``contig, chunk_id, seq``: the sequence in chunks.

    Lines are told apart by their place in the file; the bases before each line are a running
    sum over a contig's line lengths, and a line's bases go to the chunk they fall in.
    """
    raw = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at")).where(F.trim("value") != "")
    return fasta_chunks(raw, chunk)


def fasta_chunks(raw: DataFrame, chunk: int = 512) -> DataFrame:
    """The same out of ``value, at`` with ``at`` the lines' order.

    Only line lengths and offsets are windowed, first over blocks of lines, then over blocks.
    """
    from pyspark.sql import Window as W

    block = raw.withColumns({"b": F.expr("at div 65536"), "head": F.when(F.startswith("value", F.lit(">")), F.regexp_extract("value", r"^>(\S+)", 1))})
    # the contig that a block begins in is the last one named before it; one row a block
    named = block.groupBy("b").agg(F.max_by("head", F.when(F.col("head").isNotNull(), F.col("at"))).alias("last"))
    begins = named.select("b", F.last("last", ignorenulls=True).over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)).alias("begins"))
    here = F.last("head", ignorenulls=True).over(W.partitionBy("b").orderBy("at"))
    lines_ = block.withColumn("here", here).where("head IS NULL").join(begins, "b")
    block = lines_.select("at", "b", F.upper(F.trim("value")).alias("seq"), F.coalesce("here", "begins").alias("contig")).where("contig IS NOT NULL")
    per = block.groupBy("contig", "b").agg(F.sum(F.length("seq")).alias("n"))
    before = per.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("contig").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.coalesce(F.sum(F.length("seq")).over(W.partitionBy("contig", "b").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = block.withColumn("own", own).join(before, ["contig", "b"]).withColumn("s", F.col("base") + F.col("own")).withColumn("e", F.col("s") + F.length("seq"))
    cut = placed.withColumn("chunk_id", F.explode(F.sequence(F.expr(f"s div {chunk}"), F.expr(f"(e - 1) div {chunk}"))))
    start = F.greatest(F.col("s"), F.col("chunk_id") * chunk)
    part = F.substring(F.col("seq"), (start - F.col("s") + 1).cast("int"), (F.least(F.col("e"), (F.col("chunk_id") + 1) * chunk) - start).cast("int"))
    pieces = cut.select("contig", "chunk_id", start.alias("start"), part.alias("part"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "part"))), lambda x: x["part"]), "")
    return pieces.groupBy("contig", "chunk_id").agg(joined.alias("seq"))
