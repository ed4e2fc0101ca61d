"""The layers of a genome annotation, from gene and exon rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushgrain import constants as C
from hushgrain.operators import intervals as I
from hushgrain.operators import sequence
from hushgrain.storage import materialise

GENE = ["contig", "strand", "gene_id", "biotype"]


def drop_biotypes(df: DataFrame, biotypes: list[str]) -> DataFrame:
    """Rows without those of excluded biotypes; a null biotype stays."""
    return df.where(~F.coalesce(F.col("biotype").isin(*biotypes), F.lit(False))) if biotypes else df


def drop_mito(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce(F.col("contig").isin(*C.MITO_CONTIGS), F.lit(False)))


def exon_unions(exons: DataFrame) -> DataFrame:
    """Overlapping exons merged within their gene."""
    return I.islands(exons, GENE)


def gene_bodies(genes: DataFrame) -> DataFrame:
    return genes.select(*GENE, "s", "e").distinct()


def introns(bodies: DataFrame, unions: DataFrame) -> DataFrame:
    """Gene bodies without any exon of their strand; one set per gene, so nested genes overlap."""
    return I.subtract(bodies, unions, GENE, ["contig", "strand"])


def overlap_type(a: str | Column = "biotype_a", b: str | Column = "biotype_b") -> Column:
    a, b = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")).isin(*C.CODING_BIOTYPES) for x in (a, b))
    return F.when(a & b, "cod_cod").when(a | b, "cod_ncod").otherwise("ncod_ncod")


def shared_regions(unions: DataFrame, collapse_strands: bool = False) -> DataFrame:
    """``layer, contig, [strand,] s, e``: where genes of a strand overlap, merged per class; two non-coding ones count as ``cod_ncod``."""
    pairs = I.self_overlap(unions, ["contig", "strand"], "gene_id")
    layer = F.when(overlap_type() == "cod_cod", "shared_cod_cod").otherwise("shared_cod_ncod")
    return I.islands(pairs.select(layer.alias("layer"), "contig", "strand", "s", "e"), ["layer", "contig"] + ([] if collapse_strands else ["strand"]))


def unique_regions(unions: DataFrame, shared: DataFrame) -> DataFrame:
    """Exon unions without shared regions of their strand."""
    return I.subtract(unions, shared, GENE, ["contig", "strand"])


def intergenic(bodies: DataFrame) -> DataFrame:
    """Gaps between genes of either strand."""
    return I.complement(bodies, ["contig"])


def intergenic_bases(gaps: DataFrame) -> DataFrame:
    """One row; 0 for no gaps."""
    return gaps.agg(F.coalesce(F.sum(F.col("e") - F.col("s")), F.lit(0)).alias("intergenic_bases"))


def build(genes: DataFrame, exons: DataFrame, exclude: list[str] | None = None) -> dict[str, DataFrame]:
    """All layers.  Raises if there are no genes or exons once the excluded ones are gone."""
    genes, exons = (materialise(drop_mito(drop_biotypes(x, exclude or [])), "annotation") for x in (genes, exons))
    if genes.isEmpty() or exons.isEmpty():
        raise ValueError("the annotation has no gene or no exon rows")
    # each layer feeds several others, so it is written once
    unions, bodies = materialise(exon_unions(exons), "exons"), gene_bodies(genes)
    shared, inner = materialise(shared_regions(unions), "shared"), materialise(introns(bodies, unions), "introns")
    gaps = intergenic(bodies)
    return {"exons": unions, "genes": bodies, "introns": inner, "shared": shared, "unique": unique_regions(unions, shared), "intergenic": gaps, "splice_sites": sequence.splice_sites(exons)}


def tagged(index: dict[str, DataFrame]) -> DataFrame:
    """``contig, s, e, layer, layer_strand``: what the classification joins, in one table."""
    cols = ["contig", "s", "e"]
    exon = index["exons"].select(*cols, F.lit("exon").alias("layer"), F.col("strand").alias("layer_strand"))
    intron = index["introns"].select(*cols, F.lit("intron").alias("layer"), F.col("strand").alias("layer_strand"))
    shared = index["shared"].select(*cols, "layer", F.lit(None).cast("string").alias("layer_strand"))
    return exon.unionByName(intron).unionByName(shared)
