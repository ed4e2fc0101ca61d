"""Classification of reads by the annotation layers under their blocks.

One range join of blocks with all layers gives each block's bases per layer; the rest is
column arithmetic.  Only overlaps leave the join; they are spread by read once, and the three
aggregations after it (per block, per read and category, per read) keep that partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushgrain import constants as C
from hushgrain.functions import reads as R
from hushgrain.operators import cascade, intervals, sequence

#: Rank of a category that took another's place: after all inserted ones.
_RENAMED = 1 << 40


def block_bases(blocks: DataFrame, layers: DataFrame, width: int = intervals.BIN) -> DataFrame:
    """``read_id, block, s, e`` and the bases per layer, multiplicity kept.  ``blocks`` has ``read_id, block, contig, strand, s, e``."""
    exon, same = F.col("layer") == "exon", F.col("strand") == F.col("layer_strand")
    kinds = {"cc": F.col("layer") == "shared_cod_cod", "cn": F.col("layer") == "shared_cod_ncod", "n_sense": exon & same, "n_anti": exon & ~same, "intronic": F.col("layer") == "intron"}
    which = F.coalesce(*[F.when(test, i) for i, test in enumerate(kinds.values())])
    hits = intervals.overlaps(blocks, layers, ["contig"], width, "left").select("read_id", "block", "s", "e", which.alias("_kind"), "bases").repartition("read_id")
    return hits.groupBy("read_id", "block", "s", "e").agg(*[F.sum(F.when(F.col("_kind") == i, F.col("bases")).otherwise(0)).alias(n) for i, n in enumerate(kinds)])


def tally(bases: DataFrame) -> DataFrame:
    """``read_id, category, bases, first``: each block's bases by the hierarchy, summed; ``first`` orders the categories of a read.

    Overlap with shared regions counts fully; sense and antisense bases are lessened by it
    but not capped at what remains, so a read's sum may exceed its length.
    """
    at = F.col("block") * 10
    b = bases.withColumn("sh", F.col("cc") + F.col("cn")).withColumn("r0", F.col("e") - F.col("s") - F.col("sh"))
    zero = F.lit(0)
    b = b.withColumn("es", F.when(F.col("r0") > 0, F.greatest(zero, F.col("n_sense") - F.col("sh"))).otherwise(0)).withColumn("r1", F.col("r0") - F.col("es"))
    b = b.withColumn("ea", F.when((F.col("r0") > 0) & (F.col("r1") > 0), F.greatest(zero, F.col("n_anti") - F.col("sh"))).otherwise(0)).withColumn("r2", F.when(F.col("r0") > 0, F.col("r1") - F.col("ea")).otherwise(0))
    b = b.withColumn("in", F.when((F.col("r1") > 0) & (F.col("r2") > 0), F.least(F.col("r2"), F.greatest(zero, F.col("intronic") - F.col("sh")))).otherwise(0))
    b = b.withColumn("ig", F.when((F.col("r1") > 0) & (F.col("r2") > 0), F.col("r2") - F.col("in")).otherwise(0))
    kinds = [("ambiguous_cod_cod", "cc"), ("ambiguous_cod_ncod", "cn"), ("exonic_sense", "es"), ("exonic_antisense", "ea"), ("intronic_pure", "in"), ("intergenic_sparse", "ig")]
    parts = F.array(*[F.struct(F.lit(k).alias("category"), F.col(c).cast("long").alias("bases"), (at + i).cast("long").alias("first")) for i, (k, c) in enumerate(kinds)])
    rows = b.select("read_id", F.inline(parts)).where("bases > 0")
    return rows.groupBy("read_id", "category").agg(F.sum("bases").alias("bases"), F.min("first").alias("first"))


def vote(reads: DataFrame, tallied: DataFrame) -> DataFrame:
    """Each read with ``category`` and ``base_counts``.

    ``reads`` has ``read_id, n_blocks, n_junctions, read_length``.  Intronic bases of a spliced read become
    junction-spanning, and of an unspliced one with sense bases boundary bases.  The category with
    most bases wins, the earlier on ties.  A read without blocks or bases is ambiguous.
    """
    per = tallied.groupBy("read_id").agg(F.collect_list(F.struct("category", "bases", "first")).alias("t"))  # at most six entries
    j = reads.join(per, "read_id", "left").withColumn("t", F.coalesce("t", F.array().cast("array<struct<category:string,bases:bigint,first:bigint>>")))
    sense = F.exists("t", lambda x: x["category"] == "exonic_sense")
    name = F.when(F.col("n_junctions") > 0, "intronic_jxnspan").when(sense, "intronic_boundary").otherwise("intronic_pure")
    j = j.withColumn("_name", name).withColumn("_moved", F.col("_name") != "intronic_pure")
    renamed = F.transform("t", lambda x: F.when(x["category"] == "intronic_pure", F.struct(F.col("_name").alias("category"), x["bases"].alias("bases"), F.when(F.col("_moved"), F.lit(_RENAMED)).otherwise(x["first"]).alias("first"))).otherwise(x))
    empty = F.array(F.struct(F.lit("ambiguous").alias("category"), F.when(F.col("n_blocks") == 0, 0).otherwise(F.coalesce("read_length", F.lit(0))).cast("long").alias("bases"), F.lit(0).cast("long").alias("first")))
    j = j.withColumn("t", F.when(F.size("t") == 0, empty).otherwise(renamed))
    best = F.array_max(F.transform("t", lambda x: F.struct(x["bases"], -x["first"], x["category"].alias("category"))))["category"]
    entries = F.transform("t", lambda x: F.struct(x["category"], x["bases"]))
    return j.withColumn("category", best).withColumn("base_counts", F.map_from_entries(entries)).drop("t", "_name", "_moved")


def classify(reads: DataFrame, layers: DataFrame, whitelist: DataFrame | None = None, paired: bool = False, splice_sites: DataFrame | None = None, chunks: DataFrame | None = None, chunk: int = 512, distance: int = C.CHIMERIC_DISTANCE) -> DataFrame:
    """Every primary read with ``cell_barcode, category, base_counts, read_length`` and the artifact flags.

    ``reads`` needs ``read_id`` (unique), ``contig, pos, strand, flag, cigar, seq, cb, umi, nh, sa`` and, if ``paired``,
    ``next_contig, tlen``.  Rows that the rules decide never enter the range join.  Without ``chunks`` no read is
    primed at a run of A, without ``splice_sites`` none has a junction that is unknown.
    """
    decided = cascade.decide(reads.withColumn("read_length", R.aligned_length()), whitelist, paired, distance)
    rest = decided.where(F.col("decided") == cascade.UNDECIDED).withColumn("blocks", R.blocks()).withColumn("n_junctions", F.size(R.junctions())).withColumn("n_blocks", F.size("blocks"))
    long = rest.select("read_id", "contig", "strand", F.posexplode("blocks").alias("block", "_b")).select("read_id", "contig", "strand", "block", "_b.s", "_b.e")
    voted = vote(rest.drop("blocks"), tally(block_bases(long, layers)))
    flags = voted.withColumn("is_tso", R.is_tso_invasion())
    if chunks is not None:
        f = sequence.fetch(flags.withColumn("_end", R.ref_end()), chunks, "contig", "_end", 20, chunk)
        flags = f.withColumn("is_polya", R.has_a_run("bases")).drop("bases", "_end")
        if splice_sites is not None:
            j = rest.where("n_junctions > 0").select("read_id", "contig", "strand", F.explode(R.junctions()).alias("junction"))
            odd = sequence.with_donor(sequence.with_known(j, splice_sites), chunks, chunk).where("NOT is_known AND NOT is_canonical").select("read_id", F.lit(True).alias("is_noncanon")).distinct()
            flags = flags.join(odd, "read_id", "left")
    for c in ("is_polya", "is_noncanon"):
        flags = flags.withColumn(c, F.coalesce(F.col(c), F.lit(False)) if c in flags.columns else F.lit(False))
    done = decided.where(F.col("decided") != cascade.UNDECIDED).withColumn("category", F.col("decided")).withColumn("base_counts", F.create_map("decided", "read_length"))
    done = done.withColumns({"is_tso": F.lit(False), "is_polya": F.lit(False), "is_noncanon": F.lit(False)})
    keep = [*[c for c in reads.columns if c != "read_length"], "cell_barcode", "read_length", "category", "base_counts", "is_tso", "is_polya", "is_noncanon"]
    return done.select(keep).unionByName(flags.select(keep))
