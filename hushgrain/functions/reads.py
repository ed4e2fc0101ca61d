"""Expressions over the fields of one alignment.

Positions are 0-based and half-open.  Every function gives null or a stated default for
null input, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushgrain import constants as C


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_primary(flag="flag") -> Column:
    """Neither secondary, supplementary nor unmapped; a null flag counts as 0."""
    return F.coalesce(_c(flag), F.lit(0)).bitwiseAND(C.FLAG_SKIPPED) == 0


def has_flag(flag, bit: int) -> Column:
    return F.coalesce(_c(flag), F.lit(0)).bitwiseAND(bit) != 0


def is_multimapper(nh="nh") -> Column:
    return F.coalesce(_c(nh) > 1, F.lit(False))


def is_mito(contig="contig") -> Column:
    return F.coalesce(_c(contig).isin(*C.MITO_CONTIGS), F.lit(False))


def is_chimeric_sa(sa="sa", contig="contig", pos="pos", strand="strand", distance: int = C.CHIMERIC_DISTANCE) -> Column:
    """Any supplementary entry on another contig or strand, or farther than ``distance``.

    Entries with fewer than three fields or a position that is no number are ignored.  The
    entry's position is 1-based text and is compared with the 0-based one as it stands.
    """

    def far(entry: Column) -> Column:
        f = F.split(entry, ",")
        at = F.get(f, F.lit(1)).try_cast("long")
        other = (F.get(f, F.lit(0)) != _c(contig)) | (F.get(f, F.lit(2)) != _c(strand)) | (F.abs(at - _c(pos)) > distance)
        return F.coalesce((F.size(f) >= 3) & at.isNotNull() & other, F.lit(False))

    return F.coalesce(F.exists(F.split(_c(sa), ";"), far), F.lit(False))


def is_chimeric_pair(flag="flag", sa="sa", contig="contig", next_contig="next_contig", tlen="tlen", most: int = C.MAX_TLEN) -> Column:
    """Without a supplementary entry: a paired read whose mate is unmapped, on another contig, or too far."""
    no_sa = F.coalesce(_c(sa), F.lit("")) == ""
    mate = has_flag(flag, C.FLAG_MATE_UNMAPPED) | F.coalesce((_c(next_contig) != _c(contig)) | (F.abs(_c(tlen)) > most) & _c(next_contig).isNotNull(), F.lit(False))
    return no_sa & has_flag(flag, C.FLAG_PAIRED) & mate


def leading_clip(cigar="cigar") -> Column:
    """Length of a soft clip that is the first operation, else 0."""
    return F.coalesce(F.regexp_extract(_c(cigar), r"^(\d+)S", 1).try_cast("int"), F.lit(0))


def trailing_clip(cigar="cigar") -> Column:
    """Length of a soft clip that is the last of several operations, else 0."""
    return F.coalesce(F.regexp_extract(_c(cigar), r"[A-Z=](\d+)S$", 1).try_cast("int"), F.lit(0))


def is_tso_invasion(seq="seq", cigar="cigar") -> Column:
    """A soft clip at either end holds the template-switch sequence or a run of G."""
    s = F.upper(_c(seq))
    lead, trail = F.substring(s, F.lit(1), leading_clip(cigar)), F.right(s, trailing_clip(cigar))

    def hit(x: Column) -> Column:
        return F.contains(x, F.lit(C.TSO_PREFIX)) | F.contains(x, F.lit(C.POLY_G))

    return F.coalesce(hit(lead) | hit(trail), F.lit(False))


def cigar_ops(cigar="cigar") -> Column:
    """The operations as an array of ``{n, op}``; empty for null and ``*``."""
    ops = F.regexp_extract_all(F.coalesce(_c(cigar), F.lit("")), F.lit(r"(\d+[MIDNSHP=X])"), 1)
    return F.transform(ops, lambda o: F.struct(F.substring(o, F.lit(1), F.length(o) - 1).cast("long").alias("n"), F.right(o, F.lit(1)).alias("op")))


_ADVANCES, _ALIGNED, _QUERY = ("M", "D", "N", "=", "X"), ("M", "=", "X"), ("M", "I", "=", "X")


def ref_end(pos="pos", cigar="cigar") -> Column:
    """The end on the reference."""
    return F.aggregate(cigar_ops(cigar), _c(pos).cast("long"), lambda a, o: a + F.when(o["op"].isin(*_ADVANCES), o["n"]).otherwise(0))


def aligned_length(cigar="cigar") -> Column:
    """Aligned query bases: matches and insertions, not clips."""
    return F.aggregate(cigar_ops(cigar), F.lit(0).cast("long"), lambda a, o: a + F.when(o["op"].isin(*_QUERY), o["n"]).otherwise(0))


def _walk(pos, cigar, wanted: tuple[str, ...], kind: str) -> Column:
    """Fold over the operations, keeping ``(start, end)`` of the wanted ones."""
    start = F.struct(_c(pos).cast("long").alias("p"), F.array().cast(kind).alias("out"))

    def step(a: Column, o: Column) -> Column:
        end = a["p"] + F.when(o["op"].isin(*_ADVANCES), o["n"]).otherwise(0)
        new = F.struct(a["p"].alias("s"), end.alias("e"))
        return F.struct(end.alias("p"), F.when(o["op"].isin(*wanted), F.array_append(a["out"], new)).otherwise(a["out"]).alias("out"))

    return F.aggregate(cigar_ops(cigar), start, step)["out"]


def blocks(pos="pos", cigar="cigar") -> Column:
    """The gapless aligned blocks ``{s, e}``, one per match operation."""
    return _walk(pos, cigar, _ALIGNED, "array<struct<s:bigint,e:bigint>>")


def junctions(pos="pos", cigar="cigar") -> Column:
    """The starts of the skipped regions."""
    return F.transform(_walk(pos, cigar, ("N",), "array<struct<s:bigint,e:bigint>>"), lambda j: j["s"])


def length_bin(n) -> Column:
    """The number of break-points at or below ``n``; null for null."""
    return F.when(_c(n).isNotNull(), sum((F.when(_c(n) >= b, 1).otherwise(0) for b in C.LENGTH_BREAKS), F.lit(0)))


def three_prime(strand="strand", pos="pos", end="ref_end") -> Column:
    return F.when(_c(strand) == "-", _c(pos)).otherwise(_c(end))


def five_prime(strand="strand", pos="pos", end="ref_end") -> Column:
    return F.when(_c(strand) == "-", _c(end)).otherwise(_c(pos))


def is_insert(flag="flag", tlen="tlen", most: int = C.INSERT_MAX) -> Column:
    """The first read of a proper pair with a plausible insert."""
    t = F.abs(_c(tlen))
    return F.coalesce(has_flag(flag, C.FLAG_PAIRED) & has_flag(flag, C.FLAG_PROPER) & has_flag(flag, C.FLAG_READ1) & (t > 0) & (t < most), F.lit(False))


def reverse_complement(seq) -> Column:
    return F.reverse(F.translate(_c(seq), "ACGTacgt", "TGCAtgca"))


def strip_suffix(cb) -> Column:
    """A barcode without one trailing ``-1``; the case stays."""
    return F.regexp_replace(_c(cb), "-1$", "")


def has_a_run(seq, run: int = C.POLYA_RUN) -> Column:
    return F.coalesce(F.contains(F.upper(_c(seq)), F.lit("A" * run)), F.lit(False))
