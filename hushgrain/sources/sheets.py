"""Sample sheets of plates, and where their wells' files lie."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hushgrain.functions import reads as R

# Words that make a first line a header, sequencers that store i7 reversed, the form of a well and of a well's folder.
HEADER_WORDS = frozenset("sample well plate i5 i7 name index sequence barcode samplename sample_name wellid plateid".split())
I7_REVERSED = frozenset(("nextseq", "novaseqx"))
WELL = r"^[A-Pa-p]\d{1,2}$"
PLATE_FOLDER = r"^(.+)_([A-Pa-p]\d{1,2})$"
NAME_WORDS = ("name", "primer", "label")


def _words(cell: str) -> set[str]:
    low = cell.strip().lower()
    return {low, *re.split("[_]", low), *re.split("-", low), *re.split(" ", low)} - {""}


def _first(headers: list[str], marker: str) -> int | None:
    return next((i for i, h in enumerate(headers) if marker in h), None)


def columns(first: list[str]) -> tuple[list[str], bool]:
    """The columns of a sheet from its first line, and whether that line is a header."""
    if any(_words(c) & HEADER_WORDS for c in first if c.strip()):
        return [c.strip() for c in first], True
    default = ["Sample_Name", "i7_sequence", "i5_reverse_complement"]
    return default[: len(first)] + [f"col_{i}" for i in range(3, len(first))], False


def split_sample_name(name: Column) -> tuple[Column, Column]:
    """Plate and well of ``PLATE_WELL``; no plate, and the whole name as well, if the last part is no well."""
    last = F.element_at(F.split(name, "_"), -1)
    ok = F.contains(name, F.lit("_")) & last.rlike(WELL)
    return F.when(ok, F.substring(name, F.lit(1), F.length(name) - F.length(last) - 1)).otherwise(""), F.upper(F.when(ok, last).otherwise(name))


def parse_sheet(rows: DataFrame, names: list[str], sequencer: str = "none") -> DataFrame:
    """``key, plate_id, well_id, i7_seq, i5_seq, i7_name, i5_name, extras`` out of ``row_no, cells``.

    Of several rows of a well the last wins.  Rows without any value or without a well are
    left out.  Raises if no column names wells or none holds an index.
    """
    low = [n.lower() for n in names]
    sample, well, plate = _first(low, "sample_name"), _first(low, "wellid"), _first(low, "plateid")
    well = _first(low, "well") if well is None else well
    i7, i5, col = _first(low, "i7"), _first(low, "i5"), _first(low, "column")
    if sample is None and well is None:
        raise ValueError(f"neither Sample_Name nor WellID among {names}")
    if i7 is None and i5 is None:
        raise ValueError(f"neither an i7 nor an i5 column among {names}")
    label = {x: max((i for i, h in enumerate(low) if x in h and any(w in h for w in NAME_WORDS)), default=None) for x in ("i7", "i5")}

    def cell(i: int | None) -> Column:
        return F.coalesce(F.trim(F.get("cells", F.lit(i))), F.lit("")) if i is not None else F.lit("")

    if sample is not None:
        plate_id, well_id = split_sample_name(cell(sample))
    else:
        raw = cell(well)
        plate_id = cell(plate)
        well_id = F.upper(F.when(raw.rlike("^[A-Za-z]$"), F.concat(raw, cell(col))).otherwise(raw)) if col is not None else F.upper(raw)
    seq7 = F.when(cell(i7) != "", R.reverse_complement(cell(i7))).otherwise("") if sequencer.lower() in I7_REVERSED else cell(i7)
    used = {i7, i5, label["i7"], label["i5"], sample, well, plate}
    extra = {n: i for i, n in enumerate(names) if i not in used and n.lower() not in ("sample_name", "wellid", "well", "plateid")}
    extras = F.create_map(*[x for n, i in extra.items() for x in (F.lit(n), cell(i))]) if extra else F.create_map().cast("map<string,string>")
    out = rows.where(F.exists("cells", lambda c: F.trim(c) != "")).select("row_no", F.upper(plate_id).alias("plate_id"), well_id.alias("well_id"), seq7.alias("i7_seq"), cell(i5).alias("i5_seq"), cell(label["i7"]).alias("i7_name"), cell(label["i5"]).alias("i5_name"), extras.alias("extras")).where("well_id != ''")
    key = F.when(F.col("plate_id") != "", F.concat("plate_id", F.lit("/"), "well_id")).otherwise(F.col("well_id"))
    return last_wins(out.withColumn("key", key), ["key"], "row_no").drop("row_no")


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of a key the one with the highest ``order``."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def read_sheet(spark: SparkSession, path: str, sequencer: str = "none") -> DataFrame:
    """Read one sheet; the driver looks at the first line only."""
    head = spark.read.text(path).first()
    if head is None:
        raise ValueError(f"empty sheet: {path}")
    names, is_header = columns(next(csv.reader([head.value.lstrip("﻿")])))
    rows = spark.read.csv(path, header=False, schema=", ".join(f"c{i} string" for i in range(len(names))), escape='"').select(F.monotonically_increasing_id().alias("row_no"), F.array(*[F.col(f"c{i}") for i in range(len(names))]).alias("cells"))
    return parse_sheet(rows.where("row_no > 0") if is_header else rows, names, sequencer)


def with_sheet(wells: DataFrame, sheet: DataFrame) -> DataFrame:
    """Each well with its sheet row: by plate and well, else by well alone."""
    cols = [c for c in sheet.columns if c not in ("key", "plate_id", "well_id")]
    a = sheet.select(F.col("key").alias("_ka"), F.struct(*cols).alias("_a"))
    b = sheet.select(F.col("key").alias("_kb"), F.struct(*cols).alias("_b"))
    full = F.concat(F.upper("plate_id"), F.lit("/"), F.upper("well_id"))
    j = wells.join(a, full == F.col("_ka"), "left").join(b, F.upper("well_id") == F.col("_kb"), "left")
    return j.withColumn("_s", F.coalesce("_a", "_b")).select(*wells.columns, *[F.col(f"_s.{c}").alias(c) for c in cols])


def unmatched(wells: DataFrame, sheet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wells without a sheet row, and sheet keys without a well."""
    full = F.concat(F.upper("plate_id"), F.lit("/"), F.upper("well_id"))
    keys = wells.select(F.explode(F.array(full, F.upper("well_id"))).alias("key")).distinct()
    known = sheet.select("key")
    w = wells.withColumn("_f", full)
    lonely = w.join(known, F.col("_f") == F.col("key"), "left_anti").join(known, F.upper("well_id") == F.col("key"), "left_anti").drop("_f")
    return lonely, known.join(keys, "key", "left_anti")


def plate_wells(paths: DataFrame, path: str = "path") -> DataFrame:
    """``plate_id, well_id, bam``: the first file by name of each folder named ``PLATE_WELL``; a window of a folder's files."""
    folder = F.element_at(F.split(path, "/"), -2)
    ok = paths.where(F.endswith(path, F.lit(".bam")) & folder.rlike(PLATE_FOLDER))
    return ok.groupBy(F.regexp_extract(folder, PLATE_FOLDER, 1).alias("plate_id"), F.upper(F.regexp_extract(folder, PLATE_FOLDER, 2)).alias("well_id")).agg(F.min(path).alias("bam"))
