"""Queries of problem 3: sample sheets whose columns change from file to file."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrain.operators import drift
from hushgrain.queries.common import table

# The sheet fields of the list of terms.
FIELDS = ["sample_name", "plate_id", "well_id", "i7_seq", "i5_seq", "i7_name", "i5_name", "cells_loaded", "conc_ng_ul", "run_date", "note"]


def _drift(spark, d):
    return drift.drift(*(table(spark, d, t) for t in ("sheet_files", "sheet_lines", "sheet_terms")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Each file's changes against the file before it in its series."""
    return _drift(spark, d)["changes"].select("file_id", "field_name", "change_kind")


def p3_wells(spark: SparkSession, d: str) -> DataFrame:
    """All lines of all sheets in one table."""
    x = _drift(spark, d)
    return drift.unified(x["cells"], x["schemas"], FIELDS)


def p3_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """The types that each field takes in a series, and since when."""
    return drift.alternatives(_drift(spark, d)["schemas"])


def p3_changes(spark: SparkSession, d: str) -> DataFrame:
    """The list of changes with what was before and after."""
    return _drift(spark, d)["changes"]


def p3_file_lines(spark: SparkSession, d: str) -> DataFrame:
    """Distinct lines with a value per file, and the number of the first."""
    return _drift(spark, d)["parsed"].groupBy("file_id").agg(F.count(F.lit(1)).alias("n_lines"), F.min("line_no").alias("first_line"))


P3_FILE_LINES = """
SELECT l.file_id, count(*) AS n_lines, min(line_no) AS first_line
FROM (SELECT DISTINCT file_id, line_no, raw_line FROM sheet_lines WHERE regexp_replace(raw_line, '[,;\t"﻿\\s]', '', 'g') <> '') l
WHERE l.file_id IN (SELECT file_id FROM sheet_files WHERE series_id IS NOT NULL) GROUP BY l.file_id
"""

QUERIES = {"p3_found": p3_found, "p3_wells": p3_wells, "p3_alternatives": p3_alternatives, "p3_changes": p3_changes, "p3_file_lines": p3_file_lines}
SQL = {"p3_file_lines": P3_FILE_LINES}
