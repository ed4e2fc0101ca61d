"""One table out of delimited files whose columns drift.

Tagged-union inference.  Each file gives a schema: fields, each with the header it came
under and the type of its values.  Schemas are fused per series while every alternative
type of a field is kept; where files disagree, values are split into typed branches
(``integer``, ``decimal``, ``date``, ``text``) beside a canonical form in the fused type.  No cell with a value is lost.

A column under an unlisted header may continue a field of earlier files; whether it does
depends on how columns of earlier files were resolved.  That is solved for all series at
once by repeating the resolution until it no longer changes.  The dependency follows the
order of files, so the fixed point is unique, and round *i* has settled the first *i* files; a series that
a round leaves as it was is settled and takes no part in the next.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushgrain.storage import materialise, release

# Delimiters, missing values, the columns of a file without header.
DELIMITERS = (",", ";", "\t")
MISSING = ("", "NA", "n/a", "-")
NO_HEADER = ("Sample_Name", "i7_sequence", "i5_reverse_complement")
#: Fixed value: this name is the field's name in the list of terms.
FIELD_ALIASES = {"i5reversecomplement": "i5_seq"}
TYPES = ("integer", "decimal", "date", "text")
_PATTERNS = {"integer": r"^[+-]?[0-9]+$", "decimal": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$", "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"}


def normalised(c: Column) -> Column:
    """Lower case, letters a-z and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def ordered_files(files: DataFrame) -> DataFrame:
    """``file_id, series_id, exported_at, ord``: each file once, numbered within its series by export time, then id.

    Files without id or series are left out; one without time comes first.
    """
    once = files.where("file_id IS NOT NULL AND series_id IS NOT NULL").groupBy("file_id").agg(F.min("series_id").alias("series_id"), F.min("exported_at").alias("exported_at"))
    return once.withColumn("ord", F.row_number().over(W.partitionBy("series_id").orderBy("exported_at", "file_id")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cells(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for lines, delimiters in parts:
        yield pd.Series([[c.strip() for c in next(csv.reader([line], delimiter=d, skipinitialspace=d != "\t"), [])] if d else [line.strip()] for line, d in zip(lines, delimiters)])


def parsed_lines(files: DataFrame, lines: DataFrame) -> DataFrame:
    """``file_id, series_id, ord, line_no, cells``: each line once, cells trimmed; lines without any value are left out."""
    clean = F.regexp_replace(F.regexp_replace("raw_line", "^﻿", ""), "[\r\n]+", " ")
    once = lines.where("raw_line IS NOT NULL AND line_no IS NOT NULL").select("file_id", "line_no", clean.alias("raw_line")).distinct()
    once = once.where(F.regexp_replace("raw_line", '[,;\t"﻿\\s]', "") != "")
    first = once.groupBy("file_id").agg(F.expr("min_by(raw_line, struct(line_no, raw_line))").alias("first"))
    bare = F.regexp_replace("first", '"[^"]*"', "")
    counts = [F.struct((F.length(bare) - F.length(F.replace(bare, F.lit(d)))).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]
    marks = first.select("file_id", F.greatest(*counts)["d"].alias("delimiter")).join(files, "file_id")
    return once.join(marks, "file_id").select("file_id", "series_id", "ord", "line_no", _cells("raw_line", "delimiter").alias("cells"))


def term_fields(terms: DataFrame) -> DataFrame:
    """``hdr, listed``: the field of each normalised header."""
    own = terms.select(normalised(F.col("header_term")).alias("hdr"), F.col("field_name").alias("listed"))
    alias = terms.sparkSession.createDataFrame(list(FIELD_ALIASES.items()), "hdr string, listed string")
    return own.unionByName(alias).where("hdr != '' AND listed IS NOT NULL").groupBy("hdr").agg(F.min("listed").alias("listed"))


def columns_and_cells(parsed: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files' columns ``series_id, ord, file_id, pos, hdr, listed``, those without a header left out, and all cells ``file_id, line_no, pos, value``."""
    top = parsed.groupBy("series_id", "ord", "file_id").agg(F.min("line_no").alias("top_no"), F.min_by("cells", "line_no").alias("top"))
    heads = top.select("series_id", "ord", "file_id", "top_no", F.posexplode("top").alias("pos", "name")).withColumn("hdr", normalised(F.coalesce("name", F.lit(""))))
    heads = heads.join(F.broadcast(fields), "hdr", "left")  # the list of known headers is fixed
    has = heads.groupBy("series_id", "ord", "file_id", "top_no").agg((F.count("listed") > 0).alias("has_header"))
    bare = F.array(*[F.lit(n) for n in NO_HEADER])
    without = has.where("NOT has_header").select("series_id", "ord", "file_id", F.posexplode(bare).alias("pos", "name")).withColumn("hdr", normalised(F.col("name"))).join(F.broadcast(fields), "hdr", "left")
    cols = ["series_id", "ord", "file_id", "pos", "hdr", "listed"]
    columns = heads.join(has.where("has_header").select("file_id"), "file_id").where("hdr != ''").select(cols).unionByName(without.select(cols))
    body = parsed.join(has.select("file_id", "top_no", "has_header"), "file_id").where("NOT has_header OR line_no != top_no")
    return columns, body.select("file_id", "line_no", F.posexplode("cells").alias("pos", "value"))


def resolved(columns: DataFrame, values: DataFrame, share: float = 0.9) -> DataFrame:
    """``columns`` with ``field_name``: the listed field, the one it continues, or its own header.

    ``values`` has ``series_id, ord, file_id, hdr, value``, each distinct value once, missing ones
    left out.  An unlisted column continues the listed field, without a listed header in its file,
    under which at least ``share`` of its values occurred in earlier files; of several the one with
    most values, then by name; if two columns of a file claim a field, the one with the larger
    share has it, then the one further left.
    """
    cols = materialise(columns.groupBy("series_id", "ord", "file_id", "hdr").agg(F.min("pos").alias("pos"), F.min("listed").alias("listed")), "columns")
    vals = materialise(values.join(cols.select("file_id", "hdr", "listed"), ["file_id", "hdr"]), "values")
    fixed = vals.where("listed IS NOT NULL").groupBy("series_id", F.col("listed").alias("field_name"), "value").agg(F.min("ord").alias("since"))
    fixed = materialise(fixed, "since")
    loose = materialise(vals.where("listed IS NULL").drop("listed"), "loose")
    open_cols = cols.where("listed IS NULL")
    sizes = loose.groupBy("file_id", "hdr").agg(F.count(F.lit(1)).alias("total"))
    taken = cols.where("listed IS NOT NULL").select("file_id", F.col("listed").alias("field_name")).distinct()
    what = ["series_id", "file_id", "hdr", "field_name"]
    state = materialise(open_cols.select("series_id", "file_id", "hdr", F.lit(None).cast("string").alias("field_name")).where("false"), "resolved")
    at_work, settled, used = loose, [], [vals, fixed, loose, state]
    while True:
        more = at_work.join(state.drop("series_id"), ["file_id", "hdr"]).groupBy("series_id", "field_name", "value").agg(F.min("ord").alias("since"))
        since = fixed.unionByName(more).groupBy("series_id", "field_name", "value").agg(F.min("since").alias("since"))
        hits = at_work.join(since, ["series_id", "value"]).where("since < ord").groupBy("series_id", "file_id", "hdr", "field_name").agg(F.count(F.lit(1)).alias("hits"))
        hits = hits.join(sizes, ["file_id", "hdr"]).where(F.col("hits") >= F.col("total") * F.lit(share)).join(taken, ["file_id", "field_name"], "left_anti").join(open_cols.select("file_id", "hdr", "pos"), ["file_id", "hdr"])
        best = hits.withColumn("_r", F.row_number().over(W.partitionBy("file_id", "hdr").orderBy(F.desc("hits"), "field_name"))).where("_r = 1")
        best = best.withColumn("_r", F.row_number().over(W.partitionBy("file_id", "field_name").orderBy(F.desc(F.col("hits") / F.col("total")), "pos", "hdr"))).where("_r = 1")
        new = materialise(best.select(what), "resolved")
        both = new.withColumn("_n", F.lit(1)).unionByName(state.withColumn("_n", F.lit(-1))).groupBy(*what).agg(F.sum("_n").alias("_n"))
        moved = materialise(both.where("_n != 0").select("series_id").distinct(), "moved")
        used += [new, moved]
        if moved.isEmpty():
            settled.append(new)
            break
        settled.append(new.join(moved, "series_id", "left_anti"))
        state, at_work = new.join(moved, "series_id", "left_semi"), loose.join(moved, "series_id", "left_semi")
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    found = materialise(found.drop("series_id"), "resolved")
    release(*used)
    return cols.join(found, ["file_id", "hdr"], "left").withColumn("field_name", F.coalesce("listed", "field_name", "hdr"))


def type_of(value: Column) -> Column:
    """The narrowest type of one value."""
    t = F.lit("text")
    for name in ("date", "decimal", "integer"):
        t = F.when(value.rlike(_PATTERNS[name]), name).otherwise(t)
    return t


def drift(files: DataFrame, lines: DataFrame, terms: DataFrame) -> dict[str, DataFrame]:
    """Everything that is known of the files' columns.

    ``columns``: file_id, series_id, ord, pos, hdr, field_name.
    ``cells``: file_id, series_id, line_no, pos, field_name, hdr (both null in a cell without a header), value (null where missing), kind (its narrowest type).
    ``schemas``: series_id, ord, file_id, field_name, hdr, type (null for a column without values), and the number of values of each type.
    ``changes``: file_id, series_id, ord, field_name, change_kind, before, after.

    Empty tables give empty results; extra columns of the inputs are ignored; a file without lines
    has no fields.  Cells beyond the header and columns without a header belong to no field and no schema.  Of
    columns whose headers are equal after normalising, the values belong to one column.
    """
    order = materialise(ordered_files(files), "files")
    parsed = materialise(parsed_lines(order, lines), "lines")
    columns, cells = columns_and_cells(parsed, term_fields(terms))
    columns = materialise(columns, "heads")
    known = cells.join(order.select("file_id", "series_id", "ord"), "file_id").join(columns.select("file_id", "pos", "hdr"), ["file_id", "pos"], "left")
    known = materialise(known.withColumn("value", F.when(~F.coalesce("value", F.lit("")).isin(*MISSING), F.col("value"))).withColumn("kind", type_of(F.col("value"))), "cells")
    counts = known.where("value IS NOT NULL AND hdr IS NOT NULL").groupBy("series_id", "ord", "file_id", "hdr", "value")
    fields = materialise(resolved(columns, counts.agg(F.lit(1).alias("_one")).drop("_one")), "fields")
    tally = known.groupBy("file_id", "hdr").agg(*[F.count(F.when(F.col("kind") == t, 1)).alias(f"n_{t}") for t in TYPES if t != "text"], F.count("value").alias("n_values"))
    per_field = fields.join(tally, ["file_id", "hdr"], "left").groupBy("series_id", "ord", "file_id", "field_name").agg(
        F.min_by("hdr", "pos").alias("hdr"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_integer", "n_decimal", "n_date", "n_values")]
    )
    least = F.col("n_values") * 9
    kind = F.when(F.col("n_values") == 0, None).when(F.col("n_integer") * 10 >= least, "integer").when((F.col("n_integer") + F.col("n_decimal")) * 10 >= least, "decimal").when(F.col("n_date") * 10 >= least, "date").otherwise("text")
    schemas = materialise(per_field.withColumn("type", kind), "schemas")
    return {"columns": fields, "cells": known.join(fields.select("file_id", "hdr", "field_name"), ["file_id", "hdr"], "left"), "schemas": schemas, "changes": changes(order, schemas), "parsed": parsed}


def changes(files: DataFrame, schemas: DataFrame) -> DataFrame:
    """Each file's fields against the file before it in its series."""
    key = ["series_id", "ord", "field_name"]
    now = schemas.select(*key, F.col("hdr").alias("hdr"), F.col("type").alias("type"), F.lit(1).alias("here"))
    before = schemas.select("series_id", (F.col("ord") + 1).alias("ord"), "field_name", F.col("hdr").alias("hdr0"), F.col("type").alias("type0"), F.lit(1).alias("there"))
    both = now.join(before, key, "full").where("ord > 1").join(files.select("series_id", "ord", "file_id"), ["series_id", "ord"])
    case = lambda test, kind, a, b: F.when(test, F.struct(F.lit(kind).alias("change_kind"), F.col(a).alias("before"), F.col(b).alias("after")))
    kinds = F.array_compact(
        F.array(
            case(F.col("there").isNull(), "added", "hdr0", "hdr"),
            case(F.col("here").isNull(), "removed", "hdr0", "hdr"),
            case(F.col("hdr") != F.col("hdr0"), "renamed", "hdr0", "hdr"),
            case(F.col("type") != F.col("type0"), "type_changed", "type0", "type"),
        )
    )
    return both.select("file_id", "series_id", "ord", "field_name", F.inline(kinds))


def fused(kinds: Column) -> Column:
    """The narrowest type that holds all of an array of types."""
    have = lambda t: F.array_contains(kinds, t)
    one = F.size(kinds) == 1
    return F.when(one & have("date"), "date").when(one & have("integer"), "integer").when(~have("text") & ~have("date"), "decimal").otherwise("text")


def alternatives(schemas: DataFrame) -> DataFrame:
    """The fused schema: per series and field each type, since which file it appears, in how many files, and the type that holds all."""
    seen = schemas.where("type IS NOT NULL").groupBy("series_id", "field_name", "type").agg(F.min("ord").alias("since_ord"), F.min_by("file_id", "ord").alias("since_file"), F.count(F.lit(1)).alias("n_files"))
    w = W.partitionBy("series_id", "field_name")  # at most four types
    return seen.withColumn("n_alternatives", F.count(F.lit(1)).over(w)).withColumn("fused_type", fused(F.collect_set("type").over(w)))


#: What is exact as a decimal branch; other numbers stay text.
_EXACT = r"^[+-]?[0-9]{0,20}(\.[0-9]{0,18})?$"


def _branches(value: Column, kind: Column) -> Column:
    """``{integer, decimal, date, text}`` of which one is set: by the value's own form, or text where that can't hold it exactly."""
    i = F.when(kind == "integer", value.try_cast("long"))
    d = F.when((kind == "decimal") & value.rlike(_EXACT), value.try_cast("decimal(38,18)"))
    t = F.when(kind == "date", value.try_cast("date"))
    return F.struct(i.alias("integer"), d.alias("decimal"), t.alias("date"), F.when(i.isNull() & d.isNull() & t.isNull(), value).alias("text"))


def _canonical(value: Column, kind: Column) -> Column:
    """The value in the form of a type: numbers without sign +, leading zeros and trailing zeros of a fraction; null where it is none of that type."""
    sign = F.when(F.startswith(value, F.lit("-")), "-").otherwise("")
    bare = F.regexp_replace(value, "^[+-]", "")
    whole = F.regexp_replace(F.regexp_replace(bare, r"\..*$", ""), "^0+(?=[0-9])", "")
    part = F.when(F.contains(bare, F.lit(".")), F.regexp_replace(F.regexp_replace(bare, r"^[^.]*\.", ""), "0+$", "")).otherwise("")
    number = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))
    number = F.when(number == "0", number).otherwise(F.concat(sign, number))
    is_number = value.rlike(_PATTERNS["decimal"])
    return F.when(kind == "text", value).when((kind == "date") & value.rlike(_PATTERNS["date"]), value).when((kind == "integer") & value.rlike(_PATTERNS["integer"]), number).when((kind == "decimal") & is_number, number)


def unified(cells: DataFrame, schemas: DataFrame, listed: list[str]) -> DataFrame:
    """One row per file and line: each listed field's text, its typed branches and canonical form, and all other values as a map.

    The branches are structs ``{integer, decimal, date, text}`` of which one is set; the canonical
    form is that of the type which the field's files of the series have in common, null where the value is
    none.  Of several columns of one field in a line the leftmost value is the field's; the others,
    and cells without a header, are in the map ``extras`` under ``header#column``, columns counted from 1.
    """
    types = alternatives(schemas).select("series_id", "field_name", "fused_type").distinct()
    v = F.col("value")
    rows = cells.where("value IS NOT NULL").join(types, ["series_id", "field_name"], "left")
    w = W.partitionBy("file_id", "line_no", "field_name").orderBy("pos", "hdr")  # the columns of one field in one line
    ranked = rows.withColumn("_r", F.row_number().over(w))
    first = F.col("field_name").isNotNull() & (F.col("_r") == 1)
    name = F.when(first, F.col("field_name")).otherwise(F.concat(F.coalesce("hdr", F.lit("")), F.lit("#"), (F.col("pos") + 1).cast("string")))
    is_field = first & F.col("field_name").isin(*listed)
    kind = F.coalesce("fused_type", F.lit("text"))
    one = ranked.select("file_id", "line_no", name.alias("name"), is_field.alias("is_field"), v.alias("value"), F.when(is_field, _branches(v, F.col("kind"))).alias("branch"), F.when(is_field, _canonical(v, kind)).alias("canonical"))
    of = lambda c, f: F.max(F.when(F.col("is_field") & (F.col("name") == f), F.col(c)))
    return one.groupBy("file_id", "line_no").agg(
        *[of("value", f).alias(f) for f in listed],
        *[of("branch", f).alias(f"{f}_typed") for f in listed],
        *[of("canonical", f).alias(f"{f}_canonical") for f in listed],
        F.map_from_entries(F.sort_array(F.collect_list(F.when(~F.col("is_field"), F.struct("name", "value"))))).alias("extras"),
    )
