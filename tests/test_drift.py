"""Problem 3 against a plain-Python reading of the statement, and its edge cases."""

import csv
import os
import re

import duckdb
import pytest

from hushgrain.operators import drift

DATA = "/root/testdata/sf0.01"
MISSING = {"", "NA", "n/a", "-"}


def norm(s):
    return re.sub("[^a-z0-9]", "", s.lower())


def kind(values):
    if not values:
        return None
    is_int = [bool(re.fullmatch(r"[+-]?\d+", v)) for v in values]
    is_dec = [bool(re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", v)) for v in values]
    is_date = [bool(re.fullmatch(r"\d{4}-\d\d-\d\d", v)) for v in values]
    for name, flags in (("integer", is_int), ("decimal", is_dec), ("date", is_date)):
        if sum(flags) >= 0.9 * len(flags):
            return name
    return "text"


def brute(files, lines, terms):
    listed = {norm(h): f for h, f in terms} | {"i5reversecomplement": "i5_seq"}
    by_file = {}
    for f, no, raw in set(lines):
        by_file.setdefault(f, []).append((no, raw.lstrip("﻿")))
    series = {}
    for f, s, at in {(f, s, at) for f, s, at in files}:
        series.setdefault(s, []).append((at, f))
    out = set()
    for members in series.values():
        earlier, before = {}, None
        for _, f in sorted(members):
            rows = sorted(by_file.get(f, []))
            rows = [r for _, r in rows if re.sub(r'[\s,;\t"]', "", r)]
            top = re.sub('"[^"]*"', "", rows[0]) if rows else ""
            delim = max(",;\t", key=top.count)
            cells = [[c.strip() for c in next(csv.reader([r], delimiter=delim, skipinitialspace=delim != "\t"))] for r in rows]
            head = [norm(c) for c in cells[0]] if cells else []
            if any(h in listed for h in head):
                body = cells[1:]
            else:
                head, body = ([norm(x) for x in ("Sample_Name", "i7_sequence", "i5_reverse_complement")] if rows else []), cells
            cols = [(i, h, [r[i] for r in body if i < len(r) and r[i] not in MISSING]) for i, h in enumerate(head) if h]
            own = {listed[h] for _, h, _ in cols if h in listed}
            now, claims = {}, []
            for i, h, v in cols:
                if h in listed:
                    now.setdefault(listed[h], (h, v))
                else:
                    best = [(len(set(v) & earlier.get(g, set())), g) for g in set(listed.values()) - own]
                    best = [(n, g) for n, g in best if v and n * 10 >= 9 * len(set(v))]
                    claims.append((h, v, max(best, key=lambda x: x[0])[1] if best else h))
            for h, v, g in claims:
                now[g] = (h, v)
            for g, (_, v) in now.items():
                earlier.setdefault(g, set()).update(v)
            if before is not None:
                for g in now.keys() | before.keys():
                    if g not in before:
                        out.add((f, g, "added"))
                    elif g not in now:
                        out.add((f, g, "removed"))
                    else:
                        if now[g][0] != before[g][0]:
                            out.add((f, g, "renamed"))
                        if (a := kind(now[g][1])) and (b := kind(before[g][1])) and a != b:
                            out.add((f, g, "type_changed"))
            before = now
    return out


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_against_brute_force(spark):
    c = duckdb.connect()
    q = lambda s: c.execute(s).fetchall()
    want = brute(q(f"SELECT file_id, series_id, exported_at FROM '{DATA}/sheet_files.parquet'"), q(f"SELECT file_id, line_no, raw_line FROM '{DATA}/sheet_lines.parquet'"), q(f"SELECT header_term, field_name FROM '{DATA}/sheet_terms.parquet'"))
    got = drift.drift(*(spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("sheet_files", "sheet_lines", "sheet_terms")))["changes"]
    rows = [(r.file_id, r.field_name, r.change_kind) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == want


def run(spark, files, lines):
    f = spark.createDataFrame([(*x, "clash") for x in files], "file_id long, series_id string, exported_at string, ord string")
    li = spark.createDataFrame([(*x, 7) for x in lines], "file_id long, line_no int, raw_line string, pos int")
    t = spark.createDataFrame([("Sample_Name", "sample_name"), ("note", "note"), ("plate", "plate_id")], "header_term string, field_name string")
    return drift.drift(f, li, t)


def test_small_cases(spark):
    """Repeated and unordered lines, blank lines, quotes, nulls, a rename by values, clashing extra columns."""
    files = [(1, "s", "2031-01-01"), (1, "s", "2031-01-01"), (2, "s", "2031-01-02"), (3, "s", "2031-01-03"), (None, "s", "2031-01-01"), (4, None, "2031-01-01")]
    lines = [(1, 2, 'a,"x, y",'), (1, 1, "﻿Sample_Name, Note ,"), (1, 2, 'a,"x, y",'), (1, 3, ",,"), (1, 4, None), (2, 1, "who;plate"), (2, 2, "a;1"), (2, 3, "NA;2"), (3, 1, "who\tplate\tplate"), (3, 2, "a\t1.5\t"), (3, 3, "b\t-\tzz\tstray"), (9, 1, "lost,1")]
    d = run(spark, files, lines)
    got = {(r.file_id, r.field_name, r.change_kind) for r in d["changes"].collect()}
    assert got == {(2, "sample_name", "renamed"), (2, "note", "removed"), (2, "plate_id", "added"), (3, "sample_name", "removed"), (3, "who", "added"), (3, "plate_id", "type_changed")}
    wide = {(r.file_id, r.line_no): r for r in drift.unified(d["cells"], d["schemas"], ["sample_name", "plate_id", "note"]).collect()}
    assert wide[(1, 2)].note == "x, y" and wide[(2, 2)].sample_name == "a" and wide[(2, 2)].plate_id_typed.integer == 1
    assert wide[(3, 2)].extras == {"who": "a"} and wide[(3, 2)].plate_id == "1.5" and wide[(3, 3)].extras == {"who": "b", "#4": "stray"}
    assert wide[(3, 3)].plate_id == "zz" and wide[(2, 2)].plate_id_canonical == "1"


def test_no_value_is_lost(spark):
    """Two columns of one field, cells without header and beyond it, numbers that a branch can't hold exactly: all are in the table."""
    files = [(1, "s", "2031-01-01"), (2, "s", "2031-01-02")]
    lines = [(1, 1, "Sample_Name,,plate,plate"), (1, 2, "a,loose,+007,8,beyond"), (1, 3, "b,,,9"), (2, 1, "Sample_Name,plate"), (2, 2, "c,1.50"), (2, 3, "d,0.1234567890123456789"), (2, 4, "e,123456789012345678901234567890")]
    d = run(spark, files, lines)
    wide = {(r.file_id, r.line_no): r for r in drift.unified(d["cells"], d["schemas"], ["sample_name", "plate_id"]).collect()}
    a = wide[(1, 2)]
    assert (a.sample_name, a.plate_id, a.plate_id_typed.integer, a.plate_id_canonical) == ("a", "+007", 7, "7")
    assert a.extras == {"#2": "loose", "plate#4": "8", "#5": "beyond"}
    assert wide[(1, 3)].plate_id == "9" and wide[(1, 3)].extras == {}
    assert wide[(2, 2)].plate_id_canonical == "1.5" and str(wide[(2, 2)].plate_id_typed.decimal) == "1.500000000000000000"
    assert wide[(2, 3)].plate_id_typed.text == "0.1234567890123456789" == wide[(2, 3)].plate_id_canonical and wide[(2, 3)].plate_id_typed.decimal is None
    assert wide[(2, 4)].plate_id_typed.text == "123456789012345678901234567890"
    alt = {(r.field_name, r.type): r.fused_type for r in drift.alternatives(d["schemas"]).collect()}
    assert alt == {("sample_name", "text"): "text", ("plate_id", "integer"): "decimal", ("plate_id", "decimal"): "decimal"}
    total = sum(len([c for c in raw.split(",") if c]) for _, no, raw in lines if no > 1)
    assert sum(sum(x is not None for x in (r.sample_name, r.plate_id)) + len(r.extras) for r in wide.values()) == total


def test_empty(spark):
    d = run(spark, [], [])
    assert d["changes"].count() == 0 and drift.alternatives(d["schemas"]).count() == 0 and drift.unified(d["cells"], d["schemas"], ["note"]).count() == 0
