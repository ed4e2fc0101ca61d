"""Binary alignment files as a Spark data source: ``spark.read.format("bam").load(path)``.

A file with a ``.bai`` index is read as one partition per contig and run of blocks; one
without is one partition.  The path is a file, a folder, a pattern, or with the option ``paths`` a JSON list of
files; ``file:`` and any store that Arrow's file systems reach (``hdfs:``, ``s3:``, ``gs:``).  The option ``fields``
names the columns wanted; sequences are only decoded if asked for.  Options: ``fields``, ``barcode_tag`` (CB), ``umi_tag`` (UB).
"""

from __future__ import annotations

import fnmatch
import io
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "qname string, flag int, contig string, pos bigint, mapq int, cigar string, next_contig string, next_pos bigint, tlen bigint, seq string, cb string, umi string, nh int, sa string, strand string, file string"
#: Compressed bytes that a partition of an indexed file aims at.
SPLIT_BYTES = 64 << 20
# Fixed values of the format.
_OPS, _BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
# a base is one hexadecimal digit of the packed sequence
_FROM_HEX = str.maketrans("0123456789abcdef", _BASES)
_TO_HEX = str.maketrans(_BASES, "0123456789abcdef")
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_CODES = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


#: Files whose headers and indexes the driver reads at a time.
PLANNERS = 32
#: Bases of a piece of a long contig: the format's positions have 31 bits, so what lies beyond is in pieces named ``contig:piece:1`` and so on.
PIECE = 1 << 30
_PIECE_MARK = ":piece:"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


def found(path: str) -> list[str]:
    """The alignment files of a folder or pattern, or the file itself."""
    at, inner = store(path)
    prefix = path[: len(path) - len(inner)] if "://" in path else ""
    info = at.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.Directory:
        folder, pattern = inner, "*.bam"
    else:
        folder, _, pattern = inner.rpartition("/")
    rows = at.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True))
    return sorted(prefix + r.path for r in rows if r.type == fs.FileType.File and fnmatch.fnmatch(r.base_name, pattern))


class BlockReader:
    """Bytes of a blocked gzip file from a virtual offset (block offset << 16 | offset within)."""

    def __init__(self, path: str, start: int = 0) -> None:
        at, inner = store(path)
        self.f = open(inner, "rb") if isinstance(at, fs.LocalFileSystem) else io.BufferedReader(at.open_input_file(inner), 1 << 20)
        self.f.seek(start >> 16)
        self.at, self.block, self.i = start >> 16, b"", 0
        self._next()
        self.i = start & 0xFFFF

    def _next(self) -> bool:
        self.at = self.f.tell()
        head = self.f.read(12)
        if len(head) < 12:
            self.block, self.i = b"", 0
            return False
        extra = self.f.read(struct.unpack("<H", head[10:12])[0])
        i, size = 0, None
        while i + 4 <= len(extra):
            tag, n = extra[i : i + 2], struct.unpack("<H", extra[i + 2 : i + 4])[0]
            if tag == b"BC":
                size = struct.unpack("<H", extra[i + 4 : i + 6])[0] + 1
            i += 4 + n
        if head[:2] != b"\x1f\x8b" or size is None:
            raise ValueError("not a blocked gzip file")
        body = self.f.read(size - 12 - len(extra))
        self.block, self.i = zlib.decompress(body[:-8], -15), 0
        return True

    @property
    def offset(self) -> int:
        while self.i >= len(self.block) and self._next():
            pass
        return self.at << 16 | self.i

    def read(self, n: int) -> bytes:
        out = []
        while n:
            if self.i >= len(self.block):
                if not self._next():
                    break
                continue
            part = self.block[self.i : self.i + n]
            self.i += len(part)
            n -= len(part)
            out.append(part)
        return b"".join(out)

    def close(self) -> None:
        self.f.close()


def read_header(r: BlockReader) -> tuple[str, list[str]]:
    if r.read(4) != b"BAM\x01":
        raise ValueError("not an alignment file")
    text = r.read(struct.unpack("<i", r.read(4))[0]).rstrip(b"\0").decode()
    names = []
    for _ in range(struct.unpack("<i", r.read(4))[0]):
        names.append(r.read(struct.unpack("<i", r.read(4))[0]).rstrip(b"\0").decode())
        r.read(4)
    return text, names


def header_text(path: str) -> str:
    r = BlockReader(path)
    try:
        return read_header(r)[0]
    finally:
        r.close()


def _tags(data: bytes, i: int, wanted: set[str]) -> dict:
    out = {}
    while i + 3 <= len(data):
        tag, kind = data[i : i + 2].decode(), chr(data[i + 2])
        i += 3
        if kind in "ZH":
            end = data.index(0, i)
            value, i = data[i:end].decode(), end + 1
        elif kind == "B":
            n, item = struct.unpack("<i", data[i + 1 : i + 5])[0], chr(data[i])
            size = n * _SIZES[item]
            # of arrays only long lists of operations are wanted
            value, i = struct.unpack(f"<{n}{_CODES[item][1]}", data[i + 5 : i + 5 + size]) if tag in wanted else None, i + 5 + size
        elif kind == "A":
            value, i = chr(data[i]), i + 1
        else:
            value, i = struct.unpack(_CODES[kind], data[i : i + _SIZES[kind]])[0], i + _SIZES[kind]
        if tag in wanted:
            out[tag] = value
    return out


def parse_record(data: bytes, names: list[str], with_seq: bool, cb: str, umi: str) -> tuple:
    ref, pos, ln, mapq, _, n_ops, flag, n_seq, next_ref, next_pos, tlen = struct.unpack("<iiBBHHHiiii", data[:32])
    qname = data[32 : 32 + ln - 1].decode()
    i = 32 + ln
    ops = struct.unpack(f"<{n_ops}I", data[i : i + 4 * n_ops])
    i += 4 * n_ops
    seq = None
    if with_seq and n_seq:
        packed = data[i : i + (n_seq + 1) // 2]
        seq = packed.hex().translate(_FROM_HEX)[:n_seq]
    i += (n_seq + 1) // 2 + n_seq
    t = _tags(data, i, {cb, umi, "NH", "SA", "CG"})
    contig, pos = whole_place(names[ref] if ref >= 0 else None, pos)
    mate, next_pos = whole_place(names[next_ref] if next_ref >= 0 else None, next_pos)
    if t.get("CG") and n_ops and ops[0] == (n_seq << 4 | 4):
        ops = t["CG"]  # more operations than the record's own field can count; that one holds a clip of the whole read
    cigar = "".join(f"{o >> 4}{_OPS[o & 15]}" for o in ops) or "*"
    return qname, flag, contig, pos, mapq, cigar, mate, next_pos, tlen, seq, t.get(cb), t.get(umi), t.get("NH"), t.get("SA"), "-" if flag & 16 else "+"


_BATCH = 4096
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


@dataclass
class BamPartition(InputPartition):
    path: str
    start: int
    stop: int | None

    def __init__(self, path: str, start: int, stop: int | None) -> None:
        self.path, self.start, self.stop = path, start, stop


def _index(path: str) -> bytes | None:
    for p in (path + ".bai", os.path.splitext(path)[0] + ".bai"):
        at, inner = store(p)
        if at.get_file_info(inner).type == fs.FileType.File:
            with at.open_input_file(inner) as f:
                data = f.read()
            if data[:4] != b"BAI\x01":
                raise ValueError(f"not an index: {p}")
            return data
    return None


def read_index(path: str) -> tuple[list[int], tuple[int, int]] | None:
    """Virtual offsets at which records start, from the index's linear part, and the mapped and unmapped reads; null without an index."""
    data = _index(path)
    if data is None:
        return None
    n_ref, i, starts, mapped, unmapped = struct.unpack("<i", data[4:8])[0], 8, set(), 0, 0
    for _ in range(n_ref):
        n_bin, i = struct.unpack("<i", data[i : i + 4])[0], i + 4
        for _ in range(n_bin):
            number, n_chunk = struct.unpack("<Ii", data[i : i + 8])
            if number == 37450 and n_chunk == 2:  # fixed value: the bin that holds counts
                m, u = struct.unpack("<QQ", data[i + 24 : i + 40])
                mapped, unmapped = mapped + m, unmapped + u
            i += 8 + 16 * n_chunk
        n_int, i = struct.unpack("<i", data[i : i + 4])[0], i + 4
        starts.update(x for x in struct.unpack(f"<{n_int}Q", data[i : i + 8 * n_int]) if x)
        i += 8 * n_int
    if i + 8 <= len(data):
        unmapped += struct.unpack("<Q", data[i : i + 8])[0]
    return sorted(starts), (mapped, unmapped)


def index_starts(path: str) -> list[int] | None:
    index = read_index(path)
    return None if index is None else index[0]


class BamReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.cb, self.umi = options.get("barcode_tag", "CB"), options.get("umi_tag", "UB")
        fields = options.get("fields")
        self.with_seq = fields is None or "seq" in fields.replace(" ", "").split(",")
        self.paths = json.loads(options["paths"]) if "paths" in options else found(options["path"])
        if not self.paths:
            raise FileNotFoundError(options.get("path", "no paths"))

    def _plan(self, path: str) -> list[BamPartition]:
        r = BlockReader(path)
        read_header(r)
        cuts = [r.offset]
        r.close()
        for s in index_starts(path) or []:
            if (s >> 16) - (cuts[-1] >> 16) >= SPLIT_BYTES:
                cuts.append(s)
        return [BamPartition(path, a, b) for a, b in zip(cuts, [*cuts[1:], None])]

    def partitions(self) -> list[BamPartition]:
        with ThreadPoolExecutor(PLANNERS) as pool:
            return [p for parts in pool.map(self._plan, self.paths) for p in parts]

    def read(self, partition: BamPartition) -> Iterator[pa.RecordBatch]:
        r = BlockReader(partition.path)
        names = read_header(r)[1]
        r.close()
        r, held = BlockReader(partition.path, partition.start), []
        while partition.stop is None or r.offset < partition.stop:
            size = r.read(4)
            if len(size) < 4:
                break
            held.append((*parse_record(r.read(struct.unpack("<i", size)[0]), names, self.with_seq, self.cb, self.umi), partition.path))
            if len(held) == _BATCH:
                yield _as_batch(held)
                held = []
        if held:
            yield _as_batch(held)
        r.close()


class BamSource(DataSource):
    """Registered by :func:`register` as ``bam``."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)


def _block(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def in_header(contig: str, length: int) -> list[tuple[str, int]]:
    """The names and lengths of a contig in a header: itself, or its pieces if it is longer than a piece."""
    return [(contig if i == 0 else f"{contig}{_PIECE_MARK}{i}", min(PIECE, length - i * PIECE)) for i in range(max(1, -(-length // PIECE)))]


def whole_place(name: str | None, pos: int) -> tuple[str | None, int]:
    """Contig and position of a place in a piece."""
    contig, mark, i = name.rpartition(_PIECE_MARK) if name else ("", "", "")
    return (contig, pos + int(i) * PIECE) if mark and i.isdigit() else (name, pos)


def pack_record(r: dict, places: dict[str, int]) -> bytes:
    """One record of the fields of ``SCHEMA``; null tags are left out.  Places beyond a piece are in the contig's later pieces."""
    ops = [(int(n), op) for n, op in _CIGAR.findall(r["cigar"] or "")]
    seq = r["seq"] or ""
    packed = bytes.fromhex(re.sub("[^0-9a-e]", "f", seq.upper().translate(_TO_HEX)) + "0" * (len(seq) % 2))
    name = r["qname"].encode() + b"\0"
    tags = b"".join(t + b"Z" + r[c].encode() + b"\0" for t, c in ((b"CB", "cb"), (b"UB", "umi"), (b"SA", "sa")) if r[c] is not None)
    if len(ops) > 0xFFFF:
        tags += b"CGBI" + struct.pack(f"<i{len(ops)}I", len(ops), *(n << 4 | _OPS.index(op) for n, op in ops))
        ops = [(len(seq), "S"), (sum(n for n, op in ops if op in "MDN=X"), "N")]
    if r["nh"] is not None:
        tags += b"NHi" + struct.pack("<i", int(r["nh"]))
    contig, pos = r["contig"], int(r["pos"])
    if contig is not None and pos >= PIECE:
        contig, pos = f"{contig}{_PIECE_MARK}{pos // PIECE}", pos % PIECE
        if contig not in places:
            raise ValueError(f"{r['qname']}: {r['contig']}:{r['pos']} lies beyond the contig's length in the header")
    head = struct.pack("<iiBBHHHiiii", places.get(contig, -1), pos, len(name), 255 if r["mapq"] is None else int(r["mapq"]), 0, len(ops), int(r["flag"]), len(seq), places.get(r["next_contig"], -1), -1, int(r["tlen"] or 0))
    body = head + name + b"".join(struct.pack("<I", n << 4 | _OPS.index(op)) for n, op in ops) + packed + b"\xff" * len(seq) + tags
    return struct.pack("<i", len(body)) + body


_CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")
_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def write_bam(df, folder: str, contigs: list[tuple[str, int]], header: str = "@HD\tVN:1.6\n") -> int:
    """One file per partition of ``df`` in a folder that all executors share; returns the number of records."""
    at, inner = store(folder)
    at.create_dir(inner, recursive=True)
    contigs = [x for c, n in contigs for x in in_header(c, n)]
    places = {c: i for i, (c, _) in enumerate(contigs)}
    text = header + "".join(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in contigs)
    top = b"BAM\x01" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(contigs)) + b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in contigs)

    def run(parts):
        to, inner = store(folder)
        path, n, held = f"{inner.rstrip('/')}/part-{uuid.uuid4().hex}.bam", 0, top
        with to.open_output_stream(path + ".tmp") as f:
            for part in parts:
                for r in part.to_pylist():
                    held += pack_record(r, places)
                    n += 1
                    while len(held) >= 65_000:
                        f.write(_block(held[:65_000]))
                        held = held[65_000:]
            f.write((_block(held) if held else b"") + _END)
        to.move(path + ".tmp", path)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    cols = ["qname", "flag", "contig", "pos", "mapq", "cigar", "next_contig", "tlen", "seq", "cb", "umi", "nh", "sa"]
    return df.select(*cols).mapInArrow(run, "n bigint").groupBy().sum("n").first()[0] or 0
