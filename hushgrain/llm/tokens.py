"""Token ids of every text by a public byte-level BPE vocabulary.

Texts are encoded as ordinary text: a string that looks like a marker is no marker.
Null and empty texts have no ids.

Tree concatenation of long texts: a text is halved, and its halves are encoded in parallel
threads (the encoder runs outside the interpreter's lock), so texts are read once and none is shuffled.  A cut where white space follows other text always separates two pre-tokens, so the
halves' ids agree with the whole's as they are.  Only text that has no such place is cut
inside a pre-token; there windows around each join are encoded again, growing until their
first and last token agree with what both sides have.  Then every pair of neighbours is one
that BPE itself produces, which holds for exactly one sequence: the encoding of the whole.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's pre-token pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed value: Unicode white space, which the encoder means by ``\\s``; other engines' ``\\s`` differ in control characters.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PRE_TOKEN = regex.compile(PATTERN.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))
_BLANK = regex.compile(f"[{_SPACE}]+")
#: Characters (bytes of a single pre-token) that are encoded in one go.
LEAF = 16_384
#: Texts of more characters are encoded by several threads.
SPREAD = 32_768
THREADS = 4


def encoder(path: str = VOCABULARY):
    """The encoder of a vocabulary file; one per process."""
    held = sys.__dict__.setdefault("_hushgrain_encoders", {})
    if path not in held:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        held[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return held[path]


def _cut(text: str) -> int | None:
    """The place nearest the middle where plain white space follows a letter, digit or ASCII mark."""
    middle = len(text) // 2

    def fits(p: int) -> bool:
        return text[p] in " \n\t\r" and (text[p - 1].isalnum() or "!" <= text[p - 1] <= "~")

    for step in range(middle):
        if middle + step < len(text) and fits(middle + step):
            return middle + step
        if middle - step > 0 and fits(middle - step):
            return middle - step
    return None


def halves(text: str, leaf: int) -> list[tuple[bool, bytes]]:
    """The leaves of a text in order: ``(raw, bytes)``; consecutive raw leaves are parts of one pre-token."""
    todo, out = [text], []
    while todo:
        t = todo.pop()
        if len(t) <= leaf:
            out.append((False, t.encode()))
        elif (p := _cut(t)) is not None:
            todo += [t[p:], t[:p]]
        else:
            out += _unsplit(t, leaf)
    return out


def _unsplit(text: str, leaf: int) -> list[tuple[bool, bytes]]:
    """Leaves of text without a place to cut: whole pre-tokens together, and halves of pre-tokens that are too long."""
    out, held, size = [], [], 0

    def close() -> None:
        nonlocal held, size
        if held:
            out.append((False, "".join(held).encode()))
        held, size = [], 0

    for m in _PRE_TOKEN.finditer(text):
        piece = m.group()
        raw = piece.encode()
        if len(raw) > leaf:
            close()
            todo = [raw]
            while todo:
                b = todo.pop()
                if len(b) <= leaf:
                    out.append((True, b))
                else:
                    todo += [b[len(b) // 2 :], b[: len(b) // 2]]
            out.append((False, b""))  # ends the pre-token
            continue
        if _BLANK.fullmatch(piece):  # how white space is cut depends on what follows, so it stays alone
            close()
            out.append((False, raw))
            continue
        if size + len(piece) > leaf:
            close()
        held.append(piece)
        size += len(piece)
    close()
    return out


def encode_leaf(enc, raw: bool, data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint32)
    if raw:
        return np.asarray(enc._encode_single_piece(data), np.uint32)
    return enc.encode_to_numpy(data.decode())


def join(enc, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The encoding of two neighbouring parts of one pre-token from theirs."""
    if not len(left) or not len(right):
        return np.concatenate([left, right])
    w = 4
    while True:
        a, b = left[-w:], right[:w]
        window = enc._encode_single_piece(enc.decode_bytes([*a.tolist(), *b.tolist()]))
        if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
            return np.concatenate([left[: len(left) - len(a)], np.asarray(window, np.uint32), right[len(b) :]])
        w *= 2


def concatenate(enc, leaves: list[tuple[bool, np.ndarray]]) -> np.ndarray:
    """Join the ids of leaves in order; runs of raw leaves pairwise, as a tree."""
    out, run = [], []

    def close():
        nonlocal run
        while len(run) > 1:
            run = [join(enc, *run[i : i + 2]) if i + 1 < len(run) else run[i] for i in range(0, len(run), 2)]
        out.extend(run)
        run = []

    for raw, ids in leaves:
        if raw:
            run.append(ids)
        else:
            close()
            out.append(ids)
    close()
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def encode_text(enc, text: str | None, leaf: int = LEAF, pool: ThreadPoolExecutor | None = None) -> np.ndarray:
    """The ids of one text; its leaves go to the threads of ``pool`` if there is one."""
    if not text:
        return np.empty(0, np.uint32)
    if len(text) <= leaf:
        return enc.encode_to_numpy(text)
    leaves = halves(text, leaf)
    ids = (map if pool is None else pool.map)(lambda x: encode_leaf(enc, *x), leaves)
    return concatenate(enc, [(raw, x) for (raw, _), x in zip(leaves, ids)])


def _batch(schema: pa.Schema, ids: list, tokens: list[np.ndarray], count_only: bool) -> pa.RecordBatch:
    if count_only:
        second = pa.array([len(t) for t in tokens], pa.int64())
    else:
        offsets = np.zeros(len(tokens) + 1, np.int32)
        np.cumsum([len(t) for t in tokens], out=offsets[1:])
        second = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tokens).astype(np.int32) if tokens else np.empty(0, np.int32)))
    return pa.RecordBatch.from_arrays([ids, second], names=schema)


def encode(df: DataFrame, ident: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, count_only: bool = False, leaf: int = LEAF, spread: int = SPREAD) -> DataFrame:
    """``ident, ids`` (array of int), or with ``count_only`` ``ident, n_tokens``: one row per row of ``df``.

    Null and empty texts give an empty list (0 tokens).  ``ident`` may be null or repeated; each row
    keeps its own.  Texts of more than ``spread`` characters use several threads.  Other columns are ignored.
    """
    kind = df.schema[ident].dataType.simpleString()
    out = f"`{ident}` {kind}, " + ("n_tokens bigint" if count_only else "ids array<int>")
    names = [ident, "n_tokens" if count_only else "ids"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        with ThreadPoolExecutor(THREADS) as pool:
            for part in parts:
                start, got, size = 0, [], 0
                for i, t in enumerate(part.column(1)):
                    t = t.as_py()
                    got.append(encode_text(enc, t, leaf, pool if t and len(t) > spread else None))
                    size += len(got[-1])
                    if size > 2_000_000:
                        yield _batch(names, part.column(0).slice(start, len(got)), got, count_only)
                        start, got, size = i + 1, [], 0
                if got:
                    yield _batch(names, part.column(0).slice(start, len(got)), got, count_only)

    return df.select(F.col(ident).alias(ident), F.col(text).alias("_text")).mapInArrow(run, out)
