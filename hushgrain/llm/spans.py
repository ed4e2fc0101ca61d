"""Exact spans of at least a given length that stand in more than one record.

Suffix automata of reference shards.  An anchor is a run of ``anchor`` characters that is the
least, by hash, of some window of ``length - anchor + 1`` runs.  Equal spans of ``length``
characters have equal windows, hence an equal anchor at the same place, so both their records
hold it.  Anchors that follow each other in the same records at the same distances are one
group.  A shard holds a group's surroundings in every record that has it; its reference is the
distinct texts among them, of which one generalised suffix automaton is built.  The shard's
records are streamed through it: a position's matching statistic, climbed to the first state of at
least ``length`` characters, tells which texts hold that window, and windows whose texts
belong to several records are the shared spans.  Texts are compared as texts throughout.

A shard with more than ``max_texts`` distinct texts or ``MAX_CHARS`` characters of them, such as a formula that a third of all
records contain in different places, is halved by the places of its windows, and each half is
divided by the characters that all its windows have in common, until the reference is small
enough.  A shard of many records is divided among tasks, each of which gets the whole
reference.  So tasks are bounded, and every link comes out of an automaton.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hushgrain.storage import is_small, lookup_join, materialise, release

LENGTH = 200
ANCHOR = 64
#: Distinct texts of a reference shard and their characters, records of a task's part of a shard, characters that a group of anchors extends over.
MAX_TEXTS = 256
MAX_CHARS = 1 << 17
MAX_ROWS = 4096
MAX_EXTENT = 4096
#: Log2 of the bits of the filter on records that precedes a shuffle of their texts; it is at most 4 MB as a table.
FILTER_BITS = 24

# Multiplier of the rolling hash over code points, odd; any odd value does.
_BASE = 0x9E3779B97F4A7C15


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, extended as needed."""

    def __init__(self) -> None:
        self.n, self.up, self.down = 0, None, None

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 14)
            self.up = np.cumprod(np.full(self.n, _BASE, np.uint64))
            self.down = np.cumprod(np.full(self.n, pow(_BASE, -1, 1 << 64), np.uint64))
        return self.up, self.down


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def run_hashes(text: str, k: int, powers: _Powers) -> np.ndarray:
    """The hash of every run of ``k`` characters, by prefix sums."""
    # Spark's strings are valid UTF-8; one 32-bit unit is one code point
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(a)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = powers.get(n + 1)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum(_mix(a + np.uint64(1)) * up[:n], out=h[1:])
    return _mix((h[k:] - h[:-k]) * down[: n - k + 1])


def minimizers(g: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least value of some ``w`` consecutive ones, the leftmost among equals."""
    m = len(g)
    pad = -m % w
    block = np.concatenate([g, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: m - w + 1], ahead[w - 1 : m])
    at = np.flatnonzero(np.isin(g, least))
    # exact: keep positions that are the leftmost least of a window of their own
    if len(at) > 4 * m // w + 16:
        last: dict[int, int] = {}
        keep = []
        for p in at.tolist():
            v = int(g[p])
            first = max(0, p - w + 1, last.get(v, -1) + 1)  # windows that start here hold no equal value before p
            stop = min(p, m - w)
            if first <= stop and (least[first : stop + 1] == g[p]).any():
                keep.append(p)
            last[v] = p
        at = np.asarray(keep, np.int64)
    return at


def anchors(docs: DataFrame, ident: str, text: str, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``fp, doc, at``: each anchor's hash and place."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = _Powers()
        for part in parts:
            out, size = [], 0
            for doc, t in zip(part["doc"].to_numpy(), part["text"].to_numpy()):
                g = run_hashes(t, anchor, powers)
                if len(g) <= length - anchor:
                    continue
                at = minimizers(g, length - anchor + 1)
                out.append((g[at].view(np.int64), np.full(len(at), doc), at))
                size += len(at)
                if size > 100_000:
                    yield _anchor_frame(out)
                    out, size = [], 0
            if out:
                yield _anchor_frame(out)

    return _texts(docs, ident, text, length).mapInPandas(run, "fp long, doc long, at int")


def _texts(docs: DataFrame, ident: str, text: str, length: int) -> DataFrame:
    return docs.where(F.col(ident).isNotNull() & (F.length(text) >= length)).select(F.col(ident).cast("long").alias("doc"), F.col(text).alias("text"))


def _anchor_frame(out: list) -> pd.DataFrame:
    fp, doc, at = (np.concatenate(x) for x in zip(*out))
    return pd.DataFrame({"fp": fp, "doc": doc, "at": at.astype(np.int32)})


def groups(kept: DataFrame, side: int, extent: int = MAX_EXTENT) -> DataFrame:
    """``fp, span``: the first anchor of each group, and how far its last lies behind it.

    Anchors are chained in the first record that holds them, where they follow each other within
    ``side + 1`` characters, occur once in each of the same records, and lie at the same distance in all of
    them: sums of the records' hashes, plain and times the distance to the first record's place, agree.
    """
    per = kept.groupBy("fp", "doc").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    h = [F.pmod(F.xxhash64(F.lit(i), "doc"), F.lit(1 << 31)).cast("decimal(20,0)") for i in range(2)]
    sums = [F.sum(x).cast("decimal(38,0)").alias(f"b{i}") for i, x in enumerate(h)] + [F.sum((x * F.col("at")).cast("decimal(24,0)")).cast("decimal(38,0)").alias(f"a{i}") for i, x in enumerate(h)]
    sig = per.groupBy("fp").agg(F.min(F.struct("doc", "at")).alias("ref"), F.max("n").alias("most"), F.count(F.lit(1)).alias("n"), *sums)
    same = F.struct("n", "b0", "b1", *[(F.col(f"a{i}") - (F.col("ref.at") * F.col(f"b{i}")).cast("decimal(38,0)")).cast("decimal(38,0)").alias(f"d{i}") for i in range(2)])
    rows = sig.select("fp", F.col("ref.doc").alias("doc"), F.col("ref.at").alias("at"), "most", same.alias("same"))
    w = W.partitionBy("doc").orderBy("at", "fp")  # one record's anchors
    follows = (F.lag("same").over(w) == F.col("same")) & (F.col("most") == 1) & (F.lag("most").over(w) == 1) & (F.col("at") - F.lag("at").over(w) <= side + 1)
    rows = rows.withColumn("_new", F.when(follows, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    part = ((F.col("at") - F.min("at").over(W.partitionBy("doc", "_run"))) / extent).cast("int")
    return rows.withColumn("_part", part).groupBy("doc", "_run", "_part").agg(F.min_by("fp", "at").alias("fp"), (F.max("at") - F.min("at")).alias("span")).select("fp", "span")


def _slices(places: DataFrame, docs: DataFrame, length: int, side: int) -> DataFrame:
    """``key, lo, hi, doc, start, left, text``: the surroundings of each place, from ``lo`` to ``hi + length`` as seen from the anchor, which is ``left`` characters in."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for doc, t, fps, ats, spans in zip(part["doc"].tolist(), part["text"], part["fp"], part["at"], part["span"]):
                for fp, at, span in zip(fps.tolist(), ats.tolist(), spans.tolist()):
                    start = max(at - side, 0)
                    out.append((fp, -side, span, doc, start, at - start, t[start : at + span + length]))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=_PIECE)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=_PIECE)

    of = places.groupBy("doc").agg(F.collect_list(F.struct("fp", "at", "span")).alias("x")).select("doc", "x.fp", "x.at", "x.span")
    if is_small(places):
        rows = docs.join(F.broadcast(of), "doc")
    else:
        slot = F.pmod(F.xxhash64("doc"), F.lit(1 << FILTER_BITS))
        bit = F.expr("shiftleft(1L, cast(_slot % 64 as int))")
        words = places.select(slot.alias("_slot")).groupBy(F.expr("_slot div 64").alias("_word")).agg(F.bit_or(bit).alias("_mask"))
        some = docs.withColumn("_slot", slot).withColumn("_word", F.expr("_slot div 64")).join(F.broadcast(words), "_word").where(F.col("_mask").bitwiseAND(bit) != 0)
        rows = some.select("doc", "text").join(of.hint("merge"), "doc")  # lists are larger than their files, by which the planner would broadcast them
    return rows.mapInPandas(run, "key long, lo int, hi int, doc long, start int, left int, text string")


_PIECE = ["key", "lo", "hi", "doc", "start", "left", "text"]


class SuffixAutomaton:
    """The automaton of several texts, built online; ``ends`` has each text's states by position."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.len, self.ends = [-1], [0], []

    def add(self, text: str) -> None:
        """Stream one text through the automaton, extending it where it goes beyond."""
        nxt, link, ln, last, states = self.next, self.link, self.len, 0, []
        for c in text:
            q = nxt[last].get(c)
            if q is not None and ln[q] == ln[last] + 1:
                last = q
                states.append(q)
                continue
            p = last
            if q is not None:
                copy = len(ln)
                ln.append(ln[p] + 1)
                nxt.append(nxt[q].copy())
                link.append(link[q])
                link[q] = copy
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                last = copy
                states.append(copy)
                continue
            new = len(ln)
            ln.append(ln[p] + 1)
            nxt.append({})
            link.append(0)
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if ln[q] == ln[p] + 1:
                    link[new] = q
                else:
                    copy = len(ln)
                    ln.append(ln[p] + 1)
                    nxt.append(nxt[q].copy())
                    link.append(link[q])
                    link[q] = link[new] = copy
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = copy
                        p = link[p]
            last = new
            states.append(new)
        self.ends.append(states)

    def shared(self, length: int, owners: list[tuple[int, int]]) -> list[list[tuple[int, int, int]]]:
        """The spans of at least ``length`` in texts of several records: for each the ends ``(text, first, last)`` of its windows of ``length``.

        ``owners`` has the least and the greatest record of each text.
        """
        n, link, ln = len(self.len), self.link, self.len
        mask = [0] * n
        for i, states in enumerate(self.ends):
            for s in states:
                mask[s] |= 1 << i
        for s in sorted(range(1, n), key=ln.__getitem__, reverse=True):
            if mask[s]:
                mask[link[s]] |= mask[s]
        crossing: dict[int, int] = {}
        found: dict[int, list[tuple[int, int, int]]] = {}
        several: dict[int, bool] = {}
        for i, states in enumerate(self.ends):
            for end in range(length - 1, len(states)):
                v, path = states[end], []
                while v not in crossing and ln[link[v]] >= length:
                    path.append(v)
                    v = link[v]
                v = crossing.get(v, v)
                for p in path:
                    crossing[p] = v
                m = mask[v]
                if m not in several:
                    of = [o for k, o in enumerate(owners) if m >> k & 1]
                    several[m] = min(a for a, _ in of) != max(b for _, b in of)
                if several[m]:
                    runs = found.setdefault(m, [])
                    if runs and runs[-1][0] == i and runs[-1][2] == end - 1:
                        runs[-1] = (i, runs[-1][1], end)
                    else:
                        runs.append((i, end, end))
        return list(found.values())

    def aligned(self, length: int, owners: list[tuple[int, int]]) -> list[list[tuple[int, int, int]]]:
        """The spans of at least ``length``, each the same characters at all its places ``(text, first, last)``, the ends of its windows.

        A window of ``length`` is one state; windows that follow each other at all their places, and at no others, are one span.
        """
        link, ln = self.link, self.len
        window: dict[int, int] = {}
        at: list[list[int]] = []
        places: dict[int, list[tuple[int, int]]] = {}
        for i, states in enumerate(self.ends):
            row = []
            for end in range(length - 1, len(states)):
                v, path = states[end], []
                while v not in window and ln[link[v]] >= length:
                    path.append(v)
                    v = link[v]
                v = window.get(v, v)
                for p in path:
                    window[p] = v
                places.setdefault(v, []).append((i, end))
                row.append(v)
            at.append(row)
        off = length - 1

        def beside(v: int, step: int) -> int | None:
            """The window ``step`` on at every place of ``v``, if it is one and has no other places."""
            w = None
            for i, end in places[v]:
                k = end - off + step
                if not 0 <= k < len(at[i]) or (w is not None and at[i][k] != w):
                    return None
                w = at[i][k]
            return w if len(places[w]) == len(places[v]) else None

        out = []
        for v, where in places.items():
            if min(owners[i][0] for i, _ in where) != max(owners[i][1] for i, _ in where) and beside(v, -1) is None:
                n, w = 0, v
                while (w := beside(w, 1)) is not None:
                    n += 1
                out.append([(i, end, end + n) for i, end in where])
        return out


def _shard_spans(length: int, aligned: bool):
    """Over rows sorted by shard: each shard's spans and their places in its records."""

    def one(key: int, rows: list[tuple]) -> Iterator[tuple]:
        owners: dict[str, tuple[int, int]] = {}
        for _, _, t, a, b in rows:
            x = owners.get(t)
            owners[t] = (a, b) if x is None else (min(a, x[0]), max(b, x[1]))
        if min(a for a, _ in owners.values()) == max(b for _, b in owners.values()):
            return
        texts = sorted(owners)  # the same in every task that has a part of the shard
        automaton = SuffixAutomaton()
        for t in texts:
            automaton.add(t)
        found = (automaton.aligned if aligned else automaton.shared)(length, [owners[t] for t in texts])
        per: dict[str, list[tuple[int, int, int]]] = {}
        for no, places in enumerate(found):
            for i, first, last in places:
                per.setdefault(texts[i], []).append((no, first - length + 1, last + 1))
        for doc, start, t, _, _ in rows:
            if start >= 0:
                for no, first, last in per.get(t, ()):
                    yield key, no, doc, start + first, start + last

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rows, out = None, [], []
        cols = ["key", "no", "doc", "first", "last"]
        for part in parts:
            for key, salt, *row in zip(*[part[c].tolist() for c in ("key", "salt", "doc", "start", "text", "a", "b")]):
                if (key, salt) != at:
                    if rows:
                        out += one(at[0], rows)
                    at, rows = (key, salt), []
                rows.append(tuple(row))
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=cols)
                    out = []
        if rows:
            out += one(at[0], rows)
        if out:
            yield pd.DataFrame(out, columns=cols)

    return run


def _sizes(pieces: DataFrame) -> DataFrame:
    """``key, narrow, n_texts, n_chars, n_rows`` of shards of several records; ``narrow``: all windows lie at one place."""
    texts = pieces.groupBy("key", (F.col("lo") == F.col("hi")).alias("narrow"), F.xxhash64("text").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("a"), F.max("doc").alias("b"), F.max(F.length("text")).alias("c"))
    return texts.groupBy("key", "narrow").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("c").alias("n_chars"), F.sum("n").alias("n_rows"), F.min("a").alias("a"), F.max("b").alias("b")).where("a != b").drop("a", "b")


def _halved(pieces: DataFrame, length: int) -> DataFrame:
    """Each piece for either half of its windows' places, its shard told apart by the characters that all windows of the half have."""
    mid = F.expr("cast(floor((lo + hi) / 2) as int)")
    two = F.explode(F.array(F.struct(F.col("lo").alias("l"), mid.alias("h")), F.struct((mid + 1).alias("l"), F.col("hi").alias("h"))))
    rows = pieces.where("lo < hi").withColumn("_r", two).withColumns({"l": F.col("_r.l"), "h": F.col("_r.h")}).drop("_r")
    skip = F.greatest(F.col("left") + F.col("l"), F.lit(0))  # of the piece's characters
    rows = rows.withColumn("_skip", skip).withColumn("text", F.expr(f"substring(text, _skip + 1, left + h + {length} - _skip)")).where(F.length("text") >= length)
    rows = rows.withColumns({"start": F.col("start") + F.col("_skip"), "left": F.col("left") - F.col("_skip")})
    common = F.when(F.col("h") - F.col("l") < length, F.expr(f"substring(text, left + h + 1, {length} - (h - l))")).otherwise("")
    return rows.select(F.xxhash64("key", "l", "h", common).alias("key"), F.col("l").alias("lo"), F.col("h").alias("hi"), "doc", "start", "left", "text")


def shared_spans(docs: DataFrame, ident: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, max_texts: int = MAX_TEXTS, aligned: bool = False, max_rows: int = MAX_ROWS, extent: int = MAX_EXTENT) -> DataFrame:
    """``span, doc, first, last``: the places ``[first, last)`` of shared spans of at least ``length`` characters.

    Every run of ``length`` characters that two different records share lies within a span that has
    both as members, at those places; a span has at least two different records.  Spans overlap and
    repeat; see :func:`coverage` and :func:`pairs`.  Characters are code points, compared as they
    stand.  Null and short texts share nothing; rows of equal ``ident`` are one record; null idents
    are left out; an empty table gives an empty one.  With ``aligned`` a span has the same
    characters at all its places; see :func:`maximal`.
    """
    side = length - anchor
    found = materialise(anchors(docs, ident, text, length, anchor), "anchors")
    several = materialise(found.groupBy("fp").agg(F.min("doc").alias("_a"), F.max("doc").alias("_b")).where("_a != _b").select("fp"), "shared")
    kept = materialise(lookup_join(found, several, ["fp"]), "kept")
    release(found, several)
    places = materialise(lookup_join(kept, materialise(groups(kept, side, extent), "groups"), ["fp"]), "places")
    release(kept)
    pieces, ready = materialise(_slices(places, _texts(docs, ident, text, length), length, side), "pieces"), []
    release(places)
    while pieces is not None:
        sizes = materialise(_sizes(pieces), "sizes")
        fits = (F.col("n_texts") <= max_texts) & (F.col("n_chars") <= MAX_CHARS) | F.col("narrow")
        # written by round: one query over all rounds would hold the lookups of all of them in the driver at once
        ready.append(materialise(lookup_join(pieces, sizes.where(fits).select("key", "n_rows"), ["key"]).select("key", "n_rows", "doc", "start", "text"), "ready"))
        large = sizes.where(~fits).select("key")
        more = None if large.isEmpty() else materialise(_halved(lookup_join(pieces, large, ["key"]), length), "pieces")
        release(pieces, sizes)
        pieces = more
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.unionByName(more)
    parts = F.expr(f"cast((n_rows - 1) div {max_rows} + 1 as int)")
    own = rows.select("key", F.pmod(F.xxhash64("doc", "start"), parts).cast("int").alias("salt"), "doc", "start", "text", F.col("doc").alias("a"), F.col("doc").alias("b"))
    # the reference of a shard that several tasks have a part of goes to each of them
    of = rows.where(F.col("n_rows") > max_rows).groupBy("key", "n_rows", "text").agg(F.min("doc").alias("a"), F.max("doc").alias("b"))
    reference = of.select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), F.lit(-1).cast("long").alias("doc"), F.lit(-1).alias("start"), "text", "a", "b")
    placed = own.unionByName(reference).repartition("key", "salt").sortWithinPartitions("key", "salt").mapInPandas(_shard_spans(length, aligned), "key long, no int, doc long, first int, last int")
    spans = materialise(placed.select(F.xxhash64("key", "no").alias("span"), "doc", "first", "last"), "placed")
    release(*ready)
    return spans


def _groups(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of each span, and one span for each set of records with its size and ends."""
    member = materialise(spans.select("span", "doc").distinct(), "members")
    sign = member.groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc")).alias("x0"), F.bit_xor(F.xxhash64(F.lit(1), "doc")).alias("x1"), F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    return member, materialise(sign.groupBy("n", "x0", "x1", "lo", "hi").agg(F.min("span").alias("span")), "signs")


def link_groups(spans: DataFrame) -> DataFrame:
    """``group_id, doc, n_members``: two records have a span in common just if they are in a group together.

    As many rows as spans have records, never their square; groups of the same records are one, told by mergeable
    sums of their hashes.
    """
    member, once = _groups(spans)
    return lookup_join(member, once.select("span", F.col("n").alias("n_members")), ["span"]).withColumnRenamed("span", "group_id")


def pairs(spans: DataFrame, part: int = 1024) -> DataFrame:
    """``doc_id_a, doc_id_b``: the distinct pairs of records with a span in common, the smaller first.

    Groups of the same records are joined once; a group of more than ``part`` records is joined part by part.
    """
    member, once = _groups(spans)
    two = once.where("n = 2").select(F.col("lo").alias("doc_id_a"), F.col("hi").alias("doc_id_b"))
    more = lookup_join(member, once.where("n > 2").select("span", F.expr(f"cast((n - 1) div {part} + 1 as int)").alias("parts")), ["span"])
    a = more.select("span", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part"), F.col("doc").alias("doc_id_a"))
    b = more.select("span", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("doc").alias("doc_id_b"))
    return a.join(b, ["span", "part"]).where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b").unionByName(two).distinct()


def text_classes(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, class_id, n_copies``: records of equal text (by SHA-256) are one class, named by the least of them; a null text is a class of its own."""
    keyed = docs.where(F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("doc"), F.coalesce(F.sha2(F.encode(text, "UTF-8"), 256), F.col(ident).cast("string")).alias("_h")).distinct()
    keyed = materialise(keyed, "texts")
    classes = materialise(keyed.groupBy("_h").agg(F.min("doc").alias("class_id"), F.count(F.lit(1)).alias("n_copies")), "classes")
    return lookup_join(keyed, classes, ["_h"]).select("doc", "class_id", "n_copies")


def removed(docs: DataFrame, spans: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident, text, n_removed``: texts without the spans that stand in a record of lesser ident as well.

    Of every shared span the record of least ident keeps its copy.  Null and empty texts stay as they are; rows with a null ident are left out.
    """
    first = spans.groupBy("span").agg(F.min("doc").alias("_first"))
    later = lookup_join(spans, materialise(first, "firsts"), ["span"]).where(F.col("doc") != F.col("_first")).select("doc", "first", "last")
    cuts = coverage(later).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("x")).select("doc", "x.first", "x.last")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out, n = [], []
            for t, a, b in zip(part["text"], part["first"], part["last"]):
                if t is None or a is None:
                    out.append(t)
                    n.append(0)
                    continue
                at, kept = 0, []
                for p, q in zip(a.tolist(), b.tolist()):
                    kept.append(t[at:p])
                    at = q
                out.append("".join([*kept, t[at:]]))
                n.append(len(t) - len(out[-1]))
            yield pd.DataFrame({"doc": part["doc"], "text": out, "n_removed": n})

    rows = docs.where(F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("doc"), F.col(text).alias("text"))
    cut = rows.join(F.broadcast(cuts) if is_small(cuts) else cuts.hint("merge"), "doc", "left").select("doc", "text", "first", "last").mapInPandas(run, "doc long, text string, n_removed long")
    return cut.withColumnsRenamed({"doc": ident, "text": text})


def maximal(aligned: DataFrame) -> DataFrame:
    """``span, doc, first, last``: the two places of every maximal verbatim span that two records share.

    A span goes as far in both directions as both records agree.  Pieces of a pair of records at
    one offset that overlap or adjoin are one span.  There are as many rows as pairs of places
    ask for, which is quadratic in the records of a formula.
    """
    a, b = (aligned.select("span", F.col("doc").alias(f"_{x}"), F.col("first").alias(f"_{x}0"), "last").withColumnRenamed("last", f"_{x}1") for x in "ab")
    both = a.join(b, "span").where("_a < _b").select("_a", "_b", (F.col("_b0") - F.col("_a0")).alias("_off"), "_a0", "_a1")
    key = ["_a", "_b", "_off"]
    once = both.groupBy(*key, "_a0").agg(F.max("_a1").alias("_a1"))
    w = W.partitionBy(*key).orderBy("_a0")
    before = F.max("_a1").over(w.rowsBetween(W.unboundedPreceding, -1))
    island = once.withColumn("_new", F.when(before >= F.col("_a0"), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w))
    whole = island.groupBy(*key, "_island").agg(F.min("_a0").alias("_from"), F.max("_a1").alias("_to"))
    span = F.concat_ws(":", "_a", "_from", "_b", F.col("_from") + F.col("_off")).alias("span")
    place = lambda doc, off: F.struct(F.col(doc).alias("doc"), (F.col("_from") + off).cast("int").alias("first"), (F.col("_to") + off).cast("int").alias("last"))
    return whole.select(span, F.explode(F.array(place("_a", F.lit(0)), place("_b", F.col("_off")))).alias("p")).select("span", "p.*")


def coverage(spans: DataFrame) -> DataFrame:
    """``doc, first, last``: the shared spans of each record, overlapping and adjoining ones merged."""
    w = W.partitionBy("doc").orderBy("first", "last")
    once = spans.groupBy("doc", "first").agg(F.max("last").alias("last"))
    before = F.max("last").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = once.withColumn("_new", F.when(before >= F.col("first"), 0).otherwise(1))
    island = marked.withColumn("_island", F.sum("_new").over(w))
    return island.groupBy("doc", "_island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_island")


def shares(docs: DataFrame, cover: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident, n_chars, shared_chars, n_spans, share``: how much of every record also stands elsewhere, and at how many places, merged ones counted once; 0 for empty and null texts."""
    per = cover.groupBy(F.col("doc").alias(ident)).agg(F.sum(F.col("last") - F.col("first")).alias("shared_chars"), F.count(F.lit(1)).alias("n_spans"))
    rows = docs.select(ident, F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars")).join(per, ident, "left")
    rows = rows.withColumns({"shared_chars": F.coalesce("shared_chars", F.lit(0)), "n_spans": F.coalesce("n_spans", F.lit(0))})
    return rows.withColumn("share", F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)))
