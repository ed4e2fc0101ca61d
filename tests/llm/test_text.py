"""Problems 6, 7 and 8: token ids, packing, shared spans."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushgrain.llm import packing, spans, tokens

SMALL = "/root/testdata/sf0.001"

# --- token ids ---

_PARTS = list("aabbcC012 \n\t'!<|>_-éß漢字😀") + ["\u200b", "\u2009", "\x1c", "\x85", "'re", "'ll", "the", "ing", "<|endoftext|>"]
hard = st.lists(st.sampled_from(_PARTS), max_size=120).map("".join)


@given(hard, st.integers(2, 9))
@settings(max_examples=300, deadline=None)
def test_tree_equals_whole(text, leaf):
    enc = tokens.encoder()
    assert tokens.encode_text(enc, text, leaf).tolist() == enc.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "antidisestablishment" * 300, "9" * 3000, "漢字" * 1500, "=" * 4000 + "x" * 3000, "\n" * 4000, " " * 3000 + "x", "it's" * 900, ("q" * 70 + " ") * 60])
def test_tree_on_unsplit_text(text):
    enc = tokens.encoder()
    for leaf in (7, 64, 1000):
        assert tokens.encode_text(enc, text, leaf).tolist() == enc.encode_ordinary(text)


def test_random_unsplit():
    enc, rng = tokens.encoder(), random.Random(4)
    for _ in range(60):
        t = "".join(rng.choice(["re", "ing", "tion", "a", "th", "e", "xx", "q"]) for _ in range(rng.randint(1, 800)))
        assert tokens.encode_text(enc, t, rng.choice([5, 33, 200])).tolist() == enc.encode_ordinary(t)


def test_encode_rows(spark):
    """Null, empty, marker-like and long texts, repeated ids, clashing columns; long ones spread over rows."""
    texts = [None, "", " ", "<|endoftext|> hi", "x" * 500, "word " * 200, "a\r\nb\x00c", "é" * 300, "z" * 101 + " " + "y" * 350]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)] + [(4, "x" * 500, 1, "k")], "doc_id long, text string, ids int, _no string")
    enc = tokens.encoder()
    want = sorted((i, enc.encode_ordinary(t or "")) for i, t in [*enumerate(texts), (4, "x" * 500)])
    for leaf, spread in ((16, 100), (tokens.LEAF, tokens.SPREAD)):
        got = tokens.encode(df, leaf=leaf, spread=spread)
        assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
        assert sorted((r.doc_id, r.ids) for r in got.collect()) == want
    assert sorted((r.doc_id, r.n_tokens) for r in tokens.encode(df, count_only=True, leaf=16, spread=100).collect()) == [(i, len(t)) for i, t in want]
    assert tokens.encode(df.limit(0)).count() == 0


# --- packing ---


def check_bins(sizes, bins, cap, items, cost):
    load = {}
    for s, b in zip(sizes, bins):
        load.setdefault(int(b), []).append(int(s))
    for v in load.values():
        assert sum(v) <= cap and len(v) <= items and sum(x * x for x in v) <= cost
    return load


@given(st.lists(st.integers(0, 100), max_size=150), st.integers(1, 12), st.sampled_from(["norm", "dot"]))
@settings(max_examples=80, deadline=None)
def test_best_fit_holds_constraints(sizes, items, rule):
    bins = packing.vector_best_fit(np.array(sizes, dtype=int), 100, items, 10_000, rule=rule)
    load = check_bins(sizes, bins, 100, items, 10_000)
    assert set(load) == set(range(len(load)))


def test_best_fit_attention_cost():
    bins = packing.vector_best_fit(np.array([60, 60, 30, 30, 10, 10]), 100, 9, 10_000)
    check_bins([60, 60, 30, 30, 10, 10], bins, 100, 9, 10_000)
    assert len(set(bins)) == 2
    tight = packing.vector_best_fit(np.array([5] * 12), 100, 9, 75)
    check_bins([5] * 12, tight, 100, 9, 75)
    assert len(set(tight)) == 4
    with pytest.raises(ValueError):
        packing.vector_best_fit(np.array([101]), 100, 9, 20_000)


@pytest.mark.parametrize("sizes,items,cost,want", [([60, 60], 9, 10_000, 2), ([1] * 7, 3, 10_000, 3), ([50, 50], 9, 4_000, 2), ([80, 10, 10], 9, 5_000, 2), ([50, 50], 9, 5_000, 1)])
@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_each_capacity_alone_refuses(sizes, items, cost, want, rule):
    """Tokens, items, and attention cost; an item beyond the cost is alone, not split."""
    bins = packing.vector_best_fit(np.array(sizes), 100, items, cost, rule=rule)
    assert len(set(bins.tolist())) == want


def test_cost_binds_in_production(spark):
    """Two items that fit by tokens but not by cost part ways; a full one has a container of its own."""
    df = spark.createDataFrame([(1, 1800), (2, 248), (3, 1850), (4, 190), (5, 2048), (6, 2000)], "doc_id long, n long")
    loads = {}
    for r in packing.pack(df, "doc_id", "n").collect():
        loads.setdefault(r.container_id, []).append(r.n_tokens)
    assert sorted(map(sorted, loads.values())) == [[190, 248], [1800], [1850], [2000], [2048]] or sorted(map(sorted, loads.values())) == [[190], [248, 1800], [1850], [2000], [2048]]
    assert all(len(v) == 1 or sum(x * x for x in v) <= packing.COST_SHARE * 2048**2 for v in loads.values())


def test_pack_table(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([3, 40, 500, 900, 1100, 2048, 5000])) for i in range(3000)] + [(9000, None), (9001, 0), (9002, -4), (9003, 2049)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, n long, n_tokens int")
    got = packing.pack(df, "doc_id", "n", shard_items=500).collect()
    whole = {}
    for r in got:
        whole.setdefault(r.doc_id, []).append(r)
    want = {i: max(0, n or 0) for i, n in rows}
    assert {i: sum(r.n_tokens for r in v) for i, v in whole.items()} == want
    for i, v in whole.items():
        assert len(v) == max(1, -(-want[i] // 2048)) and sorted(r.piece_no for r in v) == list(range(len(v)))
    loads = {}
    for r in got:
        loads.setdefault(r.container_id, []).append(r.n_tokens)
    assert max(map(sum, loads.values())) <= 2048
    assert len(loads) <= 1.03 * sum(want.values()) / 2048 + 10
    assert packing.pack(df.limit(0), "doc_id", "n").count() == 0
    c = packing.containers(spark.createDataFrame(got)).agg(F.sum("n_items"), F.sum("n_tokens"), F.min("unused")).first()
    assert c[0] == len(got) and c[1] == sum(want.values()) and c[2] >= 0


# --- shared spans ---


def brute(texts, length):
    seen, hits = {}, {}
    for i, t in texts.items():
        for p in range(len(t or "") - length + 1):
            seen.setdefault(t[p : p + length], []).append((i, p))
    found = set()
    for v in seen.values():
        ids = sorted({i for i, _ in v})
        if len(ids) > 1:
            found |= {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]}
            for i, p in v:
                hits.setdefault(i, set()).update(range(p, p + length))
    return found, {i: len(v) for i, v in hits.items()}


def compare(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, span string, fp int")
    s = spans.shared_spans(df, **kw)
    want, share = brute(texts, kw.get("length", spans.LENGTH))
    got = [(r.doc_id_a, r.doc_id_b) for r in spans.pairs(s).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    rows = spans.shares(df, spans.coverage(s)).collect()
    assert {r.doc_id: r.shared_chars for r in rows} == {i: share.get(i, 0) for i in texts}
    assert {r.doc_id: r.n_chars for r in rows} == {i: len(t or "") for i, t in texts.items()}


def mess(rng, n, alphabet="abcdefgh 漢😀\n"):
    return "".join(rng.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_spans_random(spark, seed):
    """Spans of just below, at and above the length; copies, chains, formulas, repeats within a record."""
    rng = random.Random(seed)
    base = [mess(rng, rng.randint(10, 90)) for _ in range(6)]
    texts = {i: mess(rng, rng.randint(0, 40)) + "".join(b[rng.randint(0, 5) : len(b) - rng.randint(0, 5)] + mess(rng, rng.randint(0, 3)) for b in rng.sample(base, 3)) + mess(rng, rng.randint(0, 40)) for i in range(40)}
    for k, d in enumerate((19, 20, 21)):
        run = mess(rng, d)
        texts[100 + 2 * k], texts[101 + 2 * k] = mess(rng, 30) + run, run + mess(rng, 30)
    twice = mess(rng, 30)
    texts |= {200: twice + mess(rng, 9) + twice, 201: None, 202: "", 203: "a" * 300, 204: "b" + "a" * 45, 205: "ab" * 60, 206: "ab" * 11, 207: texts[0], 208: texts[0]}
    compare(spark, texts, length=20, anchor=12, max_texts=[256, 3, 1][seed])


def test_spans_long_and_hot(spark):
    """A formula shorter than the length in very many records is no case; one of the length is, on both ways."""
    rng = random.Random(9)
    under, over = mess(rng, 199), mess(rng, 205)
    texts = {i: mess(rng, 50) + (under if i % 3 else over) + mess(rng, 50) for i in range(60)}
    compare(spark, texts)
    compare(spark, texts, max_texts=5)


def test_spans_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    s = spans.shared_spans(df)
    assert spans.pairs(s).count() == 0 and spans.shares(df, spans.coverage(s)).count() == 0
    assert spans.link_groups(s).count() == 0 and spans.removed(df, s).count() == 0 and spans.text_classes(df).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_spans_divided(spark, monkeypatch, seed):
    """Shards halved to the end, divided among tasks, short groups, and texts reached by shuffle: the same links."""
    rng = random.Random(20 + seed)
    formula, long_one = mess(rng, 35), mess(rng, 150)
    texts = {i: mess(rng, rng.randint(0, 25)) + formula[rng.randint(0, 3) :] + mess(rng, rng.randint(0, 25)) for i in range(60)}
    texts |= {100 + i: mess(rng, 9) + long_one[i % 3 * 7 : 150 - i % 2 * 5] + mess(rng, i) for i in range(12)} | {200 + i: long_one for i in range(9)} | {300: long_one + long_one, 301: "ab" * 40, 302: "ab" * 14 + "c"}
    monkeypatch.setattr(spans, "is_small", lambda *a: False)
    compare(spark, texts, length=20, anchor=[12, 20][seed], max_texts=[2, 4][seed], max_rows=3, extent=16)


def test_one_lookup_is_broadcast_at_a_time(spark, monkeypatch):
    """However often shards are halved, no job sends more than one lookup through the driver."""
    rng = random.Random(31)
    formula = mess(rng, 35)
    texts = {i: mess(rng, rng.randint(3, 25)) + formula + mess(rng, rng.randint(3, 25)) for i in range(40)}
    write, sent = spans.materialise, []

    def count(df, name):
        sent.append((name, df._jdf.queryExecution().analyzed().toString().count("strategy=broadcast")))
        return write(df, name)

    monkeypatch.setattr(spans, "materialise", count)
    compare(spark, texts, length=20, anchor=12, max_texts=2)
    assert sum(name == "pieces" for name, _ in sent) > 3
    assert max(n for _, n in sent) == 1


def test_groups_tell_every_link(spark):
    """Two records are linked just if they are in a group together; groups are as many rows as members."""
    rng = random.Random(6)
    a, b, c = (mess(rng, 60) for _ in range(3))
    texts = {1: a + b, 2: b + c, 3: c, 4: a, 5: a + b, 6: mess(rng, 80), 7: c[:30], 8: b[5:40]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    g = {}
    for r in spans.link_groups(spans.shared_spans(df, length=20, anchor=12)).collect():
        g.setdefault(r.group_id, set()).add(r.doc)
    assert len(g) == len({frozenset(v) for v in g.values()})
    assert {(x, y) for v in g.values() for x in v for y in v if x < y} == brute(texts, 20)[0]
    classes = {r.doc: (r.class_id, r.n_copies) for r in spans.text_classes(df.union(spark.createDataFrame([(9, None), (10, None), (11, "")], "doc_id long, text string"))).collect()}
    assert classes[5] == (1, 2) and classes[1] == (1, 2) and classes[2] == (2, 1) and classes[9] == (9, 1) and classes[10] == (10, 1) and classes[11] == (11, 1)


def test_removed(spark):
    """What stands in a record of lesser ident is taken out, and nothing else."""
    rng = random.Random(12)
    base = [mess(rng, 60) for _ in range(4)]
    texts = {i: mess(rng, rng.randint(0, 30)) + "".join(rng.sample(base, 2)) + mess(rng, rng.randint(0, 30)) for i in range(15)} | {20: None, 21: "", 22: base[0], 23: base[0][:19]}
    df = spark.createDataFrame([(i, t, 5) for i, t in texts.items()], "doc_id long, text string, n_removed int")
    got = {r.doc_id: (r.text, r.n_removed) for r in spans.removed(df, spans.shared_spans(df, length=20, anchor=12)).collect()}
    for i, t in texts.items():
        off = {q for p in range(len(t or "") - 19) if any(t[p : p + 20] in (u or "") for j, u in texts.items() if j < i) for q in range(p, p + 20)}
        assert got[i] == (None if t is None else "".join(x for p, x in enumerate(t) if p not in off), len(off))


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test data")
def test_spans_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    compare(spark, texts)


def brute_maximal(texts, length):
    """The two places of each match of two texts that goes no further."""
    found = set()
    ids = [i for i in sorted(texts) if texts[i]]
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            s, t = texts[a], texts[b]
            for off in range(-len(s) + length, len(t) - length + 1):
                p, n = max(0, -off), min(len(s), len(t) - off)
                while p < n:
                    q = p
                    while q < n and s[q] == t[q + off]:
                        q += 1
                    if q - p >= length:
                        found |= {(f"{a}:{p}:{b}:{p + off}", a, p, q), (f"{a}:{p}:{b}:{p + off}", b, p + off, q + off)}
                    p = q + 1
    return found


def maximal(spark, texts, **kw):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = [tuple(r) for r in spans.maximal(spans.shared_spans(df, aligned=True, **kw)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_two_neighbours_are_two_spans(spark):
    """250 characters of one record and 250 of another beside each other are no span of 500."""
    rng = random.Random(4)
    y, z = "y" + mess(rng, 250), mess(rng, 250) + "z"
    got = maximal(spark, {1: "-" + y[1:] + z[:-1] + "-", 2: y + "2", 3: "3" + z})
    assert {r[1:] for r in got} == {(1, 1, 251), (2, 1, 251), (1, 251, 501), (3, 1, 251)} and len({r[0] for r in got}) == 2


@pytest.mark.parametrize("most", [256, 3])
def test_maximal_spans(spark, most):
    rng = random.Random(most)
    base = [mess(rng, rng.randint(20, 90)) for _ in range(5)]
    texts = {i: mess(rng, rng.randint(0, 30)) + "".join(b[rng.randint(0, 5) : len(b) - rng.randint(0, 5)] for b in rng.sample(base, 3)) for i in range(14)}
    texts |= {50: "a" * 60, 51: "b" + "a" * 30, 52: "ab" * 40, 53: "ab" * 14, 54: texts[0], 55: texts[0] + texts[1], 56: None, 57: ""}
    want = brute_maximal(texts, 20)
    assert len(want) > 50 and maximal(spark, texts, length=20, anchor=12, max_texts=most) == want


def test_lists_of_places_are_not_broadcast(spark, monkeypatch):
    """Many places stay in the executors, however small their files; only the filter on records is broadcast."""
    monkeypatch.setattr(spans, "is_small", lambda *a: False)
    docs = spark.createDataFrame([(i, "abc" * 20) for i in range(3)], "doc long, text string")
    places = spans.materialise(spark.createDataFrame([(7, i, 2, 0) for i in range(3)], "fp long, doc long, at int, span int"), "places")
    rows = spans._slices(places, docs, 20, 8)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastExchange") == 1
    assert sorted((r.doc, r.start, r.left, len(r.text)) for r in rows.collect()) == [(i, 0, 2, 22) for i in range(3)]
