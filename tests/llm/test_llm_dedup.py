"""Exact, SimHash and substring deduplication against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from conftest import SF_CHECK
from flowlens.llm import exact, runtime, simhash, suffix
from flowlens.llm.components import components
from llm.edge import ROWS, frame


def _docs(spark, sf=SF_CHECK):
    runtime.prepare(spark)
    return runtime.documents(spark, sf)


# ------------------------------------------------------------------ exact
def _exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids)) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"first_digit": 1, "growth": 2}, {"first_digit": 4, "growth": 4}])
def test_exact_groups_on_edge_rows(spark, options):
    got = exact.exact_groups(frame(spark), **options).collect()
    assert sorted([(r.row.doc_id, r.keep_id, r.group_size) for r in got], key=str) == _exact_brute([(i, t) for i, t, _ in ROWS])
    kept = [r for r in got if r.kept]
    assert len(kept) == len({t or "" for _, t, _ in ROWS})  # one row of each group, ties included
    assert all(r.row.doc_id == r.keep_id for r in kept)
    assert all(r.row.fp == "f" and r.row.kept == "k" for r in got)


def test_exact_dedup_keeps_columns_and_handles_no_rows(spark):
    d = frame(spark)
    out = exact.drop_exact_duplicates(d)
    assert out.columns == d.columns and out.schema == d.schema
    assert exact.drop_exact_duplicates(d.limit(0)).count() == 0


def test_exact_long_texts_that_differ_late(spark):
    base = "x" * 50_000
    rows = [(k, base + (str(k % 3) if k % 2 else ""), "s") for k in range(12)]
    got = exact.exact_groups(frame(spark, rows)).collect()
    assert sorted([(r.row.doc_id, r.keep_id, r.group_size) for r in got], key=str) == _exact_brute([(i, t) for i, t, _ in rows])


# ------------------------------------------------------------------ SimHash
def _fingerprint_brute(text, k=3):
    import re

    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i: i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components_brute(rows, tau=3):
    fps = [_fingerprint_brute(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    arr = np.array(fps, dtype=np.uint64)
    for a in range(len(rows)):
        for b in np.flatnonzero(np.bitwise_count(arr[a + 1:] ^ arr[a]) <= tau):
            x, y = find(a), find(a + 1 + int(b))
            root[max(x, y)] = min(x, y)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return [(i, fps[k], low.get(find(k))) for k, (i, _) in enumerate(rows)]


def test_simhash_on_edge_rows(spark):
    rows = [(i, t) for i, t, _ in ROWS]
    got = simhash.near_groups(frame(spark)).collect()
    assert sorted([(r.row.doc_id, r.fp % (1 << 64), r.component_id) for r in got], key=str) == sorted(_components_brute(rows), key=str)
    assert sum(r.kept for r in got) == len({c for _, _, c in _components_brute(rows)})
    d = frame(spark)
    assert simhash.drop_near_duplicates(d).columns == d.columns
    assert simhash.drop_near_duplicates(d.limit(0)).count() == 0


def test_simhash_query_matches_brute_force(spark):
    import __spark_entry__ as E

    docs = [(r.doc_id, r.text) for r in _docs(spark).select("doc_id", "text").collect()]
    expect = {(i, format(f, "016x"), c) for i, f, c in _components_brute(docs)}
    got = {tuple(r) for r in E.queries()["op6_simhash_near_dedup"](spark, SF_CHECK).collect()}
    assert got == expect


@pytest.mark.parametrize("hot,options", [(256, (2, 3, 4)), (4, (2, 3, 4)), (4, (2,)), (4, (3,))])
def test_simhash_links_are_complete(spark, hot, options):
    rng, fps = random.Random(5), set()
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(80):
            x = base
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps.update(rng.getrandbits(64) for _ in range(100))
    arr = np.array(sorted(fps), dtype=np.uint64)
    expect = set()
    for a in range(len(arr)):
        for b in np.flatnonzero(np.bitwise_count(arr[a + 1:] ^ arr[a]) <= 3):
            pair = sorted((int(arr[a].astype(np.int64)), int(arr[a + 1 + b].astype(np.int64))))
            expect.add(tuple(pair))
    runtime.prepare(spark)
    df = spark.createDataFrame([(int(x),) for x in arr.view(np.int64)], "fp long")
    got = {(r.a, r.b) for r in simhash.links(df, 3, runtime.Scratch(spark, "t"), hot, options).collect()}
    assert got == expect


def test_thresholds_are_the_cheapest_that_lose_nothing():
    cost, picked = simhash.allocate([{-1: 0, 0: 5, 1: 50}, {-1: 0, 0: 90, 1: 95}, {-1: 0, 0: 5, 1: 7}], 1)
    assert sum(picked) == 1 and cost == 57 and picked == [1, -1, 1] or (sum(picked) == 1 and cost <= 57)


def test_components_of_a_long_chain(spark):
    runtime.prepare(spark)
    n = 200
    order = list(range(n))
    random.Random(3).shuffle(order)
    df = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    got = {r.node: r.root for r in components(df, runtime.Scratch(spark, "cc")).collect()}
    assert got == {k: 0 for k in range(n)}


# ------------------------------------------------------------------ substring
def _substring_brute(rows, window=13):
    low, words = {}, []
    top = 1 << 62
    for i, t in rows:
        w = (t or "").encode().split()
        words.append(w)
        for p in range(len(w) - window + 1):
            key = tuple(w[p: p + window])
            low[key] = min(low.get(key, top), top if i is None else i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if low[tuple(w[p: p + window])] < (top if i is None else i):
                gone[p: p + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _substring(df, **options):
    got = suffix.kept_text(df, **options).collect()
    return sorted([(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got], key=str)


@pytest.mark.parametrize("group", [50_000, 2])
def test_substring_on_edge_rows(spark, group):
    assert _substring(frame(spark), group=group) == _substring_brute([(i, t) for i, t, _ in ROWS])


def test_substring_of_no_rows(spark):
    assert _substring(frame(spark).limit(0)) == []


@pytest.mark.parametrize("group", [50_000, 3])
def test_substring_matches_brute_force(spark, group):
    docs = _docs(spark).select("doc_id", "text")
    assert _substring(docs, group=group) == _substring_brute([tuple(r) for r in docs.collect()])


def test_passage_shared_by_many_documents(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = []
    for k in range(60):
        own = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
        rows.append((k, f"{own(5)} {passage} {own(7)}", "s"))
    got = _substring(frame(spark, rows), group=10)
    assert got == _substring_brute([(i, t) for i, t, _ in rows])
    assert sorted(n for _, _, n, _ in got) == [0] + [40] * 59


def test_words_whose_hashes_agree_in_part_stay_apart(spark):
    """Templates with a running number: pairs of numbers whose hashes agree in 24 bits."""
    seen, pairs = {}, []
    for k in range(60_000):
        low = xxhash.xxh64_intdigest(f"n{k}".encode()) & 0xFFFFFF
        if low in seen:
            pairs.append((seen[low], k))
        seen[low] = k
    rows = []
    for j, pair in enumerate(pairs[:10]):
        words = [f"t{j}x{i}" for i in range(30)]
        for n in pair:
            rows.append((len(rows), " ".join([*words[:15], f"n{n}", *words[15:]]), "s"))
    got = _substring(frame(spark, rows))
    assert got == _substring_brute([(i, t) for i, t, _ in rows])
    assert sorted(n for _, _, n, _ in got) == [0] * 10 + [30] * 10


# ------------------------------------------------------------------ lines
def _lines_brute(rows, window=3):
    top, first = 1 << 62, {}
    docs = sorted({(top if i is None else i, t) for i, t in rows if t is not None}, key=str)
    places = []
    for i, t in docs:
        ls = t.split("\n")
        for p in range(len(ls) - window + 1):
            places.append((i, p, tuple(ls[p: p + window])))
    for i, p, w in sorted(places, key=lambda x: x[:2]):
        first.setdefault(w, (i, p))
    out = []
    for i, t in rows:
        ls = [] if t is None else t.split("\n")
        gone = [False] * len(ls)
        for p in range(len(ls) - window + 1):
            if first[tuple(ls[p: p + window])] < (top if i is None else i, p):
                gone[p: p + window] = [True] * window
        kept = "\n".join(x for x, g in zip(ls, gone) if not g)
        out.append((i, len(ls), sum(gone), kept))
    return sorted(out, key=str)


def test_lines_on_edge_rows(spark):
    from flowlens.llm import lines

    rows = [(i, t, s) for i, t, s in ROWS] + [
        (20, "a\nb\nc\nd", "s"), (21, "x\na\nb\nc\nd\ny", "s"), (22, "q\nq\nq\nq\nq", "s"), (None, "z\na\nb\nc", "s"), (23, "a\nb", "s"),
        (24, "b\nc\nd\n" * 2000, "s")]
    got = lines.kept_lines(frame(spark, rows)).collect()
    assert sorted([(r.doc_id, r.n_lines, r.n_removed, r.kept) for r in got], key=str) == _lines_brute([(i, t) for i, t, _ in rows])
    assert lines.kept_lines(frame(spark).limit(0)).count() == 0
