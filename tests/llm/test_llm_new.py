"""Importance resampling, fill-in-the-middle and suffix-array dedup against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from conftest import SF_CHECK, SF_SMALL
from flowlens.llm import infilling, resampling, runtime, suffixarray
from flowlens.llm.queries import ORACLE, QUERIES
from flowlens.sources.tables import table
from llm.edge import LONG, ROWS, frame
from oracle import compare


def _docs(spark, sf=SF_SMALL):
    runtime.prepare(spark)
    return runtime.documents(spark, sf)


# ------------------------------------------------------------------ importance resampling
def _words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _runs(text, n):
    w = _words(text)
    return [" ".join(w[i: i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def _resample_brute(rows, target, n=1, buckets=10_000, min_words=20, share=10, seed=2024):
    bucket = lambda f: crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in _runs(t, n))
    t = Counter(bucket(f) for x in target for f in _runs(x, n))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets))))
    out = []
    for i, text in rows:
        f = _runs(text, n)
        w = sum(gain(bucket(x)) for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(_words(text))])
    drawn = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = drawn[: share * len(drawn) // 100]
    ranks = {id(r): k + 1 for k, r in enumerate(drawn)}
    return sorted([(*r[:4], ranks.get(id(r))) for r in out], key=str)


@pytest.mark.parametrize("n,buckets", [(1, 10_000), (3, 10_000), (5, 97)])
def test_resampling_equals_brute_force(spark, n, buckets):
    docs, target = _docs(spark), table(spark, SF_SMALL, "benchmark", "text")
    got = resampling.resample(docs, target, n=n, buckets=buckets, share=30).collect()
    want = _resample_brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], n, buckets, share=30)
    assert sorted([(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got], key=str) == want


def test_resampling_edge_rows(spark):
    target = table(spark, SF_SMALL, "benchmark", "text")
    rows = [(i, t) for i, t, _ in ROWS if i != 5]  # rows of one id and text may take each other's rank
    d = frame(spark, [r for r in ROWS if r[0] != 5])
    got = resampling.resample(d, target, n=2, min_words=2, share=60).collect()
    want = _resample_brute(rows, [r.text for r in target.collect()], 2, min_words=2, share=60)
    assert sorted([(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got], key=str) == want
    both = resampling.resample(frame(spark), target, min_words=1, share=100).collect()
    ranks = sorted(r["rank"] for r in both if r["rank"] is not None)
    assert ranks == list(range(1, len(ranks) + 1))
    assert resampling.resample(d.limit(0), target).count() == 0
    assert resampling.resample(d, target.limit(0)).count() == len(rows)


def test_crc_of_runs_from_prefixes():
    shift, rng = resampling.Shifter(), random.Random(3)
    docs = [[bytes(rng.choices(b"abz0\xc3\xa9", k=rng.choice([1, 2, 7, 300, 70_000 if k == 2 else 9]))) for _ in range(k)] for k in (0, 1, 2, 6)]
    crc, owner = resampling.run_crcs(docs, 4, shift)
    want = Counter((d, crc32(b" ".join(w[i: i + k]))) for d, w in enumerate(docs) for k in range(1, 5) for i in range(len(w) - k + 1))
    assert Counter(zip(owner.tolist(), crc.tolist())) == want


# ------------------------------------------------------------------ fill in the middle
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def _fim_brute(i, text, seed=42, rate=50, spm=80):
    text = text or ""
    draw = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(draw[k: k + 8], 16) for k in (0, 8, 16, 24))
    tok = TOKEN.findall(text)
    n = len(tok)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return i, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tok[:a]), "".join(tok[a:b]), "".join(tok[b:])
    if h4 % 100 < spm:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def _fim_check(spark, d, rows, **options):
    got = infilling.fill_in_middle(d, **options)
    got = got.withColumn("back", infilling.restored(got.output, got.form)).collect()
    want = [_fim_brute(i, t, **{{"spm_rate": "spm"}.get(k, k): v for k, v in options.items()}) for i, t in rows]
    assert sorted([tuple(r)[:6] for r in got], key=str) == sorted(want, key=str)
    assert sorted([(r.doc_id, r.back) for r in got], key=str) == sorted([(i, t or "") for i, t in rows], key=str)
    return got


def test_fill_in_middle_equals_brute_force(spark):
    d = _docs(spark)
    rows = [(r.doc_id, r.text) for r in d.collect()]
    forms = Counter(r.form for r in _fim_check(spark, d, rows))
    assert set(forms) == {"plain", "spm", "psm"}
    _fim_check(spark, d, rows, seed=7, rate=100, spm_rate=10)


def test_fill_in_middle_edge_rows(spark):
    odd = [" ", "a", "a ", " a", "\t\n a\x0b b\x0c\r", "x<P>y <S> z", "end with <", "<S", "a" * 20_000 + " b", " " * 9_000 + "é" * 9_000, "\x1c\x1d a　b",
           "日本 語 x " * 3_000]
    rows = [(i, t) for i, t, _ in ROWS] + [(100 + 10 * k + j, t) for k, t in enumerate(odd) for j in range(4)]
    _fim_check(spark, frame(spark, [(i, t, "s") for i, t in rows]), rows, rate=90, spm_rate=50)
    assert infilling.fill_in_middle(frame(spark).limit(0)).count() == 0


def test_every_cut_of_chunked_texts():
    rng, cache = random.Random(5), infilling.Summaries(most=20_000)
    base = "".join(rng.choices("ab cé\n  日 xyz", k=9_000))
    for text in (base, base[500:3_000] + "!" + base[100:7_000], "a" * 9_000, " " * 9_000, base + "  ", "  " + base):
        data = text.encode()
        c, tok = infilling.Chunked(data, cache), TOKEN.findall(text)
        assert c.n_tokens == len(tok)
        for k in range(0, len(tok) + 1, max(1, len(tok) // 400)):
            end = c.end_of(k)
            assert data[:end].decode() == "".join(tok[:k]) and c.points_to(end) == len("".join(tok[:k]))


def test_shared_passages_are_cut_alike():
    rng, cache = random.Random(6), infilling.Summaries()
    passage = bytes(rng.choices(b"abcdefgh ", k=50_000))
    infilling.Chunked(passage, cache)
    before = cache.misses
    infilling.Chunked(b"other beginning " + passage + b" other end", cache)
    assert cache.misses - before < before / 10


# ------------------------------------------------------------------ suffix array
def _repeats_brute(texts, depth):
    seen = defaultdict(int)
    data = [(t or "").encode() for t in texts]
    for d in data:
        for i in range(len(d) - depth + 1):
            seen[d[i: i + depth]] += 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, dtype=bool)
        for i in range(len(d) - depth + 1):
            if seen[d[i: i + depth]] > 1:
                gone[i: i + depth] = True
        spans = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(d) else 0
        kept = bytes(b for b, g in zip(d, gone.tolist()) if not g)
        out.append((len(d), int(gone[:len(d)].sum()), spans, kept))
    return out


def _suffix_check(spark, d, rows, depth, **options):
    got = suffixarray.kept_bytes(d, depth, **options).collect()
    want = [(i, *x) for (i, _), x in zip(rows, _repeats_brute([t for _, t in rows], depth))]
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got], key=str) == sorted(want, key=str)
    return want


OPTIONS = [{}, {"group": 1}, {"group": 3, "run": 5, "buckets": 2}]


@pytest.mark.parametrize("options", OPTIONS)
def test_suffix_dedup_equals_brute_force(spark, options):
    """All documents with the real window; hot anchors from the first, the second or the 2,001st occurrence on."""
    d = _docs(spark)
    want = _suffix_check(spark, d, [(r.doc_id, r.text) for r in d.collect()], 400, **options)
    assert any(0 < w[2] < w[1] for w in want)


@pytest.mark.parametrize("options", [{"gram": 4, **o} for o in OPTIONS])
def test_suffix_dedup_edge_rows(spark, options):
    short = LONG[:3_000]
    rows = [(i, t if t is None or len(t) < 9_000 else t[:3_000] + t[-20:]) for i, t, _ in ROWS] + [
        (20, "abc" * 300), (21, "z" * 500), (22, "日本語" * 40 + "x"), (23, short[40:900]), (24, short[:500] + "#" + short[500:900])]
    rows += [(None, f"{k} copies of a passage that many rows without an id share {k}") for k in range(40)]
    _suffix_check(spark, frame(spark, [(i, t, "s") for i, t in rows]), rows, 13, **options)
    assert suffixarray.kept_bytes(frame(spark).limit(0)).count() == 0


def test_radix_groups_on_random_bytes():
    rng = np.random.default_rng(4)
    for depth in (3, 8, 13, 16, 20):
        data = rng.integers(0, 2, 3_000, dtype=np.uint8)
        at = np.arange(len(data) - depth + 1)
        weight = np.ones(len(at), dtype=np.int64)
        weight[::97] = 2
        total = Counter()
        for i in at.tolist():
            total[data[i: i + depth].tobytes()] += int(weight[i])
        want = [total[data[i: i + depth].tobytes()] > 1 for i in at.tolist()]
        assert suffixarray.radix_groups(data, at, weight, depth).tolist() == want


def test_anchors_do_not_depend_on_blocks():
    data = np.random.default_rng(2).integers(0, 3, 5_000, dtype=np.uint8)
    whole = suffixarray.anchors(data, 100, 16)
    parts = suffixarray.anchors(data, 100, 16, block=700)
    spread = lambda x: [(k, p) for k, p, a, b in zip(*x) for _ in range(a, b + 1)]
    assert spread(whole) == spread(parts) and len(spread(whole)) == len(data) - 99


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_fill_in_middle"])
def test_new_queries_equal_sql(spark, name):
    runtime.prepare(spark)
    out = compare(spark, name, SF_CHECK, QUERIES, ORACLE)
    assert out["ok"], out
