"""Tokens, mixing, fingerprints and URL verdicts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF_CHECK, SF_SMALL
from flowlens.llm import bpe, merkle, mixing, runtime, urls
from flowlens.sources.tables import table
from llm.edge import LONG, ROWS, frame

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "   ", "Hello World's it'll 12345 ½ Ⅻ", "a<|endoftext|>b <|startoftext|>", "ΑΣ ΣΑΣ İstanbul ß ﬁ", "é ́x é​\x1c\x1dfoo\x85bar　",
       "😀😀 👍🏽 日本語テキスト", "x" * 3000, "aaaaa" * 500, "\x00\x01 _ __ -- '''s 'S don'T", "<|EndOfText|>", "Ω K Å", "the" * 4000, LONG]


# ------------------------------------------------------------------ BPE
def test_codec_equals_the_library_on_odd_texts():
    ref, codec = Tokenizer.from_file(PATH), bpe.codec(open(PATH, encoding="utf-8").read())
    rng = random.Random(1)
    noise = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x4E00, 0x4F00)]))
                     for _ in range(rng.randrange(60))) for _ in range(300)]
    for text in ODD + noise:
        ids = ref.encode(text, add_special_tokens=False).ids
        got = codec.encode(text)
        assert np.frombuffer(got, dtype="<u4").tolist() == ids, text[:50]
        assert codec.decode(got).decode() == ref.decode(ids, skip_special_tokens=False)


def test_bpe_query_matches_the_library(spark):
    import __spark_entry__ as E

    ref = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in E.queries()["op4_bpe_round_trip"](spark, SF_SMALL).collect()}
    rows = runtime.documents(spark, SF_SMALL, "doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = ref.encode(r.text or "", add_special_tokens=False).ids
        g = got[r.doc_id]
        assert g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_edge_rows(spark):
    out = bpe.encode_documents(frame(spark), bpe.Tokenizer(spark, PATH)).collect()
    assert len(out) == len(ROWS)
    assert all(r.ids == b"" and r.decoded == "" for r in out if r.doc_id in (2, 3, 7))
    assert bpe.encode_documents(frame(spark).limit(0), bpe.Tokenizer(spark, PATH)).count() == 0


# ------------------------------------------------------------------ mixing
def _targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        level = left / sum(w[s] for s in free) if free else 0
        over = {s for s in free if w[s] * level > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else w[s] * level for s in names}
        capped |= over


def test_mix_on_edge_rows(spark):
    got = mixing.plan_mix(frame(spark)).select("row.doc_id", "row.source", "mix.*").collect()
    assert len(got) == len(ROWS)
    sizes = {}
    for _, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    want = _targets(sizes)
    taken = {}
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) < 1 for s in want)


def test_mixed_documents_hold_the_words_taken(spark):
    d = frame(spark)
    plan = mixing.plan_mix(d).agg(F.sum("mix.taken")).first()[0]
    out = mixing.mix_documents(d)
    assert out.columns == d.columns
    assert out.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == plan
    assert mixing.mix_documents(d.limit(0)).count() == 0
    cut = [r for r in out.collect() if r.text is not None and r.n_chars != len(r.text)]
    assert cut == []


def test_positions_follow_the_schedule(spark):
    docs = runtime.documents(runtime.prepare(spark), SF_CHECK)
    c = mixing.copies(mixing.plan_mix(docs)).select("mix.tier", "position", "words").collect()
    early = {t: sum(r.words for r in c if r.tier == t and r.position < 0.5) / sum(r.words for r in c if r.tier == t) for t in (0, 1, 2)}
    assert all(0 <= r.position <= 1 for r in c)
    # The schedules give the first half (1.3, 1.0, 0.7) / 2 of each tier's words.
    assert early[0] == pytest.approx(0.65, abs=0.03) and early[1] == pytest.approx(0.5, abs=0.03) and early[2] == pytest.approx(0.35, abs=0.03)


def test_due_time_inverts_the_integral(spark):
    rows = spark.range(0, 101).select((F.col("id") / 100).alias("y"))
    got = rows.select("y", mixing.due_time(F.col("y"), F.lit(0)).alias("u")).collect()
    for r in got:
        u = r.u  # integral of 1.6 - 1.2 u over 0..u (both pieces have that slope)
        assert 1.6 * u - 0.6 * u * u == pytest.approx(r.y, abs=1e-9)


def test_mix_query_follows_the_schedules(spark, monkeypatch):
    import __spark_entry__ as E

    run = lambda: [(r.doc_id, r.taken) for r in E.queries()["op7_mix_sources"](spark, SF_SMALL).collect()]
    got = run()
    docs = runtime.documents(spark, SF_SMALL, "doc_id", "text", "source")
    first, words = {}, {}
    for r in mixing.copies(mixing.plan_mix(docs)).select("row.doc_id", "words", "position").collect():
        first[r.doc_id] = min(first.get(r.doc_id, 2.0), r.position)
        words[r.doc_id] = words.get(r.doc_id, 0) + r.words
    assert dict(got) == {r.doc_id: words.get(r.doc_id, 0) for r in docs.collect()}
    places = [first.get(i, 2.0) for i, _ in got]
    assert places == sorted(places) and places[0] < places[len(words) - 1]
    monkeypatch.setattr(mixing, "SCHEDULES", mixing.SCHEDULES[::-1])
    other = run()
    assert other != got and sorted(other) == sorted(got)


# ------------------------------------------------------------------ Merkle
def test_merkle_query_rows(spark):
    import __spark_entry__ as E

    got = {r.doc_id: r for r in E.queries()["op9_merkle_fingerprints"](spark, SF_SMALL).collect()}
    docs = sorted([(r.doc_id, r.text or "") for r in runtime.documents(spark, SF_SMALL, "doc_id", "text").collect()], reverse=True)
    assert len(got) == len(docs)
    by_text = {}
    for k, (i, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.edited_fingerprint == str(merkle.Tree(changed))
        assert r.near_edited == pytest.approx(merkle.likeness(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(merkle.likeness(r.fingerprint, str(merkle.Tree(following))))
        assert r.differs_from == -1 if changed == text else r.differs_from <= len(text) - half
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) == len(by_text)
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.9


def test_merkle_parents_from_their_children(spark):
    """Every digest of the query's fingerprints, recomputed from the leaves up by plain hashing."""
    import __spark_entry__ as E

    def digest(data, level):
        return hashlib.blake2b(data, digest_size=16, person=level).digest()

    def expected(text):
        sections, held = [], []
        cut = merkle.leaves(text)
        assert "".join(cut) == text
        for k, leaf in enumerate(cut):
            held.append(digest(leaf.encode(), b"leaf"))
            if held[-1][15] % 16 == 0 or k == len(cut) - 1:
                sections.append(held)
                held = []
        parents = [digest(b"".join(h), b"section") for h in sections]
        root = digest(b"".join(parents), b"root").hex()
        return root + "".join(";" + p.hex()[:16] + ":" + "".join(x.hex()[:8] for x in h) for p, h in zip(parents, sections))

    def alike(a, b):  # Dice share of common leaves
        (ra, *sa), (rb, *sb) = a.split(";"), b.split(";")
        la, lb = ([h[k: k + 8] for h in (x.split(":")[1] for x in s) for k in range(0, len(h), 8)] for s in (sa, sb))
        common = sum(min(la.count(x), lb.count(x)) for x in set(la))
        return 1.0 if ra == rb else min(2 * common / max(len(la) + len(lb), 1), 1 - 1e-9)

    got = {r.doc_id: r for r in E.queries()["op9_merkle_fingerprints"](spark, SF_SMALL).collect()}
    docs = sorted([(r.doc_id, r.text or "") for r in runtime.documents(spark, SF_SMALL, "doc_id", "text").collect()], reverse=True)
    assert docs and len(got) == len(docs)
    for k, (i, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        want = [expected(t) for t in (text, text[: len(text) - half] + following[:half], following)]
        r = got[i]
        assert [r.fingerprint, r.edited_fingerprint] == want[:2]
        assert r.near_edited == pytest.approx(alike(want[0], want[1])) and r.near_next == pytest.approx(alike(want[0], want[2]))


def test_merkle_leaves_are_paragraphs():
    assert merkle.leaves("") == []
    assert merkle.leaves("One. Two, three.\n\nFour; five.\n \n\n  Six!") == ["One. Two, three.\n\n", "Four; five.\n \n\n  ", "Six!"]
    long = "A line of its own\n" * 4 + "\n" + "word " * 40
    assert merkle.leaves(long)[:4] == ["A line of its own\n"] * 3 + ["A line of its own\n\n"]
    for text in (long, "\n\n\nx", "\n" * 100, " \n\t\n ", "a" * 500, "x\r\n\r\ny"):
        assert "".join(merkle.leaves(text)) == text
    a, b = merkle.Tree("ab\n\ncd"), merkle.Tree("ab\n\nce")
    assert a.root != b.root and merkle.first_difference(a, b) == 4


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_merkle_edge_rows(spark, buckets):
    got = merkle.fingerprints(frame(spark), buckets=buckets).collect()
    order = sorted([(i, t or "") for i, t, _ in ROWS], key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (i, text) in enumerate(order):
        changed = merkle.edited(text, order[(k + 1) % len(order)][1])
        want.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest()))
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=str) == sorted(want, key=str)
    assert merkle.fingerprints(frame(spark).limit(0)).count() == 0
    one = merkle.fingerprints(frame(spark, [(1, "only one", "s")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_merkle_locates_an_edit():
    text = " ".join(f"Sentence number {k} stands here." for k in range(200))
    at = text.index("number 120")
    a, b = merkle.Tree(text), merkle.Tree(text[:at] + "NUMBER" + text[at + 6:])
    assert 0 <= at - merkle.first_difference(a, b) < 80
    assert merkle.likeness(str(a), str(b)) > 0.95 and merkle.likeness(str(a), str(a)) == 1.0
    assert "".join(merkle.leaves(text)) == text


# ------------------------------------------------------------------ URLs
URLS = ["https://A.Example.NET/en/1?x", "http://example.net/en", "http://example.net", "http://example.com/de/5#y", "http://x.org/fr/3",
        "http://notnet/en/", "no scheme", None, "", "ftp://casinowin.example.com/en/1", "http://ads-track.example.org/es/2", "http://h?p://q/z",
        "http://thousandwords.example.com/en/9", "http://" + "a" * 3000 + ".com/x"]


def _pages(spark):
    runtime.prepare(spark)
    html = "<html><script>var casino;</script><p>thousand words and words thousand win</p></html>"
    rows = [(k, u, html) for k, u in enumerate(URLS)] + [(None, URLS[0], None), (0, URLS[0], html)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("n", F.lit(1))


def test_url_hosts_rules_and_verdicts(spark):
    got = {}
    rows = urls.judge(_pages(spark)).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        got.setdefault(r.page_id, r)
    at = lambda k: (got[k].host, got[k].path, got[k].rule, got[k].verdict)
    assert at(0) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert at(1) == ("example.net", "/en", "net/", "block")
    assert at(2)[:3] == ("example.net", "", None)
    assert at(3) == ("example.com", "/de/5", "example.com/de/", "block")
    assert at(4) == ("x.org", "/fr/3", "org/fr/", "allow")
    assert at(5)[2] is None
    assert all(at(k)[:3] == ("", "", None) for k in (6, 7, 8))
    assert at(9)[3] == "block" and "casino win" in got[9].host_words
    assert at(10)[3] == "block" and at(10)[2] is None
    assert at(11)[:2] == ("h", "")
    assert "thousand words" in got[12].host_words
    assert urls.judge(_pages(spark).limit(0)).count() == 0


def test_url_query_against_plain_python(spark):
    import re

    import __spark_entry__ as E

    rows = {r.page_id: r for r in table(spark, SF_SMALL, "pages", "page_id", "url").collect()}
    got = E.queries()["op1_url_filters"](spark, SF_SMALL).collect()
    assert len(got) == len(rows)
    for r in got:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", rows[r.page_id].url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit, key=lambda f: len(f[0]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score > 0 else "allow"))
        if rule is None:
            assert (r.verdict == "block") == any(w in r.host_words.split() for w in urls.BLOCK_WORDS)


def test_segmentation_is_the_likeliest_split():
    words = {"in": 50.0, "to": 60.0, "into": 30.0, "the": 90.0, "sea": 5.0}
    name = "intothesea"
    subs = [(a, n, words[name[a: a + n]]) for a in range(len(name)) for n in range(1, 6)
            if a + n <= len(name) and name[a: a + n] in words]
    assert urls.segment(name, subs, 1000.0) == ["into", "the", "sea"]
    assert urls.segment("zzz", [], 1000.0) == ["zzz"]
    assert urls.segment("", [], 1000.0) == []
