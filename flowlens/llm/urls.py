"""URL filters: rules, host word segmentation and a naive Bayes verdict.

Rules are (host, path, verdict). A rule fits its host and all subdomains when
the URL's path starts with the rule's; the longest fitting rule decides.

URLs without a rule are judged by their words. Concatenated names in hosts and
paths are split by a unigram model: the likeliest segmentation under word
counts of all pages' texts, found by Viterbi. The counts stay distributed: the
distinct names' substrings (at most ``LONGEST`` letters) meet them in a join,
so no dictionary is broadcast. A multinomial naive Bayes model then scores the
segmented tokens. Its training rows are all URLs, labelled block when a host
word is one of ``BLOCK_WORDS`` (a parameter), so it learns what else such URLs
carry. Tokens are counted by hash in a table of fixed size.

Defined cases: a null URL, or one without ``://``, has empty host and path, no
rule, and the verdict of the class shares alone. Repeated pages are judged one
by one. Names without any known word stay whole. An empty table gives an empty
result; other columns pass through untouched (only the id, URL and page text
are read).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.runtime import Scratch

# The rules of the contract.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

# Host words that label a training row as block.
BLOCK_WORDS = ("ads", "adult", "bet", "bets", "betting", "casino", "gambling", "hookup", "jackpot", "lottery", "pharma",
               "pill", "pills", "poker", "porn", "sex", "sexy", "slots", "spam", "tracker", "viagra", "warez", "xxx")

LONGEST = 24  # letters of a word
SEED_COUNT = 50.0  # occurrences that a block word is given in the unigram model
SLOTS = 1 << 18  # hashed tokens of the naive Bayes model
ALPHA = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NAME = r"[\p{L}]+"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest fitting rule; nulls if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0], r[1])):  # the longest comes last and wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def word_counts(pages: DataFrame, html_col: str) -> DataFrame:
    """(word, n): words of all pages' texts, and the block words' seed counts."""
    plain = F.regexp_replace(F.coalesce(F.col(html_col).cast("string"), F.lit("")),
                             r"(?is)<(script|style)\b.*?</\1>|<[^>]*>|&[#\w]+;", " ")
    words = pages.select(F.explode(F.regexp_extract_all(F.lower(plain), F.lit(NAME), F.lit(0))).alias("word"))
    counts = words.filter(F.length("word") <= LONGEST).groupBy("word").agg(F.count(F.lit(1)).cast("double").alias("n"))
    seeds = pages.sparkSession.createDataFrame([(w, SEED_COUNT) for w in BLOCK_WORDS], "word string, n double")
    return counts.unionByName(seeds).groupBy("word").agg(F.sum("n").alias("n"))


def segment(name: str, words: list[tuple[int, int, float]], total: float) -> list[str]:
    """The likeliest split of a name. ``words``: (start, length, count) of its
    substrings that are words; other substrings get a probability that falls
    tenfold with every letter."""
    n = len(name)
    known: dict[int, list[tuple[int, float]]] = {}
    for start, size, count in words:
        known.setdefault(start, []).append((size, math.log(count / total)))
    unknown = math.log(0.1 / total)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for a in range(n):
        for size, p in known.get(a, ()):
            if best[a] + p > best[a + size]:
                best[a + size], back[a + size] = best[a] + p, a
        for size in range(1, min(LONGEST, n - a) + 1):
            p = best[a] + unknown - size * math.log(10)
            if p > best[a + size]:
                best[a + size], back[a + size] = p, a
    out, b = [], n
    while b:
        out.append(name[back[b]: b])
        b = back[b]
    return out[::-1]


def segmented_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) for a frame of distinct names."""
    total = counts.agg(F.sum("n")).first()[0] or 1.0
    size = F.length("name")
    starts = names.select("name", F.explode(F.sequence(F.lit(1), size)).alias("start"))
    subs = starts.select("name", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), size - F.col("start") + 1)))
                         .alias("size"))
    subs = subs.withColumn("word", F.expr("substring(name, start, size)"))
    hits = (subs.join(counts, "word").groupBy("name")
            .agg(F.collect_list(F.struct(F.col("start") - 1, F.col("size"), F.col("n"))).alias("hits")))

    @F.pandas_udf("array<string>")
    def split(name: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([segment(x, [tuple(h.values()) for h in (hs if hs is not None else ())], total)
                          for x, hs in zip(name, hits)], dtype=object)

    both = names.join(hits, "name", "left")
    return both.select("name", split(F.col("name"), F.col("hits")).alias("words"))


def _names(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(NAME), F.lit(0))


def _slot(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(SLOTS)).cast("int")


def _tokens(parts: DataFrame, key: str, segments: DataFrame) -> DataFrame:
    """(key, tokens): segmented words of every name in ``key``; all keys stay."""
    each = parts.select(key, F.explode(_names(F.col(key))).alias("name"))
    found = (each.join(segments, "name").groupBy(key).agg(F.flatten(F.collect_list("words")).alias("tokens")))
    return parts.join(found, key, "left").select(key, F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES,
          block_words=BLOCK_WORDS) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, ``score`` (log-odds of
    block by the model) and ``host_words`` (the segmented host)."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    shapes = scratch.keep(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")), "shapes")
    hosts, paths = shapes.select("host").distinct(), shapes.select("path").distinct()
    names = (hosts.select(F.explode(_names(F.col("host"))).alias("name"))
             .unionByName(paths.select(F.explode(_names(F.col("path"))).alias("name"))).distinct())
    counts = scratch.keep(word_counts(pages, html_col), "counts")
    segments = scratch.keep(segmented_names(names, counts), "segments")
    host_tokens = scratch.keep(_tokens(hosts, "host", segments), "hosts")
    path_tokens = scratch.keep(_tokens(paths, "path", segments), "paths")

    # Training: every URL, labelled by its host's words.
    bad = F.arrays_overlap("tokens", F.array(*[F.lit(w) for w in block_words])).cast("int")
    labelled = shapes.join(host_tokens.select("host", F.coalesce(bad, F.lit(0)).alias("label"),
                                              F.col("tokens").alias("h_tokens")), "host").join(path_tokens, "path")
    share = {int(r.label): float(r.n) for r in labelled.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    slots = (labelled.select("label", "n", F.explode(F.concat("h_tokens", "tokens")).alias("token"))
             .groupBy("label", _slot(F.col("token")).alias("slot")).agg(F.sum("n").alias("n")).toPandas())  # <= 2 * SLOTS rows
    count = np.zeros((2, SLOTS))
    count[slots["label"].to_numpy(dtype=int), slots["slot"].to_numpy(dtype=int)] = slots["n"].to_numpy(dtype=float)
    seen = count.sum(axis=0) > 0
    likely = np.log((count + ALPHA) / (count.sum(axis=1, keepdims=True) + ALPHA * max(seen.sum(), 1)))
    odds = spark.sparkContext.broadcast(np.where(seen, likely[1] - likely[0], 0.0).astype(np.float64))
    prior = math.log((share.get(1, 0.0) + 1.0) / (share.get(0, 0.0) + 1.0))

    @F.pandas_udf("double")
    def log_odds(slots: pd.Series) -> pd.Series:
        table = odds.value
        return pd.Series([float(table[np.asarray(s, dtype=np.int64)].sum()) for s in slots], dtype="float64")

    def scored(tokens: DataFrame, key: str) -> DataFrame:
        return tokens.select(F.col(key).alias(f"s_{key}"), F.col("tokens").alias(f"{key}_words"),
                             log_odds(F.transform("tokens", _slot)).alias(f"{key}_odds"))

    out = (rows.join(scratch.keep(scored(host_tokens, "host"), "host_odds"), F.col("host") == F.col("s_host"))
           .join(scratch.keep(scored(path_tokens, "path"), "path_odds"), F.col("path") == F.col("s_path")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    score = F.col("host_odds") + F.col("path_odds") + F.lit(prior)
    return out.select("page_id", "host", "path", rule.alias("rule"),
                      F.coalesce(verdict, F.when(score > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                      score.alias("score"), F.array_join("host_words", " ").alias("host_words"))
