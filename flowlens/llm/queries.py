"""Registered queries ``opN_<name>`` and their DuckDB SQL.

Each query applies its operator, with production parameters, to its whole
table and derives the contract's columns from the operator's outputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import (bpe, exact, infilling, lines, merkle, mixing, quality, resampling, runtime, simhash, suffix, suffixarray,
                          toxicity, urls)
from flowlens.sources.tables import table

def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(runtime.prepare(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return fn

    return deco


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_url_filters")
def op1_url_filters(spark, sf_dir):
    """Rule or model verdict of every page's URL."""
    return urls.judge(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query("op3_line_dedup", sql="""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, i, array_to_string(list_slice(l, i, i + 2), chr(10)) AS win
      FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d WHERE len(l) >= 3)),
r AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM p),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM r, range(3) t(k) WHERE nth > 1),
x AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS j FROM d),
k AS (SELECT x.doc_id, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY x.j) AS kept
      FROM x LEFT JOIN gone g ON x.doc_id = g.doc_id AND x.j = g.j WHERE g.j IS NULL GROUP BY x.doc_id)
SELECT o.doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, (coalesce(len(l), 0) - coalesce(n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents o LEFT JOIN d ON o.doc_id = d.doc_id LEFT JOIN k ON o.doc_id = k.doc_id""")
def op3_line_dedup(spark, sf_dir):
    """Lines left of every document when later occurrences of three-line
    windows are removed."""
    out = lines.kept_lines(runtime.documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op4_bpe_round_trip")
def op4_bpe_round_trip(spark, sf_dir):
    """Ids and decoded text of every document under the word-end BPE vocabulary."""
    tok = bpe.Tokenizer(spark, word_tokenizer_path())
    out = bpe.encode_documents(runtime.documents(spark, sf_dir, "doc_id", "text"), tok)
    return out.select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op2_exact_dedup", sql="""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op2_exact_dedup(spark, sf_dir):
    """The group of equal texts of every document, and the row that stays."""
    out = exact.exact_groups(runtime.documents(spark, sf_dir, "doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept",
                      F.sha2(runtime.text_or_empty("row.text").cast("binary"), 256).alias("text_sha256"))


@query("op5_quality")
def op5_quality(spark, sf_dir):
    """Quality score of every document, learned outside the held-out third."""
    return quality.scored_documents(runtime.documents(spark, sf_dir, "doc_id", "text"), labels(spark, sf_dir), "quality",
                                    parts=3, held=1)


@query("op6_simhash_near_dedup")
def op6_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and component (links at 3 or fewer differing bits) of every document."""
    out = simhash.near_groups(runtime.documents(spark, sf_dir, "doc_id", "text"), shingle=3, tau=3, carry=["doc_id"])
    return out.select("row.doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_mix_sources", sql=r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS ord FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, [5.0, 2.0, 1.0][1 + tier]::DOUBLE AS weight
      FROM (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 AS tier FROM s)),
l AS (SELECT *, (sum(source_size) OVER ()
                 - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM k),
v AS (SELECT max(level) AS level FROM l),
t AS (SELECT k.source, source_size, tier, least(3.0 * source_size, weight * v.level)::DOUBLE AS target FROM k, v),
c AS (SELECT d.*, source_size, target, tier, floor(target)::BIGINT AS whole,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE
           ((whole // source_size) * size + greatest(least(whole % source_size - before, size), 0))::BIGINT END AS taken,
             [1.6, 1.0, 0.4][1 + tier]::DOUBLE AS u, [1.0, 1.0, 1.0][1 + tier]::DOUBLE AS v, [0.4, 1.0, 1.6][1 + tier]::DOUBLE AS w
      FROM c),
q AS (SELECT *, (before + least(size, whole - before) / 2) / whole AS share, (u + v) / 2 * 0.5::DOUBLE AS half FROM n),
r AS (SELECT *, greatest(share - half, 0) AS rest FROM q)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken = 0 THEN NULL
            WHEN share > half THEN 0.5::DOUBLE + least(2 * rest / (v + sqrt(greatest(v * v + 4 * (w - v) * rest, 0))), 0.5::DOUBLE)
            ELSE least(2 * share / (u + sqrt(greatest(u * u + 4 * (v - u) * share, 0))), 0.5::DOUBLE) END AS position
FROM r""")
def op7_mix_sources(spark, sf_dir):
    """Words that the mix's copies take from every document and the training
    position (0..1) of the first copy, in that order; documents without a copy
    have no position and come last."""
    out = mixing.plan_mix(runtime.documents(spark, sf_dir, "doc_id", "text", "source")
                          .select("doc_id", "source", mixing.word_count(F.col("text")).alias("n_words")),
                          size=F.col("n_words"))
    taken = F.aggregate("copies.words", F.lit(0).cast("long"), lambda total, words: total + words)
    return mixing.in_training_order(out, mixing.SCHEDULES).select("row.doc_id", "mix.size", "mix.source_size", "mix.target", taken.alias("taken"),
                                                                  F.try_element_at("copies", F.lit(1))["position"].alias("position"))


@query("op8_substring_dedup", sql=r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS win
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
low AS (SELECT win, min(doc_id) AS low FROM p GROUP BY win),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM p JOIN low USING (win), range(13) t(k) WHERE p.doc_id > low.low),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
k AS (SELECT x.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY x.j) AS kept
      FROM x LEFT JOIN gone g ON x.doc_id = g.doc_id AND x.j = g.j WHERE g.j IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id""")
def op8_substring_dedup(spark, sf_dir):
    """Words left of every document when passages of 13 words that a document
    with a smaller id has too are removed."""
    out = suffix.kept_text(runtime.documents(spark, sf_dir, "doc_id", "text"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op9_merkle_fingerprints")
def op9_merkle_fingerprints(spark, sf_dir):
    """Merkle fingerprints of every document and its edited text, with likenesses."""
    return merkle.fingerprints(runtime.documents(spark, sf_dir, "doc_id", "text"))


@query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    """Toxicity score of every document, learned outside the held-out fifth."""
    docs = runtime.documents(spark, sf_dir, "doc_id", "text")
    model = toxicity.fit(docs, labels(spark, sf_dir), "toxic", parts=5, held=0)
    out = docs.select("doc_id", toxicity.is_held_out(F.col("doc_id"), 5, 0).alias("held_out"),
                      toxicity.score(spark, model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


# DuckDB has no CRC-32: a table of 256 steps, then one step per byte of every distinct word.
_CRC_SQL = r"""
step AS (SELECT list(list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
                    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)),
feats AS (
  SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 't', NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
words AS (SELECT w, lower(hex(encode(w))) AS hx FROM (SELECT DISTINCT w FROM feats)),
crcs AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, (length(hx) // 2)::BIGINT),
                 lambda i: (position(substr(hx, (2 * i + 1)::INT, 1) IN '0123456789abcdef') - 1) * 16
                      + position(substr(hx, (2 * i + 2)::INT, 1) IN '0123456789abcdef') - 1)),
                 lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
         FROM words, step)"""


@query("op11_importance_resampling", sql="WITH " + _CRC_SQL + """,
f AS (SELECT side, doc_id, bucket FROM feats JOIN crcs USING (w)),
n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM f GROUP BY bucket),
a AS (SELECT count(*) FILTER (side = 'd') AS s_all, count(*) FILTER (side = 't') AS t_all FROM f),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM n, a),
w AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN g USING (bucket) WHERE side = 'd' GROUP BY doc_id),
h AS (SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
             list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda i: (position(substr(sha256('2024:' || d.doc_id), i::INT, 1) IN '0123456789abcdef') - 1)::BIGINT)),
                         lambda x, y: x * 16 + y) AS h
      FROM documents d LEFT JOIN w ON d.doc_id = w.doc_id),
z AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS eligible FROM z WHERE n_features >= 20)
SELECT z.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * eligible // 100 THEN rank END AS rank
FROM z LEFT JOIN r ON z.doc_id = r.doc_id""")
def op11_importance_resampling(spark, sf_dir):
    """Importance weight, score and rank of every document, drawn towards the benchmark texts."""
    out = resampling.resample(runtime.documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_fill_in_middle", sql=r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tok,
                  list_transform(string_split(sha256('42:' || doc_id), ''), lambda c: position(c IN '0123456789abcdef') - 1) AS x FROM documents),
h AS (SELECT doc_id, text, tok, len(tok)::BIGINT AS n,
             list_transform([0, 8, 16, 24], lambda k: list_reduce(list_prepend(0::BIGINT, list_transform(list_slice(x, k + 1, k + 8), lambda v: v::BIGINT)), lambda p, q: p * 16 + q)) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
                  WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(list_slice(tok, 1, a), '') AS pre, array_to_string(list_slice(tok, a + 1, b), '') AS mid,
             array_to_string(list_slice(tok, b + 1, n), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p""")
def op12_fill_in_middle(spark, sf_dir):
    """Fill-in-the-middle form of every document, and the text rebuilt from it."""
    out = infilling.fill_in_middle(runtime.documents(spark, sf_dir, "doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                      sha(infilling.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


@query("op13_suffix_array_dedup")
def op13_suffix_array_dedup(spark, sf_dir):
    """Bytes left of every document when strings of 400 bytes that occur twice are removed wherever they stand."""
    out = suffixarray.kept_bytes(runtime.documents(spark, sf_dir, "doc_id", "text"), depth=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
