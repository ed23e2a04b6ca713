"""Importance resampling towards a target distribution of hashed n-grams.

Features are runs of 1..``n`` consecutive words; a feature's bucket is the CRC-32
of its bytes modulo ``buckets``. A bucket's gain says how much more often the
target texts fall into it than the documents do; a document's weight is the
sum of its features' gains, and a Gumbel variate drawn from its id turns the
weights into a sample without replacement: the highest scores are drawn.

The CRCs come from prefixes. A document is normalised once (A-Z lowered, every
other separator one blank) and scanned once, which stores the running CRC at
the end of every word. CRC is linear over GF(2): with ``shift(c, m)`` the CRC
register ``c`` run over ``m`` zero bytes, ``crc(A + B) = shift(crc(A), len(B)) ^ crc(B)``,
so the CRC of words i..j is ``end[j] ^ shift(begin[i], length)``. No n-gram is
built or hashed by itself, whatever its length. ``shift`` by 2^k bytes is a 32 x 32 bit
matrix, kept as four tables of 256 words.

Counts are summed in the tasks (at most ``buckets`` rows each) before the
shuffle; the two tables of at most ``buckets`` counts are all that reaches the
driver, and the gains travel inside the scoring function. Ranks come from a
range sort with partition counts.

Defined cases: a null or empty text has no words, no features, weight 0. A null
id draws as the empty string and counts as larger than all others in ties; rows
that agree in score and id are ranked in any order. Empty tables give empty
results; an empty target gives gains from zero counts. Only the id and text
columns are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.runtime import Scratch
from flowlens.operators.ranking import Ranked

BUCKETS = 10_000
LONGEST_RUN = 1
MIN_WORDS = 20
SHARE = 10  # per cent of the documents that are long enough
SEED = 2024
GATHER = 1 << 16  # words whose n-grams are derived together

# Bytes of words: digits, lower-case letters and all of UTF-8 beyond ASCII; the rest separates.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _byte_step() -> np.ndarray:
    """What eight zero bits make of every low byte of the CRC register (reflected polynomial of CRC-32)."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


STEP = _byte_step()


class Shifter:
    """``shift(c, m)``: CRC registers run over m zero bytes, m given per element."""

    def __init__(self):
        unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
        self.images = STEP[unit & 255] ^ (unit >> 8)  # of the 32 unit vectors, for one zero byte
        self.tables = [self._tables(self.images)]

    @staticmethod
    def _tables(images: np.ndarray) -> np.ndarray:
        out = np.zeros((4, 256), dtype=np.uint32)
        v = np.arange(256)
        for byte in range(4):
            for bit in range(8):
                out[byte] ^= np.where(v >> bit & 1, images[8 * byte + bit], np.uint32(0))
        return out

    def _apply(self, k: int, c: np.ndarray) -> np.ndarray:
        t = self.tables[k]
        return t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]

    def __call__(self, c: np.ndarray, m: np.ndarray) -> np.ndarray:
        c = c.copy()
        for k in range(int(m.max()).bit_length() if len(m) else 0):
            if k == len(self.tables):  # twice as far: the matrix of 2^(k-1) bytes, applied to itself
                self.images = self._apply(k - 1, self.images)
                self.tables.append(self._tables(self.images))
            at = np.flatnonzero(m >> k & 1)
            c[at] = self._apply(k, c[at])
        return c


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(NORMAL).split()


def running_crcs(words: list[bytes]) -> Iterator[int]:
    """CRC of the normalised document up to the end of every word."""
    return accumulate(words[1:], lambda c, w: crc32(w, crc32(b" ", c)), initial=crc32(words[0]))


def _after_blank(c: np.ndarray) -> np.ndarray:
    """The running CRC one blank further."""
    register = ~c
    return ~(STEP[(register ^ np.uint32(32)) & 255] ^ (register >> 8))


def run_crcs(documents: list[list[bytes]], n: int, shift: Shifter) -> tuple[np.ndarray, np.ndarray]:
    """CRC and document number of every run of 1..n words of some documents."""
    sizes = np.array([len(w) for w in documents], dtype=np.int64)
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(documents)), sizes)
    end = np.fromiter((c for w in documents if w for c in running_crcs(w)), dtype=np.uint32, count=total)
    size = np.fromiter((len(x) for w in documents for x in w), dtype=np.int64, count=total)
    stop = np.cumsum(size + 1)  # where a word ends, one separator counted
    first = np.concatenate(([True], owner[1:] != owner[:-1]))
    begin = np.concatenate((np.zeros(1, np.uint32), _after_blank(end[:-1])))
    begin[first] = 0
    crcs, owners = [], []
    for k in range(n):
        i = np.flatnonzero(owner[: total - k] == owner[k:]) if k < total else np.zeros(0, dtype=np.int64)
        length = stop[i + k] - (stop[i] - size[i])
        crcs.append(end[i + k] ^ shift(begin[i], length))
        owners.append(owner[i])
    return np.concatenate(crcs), np.concatenate(owners)


def _gathered(it: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and words of documents, some ``GATHER`` words at a time."""
    ids, docs, held = [], [], 0
    for pdf in it:
        for i, text in zip(pdf["id"], pdf["text"]):
            words = words_of(text)
            ids.append(None if pd.isna(i) else int(i))
            docs.append(words)
            held += len(words)
            if held >= GATHER or len(docs) >= GATHER:
                yield ids, docs
                ids, docs, held = [], [], 0
    if docs:
        yield ids, docs


def bucket_counts(texts: DataFrame, text_col: str = "text", n: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts per bucket."""
    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shift, counts = Shifter(), np.zeros(buckets, dtype=np.int64)
        for _, docs in _gathered(it):
            counts += np.bincount(run_crcs(docs, n, shift)[0] % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": counts[at]})

    parts = texts.select(F.lit(0).alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(rows, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket floor(1000 ln of how much likelier the target is to fall into it), counts smoothed by one."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((source.get(b, 0) + 1.0) * t_all)))
                     for b in range(buckets)], dtype=np.int64)


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """floor(1000 x a standard Gumbel variate) drawn from the hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weighted(docs: DataFrame, gain: np.ndarray, n: int = LONGEST_RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""
    buckets = len(gain)

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shift = Shifter()
        for ids, texts in _gathered(it):
            crcs, owner = run_crcs(texts, n, shift)
            total = np.zeros(len(texts), dtype=np.int64)
            np.add.at(total, owner, gain[crcs % np.uint32(buckets)])
            yield pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "n_words": [len(w) for w in texts],
                                "n_features": np.bincount(owner, minlength=len(texts)), "weight": total})

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInPandas(rows, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, n: int = LONGEST_RUN, buckets: int = BUCKETS, min_words: int = MIN_WORDS,
             share: int = SHARE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of
    every document; ``share`` per cent of those with ``min_words`` words are drawn."""
    scratch = Scratch(docs.sparkSession, "resample")
    count = lambda df, col: {r["bucket"]: r["n"] for r in bucket_counts(df, col, n, buckets).collect()}  # noqa: E731  at most `buckets`
    gain = gains(count(docs, text_col), count(target, target_col), buckets)
    scored = weighted(docs, gain, n, id_col, text_col)
    scored = scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)) \
        .withColumn("place", F.monotonically_increasing_id())  # parts rows that agree in all else
    scored = scratch.keep(scored, "scored")
    long_enough = F.col("n_words") >= min_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("place").asc()]
    ranked = Ranked(scored.filter(long_enough), order, "rank")
    drawn = share * ranked.total // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    rest = scored.filter(~long_enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.rows().withColumn("rank", rank).unionByName(rest).drop("place")
