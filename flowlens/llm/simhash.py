"""SimHash near-duplicates by the generalised pigeonhole principle.

A 64-bit fingerprint is the bitwise majority of the hashes of a document's
word shingles. Two fingerprints within ``tau`` bits must, for any partition of
the bits into groups with thresholds that sum to ``tau - m + 1``, agree within
its threshold on at least one group (a threshold of -1 leaves the group out).
So:

1. Correlated bits go into the same group. The 64x64 correlation matrix is
   summed over all distinct fingerprints.
2. For every group and threshold, the number of candidate pairs is estimated
   from value histograms of all fingerprints. A Walsh-Hadamard transform turns
   the histogram of a block of up to 11 bits into its exact pair-distance
   distribution; the blocks of a group are combined as if independent.
3. Dynamic programming picks the thresholds that cost least (probes plus
   candidates), for each number of groups, and the cheapest number of groups.
4. Every fingerprint is indexed under its value on each group and probes with
   all values within the threshold; candidates are verified on all 64 bits.
   Values that more than ``HOT`` fingerprints share are split further by the
   same principle on the remaining bits, which loses no pair.

Equal fingerprints form one class before the search, so copies cost nothing.
Links between classes give the components; nothing of the documents is
collected -- only the matrix and the histograms, of fixed size.

Defined cases: null text, or text without words, has fingerprint 0 and is
linked like any other; a text with fewer words than the shingle length has the
whole sequence as its one shingle. ``component_id`` is the smallest non-null
id of the component. Where that id stands on several rows, one of them counts
as kept. Empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.components import components
from flowlens.llm.runtime import Scratch

BITS = 64
SHINGLE = 3
TAU = 3
SEED = 42
HOT = 256  # a group value shared by more fingerprints is split further
BLOCK = 11  # bits of one histogram
CHUNK = 1 << 15  # shingles whose bits are counted at a time
GROUPS = (2, 3, 4)


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the shingles' XXH64 (unsigned). Only A-Z is lower-cased
    and only the six ASCII blanks part words: bytes.lower and bytes.split."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: max(1, n - shingle + 1)].tolist()
    ends = ends[min(shingle, n) - 1:].tolist()
    h64, ones = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(starts), CHUNK):
        h = np.array([h64(joined[a:b], seed) for a, b in zip(starts[k: k + CHUNK], ends[k: k + CHUNK])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > len(starts)))


def fingerprint_column(shingle: int, seed: int):
    @F.pandas_udf("long")
    def column(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            out = np.array([fingerprint(t or "", shingle, seed) for t in texts], dtype=np.uint64)
            yield pd.Series(out.view(np.int64))

    return column


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


# --- choosing groups and thresholds ---------------------------------------

def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the absolute correlation of their bits."""
    def partial(it):
        n, both = 0, np.zeros((BITS, BITS))
        for pdf in it:
            v = pdf["fp"].to_numpy().view(np.uint8).reshape(-1, 8)
            x = np.unpackbits(v, axis=1, bitorder="little").astype(np.float32)
            n += len(x)
            both += x.T @ x
        yield pd.DataFrame({"k": np.arange(BITS * BITS + 1), "v": np.append(both.ravel(), n)})

    got = fps.select("fp").mapInPandas(partial, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    if got.empty:
        return 0, np.zeros((BITS, BITS))
    v = got.sort_values("k")["v"].to_numpy()
    n, both = v[-1], v[:-1].reshape(BITS, BITS)
    if n == 0:
        return 0, np.zeros((BITS, BITS))
    p = np.diag(both) / n
    cov, sd = both / n - np.outer(p, p), np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return int(n), np.abs(cov / np.outer(sd, sd))


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of nearly equal width; each takes the bit most correlated
    with what it already holds."""
    free, out = set(range(BITS)), []
    for g in range(m):
        width = BITS // m + (g < BITS % m)
        rest = sorted(free)
        start = max(rest, key=lambda b: (corr[b, rest].sum(), -b))
        group = [start]
        free.discard(start)
        while len(group) < width:
            nxt = max(sorted(free), key=lambda b: (corr[b, group].sum(), -b))
            group.append(nxt)
            free.discard(nxt)
        out.append(sorted(group))
    return out


def blocks_of(group: list[int]) -> list[list[int]]:
    k = -(-len(group) // BLOCK)
    return [list(map(int, part)) for part in np.array_split(group, k)]


def distance_shares(hist: np.ndarray) -> np.ndarray:
    """Share of ordered pairs at each bit distance, from a block's value counts."""
    n, a, h = hist.sum(), hist.astype(float).copy(), 1
    while h < len(a):
        a = a.reshape(-1, 2, h)
        a = np.stack([a[:, 0] + a[:, 1], a[:, 0] - a[:, 1]], axis=1).reshape(-1)
        h *= 2
    a = a * a
    h = 1
    while h < len(a):
        a = a.reshape(-1, 2, h)
        a = np.stack([a[:, 0] + a[:, 1], a[:, 0] - a[:, 1]], axis=1).reshape(-1)
        h *= 2
    auto = np.maximum(a / len(a), 0.0)  # pairs whose values differ by exactly this XOR
    bits = np.bitwise_count(np.arange(len(a), dtype=np.uint32))
    return np.bincount(bits, weights=auto) / max(n * n, 1.0)


def histograms(fps: DataFrame, blocks: list[list[int]]) -> list[np.ndarray]:
    def partial(it):
        h = [np.zeros(1 << len(b), dtype=np.int64) for b in blocks]
        for pdf in it:
            x = np.unpackbits(pdf["fp"].to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            for k, b in enumerate(blocks):
                h[k] += np.bincount(x[:, b].astype(np.int64) @ (1 << np.arange(len(b))), minlength=len(h[k]))
        for k, c in enumerate(h):
            at = np.flatnonzero(c)
            yield pd.DataFrame({"k": np.full(len(at), k), "v": at, "n": c[at]})

    got = (fps.select("fp").mapInPandas(partial, "k int, v int, n long").groupBy("k", "v").agg(F.sum("n").alias("n"))
           .toPandas())
    out = [np.zeros(1 << len(b), dtype=np.int64) for b in blocks]
    for k, part in got.groupby("k"):
        out[int(k)][part["v"].to_numpy()] = part["n"].to_numpy()
    return out


def n_probes(width: int, t: int) -> int:
    import math

    return sum(math.comb(width, j) for j in range(t + 1))


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (one per group, from the group's ``costs``) that sum to
    ``total`` at least cost: dynamic programming over the groups."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, picked) in best.items():
            for t, more in c.items():
                if s + t not in nxt or cost + more < nxt[s + t][0]:
                    nxt[s + t] = (cost + more, [*picked, t])
        best = nxt
    return best[total]


def choose(fps: DataFrame, tau: int, options=GROUPS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of every group that is probed."""
    n, corr = bit_statistics(fps)
    if n < 2:
        return []
    plans = [group_bits(corr, m) for m in options]
    blocks = [b for groups in plans for g in groups for b in blocks_of(g)]
    shares = iter([distance_shares(h) for h in histograms(fps, blocks)])
    best = None
    for groups in plans:
        costs = []
        for g in groups:
            dist = np.ones(1)
            for _ in blocks_of(g):
                dist = np.convolve(dist, next(shares))
            upto = np.cumsum(dist)
            costs.append({-1: 0.0} | {t: n * n_probes(len(g), t) + n * n * float(upto[t])
                                      for t in range(tau + 1) if n_probes(len(g), t) <= 6000})
        cost, picked = allocate(costs, tau - len(groups) + 1)
        if best is None or cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, picked) if t >= 0])
    return best[1]


# --- search -----------------------------------------------------------------

def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def _flips(bits, t: int) -> list[int]:
    return [signed(_mask(c)) for k in range(t + 1) for c in combinations(bits, k)]


def _variants(value, flips: list[int]):
    return F.transform(F.array(*[F.lit(f) for f in flips]), lambda f: value.bitwiseXOR(f))


def _piece_keys(number: int, bits: list[int], reach: int):
    values = _variants(F.col("fp").bitwiseAND(F.lit(signed(_mask(bits)))), _flips(bits, reach))
    return F.transform(values, lambda w: F.struct(F.lit(number).alias("k"), w.alias("w")))


def links(fps: DataFrame, tau: int, scratch: Scratch, hot: int = HOT, options=GROUPS) -> DataFrame:
    """All pairs (a, b) of distinct fingerprints within ``tau`` bits."""
    found = None
    for number, (bits, t) in enumerate(choose(fps, tau, options)):
        rest = sorted(set(range(BITS)) - set(bits))
        mask = signed(_mask(bits))
        index = fps.select("fp", F.col("fp").bitwiseAND(F.lit(mask)).alias("v"))
        crowded = scratch.keep(index.groupBy("v").count().filter(F.col("count") > hot).select(F.col("v").alias("hv")),
                               f"crowded{number}")
        probe = fps.select("fp", F.explode(_variants(F.col("fp").bitwiseAND(F.lit(mask)), _flips(bits, t))).alias("v"))
        if crowded.limit(1).count():  # more conditions on the rest of the bits, for crowded values only
            pieces = [rest[: len(rest) // 2], rest[len(rest) // 2:]]
            share = (tau - len(pieces) + 1 + 1) // len(pieces)

            def split(rows: DataFrame, reach: int) -> DataFrame:
                keys = F.concat(*[_piece_keys(k, p, reach) for k, p in enumerate(pieces)])
                one = F.array(F.struct(F.lit(-1).alias("k"), F.lit(0).cast("long").alias("w")))
                return (rows.join(crowded, F.col("v") == F.col("hv"), "left")
                        .select("fp", "v", F.explode(F.when(F.col("hv").isNull(), one).otherwise(keys)).alias("key"))
                        .select("fp", "v", "key.k", "key.w"))

            index, probe, on = split(index, 0), split(probe, share), ["v", "k", "w"]
        else:
            on = ["v"]
        pairs = (probe.withColumnRenamed("fp", "a").join(index.withColumnRenamed("fp", "b"), on)
                 .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau))
                 .select("a", "b"))
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).filter(F.lit(False))
    return found.distinct()


def near_groups(docs: DataFrame, shingle: int = SHINGLE, tau: int = TAU, seed: int = SEED, id_col: str = "doc_id",
                text_col: str = "text", carry: list[str] | None = None, hot: int = HOT, options=GROUPS) -> DataFrame:
    """Per input row: ``row`` (the carried columns as a struct), ``fp`` (signed
    64-bit fingerprint), ``component_id`` and ``kept``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    carry = carry or docs.columns
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = scratch.keep(docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(id_col).alias("id"),
                                    fingerprint_column(shingle, seed)(text).alias("fp")), "rows")
    classes = scratch.keep(rows.groupBy("fp").agg(F.min("id").alias("low")), "classes")
    pairs = scratch.keep(links(classes.select("fp"), tau, scratch, hot, options), "links")
    roots = components(pairs, scratch)
    rooted = scratch.keep(classes.join(roots, F.col("fp") == F.col("node"), "left")
                          .select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id")).withColumnRenamed("root", "low_root")
    member = scratch.keep(rooted.join(lowest, F.col("root") == F.col("low_root"))
                          .select(F.col("fp").alias("m_fp"), "root", "component_id"), "members")
    place = F.struct(F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    out = (rows.select("row", "id", "fp", place.alias("place")).join(member.hint("merge"), F.col("fp") == F.col("m_fp"))
           .withColumn("lowest", F.col("id").eqNullSafe(F.col("component_id"))))
    first = (rows.select("id", "fp", place.alias("place")).join(member, F.col("fp") == F.col("m_fp"))
             .filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root")
             .agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).filter("n > 1"))
    first = scratch.keep(first.select(F.col("root").alias("f_root"), "first"), "ties")
    if first.limit(1).count():  # the smallest id stands on several rows of a component
        out = (out.join(first, F.col("root") == F.col("f_root"), "left")
               .withColumn("lowest", F.col("lowest") & (F.col("first").isNull() | (F.col("place") == F.col("first")))))
    return out.select("row", "fp", "component_id", F.col("lowest").alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The input's rows and columns, one document of every component."""
    kept = near_groups(docs, **options).filter("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
