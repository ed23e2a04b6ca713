"""Quality classifier: regularised quadratic discriminant analysis.

Every document becomes a vector of transformed statistics of its whole text.
Each class has its own mean and covariance, the covariance shrunk towards the
pooled one and towards a multiple of the identity. A document's score is the
logistic of the difference of the classes' Mahalanobis log-densities (plus the
log of their shares); the inverse Cholesky factors are computed once and
broadcast with the means.

Sums and sums of products per class are all that fitting needs. They are added
up over all labelled training rows by Spark; the driver sees one matrix per
class, whatever the number of rows.

Defined cases: null text counts as empty; an empty text has all statistics 0
and a score like any other. Several labels of one id count as the largest. A
class without training rows makes every score the smoothed share of label 1.
Null ids match no label and are held out or not by the CRC of the empty string.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.runtime import Scratch

STATISTICS = ("log_words", "word_length", "upper", "digit", "sign", "wide", "distinct", "top_share", "repeat_next",
              "line_repeat", "bar_words", "sign_ends", "log_lines", "sentence_words", "length_spread")
POOL, RIDGE = 0.1, 0.02  # weight of the pooled covariance; of the identity
CHUNK = 1 << 20

KIND = np.zeros(256, dtype=np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 sign, 5 blank, 6 beyond ASCII
KIND[0x61:0x7B], KIND[0x41:0x5B], KIND[0x30:0x3A] = 1, 2, 3
KIND[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 4
KIND[[0x20, *range(0x09, 0x0E)]] = 5
KIND[0x80:] = 6
SIGN_ENDS = tuple("*#%&$!|@^~=+<>")


def _logit(p: float) -> float:
    p = min(max(p, 0.0), 1.0)
    return math.log((p + 0.01) / (1.01 - p))


def statistics(text: str) -> list[float]:
    """Transformed statistics of a text, in the order of STATISTICS."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.zeros(7, dtype=np.int64)
    for k in range(0, len(raw), CHUNK):
        kinds += np.bincount(KIND[np.frombuffer(raw[k: k + CHUNK], dtype=np.uint8)], minlength=7)
    solid = max(int(kinds.sum() - kinds[5]), 1)
    letters = max(int(kinds[1] + kinds[2]), 1)
    size = np.fromiter(map(len, words), dtype=np.float64, count=n)
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    ends = sum([w[-1] in ".!?" for w in words])
    return [
        math.log1p(n), math.log1p(size.mean()), _logit(kinds[2] / letters), _logit(kinds[3] / solid),
        _logit(kinds[4] / solid), _logit(kinds[6] / solid), _logit(len(seen) / n) / math.log(n + 2.0),
        _logit(max(seen.values()) / n), _logit(sum([a == b for a, b in zip(words, words[1:])]) / n),
        _logit(1 - len(set(lines)) / max(len(lines), 1)), _logit(seen.get("|", 0) / n),
        _logit(sum([w.endswith(SIGN_ENDS) for w in words]) / n), math.log1p(len(lines)),
        math.log1p(n / (ends + 1.0)), math.log1p(size.std()),
    ]


def statistics_column():
    @F.pandas_udf("array<double>")
    def column(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            yield pd.Series([statistics(t or "") for t in texts], dtype=object)

    return column


class Discriminant:
    """Class means, inverse Cholesky factors and log terms."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float = POOL, ridge: float = RIDGE):
        d = len(STATISTICS)
        n = {c: sums[c][0] if c in sums else 0.0 for c in (0, 1)}
        self.base = (n[1] + 1.0) / (n[0] + n[1] + 2.0)
        self.classes = None
        if min(n.values()) < 1:
            return
        mean = {c: sums[c][1] / n[c] for c in (0, 1)}
        scatter = {c: sums[c][2] - n[c] * np.outer(mean[c], mean[c]) for c in (0, 1)}
        pooled = (scatter[0] + scatter[1]) / max(n[0] + n[1] - 2, 1)
        self.classes = {}
        for c in (0, 1):
            own = scatter[c] / max(n[c] - 1, 1)
            weight = max(pool, 1.0 / (1.0 + n[c] / (d + 1.0)))  # few rows lean on the pooled covariance
            cov = (1 - weight) * own + weight * pooled
            cov = (1 - ridge) * cov + ridge * (np.trace(cov) / d + 1e-6) * np.eye(d)
            low = np.linalg.cholesky(cov)
            self.classes[c] = (mean[c], np.linalg.inv(low), -np.log(np.diag(low)).sum() + math.log(n[c]))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.base)
        density = []
        for c in (0, 1):
            mean, inverse, constant = self.classes[c]
            z = (x - mean) @ inverse.T
            density.append(constant - 0.5 * (z * z).sum(axis=1))
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def class_sums(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per label of (label, x): number of rows, sum and sum of products of x."""
    d = len(STATISTICS)

    def partial(it):
        total = {c: np.zeros(1 + d + d * d) for c in (0, 1)}
        for pdf in it:
            if len(pdf):
                x, y = np.stack(pdf["x"].to_numpy()), pdf["label"].to_numpy()
                for c in (0, 1):
                    part = x[y == c]
                    total[c] += np.concatenate(([len(part)], part.sum(axis=0), (part.T @ part).ravel()))
        yield pd.DataFrame({"label": np.repeat([0, 1], 1 + d + d * d), "k": np.tile(np.arange(1 + d + d * d), 2),
                            "v": np.concatenate((total[0], total[1]))})

    got = rows.mapInPandas(partial, "label int, k int, v double").groupBy("label", "k").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for c, part in got.groupby("label"):
        v = part.sort_values("k")["v"].to_numpy()
        out[int(c)] = (v[0], v[1: 1 + d], v[1 + d:].reshape(d, d))
    return out


def is_held_out(id_col: Column, parts: int, held: int) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts == held


def fit(rows: DataFrame, labels: DataFrame, label_col: str, parts: int, held: int) -> Discriminant:
    """Fit on (doc_id, x) rows with a label, outside the held-out part."""
    one = (labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()
                         & ~is_held_out(F.col("doc_id"), parts, held))
           .groupBy(F.col("doc_id").alias("t_id")).agg((F.max(label_col) > 0).cast("int").alias("label")))
    train = rows.join(one, F.col("doc_id") == F.col("t_id")).select("label", "x")
    return Discriminant(class_sums(train))


def score_column(spark, model: Discriminant):
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def column(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in it:
            yield pd.Series(shared.value.score(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

    return column


def scored_documents(docs: DataFrame, labels: DataFrame, label_col: str = "quality", parts: int = 3, held: int = 1,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score and predicted."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       statistics_column()(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("x"))
    rows = Scratch(spark, "quality").keep(rows, "statistics")
    model = fit(rows, labels, label_col, parts, held)
    out = rows.select("doc_id", is_held_out(F.col("doc_id"), parts, held).alias("held_out"),
                      score_column(spark, model)("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
