"""Line deduplication by overlapping three-line windows.

Every three consecutive lines of a document are hashed together (MD5). Windows
whose hash occurs more than once anywhere are repeats: the first, in the order
of document id and position, stays, and every later one covers its three
lines. Overlapping windows merge into one covered stretch, which is removed.

Windows are counted by a partially combined aggregate, so a window that a
third of all documents share costs each task one row; the join of the windows
with the repeated hashes is a merge join whose hot keys Spark splits.

Defined cases: lines are parted by the line feed and compared unchanged; null
text has no lines, an empty text has one empty line; documents of fewer than
three lines lose nothing; null ids come after all others; equal rows (id and
text) count as one document, so neither is the later one. Windows are judged
on the input, not on what is left. Empty tables give empty results; only the
id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.runtime import Scratch

WINDOW = 3
LAST = (1 << 63) - 1  # stands for a null id


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord"),
                       F.xxhash64(F.coalesce(text, F.lit(""))).alias("crc"), text.alias("text"))


def line_windows(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(ord, crc, pos, key): the hash of the lines pos .. pos + window - 1."""
    lines = F.split(F.col("text"), "\n", -1)
    keys = F.transform(F.sequence(F.lit(1), F.size("lines") - (window - 1)),
                       lambda i: F.unhex(F.md5(F.array_join(F.slice("lines", i, window), "\n").cast("binary"))))
    rows = texts.select("ord", "crc", lines.alias("lines")).filter(F.size("lines") >= window)
    return rows.select("ord", "crc", F.posexplode(keys).alias("pos", "key"))


def later_windows(texts: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """(ord, crc, pos): windows that occur earlier too."""
    windows = line_windows(texts, window)
    place = F.struct("ord", "crc", "pos")
    many = (windows.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
            .select(F.col("key").alias("m_key"), "first"))
    many = scratch.keep(many, "repeated")
    return (windows.join(many.hint("merge"), F.col("key") == F.col("m_key"))
            .filter(place > F.col("first")).select("ord", "crc", "pos"))


def kept_lines(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_lines, n_removed and ``kept`` (the lines left)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    texts = _texts(docs, id_col, text_col)
    marks = scratch.keep(later_windows(texts, scratch, window).groupBy("ord", "crc").agg(F.collect_set("pos").alias("at")), "marks")

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for i, text, at in zip(pdf["ord"], pdf["text"], pdf["at"]):
                lines = [] if text is None else text.split("\n")
                n = len(lines)
                if at is not None:
                    edge = np.zeros(n + 1, dtype=np.int64)
                    at = np.asarray(at, dtype=np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    covered = np.cumsum(edge[:n]) > 0
                    lines = [x for x, c in zip(lines, covered.tolist()) if not c]
                out.append((None if i == LAST else i, n, n - len(lines), "\n".join(lines)))
            yield pd.DataFrame(out, columns=["doc_id", "n_lines", "n_removed", "kept"]).astype({"doc_id": "Int64"})

    marks = marks.select(F.col("ord").alias("m_ord"), F.col("crc").alias("m_crc"), "at")
    joined = texts.join(marks.hint("merge"), (F.col("ord") == F.col("m_ord")) & (F.col("crc") == F.col("m_crc")), "left")
    return joined.select("ord", "text", "at").mapInPandas(rows, "doc_id long, n_lines long, n_removed long, kept string")
