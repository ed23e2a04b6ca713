"""Polled extracts with a saved mark.

A poll reads the rows beyond the saved high-water mark, up to the greatest row that
is there when it starts, and publishes them together with the new mark by one
manifest (:mod:`flowlens.streaming.manifest`). A poll that failed half-way left no
manifest, so the next one starts from the old mark; a restart finds the mark
in the last manifest. Every row is extracted once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.streaming.manifest import AtomicOutputs

# The connector's modes, with the columns that order the rows in each.
MODES = {"incrementing": ("id",), "timestamp": ("ts",), "timestamp+incrementing": ("ts", "id")}


class PolledExtract:
    """Polls of the frame that ``source`` builds anew each time."""

    def __init__(self, spark: SparkSession, source: Callable[[], DataFrame], base: str, mode: str = "timestamp+incrementing",
                 ts_col: str = "updated_at", id_col: str = "id"):
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        names = {"ts": ts_col, "id": id_col}
        self.spark, self.source, self.out = spark, source, AtomicOutputs(spark, base)
        self.cols = [names[c] for c in MODES[mode]]

    def mark(self) -> tuple | None:
        """The last published mark, one value per ordering column."""
        marks = self.out.read("mark")
        if marks is None:
            return None
        last = marks.orderBy(F.col("poll").desc()).first()
        return tuple(last[c] for c in self.cols)

    def _beyond(self, mark: tuple[Column, ...]) -> Column:
        """Rows after the mark; each column's comparison is pushed to the scan."""
        cond, equal = F.lit(False), F.lit(True)
        for c, v in zip(self.cols, mark):
            cond, equal = cond | (equal & (F.col(c) > v)), equal & (F.col(c) == v)
        return (F.col(self.cols[0]) >= mark[0]) & cond

    def _literals(self, rows: DataFrame, mark: tuple) -> tuple[Column, ...]:
        return tuple(F.lit(v).cast(rows.schema[c].dataType) for c, v in zip(self.cols, mark))

    def poll(self) -> int:
        """Extract what is new; the number of rows."""
        before = self.mark()
        rows = self.source()
        if before is not None:
            rows = rows.filter(self._beyond(self._literals(rows, before)))
        top = rows.agg(F.max(F.struct(*self.cols)).alias("m"), F.count(F.lit(1)).alias("n")).first()
        if not top.n or top.m is None:
            return 0
        upper = tuple(top.m[c] for c in self.cols)
        rows = rows.filter(~self._beyond(self._literals(rows, upper)))  # rows that came meanwhile wait
        number = len(self.out.published())
        schema = rows.select(*self.cols).schema
        marked = self.spark.createDataFrame([upper], schema).withColumn("poll", F.lit(number))
        self.out.write(rows, number, {"rows": lambda r: r, "mark": lambda _: marked})
        return top.n

    def rows(self) -> DataFrame | None:
        """All rows extracted so far."""
        return self.out.read("rows")
