"""Global ranks without a global task.

``row_number`` over a window without keys sorts the whole table in one task,
and ``offset(n).limit(k)`` keeps ``n + k`` rows in every task. Here the rows are
range partitioned and sorted inside their partitions, written once, and the
row counts of the partitions (one number each) give the rank that each
partition starts with.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.session import scratch_path

_IN_PARTITION = (1 << 33) - 1


class Ranked:
    """A table in global order: :meth:`rows` has every row with its rank (from
    1), :meth:`page` reads only the files that hold the page."""

    def __init__(self, df: DataFrame, order: list[Column], rank_col: str = "rank", drop: tuple[str, ...] = ()):
        self.spark, self.rank_col, self.drop = df.sparkSession, rank_col, drop
        self.path = scratch_path(self.spark, f"ranked-{uuid.uuid4().hex}")
        placed = (df.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumn("__place", F.monotonically_increasing_id())
                  .withColumn("__part", F.shiftright("__place", 33).cast("int")))
        self.schema = placed.schema
        placed.write.partitionBy("__part").parquet(self.path)
        self._table = self.spark.read.schema(self.schema).parquet(self.path)
        counts = {r["__part"]: r["count"] for r in self._table.groupBy("__part").count().collect()}  # one row a partition
        self.starts, total = {}, 0
        for part in sorted(counts):
            self.starts[part] = total
            total += counts[part]
        self.total = total

    def _ranked(self, rows: DataFrame, starts: dict[int, int]) -> DataFrame:
        table = self.spark.createDataFrame(sorted(starts.items()), "__p INT, __start LONG")
        # One row per partition of the sort, so the broadcast is bounded by the partition count.
        out = rows.join(F.broadcast(table), F.col("__part") == F.col("__p"))
        rank = F.col("__start") + F.col("__place").bitwiseAND(F.lit(_IN_PARTITION)) + 1
        return out.withColumn(self.rank_col, rank).drop("__p", "__start", "__place", "__part", *self.drop)

    def rows(self) -> DataFrame:
        return self._ranked(self._table, self.starts)

    def page(self, page: int, size: int) -> DataFrame:
        """Rows ranked ``page * size + 1 .. (page + 1) * size``, from the partitions that hold them."""
        low, high = page * size, (page + 1) * size
        ordered = sorted(self.starts.items())
        ends = [s for _, s in ordered[1:]] + [self.total]
        hit = {p: s for (p, s), end in zip(ordered, ends) if s < high and end > low}
        rows = self._table.filter(F.col("__part").isin(*hit)) if hit else self._table.filter(F.lit(False))
        return self._ranked(rows, hit).filter((F.col(self.rank_col) > low) & (F.col(self.rank_col) <= high))
