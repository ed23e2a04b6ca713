"""State of keyed streams as rows: what a micro-batch changed, under its batch id.

A micro-batch reads the last state of the keys it holds, goes on from there and
appends the states that it changed. It reads smaller batch ids only and overwrites what
an earlier attempt left, so a replayed batch gives the same rows. All keys of a
batch are handled by one join and one sorted pass over partitions; nothing is
paid per key but its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StateLog:
    """Last states by ``key`` below ``base``; ``schema`` is the DDL of a state with its key."""

    def __init__(self, spark: SparkSession, base: str, key: str, schema: str):
        self.spark, self.base, self.key, self.schema = spark, base, key, schema

    def hold(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The rows of the micro-batch, written once: its plan is not run for each use."""
        path = f"{self.base}/in/_batch={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(batch.schema).parquet(path)

    def _all(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, _batch LONG").parquet(f"{self.base}/states")

    def _last(self, states: DataFrame) -> DataFrame:
        rest = [c for c in states.columns if c not in (self.key, "_batch")]
        return states.groupBy(self.key).agg(F.max_by(F.struct(*rest), "_batch").alias("_s")).select(
            self.key, *[F.col("_s")[c].alias(c) for c in rest])

    def before(self, rows: DataFrame, batch_id: int) -> DataFrame | None:
        """The states that the keys of ``rows`` have before this batch; None before the first."""
        if batch_id == 0:
            return None
        known = self._all().filter(F.col("_batch") < batch_id)
        return self._last(known.join(rows.select(self.key).distinct(), self.key, "left_semi"))

    def write(self, states: DataFrame, batch_id: int) -> None:
        states.write.mode("overwrite").parquet(f"{self.base}/states/_batch={batch_id}")

    def latest(self) -> DataFrame:
        return self._last(self._all())
