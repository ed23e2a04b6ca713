"""Several outputs of a micro-batch that appear together or not at all.

Every attempt of a batch writes each output into a folder of its own. When all
are complete, one file -- the batch's manifest -- names these folders, and that
file publishes the batch: readers follow manifests only. An attempt that failed
half-way has no manifest, so nothing of it is seen; a batch that is replayed
after its manifest was written changes nothing.

A manifest is one row in one Parquet file, which Spark's committer renames into place
at the end. Of two attempts that raced to publish, readers take the manifest
with the smallest attempt name, for all outputs alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "attempt STRING, outputs MAP<STRING, STRING>"


class AtomicOutputs:
    """Named outputs below ``base``, published batch by batch."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def _manifests(self) -> DataFrame | None:
        """One row per published batch: batch, attempt, outputs."""
        try:
            rows = self.spark.read.schema(f"{MANIFEST}, batch LONG").option("pathGlobFilter", "*.parquet").parquet(f"{self.base}/manifests")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        first = rows.groupBy("batch").agg(F.min_by("outputs", "attempt").alias("outputs"), F.min("attempt").alias("attempt"))
        return first

    def published(self, batch_id: int | None = None) -> list[int]:
        """Ids of the published batches (of one batch, if asked)."""
        rows = self._manifests()
        if rows is None:
            return []
        rows = rows if batch_id is None else rows.filter(F.col("batch") == batch_id)
        return sorted(r["batch"] for r in rows.select("batch").collect())  # one number a batch

    def write(self, batch: DataFrame, batch_id: int, outputs: dict[str, Callable[[DataFrame], DataFrame]]) -> None:
        """Write ``outputs`` (name -> what to make of the batch) and publish them."""
        if self.published(batch_id):
            return
        attempt = uuid.uuid4().hex
        paths = {name: f"data/{name}/batch={batch_id}/{attempt}" for name in outputs}
        # The batch's rows are written first, so that all outputs see the same ones.
        rows_path = f"{self.base}/data/_input/batch={batch_id}/{attempt}"
        batch.write.parquet(rows_path)
        rows = self.spark.read.schema(batch.schema).parquet(rows_path)
        for name, make in outputs.items():
            make(rows).write.parquet(f"{self.base}/{paths[name]}")
        self.publish(batch_id, attempt, paths)

    def publish(self, batch_id: int, attempt: str, paths: dict[str, str]) -> None:
        row = self.spark.createDataFrame([(attempt, paths)], MANIFEST).coalesce(1)
        row.write.mode("append").parquet(f"{self.base}/manifests/batch={batch_id}")

    def read(self, name: str) -> DataFrame | None:
        """The rows of one output, of published batches only; None before the first."""
        rows = self._manifests()
        if rows is None:
            return None
        paths = [f"{self.base}/{r[0]}" for r in rows.select(F.col("outputs")[name]).collect()]  # one path a batch
        return self.spark.read.parquet(*paths) if paths else None
