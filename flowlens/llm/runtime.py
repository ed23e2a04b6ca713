"""What the operators share: session settings, shared scratch tables, input frames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.session import apply_defaults, scratch_path
from flowlens.sources.tables import table

# Rows of one Arrow batch. Texts reach 100 kB and more, so the default of
# 10,000 rows could put a gigabyte into a Python worker at once.
ARROW_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that the operators need; every query calls this first."""
    apply_defaults(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return table(spark, sf_dir, "documents", *cols)


class Scratch:
    """Tables written below ``spark.checkpoint.dir``: they cut the lineage and
    survive lost executors. Every instance uses a folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def keep(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Write ``df`` and read it back with the schema it had (no inference)."""
        w = df.write.mode("errorifexists")
        (w.partitionBy(partition_by) if partition_by else w).parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
