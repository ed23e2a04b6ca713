"""Read the driver's parquet tables.

Always go through :func:`table` with the columns you need so the parquet
scan's ``ReadSchema`` is pruned at the source; filters applied afterwards are
pushed into the scan by Catalyst.
"""

from __future__ import annotations

import contextvars
import os
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return os.path.join(sf_dir, f"{name}.parquet")


_STREAMING = contextvars.ContextVar("flowlens_streaming_tables", default=None)


@contextmanager
def streaming_tables(max_files_per_trigger: int = 1):
    """Inside this block :func:`table` returns streaming frames (a file
    stream over the same parquet), so every adapter frame and operator built
    on it becomes a Structured Streaming plan unchanged."""
    token = _STREAMING.set(max_files_per_trigger)
    try:
        yield
    finally:
        _STREAMING.reset(token)


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    path = table_path(sf_dir, name)
    per_trigger = _STREAMING.get()
    if per_trigger is None:
        df = spark.read.parquet(path)
    else:
        schema = spark.read.parquet(path).schema  # footer only; a stream never infers
        # The table itself is the stream: a folder of part files or a single file. A plain path must be a
        # folder for a file stream; as a pattern (of this one name) it may be either.
        df = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")
    return df.select(*cols) if cols else df
