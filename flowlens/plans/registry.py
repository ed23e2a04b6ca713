"""Registry of named queries and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.session import apply_defaults

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``key``.

    ``sql`` is the DuckDB oracle; leave it out for operators SQL cannot
    express (ordered folds, streaming), which then get a rows-only check.
    """

    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key!r}")

        def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_defaults(spark)
            return comparable(fn(spark, sf_dir))

        wrapped.__name__ = fn.__name__
        wrapped.__doc__ = fn.__doc__
        QUERIES[key] = wrapped
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return deco


def comparable(df: DataFrame) -> DataFrame:
    """Exact decimals leave the engine as doubles (the oracle does the same),
    so value hashes do not depend on a client's decimal handling."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            cols.append(F.col(f"`{f.name}`").cast("double").alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)
