"""Shared distributed building blocks.

* :func:`top_k_per_group` — k smallest rows per group without ever holding a
  whole group in one task: a first window ranks inside (group, input split),
  so a hot group is spread over as many tasks as it has input splits; only
  k rows per split survive into the final per-group ranking.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import scratch_path


def _cols(cs):
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def top_k_per_group(df: DataFrame, group_cols, order_cols, k: int, rank_col: str | None = None) -> DataFrame:
    """Rows ranked 1..k per group by ``order_cols`` (ties need a unique last key)."""
    g, o = _cols(group_cols), _cols(order_cols)
    split = "__split"
    local = df.withColumn(split, F.spark_partition_id())
    w1 = Window.partitionBy(*g, F.col(split)).orderBy(*o)
    pre = local.withColumn("__r1", F.row_number().over(w1)).filter(F.col("__r1") <= k).drop("__r1", split)
    w2 = Window.partitionBy(*g).orderBy(*o)
    out = pre.withColumn("__rk", F.row_number().over(w2)).filter(F.col("__rk") <= k)
    return out.withColumnRenamed("__rk", rank_col) if rank_col else out.drop("__rk")


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of ``one_row`` — a global aggregate, hence exactly
    one row — to every row of ``df`` as one scalar subquery (the aggregate
    runs once; no join and no row pairs)."""
    packed = one_row.select(F.struct(*[F.col(f"`{c}`") for c in one_row.columns]).alias("_one")).scalar()
    return df.select("*", *[packed[c].alias(c) for c in one_row.columns])


def prefix_scan(df: DataFrame, keys: list[str], order_col: str, specs: list[tuple], block: int = 1 << 20) -> DataFrame:
    """Running aggregates per key in ``order_col`` order, exact and skew-safe.

    ``specs`` = ``[(name, op, value_column, inclusive), ...]`` with ``op`` one
    of ``sum``, ``max``, ``last`` (last non-null value) and ``inclusive``
    False for "strictly before this row". Rows are cut into blocks of
    ``block`` consecutive ``order_col`` values. A window runs inside each
    (key, block); its rows are written once below the checkpoint folder, so
    what feeds the scan (a JSON decode, say) runs once. The block totals of the
    written rows give a prefix over the small block table; its rows that have
    something before them are written and joined back. No task ever holds more than one block of a hot key. Null keys form
    a group of their own.
    """
    d = df.withColumn("_blk", F.floor(F.col(order_col) / F.lit(block)).cast("long"))
    for i, (_, _, val, _) in enumerate(specs):
        d = d.withColumn(f"_v{i}", val)
    w = Window.partitionBy(*keys, "_blk").orderBy(order_col)
    inner = []
    for i, (_, op, _, inclusive) in enumerate(specs):
        frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        v = F.col(f"_v{i}")
        f = {"sum": F.sum(v), "max": F.max(v), "last": F.last(v, ignorenulls=True)}[op]
        inner.append(f.over(frame).alias(f"_i{i}"))
    spark = df.sparkSession
    path = scratch_path(spark, f"prefix-scan-{uuid.uuid4().hex}")
    dw = d.select("*", *inner)
    dw.write.parquet(path)
    dw = spark.read.schema(dw.schema).parquet(path)
    block_aggs, prior_cols = [], []
    wb = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    for i, (_, op, _, _) in enumerate(specs):
        v, b = F.col(f"_v{i}"), F.col(f"_b{i}")
        if op == "sum":
            block_aggs.append(F.sum(v).alias(f"_b{i}"))
            prior_cols.append(F.sum(b).over(wb).alias(f"_p{i}"))
        elif op == "max":
            block_aggs.append(F.max(v).alias(f"_b{i}"))
            prior_cols.append(F.max(b).over(wb).alias(f"_p{i}"))
        elif op == "last":
            block_aggs.append(F.max_by(v, F.when(v.isNotNull(), F.col(order_col))).alias(f"_b{i}"))
            prior_cols.append(F.last(b, ignorenulls=True).over(wb).alias(f"_p{i}"))
        else:
            raise ValueError(op)
    on = [*keys, "_blk"]
    prior = dw.groupBy(*on).agg(*block_aggs).select(*[F.col(k).alias(f"_on_{k}") for k in on], *prior_cols)
    # Blocks with nothing before them need no row. Written, the others have a known size: where keys
    # rarely cross a block they are few, and the rows are not shuffled once more to meet them.
    prior = prior.filter(" OR ".join(f"_p{i} IS NOT NULL" for i in range(len(specs))))
    prior.write.parquet(f"{path}-prior")
    prior = spark.read.schema(prior.schema).parquet(f"{path}-prior")
    j = dw.join(prior, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in on], "left")
    out = []
    for i, (name, op, _, _) in enumerate(specs):
        a, p = F.col(f"_i{i}"), F.col(f"_p{i}")
        if op == "sum":
            out.append(F.when(a.isNull() & p.isNull(), F.lit(None)).otherwise(
                F.coalesce(a, F.lit(0)) + F.coalesce(p, F.lit(0))).alias(name))
        elif op == "max":
            out.append(F.greatest(a, p).alias(name))
        else:
            out.append(F.coalesce(a, p).alias(name))
    return j.select(*df.columns, *out)
