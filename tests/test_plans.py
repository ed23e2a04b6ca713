"""Physical-plan properties of the catalog (scale guarantees, not results)."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

Q = E.queries()
# Queries that run a stream or write files while being built are covered elsewhere.
SIDE_EFFECTS = {k for k in Q if k.startswith("stream_")} | {"file_source_sink", "exactly_once_fanout",
                                                            "exactly_once_fanout_audit"}


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@pytest.mark.parametrize("key", sorted(k for k in Q if k not in SIDE_EFFECTS))
def test_no_pairwise_joins(spark, key):
    plan = plan_of(Q[key](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_flagship_aggregates_by_hash(spark):
    plan = plan_of(Q["product_order_stats"](spark, SF_SMALL))
    # the pass over the raw events is a hash aggregate; only the small pair table is folded by order
    assert "HashAggregate(keys=[_k" in plan


@pytest.mark.parametrize("key,table,unwanted", [
    ("failed_statistics", "events", ["props", "value", "user_id"]),
    ("top_products", "events", ["props"]),
    ("span_duration_ms", "conversations", ["role"]),
    ("connector_health", "supplier", ["s_name", "s_acctbal"]),
])
def test_scans_are_pruned(spark, key, table, unwanted):
    plan = plan_of(Q[key](spark, SF_SMALL))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and f"/{table}.parquet" in line]
    assert scans, plan
    for line in scans:
        schema = line.split("ReadSchema: ")[-1]
        for col in unwanted:
            assert f"{col}:" not in schema, (col, schema)


def test_global_top_k_is_not_a_global_sort(spark):
    plan = plan_of(Q["top_products"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in plan


def test_messages_of_one_topic_are_dealt_over_tasks(spark):
    """The lookup of a topic's tenant does not gather a hot topic's messages in one task."""
    from pyspark.sql import functions as F

    from flowlens.operators import routing as R
    topic = F.when(F.col("id") % 4 == 0, F.concat(F.lit("tenant-t-"), F.col("id") % 7)).otherwise("order-events")
    m = spark.range(4000).select(topic.alias("topic"), F.lit("K").alias("key"), F.lit(None).cast("string").alias("tenant_header"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = R.extract_tenant(m, spark.createDataFrame([("t",), ("t-3",), ("u",)], "tenant_id STRING"))
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        found = {r[0]: r[1] for r in out.groupBy("tenant_id").count().collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 4000 and max(sizes) < 1000
    assert found == {"t": 1000, None: 3000}
