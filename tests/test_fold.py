"""Pluggable folds: product statistics, hot and null keys, any split, few states held."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_CHECK, SF_SMALL
from flowlens.operators import stats
from flowlens.operators.fold import Fold, keyed_fold
from flowlens.sources import fixtures as fx
from oracle import compare


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _total(merges=None):
    """Sum of n. Local functions travel by value: workers cannot import this file."""
    def add(state, row):
        return (state[0] + row[0],)

    def merge(a, b):
        if merges is not None:
            merges.add(1)
        return add(a, b)

    return Fold(inputs=("n",), state="total long", result="total long", init=lambda: (0,), step=add, merge=merge,
                finish=lambda key, state: state)


def test_matches_sql(spark):
    r = compare(spark, "folded_order_stats", SF_CHECK, E.queries(), E.oracle_sql())
    assert r["ok"] and r["spark_rows"] > 0, r


@pytest.mark.parametrize("parts, most_keys", [(1, 50_000), (7, 50_000), (5, 2)])
def test_equals_the_aggregate_with_hot_and_empty_keys(spark, parts, most_keys):
    e = fx.order_events(spark, SF_SMALL).withColumn(
        "product_id", F.when(F.col("offset") % 3 == 0, F.lit("PROD-HOT")).when(F.col("offset") % 11 == 0, F.lit(""))
        .otherwise(F.col("product_id")))
    want = stats.product_order_stats(e)
    got = stats.folded_order_stats(e.repartition(parts), most_keys=most_keys)
    assert got.columns == want.columns
    assert _rows(got) == _rows(want)


def test_a_hot_key_sends_one_state_per_split(spark):
    e = spark.range(10_000).select(F.lit("hot").alias("k"), F.col("id").alias("n")).repartition(6)
    merges = spark.sparkContext.accumulator(0)
    assert _rows(keyed_fold(e, "k", _total(merges))) == [("hot", 49_995_000)]
    assert merges.value == 5


def test_null_keys_and_empty_tables(spark):
    e = spark.createDataFrame([(None, 1), ("a", 2), (None, 3)], "k string, n long")
    assert _rows(keyed_fold(e, "k", _total())) == [("a", 2), (None, 4)]
    assert keyed_fold(e.limit(0), "k", _total()).collect() == []
