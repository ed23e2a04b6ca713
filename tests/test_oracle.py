"""Every registered query with an oracle matches DuckDB (rows, columns, values)."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle import compare

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, key):
    r = compare(spark, key, SF_SMALL, QUERIES, ORACLE)
    assert r["ok"], r


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["product_id", "product_name", "total_orders", "total_quantity", "total_revenue",
                          "cancelled_orders"]
