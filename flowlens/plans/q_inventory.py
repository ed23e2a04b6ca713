"""Catalog: inventory reservations.

The oracle for the sequential fold is a recursive CTE: level ``n`` applies
every product's ``n``-th command to its running ``reserved`` count.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import inventory as I
from flowlens.plans.registry import register
from flowlens.sources import fixtures as fx
from flowlens.sources.fixtures_sql import with_fixtures
from flowlens.streaming import jobs as J

_FOLD = """cmd AS (
  SELECT c.*, i.quantity AS stock_quantity, coalesce(i.reserved_quantity, 0) AS base_reserved,
    row_number() OVER (PARTITION BY c.product_id ORDER BY c.seq) AS rn
  FROM inventory_commands c JOIN inventory i USING (product_id)),
f(product_id, rn, seq, reserved, outcome, available_before) AS (
  SELECT product_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(min(base_reserved) AS BIGINT), CAST(NULL AS VARCHAR),
    CAST(NULL AS BIGINT) FROM cmd GROUP BY product_id
  UNION ALL
  SELECT c.product_id, c.rn, c.seq,
    CASE WHEN c.command = 'RESERVE' THEN CASE WHEN c.stock_quantity - f.reserved >= c.quantity THEN f.reserved + c.quantity
         ELSE f.reserved END ELSE greatest(0, f.reserved - c.quantity) END,
    CASE WHEN c.command = 'RESERVE' THEN CASE WHEN c.stock_quantity - f.reserved >= c.quantity THEN 'RESERVED'
         ELSE 'INSUFFICIENT' END ELSE 'RELEASED' END,
    c.stock_quantity - f.reserved
  FROM f JOIN cmd c ON c.product_id = f.product_id AND c.rn = f.rn + 1)
SELECT c.seq, c.product_id, c.order_id, c.command, c.quantity, f.outcome,
  CAST(f.available_before AS INTEGER) AS available_before, CAST(f.reserved AS INTEGER) AS reserved_after
FROM f JOIN cmd c ON c.product_id = f.product_id AND c.rn = f.rn
UNION ALL SELECT seq, product_id, order_id, command, quantity, 'NOT_FOUND', CAST(NULL AS INTEGER), CAST(NULL AS INTEGER)
FROM inventory_commands WHERE product_id NOT IN (SELECT product_id FROM inventory)"""


def _sql(body: str) -> str:
    from flowlens.sources.fixtures_sql import SQL
    fix = ", ".join(f"{n} AS ({SQL[n]})" for n in ("inventory_commands", "inventory"))
    return f"WITH outcomes AS (WITH RECURSIVE {fix}, {_FOLD}) {body}"


_AFTER = """SELECT i.product_id, i.quantity, coalesce(o.reserved_after, i.reserved_quantity) AS reserved_quantity,
  i.quantity - coalesce(o.reserved_after, i.reserved_quantity) AS available_quantity
FROM ({inv}) i LEFT JOIN (SELECT product_id, arg_max(reserved_after, seq) AS reserved_after FROM outcomes
  WHERE outcome <> 'NOT_FOUND' GROUP BY product_id) o USING (product_id)"""


def _outcomes(spark, sf):
    return I.inventory_reservations(fx.inventory_commands(spark, sf), fx.inventory(spark, sf))


def _inv_sql():
    from flowlens.sources.fixtures_sql import SQL
    return SQL["inventory"]


@register("inventory_reservations", _sql("SELECT * FROM outcomes"))
def q_inventory_reservations(spark, sf):
    """Sequential fold per product (mapInPandas over product-sorted partitions)."""
    return _outcomes(spark, sf)


@register("reserve_against_stock", with_fixtures("""
SELECT c.*, i.quantity AS stock_quantity, i.reserved_quantity, i.quantity IS NOT NULL AS found,
  CASE WHEN i.quantity IS NULL THEN 'Inventory not found' END AS reason
FROM inventory_commands c LEFT JOIN inventory i USING (product_id)""", "inventory_commands", "inventory"))
def q_reserve_against_stock(spark, sf):
    return I.reserve_against_stock(fx.inventory_commands(spark, sf), fx.inventory(spark, sf))


@register("available_stock", with_fixtures("SELECT product_id, quantity - reserved_quantity AS available_quantity FROM inventory",
                                           "inventory"))
def q_available_stock(spark, sf):
    return fx.inventory(spark, sf).select("product_id", I.available_stock().alias("available_quantity"))


@register("inventory_projection", _sql(_AFTER.format(inv=_inv_sql())))
def q_inventory_projection(spark, sf):
    """Stock after all commands."""
    return I.inventory_after(fx.inventory(spark, sf), _outcomes(spark, sf))


@register("inventory_lookup", _sql(f"SELECT * FROM ({_AFTER.format(inv=_inv_sql())}) WHERE product_id = 'PROD-7'"))
def q_inventory_lookup(spark, sf):
    return I.inventory_lookup(I.inventory_after(fx.inventory(spark, sf), _outcomes(spark, sf)), "PROD-7")


@register("inventory_outcome_counts", _sql("SELECT outcome, count(*) AS commands FROM outcomes GROUP BY outcome"))
def q_inventory_outcome_counts(spark, sf):
    return _outcomes(spark, sf).groupBy("outcome").agg(F.count(F.lit(1)).alias("commands"))


@register("stream_inventory", _sql("SELECT seq, product_id, outcome, reserved_after FROM outcomes"))
def q_stream_inventory(spark, sf):
    """ST9: continuous A9 with per-product state (applyInPandasWithState)."""
    return J.stream_inventory(spark, sf)
