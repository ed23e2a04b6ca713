"""Catalog: order statistics."""

from __future__ import annotations

from flowlens.operators import stats
from flowlens.plans.registry import register
from flowlens.sources import decode, fixtures as fx
from flowlens.sources.fixtures_sql import with_fixtures

_STATS_SQL = """
SELECT product_id,
  CASE WHEN product_id = '' THEN arg_max(product_name, "offset") ELSE arg_min(product_name, "offset") END AS product_name,
  CAST(count_if(event_type IN ('CREATED', 'CONFIRMED')) AS BIGINT) AS total_orders,
  CAST(sum(CASE WHEN event_type IN ('CREATED', 'CONFIRMED') THEN quantity ELSE 0 END) AS BIGINT) AS total_quantity,
  CAST(sum(CASE WHEN event_type IN ('CREATED', 'CONFIRMED') THEN price * quantity
                WHEN event_type IN ('CANCELLED', 'REFUNDED') THEN -(price * quantity) ELSE 0 END) AS DOUBLE) AS total_revenue,
  CAST(count_if(event_type IN ('CANCELLED', 'REFUNDED')) AS BIGINT) AS cancelled_orders
FROM order_events GROUP BY product_id"""

_HOURLY_SQL = """
SELECT date_trunc('hour', "timestamp") AS window_start, date_trunc('hour', "timestamp") + INTERVAL 1 HOUR AS window_end,
  product_id, count(*) AS order_count
FROM order_events GROUP BY ALL"""


def _stats(spark, sf):
    return stats.product_order_stats(fx.order_events(spark, sf))


@register("product_order_stats", with_fixtures("SELECT * FROM stats", "order_events", extra={"stats": _STATS_SQL}))
def q_product_order_stats(spark, sf):
    return _stats(spark, sf)


@register("folded_order_stats", with_fixtures("SELECT * FROM stats", "order_events", extra={"stats": _STATS_SQL}))
def q_folded_order_stats(spark, sf):
    return stats.folded_order_stats(fx.order_events(spark, sf))


@register("all_product_stats", with_fixtures("SELECT * FROM stats", "order_events", extra={"stats": _STATS_SQL}))
def q_all_product_stats(spark, sf):
    return _stats(spark, sf)


@register("product_stats_lookup", with_fixtures("SELECT * FROM stats WHERE product_id = 'PROD-007'", "order_events",
                                                extra={"stats": _STATS_SQL}))
def q_product_stats_lookup(spark, sf):
    return stats.product_stats_lookup(_stats(spark, sf), "PROD-007")


@register("top_products", with_fixtures(
    "SELECT * FROM stats ORDER BY total_revenue DESC, product_id LIMIT 10", "order_events", extra={"stats": _STATS_SQL}))
def q_top_products(spark, sf):
    return stats.top_products(_stats(spark, sf), 10)


@register("hourly_order_count", with_fixtures("SELECT * FROM hourly", "order_events", extra={"hourly": _HOURLY_SQL}))
def q_hourly_order_count(spark, sf):
    return stats.hourly_order_count(fx.order_events(spark, sf))


@register("product_hourly_series", with_fixtures(
    "SELECT * FROM hourly WHERE product_id = 'PROD-007' AND window_start BETWEEN TIMESTAMP '2024-01-05 00:00:00' "
    "AND TIMESTAMP '2024-01-10 00:00:00'", "order_events", extra={"hourly": _HOURLY_SQL}))
def q_product_hourly_series(spark, sf):
    h = stats.hourly_order_count(fx.order_events(spark, sf))
    return stats.product_hourly_series(h, "PROD-007", "2024-01-05 00:00:00", "2024-01-10 00:00:00")


@register("total_amount", with_fixtures(
    "SELECT order_id, price, quantity, CAST(price * quantity AS DOUBLE) AS total_amount FROM order_events",
    "order_events"))
def q_total_amount(spark, sf):
    e = fx.order_events(spark, sf)
    return e.select("order_id", "price", "quantity", stats.total_amount().alias("total_amount"))


@register("scan_order_events", with_fixtures(
    'SELECT topic, "partition", "offset", order_id, product_id, product_name, quantity, price, customer_id, '
    'event_type, "timestamp", CAST(price * quantity AS DOUBLE) AS total_amount FROM order_events', "order_events"))
def q_scan_order_events(spark, sf):
    """The order topic as JSON records, decoded with an explicit schema."""
    raw = decode.encode_order_events(fx.order_events(spark, sf))
    return decode.decode_order_events(raw)
