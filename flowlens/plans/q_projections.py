"""Catalog: saga envelope decode, event store, order views, customer stats, saga."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators import projections as P
from flowlens.operators import saga as G
from flowlens.plans.registry import register
from flowlens.sources import decode, fixtures as fx
from flowlens.sources.fixtures_sql import with_fixtures


def _events(spark, sf):
    return decode.decode_saga_envelope(fx.saga_events(spark, sf))


def _store(spark, sf):
    return P.event_store_append(_events(spark, sf))


def _summary(spark, sf):
    return P.order_summary_view(_events(spark, sf))


def _stats(spark, sf):
    return P.customer_order_stats(_events(spark, sf))


def _history(spark, sf):
    return P.order_history_view(_events(spark, sf))


def _sagas(spark, sf):
    return G.saga_state(fx.saga_starts(spark, sf), _events(spark, sf))


# ------------------------------------------------------------------ SQL building blocks
_STORE = """SELECT 'Order' AS aggregate_type, order_id AS aggregate_id, saga_id, event_type, payload, event_ts, "offset",
  row_number() OVER (PARTITION BY order_id ORDER BY "offset") AS version FROM saga_decoded"""

_DESC = """CASE event_type
  WHEN 'ORDER_CREATED' THEN 'Order created with amount ' || CAST(total_amount AS VARCHAR) || ' for ' || quantity || ' items'
  WHEN 'ORDER_CANCELLED' THEN 'Order cancelled: ' || reason
  WHEN 'PAYMENT_COMPLETED' THEN 'Payment of ' || CAST(amount AS VARCHAR) || ' completed (paymentId: ' || payment_id || ')'
  WHEN 'PAYMENT_FAILED' THEN 'Payment failed: ' || reason
  WHEN 'PAYMENT_CANCELLED' THEN 'Payment cancelled: ' || reason
  WHEN 'INVENTORY_RESERVED' THEN 'Inventory reserved: ' || quantity || ' units of ' || product_id
  WHEN 'INVENTORY_FAILED' THEN 'Inventory failed: ' || reason || ' (requested: ' || requested_quantity || ', available: ' || available_quantity || ')'
  WHEN 'INVENTORY_RELEASED' THEN 'Inventory released: ' || quantity || ' units of ' || product_id END"""
_HISTORY = f"""SELECT "offset" || '-0' AS history_id, order_id, saga_id, event_type, payload AS event_data,
  {_DESC} AS description, event_ts AS "timestamp" FROM saga_decoded
UNION ALL SELECT "offset" || '-1', order_id, saga_id, 'ORDER_CONFIRMED', NULL, 'Order confirmed successfully', event_ts
FROM saga_decoded WHERE event_type = 'INVENTORY_RESERVED'"""


def _last(setter, val):
    return f"arg_max(struct_pack(o := \"offset\", v := {val}), \"offset\") FILTER (WHERE {setter})"


_SUMMARY = f"""SELECT order_id, c['saga_id'] AS saga_id, c['customer_id'] AS customer_id, c['product_id'] AS product_id,
  c['quantity'] AS quantity, c['total_amount'] AS total_amount,
  CASE WHEN st['o'] > c['o'] THEN st['v'] ELSE 'PENDING' END AS order_status,
  CASE WHEN pid['o'] > c['o'] THEN pid['v'] END AS payment_id,
  CASE WHEN ps['o'] > c['o'] THEN ps['v'] END AS payment_status,
  CASE WHEN pa['o'] > c['o'] THEN pa['v'] END AS paid_amount,
  CASE WHEN inv['o'] > c['o'] THEN inv['v'] ELSE FALSE END AS inventory_reserved,
  CASE WHEN rs['o'] > c['o'] THEN rs['v'] END AS failure_reason,
  c['created_at'] AS created_at, u AS updated_at,
  CASE WHEN ca['o'] > c['o'] THEN ca['v'] END AS completed_at
FROM (SELECT order_id,
  arg_max(struct_pack(o := "offset", saga_id, customer_id, product_id, quantity, total_amount, created_at := event_ts), "offset")
    FILTER (WHERE event_type = 'ORDER_CREATED') AS c,
  arg_max(event_ts, "offset") AS u,
  {_last("event_type IN ('ORDER_CANCELLED','PAYMENT_FAILED','INVENTORY_RESERVED','INVENTORY_FAILED')",
         "CASE event_type WHEN 'ORDER_CANCELLED' THEN 'CANCELLED' WHEN 'INVENTORY_RESERVED' THEN 'CONFIRMED' ELSE 'FAILED' END")} AS st,
  {_last("event_type IN ('ORDER_CANCELLED','PAYMENT_FAILED','INVENTORY_FAILED')", "reason")} AS rs,
  {_last("event_type IN ('PAYMENT_COMPLETED','PAYMENT_FAILED','PAYMENT_CANCELLED')",
         "CASE event_type WHEN 'PAYMENT_COMPLETED' THEN 'COMPLETED' WHEN 'PAYMENT_FAILED' THEN 'FAILED' ELSE 'CANCELLED' END")} AS ps,
  {_last("event_type = 'PAYMENT_COMPLETED'", "payment_id")} AS pid,
  {_last("event_type = 'PAYMENT_COMPLETED'", "amount")} AS pa,
  {_last("event_type IN ('INVENTORY_RESERVED','INVENTORY_FAILED','INVENTORY_RELEASED')", "event_type = 'INVENTORY_RESERVED'")} AS inv,
  {_last("event_type = 'INVENTORY_RESERVED'", "event_ts")} AS ca
FROM saga_decoded GROUP BY order_id) WHERE c IS NOT NULL"""

_ATTR = """SELECT *, o IS NOT NULL AS applied, o['c'] AS order_customer_id, o['a'] AS order_total_amount, o['q'] AS order_quantity
FROM (SELECT *, last_value(CASE WHEN event_type = 'ORDER_CREATED' THEN struct_pack(c := customer_id, a := total_amount, q := quantity) END IGNORE NULLS)
  OVER (PARTITION BY order_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o FROM saga_decoded)"""
_STATS = """SELECT customer_id, total_orders, completed_orders, cancelled_orders, failed_orders, total_spent, total_quantity, last_order_at FROM (
SELECT CASE WHEN event_type = 'ORDER_CREATED' THEN customer_id ELSE order_customer_id END AS customer_id,
  count_if(event_type = 'ORDER_CREATED') AS total_orders,
  count_if(applied AND event_type = 'INVENTORY_RESERVED') AS completed_orders,
  count_if(applied AND event_type = 'ORDER_CANCELLED') AS cancelled_orders,
  count_if(applied AND event_type IN ('PAYMENT_FAILED', 'INVENTORY_FAILED')) AS failed_orders,
  CAST(coalesce(sum(CASE WHEN applied AND event_type = 'INVENTORY_RESERVED' THEN order_total_amount END), 0) AS DECIMAL(38,2)) AS total_spent,
  CAST(coalesce(sum(CASE WHEN applied AND event_type = 'INVENTORY_RESERVED' THEN order_quantity END), 0) AS BIGINT) AS total_quantity,
  max(CASE WHEN event_type = 'ORDER_CREATED' THEN event_ts END) AS last_order_at
FROM attr WHERE event_type = 'ORDER_CREATED' OR applied GROUP BY 1) WHERE total_orders > 0"""


def _q(body, **extra):
    return with_fixtures(body, "saga_decoded", extra=extra or None)


def _qs(body, **extra):
    return with_fixtures(body, "saga_decoded", "saga_starts", extra=extra or None)


_SUM_COLS = ("order_id, saga_id, customer_id, product_id, quantity, total_amount, order_status, payment_id, payment_status, "
             "paid_amount, inventory_reserved, failure_reason, created_at, updated_at, completed_at")


# ------------------------------------------------------------------ decode + store
@register("decode_saga_envelope", _q("SELECT * FROM saga_decoded"))
def q_decode_saga_envelope(spark, sf):
    return _events(spark, sf)


@register("event_store_append", _q("SELECT * FROM store", store=_STORE))
def q_event_store_append(spark, sf):
    return _store(spark, sf)


@register("event_version", _q('SELECT aggregate_id, "offset", version FROM store', store=_STORE))
def q_event_version(spark, sf):
    return _store(spark, sf).select("aggregate_id", "offset", "version")


@register("event_count_by_aggregate", _q(
    "SELECT aggregate_type, aggregate_id, count(*) AS event_count, max(version) AS max_version FROM store GROUP BY ALL",
    store=_STORE))
def q_event_count_by_aggregate(spark, sf):
    return P.event_count_by_aggregate(_store(spark, sf))


@register("max_version", _q(
    "SELECT aggregate_type, aggregate_id, max(version) AS max_version FROM store GROUP BY ALL", store=_STORE))
def q_max_version(spark, sf):
    return P.event_count_by_aggregate(_store(spark, sf)).drop("event_count")


_PAY_COMPLETED = T.StructType([T.StructField("sagaId", T.StringType()), T.StructField("orderId", T.StringType()),
                               T.StructField("paymentId", T.StringType()), T.StructField("amount", T.DecimalType(19, 2)),
                               T.StructField("timestamp", T.TimestampNTZType())])


@register("replay_events", _q("""
SELECT aggregate_id, version, json_extract_string(payload, '$.sagaId') AS "sagaId",
  json_extract_string(payload, '$.orderId') AS "orderId", json_extract_string(payload, '$.paymentId') AS "paymentId",
  CAST(json_extract_string(payload, '$.amount') AS DECIMAL(19,2)) AS amount,
  CAST(json_extract_string(payload, '$.timestamp') AS TIMESTAMP) AS "timestamp"
FROM store WHERE json_extract_string(payload, '$.sagaId') IS NOT NULL AND json_extract_string(payload, '$.orderId') IS NOT NULL
  AND json_extract_string(payload, '$.paymentId') IS NOT NULL AND json_extract_string(payload, '$.amount') IS NOT NULL""",
                               store=_STORE))
def q_replay_events(spark, sf):
    return P.replay_events(_store(spark, sf), _PAY_COMPLETED, ["sagaId", "orderId", "paymentId", "amount"])


_STORE_COLS = 'aggregate_type, aggregate_id, saga_id, event_type, payload, event_ts, "offset", version'


@register("events_by_type", _q(f"SELECT {_STORE_COLS} FROM store WHERE event_type = 'PAYMENT_FAILED'", store=_STORE))
def q_events_by_type(spark, sf):
    return P.events_by(_store(spark, sf), event_type="PAYMENT_FAILED")


@register("events_from_version", _q(f"SELECT {_STORE_COLS} FROM store WHERE version > 2", store=_STORE))
def q_events_from_version(spark, sf):
    return P.events_by(_store(spark, sf), from_version=2)


@register("events_by_saga", _q(f"SELECT {_STORE_COLS} FROM store WHERE saga_id = 'saga-6'", store=_STORE))
def q_events_by_saga(spark, sf):
    return P.events_by(_store(spark, sf), saga_id="saga-6")


@register("events_by_aggregate", _q(f"SELECT {_STORE_COLS} FROM store WHERE aggregate_type = 'Order' AND aggregate_id = 'ORD-16'",
                                    store=_STORE))
def q_events_by_aggregate(spark, sf):
    return P.events_by(_store(spark, sf), aggregate=("Order", "ORD-16"))


@register("event_projection", _q('SELECT aggregate_id, aggregate_type, saga_id, event_type, version, event_ts AS "timestamp", '
                                 "payload FROM store", store=_STORE))
def q_event_projection(spark, sf):
    return P.event_projection(_store(spark, sf))


# ------------------------------------------------------------------ history
@register("order_history_view", _q("SELECT * FROM hist", hist=_HISTORY))
def q_order_history_view(spark, sf):
    return _history(spark, sf)


@register("history_description", _q(f'SELECT "offset", {_DESC} AS description FROM saga_decoded'))
def q_history_description(spark, sf):
    return _events(spark, sf).select("offset", P.history_description().alias("description"))


@register("history_projection", _q('SELECT history_id, order_id, event_type, description, "timestamp" FROM hist', hist=_HISTORY))
def q_history_projection(spark, sf):
    return P.history_projection(_history(spark, sf))


@register("history_detail_projection", _q(
    'SELECT history_id, order_id, event_type, description, "timestamp", event_data FROM hist', hist=_HISTORY))
def q_history_detail_projection(spark, sf):
    return P.history_projection(_history(spark, sf), detail=True)


@register("order_history", _q("SELECT * FROM hist WHERE order_id = 'ORD-26'", hist=_HISTORY))
def q_order_history(spark, sf):
    return P.order_history(_history(spark, sf), "ORD-26")


@register("history_count_by_order", _q("SELECT order_id, count(*) AS history_count FROM hist GROUP BY order_id", hist=_HISTORY))
def q_history_count_by_order(spark, sf):
    return _history(spark, sf).groupBy("order_id").agg(F.count(F.lit(1)).alias("history_count"))


# ------------------------------------------------------------------ summary
def _sq(body):
    return _q(body, summ=_SUMMARY)


@register("order_summary_view", _sq("SELECT * FROM summ"))
def q_order_summary_view(spark, sf):
    return _summary(spark, sf)


@register("apply_events_to_orders", _q('SELECT "offset", order_id, event_type, applied FROM attr', attr=_ATTR))
def q_apply_events_to_orders(spark, sf):
    return P.attribute_to_order(_events(spark, sf)).select("offset", "order_id", "event_type", "applied")


@register("order_summary_projection", _sq("""
SELECT order_id, saga_id, customer_id, product_id, quantity, total_amount, coalesce(order_status, 'UNKNOWN') AS status,
  payment_id IS NOT NULL AS has_payment_info, CASE WHEN payment_id IS NOT NULL THEN payment_id END AS payment_info_id,
  CASE WHEN payment_id IS NOT NULL THEN coalesce(payment_status, 'UNKNOWN') END AS payment_info_status,
  CASE WHEN payment_id IS NOT NULL THEN paid_amount END AS payment_info_amount,
  inventory_reserved, failure_reason, created_at, updated_at, completed_at FROM summ"""))
def q_order_summary_projection(spark, sf):
    p = P.order_summary_projection(_summary(spark, sf))
    return p.select(*[c for c in p.columns if c != "payment_info"],
                    F.col("payment_info").isNotNull().alias("has_payment_info"),
                    F.col("payment_info.payment_id").alias("payment_info_id"),
                    F.col("payment_info.status").alias("payment_info_status"),
                    F.col("payment_info.amount").alias("payment_info_amount"))


@register("search_orders", _sq(f"SELECT {_SUM_COLS} FROM summ WHERE order_status = 'CANCELLED' "
                               "AND created_at >= TIMESTAMP '1996-01-01 00:00:00' AND created_at <= TIMESTAMP '1997-12-31 00:00:00'"))
def q_search_orders(spark, sf):
    return P.search_orders(_summary(spark, sf), status="CANCELLED", created_from="1996-01-01 00:00:00",
                           created_to="1997-12-31 00:00:00")


@register("orders_by_customer", _sq(f"SELECT {_SUM_COLS} FROM summ WHERE customer_id = 'CUST-100'"))
def q_orders_by_customer(spark, sf):
    return P.search_orders(_summary(spark, sf), customer_id="CUST-100")


@register("orders_by_status", _sq(f"SELECT {_SUM_COLS} FROM summ WHERE order_status = 'CANCELLED'"))
def q_orders_by_status(spark, sf):
    return P.search_orders(_summary(spark, sf), status="CANCELLED")


@register("orders_by_customer_status", _sq(f"SELECT {_SUM_COLS} FROM summ WHERE customer_id = 'CUST-100' AND order_status = 'CONFIRMED'"))
def q_orders_by_customer_status(spark, sf):
    return P.search_orders(_summary(spark, sf), customer_id="CUST-100", status="CONFIRMED")


@register("orders_by_date_range", _sq(f"SELECT {_SUM_COLS} FROM summ WHERE created_at BETWEEN TIMESTAMP '1998-01-01 00:00:00' "
                                      "AND TIMESTAMP '1998-03-01 00:00:00'"))
def q_orders_by_date_range(spark, sf):
    return P.search_orders(_summary(spark, sf), created_from="1998-01-01 00:00:00", created_to="1998-03-01 00:00:00")


@register("orders_by_status_date_range", _sq(
    f"SELECT {_SUM_COLS} FROM summ WHERE order_status = 'PENDING' AND created_at BETWEEN TIMESTAMP '1998-01-01 00:00:00' "
    "AND TIMESTAMP '1999-01-01 00:00:00'"))
def q_orders_by_status_date_range(spark, sf):
    return P.search_orders(_summary(spark, sf), status="PENDING", created_from="1998-01-01 00:00:00",
                           created_to="1999-01-01 00:00:00")


@register("order_lookup", _sq(f"SELECT {_SUM_COLS} FROM summ WHERE order_id = 'ORD-42'"))
def q_order_lookup(spark, sf):
    return _summary(spark, sf).filter(F.col("order_id") == "ORD-42")


@register("order_by_saga", _sq(f"SELECT {_SUM_COLS} FROM summ WHERE saga_id = 'saga-45'"))
def q_order_by_saga(spark, sf):
    return _summary(spark, sf).filter(F.col("saga_id") == "saga-45")


@register("order_counts", _sq("SELECT order_status, count(*) AS order_count FROM summ GROUP BY order_status"))
def q_order_counts(spark, sf):
    return P.order_counts(_summary(spark, sf), "order_status")


@register("order_counts_by_customer", _sq("SELECT customer_id, count(*) AS order_count FROM summ GROUP BY customer_id"))
def q_order_counts_by_customer(spark, sf):
    return P.order_counts(_summary(spark, sf), "customer_id")


@register("paged", _sq(f"""
SELECT * FROM (SELECT {_SUM_COLS}, count(*) OVER () AS total_elements,
  CAST(ceil(count(*) OVER () / 20) AS BIGINT) AS total_pages FROM summ)
ORDER BY total_amount DESC, order_id LIMIT 20 OFFSET 40"""))
def q_paged(spark, sf):
    from flowlens.operators.paging import paged
    return paged(_summary(spark, sf), page=2, size=20, sort_col="total_amount", descending=True, key="order_id")


# ------------------------------------------------------------------ customer stats
def _cq(body):
    return _q(body, attr=_ATTR, stats=_STATS)


@register("customer_order_stats", _cq("SELECT * FROM stats"))
def q_customer_order_stats(spark, sf):
    return _stats(spark, sf)


@register("customer_stats_projection", _cq("""
SELECT *, CASE WHEN completed_orders > 0
    THEN ((CAST(total_spent * 100 AS HUGEINT) * 2 + completed_orders) // (2 * completed_orders)) / 100.0 ELSE 0.0 END AS average_order_value,
  CASE WHEN total_orders > 0 THEN completed_orders / total_orders * 100 ELSE 0.0 END AS success_rate FROM stats"""))
def q_customer_stats_projection(spark, sf):
    return P.customer_stats_projection(_stats(spark, sf))


@register("active_customers", _cq("SELECT * FROM stats WHERE last_order_at >= TIMESTAMP '2001-01-01 00:00:00'"))
def q_active_customers(spark, sf):
    return P.active_customers(_stats(spark, sf), "2001-01-01 00:00:00")


@register("top_customers_by_spending", _cq("SELECT * FROM stats ORDER BY total_spent DESC, customer_id LIMIT 10"))
def q_top_customers_by_spending(spark, sf):
    return P.top_customers(_stats(spark, sf), "total_spent", 10)


@register("top_customers_by_orders", _cq("SELECT * FROM stats ORDER BY total_orders DESC, customer_id LIMIT 10"))
def q_top_customers_by_orders(spark, sf):
    return P.top_customers(_stats(spark, sf), "total_orders", 10)


@register("orders_to_customer_stats", _q(
    "SELECT s.customer_id, order_id, order_status, total_amount, total_orders, total_spent FROM summ s JOIN stats c USING (customer_id)",
    summ=_SUMMARY, attr=_ATTR, stats=_STATS))
def q_orders_to_customer_stats(spark, sf):
    return P.orders_to_customer_stats(_summary(spark, sf), _stats(spark, sf))


# ------------------------------------------------------------------ saga
_PREFIX = """SELECT *, least(adv_before + 1, 4) AS step_at,
  CASE WHEN event_type = 'ORDER_CREATED' THEN 'PAYMENT_PENDING' WHEN event_type = 'ORDER_CANCELLED' THEN 'COMPENSATED'
       WHEN event_type = 'PAYMENT_COMPLETED' THEN 'INVENTORY_PENDING' WHEN event_type = 'INVENTORY_RESERVED' THEN 'COMPLETED'
       WHEN event_type IN ('PAYMENT_FAILED', 'INVENTORY_FAILED') THEN CASE WHEN least(adv_before + 1, 4) >= 2 THEN 'COMPENSATING' ELSE 'FAILED' END
  END AS status_set,
  CASE WHEN event_type IN ('ORDER_CANCELLED', 'INVENTORY_RESERVED')
         OR (event_type IN ('PAYMENT_FAILED', 'INVENTORY_FAILED') AND least(adv_before + 1, 4) < 2) THEN event_ts END AS done_ts
FROM (SELECT *,
  coalesce(sum(adv) OVER wb, 0) AS adv_before,
  last_value(CASE WHEN event_type = 'PAYMENT_COMPLETED' THEN payment_id END IGNORE NULLS) OVER wb AS pay_before,
  last_value(CASE WHEN event_type IN ('PAYMENT_FAILED', 'INVENTORY_FAILED') THEN reason END IGNORE NULLS) OVER wb AS reason_before,
  sum(adv) OVER wu AS adv_after,
  last_value(CASE WHEN event_type = 'PAYMENT_COMPLETED' THEN payment_id END IGNORE NULLS) OVER wu AS pay_after,
  last_value(CASE WHEN event_type IN ('PAYMENT_FAILED', 'INVENTORY_FAILED') THEN reason END IGNORE NULLS) OVER wu AS reason_after
  FROM (SELECT *, CASE WHEN event_type IN ('ORDER_CREATED', 'PAYMENT_COMPLETED') THEN 1 ELSE 0 END AS adv
        FROM saga_decoded WHERE saga_id IN (SELECT saga_id FROM saga_starts))
  WINDOW wb AS (PARTITION BY saga_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         wu AS (PARTITION BY saga_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_SAGA = """SELECT s.saga_id, order_id, customer_id, product_id, quantity, total_amount, coalesce(l.st, s.status) AS status,
  coalesce(CASE (CASE WHEN l.adv IS NULL THEN NULL ELSE least(l.adv + 1, 4) END) WHEN 1 THEN 'CREATE_ORDER' WHEN 2 THEN 'PROCESS_PAYMENT' WHEN 3 THEN 'RESERVE_INVENTORY'
           WHEN 4 THEN 'COMPLETE_SAGA' END, s.current_step) AS current_step,
  l.pay AS payment_id, l.reason AS failure_reason, created_at, coalesce(l.upd, created_at) AS updated_at, l.done AS completed_at
FROM saga_starts s LEFT JOIN (
  SELECT saga_id, arg_max(adv_after, "offset") AS adv, arg_max(struct_pack(p := pay_after), "offset")['p'] AS pay,
    arg_max(struct_pack(r := reason_after), "offset")['r'] AS reason,
    arg_max(status_set, "offset") FILTER (WHERE status_set IS NOT NULL) AS st,
    arg_max(done_ts, "offset") FILTER (WHERE done_ts IS NOT NULL) AS done, max(event_ts) AS upd
  FROM pre GROUP BY saga_id) l USING (saga_id)"""
_SAGA_COLS = ("saga_id, order_id, customer_id, product_id, quantity, total_amount, status, current_step, payment_id, "
              "failure_reason, created_at, updated_at, completed_at")


def _gq(body, **more):
    return _qs(body, pre=_PREFIX, sagas=_SAGA, **more)


@register("saga_state", _gq("SELECT * FROM sagas"))
def q_saga_state(spark, sf):
    return _sagas(spark, sf)


@register("saga_command_log", _gq("""
SELECT saga_id, CAST(0 AS BIGINT) AS seq, 'CREATE_ORDER' AS command, CAST(NULL AS VARCHAR) AS payment_id, CAST(NULL AS VARCHAR) AS reason
FROM saga_starts
UNION ALL SELECT * FROM (SELECT saga_id, "offset" AS seq,
  CASE WHEN event_type = 'ORDER_CREATED' THEN 'PROCESS_PAYMENT' WHEN event_type = 'PAYMENT_COMPLETED' THEN 'RESERVE_INVENTORY'
       WHEN event_type IN ('PAYMENT_FAILED','INVENTORY_FAILED') AND step_at >= 3 AND pay_before IS NOT NULL THEN 'CANCEL_PAYMENT'
       WHEN event_type IN ('PAYMENT_FAILED','INVENTORY_FAILED') AND step_at >= 2 THEN 'CANCEL_ORDER'
       WHEN event_type = 'PAYMENT_CANCELLED' THEN 'CANCEL_ORDER'
       WHEN event_type = 'INVENTORY_RELEASED' THEN CASE WHEN pay_before IS NOT NULL THEN 'CANCEL_PAYMENT' ELSE 'CANCEL_ORDER' END END AS command,
  NULL AS payment_id,
  CASE WHEN event_type IN ('PAYMENT_FAILED','INVENTORY_FAILED','PAYMENT_CANCELLED') THEN reason
       WHEN event_type = 'INVENTORY_RELEASED' THEN coalesce(reason_before, 'Compensation') END AS reason, pay_before
  FROM pre) x(saga_id, seq, command, payment_id, reason, pay_before) WHERE command IS NOT NULL
""".replace("UNION ALL SELECT * FROM", "UNION ALL SELECT saga_id, seq, command, CASE WHEN command = 'CANCEL_PAYMENT' THEN pay_before END, reason FROM")))
def q_saga_command_log(spark, sf):
    return G.saga_command_log(fx.saga_starts(spark, sf), _events(spark, sf))


@register("compensation_chain", _gq("""
SELECT saga_id, current_step, status, pos, compensation FROM sagas JOIN (VALUES ('PROCESS_PAYMENT', 1, 'CANCEL_ORDER'),
  ('RESERVE_INVENTORY', 1, 'CANCEL_PAYMENT')) c(current_step, pos, compensation) USING (current_step)
WHERE status IN ('COMPENSATING', 'COMPENSATED', 'FAILED')"""))
def q_compensation_chain(spark, sf):
    return G.compensation_chain(spark, _sagas(spark, sf))


@register("sagas_by_status", _gq(f"SELECT {_SAGA_COLS} FROM sagas WHERE status = 'COMPENSATED'"))
def q_sagas_by_status(spark, sf):
    return G.sagas_by(_sagas(spark, sf), status="COMPENSATED")


@register("sagas_by_statuses", _gq(f"SELECT {_SAGA_COLS} FROM sagas WHERE status IN ('PAYMENT_PENDING', 'INVENTORY_PENDING')"))
def q_sagas_by_statuses(spark, sf):
    return G.sagas_by(_sagas(spark, sf), statuses=["PAYMENT_PENDING", "INVENTORY_PENDING"])


@register("saga_by_order", _gq(f"SELECT {_SAGA_COLS} FROM sagas WHERE order_id = 'ORD-46'"))
def q_saga_by_order(spark, sf):
    return G.sagas_by(_sagas(spark, sf), order_id="ORD-46")


@register("saga_projection", _gq("SELECT saga_id, order_id, status, current_step, payment_id, failure_reason, created_at, "
                                 "updated_at, completed_at FROM sagas"))
def q_saga_projection(spark, sf):
    return G.saga_projection(_sagas(spark, sf))


@register("events_with_known_saga", _qs("SELECT * FROM saga_decoded WHERE saga_id IN (SELECT saga_id FROM saga_starts)"))
def q_events_with_known_saga(spark, sf):
    return G.events_with_known_saga(_events(spark, sf), fx.saga_starts(spark, sf))


@register("average_order_value", _cq("""
SELECT customer_id, CASE WHEN completed_orders > 0
    THEN ((CAST(total_spent * 100 AS HUGEINT) * 2 + completed_orders) // (2 * completed_orders)) / 100.0 ELSE 0.0 END
  AS average_order_value FROM stats"""))
def q_average_order_value(spark, sf):
    return _stats(spark, sf).select("customer_id", P.average_order_value().alias("average_order_value"))


@register("success_rate", _cq("SELECT customer_id, CASE WHEN total_orders > 0 THEN completed_orders / total_orders * 100 "
                              "ELSE 0.0 END AS success_rate FROM stats"))
def q_success_rate(spark, sf):
    return _stats(spark, sf).select("customer_id", P.success_rate().alias("success_rate"))
