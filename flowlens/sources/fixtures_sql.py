"""SQL twins of :mod:`flowlens.sources.fixtures` for the DuckDB oracle.

``with_fixtures(body, "order_events", ...)`` prefixes a query with the CTEs it
needs (dependencies are pulled in automatically, in order).
"""

from __future__ import annotations

from flowlens.sources.fixtures import DLT_ERROR_MESSAGES, SAGA_SCENARIOS


def lit(v) -> str:
    """SQL literal for a Python value (newlines via chr(10))."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    parts = str(v).replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in parts)


def _json_str(expr: str) -> str:
    # '"' || replace(replace(x, '\', '\\'), '"', '\"') || '"'
    return ("('\"' || replace(replace(" + expr + ", '\\', '\\\\'), '\"', '\\\"') || '\"')")


def _iso(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S')"


_SCEN_VALUES = ", ".join(f"({k}, {s}, {lit(t)}, {lit(r)})" for k, s, t, r in SAGA_SCENARIOS)

SQL: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}

SQL["order_events"] = """
SELECT 'order-events' AS topic, CAST(user_id % 3 AS INTEGER) AS "partition", event_id AS "offset",
  'ORD-' || event_id AS order_id,
  'PROD-' || lpad(CAST(user_id % 25 AS VARCHAR), 3, '0') AS product_id,
  'Product ' || (user_id % 25) || CASE WHEN event_id % 7 = 0 THEN ' v2' ELSE '' END AS product_name,
  CAST(1 + event_id % 5 AS INTEGER) AS quantity,
  CAST(value AS DECIMAL(19,2)) AS price,
  'CUST-' || user_id AS customer_id,
  CASE WHEN event_type IN ('signup', 'view') THEN 'CREATED' WHEN event_type = 'purchase' THEN 'CONFIRMED'
       WHEN event_type = 'click' THEN 'CANCELLED' WHEN event_type = 'error' THEN 'REFUNDED' END AS event_type,
  ts AS "timestamp",
  CASE WHEN event_id % 50 = 0 THEN ts - INTERVAL 3 HOUR ELSE ts END AS late_timestamp
FROM events"""

SQL["saga_base"] = """
SELECT o_orderkey, CAST(o_orderkey % 10 AS INTEGER) AS k, 'saga-' || o_orderkey AS saga_id,
  'ORD-' || o_orderkey AS order_id, 'CUST-' || o_custkey AS customer_id,
  'PROD-' || (o_orderkey % 200) AS product_id, CAST(o_orderkey % 5 + 1 AS INTEGER) AS quantity,
  CAST(o_totalprice AS DECIMAL(19,2)) AS total_amount, 'PAY-' || o_orderkey AS payment_id, o_orderdate
FROM orders"""

_head = "'{\"sagaId\":\"' || saga_id || '\",\"orderId\":\"' || order_id || '\"'"
_tail = "',\"timestamp\":\"' || " + _iso("o_orderdate + to_minutes(CAST(seq AS BIGINT))") + " || '\"}'"
_qty, _amt = "CAST(quantity AS VARCHAR)", "CAST(total_amount AS VARCHAR)"
_created = (f"{_head} || ',\"customerId\":\"' || customer_id || '\",\"productId\":\"' || product_id || "
            f"'\",\"quantity\":' || {_qty} || ',\"totalAmount\":' || {_amt} || {_tail}")
_mid = f"""CASE
  WHEN sc_type = 'ORDER_CREATED' THEN ',"customerId":"' || customer_id || '","productId":"' || product_id || '","quantity":' || {_qty} || ',"totalAmount":' || {_amt}
  WHEN sc_type IN ('ORDER_CANCELLED', 'PAYMENT_FAILED') THEN ',"reason":' || {_json_str('reason')}
  WHEN sc_type = 'PAYMENT_COMPLETED' THEN ',"paymentId":"' || payment_id || '","amount":' || {_amt}
  WHEN sc_type = 'PAYMENT_CANCELLED' THEN ',"paymentId":"' || payment_id || '","reason":' || {_json_str('reason')}
  WHEN sc_type = 'INVENTORY_FAILED' THEN ',"productId":"' || product_id || '","requestedQuantity":' || {_qty} || ',"availableQuantity":0,"reason":' || {_json_str('reason')}
  ELSE ',"productId":"' || product_id || '","quantity":' || {_qty} END"""
_payload = f"({_head} || {_mid} || {_tail})"
_bad = "((o_orderkey // 10) % 4)"
SQL["saga_events"] = f"""
SELECT o_orderkey * 10 + seq AS "offset",
  CASE WHEN sc_type = 'MALFORMED' THEN
    CASE WHEN {_bad} = 0 THEN '{{"eventType":"ORDER_SHIPPED","payload":' || {_json_str(_created)} || '}}'
         WHEN {_bad} = 1 THEN '{{"payload":' || {_json_str(_created)} || '}}'
         WHEN {_bad} = 2 THEN '{{"eventType":"ORDER_CREATED"}}'
         ELSE '{{"eventType":"ORDER_CREATED","payload":' || {_created} || '}}' END
  ELSE '{{"eventType":"' || sc_type || '","payload":' || {_json_str(_payload)} || '}}' END AS value
FROM saga_base JOIN (VALUES {_SCEN_VALUES}) AS sc(k, seq, sc_type, reason) USING (k)"""
DEPS["saga_events"] = ["saga_base"]

SQL["saga_starts"] = """
SELECT saga_id, order_id, customer_id, product_id, quantity, total_amount,
  'ORDER_PENDING' AS status, 'CREATE_ORDER' AS current_step, o_orderdate AS created_at
FROM saga_base WHERE k <> 9"""
DEPS["saga_starts"] = ["saga_base"]

_msg_case = "CASE event_id % 8 " + " ".join(
    f"WHEN {i} THEN {lit(m)}" for i, m in enumerate(DLT_ERROR_MESSAGES)) + " END"
SQL["failed_messages"] = f"""
SELECT event_id + 1 AS id, event_type || '-topic' AS original_topic,
  CAST(event_id % 3 AS INTEGER) AS partition_id, event_id AS offset_id,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'key-' || user_id END AS message_key,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE props END AS message_value,
  CAST({_msg_case} AS VARCHAR) AS error_message,
  CASE WHEN (event_id // 8) % 10 <= 5 THEN 'PENDING' WHEN (event_id // 8) % 10 <= 7 THEN 'RETRIED'
       WHEN (event_id // 8) % 10 = 8 THEN 'RESOLVED' ELSE 'IGNORED' END AS status,
  ts AS created_at,
  CASE WHEN (event_id // 8) % 10 <= 5 THEN NULL ELSE ts + INTERVAL 1 HOUR END AS resolved_at,
  CAST(event_id % 6 AS INTEGER) AS retry_count
FROM events"""


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        for d in DEPS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def with_fixtures(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH <fixtures>, <extra ctes> <body>``."""
    ctes = [f"{n} AS ({SQL[n]})" for n in _order(names)]
    ctes += [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body


def _iso_us(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S.%fZ')"


_UPD = "',\"updatedAt\":\"' || " + _iso_us("ts") + " || '\"}'"
SQL["state_changelog"] = f"""
SELECT CASE event_id % 4 WHEN 0 THEN 'user-state' WHEN 1 THEN 'product-state' WHEN 2 THEN 'inventory-state'
         ELSE 'config-state' END AS topic,
  CAST(user_id % 6 AS INTEGER) AS "partition", event_id AS "offset", 'K-' || user_id AS key,
  CASE WHEN event_type = 'error' THEN NULL
       WHEN event_id % 4 = 0 THEN '{{"userId":"K-' || user_id || '","email":"K-' || user_id || '@example.com","name":"User ' || user_id || '","status":"ACTIVE","tier":"BASIC"' || {_UPD}
       WHEN event_id % 4 = 1 THEN '{{"productId":"K-' || user_id || '","name":"Product ' || user_id || '","price":' || CAST(CAST(value AS DECIMAL(19,2)) AS VARCHAR) || ',"category":"general","status":"AVAILABLE"' || {_UPD}
       WHEN event_id % 4 = 2 THEN '{{"productId":"K-' || user_id || '","totalQuantity":100,"availableQuantity":' || CAST(event_id % 30 - 2 AS VARCHAR) || ',"reservedQuantity":0,"reorderPoint":10,"reorderQuantity":100' || {_UPD}
       ELSE '{{"configKey":"K-' || user_id || '","configValue":"' || event_id || '","valueType":"NUMBER","category":"general","isEncrypted":false' || {_UPD} END AS value,
  ts AS "timestamp"
FROM events"""

SQL["ttl_states"] = """
SELECT CASE WHEN event_id % 2 = 0 THEN 'session-state' ELSE 'cache-state' END AS topic, 'K-' || user_id AS key,
  event_id AS "offset", ts AS created_at,
  CASE WHEN event_id % 2 = 1 AND event_id % 5 = 0 THEN NULL ELSE ts + to_hours(CAST(event_id % 72 AS BIGINT)) END AS expires_at
FROM events"""

_AMT = "CAST(CAST(value AS DECIMAL(19,2)) AS VARCHAR)"
SQL["deliveries"] = f"""
SELECT 'order-events' AS topic, CAST(user_id % 3 AS INTEGER) AS "partition",
  event_id * 2 + CASE WHEN delivery = 2 THEN 1 ELSE 0 END AS "offset", CAST(delivery AS INTEGER) AS delivery,
  'key-' || user_id AS key,
  CASE WHEN event_id % 23 = 0 THEN '  ' WHEN event_id % 19 = 0 THEN 'not json ' || event_id
       WHEN event_id % 17 = 0 THEN '{{"note":"n/a","amount":' || {_AMT} || '}}'
       WHEN event_id % 3 = 0 THEN '{{"orderId":"ORD-' || event_id || '","amount":' || {_AMT} || '}}'
       WHEN event_id % 3 = 1 THEN '{{"paymentId":"PAY-' || event_id || '","amount":' || {_AMT} || '}}'
       ELSE '{{"eventId":"EVT-' || event_id || '","amount":' || {_AMT} || '}}' END AS value,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'msg-' || event_id END AS message_id_hdr,
  ts AS processed_at, ts + INTERVAL 7 DAY AS expired_at
FROM events, (VALUES (0), (1), (2)) d(delivery)
WHERE delivery = 0 OR (delivery = 1 AND event_id % 4 = 0) OR (delivery = 2 AND event_id % 5 = 0)"""

_SAGA_TYPES = ", ".join(f"'{t}'" for t in
                        ["ORDER_CREATED", "ORDER_CANCELLED", "PAYMENT_COMPLETED", "PAYMENT_FAILED",
                         "PAYMENT_CANCELLED", "INVENTORY_RESERVED", "INVENTORY_FAILED", "INVENTORY_RELEASED"])
SQL["saga_decoded"] = f"""
SELECT "offset", event_type,
  json_extract_string(payload, '$.sagaId') AS saga_id, json_extract_string(payload, '$.orderId') AS order_id,
  json_extract_string(payload, '$.customerId') AS customer_id, json_extract_string(payload, '$.productId') AS product_id,
  CAST(json_extract_string(payload, '$.quantity') AS INTEGER) AS quantity,
  CAST(json_extract_string(payload, '$.totalAmount') AS DECIMAL(19,2)) AS total_amount,
  json_extract_string(payload, '$.paymentId') AS payment_id,
  CAST(json_extract_string(payload, '$.amount') AS DECIMAL(19,2)) AS amount,
  json_extract_string(payload, '$.reason') AS reason,
  CAST(json_extract_string(payload, '$.requestedQuantity') AS INTEGER) AS requested_quantity,
  CAST(json_extract_string(payload, '$.availableQuantity') AS INTEGER) AS available_quantity,
  CAST(json_extract_string(payload, '$.timestamp') AS TIMESTAMP) AS event_ts, payload
FROM (SELECT "offset",
        CASE WHEN json_type(value, '$.eventType') = 'VARCHAR' THEN json_extract_string(value, '$.eventType') END AS event_type,
        CASE WHEN json_type(value, '$.payload') = 'VARCHAR' THEN json_extract_string(value, '$.payload') END AS payload
      FROM saga_events WHERE json_valid(value))
WHERE payload IS NOT NULL AND event_type IN ({_SAGA_TYPES})"""
DEPS["saga_decoded"] = ["saga_events"]

SQL["offset_snapshots"] = """
SELECT event_id AS snapshot_id, 'group-' || (user_id % 20) AS group_id, 'order-events' AS topic,
  p AS "partition", ts, event_id * 10 + p AS current_offset,
  event_id * 10 + p + ((event_id + p * 31) * 7919) % 15000 - 100 AS end_offset
FROM events, (SELECT unnest([0, 1, 2])::INTEGER AS p)"""

SQL["activity_log"] = """
SELECT event_type || '-topic' AS topic, CAST(user_id % 6 AS INTEGER) AS "partition", event_id AS "offset",
  'K-' || user_id AS key, ts AS record_ts, ts + to_milliseconds((event_id * 37) % 9000) AS consumed_ts,
  event_id % 50 AS processing_ms,
  CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_id % 40 = 7 THEN 'PENDING' ELSE 'PROCESSED' END AS outcome,
  CASE WHEN event_type = 'error' THEN 'processing failed at offset ' || event_id END AS error,
  event_id % 2 = 0 AS sent, event_id % 2 = 0 AND event_id % 3 = 0 AS acked, event_id % 5 = 0 AS committed
FROM events"""

SQL["rebalance_log"] = """
SELECT event_id AS rebalance_id,
  CASE event_id % 4 WHEN 0 THEN 'REVOCATION' WHEN 1 THEN 'ASSIGNMENT' WHEN 2 THEN 'LOST' ELSE 'ERROR' END AS event_type,
  CAST(CASE WHEN event_id % 4 = 3 THEN 0 ELSE event_id % 7 END AS INTEGER) AS partition_count, ts FROM events"""


def _hexid(expr: str, width: int) -> str:
    return f"lpad(lower(hex({expr})), {width}, '0')"


SQL["spans"] = f"""
SELECT {_hexid('conv_id + 1', 32)} AS trace_id, {_hexid('conv_id * 100 + turn + 1', 16)} AS span_id,
  CASE WHEN turn > 0 THEN {_hexid('conv_id * 100 + turn', 16)}
       WHEN conv_id % 10 = 0 THEN {_hexid('9000000000 + conv_id', 16)} END AS parent_span_id,
  role || '-' || turn AS name,
  CASE turn % 5 WHEN 0 THEN 'INTERNAL' WHEN 1 THEN 'SERVER' WHEN 2 THEN 'CLIENT' WHEN 3 THEN 'PRODUCER' ELSE 'CONSUMER' END AS kind,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id) + to_seconds(turn) AS started_at,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id) + to_seconds(turn) + to_milliseconds(length(text) % 900) AS ended_at,
  CASE WHEN (conv_id + turn) % 17 = 0 THEN 'ERROR' ELSE 'OK' END AS status
FROM conversations"""

SQL["traceparents"] = """
SELECT trace_id, span_id, CASE n WHEN 0 THEN NULL WHEN 1 THEN ' '
  WHEN 2 THEN '00-' || trace_id || '-' || span_id WHEN 3 THEN '01-' || trace_id || '-' || span_id || '-01'
  WHEN 4 THEN '00-' || substr(trace_id, 1, 16) || '-' || span_id || '-01'
  WHEN 5 THEN '00-' || repeat('0', 32) || '-' || span_id || '-01'
  WHEN 6 THEN '00-' || trace_id || '-' || span_id || '-00' ELSE '00-' || trace_id || '-' || span_id || '-01' END AS traceparent
FROM (SELECT *, CAST(('0x' || span_id) AS BIGINT) % 9 AS n FROM spans)"""
DEPS["traceparents"] = ["spans"]

_CSTATE = "CASE ({x}) % 7 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PAUSED' ELSE 'RUNNING' END"
SQL["connectors"] = """SELECT 'conn-' || s_suppkey AS connector, s_suppkey,
  CASE WHEN s_suppkey % 2 = 0 THEN 'source' ELSE 'sink' END AS type FROM supplier"""
SQL["connector_status"] = f"""SELECT 'conn-' || s_suppkey AS connector, {_CSTATE.format(x='s_suppkey')} AS state,
  'worker-' || (s_suppkey % 3) AS worker_id FROM supplier WHERE s_suppkey % 13 <> 0"""
SQL["connector_tasks"] = f"""SELECT 'conn-' || s_suppkey AS connector, CAST(t AS INTEGER) AS task_id,
  {_CSTATE.format(x='s_suppkey + t')} AS state FROM supplier, range(0, 4) r(t) WHERE t <= s_suppkey % 4"""
SQL["connector_history"] = f"""SELECT 'conn-' || s_suppkey AS connector, TIMESTAMP '2024-01-01 00:00:00' + to_hours(h) AS checked_at,
  {_CSTATE.format(x='s_suppkey + h')} AS state FROM supplier, range(0, 24) r(h)"""

SQL["tenants"] = """SELECT 'tenant-' || n_nationkey AS tenant_id, n_name AS tenant_name,
  CASE n_nationkey % 4 WHEN 0 THEN 'BASIC' WHEN 1 THEN 'STANDARD' WHEN 2 THEN 'PREMIUM' ELSE 'ENTERPRISE' END AS tier,
  n_nationkey % 6 <> 5 AS is_active,
  CASE n_nationkey % 4 WHEN 0 THEN 100 WHEN 1 THEN 500 WHEN 2 THEN 2000 ELSE 10000 END AS max_messages_per_second
FROM nation"""
SQL["tenant_messages"] = """SELECT event_id,
  CASE WHEN event_id % 4 = 2 THEN 'tenant-tenant-' || (user_id % 28) || '-order-events' ELSE 'order-events' END AS topic,
  CASE WHEN event_id % 4 = 1 THEN 'tenant-' || (user_id % 28) || ':K-' || event_id
       WHEN event_id % 4 = 0 AND event_id % 50 = 0 THEN 'tenant-' || ((user_id + 1) % 28) || ':K-' || event_id
       ELSE 'K-' || event_id END AS key,
  props AS value, CASE WHEN event_id % 4 = 0 THEN 'tenant-' || (user_id % 28) END AS tenant_header,
  CASE WHEN event_type = 'signup' THEN 'ALL' WHEN event_type = 'purchase' THEN 'PREMIUM' END AS target_tier
FROM events"""

SQL["inventory_commands"] = """SELECT event_id AS seq, 'PROD-' || (user_id % 25) AS product_id, 'ORD-' || event_id AS order_id,
  CAST(event_id % 5 + 1 AS INTEGER) AS quantity, CASE WHEN event_type = 'error' THEN 'RELEASE' ELSE 'RESERVE' END AS command
FROM events"""
SQL["inventory"] = """SELECT 'PROD-' || p_partkey AS product_id, 300 AS quantity, 0 AS reserved_quantity FROM part WHERE p_partkey < 24"""

SQL["stock"] = """SELECT 'PART-' || p_partkey AS product_id, CAST(p_partkey % 20 + 5 AS INTEGER) AS quantity,
  CAST(p_partkey % 3 AS INTEGER) AS reserved_quantity FROM part"""
SQL["stock_commands"] = """SELECT o_orderkey AS seq,
  'PART-' || CASE WHEN o_orderkey % 8 = 0 THEN '1' WHEN o_orderkey % 13 = 0 THEN 'none-' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS product_id,
  'ORD-' || o_orderkey AS order_id, CAST(o_orderkey % 5 + 1 AS INTEGER) AS quantity,
  CASE WHEN o_orderkey % 7 < 3 THEN 'RELEASE' ELSE 'RESERVE' END AS command FROM orders"""

_H = "struct_pack(key := 'kafka_dlt-{n}', value := {v})"
SQL["dead_letter_records"] = f"""
SELECT CASE WHEN event_id % 4 = 0 THEN 'saga-event-topic' ELSE 'order-events' END || '.DLT' AS topic,
  CAST(user_id % 3 AS INTEGER) AS "partition", event_id AS "offset", ts AS "timestamp",
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'key-' || user_id END AS key,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE props END AS value,
  list_filter([
    CASE WHEN event_id % 5 <> 0 THEN {_H.format(n='original-topic', v="CASE WHEN event_id % 4 = 0 THEN 'saga-event-topic' ELSE 'order-events' END")} END,
    {_H.format(n='original-partition', v="CASE WHEN event_id % 7 = 0 THEN 'x' ELSE CAST(event_id % 3 AS VARCHAR) END")},
    {_H.format(n='original-offset', v="CAST(event_id AS VARCHAR)")},
    CASE WHEN event_id % 6 <> 0 THEN {_H.format(n='exception-message', v="'java.lang.IllegalStateException: failed ' || event_id")} END,
    CASE WHEN event_id % 4 <> 0 THEN {_H.format(n='exception-stacktrace', v="'at com.example.Handler.handle(Handler.java:' || (event_id % 100) || ')'")} END,
    CASE WHEN event_id % 9 = 0 THEN {_H.format(n='exception-message', v="'retry failed ' || event_id")} END
  ], lambda h: h IS NOT NULL) AS headers
FROM events"""

_MINOR = "CAST(CAST(value AS DECIMAL(19,2)) * 100 AS BIGINT)"
_EV = "'{\"eventId\":\"E-' || event_id || '\"'"
SQL["typed_events"] = f"""
SELECT event_id AS "offset",
  CASE event_id % 4 WHEN 0 THEN 'OrderEvent' WHEN 1 THEN 'PaymentEvent' WHEN 2 THEN 'InventoryEvent' ELSE 'Unknown' END AS schema_name,
  CASE WHEN event_id % 40 = 5 THEN 'not-json'
    WHEN event_id % 4 = 0 THEN {_EV} || ',"orderId":"ORD-' || event_id || '"' ||
      CASE WHEN event_id % 24 <> 0 THEN ',"customerId":"CUST-' || user_id || '"' ELSE '' END ||
      ',"productId":"PROD-' || (user_id % 25) || '","quantity":' || (event_id % 5 + 1) || ',"totalAmount":' || {_MINOR} ||
      ',"eventType":"ORDER_CREATED","timestamp":' || (epoch_us(ts) // 1000) || '}}'
    WHEN event_id % 4 = 1 THEN {_EV} || ',"paymentId":"PAY-' || event_id || '","orderId":"ORD-' || event_id || '","amount":' || {_MINOR} ||
      ',"currency":"KRW","paymentMethod":"CARD","eventType":"PAYMENT_COMPLETED","timestamp":' || (epoch_us(ts) // 1000) || '}}'
    WHEN event_id % 4 = 2 THEN {_EV} || ',"productId":"PROD-' || (user_id % 25) || '","orderId":"ORD-' || event_id ||
      '","quantity":' || (event_id % 5 + 1) || ',"availableStock":' || (event_id % 30) ||
      ',"eventType":"STOCK_RESERVED","timestamp":' || (epoch_us(ts) // 1000) || '}}'
    ELSE {_EV} || ',"foo":"bar"}}' END AS value
FROM events"""

SQL["eos_input"] = """SELECT 'eos-input' AS topic, CAST(user_id % 3 AS INTEGER) AS "partition", event_id AS "offset",
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'K-' || event_id END AS key,
  CASE WHEN event_id % 8 = 0 THEN 'say "hi" ' || event_id ELSE props END AS value FROM events"""

SQL["outbox"] = """SELECT 'OB-' || o_orderkey AS id, 'Order' AS aggregate_type, 'ORD-' || o_orderkey AS aggregate_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'ORDER_CREATED' WHEN 1 THEN 'ORDER_CANCELLED' ELSE 'PAYMENT_COMPLETED' END AS event_type,
  '{"orderId":"ORD-' || o_orderkey || '","amount":' || CAST(CAST(o_totalprice AS DECIMAL(19,2)) AS VARCHAR) || '}' AS payload,
  'saga-event-topic' AS topic,
  CASE WHEN o_orderkey % 5 <= 2 THEN 'PENDING' WHEN o_orderkey % 5 = 3 THEN 'SENT' ELSE 'FAILED' END AS status,
  o_orderdate AS created_at, CASE WHEN o_orderkey % 5 = 3 THEN o_orderdate + INTERVAL 5 SECOND END AS processed_at,
  CAST(CASE WHEN o_orderkey % 5 = 4 THEN o_orderkey % 3 ELSE 0 END AS INTEGER) AS retry_count
FROM orders"""

SQL["incremental_source"] = """SELECT o_orderkey AS id, o_orderdate AS updated_at, CAST(o_totalprice AS DECIMAL(19,2)) AS payload
FROM orders"""

SQL["product_events"] = """SELECT p_partkey * 10 + version AS "offset", 'P-' || p_partkey AS product_id,
  CASE version WHEN 1 THEN 'PRODUCT_REGISTERED' WHEN 2 THEN 'PRODUCT_UPDATED' ELSE 'PRODUCT_DELETED' END AS event_type,
  p_name AS name, CASE WHEN version = 2 THEN CAST(trunc(p_retailprice * 1.1) AS BIGINT) ELSE CAST(trunc(p_retailprice) AS BIGINT) END AS price,
  p_brand AS category
FROM part, (VALUES (1), (2), (3)) v(version)
WHERE version = 1 OR (version = 2 AND p_partkey % 2 = 0) OR (version = 3 AND p_partkey % 5 = 0)"""

SQL["payment_commands"] = """SELECT 'PAY-' || o_orderkey AS payment_id, 'saga-' || o_orderkey AS saga_id, 'ORD-' || o_orderkey AS order_id,
  'CUST-' || o_custkey AS customer_id, CAST(o_totalprice AS DECIMAL(19,2)) AS amount,
  CASE o_orderkey % 7 WHEN 0 THEN 'CARD' WHEN 1 THEN 'BANK_TRANSFER' WHEN 2 THEN 'VIRTUAL_ACCOUNT' WHEN 3 THEN 'MOBILE'
    WHEN 4 THEN 'KAKAO_PAY' WHEN 5 THEN 'NAVER_PAY' ELSE 'TOSS_PAY' END AS method,
  o_orderkey % 6 <> 0 AS gateway_success, 'TX-' || o_orderkey AS transaction_id, 'PK-' || o_orderkey AS payment_key,
  CASE WHEN o_orderkey % 6 = 0 THEN 'Card declined' END AS gateway_error, o_orderkey % 4 = 3 OR o_orderkey % 12 = 0 AS cancel_requested,
  o_orderkey % 8 <> 7 AS refund_success, 'RF-' || o_orderkey AS refund_id,
  CASE WHEN o_orderkey % 8 = 7 THEN 'Refund window closed' END AS refund_error
FROM orders"""

SQL["routing_keys"] = """SELECT event_id,
  CASE event_id % 12 WHEN 4 THEN 'CUSTOMER-VIP-001' WHEN 6 THEN 'GOLD-001' WHEN 11 THEN NULL
    WHEN 3 THEN 'PRODUCT-' || user_id WHEN 5 THEN 'CUST-' || user_id
    WHEN 0 THEN 'ORDER-' || event_id WHEN 1 THEN 'payment-' || event_id WHEN 2 THEN 'INVENTORY-' || event_id
    WHEN 7 THEN 'HIGH:' || event_id WHEN 8 THEN 'p2:' || event_id WHEN 9 THEN 'BATCH:' || event_id
    ELSE 'plain-' || event_id END AS key,
  props AS value, CASE (event_id // 12) % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 6 WHEN 3 THEN 9 ELSE 12 END AS num_partitions
FROM events"""
