"""Catalog: connectors (dead-letter capture, typed records, batches, JDBC-style
extract/upsert, changelog, exactly-once, outbox) and write models."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import dedup as U
from flowlens.operators import saga as G
from flowlens.operators import stats
from flowlens.operators import writemodels as W
from flowlens.plans.q_projections import _PREFIX, _events
from flowlens.plans.q_stats import _STATS_SQL
from flowlens.plans.registry import register
from flowlens.sources import connectors as C
from flowlens.sources import fixtures as fx
from flowlens.sources.fixtures_sql import with_fixtures

PROCESSED_AT_MS = 1706745600000
AS_OF_OUTBOX = "2024-02-01 00:00:00"


def _hv(name):
    return f"list_filter(headers, lambda h: h.key = 'kafka_dlt-{name}')[-1].value"


_ERR = (f"CASE WHEN {_hv('exception-message')} IS NULL AND {_hv('exception-stacktrace')} IS NULL THEN 'Unknown error' "
        f"ELSE coalesce('Exception: ' || {_hv('exception-message')}, '') || "
        f"coalesce(chr(10) || chr(10) || 'StackTrace:' || chr(10) || {_hv('exception-stacktrace')}, '') END")


def _capture_sql(original_position: bool):
    part = f"coalesce(TRY_CAST({_hv('original-partition')} AS INTEGER), \"partition\")" if original_position else '"partition"'
    off = f"coalesce(TRY_CAST({_hv('original-offset')} AS BIGINT), \"offset\")" if original_position else '"offset"'
    return f"""SELECT topic AS dlt_topic, "partition" AS dlt_partition, "offset" AS dlt_offset,
  coalesce({_hv('original-topic')}, substr(topic, 1, length(topic) - 4)) AS original_topic,
  CAST({part} AS INTEGER) AS partition_id, CAST({off} AS BIGINT) AS offset_id, key AS message_key, value AS message_value,
  {_ERR} AS error_message, 'PENDING' AS status, "timestamp" AS created_at, 0 AS retry_count
FROM dead_letter_records WHERE ends_with(topic, '.DLT')"""


@register("capture_dead_letters", with_fixtures(_capture_sql(True), "dead_letter_records"))
def q_capture_dead_letters(spark, sf):
    return C.capture_dead_letters(fx.dead_letter_records(spark, sf))


@register("capture_saga_dead_letters", with_fixtures(
    _capture_sql(False).replace("WHERE ends_with(topic, '.DLT')", "WHERE topic = 'saga-event-topic.DLT'"), "dead_letter_records"))
def q_capture_saga_dead_letters(spark, sf):
    r = fx.dead_letter_records(spark, sf).filter(F.col("topic") == "saga-event-topic.DLT")
    return C.capture_dead_letters(r, original_position=False)


@register("dlt_error_text", with_fixtures(f'SELECT "offset", {_ERR} AS error_text FROM dead_letter_records',
                                          "dead_letter_records"))
def q_dlt_error_text(spark, sf):
    h = lambda n: C.header_value("headers", C.DLT_PREFIX + n)
    r = fx.dead_letter_records(spark, sf)
    return r.select("offset", C.dlt_error_text(h("exception-message"), h("exception-stacktrace")).alias("error_text"))


# ------------------------------------------------------------------ typed records
def _je(field, typ="VARCHAR"):
    return f"CAST(json_extract_string(value, '$.{field}') AS {typ})"


@register("demux_avro_events", with_fixtures(f"""
SELECT "offset", schema_name AS record_type,
  CASE schema_name WHEN 'OrderEvent' THEN {_je('orderId')} WHEN 'PaymentEvent' THEN {_je('paymentId')} ELSE {_je('productId')} END AS entity_id,
  CASE schema_name WHEN 'OrderEvent' THEN {_je('totalAmount', 'BIGINT')} WHEN 'PaymentEvent' THEN {_je('amount', 'BIGINT')} END AS amount_minor,
  CAST(make_timestamp({_je('timestamp', 'BIGINT')} * 1000) AS TIMESTAMP) AS event_time
FROM typed_events WHERE schema_name IN ('OrderEvent', 'PaymentEvent', 'InventoryEvent') AND json_valid(value)
  AND {_je('eventId')} IS NOT NULL""", "typed_events"))
def q_demux_avro_events(spark, sf):
    return C.demuxed_long(fx.typed_events(spark, sf))


def _missing(name):
    return " OR ".join(f"json_extract(value, '$.{f}') IS NULL" for f in C.AVRO_REQUIRED[name])


@register("schema_conformance", with_fixtures(" UNION ALL ".join(f"""
SELECT '{n}' AS record_type, count(*) AS records, count_if(NOT json_valid(value)) AS unparsable,
  count_if(CASE WHEN json_valid(value) THEN ({_missing(n)}) ELSE FALSE END) AS missing_required,
  count_if(NOT json_valid(value)) + count_if(CASE WHEN json_valid(value) THEN ({_missing(n)}) ELSE FALSE END) = 0 AS compatible
FROM typed_events WHERE schema_name = '{n}'""" for n in C.AVRO_SCHEMAS), "typed_events"))
def q_schema_conformance(spark, sf):
    return C.schema_conformance(fx.typed_events(spark, sf))


# ------------------------------------------------------------------ batches, extract, upsert
_HEADER_ID = "coalesce(message_id_hdr, topic || '-' || \"partition\" || '-' || \"offset\")"


@register("consume_batch", with_fixtures(f"""
SELECT "partition", "offset" // 100 AS batch, count(*) AS records, count_if(outcome = 'SUCCESS') AS success,
  count_if(outcome = 'SKIPPED') AS skipped, count_if(outcome = 'FAILED') AS failed FROM (
  SELECT r.*, CASE WHEN value IS NULL OR trim(value) = '' THEN 'FAILED'
    WHEN struct_pack(o := "offset", d := delivery) <> f.f THEN 'SKIPPED' ELSE 'SUCCESS' END AS outcome
  FROM (SELECT *, {_HEADER_ID} AS message_id FROM deliveries) r
  JOIN (SELECT {_HEADER_ID} AS message_id, min(struct_pack(o := "offset", d := delivery)) AS f FROM deliveries GROUP BY 1) f
  USING (message_id)) GROUP BY ALL""", "deliveries"))
def q_consume_batch(spark, sf):
    return C.consume_batch(fx.deliveries(spark, sf), U.message_id_header(), 100)


@register("incremental_extract", with_fixtures(
    "SELECT * FROM incremental_source WHERE updated_at > TIMESTAMP '1998-01-01 00:00:00' OR "
    "(updated_at = TIMESTAMP '1998-01-01 00:00:00' AND id > 5000)", "incremental_source"))
def q_incremental_extract(spark, sf):
    return C.incremental_extract(fx.incremental_source(spark, sf), "timestamp+incrementing", "1998-01-01 00:00:00", 5000)


@register("incremental_extract_incrementing", with_fixtures("SELECT * FROM incremental_source WHERE id > 12000",
                                                            "incremental_source"))
def q_incremental_extract_incrementing(spark, sf):
    return C.incremental_extract(fx.incremental_source(spark, sf), "incrementing", mark_id=12000)


@register("high_water_mark", with_fixtures(
    "SELECT m['u'] AS mark_ts, m['i'] AS mark_id FROM (SELECT max(struct_pack(u := updated_at, i := id)) AS m FROM incremental_source "
    "WHERE updated_at <= TIMESTAMP '1997-01-01 00:00:00')", "incremental_source"))
def q_high_water_mark(spark, sf):
    s = fx.incremental_source(spark, sf).filter(F.col("updated_at") <= F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"))
    return C.high_water_mark(s)


@register("upsert_merge", with_fixtures("""
SELECT * FROM s1 WHERE id NOT IN (SELECT id FROM s2) UNION ALL SELECT * FROM s2""", "incremental_source", extra={
    "s1": "SELECT * FROM incremental_source WHERE updated_at < TIMESTAMP '1997-01-01 00:00:00'",
    "s2": "SELECT id, updated_at + INTERVAL 1 DAY AS updated_at, payload + 1 AS payload FROM incremental_source "
          "WHERE updated_at >= TIMESTAMP '1996-06-01 00:00:00'"}))
def q_upsert_merge(spark, sf):
    src = fx.incremental_source(spark, sf)
    ts = lambda v: F.lit(v).cast("timestamp_ntz")
    s1 = src.filter(F.col("updated_at") < ts("1997-01-01 00:00:00"))
    late = src.filter(F.col("updated_at") >= ts("1996-06-01 00:00:00"))
    s2 = late.select("id", (F.col("updated_at") + F.expr("INTERVAL 1 DAY")).alias("updated_at"),
                     (F.col("payload") + 1).cast("decimal(19,2)").alias("payload")).unionByName(late)  # two updates of an id
    return C.upsert_merge(s1, s2, ["id"], "updated_at")


@register("publish_changelog", with_fixtures("""
SELECT 'order-statistics' AS topic, product_id AS key,
  '{"productId":"' || product_id || '","productName":"' || product_name || '","totalOrders":' || total_orders ||
  ',"totalQuantity":' || total_quantity || ',"totalRevenue":' || CAST(CAST(total_revenue AS DECIMAL(38,2)) AS VARCHAR) ||
  ',"cancelledOrders":' || cancelled_orders || '}' AS value FROM s""", "order_events",
    extra={"s": _STATS_SQL.replace("AS DOUBLE) AS total_revenue", "AS DECIMAL(38,2)) AS total_revenue")}))
def q_publish_changelog(spark, sf):
    return C.publish_changelog(stats.product_order_stats(fx.order_events(spark, sf)))


# ------------------------------------------------------------------ exactly-once
_WRAP = ("'{\"originalKey\":\"' || coalesce(key, 'null') || '\",\"data\":' || "
         "CASE WHEN json_valid(value) THEN CAST(json(value) AS VARCHAR) "
         "ELSE '\"' || replace(replace(value, '\\', '\\\\'), '\"', '\\\"') || '\"' END || "
         f"',\"processedAt\":{PROCESSED_AT_MS},\"processor\":\"exactly-once\"}}'")


@register("exactly_once_transform", with_fixtures(f'SELECT topic, "partition", "offset", key, {_WRAP} AS value FROM eos_input',
                                                  "eos_input"))
def q_exactly_once_transform(spark, sf):
    return C.exactly_once_transform(fx.eos_input(spark, sf), PROCESSED_AT_MS)


@register("eos_audit", with_fixtures(
    f"SELECT topic || '-' || \"partition\" AS source_topic_partition, \"offset\" AS source_offset, coalesce(key, 'null') AS key, "
    f"length(value) AS input_size, length({_WRAP}) AS output_size, CAST({PROCESSED_AT_MS} AS BIGINT) AS timestamp FROM eos_input",
    "eos_input"))
def q_eos_audit(spark, sf):
    return C.eos_audit(fx.eos_input(spark, sf), PROCESSED_AT_MS)


# ------------------------------------------------------------------ outbox
_PENDING = "SELECT * FROM outbox WHERE status = 'PENDING' ORDER BY created_at, id LIMIT 100"


@register("outbox_pending", with_fixtures(_PENDING, "outbox"))
def q_outbox_pending(spark, sf):
    return C.outbox_pending(fx.outbox(spark, sf), 100)


@register("outbox_by_status", with_fixtures("SELECT * FROM outbox WHERE status = 'FAILED'", "outbox"))
def q_outbox_by_status(spark, sf):
    return C.outbox_by_status(fx.outbox(spark, sf), "FAILED")


@register("outbox_status_update", with_fixtures(f"""
SELECT o.id, aggregate_type, aggregate_id, event_type, payload, topic,
  CASE WHEN r.ok IS NULL THEN status WHEN r.ok THEN 'SENT' ELSE 'FAILED' END AS status, created_at,
  CASE WHEN r.ok THEN TIMESTAMP '{AS_OF_OUTBOX}' ELSE processed_at END AS processed_at,
  CASE WHEN r.ok = FALSE THEN retry_count + 1 ELSE retry_count END AS retry_count
FROM outbox o LEFT JOIN (SELECT id, NOT ends_with(aggregate_id, '7') AS ok FROM ({_PENDING})) r USING (id)""", "outbox"))
def q_outbox_status_update(spark, sf):
    ob = fx.outbox(spark, sf)
    results = C.outbox_pending(ob, 100).select("id", (~F.col("aggregate_id").endswith("7")).alias("success"))
    results = results.unionByName(results.filter("success"))  # a repeated answer
    return C.outbox_status_update(ob, results, AS_OF_OUTBOX)


_CMDLOG = """SELECT saga_id, CAST(0 AS BIGINT) AS seq, 'CREATE_ORDER' AS command, CAST(NULL AS VARCHAR) AS payment_id, CAST(NULL AS VARCHAR) AS reason
FROM saga_starts
UNION ALL SELECT saga_id, seq, command, CASE WHEN command = 'CANCEL_PAYMENT' THEN pay_before END, reason FROM (SELECT saga_id, "offset" AS seq,
  CASE WHEN event_type = 'ORDER_CREATED' THEN 'PROCESS_PAYMENT' WHEN event_type = 'PAYMENT_COMPLETED' THEN 'RESERVE_INVENTORY'
       WHEN event_type IN ('PAYMENT_FAILED','INVENTORY_FAILED') AND step_at >= 3 AND pay_before IS NOT NULL THEN 'CANCEL_PAYMENT'
       WHEN event_type IN ('PAYMENT_FAILED','INVENTORY_FAILED') AND step_at >= 2 THEN 'CANCEL_ORDER'
       WHEN event_type = 'PAYMENT_CANCELLED' THEN 'CANCEL_ORDER'
       WHEN event_type = 'INVENTORY_RELEASED' THEN CASE WHEN pay_before IS NOT NULL THEN 'CANCEL_PAYMENT' ELSE 'CANCEL_ORDER' END END AS command,
  CASE WHEN event_type IN ('PAYMENT_FAILED','INVENTORY_FAILED','PAYMENT_CANCELLED') THEN reason
       WHEN event_type = 'INVENTORY_RELEASED' THEN coalesce(reason_before, 'Compensation') END AS reason, pay_before
  FROM pre) WHERE command IS NOT NULL"""


def _cmdlog(spark, sf):
    return G.saga_command_log(fx.saga_starts(spark, sf), _events(spark, sf))


_EMIT_PAYLOAD = ("'{\"sagaId\":\"' || saga_id || '\",\"command\":\"' || command || '\"' || "
                 "CASE WHEN payment_id IS NOT NULL THEN ',\"paymentId\":\"' || payment_id || '\"' ELSE '' END || "
                 "CASE WHEN reason IS NOT NULL THEN ',\"reason\":\"' || replace(replace(reason, '\\', '\\\\'), '\"', '\\\"') || '\"' ELSE '' END || '}'")


@register("outbox_emit", with_fixtures(
    f"SELECT 'Saga' AS aggregate_type, saga_id AS aggregate_id, command AS event_type, {_EMIT_PAYLOAD} AS payload, "
    "'saga-command-topic' AS topic, 'PENDING' AS status FROM cmdlog", "saga_decoded", "saga_starts",
    extra={"pre": _PREFIX, "cmdlog": _CMDLOG}))
def q_outbox_emit(spark, sf):
    c = _cmdlog(spark, sf)
    payload = F.concat(F.lit('{"sagaId":'), C.json_string("saga_id"), F.lit(',"command":'), C.json_string("command"),
                       F.coalesce(F.concat(F.lit(',"paymentId":'), C.json_string("payment_id")), F.lit("")),
                       F.coalesce(F.concat(F.lit(',"reason":'), C.json_string("reason")), F.lit("")), F.lit("}"))
    return C.outbox_emit(c, "Saga", "saga_id", "command", payload, "saga-command-topic")


# ------------------------------------------------------------------ write models
_ORDER_CMDS = """
SELECT order_id, CAST(0 AS BIGINT) AS seq, 'CREATE' AS command, CAST(NULL AS VARCHAR) AS reason, customer_id, product_id, quantity,
  total_amount, created_at AS created FROM saga_starts
UNION ALL SELECT order_id, "offset", 'CONFIRM', NULL, NULL, NULL, NULL, NULL, event_ts FROM saga_decoded
  WHERE event_type = 'INVENTORY_RESERVED' AND saga_id IN (SELECT saga_id FROM saga_starts)
UNION ALL SELECT s.order_id, c.seq, 'CANCEL', c.reason, NULL, NULL, NULL, NULL, NULL FROM cmdlog c JOIN saga_starts s USING (saga_id)
  WHERE c.command = 'CANCEL_ORDER'"""
_ORDERS = """SELECT order_id, c['customer_id'] AS customer_id, c['product_id'] AS product_id, c['quantity'] AS quantity,
  c['total_amount'] AS total_amount, l['status'] AS status, l['reason'] AS failure_reason, c['created'] AS created_at FROM (
  SELECT order_id,
    arg_max(struct_pack(customer_id, product_id, quantity, total_amount, created), seq) FILTER (WHERE command = 'CREATE') AS c,
    arg_max(struct_pack(status := CASE command WHEN 'CREATE' THEN 'PENDING' WHEN 'CONFIRM' THEN 'CONFIRMED'
      WHEN 'CANCEL' THEN 'CANCELLED' ELSE 'FAILED' END, reason := reason), seq) AS l
  FROM ocmds GROUP BY order_id) WHERE c IS NOT NULL"""


def _orders(spark, sf):
    starts = fx.saga_starts(spark, sf)
    ev = _events(spark, sf)
    return W.orders_write_model(W.order_commands(starts, G.saga_command_log(starts, ev), ev))[0]


def _oq(body):
    return with_fixtures(body, "saga_decoded", "saga_starts",
                         extra={"pre": _PREFIX, "cmdlog": _CMDLOG, "ocmds": _ORDER_CMDS, "orders": _ORDERS})


@register("orders_write_model", _oq("SELECT * FROM orders"))
def q_orders_write_model(spark, sf):
    return _orders(spark, sf)


@register("order_projection", _oq("SELECT * FROM orders WHERE status = 'CANCELLED'"))
def q_order_projection(spark, sf):
    return W.order_projection(_orders(spark, sf)).filter(F.col("status") == "CANCELLED")


_PAYMENTS = """SELECT payment_id, saga_id, order_id, customer_id, amount, method,
  CASE WHEN cancel_requested THEN 'CANCELLED' WHEN gateway_success THEN 'COMPLETED' ELSE 'FAILED' END AS status,
  CASE WHEN gateway_success THEN transaction_id END AS transaction_id, CASE WHEN gateway_success THEN payment_key END AS payment_key,
  CASE WHEN cancel_requested THEN CASE WHEN refund_success THEN 'Order cancelled'
         ELSE 'Order cancelled (환불 실패: ' || refund_error || ')' END
       WHEN NOT gateway_success THEN coalesce(gateway_error, '결제 실패') END AS failure_reason,
  CASE WHEN cancel_requested AND refund_success THEN refund_id END AS refund_id,
  CASE WHEN cancel_requested THEN 'PAYMENT_CANCELLED' WHEN gateway_success THEN 'PAYMENT_COMPLETED'
       ELSE 'PAYMENT_FAILED' END AS emitted_event
FROM payment_commands"""


def _pq(body):
    return with_fixtures(body, "payment_commands", extra={"payments": _PAYMENTS})


def _payments(spark, sf):
    return W.payments_write_model(fx.payment_commands(spark, sf))


@register("payments_write_model", _pq("SELECT * FROM payments"))
def q_payments_write_model(spark, sf):
    return _payments(spark, sf)


@register("payment_events", with_fixtures("""
SELECT payment_id, saga_id, order_id, 0 AS seq, CASE WHEN gateway_success THEN 'PAYMENT_COMPLETED' ELSE 'PAYMENT_FAILED' END AS event_type
FROM payment_commands
UNION ALL SELECT payment_id, saga_id, order_id, 1, 'PAYMENT_CANCELLED' FROM payment_commands WHERE cancel_requested""", "payment_commands"))
def q_payment_events(spark, sf):
    return W.payment_events(fx.payment_commands(spark, sf))


@register("payments_by_status", _pq("SELECT * FROM payments WHERE status = 'CANCELLED'"))
def q_payments_by_status(spark, sf):
    return W.payments_by(_payments(spark, sf), status="CANCELLED")


@register("payment_by_order", _pq("SELECT * FROM payments WHERE order_id = 'ORD-15'"))
def q_payment_by_order(spark, sf):
    return W.payments_by(_payments(spark, sf), order_id="ORD-15")


@register("payment_by_saga", _pq("SELECT * FROM payments WHERE saga_id = 'saga-23'"))
def q_payment_by_saga(spark, sf):
    return W.payments_by(_payments(spark, sf), saga_id="saga-23")


@register("product_catalog", with_fixtures("""
SELECT product_id, l['name'] AS name, l['price'] AS price, l['category'] AS category, l['offset'] AS version_offset FROM (
  SELECT product_id, arg_max(struct_pack(event_type, name, price, category, "offset"), "offset") AS l FROM product_events
  GROUP BY product_id) WHERE l['event_type'] <> 'PRODUCT_DELETED'""", "product_events"))
def q_product_catalog(spark, sf):
    return W.product_catalog(fx.product_events(spark, sf))


@register("eos_wrap", with_fixtures(f'SELECT "offset", {_WRAP} AS wrapped FROM eos_input', "eos_input"))
def q_eos_wrap(spark, sf):
    return fx.eos_input(spark, sf).select("offset", C.eos_wrap(processed_at=PROCESSED_AT_MS).alias("wrapped"))
