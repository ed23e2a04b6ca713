"""Adapter frames: the reference's record shapes, derived from driver tables.

Each function is a pure projection (or a bounded fan-out through a fixed
literal table) of a driver table, so its cost grows linearly with the input
and it never shuffles. The SQL twins used by the DuckDB oracle live in
:mod:`flowlens.sources.fixtures_sql`; both follow ``FIXTURES.md``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.sources.tables import table


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _json_str(c: Column) -> Column:
    """JSON string literal of a text column (quotes and backslashes escaped)."""
    esc = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), esc, F.lit('"'))


def _iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


# ---------------------------------------------------------------- F-ORD
def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    eid, uid = F.col("event_id"), F.col("user_id")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.lit("order-events").alias("topic"),
        (uid % 3).cast("int").alias("partition"),
        eid.alias("offset"),
        F.concat(F.lit("ORD-"), _s(eid)).alias("order_id"),
        F.concat(F.lit("PROD-"), F.lpad(_s(uid % 25), 3, "0")).alias("product_id"),
        F.concat(F.lit("Product "), _s(uid % 25),
                 F.when(eid % 7 == 0, F.lit(" v2")).otherwise(F.lit(""))).alias("product_name"),
        (eid % 5 + 1).cast("int").alias("quantity"),
        F.col("value").cast("decimal(19,2)").alias("price"),
        F.concat(F.lit("CUST-"), _s(uid)).alias("customer_id"),
        F.when(F.col("event_type").isin("signup", "view"), "CREATED")
         .when(F.col("event_type") == "purchase", "CONFIRMED")
         .when(F.col("event_type") == "click", "CANCELLED")
         .when(F.col("event_type") == "error", "REFUNDED").alias("event_type"),
        ts.alias("timestamp"),
        F.when(eid % 50 == 0, ts - F.expr("INTERVAL 3 HOURS")).otherwise(ts).alias("late_timestamp"),
    )


# ---------------------------------------------------------------- F-SAGA
# The scenario table of FIXTURES.md (k = o_orderkey % 10).
# (k, seq, event type, reason)
SAGA_SCENARIOS = [
    *[(k, s, t, None) for k in range(5)
      for s, t in ((1, "ORDER_CREATED"), (2, "PAYMENT_COMPLETED"), (3, "INVENTORY_RESERVED"))],
    (5, 1, "ORDER_CREATED", None), (5, 2, "PAYMENT_FAILED", "Insufficient funds"),
    (5, 3, "ORDER_CANCELLED", "Payment failed"),
    (6, 1, "ORDER_CREATED", None), (6, 2, "PAYMENT_COMPLETED", None),
    (6, 3, "INVENTORY_FAILED", "Insufficient stock"),
    (6, 4, "PAYMENT_CANCELLED", "Inventory reservation failed"),
    (6, 5, "ORDER_CANCELLED", "Compensation"),
    (7, 1, "ORDER_CREATED", None),
    (8, 1, "ORDER_CREATED", None), (8, 2, "PAYMENT_COMPLETED", None),
    (8, 3, "INVENTORY_RELEASED", None),
    (9, 1, "PAYMENT_COMPLETED", None), (9, 2, "MALFORMED", None),
]
SAGA_EVENT_TYPES = ["ORDER_CREATED", "ORDER_CANCELLED", "PAYMENT_COMPLETED", "PAYMENT_FAILED",
                    "PAYMENT_CANCELLED", "INVENTORY_RESERVED", "INVENTORY_FAILED",
                    "INVENTORY_RELEASED"]


def _scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAGA_SCENARIOS, "k INT, seq INT, sc_type STRING, reason STRING")


def _saga_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    k = F.col("o_orderkey")
    return o.select(
        k, (k % 10).cast("int").alias("k"),
        F.concat(F.lit("saga-"), _s(k)).alias("saga_id"),
        F.concat(F.lit("ORD-"), _s(k)).alias("order_id"),
        F.concat(F.lit("CUST-"), _s("o_custkey")).alias("customer_id"),
        F.concat(F.lit("PROD-"), _s(k % 200)).alias("product_id"),
        (k % 5 + 1).cast("int").alias("quantity"),
        F.col("o_totalprice").cast("decimal(19,2)").alias("total_amount"),
        F.concat(F.lit("PAY-"), _s(k)).alias("payment_id"),
        F.col("o_orderdate"),
    )


def saga_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelope rows ``(offset, value)`` of the saga event topic.

    The fan-out joins each order to the fixed scenario table (a literal of
    27 rows, broadcast by construction), so it stays a map-side operation.
    Payloads are ``to_json`` of one struct per event whose fields outside the
    event's type are NULL (and therefore omitted), in the reference's field order.
    """
    b = _saga_base(spark, sf_dir).join(F.broadcast(_scenarios(spark)), "k")
    t = F.col("sc_type")
    ts = (F.col("o_orderdate") + F.make_interval(mins=F.col("seq"))).cast("timestamp_ntz")
    opts = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}
    when = lambda types, c: F.when(t.isin(*types), c)
    payload = F.to_json(F.struct(
        F.col("saga_id").alias("sagaId"), F.col("order_id").alias("orderId"),
        when(["ORDER_CREATED"], F.col("customer_id")).alias("customerId"),
        when(["ORDER_CREATED", "INVENTORY_RESERVED", "INVENTORY_FAILED", "INVENTORY_RELEASED"],
             F.col("product_id")).alias("productId"),
        when(["PAYMENT_COMPLETED", "PAYMENT_CANCELLED"], F.col("payment_id")).alias("paymentId"),
        when(["ORDER_CREATED", "INVENTORY_RESERVED", "INVENTORY_RELEASED"], F.col("quantity")).alias("quantity"),
        when(["ORDER_CREATED"], F.col("total_amount")).alias("totalAmount"),
        when(["PAYMENT_COMPLETED"], F.col("total_amount")).alias("amount"),
        when(["INVENTORY_FAILED"], F.col("quantity")).alias("requestedQuantity"),
        when(["INVENTORY_FAILED"], F.lit(0)).alias("availableQuantity"),
        F.col("reason").alias("reason"), ts.alias("timestamp")), opts)
    created = F.to_json(F.struct(
        F.col("saga_id").alias("sagaId"), F.col("order_id").alias("orderId"), F.col("customer_id").alias("customerId"),
        F.col("product_id").alias("productId"), F.col("quantity").alias("quantity"),
        F.col("total_amount").alias("totalAmount"), ts.alias("timestamp")), opts)
    env = F.to_json(F.struct(t.alias("eventType"), payload.alias("payload")))
    bad = (F.col("o_orderkey") / 10).cast("long") % 4
    malformed = (F.when(bad == 0, F.to_json(F.struct(F.lit("ORDER_SHIPPED").alias("eventType"), created.alias("payload"))))
                  .when(bad == 1, F.to_json(F.struct(created.alias("payload"))))
                  .when(bad == 2, F.lit('{"eventType":"ORDER_CREATED"}'))
                  .otherwise(F.concat(F.lit('{"eventType":"ORDER_CREATED","payload":'), created, F.lit("}"))))
    return b.select(
        (F.col("o_orderkey") * 10 + F.col("seq")).alias("offset"),
        F.when(t == "MALFORMED", malformed).otherwise(env).alias("value"),
    )


def saga_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saga rows written by ``startOrderSaga`` (k = 0..8)."""
    b = _saga_base(spark, sf_dir).filter(F.col("k") != 9)
    return b.select(
        "saga_id", "order_id", "customer_id", "product_id", "quantity", "total_amount",
        F.lit("ORDER_PENDING").alias("status"), F.lit("CREATE_ORDER").alias("current_step"),
        F.col("o_orderdate").alias("created_at"),
    )


# ---------------------------------------------------------------- F-DLT
# Error messages of the failed-message fixture, by event_id % 8.
DLT_ERROR_MESSAGES = [
    None,
    "   ",
    "Exception: java.lang.NullPointerException: x",
    "Exception: DeserializationException at offset",
    "Exception: upstream call\n\nStackTrace:\ncaused by TimeoutException",
    "Exception: CustomBizException: rule",
    "plain text",
    "Exception: org.h2.SQLException: closed",
]


def failed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props")
    eid = F.col("event_id")
    msg = F.element_at(F.array(*[F.lit(m).cast("string") for m in DLT_ERROR_MESSAGES]), (eid % 8 + 1).cast("int"))
    sb = (eid / 8).cast("long") % 10
    status = (F.when(sb <= 5, "PENDING").when(sb <= 7, "RETRIED").when(sb == 8, "RESOLVED")
              .otherwise("IGNORED"))
    return e.select(
        (eid + 1).alias("id"),
        F.concat(F.col("event_type"), F.lit("-topic")).alias("original_topic"),
        (eid % 3).cast("int").alias("partition_id"),
        eid.alias("offset_id"),
        F.when(eid % 11 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("key-"), _s("user_id"))).alias("message_key"),
        F.when(eid % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("props")).alias("message_value"),
        msg.alias("error_message"),
        status.alias("status"),
        F.col("ts").alias("created_at"),
        F.when(status == "PENDING", F.lit(None).cast("timestamp_ntz"))
         .otherwise(F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("resolved_at"),
        (eid % 6).cast("int").alias("retry_count"),
    )


def _iso_us(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


# ---------------------------------------------------------------- F-STATE
STATE_TOPICS = ["user-state", "product-state", "inventory-state", "config-state"]


def state_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compacted-topic changelog: JSON state per key, NULL value = tombstone."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    eid, uid = F.col("event_id"), F.col("user_id")
    key = F.concat(F.lit("K-"), _s(uid))
    upd = F.concat(F.lit(',"updatedAt":"'), _iso_us(F.col("ts")), F.lit('"}'))
    kind = (eid % 4).cast("int")
    user = F.concat(F.lit('{"userId":"'), key, F.lit('","email":"'), key, F.lit('@example.com","name":"User '),
                    _s(uid), F.lit('","status":"ACTIVE","tier":"BASIC"'), upd)
    product = F.concat(F.lit('{"productId":"'), key, F.lit('","name":"Product '), _s(uid), F.lit('","price":'),
                       _s(F.col("value").cast("decimal(19,2)")), F.lit(',"category":"general","status":"AVAILABLE"'), upd)
    inv = F.concat(F.lit('{"productId":"'), key, F.lit('","totalQuantity":100,"availableQuantity":'),
                   _s(eid % 30 - 2), F.lit(',"reservedQuantity":0,"reorderPoint":10,"reorderQuantity":100'), upd)
    conf = F.concat(F.lit('{"configKey":"'), key, F.lit('","configValue":"'), _s(eid),
                    F.lit('","valueType":"NUMBER","category":"general","isEncrypted":false'), upd)
    val = (F.when(F.col("event_type") == "error", F.lit(None).cast("string"))
           .when(kind == 0, user).when(kind == 1, product).when(kind == 2, inv).otherwise(conf))
    return e.select(
        F.element_at(F.array(*[F.lit(t) for t in STATE_TOPICS]), kind + 1).alias("topic"),
        (uid % 6).cast("int").alias("partition"), eid.alias("offset"), key.alias("key"), val.alias("value"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def ttl_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session and cache states with an expiry (cache entries without TTL never expire)."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id")
    eid = F.col("event_id")
    is_session = eid % 2 == 0
    exp = F.col("ts") + F.make_dt_interval(F.lit(0), (eid % 72).cast("int"))
    return e.select(
        F.when(is_session, F.lit("session-state")).otherwise(F.lit("cache-state")).alias("topic"),
        F.concat(F.lit("K-"), _s("user_id")).alias("key"), eid.alias("offset"),
        F.col("ts").alias("created_at"),
        F.when(~is_session & (eid % 5 == 0), F.lit(None).cast("timestamp_ntz")).otherwise(exp).alias("expires_at"),
    )


# ---------------------------------------------------------------- F-DELIV
def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redelivered messages: every event once, every 4th again at the same
    offset, every 5th again with the same message-id at an offset of its own (odd;
    first deliveries have even offsets)."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "value")
    eid = F.col("event_id")
    fan = F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)),
                   lambda d: (d == 0) | ((d == 1) & (eid % 4 == 0)) | ((d == 2) & (eid % 5 == 0)))
    val = (F.when(eid % 23 == 0, F.lit("  "))
           .when(eid % 19 == 0, F.concat(F.lit("not json "), _s(eid)))
           .when(eid % 17 == 0, F.concat(F.lit('{"note":"n/a","amount":'), _s(F.col("value").cast("decimal(19,2)")), F.lit("}")))
           .when(eid % 3 == 0, F.concat(F.lit('{"orderId":"ORD-'), _s(eid), F.lit('","amount":'),
                                        _s(F.col("value").cast("decimal(19,2)")), F.lit("}")))
           .when(eid % 3 == 1, F.concat(F.lit('{"paymentId":"PAY-'), _s(eid), F.lit('","amount":'),
                                        _s(F.col("value").cast("decimal(19,2)")), F.lit("}")))
           .otherwise(F.concat(F.lit('{"eventId":"EVT-'), _s(eid), F.lit('","amount":'),
                               _s(F.col("value").cast("decimal(19,2)")), F.lit("}"))))
    d = e.select("*", F.explode(fan).alias("delivery"))
    return d.select(
        F.lit("order-events").alias("topic"), (F.col("user_id") % 3).cast("int").alias("partition"),
        (eid * 2 + F.when(F.col("delivery") == 2, F.lit(1)).otherwise(F.lit(0))).alias("offset"),
        F.col("delivery").cast("int").alias("delivery"),
        F.concat(F.lit("key-"), _s("user_id")).alias("key"), val.alias("value"),
        F.when(eid % 6 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("msg-"), _s(eid))).alias("message_id_hdr"),
        F.col("ts").alias("processed_at"),
        (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expired_at"),
    )


# ---------------------------------------------------------------- F-LAG
def offset_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed and end offsets: a poll reads all three partitions of its group."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id")
    eid, uid = F.col("event_id"), F.col("user_id")
    cur, p = eid * 10 + F.col("p"), F.col("p")
    e = e.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("p"))
    return e.select(
        eid.alias("snapshot_id"), F.concat(F.lit("group-"), _s(uid % 20)).alias("group_id"),
        F.lit("order-events").alias("topic"), p.alias("partition"), F.col("ts"),
        cur.alias("current_offset"), (cur + ((eid + p * 31) * 7919) % 15000 - 100).alias("end_offset"))


# ---------------------------------------------------------------- F-ACT
def activity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-record producer/consumer activity (interceptor view)."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    eid = F.col("event_id")
    outcome = (F.when(F.col("event_type") == "error", "FAILED").when(eid % 40 == 7, "PENDING").otherwise("PROCESSED"))
    return e.select(
        F.concat(F.col("event_type"), F.lit("-topic")).alias("topic"),
        (F.col("user_id") % 6).cast("int").alias("partition"), eid.alias("offset"),
        F.concat(F.lit("K-"), _s("user_id")).alias("key"), F.col("ts").alias("record_ts"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ((eid * 37) % 9000) / 1000)).alias("consumed_ts"),
        (eid % 50).cast("long").alias("processing_ms"), outcome.alias("outcome"),
        F.when(outcome == "FAILED", F.concat(F.lit("processing failed at offset "), _s(eid))).alias("error"),
        (eid % 2 == 0).alias("sent"), ((eid % 2 == 0) & (eid % 3 == 0)).alias("acked"),
        (eid % 5 == 0).alias("committed"))


# Rebalance event types.
REBALANCE_TYPES = ["REVOCATION", "ASSIGNMENT", "LOST", "ERROR"]


def rebalance_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "ts")
    eid = F.col("event_id")
    kind = (eid % 4 + 1).cast("int")
    return e.select(
        eid.alias("rebalance_id"), F.element_at(F.array(*[F.lit(t) for t in REBALANCE_TYPES]), kind).alias("event_type"),
        F.when(eid % 4 == 3, F.lit(0)).otherwise(eid % 7).cast("int").alias("partition_count"), F.col("ts"))


# ---------------------------------------------------------------- F-SPAN
SPAN_KINDS = ["INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER"]


def _hexid(c: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(c)), width, "0")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of conversation turns: one trace per conversation."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    cid, turn = F.col("conv_id"), F.col("turn")
    start = (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
             + F.make_dt_interval(F.lit(0), F.lit(0), cid.cast("int"), turn.cast("decimal(18,6)")))
    parent = (F.when(turn > 0, _hexid(cid * 100 + turn, 16))
              .when(cid % 10 == 0, _hexid(F.lit(9_000_000_000) + cid, 16)))
    return c.select(
        _hexid(cid + 1, 32).alias("trace_id"), _hexid(cid * 100 + turn + 1, 16).alias("span_id"),
        parent.alias("parent_span_id"), F.concat(F.col("role"), F.lit("-"), _s(turn)).alias("name"),
        F.element_at(F.array(*[F.lit(k) for k in SPAN_KINDS]), (turn % 5 + 1).cast("int")).alias("kind"),
        start.alias("started_at"),
        (start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.length("text") % 900) / 1000)).alias("ended_at"),
        F.when((cid + turn) % 17 == 0, "ERROR").otherwise("OK").alias("status"))


def traceparents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traceparent header of each span's message, with malformed cases."""
    s = spans(spark, sf_dir)
    n = F.conv(F.col("span_id"), 16, 10).cast("long") % 9
    good = F.concat_ws("-", F.lit("00"), "trace_id", "span_id", F.lit("01"))
    tp = (F.when(n == 0, F.lit(None).cast("string")).when(n == 1, F.lit(" "))
          .when(n == 2, F.concat_ws("-", F.lit("00"), "trace_id", "span_id"))
          .when(n == 3, F.concat_ws("-", F.lit("01"), "trace_id", "span_id", F.lit("01")))
          .when(n == 4, F.concat_ws("-", F.lit("00"), F.substring("trace_id", 1, 16), "span_id", F.lit("01")))
          .when(n == 5, F.concat_ws("-", F.lit("00"), F.lit("0" * 32), "span_id", F.lit("01")))
          .when(n == 6, F.concat_ws("-", F.lit("00"), "trace_id", "span_id", F.lit("00"))).otherwise(good))
    return s.select("trace_id", "span_id", tp.alias("traceparent"))


# ---------------------------------------------------------------- F-CONN
CONNECTOR_STATES = ["FAILED", "PAUSED", "RUNNING", "RUNNING", "RUNNING", "RUNNING", "RUNNING"]


def _conn_state(c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in CONNECTOR_STATES]), (c % 7 + 1).cast("int"))


def connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    return s.select(F.concat(F.lit("conn-"), _s("s_suppkey")).alias("connector"), "s_suppkey",
                    F.when(F.col("s_suppkey") % 2 == 0, "source").otherwise("sink").alias("type"))


def connector_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier", "s_suppkey").filter(F.col("s_suppkey") % 13 != 0)
    return s.select(F.concat(F.lit("conn-"), _s("s_suppkey")).alias("connector"),
                    _conn_state(F.col("s_suppkey")).alias("state"),
                    F.concat(F.lit("worker-"), _s(F.col("s_suppkey") % 3)).alias("worker_id"))


def connector_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier", "s_suppkey")
    t = s.select("s_suppkey", F.explode(F.sequence(F.lit(0), (F.col("s_suppkey") % 4).cast("int"))).alias("task_id"))
    return t.select(F.concat(F.lit("conn-"), _s("s_suppkey")).alias("connector"), "task_id",
                    _conn_state(F.col("s_suppkey") + F.col("task_id")).alias("state"))


def connector_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier", "s_suppkey")
    h = s.select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return h.select(F.concat(F.lit("conn-"), _s("s_suppkey")).alias("connector"),
                    (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("hour")))
                    .alias("checked_at"),
                    _conn_state(F.col("s_suppkey") + F.col("hour")).alias("state"))


# ---------------------------------------------------------------- F-KEY
# Key shapes of the routing fixture (event_id % 12) and topic sizes.
ROUTING_KEY_PREFIXES = ["ORDER-", "payment-", "INVENTORY-", "PRODUCT-", None, "CUST-", None, "HIGH:", "p2:",
                        "BATCH:", "plain-", None]
TOPIC_SIZES = [1, 3, 6, 9, 12]
VIP_CUSTOMERS = ["VIP-001", "GOLD-001"]


def routing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "props")
    eid = F.col("event_id")
    r = eid % 12
    key = (F.when(r == 4, F.lit("CUSTOMER-VIP-001")).when(r == 6, F.lit("GOLD-001"))
           .when(r == 11, F.lit(None).cast("string"))
           .when(r.isin(3, 5), F.concat(F.element_at(F.array(*[F.lit(p or "") for p in ROUTING_KEY_PREFIXES]),
                                                     (r + 1).cast("int")), _s("user_id")))
           .otherwise(F.concat(F.element_at(F.array(*[F.lit(p or "") for p in ROUTING_KEY_PREFIXES]),
                                            (r + 1).cast("int")), _s(eid))))
    n = F.element_at(F.array(*[F.lit(x) for x in TOPIC_SIZES]), ((eid / 12).cast("long") % 5 + 1).cast("int"))
    return e.select(eid.alias("event_id"), key.alias("key"), F.col("props").alias("value"), n.alias("num_partitions"))


# ---------------------------------------------------------------- F-TEN
TENANT_TIERS = ["BASIC", "STANDARD", "PREMIUM", "ENTERPRISE"]
TIER_MAX_MPS = [100, 500, 2000, 10000]


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    k = F.col("n_nationkey")
    t = (k % 4 + 1).cast("int")
    return n.select(F.concat(F.lit("tenant-"), _s(k)).alias("tenant_id"), F.col("n_name").alias("tenant_name"),
                    F.element_at(F.array(*[F.lit(x) for x in TENANT_TIERS]), t).alias("tier"),
                    (k % 6 != 5).alias("is_active"),
                    F.element_at(F.array(*[F.lit(x) for x in TIER_MAX_MPS]), t).alias("max_messages_per_second"))


def tenant_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props")
    eid = F.col("event_id")
    tid = F.concat(F.lit("tenant-"), _s(F.col("user_id") % 28))
    other = F.concat(F.lit("tenant-"), _s((F.col("user_id") + 1) % 28))
    way = eid % 4
    base_key = F.concat(F.lit("K-"), _s(eid))
    key = (F.when(way == 1, F.concat(tid, F.lit(":"), base_key))
           .when((way == 0) & (eid % 50 == 0), F.concat(other, F.lit(":"), base_key)).otherwise(base_key))
    topic = F.when(way == 2, F.concat(F.lit("tenant-"), tid, F.lit("-order-events"))).otherwise(F.lit("order-events"))
    return e.select(eid.alias("event_id"), topic.alias("topic"), key.alias("key"), F.col("props").alias("value"),
                    F.when(way == 0, tid).alias("tenant_header"),
                    F.when(F.col("event_type") == "signup", F.lit("ALL"))
                     .when(F.col("event_type") == "purchase", F.lit("PREMIUM")).alias("target_tier"))


# ---------------------------------------------------------------- F-INV
def inventory_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    eid = F.col("event_id")
    return e.select(eid.alias("seq"), F.concat(F.lit("PROD-"), _s(F.col("user_id") % 25)).alias("product_id"),
                    F.concat(F.lit("ORD-"), _s(eid)).alias("order_id"), (eid % 5 + 1).cast("int").alias("quantity"),
                    F.when(F.col("event_type") == "error", "RELEASE").otherwise("RESERVE").alias("command"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock rows for products 0..23 (product 24 has none), derived from part keys."""
    p = table(spark, sf_dir, "part", "p_partkey").filter(F.col("p_partkey") < 24)
    return p.select(F.concat(F.lit("PROD-"), _s("p_partkey")).alias("product_id"), F.lit(300).alias("quantity"),
                    F.lit(0).alias("reserved_quantity"))


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock rows of all parts; quantity and reservations differ by part."""
    p = table(spark, sf_dir, "part", "p_partkey")
    k = F.col("p_partkey")
    return p.select(F.concat(F.lit("PART-"), _s(k)).alias("product_id"), (k % 20 + 5).cast("int").alias("quantity"),
                    (k % 3).cast("int").alias("reserved_quantity"))


def stock_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command per order: one in eight for part 1, one in thirteen of the
    others for a part that does not exist, the rest by customer key."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    product = F.when(k % 8 == 0, F.lit("1")).when(k % 13 == 0, F.concat(F.lit("none-"), _s("o_custkey"))).otherwise(_s("o_custkey"))
    return o.select(k.alias("seq"), F.concat(F.lit("PART-"), product).alias("product_id"), F.concat(F.lit("ORD-"), _s(k)).alias("order_id"),
                    (k % 5 + 1).cast("int").alias("quantity"), F.when(k % 7 < 3, "RELEASE").otherwise("RESERVE").alias("command"))


# ---------------------------------------------------------------- F-DLTRAW
DLT_HEADER_PREFIX = "kafka_dlt-"


def _hdr(name: str, value: Column) -> Column:
    return F.struct(F.lit(DLT_HEADER_PREFIX + name).alias("key"), F.encode(value, "UTF-8").alias("value"))


def dead_letter_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records on the ``.DLT`` topics with Spring's dead-letter headers."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "props")
    eid = F.col("event_id")
    saga = eid % 4 == 0
    orig = F.when(saga, F.lit("saga-event-topic")).otherwise(F.lit("order-events"))
    heads = F.array(
        F.when(eid % 5 != 0, _hdr("original-topic", orig)),
        _hdr("original-partition", F.when(eid % 7 == 0, F.lit("x")).otherwise(_s(eid % 3))),
        _hdr("original-offset", _s(eid)),
        F.when(eid % 6 != 0, _hdr("exception-message", F.concat(F.lit("java.lang.IllegalStateException: failed "), _s(eid)))),
        F.when(eid % 4 != 0, _hdr("exception-stacktrace", F.concat(F.lit("at com.example.Handler.handle(Handler.java:"),
                                                                  _s(eid % 100), F.lit(")")))),
        F.when(eid % 9 == 0, _hdr("exception-message", F.concat(F.lit("retry failed "), _s(eid)))),
    )
    return e.select(
        F.concat(orig, F.lit(".DLT")).alias("topic"), (F.col("user_id") % 3).cast("int").alias("partition"),
        eid.alias("offset"), F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(eid % 11 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("key-"), _s("user_id"))).alias("key"),
        F.when(eid % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("props")).alias("value"),
        F.filter(heads, lambda h: h.isNotNull()).alias("headers"))


# ---------------------------------------------------------------- F-AVRO
AVRO_RECORD_TYPES = ["OrderEvent", "PaymentEvent", "InventoryEvent", "Unknown"]


def typed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "value")
    eid, uid = F.col("event_id"), F.col("user_id")
    r = (eid % 4).cast("int")
    ms = _s(F.unix_millis(F.col("ts").cast("timestamp")))
    minor = _s((F.col("value").cast("decimal(19,2)") * 100).cast("long"))
    ev = F.concat(F.lit('{"eventId":"E-'), _s(eid), F.lit('"'))
    order = F.concat(ev, F.lit(',"orderId":"ORD-'), _s(eid), F.lit('"'),
                     F.when(eid % 24 != 0, F.concat(F.lit(',"customerId":"CUST-'), _s(uid), F.lit('"'))).otherwise(F.lit("")),
                     F.lit(',"productId":"PROD-'), _s(uid % 25), F.lit('","quantity":'), _s(eid % 5 + 1),
                     F.lit(',"totalAmount":'), minor, F.lit(',"eventType":"ORDER_CREATED","timestamp":'), ms, F.lit("}"))
    pay = F.concat(ev, F.lit(',"paymentId":"PAY-'), _s(eid), F.lit('","orderId":"ORD-'), _s(eid), F.lit('","amount":'), minor,
                   F.lit(',"currency":"KRW","paymentMethod":"CARD","eventType":"PAYMENT_COMPLETED","timestamp":'), ms, F.lit("}"))
    inv = F.concat(ev, F.lit(',"productId":"PROD-'), _s(uid % 25), F.lit('","orderId":"ORD-'), _s(eid),
                   F.lit('","quantity":'), _s(eid % 5 + 1), F.lit(',"availableStock":'), _s(eid % 30),
                   F.lit(',"eventType":"STOCK_RESERVED","timestamp":'), ms, F.lit("}"))
    val = (F.when(eid % 40 == 5, F.lit("not-json")).when(r == 0, order).when(r == 1, pay).when(r == 2, inv)
           .otherwise(F.concat(ev, F.lit(',"foo":"bar"}'))))
    return e.select(eid.alias("offset"), F.element_at(F.array(*[F.lit(t) for t in AVRO_RECORD_TYPES]), r + 1)
                    .alias("schema_name"), val.alias("value"))


# ---------------------------------------------------------------- F-EOS
def eos_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "props")
    eid = F.col("event_id")
    return e.select(F.lit("eos-input").alias("topic"), (F.col("user_id") % 3).cast("int").alias("partition"),
                    eid.alias("offset"),
                    F.when(eid % 10 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("K-"), _s(eid))).alias("key"),
                    F.when(eid % 8 == 0, F.concat(F.lit('say "hi" '), _s(eid))).otherwise(F.col("props")).alias("value"))


# ---------------------------------------------------------------- F-OUT
OUTBOX_EVENT_CYCLE = ["ORDER_CREATED", "ORDER_CANCELLED", "PAYMENT_COMPLETED"]


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderdate")
    k = F.col("o_orderkey")
    st = F.when(k % 5 <= 2, "PENDING").when(k % 5 == 3, "SENT").otherwise("FAILED")
    return o.select(
        F.concat(F.lit("OB-"), _s(k)).alias("id"), F.lit("Order").alias("aggregate_type"),
        F.concat(F.lit("ORD-"), _s(k)).alias("aggregate_id"),
        F.element_at(F.array(*[F.lit(t) for t in OUTBOX_EVENT_CYCLE]), (k % 3 + 1).cast("int")).alias("event_type"),
        F.concat(F.lit('{"orderId":"ORD-'), _s(k), F.lit('","amount":'), _s(F.col("o_totalprice").cast("decimal(19,2)")),
                 F.lit("}")).alias("payload"),
        F.lit("saga-event-topic").alias("topic"), st.alias("status"), F.col("o_orderdate").alias("created_at"),
        F.when(st == "SENT", F.col("o_orderdate") + F.expr("INTERVAL 5 SECONDS")).alias("processed_at"),
        F.when(st == "FAILED", (k % 3).cast("int")).otherwise(F.lit(0)).alias("retry_count"))


# ---------------------------------------------------------------- F-JDBC
def incremental_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_totalprice")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"),
                    F.col("o_totalprice").cast("decimal(19,2)").alias("payload"))


# ---------------------------------------------------------------- F-PROD
def product_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_retailprice")
    k = F.col("p_partkey")
    v = p.select("*", F.explode(F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)),
                                         lambda x: (x == 1) | ((x == 2) & (k % 2 == 0)) | ((x == 3) & (k % 5 == 0))))
                 .alias("version"))
    t = F.element_at(F.array(F.lit("PRODUCT_REGISTERED"), F.lit("PRODUCT_UPDATED"), F.lit("PRODUCT_DELETED")),
                     F.col("version"))
    price = F.when(F.col("version") == 2, (F.col("p_retailprice") * 1.1).cast("long")).otherwise(
        F.col("p_retailprice").cast("long"))
    return v.select((k * 10 + F.col("version")).alias("offset"), F.concat(F.lit("P-"), _s(k)).alias("product_id"),
                    t.alias("event_type"), F.col("p_name").alias("name"), price.alias("price"),
                    F.col("p_brand").alias("category"))


# ---------------------------------------------------------------- F-PAY
PAYMENT_METHODS = ["CARD", "BANK_TRANSFER", "VIRTUAL_ACCOUNT", "MOBILE", "KAKAO_PAY", "NAVER_PAY", "TOSS_PAY"]


def payment_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process (every order) and cancel (every 4th) commands with the gateway's answers."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    k = F.col("o_orderkey")
    base = o.select(
        F.concat(F.lit("PAY-"), _s(k)).alias("payment_id"), F.concat(F.lit("saga-"), _s(k)).alias("saga_id"),
        F.concat(F.lit("ORD-"), _s(k)).alias("order_id"), F.concat(F.lit("CUST-"), _s("o_custkey")).alias("customer_id"),
        F.col("o_totalprice").cast("decimal(19,2)").alias("amount"),
        F.element_at(F.array(*[F.lit(m) for m in PAYMENT_METHODS]), (k % 7 + 1).cast("int")).alias("method"),
        (k % 6 != 0).alias("gateway_success"), F.concat(F.lit("TX-"), _s(k)).alias("transaction_id"),
        F.concat(F.lit("PK-"), _s(k)).alias("payment_key"),
        F.when(k % 6 == 0, F.lit("Card declined")).alias("gateway_error"),
        ((k % 4 == 3) | (k % 12 == 0)).alias("cancel_requested"), (k % 8 != 7).alias("refund_success"),
        F.concat(F.lit("RF-"), _s(k)).alias("refund_id"),
        F.when(k % 8 == 7, F.lit("Refund window closed")).alias("refund_error"))
    return base
