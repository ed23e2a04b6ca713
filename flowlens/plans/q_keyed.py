"""Catalog: published commands with their data, keyed-state streams, atomic outputs,
polled extracts, deep pages, circuit states and stock over all parts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flowlens.operators import commands as K
from flowlens.operators import inventory as I
from flowlens.operators import ops as O
from flowlens.operators import routing as R
from flowlens.operators.paging import SortedPages
from flowlens.plans.q_inventory import _FOLD
from flowlens.plans.q_projections import _ATTR, _HISTORY, _PREFIX, _SAGA, _STATS, _SUM_COLS, _SUMMARY, _events, _summary
from flowlens.plans.q_sources import _CMDLOG, PROCESSED_AT_MS
from flowlens.plans.q_state import _COMPACT
from flowlens.plans.registry import ORACLE, register
from flowlens.session import scratch_path
from flowlens.sources import connectors as C
from flowlens.sources import fixtures as fx
from flowlens.sources.fixtures_sql import SQL, with_fixtures
from flowlens.sources.tables import streaming_tables
from flowlens.streaming import jobs as J
from flowlens.streaming import keyed, ordered
from flowlens.streaming.manifest import AtomicOutputs
from flowlens.streaming.polling import PolledExtract

# ------------------------------------------------------------------ A7, S16, ST5: commands with their data
_COMMANDS = """SELECT saga_id, seq, command, order_id,
  CASE WHEN command IN ('CREATE_ORDER', 'PROCESS_PAYMENT') THEN customer_id END AS customer_id,
  CASE WHEN command IN ('CREATE_ORDER', 'RESERVE_INVENTORY') THEN product_id END AS product_id,
  CASE WHEN command IN ('CREATE_ORDER', 'RESERVE_INVENTORY') THEN quantity END AS quantity,
  CASE WHEN command = 'CREATE_ORDER' THEN total_amount END AS total_amount,
  CASE WHEN command = 'PROCESS_PAYMENT' THEN total_amount END AS amount,
  CASE WHEN command = 'CANCEL_PAYMENT' THEN payment_id END AS payment_id,
  CASE WHEN command IN ('CANCEL_PAYMENT', 'CANCEL_ORDER') THEN reason END AS reason
FROM cmdlog JOIN saga_starts USING (saga_id)"""


def _text(name: str, col: str) -> str:
    return f"coalesce(',\"{name}\":\"' || replace(replace({col}, '\\', '\\\\'), '\"', '\\\"') || '\"', '')"


def _number(name: str, col: str) -> str:
    return f"coalesce(',\"{name}\":' || CAST({col} AS VARCHAR), '')"


_PAYLOAD = ("'{\"sagaId\":\"' || saga_id || '\"' || " + " || ".join([
    _text("orderId", "order_id"), _text("customerId", "customer_id"), _text("productId", "product_id"), _number("quantity", "quantity"),
    _number("totalAmount", "total_amount"), _number("amount", "amount"), _text("paymentId", "payment_id"), _text("reason", "reason")])
    + " || '}'")


def _with_commands(body: str) -> str:
    return with_fixtures(body, "saga_decoded", "saga_starts", extra={"pre": _PREFIX, "cmdlog": _CMDLOG, "commands": _COMMANDS})


@register("saga_commands", _with_commands("SELECT * FROM commands"))
def q_saga_commands(spark, sf):
    """Every command with its reference fields."""
    return K.saga_commands(fx.saga_starts(spark, sf), _events(spark, sf))


@register("outbox_commands", _with_commands(
    f"SELECT 'Saga' AS aggregate_type, saga_id AS aggregate_id, seq, command AS event_type, {_PAYLOAD} AS payload, "
    "'saga-command-topic' AS topic, 'PENDING' AS status FROM commands"))
def q_outbox_commands(spark, sf):
    """Outbox rows whose payload is the whole command."""
    return K.command_outbox(K.saga_commands(fx.saga_starts(spark, sf), _events(spark, sf)))


@register("stream_saga_commands", _with_commands("SELECT * FROM commands"))
def q_stream_saga_commands(spark, sf):
    """ST5 with A7: commands given by keyed state, each once."""
    return keyed.run_sagas(spark, sf)[0]


@register("stream_saga_states", with_fixtures("SELECT * FROM sagas", "saga_decoded", "saga_starts", extra={"pre": _PREFIX, "sagas": _SAGA}))
def q_stream_saga_states(spark, sf):
    """ST5 with A6: saga states from keyed state, without history."""
    return keyed.run_sagas(spark, sf)[1]


# ------------------------------------------------------------------ ST6 with A5 and A4
@register("stream_customer_stats", with_fixtures("SELECT * FROM stats", "saga_decoded", extra={"attr": _ATTR, "stats": _STATS}))
def q_stream_customer_stats(spark, sf):
    return keyed.run_customer_stats(spark, sf)


@register("stream_order_history", with_fixtures("SELECT * FROM hist", "saga_decoded", extra={"hist": _HISTORY}))
def q_stream_order_history(spark, sf):
    return keyed.run_history(spark, sf)


# ------------------------------------------------------------------ A9, J9, P26, F26, ST9: stock over all parts
def _stock_sql(body: str) -> str:
    fix = f"inventory_commands AS ({SQL['stock_commands']}), inventory AS ({SQL['stock']})"
    return f"WITH outcomes AS (WITH RECURSIVE {fix}, {_FOLD}) {body}"


def _outcomes(spark, sf):
    return I.inventory_reservations(fx.stock_commands(spark, sf), fx.stock(spark, sf))


@register("stock_reservations", _stock_sql("SELECT * FROM outcomes"))
def q_stock_reservations(spark, sf):
    """A9 over all parts, one of them hot."""
    return _outcomes(spark, sf)


@register("stock_matches", with_fixtures("""
SELECT c.*, i.quantity AS stock_quantity, i.reserved_quantity, i.quantity IS NOT NULL AS found,
  CASE WHEN i.quantity IS NULL THEN 'Inventory not found' END AS reason
FROM stock_commands c LEFT JOIN stock i USING (product_id)""", "stock_commands", "stock"))
def q_stock_matches(spark, sf):
    """J9 over all parts."""
    return I.reserve_against_stock(fx.stock_commands(spark, sf), fx.stock(spark, sf))


@register("stock_available", with_fixtures("SELECT product_id, quantity - reserved_quantity AS available_quantity FROM stock", "stock"))
def q_stock_available(spark, sf):
    """F26 over all parts."""
    return fx.stock(spark, sf).select("product_id", I.available_stock().alias("available_quantity"))


@register("stock_projection", _stock_sql(f"""SELECT i.product_id, i.quantity, coalesce(o.reserved_after, i.reserved_quantity) AS reserved_quantity,
  i.quantity - coalesce(o.reserved_after, i.reserved_quantity) AS available_quantity
FROM ({SQL['stock']}) i LEFT JOIN (SELECT product_id, arg_max(reserved_after, seq) AS reserved_after FROM outcomes
  WHERE outcome <> 'NOT_FOUND' GROUP BY product_id) o USING (product_id)"""))
def q_stock_projection(spark, sf):
    """P26 over all parts."""
    return I.inventory_after(fx.stock(spark, sf), _outcomes(spark, sf))


@register("stream_stock", _stock_sql("SELECT * FROM outcomes"))
def q_stream_stock(spark, sf):
    """ST9 over all parts: commands buffered in state and applied in order."""
    return ordered.run_ordered_stock(spark, lambda: fx.stock_commands(spark, sf), fx.stock(spark, sf))


# ------------------------------------------------------------------ ST3, ST4, ST7, ST8
@register("stream_first_delivery", ORACLE["stream_dedup"])
def q_stream_first_delivery(spark, sf):
    """ST3: first deliveries by (offset, delivery), ids with a time to live."""
    return ordered.run_first_deliveries(spark, sf)


@register("stream_latest_state", with_fixtures("SELECT * FROM compacted", "state_changelog", extra={"compacted": _COMPACT}))
def q_stream_latest_state(spark, sf):
    """ST4: compaction whose deleted keys leave the state."""
    return ordered.run_compaction(spark, sf)


def _records(spark, sf):
    return fx.activity_log(spark, sf).select("topic", "partition", "offset", "key", "record_ts")


@register("stream_size_or_time", with_fixtures("""SELECT topic, "partition", "offset", key, record_ts,
  (row_number() OVER (PARTITION BY topic, "partition" ORDER BY "offset") - 1) // 100 AS chunk FROM activity_log""", "activity_log"))
def q_stream_size_or_time(spark, sf):
    """ST7: groups of at most 100 records of a partition."""
    return ordered.run_size_or_time(spark, lambda: _records(spark, sf), 100)


@register("stream_sample_latest", ORACLE["sample_latest"])
def q_stream_sample_latest(spark, sf):
    """ST8 as a stream: the newest record of every hour so far."""
    with streaming_tables(1):
        s = J.sample_latest(_records(spark, sf), "record_ts", "1 hour")
    return J.run_available_now(spark, s, "sample", "update", ["interval_start"]).withColumn(
        "interval_start", F.col("interval_start").cast("timestamp_ntz"))


# ------------------------------------------------------------------ S12, S13: outputs that appear together
def _atomic(spark, sf) -> AtomicOutputs:
    base = scratch_path(spark, f"eos-atomic-{uuid.uuid4().hex[:12]}")
    out = AtomicOutputs(spark, base)
    makes = {"output": lambda b: C.exactly_once_transform(b, PROCESSED_AT_MS), "audit": lambda b: C.eos_audit(b, PROCESSED_AT_MS)}
    with streaming_tables():
        src = fx.eos_input(spark, sf)
    q = J.start_stream(spark, src.writeStream.foreachBatch(lambda b, i: out.write(b, i, makes))
                       .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True))
    q.awaitTermination()
    return out


@register("exactly_once_atomic", ORACLE["exactly_once_transform"])
def q_exactly_once_atomic(spark, sf):
    """Transformed records of published batches."""
    return _atomic(spark, sf).read("output")


@register("exactly_once_atomic_audit", ORACLE["eos_audit"])
def q_exactly_once_atomic_audit(spark, sf):
    """Audit rows, published together with the records."""
    return _atomic(spark, sf).read("audit")


# ------------------------------------------------------------------ S8: polled extract
@register("polled_extract", with_fixtures("SELECT * FROM incremental_source", "incremental_source"))
def q_polled_extract(spark, sf):
    """Three polls over a table that grows give each row once."""
    src = fx.incremental_source(spark, sf)
    base = scratch_path(spark, f"polled-{uuid.uuid4().hex[:12]}")
    for until in ("1995-01-01 00:00:00", "1998-01-01 00:00:00", None):
        grown = src if until is None else src.filter(F.col("updated_at") < F.lit(until).cast("timestamp_ntz"))
        polled = PolledExtract(spark, lambda rows=grown: rows, base)
        polled.poll()
    return polled.rows()


# ------------------------------------------------------------------ T3: deep pages
@register("deep_page", with_fixtures(f"""SELECT {_SUM_COLS}, rank, total_elements, total_pages FROM (
  SELECT *, row_number() OVER (ORDER BY total_amount DESC, order_id) AS rank, count(*) OVER () AS total_elements,
    CAST(ceil(count(*) OVER () / 20) AS BIGINT) AS total_pages FROM summ) WHERE rank > 60 * 20 AND rank <= 61 * 20""",
                                     "saga_decoded", extra={"summ": _SUMMARY}))
def q_deep_page(spark, sf):
    """Page 60 of the orders by amount, read from the partition that holds it."""
    return SortedPages(_summary(spark, sf), "total_amount", descending=True, key="order_id").page(60, 20)


# ------------------------------------------------------------------ J8: broadcast to an explicit list
_TARGETS = """SELECT *, CASE event_id % 3 WHEN 0 THEN ['tenant-' || (event_id % 28), 'tenant-' || (event_id % 7), 'tenant-' || (event_id % 28)]
  WHEN 1 THEN ['tenant-' || (event_id % 25)] END AS target_ids FROM tenant_messages"""


@register("tenant_broadcast_list", with_fixtures("""SELECT event_id, topic, key, value, x.tenant_id FROM (
  SELECT event_id, topic, key, value, unnest(list_distinct(target_ids)) AS tenant_id FROM m WHERE target_ids IS NOT NULL) x
JOIN tenants t ON x.tenant_id = t.tenant_id WHERE t.is_active""", "tenant_messages", "tenants", extra={"m": _TARGETS}))
def q_tenant_broadcast_list(spark, sf):
    """A copy per active tenant of a message's own list."""
    m = fx.tenant_messages(spark, sf)
    name = lambda n: F.concat(F.lit("tenant-"), (F.col("event_id") % n).cast("string"))
    ids = F.when(F.col("event_id") % 3 == 0, F.array(name(28), name(7), name(28))).when(F.col("event_id") % 3 == 1, F.array(name(25)))
    out = R.tenant_broadcast_to(m.withColumn("target_ids", ids), fx.tenants(spark, sf))
    return out.select("event_id", "topic", "key", "value", "tenant_id")


# ------------------------------------------------------------------ W6: both rates
def _circuit_sql() -> str:
    parts = []
    for name, (window, least, failed_at, slow_at, slow_ms) in O.CIRCUITS.items():
        parts.append(f"""SELECT '{name}' AS circuit, topic, "offset", failure_rate, calls, slow_call_rate,
  CASE WHEN failure_rate >= {failed_at} OR slow_call_rate >= {slow_at} THEN 'OPEN' ELSE 'CLOSED' END AS state FROM (
  SELECT topic, "offset", count(*) OVER w AS calls,
    CASE WHEN count(*) OVER w >= {least} THEN avg(CASE WHEN outcome = 'FAILED' THEN 1 ELSE 0 END) OVER w * 100 END AS failure_rate,
    CASE WHEN count(*) OVER w >= {least} THEN avg(CASE WHEN ms >= {slow_ms} THEN 1 ELSE 0 END) OVER w * 100 END AS slow_call_rate
  FROM (SELECT *, epoch_ms(consumed_ts) - epoch_ms(record_ts) AS ms FROM activity_log)
  WINDOW w AS (PARTITION BY topic ORDER BY "offset" ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW))""")
    return with_fixtures(" UNION ALL ".join(parts), "activity_log")


@register("circuit_states", _circuit_sql())
def q_circuit_states(spark, sf):
    """Failure and slow-call rates under the three configurations."""
    ms = F.unix_millis(F.col("consumed_ts").cast("timestamp")) - F.unix_millis(F.col("record_ts").cast("timestamp"))
    return O.circuit_states(fx.activity_log(spark, sf), ms)
