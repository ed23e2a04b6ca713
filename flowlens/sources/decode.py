"""Typed decoding of topic records.

Records arrive as ``(topic, partition, offset, key, value)`` rows, the layout
of Spark's Kafka source, or any file source with the same columns. Decoding
is ``from_json`` with an explicit schema — never inferred — so it runs
JVM-side inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.sources import schemas as S
from flowlens.sources.fixtures import SAGA_EVENT_TYPES

# Microsecond timestamps survive an encode/decode round trip.
JSON_OPTS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def encode_order_events(events: DataFrame, topic: str = "order-events") -> DataFrame:
    """Order events -> topic records keyed by product id, JSON value."""
    body = F.struct(
        F.col("order_id").alias("orderId"), F.col("product_id").alias("productId"),
        F.col("product_name").alias("productName"), "quantity", "price",
        F.col("customer_id").alias("customerId"), F.col("event_type").alias("eventType"),
        F.col("timestamp"),
    )
    return events.select(F.lit(topic).alias("topic"), "partition", "offset",
                         F.col("product_id").alias("key"), F.to_json(body, JSON_OPTS).alias("value"))


def decode_order_events(records: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """JSON order events -> typed rows plus the derived ``total_amount``.

    ``mode="FAILFAST"`` reproduces a serde that throws on a bad record; the
    default drops records whose value is not an order event.
    """
    p = F.from_json(F.col("value"), S.ORDER_EVENT_JSON, {**JSON_OPTS, "mode": mode})
    d = records.select("topic", "partition", "offset", p.alias("e"))
    d = d.filter(F.col("e.orderId").isNotNull() & F.col("e.eventType").isin(*S.ORDER_EVENT_TYPES))
    return d.select(
        "topic", "partition", "offset",
        F.col("e.orderId").alias("order_id"), F.col("e.productId").alias("product_id"),
        F.col("e.productName").alias("product_name"), F.col("e.quantity").alias("quantity"),
        F.col("e.price").alias("price"), F.col("e.customerId").alias("customer_id"),
        F.col("e.eventType").alias("event_type"), F.col("e.timestamp").alias("timestamp"),
        (F.col("e.price") * F.col("e.quantity").cast("decimal(10,0)")).cast("decimal(38,2)").alias("total_amount"),
    )


ENVELOPE_JSON = "eventType STRING, payload STRING"


def _is_text_token(key: str):
    """True when ``key``'s value in the JSON text is a string token.

    ``from_json`` hands back an object's raw text for a STRING field, so the
    token type is read from the text: an escaped key inside a nested string
    (``\\"key\\"``) cannot match, a top-level one followed by ``"`` can."""
    return F.col("value").rlike(r'"' + key + r'"\s*:\s*"')


def parse_once(df, expr, alias: str):
    """Evaluate ``expr`` once per row as column ``alias``.

    A ``Generate`` (inline over a one-element array) is a barrier: filters on
    its output are not pushed below it, so an expensive parse is never
    copied into pushed-down predicates or join conditions."""
    keep = [c for c in df.columns]
    return df.select(*keep, F.inline(F.array(F.struct(expr.alias(alias)))))


def decode_saga_envelope(records: DataFrame, event_types=SAGA_EVENT_TYPES) -> DataFrame:
    """``{"eventType": T, "payload": "<json text>"}`` -> typed saga events.

    Dropped, as the consumers do: unparsable JSON, a missing or non-text
    payload, a missing or non-text type, and types outside ``event_types``.
    Each JSON document is parsed exactly once (envelope, then payload).
    """
    r = records.select("offset", "value", _is_text_token("eventType").alias("_t1"),
                       _is_text_token("payload").alias("_t2"))
    r = parse_once(r, F.from_json(F.col("value"), ENVELOPE_JSON), "env")
    r = r.select("offset", F.when(F.col("_t1"), F.col("env.eventType")).alias("event_type"),
                 F.when(F.col("_t2"), F.col("env.payload")).alias("payload"))
    r = r.filter(F.col("payload").isNotNull() & F.col("event_type").isin(*event_types))
    r = parse_once(r, F.from_json(F.col("payload"), S.SAGA_PAYLOAD_JSON), "p")
    return r.select(
        "offset", "event_type",
        F.col("p.sagaId").alias("saga_id"), F.col("p.orderId").alias("order_id"),
        F.col("p.customerId").alias("customer_id"), F.col("p.productId").alias("product_id"),
        F.col("p.quantity").alias("quantity"), F.col("p.totalAmount").alias("total_amount"),
        F.col("p.paymentId").alias("payment_id"), F.col("p.amount").alias("amount"),
        F.col("p.reason").alias("reason"), F.col("p.requestedQuantity").alias("requested_quantity"),
        F.col("p.availableQuantity").alias("available_quantity"),
        F.col("p.timestamp").alias("event_ts"), "payload",
    )
