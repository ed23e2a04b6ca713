"""Explicit schemas of every record type (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

# Enumerations of the reference's data model.
ORDER_EVENT_TYPES = ["CREATED", "CONFIRMED", "CANCELLED", "REFUNDED"]
ORDER_STATUSES = ["PENDING", "CONFIRMED", "CANCELLED", "FAILED"]
PAYMENT_STATUSES = ["PENDING", "COMPLETED", "FAILED", "CANCELLED"]
OUTBOX_STATUSES = ["PENDING", "SENT", "FAILED"]
FAILED_MESSAGE_STATUSES = ["PENDING", "RETRIED", "RESOLVED", "IGNORED"]
SAGA_STATUSES = ["STARTED", "ORDER_PENDING", "ORDER_CREATED", "PAYMENT_PENDING", "PAYMENT_COMPLETED",
                 "INVENTORY_PENDING", "COMPLETED", "COMPENSATING", "COMPENSATED", "FAILED"]
SAGA_STEPS = ["CREATE_ORDER", "PROCESS_PAYMENT", "RESERVE_INVENTORY", "COMPLETE_SAGA",
              "CANCEL_PAYMENT", "CANCEL_ORDER", "RELEASE_INVENTORY"]
OUTBOX_EVENT_TYPES = ["PRODUCT_REGISTERED", "PRODUCT_UPDATED", "PRODUCT_DELETED",
                      "CREATE_ORDER", "CANCEL_ORDER", "PROCESS_PAYMENT", "CANCEL_PAYMENT",
                      "RESERVE_INVENTORY", "RELEASE_INVENTORY",
                      "ORDER_CREATED", "ORDER_CANCELLED", "PAYMENT_COMPLETED", "PAYMENT_FAILED",
                      "PAYMENT_CANCELLED", "INVENTORY_RESERVED", "INVENTORY_FAILED", "INVENTORY_RELEASED"]

ORDER_EVENT_JSON = T.StructType([
    T.StructField("orderId", T.StringType()),
    T.StructField("productId", T.StringType()),
    T.StructField("productName", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("price", T.DecimalType(19, 2)),
    T.StructField("customerId", T.StringType()),
    T.StructField("eventType", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])

# Superset of the eight saga event payloads; absent fields decode as NULL.
SAGA_PAYLOAD_JSON = T.StructType([
    T.StructField("sagaId", T.StringType()),
    T.StructField("orderId", T.StringType()),
    T.StructField("customerId", T.StringType()),
    T.StructField("productId", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("totalAmount", T.DecimalType(19, 2)),
    T.StructField("paymentId", T.StringType()),
    T.StructField("amount", T.DecimalType(19, 2)),
    T.StructField("reason", T.StringType()),
    T.StructField("requestedQuantity", T.IntegerType()),
    T.StructField("availableQuantity", T.IntegerType()),
    T.StructField("timestamp", T.TimestampNTZType()),
])

# Topic record layout (Spark's Kafka source with includeHeaders=true).
HEADER = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())])
RECORD = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("headers", T.ArrayType(HEADER)),
])
