"""Saga commands with their data (A7) and their outbox rows.

:func:`flowlens.operators.saga.saga_command_log` says which command each event
causes. A published command carries more: the saga's order, and, by its type,
customer, product, quantity and amount. These are fields of the saga's start
row, so they come from one equi-join on the saga id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators.saga import saga_command_log

# The fields of each command, in the order of its JSON.
COMMAND_FIELDS = {
    "CREATE_ORDER": ("customer_id", "product_id", "quantity", "total_amount"),
    "PROCESS_PAYMENT": ("customer_id", "amount"),
    "RESERVE_INVENTORY": ("product_id", "quantity"),
    "CANCEL_PAYMENT": ("payment_id", "reason"),
    "CANCEL_ORDER": ("reason",),
}
JSON_NAMES = {"saga_id": "sagaId", "order_id": "orderId", "customer_id": "customerId", "product_id": "productId",
              "quantity": "quantity", "total_amount": "totalAmount", "amount": "amount", "payment_id": "paymentId", "reason": "reason"}
COMMAND_COLUMNS = ("saga_id", "seq", "command", *[c for c in JSON_NAMES if c != "saga_id"])


def _has(field: str) -> Column:
    return F.col("command").isin(*[c for c, fields in COMMAND_FIELDS.items() if field in fields])


def with_data(commands: DataFrame) -> DataFrame:
    """Rows with saga_id, seq, command, payment_id, reason and the saga's fields
    → the columns of a published command; fields that its type lacks are null."""
    src = {"amount": "total_amount"}
    cols = [F.when(_has(f), F.col(src.get(f, f))).alias(f) for f in JSON_NAMES if f not in ("saga_id", "order_id")]
    return commands.select("saga_id", "seq", "command", "order_id", *cols)


def payload() -> Column:
    """The command as JSON: its fields in order, those it lacks left out."""
    return F.to_json(F.struct(*[F.col(c).alias(n) for c, n in JSON_NAMES.items()]))


def saga_commands(starts: DataFrame, events: DataFrame) -> DataFrame:
    """Every published command with its fields."""
    log = saga_command_log(starts, events).select("saga_id", "seq", "command", "payment_id", "reason")
    fields = starts.select("saga_id", "order_id", "customer_id", "product_id", "quantity", "total_amount")
    return with_data(log.join(fields, "saga_id"))


def command_outbox(commands: DataFrame, topic: str = "saga-command-topic") -> DataFrame:
    """Commands → PENDING outbox rows."""
    return commands.select(F.lit("Saga").alias("aggregate_type"), F.col("saga_id").alias("aggregate_id"), "seq",
                           F.col("command").alias("event_type"), payload().alias("payload"), F.lit(topic).alias("topic"),
                           F.lit("PENDING").alias("status"))
