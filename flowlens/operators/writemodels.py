"""Write models: orders, payments and the product catalog.

Each is "last state per entity" over a command/event log: ``max_by`` over
the log order, one partial+final aggregate per entity id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Texts the payment service writes (kept verbatim).
PAYMENT_FAILED_DEFAULT = "결제 실패"
REFUND_FAILED_TEXT = " (환불 실패: "  # "<reason> (환불 실패: <error>)"


def order_commands(saga_starts: DataFrame, commands: DataFrame, events: DataFrame) -> DataFrame:
    """Order-service commands of the saga flow: CREATE (saga start), CONFIRM
    (INVENTORY_RESERVED of a known saga), CANCEL (CANCEL_ORDER command)."""
    create = saga_starts.select("order_id", F.lit(0).cast("long").alias("seq"), F.lit("CREATE").alias("command"),
                                F.lit(None).cast("string").alias("reason"), "customer_id", "product_id", "quantity",
                                "total_amount", F.col("created_at").alias("at"))
    known = events.join(saga_starts.select("saga_id"), "saga_id", "left_semi")
    confirm = known.filter(F.col("event_type") == "INVENTORY_RESERVED").select(
        "order_id", F.col("offset").alias("seq"), F.lit("CONFIRM").alias("command"), F.lit(None).cast("string").alias("reason"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("customer_id", "string"), ("product_id", "string"),
                                                    ("quantity", "int"), ("total_amount", "decimal(19,2)"))],
        F.col("event_ts").alias("at"))
    sagas = saga_starts.select("saga_id", "order_id")
    cancel = commands.filter(F.col("command") == "CANCEL_ORDER").join(sagas, "saga_id").select(
        "order_id", "seq", F.lit("CANCEL").alias("command"), "reason",
        *[F.lit(None).cast(t).alias(c) for c, t in (("customer_id", "string"), ("product_id", "string"),
                                                    ("quantity", "int"), ("total_amount", "decimal(19,2)"))],
        F.lit(None).cast("timestamp_ntz").alias("at"))
    return create.unionByName(confirm).unionByName(cancel)


def orders_write_model(cmds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(orders, rejected). create → PENDING; confirm → CONFIRMED;
    cancel → CANCELLED + reason; fail → FAILED + reason. Commands for an
    order never created are rejected ("Order not found")."""
    st = (F.when(F.col("command") == "CREATE", "PENDING").when(F.col("command") == "CONFIRM", "CONFIRMED")
          .when(F.col("command") == "CANCEL", "CANCELLED").when(F.col("command") == "FAIL", "FAILED"))
    c = cmds.withColumn("_st", st)
    g = c.groupBy("order_id").agg(
        F.max_by(F.struct("customer_id", "product_id", "quantity", "total_amount", "at"),
                 F.when(F.col("command") == "CREATE", F.col("seq"))).alias("_c"),
        F.max_by(F.struct(F.col("_st").alias("status"), F.col("reason")), F.col("seq")).alias("_last"))
    created = g.filter(F.col("_c").isNotNull())
    orders = created.select("order_id", F.col("_c.customer_id").alias("customer_id"),
                            F.col("_c.product_id").alias("product_id"), F.col("_c.quantity").alias("quantity"),
                            F.col("_c.total_amount").alias("total_amount"), F.col("_last.status").alias("status"),
                            F.col("_last.reason").alias("failure_reason"), F.col("_c.at").alias("created_at"))
    rejected = cmds.join(created.select("order_id"), "order_id", "left_anti").select(
        "order_id", "seq", "command", F.lit("Order not found").alias("error"))
    return orders, rejected


def order_projection(orders: DataFrame) -> DataFrame:
    """Write-model order as a response."""
    return orders.select("order_id", "customer_id", "product_id", "quantity", "total_amount", "status",
                         "failure_reason", "created_at")


def payments_write_model(cmds: DataFrame) -> DataFrame:
    """Gateway success → COMPLETED with transaction id and key; failure →
    FAILED with the gateway's message; a cancel → CANCELLED whatever the
    status was, and even when the refund fails (reason suffixed, no refund id).
    ``emitted_event`` is the last event published for the payment;
    :func:`payment_events` gives them all."""
    ok = F.col("gateway_success")
    cancel = F.col("cancel_requested")
    refund_ok = F.col("refund_success")
    reason = F.lit("Order cancelled")
    failed_reason = F.coalesce("gateway_error", F.lit(PAYMENT_FAILED_DEFAULT))
    cancel_reason = F.when(refund_ok, reason).otherwise(
        F.concat(reason, F.lit(REFUND_FAILED_TEXT), F.col("refund_error"), F.lit(")")))
    return cmds.select(
        "payment_id", "saga_id", "order_id", "customer_id", "amount", "method",
        F.when(cancel, "CANCELLED").when(ok, "COMPLETED").otherwise("FAILED").alias("status"),
        F.when(ok, F.col("transaction_id")).alias("transaction_id"), F.when(ok, F.col("payment_key")).alias("payment_key"),
        F.when(cancel, cancel_reason).when(~ok, failed_reason).alias("failure_reason"),
        F.when(cancel & refund_ok, F.col("refund_id")).alias("refund_id"),
        F.when(cancel, "PAYMENT_CANCELLED").when(ok, "PAYMENT_COMPLETED").otherwise("PAYMENT_FAILED").alias("emitted_event"))


def payment_events(cmds: DataFrame) -> DataFrame:
    """Every event a payment publishes, in order: the gateway's answer,
    then the cancellation if one was requested."""
    first = F.when(F.col("gateway_success"), "PAYMENT_COMPLETED").otherwise("PAYMENT_FAILED")
    events = F.when(F.col("cancel_requested"), F.array(first, F.lit("PAYMENT_CANCELLED"))).otherwise(F.array(first))
    return cmds.select("payment_id", "saga_id", "order_id", F.posexplode(events).alias("seq", "event_type"))


def payments_by(payments: DataFrame, *, status=None, order_id=None, saga_id=None) -> DataFrame:
    """Derived filters."""
    f = payments
    if status is not None:
        f = f.filter(F.col("status") == status)
    if order_id is not None:
        f = f.filter(F.col("order_id") == order_id)
    if saga_id is not None:
        f = f.filter(F.col("saga_id") == saga_id)
    return f


def product_catalog(events: DataFrame) -> DataFrame:
    """registered/updated/deleted events → current products; DELETED is
    the tombstone (latest event per product by offset)."""
    g = events.groupBy("product_id").agg(
        F.max_by(F.struct("event_type", "name", "price", "category", "offset"), F.col("offset")).alias("_l"))
    live = g.filter(F.col("_l.event_type") != "PRODUCT_DELETED")
    return live.select("product_id", F.col("_l.name").alias("name"), F.col("_l.price").alias("price"),
                       F.col("_l.category").alias("category"), F.col("_l.offset").alias("version_offset"))
