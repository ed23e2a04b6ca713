"""Event-sourced projections: event store, order summary, history and
customer statistics (A3–A5, A10–A12, A42, J1, J2, P1–P5, P19, P20, P24, T2–T4,
W1, F2, F20).

Input is the decoded saga event stream of :func:`flowlens.sources.decode.
decode_saga_envelope` (``offset`` = arrival order).

The order summary is *not* a sequential fold here. ORDER_CREATED overwrites
the row, and every later event sets a fixed group of fields, so the final
row is: the last CREATED, plus — for each field group — the last event that
sets it *if* it arrived after that CREATED. ``max_by`` per group is
associative, so the whole view is one partial+final aggregate per order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators.common import prefix_scan

ORDER_AGGREGATE = "Order"


def _is(*types) -> Column:
    return F.col("event_type").isin(*types)


# ------------------------------------------------------------------ event store
def event_store_append(events: DataFrame, existing: DataFrame | None = None,
                       aggregate_type: str = ORDER_AGGREGATE) -> DataFrame:
    """One store row per event; ``version`` = existing max + rank of
    the event within its aggregate by arrival."""
    rows = events.select(F.lit(aggregate_type).alias("aggregate_type"), F.col("order_id").alias("aggregate_id"),
                         "saga_id", "event_type", "payload", F.col("event_ts").alias("event_ts"), "offset")
    rows = prefix_scan(rows, ["aggregate_type", "aggregate_id"], "offset", [("version", "sum", F.lit(1).cast("long"), True)])
    if existing is not None:
        base = existing.groupBy("aggregate_type", "aggregate_id").agg(F.max("version").alias("_base"))
        rows = (rows.join(base, ["aggregate_type", "aggregate_id"], "left")
                .withColumn("version", F.col("version") + F.coalesce("_base", F.lit(0))).drop("_base"))
    return rows


def event_count_by_aggregate(store: DataFrame) -> DataFrame:
    """Event count and max version per aggregate."""
    return store.groupBy("aggregate_type", "aggregate_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.max("version").alias("max_version"))


def events_by(store: DataFrame, *, event_type=None, saga_id=None, aggregate=None, from_version=None) -> DataFrame:
    """Store reads — by type; by saga (timestamp order); by aggregate or
    from a version (version order)."""
    f = store
    if event_type is not None:
        f = f.filter(F.col("event_type") == event_type)
    if saga_id is not None:
        f = f.filter(F.col("saga_id") == saga_id)
    if aggregate is not None:
        f = f.filter((F.col("aggregate_type") == aggregate[0]) & (F.col("aggregate_id") == aggregate[1]))
    if from_version is not None:
        f = f.filter(F.col("version") > from_version)
    order = ["event_ts", "version"] if saga_id is not None else ["aggregate_id", "version"]
    return f.orderBy(*order)


def replay_events(store: DataFrame, schema, required: list[str], aggregate=None) -> DataFrame:
    """Payloads decoded as one event class in version order; payloads
    missing a required field do not decode and are skipped."""
    f = store if aggregate is None else store.filter(
        (F.col("aggregate_type") == aggregate[0]) & (F.col("aggregate_id") == aggregate[1]))
    d = f.select("aggregate_id", "version", F.from_json("payload", schema).alias("e"))
    ok = F.lit(True)
    for r in required:
        ok = ok & F.col(f"e.{r}").isNotNull()
    return d.filter(ok).select("aggregate_id", "version", "e.*").orderBy("aggregate_id", "version")


def event_projection(store: DataFrame) -> DataFrame:
    """Event-store row as a response."""
    return store.select(F.col("aggregate_id"), "aggregate_type", "saga_id", "event_type", "version",
                        F.col("event_ts").alias("timestamp"), "payload")


# ------------------------------------------------------------------ history
def history_description(t: Column | None = None) -> Column:
    """per-type description text; decimals print at their scale."""
    s = lambda c: F.col(c).cast("string")
    return (F.when(_is("ORDER_CREATED"), F.concat(F.lit("Order created with amount "), s("total_amount"),
                                                  F.lit(" for "), s("quantity"), F.lit(" items")))
            .when(_is("ORDER_CANCELLED"), F.concat(F.lit("Order cancelled: "), F.col("reason")))
            .when(_is("PAYMENT_COMPLETED"), F.concat(F.lit("Payment of "), s("amount"), F.lit(" completed (paymentId: "),
                                                     F.col("payment_id"), F.lit(")")))
            .when(_is("PAYMENT_FAILED"), F.concat(F.lit("Payment failed: "), F.col("reason")))
            .when(_is("PAYMENT_CANCELLED"), F.concat(F.lit("Payment cancelled: "), F.col("reason")))
            .when(_is("INVENTORY_RESERVED"), F.concat(F.lit("Inventory reserved: "), s("quantity"), F.lit(" units of "),
                                                      F.col("product_id")))
            .when(_is("INVENTORY_FAILED"), F.concat(F.lit("Inventory failed: "), F.col("reason"), F.lit(" (requested: "),
                                                    s("requested_quantity"), F.lit(", available: "),
                                                    s("available_quantity"), F.lit(")")))
            .when(_is("INVENTORY_RELEASED"), F.concat(F.lit("Inventory released: "), s("quantity"), F.lit(" units of "),
                                                      F.col("product_id"))))


def order_history_view(events: DataFrame) -> DataFrame:
    """A4: one history row per event; INVENTORY_RESERVED adds ORDER_CONFIRMED.
    Timestamps are event time (the reference stamps wall clock)."""
    base = events.select("offset", "order_id", "saga_id", "event_type", "payload", "event_ts",
                         history_description().alias("description"))
    confirmed = F.struct(F.lit(1).alias("n"), F.lit("ORDER_CONFIRMED").alias("t"), F.lit(None).cast("string").alias("d"),
                         F.lit("Order confirmed successfully").alias("x"))
    own = F.struct(F.lit(0).alias("n"), F.col("event_type").alias("t"), F.col("payload").alias("d"),
                   F.col("description").alias("x"))
    rows = base.select("offset", "order_id", "saga_id", "event_ts", F.explode(
        F.when(_is("INVENTORY_RESERVED"), F.array(own, confirmed)).otherwise(F.array(own))).alias("h"))
    return rows.select(
        F.concat_ws("-", F.col("offset").cast("string"), F.col("h.n").cast("string")).alias("history_id"),
        "order_id", "saga_id", F.col("h.t").alias("event_type"), F.col("h.d").alias("event_data"),
        F.col("h.x").alias("description"), F.col("event_ts").alias("timestamp"))


def history_projection(history: DataFrame, detail: bool = False) -> DataFrame:
    """P5: history rows without (or, ``detail``, with) ``event_data``."""
    cols = ["history_id", "order_id", "event_type", "description", "timestamp"]
    return history.select(*(cols + (["event_data"] if detail else [])))


def order_history(history: DataFrame, order_id: str, descending: bool = False) -> DataFrame:
    """T4: one order's history by timestamp (paged views use descending)."""
    o = [F.col("timestamp").desc(), F.col("history_id").desc()] if descending else ["timestamp", "history_id"]
    return history.filter(F.col("order_id") == order_id).orderBy(*o)


# ------------------------------------------------------------------ summary view
def _last_after_create(setter: Column, *vals: Column, names: list[str]) -> list[Column]:
    s = F.struct(F.col("offset").alias("o"), *[v.alias(n) for v, n in zip(vals, names)])
    return [F.max_by(s, F.when(setter, F.col("offset"))).alias("_" + names[0])]


def order_summary_view(events: DataFrame) -> DataFrame:
    """A3: one row per order that has an ORDER_CREATED."""
    created = _is("ORDER_CREATED")
    status_set = _is("ORDER_CANCELLED", "PAYMENT_FAILED", "INVENTORY_RESERVED", "INVENTORY_FAILED")
    status_val = (F.when(_is("ORDER_CANCELLED"), "CANCELLED").when(_is("INVENTORY_RESERVED"), "CONFIRMED")
                  .otherwise("FAILED"))
    reason_set = _is("ORDER_CANCELLED", "PAYMENT_FAILED", "INVENTORY_FAILED")
    pay_status = (F.when(_is("PAYMENT_COMPLETED"), "COMPLETED").when(_is("PAYMENT_FAILED"), "FAILED")
                  .otherwise("CANCELLED"))
    inv_set = _is("INVENTORY_RESERVED", "INVENTORY_FAILED", "INVENTORY_RELEASED")
    c = F.struct(F.col("offset").alias("o"), "saga_id", "customer_id", "product_id", "quantity", "total_amount",
                 F.col("event_ts").alias("created_at"))
    aggs = [
        F.max_by(c, F.when(created, F.col("offset"))).alias("_c"),
        F.max("event_ts").alias("_last_ts"),
        F.max_by(F.struct(F.col("offset").alias("o"), F.col("event_ts").alias("ts")), F.col("offset")).alias("_u"),
        *_last_after_create(status_set, status_val, names=["status"]),
        *_last_after_create(reason_set, F.col("reason"), names=["reason"]),
        *_last_after_create(_is("PAYMENT_COMPLETED", "PAYMENT_FAILED", "PAYMENT_CANCELLED"), pay_status,
                            names=["pay_status"]),
        *_last_after_create(_is("PAYMENT_COMPLETED"), F.col("payment_id"), F.col("amount"),
                            names=["payment_id", "paid_amount"]),
        *_last_after_create(inv_set, _is("INVENTORY_RESERVED"), names=["inv"]),
        *_last_after_create(_is("INVENTORY_RESERVED"), F.col("event_ts"), names=["completed_at"]),
    ]
    g = events.groupBy("order_id").agg(*aggs).filter(F.col("_c").isNotNull())
    after = lambda n: F.col(f"_{n}.o") > F.col("_c.o")
    pick = lambda n, f=None, default=None: F.when(after(n), F.col(f"_{n}.{f or n}")).otherwise(
        F.lit(default))
    return g.select(
        "order_id", F.col("_c.saga_id").alias("saga_id"), F.col("_c.customer_id").alias("customer_id"),
        F.col("_c.product_id").alias("product_id"), F.col("_c.quantity").alias("quantity"),
        F.col("_c.total_amount").alias("total_amount"),
        pick("status", default="PENDING").alias("order_status"),
        pick("payment_id").cast("string").alias("payment_id"),
        pick("pay_status").cast("string").alias("payment_status"),
        pick("payment_id", "paid_amount").cast("decimal(19,2)").alias("paid_amount"),
        pick("inv", default=False).cast("boolean").alias("inventory_reserved"),
        pick("reason").cast("string").alias("failure_reason"),
        F.col("_c.created_at").alias("created_at"),
        F.col("_u.ts").alias("updated_at"),
        pick("completed_at").cast("timestamp_ntz").alias("completed_at"),
    )


# ------------------------------------------------------------------ customer stats
def attribute_to_order(events: DataFrame) -> DataFrame:
    """Each event with the order row it applies to — the latest
    ORDER_CREATED of its order at or before it (an as-of lookup inside the
    order, as a blocked prefix scan).
    ``applied`` is false for events on a missing order; they are still kept."""
    created = _is("ORDER_CREATED")
    snap = F.when(created, F.struct(F.col("customer_id").alias("c"), F.col("total_amount").alias("a"),
                                    F.col("quantity").alias("q")))
    e = prefix_scan(events, ["order_id"], "offset", [("_o", "last", snap, True)])
    return e.select(*events.columns, F.col("_o").isNotNull().alias("applied"),
                    F.col("_o.c").alias("order_customer_id"), F.col("_o.a").alias("order_total_amount"),
                    F.col("_o.q").alias("order_quantity"))


def customer_order_stats(events: DataFrame) -> DataFrame:
    """A5: per customer — total (each CREATED, replays count again), completed,
    cancelled, failed (a payment failure then a cancel counts as both), spent
    (order amount of completed orders), quantity, last order time."""
    a = attribute_to_order(events)
    created = _is("ORDER_CREATED")
    ok = F.col("applied")
    cust = F.when(created, F.col("customer_id")).otherwise(F.col("order_customer_id"))
    done = ok & _is("INVENTORY_RESERVED")
    g = a.filter(created | ok).groupBy(cust.alias("customer_id")).agg(
        F.count_if(created).alias("total_orders"),
        F.count_if(done).alias("completed_orders"),
        F.count_if(ok & _is("ORDER_CANCELLED")).alias("cancelled_orders"),
        F.count_if(ok & _is("PAYMENT_FAILED", "INVENTORY_FAILED")).alias("failed_orders"),
        F.coalesce(F.sum(F.when(done, F.col("order_total_amount"))), F.lit(0)).cast("decimal(38,2)").alias("total_spent"),
        F.coalesce(F.sum(F.when(done, F.col("order_quantity"))), F.lit(0)).cast("long").alias("total_quantity"),
        F.max(F.when(created, F.col("event_ts"))).alias("last_order_at"),
    )
    return g.filter(F.col("total_orders") > 0)


def average_order_value(spent="total_spent", completed="completed_orders") -> Column:
    """spent / completed, HALF_UP at scale 2; 0 without completions."""
    return F.when(F.col(completed) > 0, F.round(F.col(spent) / F.col(completed), 2)).otherwise(F.lit(0)) \
        .cast("decimal(38,2)")


def success_rate(completed="completed_orders", total="total_orders") -> Column:
    """F2: completed / total * 100 as double; 0.0 without orders."""
    return F.when(F.col(total) > 0, F.col(completed).cast("double") / F.col(total).cast("double") * 100) \
        .otherwise(F.lit(0.0))


def customer_stats_projection(stats: DataFrame) -> DataFrame:
    """Stats row plus derived average order value and success rate."""
    return stats.select("*", average_order_value().alias("average_order_value"), success_rate().alias("success_rate"))


def orders_to_customer_stats(summary: DataFrame, stats: DataFrame) -> DataFrame:
    """Each order with its customer's statistics."""
    return summary.select("order_id", "customer_id", "order_status", "total_amount").join(
        stats.select("customer_id", "total_orders", "total_spent"), "customer_id")


# ------------------------------------------------------------------ reads
def search_orders(summary: DataFrame, status=None, customer_id=None, created_from=None, created_to=None) -> DataFrame:
    """Conjunction of the supplied filters only (null = no filter)."""
    f = summary
    if status is not None:
        f = f.filter(F.col("order_status") == status)
    if customer_id is not None:
        f = f.filter(F.col("customer_id") == customer_id)
    if created_from is not None:
        f = f.filter(F.col("created_at") >= F.lit(created_from).cast("timestamp_ntz"))
    if created_to is not None:
        f = f.filter(F.col("created_at") <= F.lit(created_to).cast("timestamp_ntz"))
    return f


def order_summary_projection(summary: DataFrame) -> DataFrame:
    """Response shape — nested ``payment_info`` only when a payment exists."""
    pay = F.when(F.col("payment_id").isNotNull(), F.struct(
        F.col("payment_id").alias("payment_id"), F.coalesce("payment_status", F.lit("UNKNOWN")).alias("status"),
        F.col("paid_amount").alias("amount")))
    return summary.select("order_id", "saga_id", "customer_id", "product_id", "quantity", "total_amount",
                          F.coalesce("order_status", F.lit("UNKNOWN")).alias("status"), pay.alias("payment_info"),
                          "inventory_reserved", "failure_reason", "created_at", "updated_at", "completed_at")


def top_customers(stats: DataFrame, by: str, n: int = 10, page: int = 0) -> DataFrame:
    """Customers by ``total_spent`` or ``total_orders`` desc, one page."""
    return stats.orderBy(F.col(by).desc(), F.col("customer_id")).offset(page * n).limit(n)


def active_customers(stats: DataFrame, since) -> DataFrame:
    """P20: ``last_order_at >= since``."""
    return stats.filter(F.col("last_order_at") >= F.lit(since).cast("timestamp_ntz"))


def order_counts(summary: DataFrame, by: str) -> DataFrame:
    """Order count by customer or by status."""
    return summary.groupBy(by).agg(F.count(F.lit(1)).alias("order_count"))
