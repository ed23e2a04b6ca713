"""Order saga: state fold, emitted commands, compensation chains.

The orchestrator applies events whatever the current status (no guard);
its decisions depend on the step reached and on whether a payment id was
seen *before* the event. Those are running aggregates over the saga's events
in arrival order, computed by :func:`flowlens.operators.common.prefix_scan`
(blocked, so even a saga with billions of events never sits in one task).

Step order: CREATE_ORDER(1) → PROCESS_PAYMENT(2) → RESERVE_INVENTORY(3) →
COMPLETE_SAGA(4); ORDER_CREATED and PAYMENT_COMPLETED each advance one step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators.common import prefix_scan

STEP_NAMES = ["CREATE_ORDER", "PROCESS_PAYMENT", "RESERVE_INVENTORY", "COMPLETE_SAGA"]
# Compensation chain of each failed step.
COMPENSATION_CHAIN = {
    "CREATE_ORDER": [],
    "PROCESS_PAYMENT": ["CANCEL_ORDER"],
    "RESERVE_INVENTORY": ["CANCEL_PAYMENT"],
    "COMPLETE_SAGA": [],
    "CANCEL_PAYMENT": [],
    "CANCEL_ORDER": [],
    "RELEASE_INVENTORY": [],
}
# What the fold reads of an event.
PREFIX_COLUMNS = ("saga_id", "offset", "event_type", "payment_id", "reason", "event_ts")


def _is(*t) -> Column:
    return F.col("event_type").isin(*t)


def _step_name(idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STEP_NAMES]), idx.cast("int"))


def events_with_known_saga(events: DataFrame, starts: DataFrame) -> DataFrame:
    """Events whose saga exists (unknown sagas are dropped)."""
    return events.join(starts.select("saga_id"), "saga_id", "left_semi")


def _prefix(events: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Each event with the saga state *before* it and its own effect
    (running aggregates by a blocked prefix scan — exact for any saga size)."""
    events = events.select(*PREFIX_COLUMNS)  # the scan writes and shuffles its rows
    adv = _is("ORDER_CREATED", "PAYMENT_COMPLETED").cast("long")
    pay = F.when(_is("PAYMENT_COMPLETED"), F.col("payment_id"))
    why = F.when(_is("PAYMENT_FAILED", "INVENTORY_FAILED"), F.col("reason"))
    e = prefix_scan(events, ["saga_id"], "offset", [
        ("_adv_b", "sum", adv, False), ("_pay_before", "last", pay, False), ("_reason_before", "last", why, False),
    ], block)
    # state after the event = state before it combined with the event itself
    e = e.select("*", F.coalesce("_adv_b", F.lit(0)).alias("_adv_before"),
                 (F.coalesce("_adv_b", F.lit(0)) + adv).alias("_adv_after"),
                 F.coalesce(pay, F.col("_pay_before")).alias("_pay_after"),
                 F.coalesce(why, F.col("_reason_before")).alias("_reason_after")).drop("_adv_b")
    step_at = F.least(F.col("_adv_before") + 1, F.lit(4))
    status_set = (F.when(_is("ORDER_CREATED"), "PAYMENT_PENDING").when(_is("ORDER_CANCELLED"), "COMPENSATED")
                  .when(_is("PAYMENT_COMPLETED"), "INVENTORY_PENDING").when(_is("INVENTORY_RESERVED"), "COMPLETED")
                  .when(_is("PAYMENT_FAILED", "INVENTORY_FAILED"),
                        F.when(step_at >= 2, "COMPENSATING").otherwise("FAILED")))
    done = _is("ORDER_CANCELLED", "INVENTORY_RESERVED") | (_is("PAYMENT_FAILED", "INVENTORY_FAILED") & (step_at < 2))
    return e.select("*", step_at.alias("_step_at"), status_set.alias("_status_set"),
                    F.when(done, F.col("event_ts")).alias("_done_ts"))


def saga_state(starts: DataFrame, events: DataFrame) -> DataFrame:
    """Final state of every started saga (no events → the start row)."""
    p = _prefix(events_with_known_saga(events, starts))
    last = p.groupBy("saga_id").agg(
        F.max_by(F.struct("_adv_after", "_pay_after", "_reason_after"), F.col("offset")).alias("_end"),
        F.max_by("_status_set", F.when(F.col("_status_set").isNotNull(), F.col("offset"))).alias("_status"),
        F.max_by("_done_ts", F.when(F.col("_done_ts").isNotNull(), F.col("offset"))).alias("_completed_at"),
        F.max("event_ts").alias("_updated_at"),
    )
    s = starts.join(last, "saga_id", "left")
    return s.select(
        "saga_id", "order_id", "customer_id", "product_id", "quantity", "total_amount",
        F.coalesce("_status", "status").alias("status"),
        F.when(F.col("_end").isNotNull(), _step_name(F.least(F.col("_end._adv_after") + 1, F.lit(4))))
         .otherwise(F.col("current_step")).alias("current_step"),
        F.col("_end._pay_after").alias("payment_id"),
        F.col("_end._reason_after").alias("failure_reason"),
        "created_at",
        F.coalesce("_updated_at", "created_at").alias("updated_at"),
        F.col("_completed_at").alias("completed_at"),
    )


def saga_command_log(starts: DataFrame, events: DataFrame) -> DataFrame:
    """Commands published by the orchestrator, one row each: the
    CREATE_ORDER of every start, then PROCESS_PAYMENT, RESERVE_INVENTORY,
    CANCEL_PAYMENT and CANCEL_ORDER as events arrive."""
    p = _prefix(events_with_known_saga(events, starts))
    step3 = F.col("_step_at") >= 3
    has_pay = F.col("_pay_before").isNotNull()
    fail = _is("PAYMENT_FAILED", "INVENTORY_FAILED")
    comp_reason = F.coalesce(F.col("_reason_before"), F.lit("Compensation"))
    cmd = (F.when(_is("ORDER_CREATED"), "PROCESS_PAYMENT").when(_is("PAYMENT_COMPLETED"), "RESERVE_INVENTORY")
           .when(fail & step3 & has_pay, "CANCEL_PAYMENT").when(fail & (F.col("_step_at") >= 2), "CANCEL_ORDER")
           .when(_is("PAYMENT_CANCELLED"), "CANCEL_ORDER")
           .when(_is("INVENTORY_RELEASED"), F.when(has_pay, "CANCEL_PAYMENT").otherwise("CANCEL_ORDER")))
    reason = (F.when(fail | _is("PAYMENT_CANCELLED"), F.col("reason"))
              .when(_is("INVENTORY_RELEASED"), comp_reason))
    pay = F.when(cmd == "CANCEL_PAYMENT", F.col("_pay_before"))
    from_events = p.select("saga_id", F.col("offset").alias("seq"), cmd.alias("command"),
                           pay.alias("payment_id"), reason.cast("string").alias("reason")).filter(F.col("command").isNotNull())
    created = starts.select("saga_id", F.lit(0).cast("long").alias("seq"), F.lit("CREATE_ORDER").alias("command"),
                            F.lit(None).cast("string").alias("payment_id"), F.lit(None).cast("string").alias("reason"))
    return created.unionByName(from_events)


def compensation_chain(spark, sagas: DataFrame) -> DataFrame:
    """Expected compensations of each saga in COMPENSATING/COMPENSATED/FAILED
    status, by the step where it failed (one row per compensation, ``pos``
    from 1). The chain table is a fixed literal, broadcast by construction."""
    rows = [(step, i + 1, c) for step, chain in COMPENSATION_CHAIN.items() for i, c in enumerate(chain)]
    chain = spark.createDataFrame(rows, "current_step STRING, pos INT, compensation STRING")
    failed = sagas.filter(F.col("status").isin("COMPENSATING", "COMPENSATED", "FAILED"))
    return failed.select("saga_id", "current_step", "status").join(F.broadcast(chain), "current_step")


def sagas_by(sagas: DataFrame, *, status=None, statuses=None, order_id=None) -> DataFrame:
    """By status, by a status list (IN), or by order."""
    f = sagas
    if status is not None:
        f = f.filter(F.col("status") == status)
    if statuses is not None:
        f = f.filter(F.col("status").isin(*statuses))
    if order_id is not None:
        f = f.filter(F.col("order_id") == order_id)
    return f


def saga_projection(sagas: DataFrame) -> DataFrame:
    """Saga state as a response."""
    return sagas.select("saga_id", "order_id", "status", "current_step", "payment_id", "failure_reason",
                        "created_at", "updated_at", "completed_at")
