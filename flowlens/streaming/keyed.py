"""Continuous saga orchestration and customer statistics, by keyed state (ST5, ST6).

The state of a saga is one row (step, payment, reason, ...), that of an order
three values; no history is folded again. States lie in a
:class:`flowlens.streaming.statelog.StateLog`: a micro-batch joins the states of
its keys, folds its rows in one sorted pass, and writes what changed under its
batch id with overwrite, so a replayed batch gives the same rows once.

Rows of one key come in order of their offsets across micro-batches, as in a
log keyed by it; inside a batch they are sorted here. A row whose offset is not
beyond the key's last one is a redelivery and is ignored.
"""

from __future__ import annotations

import uuid
from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState

from flowlens.operators import commands as C
from flowlens.operators import projections as P
from flowlens.operators.fold import batches_of, tuples
from flowlens.operators.saga import STEP_NAMES
from flowlens.session import scratch_path
from flowlens.sources import decode
from flowlens.sources import fixtures as fx
from flowlens.sources.tables import streaming_tables
from flowlens.streaming.jobs import run_available_now, start_stream
from flowlens.streaming.statelog import StateLog

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_keyed(spark: SparkSession, writer):
    """Start a query whose state lies in RocksDB (on disk, changes logged per batch)."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        return start_stream(spark, writer)
    finally:
        spark.conf.set(key, before)


def _sorted(pdfs: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    """A key's rows of one micro-batch, in order."""
    return pd.concat(list(pdfs)).sort_values(list(by), kind="stable")


def _value(x):
    """A cell as a state value: missing ones (None, NaN, NaT) as None."""
    return None if x is None or x != x else x


# ------------------------------------------------------------------ ST5 sagas
_START = "order_id STRING, customer_id STRING, product_id STRING, quantity INT, total_amount DECIMAL(19,2), created_at TIMESTAMP_NTZ"
SAGA_OUT = f"kind STRING, saga_id STRING, seq LONG, command STRING, {_START}, status STRING, current_step STRING, " \
           "payment_id STRING, reason STRING, updated_at TIMESTAMP_NTZ, completed_at TIMESTAMP_NTZ, advanced INT"
SAGA_STATES = "saga_id STRING, order_id STRING, customer_id STRING, product_id STRING, quantity INT, total_amount DECIMAL(19,2), " \
              "status STRING, current_step STRING, payment_id STRING, failure_reason STRING, created_at TIMESTAMP_NTZ, " \
              "updated_at TIMESTAMP_NTZ, completed_at TIMESTAMP_NTZ, seq LONG, advanced INT"
_START_COLS = ["order_id", "customer_id", "product_id", "quantity", "total_amount", "created_at"]


class Saga:
    """One saga's state and what an event does to it."""

    FIELDS = [*_START_COLS, "status", "advanced", "payment_id", "reason", "updated_at", "completed_at", "last_offset"]

    def __init__(self, values: tuple):
        self.__dict__.update(zip(self.FIELDS, values))

    @classmethod
    def started(cls, row) -> Saga:
        return cls((*[_value(getattr(row, c)) for c in _START_COLS], "ORDER_PENDING", 0, None, None, _value(row.created_at), None, 0))

    def values(self) -> tuple:
        return tuple(getattr(self, f) for f in self.FIELDS)

    def start(self) -> tuple:
        return tuple(getattr(self, c) for c in _START_COLS)

    def step(self) -> int:
        return min(self.advanced + 1, len(STEP_NAMES))

    def apply(self, e) -> tuple[str, str | None, str | None] | None:
        """The state after the event; the command that it causes, with payment id and reason."""
        kind, step, payment, why = e.event_type, self.step(), self.payment_id, _value(e.reason)
        out = None
        if kind == "ORDER_CREATED":
            self.status, self.advanced, out = "PAYMENT_PENDING", self.advanced + 1, ("PROCESS_PAYMENT", None, None)
        elif kind == "PAYMENT_COMPLETED":
            self.status, self.advanced, out = "INVENTORY_PENDING", self.advanced + 1, ("RESERVE_INVENTORY", None, None)
            self.payment_id = _value(e.payment_id) or self.payment_id
        elif kind in ("PAYMENT_FAILED", "INVENTORY_FAILED"):
            self.status = "COMPENSATING" if step >= 2 else "FAILED"
            if step >= 3 and payment is not None:
                out = ("CANCEL_PAYMENT", payment, why)
            elif step >= 2:
                out = ("CANCEL_ORDER", None, why)
            else:
                self.completed_at = e.event_ts
        elif kind == "PAYMENT_CANCELLED":
            out = ("CANCEL_ORDER", None, why)
        elif kind == "INVENTORY_RELEASED":
            why = self.reason or "Compensation"
            out = ("CANCEL_PAYMENT", payment, why) if payment is not None else ("CANCEL_ORDER", None, why)
        elif kind == "ORDER_CANCELLED":
            self.status, self.completed_at = "COMPENSATED", e.event_ts
        elif kind == "INVENTORY_RESERVED":
            self.status, self.completed_at = "COMPLETED", e.event_ts
        if kind in ("PAYMENT_FAILED", "INVENTORY_FAILED"):
            self.reason = _value(e.reason) or self.reason
        if _value(e.event_ts) is not None and (self.last_offset == 0 or e.event_ts > self.updated_at):
            self.updated_at = e.event_ts
        self.last_offset = e.offset
        return out


def _saga_rows(saga_id: str, saga: Saga | None, events: Iterable) -> tuple[Saga | None, list[tuple]]:
    """The state after a saga's events, in order, and its rows: commands, then the
    state. Events of a saga that never started are dropped."""
    out = []
    for e in events:
        if e.event_type == "START":
            if saga is None:
                saga = Saga.started(e)
                out.append(("COMMAND", saga_id, 0, "CREATE_ORDER", *saga.start(), None, None, None, None, None, None, None))
        elif saga is not None and e.offset > saga.last_offset:
            command = saga.apply(e)
            if command:
                out.append(("COMMAND", saga_id, e.offset, command[0], *saga.start(), None, None, command[1], command[2], None, None, None))
    if saga is not None:
        out.append(("STATE", saga_id, saga.last_offset, None, *saga.start(), saga.status, STEP_NAMES[saga.step() - 1],
                    saga.payment_id, saga.reason, saga.updated_at, saga.completed_at, saga.advanced))
    return saga, out


def _saga_step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One saga's rows, its state held by ``state``: commands, then the state."""
    saga, out = _saga_rows(key[0], Saga(state.get) if state.exists else None, _sorted(pdfs, "offset").itertuples(index=False))
    if saga is not None:
        state.update(saga.values())
    yield pd.DataFrame(out, columns=[c.split()[0] for c in SAGA_OUT.replace("(19,2)", "").split(", ")])


def saga_input(starts: DataFrame, events: DataFrame) -> DataFrame:
    """Start rows and events as one frame, keyed by saga."""
    starts = starts.select("saga_id", F.lit(-1).cast("long").alias("offset"), F.lit("START").alias("event_type"), *_START_COLS)
    events = events.filter(F.col("saga_id").isNotNull()).select("saga_id", "offset", "event_type", "payment_id", "reason", "event_ts")
    return starts.unionByName(events, allowMissingColumns=True)


def _fold_sagas(columns: list[str], schema: pa.Schema):
    """Rows sorted by saga and offset → commands and states. A saga's earlier state
    comes as its first row (``STATE``); what streams by is one saga at a time."""
    Event = namedtuple("Event", columns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            events = (Event(*values) for batch in batches for values in tuples(batch))
            for saga_id, mine in groupby(events, key=lambda e: e.saga_id):
                first = next(mine)
                if first.event_type == "STATE":
                    saga = Saga((*[getattr(first, c) for c in _START_COLS], first.status, first.advanced, first.payment_id, first.reason,
                                 first.updated_at, first.completed_at, first.last_offset))
                else:
                    saga, mine = None, chain([first], mine)
                yield from _saga_rows(saga_id, saga, mine)[1]

        return batches_of(rows(), schema)

    return fold


def orchestrate(rows: DataFrame, states: DataFrame | None) -> DataFrame:
    """Commands and states after :func:`saga_input` rows, going on from ``states``."""
    none = {c: F.lit(None).cast(t) for c, t in (("status", "string"), ("advanced", "int"), ("updated_at", "timestamp_ntz"),
                                                ("completed_at", "timestamp_ntz"), ("last_offset", "long"))}
    rows = rows.withColumns(none)
    if states is not None:
        rows = rows.unionByName(states.select(
            "saga_id", F.lit(-2).cast("long").alias("offset"), F.lit("STATE").alias("event_type"), *_START_COLS, "payment_id",
            F.col("failure_reason").alias("reason"), "status", "advanced", "updated_at", "completed_at", F.col("seq").alias("last_offset")),
            allowMissingColumns=True)
    out = T.StructType.fromDDL(SAGA_OUT)
    ordered = rows.repartition("saga_id").sortWithinPartitions("saga_id", "offset")
    return ordered.mapInArrow(_fold_sagas(rows.columns, to_arrow_schema(out)), out)


def saga_writer(spark: SparkSession, base: str) -> Callable[[DataFrame, int], None]:
    """Commands below ``commands``, states below ``states``, both under the batch id."""
    log = StateLog(spark, base, "saga_id", SAGA_STATES)

    def write(batch: DataFrame, batch_id: int) -> None:
        given = batch if batch_id == 0 else log.hold(batch, batch_id)
        folded = orchestrate(given, log.before(given, batch_id))
        rows = f"{base}/rows/_batch={batch_id}"
        folded.write.mode("overwrite").parquet(rows)  # the fold runs once
        written = spark.read.schema(folded.schema).parquet(rows)
        commands = written.filter("kind = 'COMMAND'")
        C.with_data(commands).write.mode("overwrite").parquet(f"{base}/commands/_batch={batch_id}")
        log.write(written.filter("kind = 'STATE'").withColumnRenamed("reason", "failure_reason").select(
            *[f.name for f in T.StructType.fromDDL(SAGA_STATES)]), batch_id)
    return write


def run_sagas(spark: SparkSession, sf_dir: str, max_files: int = 1, base: str | None = None) -> tuple[DataFrame, DataFrame]:
    """ST5: sagas orchestrated continuously; (commands, states). Rows that
    arrive later go on from the state below the same ``base``."""
    base = base or scratch_path(spark, f"stream-sagas-{uuid.uuid4().hex[:12]}")
    with streaming_tables(max_files):
        rows = saga_input(fx.saga_starts(spark, sf_dir), decode.decode_saga_envelope(fx.saga_events(spark, sf_dir)))
    q = start_stream(spark, rows.writeStream.outputMode("append").foreachBatch(saga_writer(spark, base))
                     .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True))
    q.awaitTermination()
    commands = spark.read.parquet(f"{base}/commands").drop("_batch")
    return commands, StateLog(spark, base, "saga_id", SAGA_STATES).latest().drop("seq", "advanced")


# ------------------------------------------------------------------ ST6 customer statistics
ORDER_STATE = "order_id STRING, customer_id STRING, total_amount DECIMAL(19,2), quantity INT, last_offset LONG"
_COUNTS = ("total_orders", "completed_orders", "cancelled_orders", "failed_orders")
_CHANGE = {"ORDER_CREATED": 0, "INVENTORY_RESERVED": 1, "ORDER_CANCELLED": 2, "PAYMENT_FAILED": 3, "INVENTORY_FAILED": 3}
_OWNER = ("customer_id", "total_amount", "quantity")


def owned_events(rows: DataFrame, owners: DataFrame | None) -> DataFrame:
    """Events of a micro-batch with their order's ``owner``: the order's latest creation
    before the event, here or in ``owners``. Earlier events of an order are skipped
    when they come again, as are events before its first creation."""
    kinds = rows
    if owners is not None:
        kinds = rows.unionByName(owners.select("order_id", F.col("last_offset").alias("offset"), F.lit("OWNER").alias("event_type"), *_OWNER),
                                 allowMissingColumns=True)
    # The known owner stands before all; an event with an offset that was seen is a redelivery.
    first = F.when(F.col("event_type") == "OWNER", 0).otherwise(1)
    w = Window.partitionBy("order_id").orderBy(first, "offset").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.max("offset").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = kinds.withColumn("_seen", seen).filter("_seen IS NULL OR offset > _seen").drop("_seen")
    made = F.when(F.col("event_type").isin("OWNER", "ORDER_CREATED"), F.struct(*_OWNER))
    return (fresh.select("order_id", "offset", "event_type", "event_ts", F.last(made, ignorenulls=True).over(w).alias("owner"))
            .filter("owner IS NOT NULL AND event_type <> 'OWNER'"))


def _deltas(events: DataFrame) -> DataFrame:
    """What each event changes in the statistics of its order's owner."""
    counts = [F.col("event_type").isin(*[t for t, k in _CHANGE.items() if k == i]).cast("long").alias(c) for i, c in enumerate(_COUNTS)]
    done, created = F.col("event_type") == "INVENTORY_RESERVED", F.col("event_type") == "ORDER_CREATED"
    return events.filter(F.col("event_type").isin(*_CHANGE)).select(
        F.col("owner.customer_id").alias("customer_id"), *counts, F.when(done, F.col("owner.total_amount")).alias("total_spent"),
        F.when(done, F.col("owner.quantity")).cast("long").alias("total_quantity"), F.when(created, F.col("event_ts")).alias("last_order_at"))


def _summed(deltas: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in (*_COUNTS, "total_spent", "total_quantity")]
    return deltas.groupBy("customer_id").agg(*sums, F.max("last_order_at").alias("last_order_at"))


def run_customer_stats(spark: SparkSession, sf_dir: str, max_files: int = 1, base: str | None = None) -> DataFrame:
    """ST6: A5 as a stream. The keyed state holds each order's owner; the
    deltas of a micro-batch are summed per customer (combined before the shuffle, so one
    customer may have a third of all orders) and written once per batch id. The
    statistics are the sums over the batches."""
    base = base or scratch_path(spark, f"stream-customer-stats-{uuid.uuid4().hex[:12]}")
    with streaming_tables(max_files):
        ev = decode.decode_saga_envelope(fx.saga_events(spark, sf_dir))
    keyed = ev.filter(F.col("order_id").isNotNull()).select("order_id", "offset", "event_type", "customer_id", "total_amount", "quantity",
                                                            "event_ts")
    log = StateLog(spark, base, "order_id", ORDER_STATE)

    def write(batch: DataFrame, batch_id: int) -> None:
        given = batch if batch_id == 0 else log.hold(batch, batch_id)
        owned = owned_events(given, log.before(given, batch_id))
        rows = f"{base}/rows/_batch={batch_id}"
        owned.write.mode("overwrite").parquet(rows)  # the decode and the window run once
        events = spark.read.schema(owned.schema).parquet(rows)
        _summed(_deltas(events)).write.mode("overwrite").parquet(f"{base}/deltas/_batch={batch_id}")
        last = events.groupBy("order_id").agg(F.max_by("owner", "offset").alias("o"), F.max("offset").alias("last_offset"))
        log.write(last.select("order_id", *[F.col("o")[c].alias(c) for c in _OWNER], "last_offset"), batch_id)

    q = start_stream(spark, keyed.writeStream.outputMode("append").foreachBatch(write)
                     .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True))
    q.awaitTermination()
    total = _summed(spark.read.parquet(f"{base}/deltas")).filter("total_orders > 0")
    return total.select("customer_id", *_COUNTS, F.coalesce("total_spent", F.lit(0)).cast("decimal(38,2)").alias("total_spent"),
                        F.coalesce("total_quantity", F.lit(0)).cast("long").alias("total_quantity"), "last_order_at")


def run_history(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    """ST6: A4 as a stream; each event appends its history rows."""
    with streaming_tables(max_files):
        ev = decode.decode_saga_envelope(fx.saga_events(spark, sf_dir))
        rows = P.order_history_view(ev)
    return run_available_now(spark, rows, "history")
