"""Keyed streams that buffer in state: ordered stock (ST9), first deliveries (ST3),
compaction with deletes (ST4) and groups by size or time (ST7).

State lies in RocksDB (:func:`flowlens.streaming.keyed.start_keyed`): what is
deleted or expired leaves it; the ids of first deliveries are rows, read until
they expire. Timers run on processing time. A table that ends is
closed by control rows, one per key, which release what still waits; a
continuous job never needs them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowlens.operators import dedup as U
from flowlens.operators import inventory as I
from flowlens.session import scratch_path
from flowlens.sources import fixtures as fx
from flowlens.sources.tables import streaming_tables
from flowlens.streaming.jobs import start_stream
from flowlens.streaming.keyed import start_keyed

CLOSE = "CLOSE"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


class Control:
    """A folder of control rows beside a stream's input."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        spark.createDataFrame([], schema).write.mode("append").parquet(path)  # a stream needs the folder

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(self.path)

    def send(self, rows: DataFrame) -> None:
        rows.select(*[c.split()[0] for c in self.schema.split(", ")]).write.mode("append").parquet(self.path)


def _run(spark: SparkSession, frame: DataFrame, base: str) -> None:
    """Run to the end of the input. Batches without data, which a continuous job needs
    for its timers, would follow one another for ever here, so they are off."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/_batch={batch_id}")

    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        q = start_keyed(spark, frame.writeStream.outputMode("append").foreachBatch(write)
                        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True))
    finally:
        spark.conf.set(key, before)
    q.awaitTermination()


# ------------------------------------------------------------------ ST9 ordered stock
STOCK_BUCKETS = 1024  # products are dealt over so many keys of state, which stays so for a checkpoint's life
WAITING = "due LONG, rows BINARY"
_COMMAND = ["product_id", "seq", "order_id", "command", "quantity", "stock_quantity", "reserved_quantity"]
_COMMAND_ARROW = pa.schema([("product_id", pa.string()), ("seq", pa.int64()), ("order_id", pa.string()), ("command", pa.string()),
                            ("quantity", pa.int32()), ("stock_quantity", pa.int32()), ("reserved_quantity", pa.int32())])


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _COMMAND_ARROW, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(pa.Table.from_pandas(rows[_COMMAND], _COMMAND_ARROW, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(rows: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(rows)).read_all().to_pandas()


class OrderedStock(StatefulProcessor):
    """The commands of a bucket's products, applied per product in order of ``seq``.

    A command waits ``hold_ms`` after its arrival; then it and all of its product's
    waiting commands with a smaller ``seq`` are applied. So rows that arrive at most that
    much out of order give the outcomes of the ordered log, however they are dealt
    over partitions, files and micro-batches. A command that comes later still is
    applied when it comes; none is lost.

    Commands that arrived together wait as one block with their due time: calls to the
    state are paid per block, and per product whose commands are applied."""

    def __init__(self, hold_ms: int):
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stock = handle.getMapState("stock", "product_id STRING", "reserved INT")
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        now = timers.getCurrentProcessingTimeInMs()
        due, closed, fresh = now + self.hold_ms, False, []
        for part in rows:
            close = part["command"] == CLOSE
            closed = closed or bool(close.any())
            part = part[~close]
            found = part["found"].astype(bool)
            missing = part[~found]
            if len(missing):
                yield missing.assign(quantity=missing["quantity"].astype("int32"), outcome="NOT_FOUND", available_before=None,
                                     reserved_after=None)[_OUT]
            if found.any():
                fresh.append((due, _packed(part[found])))
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(due)
        if closed or self.hold_ms <= 0:
            yield self._release(None if closed else now)

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        yield self._release(timers.getCurrentProcessingTimeInMs())

    def _release(self, now: int | None) -> pd.DataFrame:
        """Apply what is due at ``now`` and what of the same products comes before it (None: all)."""
        blocks = list(self.waiting.get()) if self.waiting.exists() else []
        if not any(now is None or b[0] <= now for b in blocks):
            return _frame([], I.OUT_SCHEMA)
        b = pd.concat([_unpacked(r).assign(due=d) for d, r in blocks], ignore_index=True)
        ripe = (b["seq"] if now is None else b["seq"].where(b["due"] <= now)).groupby(b["product_id"]).transform("max")
        go = b["seq"] <= ripe  # a product with nothing due has no number here, so it waits
        rest = b[~go]
        if len(rest):
            self.waiting.put([(int(d), _packed(part)) for d, part in rest.groupby("due")])
        else:
            self.waiting.clear()
        return self._applied(b[go].sort_values(["product_id", "seq"], kind="stable"))

    def _applied(self, b: pd.DataFrame) -> pd.DataFrame:
        products = b["product_id"].tolist()
        commands, amounts, totals, bases = (b[c].tolist() for c in ("command", "quantity", "stock_quantity", "reserved_quantity"))
        known, head, outcome, before, after = self.stock.exists(), 0, [], [], []
        for product, mine in groupby(products):
            end = head + sum(1 for _ in mine)
            state = self.stock.getValue((product,)) if known else None
            fold = I.StockFold(product, int(bases[head]) if state is None else int(state[0]))
            for whole, part in zip((outcome, before, after), fold.outcomes(int(totals[head]), commands[head:end], amounts[head:end])):
                whole += part
            self.stock.updateValue((product,), (int(fold.reserved),))
            head = end
        return b.assign(outcome=outcome, available_before=before, reserved_after=after)[_OUT]

    def close(self) -> None:
        pass


_OUT = [c.split()[0] for c in I.OUT_SCHEMA.split(", ")]
_STOCK_IN = "seq LONG, product_id STRING, order_id STRING, quantity INT, command STRING, stock_quantity INT, reserved_quantity INT, " \
            "found BOOLEAN, bucket INT"


def run_ordered_stock(spark: SparkSession, commands: Callable[[], DataFrame], stock: DataFrame, hold: float = 3600.0,
                      max_files: int = 1) -> DataFrame:
    """ST9: outcomes of a stream of commands in any order of arrival. The
    frame that ``commands`` builds becomes a stream; when it is read, every
    bucket of products is closed."""
    base = scratch_path(spark, f"stream-stock-{uuid.uuid4().hex[:12]}")
    control = Control(spark, f"{base}/control", _STOCK_IN)
    names = [c.split()[0] for c in _STOCK_IN.split(", ")]
    bucket = F.pmod(F.xxhash64("product_id"), F.lit(STOCK_BUCKETS)).cast("int")

    def frame() -> DataFrame:
        with streaming_tables(max_files):
            j = I.reserve_against_stock(commands(), stock).fillna({"reserved_quantity": 0}).withColumn("bucket", bucket).select(*names)
        return j.unionByName(control.stream()).groupBy("bucket").transformWithStateInPandas(
            OrderedStock(int(hold * 1000)), I.OUT_SCHEMA, "Append", "ProcessingTime")

    _run(spark, frame(), base)
    empty = {c: F.lit(None) for c in names}
    closing = commands().select(bucket.alias("bucket")).distinct().select(
        *[(F.col("bucket") if c == "bucket" else F.lit(CLOSE) if c == "command" else empty[c]).cast(t).alias(c)
          for c, t in (x.split() for x in _STOCK_IN.split(", "))])
    control.send(closing)
    _run(spark, frame(), base)
    return spark.read.schema(I.OUT_SCHEMA).parquet(f"{base}/out").drop("_batch")


# ------------------------------------------------------------------ ST3 first deliveries
def first_deliveries(batch: DataFrame, seen: DataFrame | None) -> DataFrame:
    """The first delivery, by (offset, delivery), of every id of the batch that is not among ``seen``."""
    arrival, rows = ["offset", "delivery"], batch.withColumnRenamed("message_id", "_id")
    if seen is None:
        return U.distinct_by_message_id(rows, F.col("_id"), arrival).drop("_id")
    return U.dedup_anti_join(rows, seen, F.col("_id"), arrival).drop("_id")


def run_first_deliveries(spark: SparkSession, sf_dir: str, retention_days: float = 7, max_files: int = 1) -> DataFrame:
    """ST3: the first delivery of every message id: by (offset, delivery) inside a
    micro-batch, by arrival between them. The ids are the state: a micro-batch
    reads those of smaller batch ids, and none that was processed more than
    ``retention_days`` before it. Its own are written under its id with overwrite."""
    base = scratch_path(spark, f"stream-first-{uuid.uuid4().hex[:12]}")
    with streaming_tables(max_files):
        ok, _ = U.valid_payload_split(fx.deliveries(spark, sf_dir))
        rows = ok.withColumn("message_id", U.message_id_header())

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = None
        if batch_id > 0:
            oldest = F.current_timestamp() - F.make_dt_interval(secs=F.lit(retention_days * 86_400).cast("decimal(18,6)"))
            seen = (spark.read.schema("message_id STRING, at TIMESTAMP, _batch LONG").parquet(f"{base}/seen")
                    .filter((F.col("_batch") < batch_id) & (F.col("at") > oldest)))
        out = f"{base}/out/_batch={batch_id}"
        first_deliveries(batch, seen).write.mode("overwrite").parquet(out)
        written = spark.read.schema(rows.schema).parquet(out)
        written.select("message_id", F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{base}/seen/_batch={batch_id}")

    q = start_stream(spark, rows.writeStream.outputMode("append").foreachBatch(write)
                     .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True))
    q.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out").drop("_batch")


# ------------------------------------------------------------------ ST4 compaction with deletes
class LatestState(StatefulProcessor):
    """The latest record of a key. A tombstone clears the key's state; only its offset
    is kept, for ``grave_ms``, so that a redelivered older record does not bring it back."""

    def __init__(self, columns: list[str], grave_ms: int):
        self.columns, self.grave_ms = columns, grave_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getValueState("live", "offset LONG")
        self.grave = handle.getValueState("grave", "offset LONG", ttlDurationMs=self.grave_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        last = pd.concat([part.sort_values("offset").tail(1) for part in rows]).sort_values("offset").tail(1)
        offset = int(last["offset"].iloc[0])
        known = max((int(s.get()[0]) for s in (self.live, self.grave) if s.exists()), default=-1)
        if offset <= known:
            return
        if pd.isna(last["value"].iloc[0]):
            self.live.clear()
            self.grave.update((offset,))
        else:
            self.live.update((offset,))
            self.grave.clear()
        yield last[self.columns]

    def close(self) -> None:
        pass


def run_compaction(spark: SparkSession, sf_dir: str, grave_days: float = 1, max_files: int = 1) -> DataFrame:
    """ST4: the changelog's latest values; deleted keys leave state and result.
    The sink is a changelog too (a row per key and batch that changed it), compacted on read."""
    base = scratch_path(spark, f"stream-latest-{uuid.uuid4().hex[:12]}")
    with streaming_tables(max_files):
        c = fx.state_changelog(spark, sf_dir)
    out = c.groupBy("topic", "key").transformWithStateInPandas(
        LatestState(c.columns, int(grave_days * 86_400_000)), c.schema, "Append", "ProcessingTime")
    _run(spark, out, base)
    rest = [x for x in c.columns if x not in ("topic", "key")]
    latest = spark.read.schema(c.schema).parquet(f"{base}/out").groupBy("topic", "key").agg(F.max_by(F.struct(*rest), "offset").alias("v"))
    return latest.select("topic", "key", *[F.col("v")[x].alias(x) for x in rest]).filter(F.col("value").isNotNull())


# ------------------------------------------------------------------ ST7 groups by size or time
GROUP_IN = "topic STRING, partition INT, offset LONG, key STRING, record_ts TIMESTAMP_NTZ, closes BOOLEAN"
GROUP_OUT = "topic STRING, partition INT, offset LONG, key STRING, record_ts TIMESTAMP_NTZ, chunk LONG"


class SizeOrTime(StatefulProcessor):
    """Groups of at most ``size`` records of a partition; a group that is not full goes
    ``wait_ms`` after its first record arrived."""

    def __init__(self, size: int, wait_ms: int):
        self.size, self.wait_ms = size, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "offset LONG, key STRING, record_ts TIMESTAMP_NTZ")
        self.chunk = handle.getValueState("chunk", "n LONG")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        before = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        new = pd.concat(list(rows)).sort_values("offset")
        closed = bool(new["closes"].any())
        new = new[~new["closes"].astype(bool)]
        held = before + list(new[["offset", "key", "record_ts"]].itertuples(index=False, name=None))
        full = len(held) // self.size * self.size
        cut = len(held) if closed else full
        yield self._emit(key, held[:cut])
        self._keep(held[cut:])
        if cut < len(held) and (not before or cut):  # a new group begins to wait
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        self._keep([])
        yield self._emit(key, held)

    def _keep(self, rows: list[tuple]) -> None:
        if rows:
            self.held.put(rows)
        elif self.held.exists():
            self.held.clear()

    def _emit(self, key, rows: list[tuple]) -> pd.DataFrame:
        if not rows:
            return _frame([], GROUP_OUT)
        n = int(self.chunk.get()[0]) if self.chunk.exists() else 0
        out = [(*key, *r, n + k // self.size) for k, r in enumerate(rows)]
        self.chunk.update((n + -(-len(rows) // self.size),))
        return _frame(out, GROUP_OUT)

    def close(self) -> None:
        pass


def run_size_or_time(spark: SparkSession, records: Callable[[], DataFrame], size: int, wait: float = 3600.0, max_files: int = 1,
                     close: bool = True) -> DataFrame:
    """ST7 as a stream: records with the number of their group (``chunk``) in their
    partition. Records of a partition come in order of their offsets."""
    base = scratch_path(spark, f"stream-groups-{uuid.uuid4().hex[:12]}")
    control = Control(spark, f"{base}/control", GROUP_IN)
    names = [c.split()[0] for c in GROUP_OUT.split(", ")][:-1]

    def frame() -> DataFrame:
        with streaming_tables(max_files):
            rows = records().select(*names).withColumn("closes", F.lit(False))
        return rows.unionByName(control.stream()).groupBy("topic", "partition").transformWithStateInPandas(
            SizeOrTime(size, int(wait * 1000)), GROUP_OUT, "Append", "ProcessingTime")

    _run(spark, frame(), base)
    if close:
        keys = records().select("topic", "partition").distinct()
        control.send(keys.select("topic", "partition", F.lit(-1).cast("long").alias("offset"), F.lit(None).cast("string").alias("key"),
                                 F.lit(None).cast("timestamp_ntz").alias("record_ts"), F.lit(True).alias("closes")))
        _run(spark, frame(), base)
    return spark.read.schema(GROUP_OUT).parquet(f"{base}/out").drop("_batch")
