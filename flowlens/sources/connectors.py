"""Connector-style sources and sinks.

Record layout follows Spark's Kafka source (``topic, partition, offset,
timestamp, key, value, headers``). Where the reference talks to a broker or
a database, the Spark form reads/writes tables: a JDBC pull becomes a
high-water-mark filter over a table, an upsert sink becomes an anti-join +
union written as a new table version, a transactional fan-out becomes a
``foreachBatch`` that writes two sinks under the batch id (idempotent on
replay). Writes go below ``spark.checkpoint.dir`` (shared storage on a
cluster), never to a machine-local folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DLT_PREFIX = "kafka_dlt-"
DLT_SUFFIX = ".DLT"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_string(c) -> Column:
    """JSON string literal of a text column (quotes and backslashes escaped)."""
    esc = F.replace(F.replace(_c(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), esc, F.lit('"'))


# ------------------------------------------------------------------ dead letters
def header_value(headers: Column | str, name: str) -> Column:
    """Last header named ``name`` decoded as UTF-8 (``lastHeader`` semantics)."""
    hs = F.filter(_c(headers), lambda h: h["key"] == name)
    last = F.try_element_at(hs, F.lit(-1))
    return F.decode(last["value"], "UTF-8")


def dlt_error_text(message: Column, stacktrace: Column) -> Column:
    """"Exception: <msg>" + blank line + "StackTrace:\\n<trace>"; "Unknown error" when neither."""
    body = F.concat(F.coalesce(F.concat(F.lit("Exception: "), message), F.lit("")),
                    F.coalesce(F.concat(F.lit("\n\nStackTrace:\n"), stacktrace), F.lit("")))
    return F.when(body == "", F.lit("Unknown error")).otherwise(body)


def capture_dead_letters(records: DataFrame, original_position: bool = True) -> DataFrame:
    """``.DLT`` records → failed-message rows (PENDING).

    Original topic from the header, else the DLT topic without ``.DLT``
    (the reference's generic handler strips ``-dlt``; we strip ``.DLT``).
    S4 takes partition/offset from the headers when parsable; S5
    (``original_position=False``) keeps the record's own. One row per
    (topic, partition, offset): each DLT record is read once, so the double
    capture of two overlapping listeners cannot happen."""
    dlt = records.filter(F.col("topic").endswith(DLT_SUFFIX))
    h = lambda n: header_value("headers", DLT_PREFIX + n)
    topic = F.coalesce(h("original-topic"),
                       F.expr(f"substr(topic, 1, length(topic) - {len(DLT_SUFFIX)})"))
    part = F.coalesce(h("original-partition").try_cast("int"), F.col("partition")) if original_position \
        else F.col("partition")
    off = F.coalesce(h("original-offset").try_cast("long"), F.col("offset")) if original_position else F.col("offset")
    out = dlt.select(
        F.col("topic").alias("dlt_topic"), F.col("partition").alias("dlt_partition"), F.col("offset").alias("dlt_offset"),
        topic.alias("original_topic"), part.cast("int").alias("partition_id"), off.cast("long").alias("offset_id"),
        F.col("key").alias("message_key"), F.col("value").alias("message_value"),
        dlt_error_text(h("exception-message"), h("exception-stacktrace")).alias("error_message"),
        F.lit("PENDING").alias("status"), F.col("timestamp").cast("timestamp_ntz").alias("created_at"),
        F.lit(0).alias("retry_count"))
    return out


# ------------------------------------------------------------------ typed (Avro) records
# The fields of the three record types.
AVRO_SCHEMAS = {
    "OrderEvent": T.StructType([
        T.StructField("eventId", T.StringType()), T.StructField("orderId", T.StringType()),
        T.StructField("customerId", T.StringType()), T.StructField("productId", T.StringType()),
        T.StructField("quantity", T.IntegerType()), T.StructField("totalAmount", T.LongType()),
        T.StructField("eventType", T.StringType()), T.StructField("timestamp", T.LongType())]),
    "PaymentEvent": T.StructType([
        T.StructField("eventId", T.StringType()), T.StructField("paymentId", T.StringType()),
        T.StructField("orderId", T.StringType()), T.StructField("amount", T.LongType()),
        T.StructField("currency", T.StringType()), T.StructField("paymentMethod", T.StringType()),
        T.StructField("eventType", T.StringType()), T.StructField("timestamp", T.LongType())]),
    "InventoryEvent": T.StructType([
        T.StructField("eventId", T.StringType()), T.StructField("productId", T.StringType()),
        T.StructField("orderId", T.StringType()), T.StructField("quantity", T.IntegerType()),
        T.StructField("availableStock", T.IntegerType()), T.StructField("eventType", T.StringType()),
        T.StructField("timestamp", T.LongType())]),
}
# Non-null (required) fields of each record type.
AVRO_REQUIRED = {
    "OrderEvent": ["eventId", "orderId", "customerId", "productId", "quantity", "totalAmount", "eventType", "timestamp"],
    "PaymentEvent": ["eventId", "paymentId", "orderId", "amount", "currency", "paymentMethod", "eventType", "timestamp"],
    "InventoryEvent": ["eventId", "productId", "orderId", "quantity", "availableStock", "eventType", "timestamp"],
}
_ENTITY = {"OrderEvent": "orderId", "PaymentEvent": "paymentId", "InventoryEvent": "productId"}
_AMOUNT = {"OrderEvent": "totalAmount", "PaymentEvent": "amount", "InventoryEvent": None}


def demux_avro_events(records: DataFrame) -> dict[str, DataFrame]:
    """S3: one topic, three record types → one typed frame per type (unknown
    types in ``"unknown"``). ``from_avro`` applies when spark-avro is deployed;
    here values are the JSON encoding with ``schema_name``."""
    out = {}
    for name, schema in AVRO_SCHEMAS.items():
        f = records.filter(F.col("schema_name") == name)
        out[name] = f.select("offset", F.from_json("value", schema).alias("r")).select("offset", "r.*")
    out["unknown"] = records.filter(~F.col("schema_name").isin(*AVRO_SCHEMAS))
    return out


def _typed(records: DataFrame) -> DataFrame:
    """offset, schema_name, value and one column per record type, parsed once
    per row (behind a Generate, so that no later use parses again)."""
    parsed = [F.when(F.col("schema_name") == n, F.from_json("value", t)).alias(n) for n, t in AVRO_SCHEMAS.items()]
    return records.select("offset", "schema_name", "value", F.inline(F.array(F.struct(*parsed))))


def demuxed_long(records: DataFrame) -> DataFrame:
    """S3 as one long frame, in one scan: offset, record type, entity id,
    minor-unit amount, event time."""
    pick = lambda field: F.coalesce(*[F.col(f"{n}.{f}") for n, f in field.items() if f])
    same = lambda f: {n: f for n in AVRO_SCHEMAS}
    t = _typed(records.filter(F.col("schema_name").isin(*AVRO_SCHEMAS))).filter(pick(same("eventId")).isNotNull())
    return t.select("offset", F.col("schema_name").alias("record_type"), pick(_ENTITY).alias("entity_id"),
                    pick(_AMOUNT).alias("amount_minor"),
                    F.timestamp_millis(pick(same("timestamp"))).cast("timestamp_ntz").alias("event_time"))


def schema_conformance(records: DataFrame) -> DataFrame:
    """per record type — records, unparsable ones, and ones missing a
    required field under the current schema; zero of both = compatible. One
    scan and one aggregate; a type without records has a row too."""
    t = _typed(records).withColumn("_json", F.try_parse_json("value").isNotNull())
    aggs, rows = [], []
    for n in AVRO_SCHEMAS:
        mine = F.col("schema_name") == n
        missing = reduce(lambda x, f: x | F.col(f"{n}.{f}").isNull(), AVRO_REQUIRED[n], F.lit(False))
        aggs += [F.count_if(mine).alias(f"n_{n}"), F.count_if(mine & ~F.col("_json")).alias(f"u_{n}"),
                 F.count_if(mine & F.col("_json") & missing).alias(f"m_{n}")]
        rows.append(F.struct(F.lit(n).alias("record_type"), F.col(f"n_{n}").alias("records"),
                             F.col(f"u_{n}").alias("unparsable"), F.col(f"m_{n}").alias("missing_required")))
    u = t.agg(*aggs).select(F.inline(F.array(*rows)))
    return u.withColumn("compatible", (F.col("unparsable") + F.col("missing_required")) == 0)


# ------------------------------------------------------------------ consumption
def consume_batch(records: DataFrame, message_id: Column, max_poll: int = 100) -> DataFrame:
    """Per poll batch (≤ ``max_poll`` records of a partition, in offset
    order): successes, skips (already-seen message ids) and failures (blank
    payloads). Batches are ``offset div max_poll`` within each partition."""
    r = records.withColumn("message_id", message_id)
    first = r.groupBy("message_id").agg(F.min(F.struct("offset", "delivery")).alias("_f"))
    j = r.join(first, "message_id")
    dup = F.struct("offset", "delivery") != F.col("_f")
    blank = F.col("value").isNull() | (F.trim("value") == "")
    j = j.select("partition", (F.col("offset") / max_poll).cast("long").alias("batch"),
                 F.when(blank, "FAILED").when(dup, "SKIPPED").otherwise("SUCCESS").alias("outcome"))
    return j.groupBy("partition", "batch").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("outcome") == "SUCCESS").alias("success"),
        F.count_if(F.col("outcome") == "SKIPPED").alias("skipped"), F.count_if(F.col("outcome") == "FAILED").alias("failed"))


def incremental_extract(source: DataFrame, mode: str, mark_ts=None, mark_id=None, ts_col: str = "updated_at",
                        id_col: str = "id") -> DataFrame:
    """Rows newer than the saved high-water mark. ``incrementing``:
    id > mark; ``timestamp``: ts > mark; ``timestamp+incrementing``:
    ts > mark.ts OR (ts = mark.ts AND id > mark.id). A pushed-down filter."""
    ts = F.lit(mark_ts).cast("timestamp_ntz") if mark_ts is not None else None
    if mode == "incrementing":
        cond = F.col(id_col) > F.lit(mark_id)
    elif mode == "timestamp":
        cond = F.col(ts_col) > ts
    elif mode == "timestamp+incrementing":
        cond = (F.col(ts_col) > ts) | ((F.col(ts_col) == ts) & (F.col(id_col) > F.lit(mark_id)))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return source.filter(cond)


def high_water_mark(extracted: DataFrame, ts_col: str = "updated_at", id_col: str = "id") -> DataFrame:
    """The next mark: the greatest (ts, id) extracted."""
    return extracted.agg(F.max(F.struct(ts_col, id_col)).alias("m")).select(
        F.col(f"m.{ts_col}").alias("mark_ts"), F.col(f"m.{id_col}").alias("mark_id"))


def upsert_merge(target: DataFrame, updates: DataFrame, pk: list[str], order_col: str | None = None) -> DataFrame:
    """``insert.mode=upsert`` — one update per pk (the latest by
    ``order_col``; without one the largest row, so that the result is fixed),
    then the target rows without an update plus the updates (a new table
    version)."""
    rest = [c for c in updates.columns if c not in pk]
    whole = F.struct(*rest)
    pick = F.max_by(whole, F.col(order_col)) if order_col else F.max(whole)
    updates = updates.groupBy(*pk).agg(pick.alias("_u")).select(*pk, *[F.col("_u")[c].alias(c) for c in rest])
    keep = target.join(updates.select(*pk), pk, "left_anti")
    return keep.unionByName(updates.select(*target.columns))


def file_source(spark: SparkSession, path: str, topic: str) -> DataFrame:
    """Text file → topic records (one record per line)."""
    return spark.read.text(path).select(F.lit(topic).alias("topic"), F.col("value"))


def file_sink(records: DataFrame, path: str) -> None:
    """Topic → text file (values, one per line)."""
    records.select(F.col("value").cast("string")).write.mode("overwrite").text(path)


def publish_changelog(stats: DataFrame, topic: str = "order-statistics") -> DataFrame:
    """Aggregate rows → (topic, key, JSON value) changelog records."""
    body = F.struct(F.col("product_id").alias("productId"), F.col("product_name").alias("productName"),
                    F.col("total_orders").alias("totalOrders"), F.col("total_quantity").alias("totalQuantity"),
                    F.col("total_revenue").alias("totalRevenue"), F.col("cancelled_orders").alias("cancelledOrders"))
    return stats.select(F.lit(topic).alias("topic"), F.col("product_id").alias("key"), F.to_json(body).alias("value"))


# ------------------------------------------------------------------ exactly-once
def eos_wrap(key="key", value="value", processed_at: int = 0) -> Column:
    """``{originalKey, data, processedAt, processor}``; JSON values are
    embedded as JSON, others as an escaped JSON string (the reference
    concatenates them unescaped)."""
    v = _c(value)
    parsed = F.try_parse_json(v)
    data = F.when(parsed.isNotNull(), F.to_json(parsed)).otherwise(json_string(v))
    return F.concat(F.lit('{"originalKey":'), json_string(F.coalesce(_c(key), F.lit("null"))), F.lit(',"data":'), data,
                    F.lit(f',"processedAt":{int(processed_at)},"processor":"exactly-once"}}'))


def exactly_once_transform(records: DataFrame, processed_at: int) -> DataFrame:
    """consume–transform–produce: output records keyed as the input."""
    return records.select("topic", "partition", "offset", "key", eos_wrap(processed_at=processed_at).alias("value"))


def eos_audit(records: DataFrame, processed_at: int) -> DataFrame:
    """audit row per input: source topic-partition, offset, key, sizes."""
    out = eos_wrap(processed_at=processed_at)
    return records.select(F.concat_ws("-", "topic", F.col("partition").cast("string")).alias("source_topic_partition"),
                          F.col("offset").alias("source_offset"), F.coalesce("key", F.lit("null")).alias("key"),
                          F.length("value").alias("input_size"), F.length(out).alias("output_size"),
                          F.lit(processed_at).cast("long").alias("timestamp"))


def exactly_once_fanout(out_path: str, audit_path: str, processed_at: int):
    """A ``foreachBatch`` function writing output and audit rows under
    ``batch_id=<id>`` (overwrite), so a replayed micro-batch rewrites the same
    files instead of duplicating them."""

    def write(batch: DataFrame, batch_id: int) -> None:
        exactly_once_transform(batch, processed_at).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        eos_audit(batch, processed_at).write.mode("overwrite").parquet(f"{audit_path}/batch_id={batch_id}")

    return write


# ------------------------------------------------------------------ outbox
def outbox_pending(outbox: DataFrame, limit: int = 100) -> DataFrame:
    """Oldest PENDING rows first (ties by id), ``limit`` per poll."""
    return outbox.filter(F.col("status") == "PENDING").orderBy("created_at", "id").limit(limit)


def outbox_status_update(outbox: DataFrame, results: DataFrame, as_of) -> DataFrame:
    """Publish results ``(id, success)`` → SENT with processed_at, or
    FAILED with retry_count + 1; other rows unchanged. Of several results of
    one id a success counts."""
    once = results.groupBy("id").agg(F.max("success").alias("_ok"))
    j = outbox.join(once, "id", "left")
    hit = F.col("_ok").isNotNull()
    now = F.lit(as_of).cast("timestamp_ntz")
    cols = []
    for c in outbox.columns:
        if c == "status":
            cols.append(F.when(hit, F.when(F.col("_ok"), "SENT").otherwise("FAILED")).otherwise(F.col(c)).alias(c))
        elif c == "processed_at":
            cols.append(F.when(hit & F.col("_ok"), now).otherwise(F.col(c)).alias(c))
        elif c == "retry_count":
            cols.append(F.when(hit & ~F.col("_ok"), F.col(c) + 1).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def outbox_emit(rows: DataFrame, aggregate_type: str, id_col: str, type_col: str, payload: Column, topic: str) -> DataFrame:
    """Domain changes → PENDING outbox rows."""
    return rows.select(F.lit(aggregate_type).alias("aggregate_type"), F.col(id_col).alias("aggregate_id"),
                       F.col(type_col).alias("event_type"), payload.alias("payload"), F.lit(topic).alias("topic"),
                       F.lit("PENDING").alias("status"))


def outbox_by_status(outbox: DataFrame, status: str) -> DataFrame:
    """P25."""
    return outbox.filter(F.col("status") == status)


def kafka_source(spark: SparkSession, bootstrap: str, topics: str | None = None, pattern: str | None = None,
                 max_offsets_per_trigger: int | None = None, stream: bool = True) -> DataFrame:
    """A Kafka topic as records — committed data only
    (``read_committed``), from the earliest offset, with headers. Needs the
    spark-sql-kafka package on the cluster (not deployed in this image)."""
    r = (spark.readStream if stream else spark.read).format("kafka").option("kafka.bootstrap.servers", bootstrap)
    r = r.option("subscribePattern", pattern) if pattern else r.option("subscribe", topics)
    r = (r.option("startingOffsets", "earliest").option("kafka.isolation.level", "read_committed")
         .option("includeHeaders", "true"))
    if max_offsets_per_trigger and stream:
        r = r.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return r.load().select("topic", "partition", "offset", "timestamp", F.col("key").cast("string").alias("key"),
                           F.col("value").cast("string").alias("value"), "headers")
