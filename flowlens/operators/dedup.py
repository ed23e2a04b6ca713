"""Idempotent consumption: message ids, first-delivery-wins dedup, the
processed-id store and its expiry (U1, U8, J10, A45, P13, F10).

Dedup is ``min_by(struct(*), arrival)`` per message id — a partial+final
aggregate, so a message id redelivered a billion times is combined map-side
(the streaming twin is ``dropDuplicatesWithinWatermark``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def message_id_offset(topic="topic", partition="partition", offset="offset") -> Column:
    """``topic-partition-offset``."""
    return F.concat_ws("-", _c(topic), _c(partition).cast("string"), _c(offset).cast("string"))


def message_id_header(header="message_id_hdr") -> Column:
    """the ``message-id`` header, else the offset id."""
    return F.coalesce(_c(header), message_id_offset())


def message_id_business(value="value", key="key", strict_parity: bool = False) -> Column:
    """``biz-`` + first of orderId, paymentId, eventId in the JSON value.

    Unparsable values use the record key (else partition-offset). A JSON value
    with none of the three falls back to the offset id; ``strict_parity``
    yields the literal ``biz-null`` instead, merging unrelated messages as the
    reference does. A blank value counts as JSON without those fields."""
    v = _c(value)
    j = F.try_parse_json(v)
    biz = F.coalesce(*[F.variant_get(j, f"$.{f}", "string") for f in ("orderId", "paymentId", "eventId")])
    blank = F.trim(v) == ""
    none = F.lit("biz-null") if strict_parity else message_id_offset()
    keyed = F.concat(F.lit("biz-"), F.coalesce(_c(key), F.concat_ws("-", F.col("partition").cast("string"),
                                                                     F.col("offset").cast("string"))))
    return (F.when(blank | (j.isNotNull() & biz.isNull()), none)
            .when(j.isNotNull(), F.concat(F.lit("biz-"), biz)).otherwise(keyed))


def valid_payload_split(records: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) — a NULL or blank payload is an error."""
    bad = F.col(value).isNull() | (F.trim(F.col(value)) == "")
    return records.filter(~bad), records.filter(bad)


def distinct_by_message_id(records: DataFrame, message_id: Column, arrival: list[str]) -> DataFrame:
    """First delivery per message id wins (``arrival`` orders deliveries)."""
    r = records.withColumn("message_id", message_id)
    rest = [c for c in r.columns if c != "message_id"]
    first = r.groupBy("message_id").agg(F.min_by(F.struct(*rest), F.struct(*arrival)).alias("_f"))
    return first.select("message_id", *[F.col("_f")[c].alias(c) for c in rest])


def processed_store(first: DataFrame, retention_days: int = 7) -> DataFrame:
    """The remembered ids (``processed_messages``): id, source position,
    processed_at and its expiry."""
    return first.select("message_id", "topic", F.col("partition").alias("partition_id"),
                        F.col("offset").alias("offset_id"), F.col("key").alias("message_key"),
                        "processed_at",
                        (F.col("processed_at") + F.make_dt_interval(F.lit(retention_days))).alias("expired_at"))


def dedup_anti_join(batch: DataFrame, store: DataFrame, message_id: Column, arrival: list[str]) -> DataFrame:
    """Records of ``batch`` whose id is not yet in ``store``; within the
    batch the first delivery wins."""
    b = batch.withColumn("message_id", message_id)
    fresh = b.join(store.select("message_id"), "message_id", "left_anti").drop("message_id")
    return distinct_by_message_id(fresh, message_id, arrival)


def expire_processed(store: DataFrame, as_of) -> DataFrame:
    """U8: drop ids whose ``expired_at < as_of``."""
    return store.filter(~(F.col("expired_at") < F.lit(as_of).cast("timestamp_ntz")))


def processed_count(store: DataFrame) -> DataFrame:
    """Number of remembered message ids."""
    return store.agg(F.count(F.lit(1)).alias("processed_count"))
