"""Catalog: compaction, state reads, idempotent consumption."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import dedup as U
from flowlens.operators import state as S
from flowlens.plans.registry import register
from flowlens.sources import fixtures as fx
from flowlens.sources.fixtures_sql import with_fixtures

AS_OF_TTL = "2024-01-30 12:00:00"
AS_OF_EXPIRY = "2024-01-20 00:00:00"
STORE_CUTOFF = "2024-01-15 00:00:00"

_COMPACT = ('SELECT topic, key, "partition", "offset", value, "timestamp" FROM state_changelog '
            'QUALIFY row_number() OVER (PARTITION BY topic, key ORDER BY "offset" DESC) = 1 AND value IS NOT NULL')
_INV = ("SELECT json_extract_string(value, '$.productId') AS product_id, "
        "CAST(json_extract(value, '$.totalQuantity') AS INTEGER) AS total_quantity, "
        "CAST(json_extract(value, '$.availableQuantity') AS INTEGER) AS available_quantity, "
        "CAST(json_extract(value, '$.reorderPoint') AS INTEGER) AS reorder_point FROM compacted "
        "WHERE topic = 'inventory-state'")


def _sql(body, *fix, **extra):
    return with_fixtures(body, *(fix or ("state_changelog",)), extra=extra or None)


def _compacted(spark, sf):
    return S.compact_state(fx.state_changelog(spark, sf))


@register("compact_state", _sql("SELECT * FROM compacted", compacted=_COMPACT))
def q_compact_state(spark, sf):
    return _compacted(spark, sf)


@register("state_store_counts", _sql("SELECT topic, count(*) AS live_keys FROM compacted GROUP BY topic",
                                     compacted=_COMPACT))
def q_state_store_counts(spark, sf):
    return S.state_store_counts(_compacted(spark, sf))


@register("state_lookup", _sql("SELECT * FROM compacted WHERE topic = 'product-state' AND key = 'K-7'",
                               compacted=_COMPACT))
def q_state_lookup(spark, sf):
    return S.state_lookup(_compacted(spark, sf), "product-state", "K-7")


@register("all_states", _sql("SELECT * FROM compacted WHERE topic = 'config-state'", compacted=_COMPACT))
def q_all_states(spark, sf):
    return S.state_lookup(_compacted(spark, sf), "config-state")


@register("low_stock", _sql("SELECT * FROM inv WHERE available_quantity <= reorder_point", compacted=_COMPACT, inv=_INV))
def q_low_stock(spark, sf):
    return S.low_stock(S.inventory_states(_compacted(spark, sf)))


@register("out_of_stock", _sql("SELECT * FROM inv WHERE available_quantity <= 0", compacted=_COMPACT, inv=_INV))
def q_out_of_stock(spark, sf):
    return S.out_of_stock(S.inventory_states(_compacted(spark, sf)))


@register("state_put_tombstone", _sql(
    "SELECT 'inventory-snapshot' AS topic, product_id AS key, CASE WHEN available_quantity <= 0 THEN NULL ELSE "
    "'{\"productId\":\"' || product_id || '\",\"availableQuantity\":' || available_quantity || "
    "',\"reorderPoint\":' || reorder_point || '}' END AS value FROM inv", compacted=_COMPACT, inv=_INV))
def q_state_put_tombstone(spark, sf):
    inv = S.inventory_states(_compacted(spark, sf))
    body = F.to_json(F.struct(F.col("product_id").alias("productId"),
                              F.col("available_quantity").alias("availableQuantity"),
                              F.col("reorder_point").alias("reorderPoint")))
    return S.state_put_tombstone(inv, "inventory-snapshot", "product_id", body, F.col("available_quantity") <= 0)


@register("expired_states", with_fixtures(
    f"SELECT * FROM (SELECT * FROM ttl_states QUALIFY row_number() OVER (PARTITION BY topic, key ORDER BY \"offset\" DESC) = 1) "
    f"WHERE coalesce(TIMESTAMP '{AS_OF_TTL}' > expires_at, FALSE)", "ttl_states"))
def q_expired_states(spark, sf):
    live = S.compact_state(fx.ttl_states(spark, sf).withColumn("value", F.lit("")))
    return S.expired_states(live.drop("value"), AS_OF_TTL)


# ------------------------------------------------------------------ dedup
_OFFSET_ID = "topic || '-' || \"partition\" || '-' || \"offset\""
_HEADER_ID = f"coalesce(message_id_hdr, {_OFFSET_ID})"
_BIZ = "coalesce(json_extract_string(value, '$.orderId'), json_extract_string(value, '$.paymentId'), json_extract_string(value, '$.eventId'))"
_BIZ_ID = (f"CASE WHEN trim(value) = '' OR (json_valid(value) AND {_BIZ} IS NULL) THEN {_OFFSET_ID} "
           f"WHEN json_valid(value) THEN 'biz-' || {_BIZ} "
           f"ELSE 'biz-' || coalesce(key, \"partition\" || '-' || \"offset\") END")
_DCOLS = 'topic, "partition", "offset", delivery, key, value, message_id_hdr, processed_at, expired_at'
_VALID = "SELECT * FROM deliveries WHERE value IS NOT NULL AND trim(value) <> ''"


def _first_sql(idexpr, src="valid"):
    return (f"SELECT {idexpr} AS message_id, {_DCOLS} FROM {src} "
            f"QUALIFY row_number() OVER (PARTITION BY {idexpr} ORDER BY \"offset\", delivery) = 1")


def _valid(spark, sf):
    return U.valid_payload_split(fx.deliveries(spark, sf))[0]


_ARRIVAL = ["offset", "delivery"]


@register("message_id_offset", with_fixtures(f"SELECT \"offset\", delivery, {_OFFSET_ID} AS message_id FROM deliveries", "deliveries"))
def q_message_id_offset(spark, sf):
    return fx.deliveries(spark, sf).select("offset", "delivery", U.message_id_offset().alias("message_id"))


@register("message_id_header", with_fixtures(f"SELECT \"offset\", delivery, {_HEADER_ID} AS message_id FROM deliveries", "deliveries"))
def q_message_id_header(spark, sf):
    return fx.deliveries(spark, sf).select("offset", "delivery", U.message_id_header().alias("message_id"))


@register("message_id_business", with_fixtures(f"SELECT \"offset\", delivery, {_BIZ_ID} AS message_id FROM deliveries", "deliveries"))
def q_message_id_business(spark, sf):
    return fx.deliveries(spark, sf).select("offset", "delivery", U.message_id_business().alias("message_id"))


@register("valid_payload_split", with_fixtures(
    f"SELECT \"offset\", delivery, value IS NOT NULL AND trim(value) <> '' AS is_valid FROM deliveries", "deliveries"))
def q_valid_payload_split(spark, sf):
    ok, bad = U.valid_payload_split(fx.deliveries(spark, sf))
    return (ok.select("offset", "delivery", F.lit(True).alias("is_valid"))
            .unionByName(bad.select("offset", "delivery", F.lit(False).alias("is_valid"))))


@register("distinct_by_message_id", with_fixtures(_first_sql(_HEADER_ID), "deliveries", extra={"valid": _VALID}))
def q_distinct_by_message_id(spark, sf):
    return U.distinct_by_message_id(_valid(spark, sf), U.message_id_header(), _ARRIVAL)


@register("distinct_by_offset", with_fixtures(_first_sql(_OFFSET_ID), "deliveries", extra={"valid": _VALID}))
def q_distinct_by_offset(spark, sf):
    return U.distinct_by_message_id(_valid(spark, sf), U.message_id_offset(), _ARRIVAL)


@register("distinct_by_business_key", with_fixtures(_first_sql(_BIZ_ID), "deliveries", extra={"valid": _VALID}))
def q_distinct_by_business_key(spark, sf):
    return U.distinct_by_message_id(_valid(spark, sf), U.message_id_business(), _ARRIVAL)


_STORE = ('SELECT message_id, topic, "partition" AS partition_id, "offset" AS offset_id, key AS message_key, '
          "processed_at, processed_at + INTERVAL 7 DAY AS expired_at FROM firsts")


def _store(spark, sf):
    return U.processed_store(U.distinct_by_message_id(_valid(spark, sf), U.message_id_header(), _ARRIVAL))


@register("processed_count", with_fixtures("SELECT count(*) AS processed_count FROM store", "deliveries",
                                           extra={"valid": _VALID, "firsts": _first_sql(_HEADER_ID), "store": _STORE}))
def q_processed_count(spark, sf):
    return U.processed_count(_store(spark, sf))


@register("expire_processed", with_fixtures(
    f"SELECT * FROM store WHERE NOT (expired_at < TIMESTAMP '{AS_OF_EXPIRY}')", "deliveries",
    extra={"valid": _VALID, "firsts": _first_sql(_HEADER_ID), "store": _STORE}))
def q_expire_processed(spark, sf):
    return U.expire_processed(_store(spark, sf), AS_OF_EXPIRY)


@register("dedup_anti_join", with_fixtures(
    _first_sql(_HEADER_ID, "fresh"), "deliveries",
    extra={"valid": _VALID, "firsts": _first_sql(_HEADER_ID), "store": _STORE,
           "old": f"SELECT * FROM store WHERE processed_at < TIMESTAMP '{STORE_CUTOFF}'",
           "fresh": f"SELECT * FROM valid WHERE {_HEADER_ID} NOT IN (SELECT message_id FROM old)"}))
def q_dedup_anti_join(spark, sf):
    store = _store(spark, sf).filter(F.col("processed_at") < F.lit(STORE_CUTOFF).cast("timestamp_ntz"))
    return U.dedup_anti_join(_valid(spark, sf), store, U.message_id_header(), _ARRIVAL)
