"""Catalog: streaming twins (run to completion, checked against the batch SQL)
and the offline forms of micro-batching, sampling and the late-event audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.plans.q_projections import _PREFIX, _SAGA, _SUMMARY
from flowlens.plans.q_sources import PROCESSED_AT_MS, _capture_sql
from flowlens.plans.registry import ORACLE
from flowlens.plans.q_state import _COMPACT
from flowlens.plans.q_stats import _STATS_SQL
from flowlens.plans.registry import register
from flowlens.sources import fixtures as fx
from flowlens.sources.fixtures_sql import with_fixtures
from flowlens.streaming import jobs as J


@register("stream_product_stats", with_fixtures("SELECT * FROM stats", "order_events", extra={"stats": _STATS_SQL}))
def q_stream_product_stats(spark, sf):
    return J.stream_product_stats(spark, sf)


# Kafka Streams' rule: a row whose window ended at or before the largest timestamp seen before it is dropped.
_ON_TIME = """SELECT * FROM (SELECT *, max({ts}) OVER (ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stream_time
  FROM order_events) WHERE {neg} coalesce(date_trunc('hour', {ts}) + INTERVAL 1 HOUR <= stream_time, FALSE)"""
_HOURLY_ON_TIME = """SELECT date_trunc('hour', late_timestamp) AS window_start, date_trunc('hour', late_timestamp) + INTERVAL 1 HOUR AS window_end,
  product_id, count(*) AS order_count FROM on_time GROUP BY ALL"""


@register("stream_hourly_count", with_fixtures(_HOURLY_ON_TIME, "order_events",
                                               extra={"on_time": _ON_TIME.format(ts="late_timestamp", neg="NOT")}))
def q_stream_hourly_count(spark, sf):
    return J.stream_hourly_count(spark, sf, "late_timestamp")[0]


@register("stream_hourly_late", with_fixtures('SELECT "offset", product_id, late_timestamp FROM late', "order_events",
                                              extra={"late": _ON_TIME.format(ts="late_timestamp", neg="")}))
def q_stream_hourly_late(spark, sf):
    """The rows that the hourly stream dropped, from its side sink."""
    return J.stream_hourly_count(spark, sf, "late_timestamp")[1].select("offset", "product_id", "late_timestamp")


_HEADER_ID = "coalesce(message_id_hdr, topic || '-' || \"partition\" || '-' || \"offset\")"


@register("stream_dedup", with_fixtures(
    f"""SELECT * FROM (SELECT *, {_HEADER_ID} AS message_id FROM deliveries WHERE value IS NOT NULL AND trim(value) <> '')
    QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY "offset", delivery) = 1""", "deliveries"))
def q_stream_dedup(spark, sf):
    return J.stream_dedup(spark, sf)


@register("stream_compact", with_fixtures("SELECT * FROM compacted", "state_changelog", extra={"compacted": _COMPACT}))
def q_stream_compact(spark, sf):
    return J.stream_compact(spark, sf)


@register("stream_saga", with_fixtures("SELECT * FROM sagas", "saga_decoded", "saga_starts", extra={"pre": _PREFIX, "sagas": _SAGA}))
def q_stream_saga(spark, sf):
    return J.stream_saga(spark, sf)


@register("stream_projection", with_fixtures("SELECT * FROM summ", "saga_decoded", extra={"summ": _SUMMARY}))
def q_stream_projection(spark, sf):
    return J.stream_projection(spark, sf)


@register("stream_dlt_capture", with_fixtures(_capture_sql(True), "dead_letter_records"))
def q_stream_dlt_capture(spark, sf):
    return J.stream_dlt_capture(spark, sf)


@register("micro_batches", with_fixtures("""
SELECT topic, "partition", "offset", key, record_ts, date_trunc('day', record_ts) AS bucket_start,
  (row_number() OVER (PARTITION BY date_trunc('day', record_ts) ORDER BY record_ts, "offset") - 1) // 100 AS chunk
FROM activity_log""", "activity_log"))
def q_micro_batches(spark, sf):
    a = fx.activity_log(spark, sf).select("topic", "partition", "offset", "key", "record_ts")
    return J.micro_batches(a, "record_ts", 1440, 100, ["record_ts", "offset"])


@register("sample_latest", with_fixtures("""
SELECT date_trunc('hour', record_ts) AS interval_start, topic, "partition", "offset", key, record_ts FROM activity_log
QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', record_ts) ORDER BY "offset" DESC) = 1""", "activity_log"))
def q_sample_latest(spark, sf):
    a = fx.activity_log(spark, sf).select("topic", "partition", "offset", "key", "record_ts")
    s = J.sample_latest(a, "record_ts", "1 hour")
    return s.withColumn("interval_start", F.col("interval_start").cast("timestamp_ntz"))


@register("late_event_audit", with_fixtures("""
SELECT "offset", late_timestamp, window_end, stream_time FROM (
  SELECT "offset", late_timestamp, date_trunc('hour', late_timestamp) + INTERVAL 1 HOUR AS window_end,
    max(late_timestamp) OVER (ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stream_time
  FROM order_events) WHERE window_end <= stream_time""", "order_events"))
def q_late_event_audit(spark, sf):
    return J.late_event_audit(fx.order_events(spark, sf), "late_timestamp", "offset", 60)


_EOS_OUT = ORACLE["exactly_once_transform"]
_EOS_AUDIT = ORACLE["eos_audit"]


@register("file_source_sink", with_fixtures("SELECT 'order-events' AS topic, order_id AS value FROM order_events", "order_events"))
def q_file_source_sink(spark, sf):
    return J.file_source_sink(spark, sf)


@register("exactly_once_fanout", _EOS_OUT)
def q_exactly_once_fanout(spark, sf):
    return J.exactly_once_fanout_job(spark, sf, PROCESSED_AT_MS)[0]


@register("exactly_once_fanout_audit", _EOS_AUDIT)
def q_exactly_once_fanout_audit(spark, sf):
    return J.exactly_once_fanout_job(spark, sf, PROCESSED_AT_MS)[1]
