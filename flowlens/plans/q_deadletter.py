"""Catalog: dead-letter analytics, decisions and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.classify import (alert_level_sql, classify_error, classify_error_sql,
                                         classify_error_short_sql)
from flowlens.operators import deadletter as D
from flowlens.operators.common import attach_one_row
from flowlens.plans.registry import register
from flowlens.sources import fixtures as fx
from flowlens.sources.fixtures_sql import with_fixtures

# Wall-clock stand-ins (FIXTURES.md): trend/dashboard, mixed retention, 90-day archive.
AS_OF_TREND = "2024-01-30 22:30:00"
AS_OF_RETENTION = "2024-02-02 00:00:00"
AS_OF_ARCHIVE = "2024-04-10 00:00:00"


def _fm(spark, sf):
    return fx.failed_messages(spark, sf)


def _sql(body, **extra):
    return with_fixtures(body, "failed_messages", extra=extra or None)


def _ts(v):
    return f"TIMESTAMP '{v}'"


_CLS = classify_error_sql("error_message")
_CLS4 = classify_error_short_sql("error_message")
_ALL = ("id, original_topic, partition_id, offset_id, message_key, message_value, error_message, status, "
        "created_at, resolved_at, retry_count")
_TOPIC_AN = """SELECT original_topic AS topic,
  count_if(status = 'PENDING') AS pending, count_if(status = 'RETRIED') AS retried,
  count_if(status = 'RESOLVED') AS resolved, count_if(status = 'IGNORED') AS ignored, count(*) AS total,
  CASE WHEN count(*) > 0 THEN count_if(status = 'PENDING') / count(*) * 100 ELSE 0.0 END AS pending_rate
FROM failed_messages GROUP BY original_topic"""


@register("failed_stats_topic_status", _sql(
    "SELECT original_topic, status, count(*) AS message_count FROM failed_messages GROUP BY ALL"))
def q_failed_stats_topic_status(spark, sf):
    return D.failed_stats_topic_status(_fm(spark, sf))


@register("failed_statistics", _sql(
    "SELECT count_if(status='PENDING') AS pending, count_if(status='RETRIED') AS retried, "
    "count_if(status='RESOLVED') AS resolved, count_if(status='IGNORED') AS ignored, count(*) AS total "
    "FROM failed_messages"))
def q_failed_statistics(spark, sf):
    return D.failed_statistics(_fm(spark, sf))


@register("error_pattern_groups", _sql(f"""
SELECT error_type, count(*) AS message_count,
  array_to_string(list_sort(list(DISTINCT original_topic)), ',') AS affected_topics,
  min(created_at) AS first_occurrence, max(created_at) AS last_occurrence,
  array_to_string(list_slice(list_sort(list(id)), 1, 5), ',') AS sample_ids
FROM (SELECT *, {_CLS} AS error_type FROM failed_messages WHERE status = 'PENDING') GROUP BY error_type"""))
def q_error_pattern_groups(spark, sf):
    return D.error_pattern_groups(_fm(spark, sf))


@register("classify_error", _sql(f"SELECT id, {_CLS} AS error_type, {_CLS4} AS error_type_short FROM failed_messages"))
def q_classify_error(spark, sf):
    from flowlens.functions.classify import classify_error_short
    return _fm(spark, sf).select("id", classify_error("error_message").alias("error_type"),
                                 classify_error_short("error_message").alias("error_type_short"))


@register("topic_failure_analysis", _sql(_TOPIC_AN))
def q_topic_failure_analysis(spark, sf):
    return D.topic_failure_analysis(_fm(spark, sf))


_TREND_SQL = f"""
SELECT g.hour, coalesce(c.message_count, 0) AS message_count
FROM (SELECT date_trunc('hour', {_ts(AS_OF_TREND)} - to_hours(i)) AS hour FROM range(24) t(i)) g
LEFT JOIN (SELECT date_trunc('hour', created_at) AS hour, count(*) AS message_count FROM failed_messages
           WHERE status = 'PENDING' AND created_at BETWEEN {_ts(AS_OF_TREND)} - INTERVAL 24 HOUR AND {_ts(AS_OF_TREND)}
           GROUP BY 1) c USING (hour)"""


@register("hourly_failure_trend", _sql(_TREND_SQL))
def q_hourly_failure_trend(spark, sf):
    return D.hourly_failure_trend(spark, _fm(spark, sf), AS_OF_TREND, 24)


_RETRY_SQL = """
SELECT count_if(status = 'RETRIED') AS total_retried,
  count_if(status = 'PENDING' AND retry_count > 0) AS pending_after_retry,
  coalesce(avg(CASE WHEN status = 'RETRIED' THEN retry_count END), 0.0) AS avg_retries_for_success,
  CASE WHEN count_if(status = 'RETRIED') + count_if(status = 'PENDING' AND retry_count > 0) > 0
       THEN count_if(status = 'RETRIED') / (count_if(status = 'RETRIED') + count_if(status = 'PENDING' AND retry_count > 0)) * 100
       ELSE 0.0 END AS success_rate
FROM failed_messages"""


@register("retry_efficiency", _sql(_RETRY_SQL))
def q_retry_efficiency(spark, sf):
    return D.retry_efficiency(_fm(spark, sf))


@register("retry_distribution", _sql(
    "SELECT retry_count, count(*) AS message_count FROM failed_messages GROUP BY retry_count"))
def q_retry_distribution(spark, sf):
    return D.retry_distribution(_fm(spark, sf))


@register("retry_distribution_pending", _sql(
    "SELECT retry_count, count(*) AS message_count FROM failed_messages WHERE status = 'PENDING' GROUP BY retry_count"))
def q_retry_distribution_pending(spark, sf):
    return D.retry_distribution(_fm(spark, sf), "PENDING")


@register("failures_per_day", _sql(
    "SELECT CAST(created_at AS DATE) AS day, count(*) AS message_count FROM failed_messages "
    "WHERE created_at >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1"))
def q_failures_per_day(spark, sf):
    return D.failures_per_day(_fm(spark, sf), "2024-01-20 00:00:00")


_RECENT = (f"status = 'PENDING' AND created_at BETWEEN {_ts(AS_OF_TREND)} - INTERVAL 1 HOUR AND {_ts(AS_OF_TREND)} "
           f"AND date_trunc('hour', created_at) = date_trunc('hour', {_ts(AS_OF_TREND)})")
_DASH_SQL = f"""
SELECT s.*, {alert_level_sql('pending', 'recent_hour_count')} AS alert_level, t.top_topics FROM (
  SELECT count_if(status='PENDING') AS pending, count_if(status='RETRIED') AS retried,
    count_if(status='RESOLVED') AS resolved, count_if(status='IGNORED') AS ignored,
    count_if({_RECENT}) AS recent_hour_count,
    CASE WHEN count_if(status = 'RETRIED') + count_if(status = 'PENDING' AND retry_count > 0) > 0
       THEN count_if(status = 'RETRIED') / (count_if(status = 'RETRIED') + count_if(status = 'PENDING' AND retry_count > 0)) * 100
       ELSE 0.0 END AS retry_success_rate
  FROM failed_messages) s,
 (SELECT string_agg(topic, ',' ORDER BY total DESC, topic) AS top_topics
  FROM (SELECT * FROM topic_an ORDER BY total DESC, topic LIMIT 5)) t"""


@register("dlt_dashboard", _sql(_DASH_SQL, topic_an=_TOPIC_AN))
def q_dlt_dashboard(spark, sf):
    return D.dlt_dashboard(_fm(spark, sf), AS_OF_TREND)


@register("dlt_topic_detail", _sql(
    "SELECT original_topic AS topic, count_if(status = 'PENDING') AS pending_count, "
    "count_if(status = 'RETRIED') AS retried_count, "
    "coalesce(avg(CASE WHEN status = 'PENDING' THEN retry_count END), 0.0) AS avg_retry_count "
    "FROM failed_messages GROUP BY 1"))
def q_dlt_topic_detail(spark, sf):
    return D.dlt_topic_detail(_fm(spark, sf))


@register("dlt_topic_error_types", _sql(
    f"SELECT original_topic AS topic, {_CLS4} AS error_type, count(*) AS message_count "
    "FROM failed_messages WHERE status = 'PENDING' GROUP BY ALL"))
def q_dlt_topic_error_types(spark, sf):
    return D.dlt_topic_error_types(_fm(spark, sf))


_HEALTH_SQL = f"""
SELECT pending_count, recent_added_count, status,
  CASE status WHEN 'CRITICAL' THEN 'Critical: ' || pending_count || ' pending messages, ' || recent_added_count || ' added in last 10 min'
              WHEN 'WARNING' THEN 'Warning: ' || pending_count || ' pending messages need attention'
              ELSE 'Healthy: DLT queue is under control' END AS message
FROM (SELECT *, CASE WHEN pending_count > 1000 THEN 'CRITICAL' WHEN pending_count > 100 THEN 'WARNING'
                     WHEN recent_added_count > 50 THEN 'WARNING' ELSE 'HEALTHY' END AS status
      FROM (SELECT count_if(status = 'PENDING') AS pending_count,
              count_if(status = 'PENDING' AND created_at BETWEEN {_ts(AS_OF_TREND)} - INTERVAL 10 MINUTE AND {_ts(AS_OF_TREND)}) AS recent_added_count
            FROM failed_messages))"""


@register("dlt_health", _sql(_HEALTH_SQL))
def q_dlt_health(spark, sf):
    return D.dlt_health(_fm(spark, sf), AS_OF_TREND)


@register("dlt_detailed_dashboard", _sql(f"""
SELECT d.*, e.unique_error_types, CAST(e.total_pending AS BIGINT) AS total_pending, tr.trend_24h_total
FROM ({_DASH_SQL}) d,
  (SELECT count(DISTINCT {_CLS}) AS unique_error_types, count(*) AS total_pending FROM failed_messages WHERE status = 'PENDING') e,
  (SELECT CAST(sum(message_count) AS BIGINT) AS trend_24h_total FROM ({_TREND_SQL})) tr""", topic_an=_TOPIC_AN))
def q_dlt_detailed_dashboard(spark, sf):
    parts = D.dlt_detailed_dashboard(spark, _fm(spark, sf), AS_OF_TREND)
    e = parts["error_patterns"].agg(F.count(F.lit(1)).alias("unique_error_types"),
                                    F.sum("message_count").alias("total_pending"))
    tr = parts["hourly_trend"].agg(F.sum("message_count").alias("trend_24h_total"))
    return attach_one_row(attach_one_row(parts["summary"], e), tr)


@register("distinct_topics", _sql("SELECT DISTINCT original_topic AS topic FROM failed_messages"))
def q_distinct_topics(spark, sf):
    return D.distinct_topics(_fm(spark, sf))


def _preview_sql(as_of):
    return f"""SELECT *, resolved_to_delete + ignored_to_delete + retried_to_delete + pending_to_archive AS total_to_affect FROM (
SELECT count_if(status = 'RESOLVED' AND created_at <= {_ts(as_of)} - INTERVAL 7 DAY) AS resolved_to_delete,
  count_if(status = 'IGNORED' AND created_at <= {_ts(as_of)} - INTERVAL 3 DAY) AS ignored_to_delete,
  count_if(status = 'RETRIED' AND created_at <= {_ts(as_of)} - INTERVAL 30 DAY) AS retried_to_delete,
  count_if(status = 'PENDING' AND created_at <= {_ts(as_of)} - INTERVAL 90 DAY) AS pending_to_archive
FROM failed_messages)"""


@register("cleanup_preview", _sql(_preview_sql(AS_OF_RETENTION)))
def q_cleanup_preview(spark, sf):
    return D.cleanup_preview(_fm(spark, sf), AS_OF_RETENTION)


@register("cleanup_preview_archive", _sql(_preview_sql(AS_OF_ARCHIVE)))
def q_cleanup_preview_archive(spark, sf):
    return D.cleanup_preview(_fm(spark, sf), AS_OF_ARCHIVE)


@register("search_failed_messages", _sql(
    f"SELECT {_ALL} FROM failed_messages WHERE status = 'PENDING' AND original_topic = 'click-topic' "
    "AND created_at >= TIMESTAMP '2024-01-10 00:00:00' AND created_at <= TIMESTAMP '2024-01-20 00:00:00' "
    "AND retry_count >= 2"))
def q_search_failed_messages(spark, sf):
    return D.search_failed_messages(_fm(spark, sf), status="PENDING", topic="click-topic",
                                    start="2024-01-10 00:00:00", end="2024-01-20 00:00:00", min_retry=2)


@register("search_error_text", _sql(f"SELECT {_ALL} FROM failed_messages WHERE contains(error_message, 'Exception')"))
def q_search_error_text(spark, sf):
    return D.search_error_text(_fm(spark, sf), "Exception")


@register("failed_by_topic", _sql(f"SELECT {_ALL} FROM failed_messages WHERE original_topic = 'error-topic'"))
def q_failed_by_topic(spark, sf):
    return D.failed_by(_fm(spark, sf), topic="error-topic")


@register("failed_by_status", _sql(f"SELECT {_ALL} FROM failed_messages WHERE status = 'RESOLVED'"))
def q_failed_by_status(spark, sf):
    return D.failed_by(_fm(spark, sf), status="RESOLVED")


@register("failed_not_status", _sql(f"SELECT {_ALL} FROM failed_messages WHERE status <> 'PENDING'"))
def q_failed_not_status(spark, sf):
    return D.failed_by(_fm(spark, sf), not_status="PENDING")


@register("failed_by_key", _sql(f"SELECT {_ALL} FROM failed_messages WHERE message_key = 'key-7'"))
def q_failed_by_key(spark, sf):
    return D.failed_by(_fm(spark, sf), key="key-7")


@register("failed_between", _sql(
    f"SELECT {_ALL} FROM failed_messages WHERE created_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' "
    "AND TIMESTAMP '2024-01-07 00:00:00'"))
def q_failed_between(spark, sf):
    return D.failed_by(_fm(spark, sf), between=("2024-01-05 00:00:00", "2024-01-07 00:00:00"))


@register("list_failed", _sql(f"SELECT {_ALL} FROM failed_messages WHERE status = 'RETRIED' AND original_topic = 'view-topic'"))
def q_list_failed(spark, sf):
    return D.list_failed(_fm(spark, sf), status="RETRIED", topic="view-topic")


@register("reprocessable", _sql(
    f"SELECT {_ALL} FROM failed_messages WHERE status = 'PENDING' AND retry_count < 5 ORDER BY created_at, id LIMIT 50"))
def q_reprocessable(spark, sf):
    return D.reprocessable(_fm(spark, sf), 5, 50)


@register("recent_failures", _sql(f"""
SELECT * FROM (SELECT id, original_topic AS topic, {_CLS4} AS error_type, retry_count, created_at,
  row_number() OVER (PARTITION BY original_topic ORDER BY created_at DESC, id DESC) AS rank
  FROM failed_messages WHERE status = 'PENDING') WHERE rank <= 10"""))
def q_recent_failures(spark, sf):
    return D.recent_failures(_fm(spark, sf), 10, per_topic=True)


def _requests(spark, sf):
    """Reprocess requests derived from the event log: every message id (every
    third one three times), an unknown (negative) id for each 'error' event."""
    e = fx.table(spark, sf, "events", "event_id", "event_type")
    again = F.when(F.col("event_id") % 3 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    i = F.col("event_id") + 1
    return e.select(F.when(F.col("event_type") == "error", -i).otherwise(i).alias("id"), F.explode(again).alias("seq"))


_REQ_SQL = ("SELECT CASE WHEN event_type = 'error' THEN -event_id - 1 ELSE event_id + 1 END AS id, "
            "unnest(CASE WHEN event_id % 3 = 0 THEN [0, 1, 2] ELSE [0] END) AS seq FROM events")
# One request after another on the row that the last one left (a recursion over the request number).
_DEC_SQL = f"""
WITH RECURSIVE req AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM requests),
step AS (
  SELECT f.id AS fid, f.id, 0::BIGINT AS n, '' AS outcome, status, retry_count, resolved_at, message_value IS NULL AS bad
  FROM failed_messages f
  UNION ALL
  SELECT fid, s.id, s.n + 1, o.outcome, CASE WHEN o.outcome = 'SUCCESS' THEN 'RETRIED' ELSE status END,
    CASE WHEN o.outcome IN ('SUCCESS', 'FAILED') THEN retry_count + 1 ELSE retry_count END,
    CASE WHEN o.outcome = 'SUCCESS' THEN {_ts(AS_OF_TREND)} ELSE resolved_at END, bad
  FROM step s JOIN req r ON r.id = s.id AND r.n = s.n + 1, LATERAL (SELECT CASE WHEN s.status <> 'PENDING' THEN 'INVALID_STATUS'
    WHEN s.retry_count >= 5 THEN 'MAX_RETRY_EXCEEDED' WHEN s.bad THEN 'FAILED' ELSE 'SUCCESS' END AS outcome) o)
SELECT id, outcome, status AS new_status, retry_count AS new_retry_count, resolved_at AS new_resolved_at FROM step WHERE n > 0
UNION ALL
SELECT r.id, 'NOT_FOUND', NULL, NULL, NULL FROM req r ANTI JOIN failed_messages f ON r.id = f.id"""


@register("reprocess_decision", _sql("SELECT * FROM decisions", requests=_REQ_SQL, decisions=_DEC_SQL))
def q_reprocess_decision(spark, sf):
    return D.reprocess_decision(_fm(spark, sf), _requests(spark, sf), AS_OF_TREND)


@register("reprocess_outcomes", _sql(
    "SELECT count(*) AS total, count_if(outcome = 'SUCCESS') AS success, count_if(outcome = 'FAILED') AS failed, "
    "count_if(outcome NOT IN ('SUCCESS', 'FAILED')) AS skipped FROM decisions", requests=_REQ_SQL, decisions=_DEC_SQL))
def q_reprocess_outcomes(spark, sf):
    return D.reprocess_outcomes(D.reprocess_decision(_fm(spark, sf), _requests(spark, sf), AS_OF_TREND))


@register("apply_reprocess", _sql("""
SELECT f.id, original_topic, partition_id, offset_id, message_key, message_value, error_message,
  CASE WHEN d.id IS NULL THEN status ELSE new_status END AS status, created_at,
  CASE WHEN d.id IS NULL THEN resolved_at ELSE new_resolved_at END AS resolved_at,
  CASE WHEN d.id IS NULL THEN retry_count ELSE new_retry_count END AS retry_count
FROM failed_messages f LEFT JOIN (
  SELECT id, arg_max(new_status, new_retry_count) AS new_status, max(new_retry_count) AS new_retry_count,
    arg_max(new_resolved_at, new_retry_count) AS new_resolved_at
  FROM decisions WHERE outcome IN ('SUCCESS', 'FAILED') GROUP BY id) d ON f.id = d.id""", requests=_REQ_SQL, decisions=_DEC_SQL))
def q_apply_reprocess(spark, sf):
    fm = _fm(spark, sf)
    return D.apply_reprocess(fm, D.reprocess_decision(fm, _requests(spark, sf), AS_OF_TREND))


@register("bulk_update_status", _sql(f"""
SELECT id, original_topic, partition_id, offset_id, message_key, message_value, error_message,
  CASE WHEN t.hit THEN 'RESOLVED' ELSE status END AS status, created_at,
  CASE WHEN t.hit THEN {_ts(AS_OF_TREND)} ELSE resolved_at END AS resolved_at, retry_count
FROM failed_messages LEFT JOIN (SELECT DISTINCT id, TRUE AS hit FROM failed_messages WHERE {_CLS} = 'Timeout') t USING (id)"""))
def q_bulk_update_status(spark, sf):
    fm = _fm(spark, sf)
    ids = fm.filter(classify_error("error_message") == "Timeout").select("id")
    return D.bulk_update_status(fm, ids, "RESOLVED", AS_OF_TREND)


@register("ignore_resolve", _sql(
    "SELECT 13 AS id, count(*) > 0 AS updated FROM failed_messages WHERE id = 13"))
def q_ignore_resolve(spark, sf):
    return D.ignore_resolve(_fm(spark, sf), 13)


@register("retention_cleanup", _sql(f"""
SELECT {_ALL} FROM failed_messages WHERE NOT (
  (status = 'RESOLVED' AND created_at <= {_ts(AS_OF_RETENTION)} - INTERVAL 7 DAY) OR
  (status = 'IGNORED' AND created_at <= {_ts(AS_OF_RETENTION)} - INTERVAL 3 DAY) OR
  (status = 'RETRIED' AND created_at <= {_ts(AS_OF_RETENTION)} - INTERVAL 30 DAY))"""))
def q_retention_cleanup(spark, sf):
    return D.retention_cleanup(_fm(spark, sf), AS_OF_RETENTION)


_ARCH = f"(status = 'PENDING' AND created_at <= {_ts(AS_OF_ARCHIVE)} - INTERVAL 90 DAY)"
_ARCH_SEL = (f"id, original_topic, partition_id, offset_id, message_key, message_value, error_message, "
             f"CASE WHEN {_ARCH} THEN 'IGNORED' ELSE status END AS status, created_at, "
             f"CASE WHEN {_ARCH} THEN {_ts(AS_OF_ARCHIVE)} ELSE resolved_at END AS resolved_at, retry_count")


@register("archive_old_pending", _sql(f"SELECT {_ARCH_SEL} FROM failed_messages"))
def q_archive_old_pending(spark, sf):
    return D.archive_old_pending(_fm(spark, sf), AS_OF_ARCHIVE)


@register("full_cleanup", _sql(f"""
SELECT {_ARCH_SEL} FROM failed_messages WHERE NOT (
  (status = 'RESOLVED' AND created_at <= {_ts(AS_OF_ARCHIVE)} - INTERVAL 7 DAY) OR
  (status = 'IGNORED' AND created_at <= {_ts(AS_OF_ARCHIVE)} - INTERVAL 3 DAY) OR
  (status = 'RETRIED' AND created_at <= {_ts(AS_OF_ARCHIVE)} - INTERVAL 30 DAY))"""))
def q_full_cleanup(spark, sf):
    return D.full_cleanup(_fm(spark, sf), AS_OF_ARCHIVE)


@register("delete_by_status", _sql(f"SELECT {_ALL} FROM failed_messages WHERE status <> 'IGNORED'"))
def q_delete_by_status(spark, sf):
    return D.delete_by_status(_fm(spark, sf), "IGNORED")


@register("delete_by_ids", _sql(f"SELECT {_ALL} FROM failed_messages WHERE NOT ({_CLS} = 'Unknown')"))
def q_delete_by_ids(spark, sf):
    fm = _fm(spark, sf)
    return D.delete_by_ids(fm, fm.filter(classify_error("error_message") == "Unknown").select("id"))


@register("delete_before", _sql(
    f"SELECT {_ALL} FROM failed_messages WHERE NOT (status = 'RESOLVED' AND created_at < TIMESTAMP '2024-01-15 00:00:00')"))
def q_delete_before(spark, sf):
    return D.delete_before(_fm(spark, sf), "RESOLVED", "2024-01-15 00:00:00")


@register("retry_schedule", _sql("""
SELECT id, original_topic, retry_count,
  CASE WHEN retry_count + 1 >= 3 THEN NULL ELSE CAST(least(1000 * pow(2, retry_count), 10000) AS BIGINT) END AS backoff_ms,
  CASE WHEN retry_count + 1 >= 3 THEN original_topic || '.DLT' ELSE original_topic || '-retry' END AS route_topic
FROM failed_messages"""))
def q_retry_schedule(spark, sf):
    return D.retry_schedule(_fm(spark, sf))


@register("classify_error_short", _sql(f"SELECT id, {_CLS4} AS error_type FROM failed_messages"))
def q_classify_error_short(spark, sf):
    from flowlens.functions.classify import classify_error_short
    return _fm(spark, sf).select("id", classify_error_short("error_message").alias("error_type"))


@register("alert_level", _sql(f"""
SELECT original_topic AS topic, pending, recent, {alert_level_sql('pending', 'recent')} AS alert_level FROM (
  SELECT original_topic, count_if(status = 'PENDING') AS pending, count_if({_RECENT}) AS recent
  FROM failed_messages GROUP BY original_topic)"""))
def q_alert_level(spark, sf):
    """F6 per topic: pending count and recent-hour count → alert level."""
    from flowlens.functions.classify import alert_level
    fm = _fm(spark, sf)
    now = F.lit(AS_OF_TREND).cast("timestamp_ntz")
    recent = ((F.col("status") == "PENDING")
              & F.col("created_at").between(now - F.expr("INTERVAL 1 HOUR"), now)
              & (F.date_trunc("hour", "created_at") == F.date_trunc("hour", now)))
    g = fm.groupBy(F.col("original_topic").alias("topic")).agg(
        F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if(recent).alias("recent"))
    return g.withColumn("alert_level", alert_level("pending", "recent"))
