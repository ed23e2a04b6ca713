"""Catalog: lag, alerts, traffic, partitions, rebalances, traces, connectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.classify import lag_level_sql
from flowlens.operators import ops as O
from flowlens.plans.registry import register
from flowlens.sources import fixtures as fx
from flowlens.sources.fixtures_sql import with_fixtures

AS_OF_OPS = "2024-03-01 12:00:00"
OFFSET_CUTOFF = "2024-01-15 00:00:00"


def _lags(spark, sf):
    return O.lag_from_snapshots(fx.offset_snapshots(spark, sf))


def _act(spark, sf):
    return fx.activity_log(spark, sf)


_LAGS = f"""SELECT c.snapshot_id, c.topic, c."partition", group_id, ts, current_offset, end_offset,
  greatest(end_offset - current_offset, 0) AS lag, {lag_level_sql('greatest(end_offset - current_offset, 0)')} AS level
FROM (SELECT snapshot_id, group_id, topic, "partition", ts, current_offset FROM offset_snapshots) c
JOIN (SELECT snapshot_id, group_id, topic, "partition", end_offset FROM offset_snapshots) e USING (snapshot_id, group_id, topic, "partition")"""
_LATEST = """SELECT group_id, topic, "partition", arg_max(lag, struct_pack(t := ts, s := snapshot_id)) AS lag FROM lags GROUP BY ALL"""


def _lq(body, **extra):
    return with_fixtures(body, "offset_snapshots", extra={"lags": _LAGS, **extra})


def _aq(body, **extra):
    return with_fixtures(body, "activity_log", extra=extra or None)


def _alq(body, **extra):
    return with_fixtures(body, "activity_log", "offset_snapshots", extra={"lags": _LAGS, **extra})


# ------------------------------------------------------------------ lag
@register("partition_lag", _lq("SELECT * FROM lags"))
def q_partition_lag(spark, sf):
    snaps = fx.offset_snapshots(spark, sf)
    return O.partition_lag(snaps.drop("end_offset"), snaps.select("snapshot_id", "group_id", "topic", "partition", "end_offset"),
                           ("snapshot_id", "group_id", "topic", "partition"))


@register("lag_level", _lq("SELECT level, count(*) AS partitions FROM lags GROUP BY level"))
def q_lag_level(spark, sf):
    return _lags(spark, sf).groupBy("level").agg(F.count(F.lit(1)).alias("partitions"))


@register("group_lag", _lq("SELECT group_id, CAST(sum(lag) AS BIGINT) AS total_lag, count(*) AS partition_count, "
                           "max(lag) AS max_lag FROM latest GROUP BY group_id", latest=_LATEST))
def q_group_lag(spark, sf):
    return O.group_lag(_lags(spark, sf))


_RECENT = """SELECT * FROM (SELECT group_id, snapshot_id, ts, lag,
  row_number() OVER (PARTITION BY group_id ORDER BY ts DESC, snapshot_id DESC) AS recency FROM (
    SELECT group_id, snapshot_id, max(ts) AS ts, CAST(sum(lag) AS BIGINT) AS lag FROM lags GROUP BY ALL)) WHERE recency <= {n}"""


@register("lag_recent_snapshots", _lq("SELECT * FROM recent", recent=_RECENT.format(n=60)))
def q_lag_recent_snapshots(spark, sf):
    return O.lag_recent_snapshots(_lags(spark, sf), 60)


@register("lag_trend", _lq("""
SELECT *, CASE WHEN current_lag > average_lag * 1.5 THEN 'INCREASING' WHEN current_lag < average_lag * 0.5 THEN 'DECREASING'
  ELSE 'STABLE' END AS trend FROM (
  SELECT group_id, arg_max(lag, struct_pack(t := ts, s := snapshot_id)) AS current_lag, avg(lag) AS average_lag,
    min(lag) AS min_lag, max(lag) AS max_lag, count(*) AS sample_count FROM recent GROUP BY group_id) WHERE sample_count >= 2""",
    recent=_RECENT.format(n=10)))
def q_lag_trend(spark, sf):
    return O.lag_trend(_lags(spark, sf))


@register("lag_alert_transitions", _lq("""
SELECT * FROM (SELECT group_id, topic, "partition", ts, snapshot_id, lag, level,
  lag(level, 1, 'NORMAL') OVER (PARTITION BY group_id, topic, "partition" ORDER BY ts, snapshot_id) AS previous_level FROM lags)
WHERE level <> previous_level"""))
def q_lag_alert_transitions(spark, sf):
    return O.lag_alert_transitions(_lags(spark, sf))


@register("active_alerts", _lq("""
SELECT * FROM (SELECT group_id, topic, "partition", arg_max(level, struct_pack(t := ts, s := snapshot_id)) AS level
  FROM lags GROUP BY ALL) WHERE level IN ('WARNING', 'CRITICAL')"""))
def q_active_alerts(spark, sf):
    return O.active_alerts(_lags(spark, sf), "WARNING")


_STORED = """SELECT topic, "partition", arg_max("offset", struct_pack(t := record_ts, o := "offset")) AS "offset",
  max(record_ts) AS updated_at FROM activity_log WHERE committed {cond} GROUP BY ALL"""


@register("stored_offsets", _aq(_STORED.format(cond="")))
def q_stored_offsets(spark, sf):
    return O.stored_offsets(_act(spark, sf))


@register("save_offsets", _aq(
    "SELECT * FROM old WHERE (topic, \"partition\") NOT IN (SELECT (topic, \"partition\") FROM upd) UNION ALL SELECT * FROM upd",
    old=_STORED.format(cond=f"AND record_ts < TIMESTAMP '{OFFSET_CUTOFF}'"),
    upd=_STORED.format(cond=f"AND record_ts >= TIMESTAMP '{OFFSET_CUTOFF}'")))
def q_save_offsets(spark, sf):
    a = _act(spark, sf)
    cut = F.lit(OFFSET_CUTOFF).cast("timestamp_ntz")
    old = O.stored_offsets(a.filter(F.col("record_ts") < cut))
    late = a.filter((F.col("record_ts") >= cut) & F.col("committed"))  # one update per commit: the last one wins
    upd = late.select("topic", "partition", "offset", F.col("record_ts").alias("updated_at"))
    return O.save_offsets(old, upd)


@register("delete_offsets", _aq("SELECT * FROM st WHERE topic <> 'error-topic'", st=_STORED.format(cond="")))
def q_delete_offsets(spark, sf):
    return O.delete_offsets(O.stored_offsets(_act(spark, sf)), "error-topic")


# ------------------------------------------------------------------ traffic
_LAT = "(epoch_ms(consumed_ts) - epoch_ms(record_ts))"


@register("traffic_by_topic", _aq("SELECT topic, count(*) AS consumed, count_if(sent) AS sent, count_if(acked) AS acked, "
                                  "count_if(sent AND NOT acked) AS send_failed, count_if(committed) AS commits "
                                  "FROM activity_log GROUP BY topic"))
def q_traffic_by_topic(spark, sf):
    return O.traffic_by_topic(_act(spark, sf))


@register("latency_stats", _aq(f"SELECT topic, CAST(CASE WHEN count(*) > 0 THEN sum({_LAT}) // count(*) ELSE 0 END AS BIGINT) "
                               f"AS avg_latency_ms, coalesce(max({_LAT}), 0) AS max_latency_ms, "
                               f"coalesce(min({_LAT}), 0) AS min_latency_ms FROM activity_log GROUP BY topic"))
def q_latency_stats(spark, sf):
    return O.latency_stats(_act(spark, sf))


@register("send_success_pct", _aq("SELECT topic, count_if(sent) AS sent, count_if(acked) AS acked, "
                                  "CAST(CASE WHEN count_if(sent) > 0 THEN count_if(acked) * 100 // count_if(sent) ELSE 0 END AS BIGINT) "
                                  "AS success_pct FROM activity_log GROUP BY topic"))
def q_send_success_pct(spark, sf):
    return O.send_success_pct(_act(spark, sf))


@register("high_latency_records", _aq(f'SELECT topic, "partition", "offset", key, {_LAT} AS latency_ms FROM activity_log '
                                      f"WHERE {_LAT} > 5000"))
def q_high_latency_records(spark, sf):
    return O.high_latency_records(_act(spark, sf))


@register("messages_by_key", _aq("SELECT * FROM activity_log WHERE key = 'K-7'"))
def q_messages_by_key(spark, sf):
    """Records of one key (the batch form of the streaming filter)."""
    return _act(spark, sf).filter(F.col("key") == "K-7")


@register("metrics_summary", _alq("""
SELECT a.*, a.failed + a.send_errors AS errors, l.total_lag FROM (
  SELECT count_if(sent) AS produced, count(*) AS consumed, count_if(outcome = 'FAILED') AS failed,
    count_if(sent AND NOT acked) AS send_errors FROM activity_log) a,
  (SELECT CAST(coalesce(sum(lag), 0) AS BIGINT) AS total_lag FROM latest) l""", latest=_LATEST))
def q_metrics_summary(spark, sf):
    return O.metrics_summary(_act(spark, sf), _lags(spark, sf))


@register("lag_by_partition", _lq('SELECT topic, "partition", CAST(sum(lag) AS BIGINT) AS lag FROM latest GROUP BY ALL',
                                  latest=_LATEST))
def q_lag_by_partition(spark, sf):
    return O.lag_by_partition(_lags(spark, sf))


_DASH = """SELECT r.*, l.*, critical_alerts + warning_alerts AS total_alerts,
  CASE WHEN critical_alerts > 0 THEN 'CRITICAL' WHEN producer_success_rate < 90 OR consumer_success_rate < 90 THEN 'CRITICAL'
    WHEN producer_success_rate < 99 OR consumer_success_rate < 99 THEN 'WARNING' ELSE 'HEALTHY' END AS overall_health FROM
 (SELECT *, CASE WHEN messages_produced > 0 THEN (messages_produced - producer_errors) / messages_produced * 100 ELSE 100.0 END AS producer_success_rate,
    CASE WHEN messages_consumed > 0 THEN (messages_consumed - messages_failed) / messages_consumed * 100 ELSE 100.0 END AS consumer_success_rate
  FROM (SELECT count_if(sent) AS messages_produced, count_if(sent AND NOT acked) AS producer_errors,
    count(*) AS messages_consumed, count_if(outcome = 'FAILED') AS messages_failed FROM activity_log)) r,
 (SELECT CAST(coalesce(sum(c['lag']), 0) AS BIGINT) AS total_lag, count_if(c['level'] = 'CRITICAL') AS critical_alerts,
    count_if(c['level'] = 'WARNING') AS warning_alerts FROM (
    SELECT arg_max(struct_pack(lag := lag, level := level), struct_pack(t := ts, s := snapshot_id)) AS c FROM lags GROUP BY group_id, topic, "partition")) l"""


@register("pipeline_dashboard", _alq(_DASH))
def q_pipeline_dashboard(spark, sf):
    return O.pipeline_dashboard(_act(spark, sf), _lags(spark, sf))


@register("pipeline_dashboard_groups", _lq("SELECT group_id, CAST(sum(lag) AS BIGINT) AS total_lag, count(*) AS partition_count, "
                                           "max(lag) AS max_lag FROM latest GROUP BY group_id", latest=_LATEST))
def q_pipeline_dashboard_groups(spark, sf):
    """The dashboard's list of consumer groups."""
    return O.group_lag(_lags(spark, sf))


@register("kafka_health", _alq("""
SELECT CASE WHEN producer_success_rate < 90 THEN 'DOWN' WHEN producer_success_rate < 99 THEN 'DEGRADED' ELSE 'UP' END AS producer_health,
  CASE WHEN critical_alerts > 0 THEN 'DOWN'
       WHEN consumer_success_rate < 90 THEN 'DOWN' WHEN consumer_success_rate < 99 THEN 'DEGRADED' ELSE 'UP' END AS consumer_health,
  producer_success_rate, consumer_success_rate, critical_alerts FROM d""", d=_DASH))
def q_kafka_health(spark, sf):
    return O.kafka_health(_act(spark, sf), _lags(spark, sf))


# ------------------------------------------------------------------ partitions, rebalances
_PART = """SELECT topic, "partition", max("offset") AS last_offset, count_if(outcome = 'PROCESSED') AS processed_count,
  count_if(outcome = 'FAILED') AS error_count, arg_max(error, "offset") FILTER (WHERE error IS NOT NULL) AS last_error,
  arg_max(CASE outcome WHEN 'PROCESSED' THEN 'ACTIVE' WHEN 'FAILED' THEN 'ERROR' ELSE 'PROCESSING' END, "offset") AS status,
  count_if(outcome <> 'PROCESSED') AS buffered, max(CASE WHEN outcome = 'PROCESSED' THEN consumed_ts END) AS last_processed_at
FROM activity_log GROUP BY ALL"""


@register("partition_activity", _aq("SELECT * FROM part", part=_PART))
def q_partition_activity(spark, sf):
    return O.partition_activity(_act(spark, sf))


@register("buffer_summary", _aq("SELECT count(*) AS partitions, count_if(status = 'ACTIVE') AS active, "
                                "count_if(status = 'PROCESSING') AS processing, count_if(status = 'ERROR') AS error, "
                                "CAST(sum(buffered) AS BIGINT) AS total_buffered FROM part", part=_PART))
def q_buffer_summary(spark, sf):
    return O.buffer_summary(O.partition_activity(_act(spark, sf)))


@register("inactive_partitions", _aq(f"SELECT * FROM part WHERE last_processed_at < TIMESTAMP '{AS_OF_OPS}' - INTERVAL 60 MINUTE",
                                     part=_PART))
def q_inactive_partitions(spark, sf):
    return O.inactive_partitions(O.partition_activity(_act(spark, sf)), AS_OF_OPS, 60)


@register("rebalance_stats", with_fixtures("SELECT event_type, count(*) AS event_count, CAST(sum(partition_count) AS BIGINT) "
                                           "AS partition_count FROM rebalance_log GROUP BY event_type", "rebalance_log"))
def q_rebalance_stats(spark, sf):
    return O.rebalance_stats(fx.rebalance_log(spark, sf))


@register("rebalance_totals", with_fixtures("""
SELECT count_if(event_type = 'REVOCATION') AS total_rebalances, count_if(event_type = 'REVOCATION') AS total_revocations,
  count_if(event_type = 'ASSIGNMENT') AS total_assignments, count_if(event_type = 'LOST') AS total_lost,
  count_if(event_type = 'ERROR') AS total_errors,
  CAST(coalesce(sum(partition_count) FILTER (WHERE event_type = 'REVOCATION'), 0) AS BIGINT) AS revoked_partitions,
  CAST(coalesce(sum(partition_count) FILTER (WHERE event_type = 'ASSIGNMENT'), 0) AS BIGINT) AS assigned_partitions,
  CAST(coalesce(sum(partition_count) FILTER (WHERE event_type = 'LOST'), 0) AS BIGINT) AS lost_partitions
FROM rebalance_log""", "rebalance_log"))
def q_rebalance_totals(spark, sf):
    return O.rebalance_totals(fx.rebalance_log(spark, sf))


@register("recent_rebalances", with_fixtures("SELECT * FROM rebalance_log ORDER BY ts DESC, rebalance_id DESC LIMIT 10",
                                             "rebalance_log"))
def q_recent_rebalances(spark, sf):
    return O.recent_rebalances(fx.rebalance_log(spark, sf), 10)


@register("consumer_processing_metrics", _aq("""
SELECT count_if(outcome = 'PROCESSED') AS processed, count_if(outcome = 'FAILED') AS errors,
  (SELECT coalesce(avg(m), 0.0) FROM (SELECT arg_max(processing_ms, "offset") AS m FROM activity_log WHERE outcome = 'PROCESSED' GROUP BY key)) AS avg_processing_ms
FROM activity_log"""))
def q_consumer_processing_metrics(spark, sf):
    return O.consumer_processing_metrics(_act(spark, sf))


@register("rolling_failure_rate", _aq("""
SELECT topic, "offset", CASE WHEN calls >= 5 THEN failure_rate END AS failure_rate, calls,
  CASE WHEN calls >= 5 AND failure_rate >= 50.0 THEN 'OPEN' ELSE 'CLOSED' END AS state FROM (
  SELECT topic, "offset", avg(CASE WHEN outcome = 'FAILED' THEN 1 ELSE 0 END) OVER w * 100 AS failure_rate,
    count(*) OVER w AS calls FROM activity_log
  WINDOW w AS (PARTITION BY topic ORDER BY "offset" ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""))
def q_rolling_failure_rate(spark, sf):
    return O.rolling_failure_rate(_act(spark, sf), 10, 5, 50.0)


# ------------------------------------------------------------------ traces
_PARSE = """SELECT span_id, traceparent, CASE WHEN ok THEN parts[2] END AS tp_trace_id, CASE WHEN ok THEN parts[3] END AS tp_span_id,
  CASE WHEN ok THEN CAST(('0x' || parts[4]) AS INTEGER) % 2 = 1 END AS sampled FROM (
  SELECT *, coalesce(traceparent IS NOT NULL AND trim(traceparent) <> '' AND len(parts) = 4 AND parts[1] = '00'
    AND length(parts[2]) = 32 AND length(parts[3]) = 16 AND length(parts[4]) = 2 AND NOT regexp_matches(parts[2], '^0+$')
    AND NOT regexp_matches(parts[3], '^0+$') AND regexp_matches(parts[4], '^[0-9a-fA-F]{2}$'), FALSE) AS ok
  FROM (SELECT *, string_split(traceparent, '-') AS parts FROM traceparents))"""


def _parsed(spark, sf):
    t = fx.traceparents(spark, sf)
    p = t.withColumn("_p", O.parse_traceparent("traceparent"))
    return p.select("span_id", "traceparent", F.col("_p.trace_id").alias("tp_trace_id"),
                    F.col("_p.span_id").alias("tp_span_id"), F.col("_p.sampled").alias("sampled"))


@register("parse_traceparent", with_fixtures("SELECT * FROM parsed", "traceparents", extra={"parsed": _PARSE}))
def q_parse_traceparent(spark, sf):
    return _parsed(spark, sf)


@register("format_traceparent", with_fixtures(
    "SELECT span_id, '00-' || trace_id || '-' || span_id || '-' || CASE WHEN status = 'OK' THEN '01' ELSE '00' END AS traceparent "
    "FROM spans", "spans"))
def q_format_traceparent(spark, sf):
    s = fx.spans(spark, sf)
    return s.select("span_id", O.format_traceparent(sampled=F.col("status") == "OK").alias("traceparent"))


@register("span_duration_ms", with_fixtures("SELECT span_id, epoch_ms(ended_at) - epoch_ms(started_at) AS duration_ms FROM spans",
                                            "spans"))
def q_span_duration_ms(spark, sf):
    return fx.spans(spark, sf).select("span_id", O.span_duration_ms().alias("duration_ms"))


@register("trace_summary", with_fixtures("""
SELECT trace_id, count(*) AS span_count,
  coalesce(arg_min(name, struct_pack(s := started_at, i := span_id)) FILTER (WHERE parent_span_id IS NULL),
           arg_min(name, struct_pack(s := started_at, i := span_id))) AS root_name,
  min(started_at) AS started_at, coalesce(max(epoch_ms(ended_at) - epoch_ms(started_at)), 0) AS total_duration_ms,
  bool_or(status = 'ERROR') AS has_error FROM spans GROUP BY trace_id""", "spans"))
def q_trace_summary(spark, sf):
    return O.trace_summary(fx.spans(spark, sf)).drop("latest_at")


@register("recent_traces", with_fixtures("""
SELECT trace_id, count(*) AS span_count, max(started_at) AS latest_at FROM spans GROUP BY trace_id
ORDER BY latest_at DESC, trace_id LIMIT 50""", "spans"))
def q_recent_traces(spark, sf):
    return O.recent_traces(fx.spans(spark, sf)).select("trace_id", "span_count", "latest_at")


@register("trace_spans", with_fixtures("SELECT * FROM spans WHERE trace_id = lpad('b', 32, '0')", "spans"))
def q_trace_spans(spark, sf):
    return O.trace_spans(fx.spans(spark, sf), "0" * 31 + "b")


@register("bounded_span_history", with_fixtures("SELECT * FROM spans ORDER BY started_at DESC, span_id DESC LIMIT 1000", "spans"))
def q_bounded_span_history(spark, sf):
    return O.bounded_span_history(fx.spans(spark, sf), 1000)


@register("link_consumer_spans", with_fixtures("""
SELECT p.span_id, tp_trace_id AS parent_trace_id, tp_span_id AS parent_span_id, sampled, s.name AS parent_name,
  tp_span_id IS NULL AS is_root
FROM parsed p LEFT JOIN spans s ON s.span_id = p.tp_span_id AND s.trace_id = p.tp_trace_id""", "traceparents", extra={"parsed": _PARSE}))
def q_link_consumer_spans(spark, sf):
    return O.link_consumer_spans(fx.traceparents(spark, sf), fx.spans(spark, sf))


# ------------------------------------------------------------------ connectors
_CONN = ("connectors", "connector_status", "connector_tasks")


@register("connector_status", with_fixtures("SELECT * FROM connectors JOIN connector_status USING (connector)", *_CONN))
def q_connector_status(spark, sf):
    return O.connector_status_join(fx.connectors(spark, sf), fx.connector_status(spark, sf))


@register("connector_detail", with_fixtures("""
SELECT connector, type, coalesce(state, 'UNKNOWN') AS state, worker_id, coalesce(task_count, 0) AS task_count,
  coalesce(running_tasks, 0) AS running_tasks, coalesce(failed_tasks, 0) AS failed_tasks
FROM connectors LEFT JOIN connector_status USING (connector) LEFT JOIN (
  SELECT connector, count(*) AS task_count, count_if(state = 'RUNNING') AS running_tasks, count_if(state = 'FAILED') AS failed_tasks
  FROM connector_tasks GROUP BY connector) USING (connector)""", *_CONN))
def q_connector_detail(spark, sf):
    return O.connector_detail(fx.connectors(spark, sf), fx.connector_status(spark, sf), fx.connector_tasks(spark, sf))


@register("connector_health", with_fixtures("""
SELECT *, CASE WHEN failed > 0 THEN 'DOWN' WHEN paused > 0 THEN 'DEGRADED' ELSE 'UP' END AS health FROM
 (SELECT count(*) AS connectors, count_if(state = 'RUNNING') AS running, count_if(state = 'PAUSED') AS paused,
    count_if(state = 'FAILED') AS failed FROM connectors LEFT JOIN connector_status USING (connector)),
 (SELECT count(*) AS tasks, count_if(state = 'FAILED') AS failed_tasks FROM connector_tasks)""", *_CONN))
def q_connector_health(spark, sf):
    return O.connector_health(fx.connectors(spark, sf), fx.connector_status(spark, sf), fx.connector_tasks(spark, sf))


@register("connector_state_changes", with_fixtures("""
SELECT * FROM (SELECT connector, checked_at, lag(state) OVER (PARTITION BY connector ORDER BY checked_at) AS previous_state, state
  FROM connector_history) WHERE previous_state IS NOT NULL AND previous_state <> state""", "connector_history"))
def q_connector_state_changes(spark, sf):
    return O.connector_state_changes(fx.connector_history(spark, sf))


@register("rate_health", _aq("""
SELECT topic, rate, CASE WHEN rate < 90 THEN 'DOWN' WHEN rate < 99 THEN 'DEGRADED' ELSE 'UP' END AS health FROM (
  SELECT topic, CASE WHEN count_if(outcome IN ('PROCESSED', 'FAILED')) > 0
    THEN count_if(outcome = 'PROCESSED') / count_if(outcome IN ('PROCESSED', 'FAILED')) * 100 ELSE 100.0 END AS rate
  FROM activity_log GROUP BY topic)"""))
def q_rate_health(spark, sf):
    """F7 per topic: processing success rate → health."""
    from flowlens.functions.classify import rate_health
    a = _act(spark, sf)
    done = F.count_if(F.col("outcome").isin("PROCESSED", "FAILED"))
    g = a.groupBy("topic").agg(F.when(done > 0, F.count_if(F.col("outcome") == "PROCESSED") / done * 100)
                               .otherwise(F.lit(100.0)).alias("rate"))
    return g.withColumn("health", rate_health("rate"))
