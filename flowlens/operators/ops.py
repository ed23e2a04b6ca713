"""Operational analytics: consumer lag, alerts, traffic, latency, partition
activity, rebalances, traces and connector health (A28–A40, A46, J4, J6, J7,
W2–W7, P15, P21, P22, U10, F17, F18, F23, F24, T6).

Inputs are the log tables of :mod:`flowlens.sources.fixtures` (offset
snapshots, activity log, rebalance log, spans, connector status). Reports are
partial+final aggregates; "latest per key" is ``max_by``; bounded histories
("last N per group") use the two-phase :func:`top_k_per_group`, never a
whole-group sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.classify import lag_level, rate_health
from flowlens.operators.common import attach_one_row, top_k_per_group

LEVEL_RANK = {"NORMAL": 0, "WARNING": 1, "CRITICAL": 2}


def _rank(level: Column) -> Column:
    return F.when(level == "CRITICAL", 2).when(level == "WARNING", 1).otherwise(0)


# ------------------------------------------------------------------ lag
def partition_lag(committed: DataFrame, end_offsets: DataFrame, keys=("snapshot_id", "topic", "partition")) -> DataFrame:
    """Committed ⋈ end offsets on topic-partition (per poll); a missing end
    offset drops the row; lag is clamped at 0; F8 level."""
    j = committed.join(end_offsets, list(keys))
    lag = F.greatest(F.col("end_offset") - F.col("current_offset"), F.lit(0))
    return j.withColumn("lag", lag).withColumn("level", lag_level("lag"))


def lag_from_snapshots(snaps: DataFrame) -> DataFrame:
    """J4 for a log whose rows hold both offsets: the same rows without a join."""
    lag = F.greatest(F.col("end_offset") - F.col("current_offset"), F.lit(0))
    return (snaps.filter("current_offset IS NOT NULL AND end_offset IS NOT NULL")
            .select("snapshot_id", "topic", "partition", "group_id", "ts", "current_offset", "end_offset", lag.alias("lag"))
            .withColumn("level", lag_level("lag")))


def _newest() -> Column:
    return F.struct("ts", "snapshot_id")


def group_lag(lags: DataFrame) -> DataFrame:
    """Latest lag of each partition, then per group: total, partitions, max."""
    latest = lags.groupBy("group_id", "topic", "partition").agg(F.max_by("lag", _newest()).alias("lag"))
    return latest.groupBy("group_id").agg(F.sum("lag").alias("total_lag"), F.count(F.lit(1)).alias("partition_count"),
                                          F.max("lag").alias("max_lag"))


def lag_recent_snapshots(lags: DataFrame, n: int = 60) -> DataFrame:
    """The newest ``n`` lag samples of each group (60 kept, 10 analysed).
    A sample is the group's total lag over the partitions of one poll."""
    polls = lags.groupBy("group_id", "snapshot_id").agg(F.max("ts").alias("ts"), F.sum("lag").alias("lag"))
    return top_k_per_group(polls.select("group_id", "snapshot_id", "ts", "lag"), ["group_id"],
                           [F.col("ts").desc(), F.col("snapshot_id").desc()], n, rank_col="recency")


def lag_trend(lags: DataFrame, window: int = 10, history: int = 60) -> DataFrame:
    """Over the last ``window`` samples: avg, min, max, current; current
    > 1.5·avg INCREASING, < 0.5·avg DECREASING, else STABLE; fewer than two
    samples give no row."""
    recent = lag_recent_snapshots(lags, min(window, history))
    g = recent.groupBy("group_id").agg(
        F.max_by("lag", F.struct("ts", "snapshot_id")).alias("current_lag"), F.avg("lag").alias("average_lag"),
        F.min("lag").alias("min_lag"), F.max("lag").alias("max_lag"), F.count(F.lit(1)).alias("sample_count"))
    g = g.filter(F.col("sample_count") >= 2)
    return g.withColumn("trend", F.when(F.col("current_lag") > F.col("average_lag") * 1.5, "INCREASING")
                        .when(F.col("current_lag") < F.col("average_lag") * 0.5, "DECREASING").otherwise("STABLE"))


def lag_alert_transitions(lags: DataFrame) -> DataFrame:
    """Alert emitted only when a partition's level changes (initial NORMAL)."""
    w = Window.partitionBy("group_id", "topic", "partition").orderBy("ts", "snapshot_id")
    prev = F.lag("level", 1, "NORMAL").over(w)
    return (lags.select("group_id", "topic", "partition", "ts", "snapshot_id", "lag", "level", prev.alias("previous_level"))
            .filter(F.col("level") != F.col("previous_level")))


def active_alerts(lags: DataFrame, min_level: str = "WARNING") -> DataFrame:
    """Current (latest) level per partition at or above ``min_level``."""
    cur = lags.groupBy("group_id", "topic", "partition").agg(
        F.max_by("level", F.struct("ts", "snapshot_id")).alias("level"))
    return cur.filter(_rank(F.col("level")) >= LEVEL_RANK[min_level])


def stored_offsets(activity: DataFrame) -> DataFrame:
    """Latest committed offset per topic-partition."""
    c = activity.filter("committed")
    return c.groupBy("topic", "partition").agg(F.max_by("offset", F.struct("record_ts", "offset")).alias("offset"),
                                               F.max("record_ts").alias("updated_at"))


def save_offsets(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """Upsert offsets by topic-partition; of several updates the one with
    the latest ``updated_at`` (then the largest offset) wins."""
    rest = [c for c in stored.columns if c not in ("topic", "partition")]
    updates = updates.groupBy("topic", "partition").agg(
        F.max_by(F.struct(*rest), F.struct("updated_at", "offset")).alias("_u")).select(
        "topic", "partition", *[F.col("_u")[c].alias(c) for c in rest])
    keep = stored.join(updates.select("topic", "partition"), ["topic", "partition"], "left_anti")
    return keep.unionByName(updates.select(*stored.columns))


def delete_offsets(stored: DataFrame, topic: str) -> DataFrame:
    """Delete the stored offsets of one topic."""
    return stored.filter(F.col("topic") != topic)


# ------------------------------------------------------------------ traffic
def _latency_ms() -> Column:
    return F.unix_millis(F.col("consumed_ts").cast("timestamp")) - F.unix_millis(F.col("record_ts").cast("timestamp"))


def traffic_by_topic(activity: DataFrame) -> DataFrame:
    """Consumed, sent, acked, send failures, commits per topic."""
    return activity.groupBy("topic").agg(
        F.count(F.lit(1)).alias("consumed"), F.count_if("sent").alias("sent"), F.count_if("acked").alias("acked"),
        F.count_if(F.col("sent") & ~F.col("acked")).alias("send_failed"), F.count_if("committed").alias("commits"))


def latency_stats(activity: DataFrame) -> DataFrame:
    """Per topic — average latency (integer division), max, min; 0 if empty."""
    lat = _latency_ms()
    g = activity.groupBy("topic").agg(F.sum(lat).alias("_s"), F.count(lat).alias("_n"),
                                      F.max(lat).alias("_max"), F.min(lat).alias("_min"))
    return g.select("topic", F.when(F.col("_n") > 0, F.expr("_s div _n")).otherwise(F.lit(0)).cast("long")
                    .alias("avg_latency_ms"), F.coalesce("_max", F.lit(0)).alias("max_latency_ms"),
                    F.coalesce("_min", F.lit(0)).alias("min_latency_ms"))


def send_success_pct(activity: DataFrame) -> DataFrame:
    """``acked*100 div sent`` per topic; 0 when nothing was sent."""
    g = activity.groupBy("topic").agg(F.count_if("sent").alias("sent"), F.count_if("acked").alias("acked"))
    return g.withColumn("success_pct", F.when(F.col("sent") > 0, F.expr("(acked * 100) div sent"))
                        .otherwise(F.lit(0)))


def high_latency_records(activity: DataFrame, threshold_ms: int = 5000) -> DataFrame:
    """Records consumed more than ``threshold_ms`` after their timestamp."""
    return activity.select("topic", "partition", "offset", "key", _latency_ms().alias("latency_ms")) \
        .filter(F.col("latency_ms") > threshold_ms)


def metrics_summary(activity: DataFrame, lags: DataFrame) -> DataFrame:
    """Produced, consumed, failed, errors and total lag in one row."""
    a = activity.agg(F.count_if("sent").alias("produced"), F.count(F.lit(1)).alias("consumed"),
                     F.count_if(F.col("outcome") == "FAILED").alias("failed"),
                     F.count_if(F.col("sent") & ~F.col("acked")).alias("send_errors"))
    a = a.withColumn("errors", F.col("failed") + F.col("send_errors"))
    latest = lags.groupBy("group_id", "topic", "partition").agg(F.max_by("lag", _newest()).alias("lag"))
    return attach_one_row(a, latest.agg(F.coalesce(F.sum("lag"), F.lit(0)).alias("total_lag")))


def lag_by_partition(lags: DataFrame) -> DataFrame:
    """A31 (detail): latest lag per topic-partition summed over groups."""
    latest = lags.groupBy("group_id", "topic", "partition").agg(F.max_by("lag", _newest()).alias("lag"))
    return latest.groupBy("topic", "partition").agg(F.sum("lag").alias("lag"))


def pipeline_dashboard(activity: DataFrame, lags: DataFrame) -> DataFrame:
    """producer/consumer counts and success rates (100 without traffic;
    every consumed record counts, pending ones too), total lag, alert counts
    and overall health. The lag list of the groups is :func:`group_lag`, a
    table of its own since there may be any number of groups."""
    r = activity.agg(F.count_if("sent").alias("messages_produced"),
                     F.count_if(F.col("sent") & ~F.col("acked")).alias("producer_errors"),
                     F.count(F.lit(1)).alias("messages_consumed"),
                     F.count_if(F.col("outcome") == "FAILED").alias("messages_failed"))
    rate = lambda n, bad: F.when(F.col(n) > 0, (F.col(n) - F.col(bad)) / F.col(n) * 100).otherwise(F.lit(100.0))
    r = r.select("*", rate("messages_produced", "producer_errors").alias("producer_success_rate"),
                 rate("messages_consumed", "messages_failed").alias("consumer_success_rate"))
    cur = lags.groupBy("group_id", "topic", "partition").agg(F.max_by(F.struct("lag", "level"), F.struct("ts", "snapshot_id")).alias("c"))
    l = cur.agg(F.coalesce(F.sum("c.lag"), F.lit(0)).alias("total_lag"),
                F.count_if(F.col("c.level") == "CRITICAL").alias("critical_alerts"),
                F.count_if(F.col("c.level") == "WARNING").alias("warning_alerts"))
    d = attach_one_row(r, l)
    worst = F.least("producer_success_rate", "consumer_success_rate")
    health = F.when(F.col("critical_alerts") > 0, "CRITICAL").otherwise(rate_health(worst, "CRITICAL", "WARNING", "HEALTHY"))
    return d.withColumn("total_alerts", F.col("critical_alerts") + F.col("warning_alerts")).withColumn("overall_health", health)


def kafka_health(activity: DataFrame, lags: DataFrame) -> DataFrame:
    """Producer health from its send rate; the consumer is DOWN on any
    critical lag alert, else judged by its success rate."""
    d = pipeline_dashboard(activity, lags)
    return d.select(rate_health("producer_success_rate").alias("producer_health"),
                    F.when(F.col("critical_alerts") > 0, "DOWN")
                    .otherwise(rate_health("consumer_success_rate")).alias("consumer_health"),
                    "producer_success_rate", "consumer_success_rate", "critical_alerts")


# ------------------------------------------------------------------ partitions / rebalances
def partition_activity(activity: DataFrame) -> DataFrame:
    """Per partition — last offset, processed, errors, last error, status
    of the last record (PROCESSED→ACTIVE, FAILED→ERROR, else PROCESSING) and
    buffered count (received but never processed)."""
    st = F.when(F.col("outcome") == "PROCESSED", "ACTIVE").when(F.col("outcome") == "FAILED", "ERROR").otherwise("PROCESSING")
    return activity.groupBy("topic", "partition").agg(
        F.max("offset").alias("last_offset"), F.count_if(F.col("outcome") == "PROCESSED").alias("processed_count"),
        F.count_if(F.col("outcome") == "FAILED").alias("error_count"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.col("offset"))).alias("last_error"),
        F.max_by(st, "offset").alias("status"),
        F.count_if(F.col("outcome") != "PROCESSED").alias("buffered"),
        F.max(F.when(F.col("outcome") == "PROCESSED", F.col("consumed_ts"))).alias("last_processed_at"))


def buffer_summary(partitions: DataFrame) -> DataFrame:
    """Partitions per status and total buffered messages."""
    return partitions.agg(F.count(F.lit(1)).alias("partitions"),
                          *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("ACTIVE", "PROCESSING", "ERROR")],
                          F.sum("buffered").alias("total_buffered"))


def inactive_partitions(partitions: DataFrame, as_of, threshold_minutes: int = 60) -> DataFrame:
    """Partitions whose last processing is older than the threshold."""
    now = F.lit(as_of).cast("timestamp_ntz")
    return partitions.filter(F.col("last_processed_at") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(threshold_minutes)))


def rebalance_totals(rebalances: DataFrame) -> DataFrame:
    """Running totals in one row. A revocation is what starts a rebalance;
    errors carry no partitions."""
    n = lambda t: F.count_if(F.col("event_type") == t)
    parts = lambda t: F.coalesce(F.sum(F.when(F.col("event_type") == t, F.col("partition_count"))), F.lit(0))
    return rebalances.agg(
        n("REVOCATION").alias("total_rebalances"), n("REVOCATION").alias("total_revocations"),
        n("ASSIGNMENT").alias("total_assignments"), n("LOST").alias("total_lost"), n("ERROR").alias("total_errors"),
        parts("REVOCATION").alias("revoked_partitions"), parts("ASSIGNMENT").alias("assigned_partitions"),
        parts("LOST").alias("lost_partitions"))


def rebalance_stats(rebalances: DataFrame) -> DataFrame:
    """Event and partition counts by rebalance type."""
    return rebalances.groupBy("event_type").agg(F.count(F.lit(1)).alias("event_count"),
                                                F.sum("partition_count").alias("partition_count"))


def recent_rebalances(rebalances: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` most recent rebalance events."""
    return rebalances.orderBy(F.col("ts").desc(), F.col("rebalance_id").desc()).limit(n)


def consumer_processing_metrics(activity: DataFrame) -> DataFrame:
    """Processed, errors, and mean of the *latest* processing time per key."""
    done = activity.filter(F.col("outcome") == "PROCESSED")  # only successes leave a processing time
    per_key = done.groupBy("key").agg(F.max_by("processing_ms", "offset").alias("latest_ms"))
    a = activity.agg(F.count_if(F.col("outcome") == "PROCESSED").alias("processed"),
                     F.count_if(F.col("outcome") == "FAILED").alias("errors"))
    return attach_one_row(a, per_key.agg(F.coalesce(F.avg("latest_ms"), F.lit(0.0)).alias("avg_processing_ms")))


def rolling_failure_rate(activity: DataFrame, window: int = 10, min_calls: int = 5, threshold: float = 50.0,
                         block: int = 1 << 20) -> DataFrame:
    """Count-based sliding failure rate per topic (last ``window`` calls);
    reported once ``min_calls`` are seen; OPEN when at/over ``threshold``.

    Exact without a per-topic sort: calls are cut into offset blocks; each
    block receives, as context, the last ``window − 1`` calls before it —
    taken from the tails of the preceding ``window − 1`` non-empty blocks
    (a small per-block table) — and the sliding window runs per
    (topic, block). No task holds more than one block of a hot topic."""
    k = window - 1
    rows = activity.select("topic", "offset", (F.col("outcome") == "FAILED").cast("int").alias("failed"),
                           (F.col("offset") / block).cast("long").alias("_blk"))
    tails = top_k_per_group(rows, ["topic", "_blk"], [F.col("offset").desc()], k)
    tails = tails.groupBy("topic", "_blk").agg(F.collect_list(F.struct("offset", "failed")).alias("_tail"))
    prev = Window.partitionBy("topic").orderBy("_blk").rowsBetween(-k, -1)
    ctx = tails.select("topic", "_blk", F.flatten(F.collect_list("_tail").over(prev)).alias("_ctx"))
    ctx = ctx.select("topic", "_blk", F.slice(F.reverse(F.array_sort("_ctx")), 1, k).alias("_ctx"))
    ctx_rows = ctx.select("topic", "_blk", F.explode("_ctx").alias("c")).select(
        "topic", F.col("c.offset").alias("offset"), F.col("c.failed").alias("failed"), "_blk", F.lit(True).alias("_is_ctx"))
    both = rows.withColumn("_is_ctx", F.lit(False)).unionByName(ctx_rows)
    w = Window.partitionBy("topic", "_blk").orderBy("offset").rowsBetween(-k, 0)
    r = both.select("topic", "offset", "_is_ctx", (F.avg("failed").over(w) * 100).alias("failure_rate"),
                    F.count(F.lit(1)).over(w).alias("calls")).filter(~F.col("_is_ctx")).drop("_is_ctx")
    r = r.withColumn("failure_rate", F.when(F.col("calls") >= min_calls, F.col("failure_rate")))
    return r.withColumn("state", F.when(F.col("failure_rate") >= threshold, "OPEN").otherwise("CLOSED"))


# Sliding window (calls), calls before a rate is given, thresholds in per cent, slow from (ms).
CIRCUITS = {"default": (10, 5, 50.0, 50.0, 2000), "producer": (10, 5, 50.0, 80.0, 3000), "consumer": (20, 10, 70.0, 90.0, 5000)}


def circuit_states(activity: DataFrame, duration_ms: Column, circuits: dict = CIRCUITS, block: int = 1 << 20) -> DataFrame:
    """Failure rate and slow-call rate of the last calls per topic under
    every configuration; OPEN when either is at or over its threshold."""
    out = None
    for name, (window, least, failed_at, slow_at, slow_ms) in circuits.items():
        rates = rolling_failure_rate(activity, window, least, failed_at, block).drop("state")
        slow = activity.withColumn("outcome", F.when(duration_ms >= slow_ms, "FAILED").otherwise("PROCESSED"))
        slow = rolling_failure_rate(slow, window, least, slow_at, block).select(
            F.col("topic").alias("_topic"), F.col("offset").alias("_offset"), F.col("failure_rate").alias("slow_call_rate"))
        j = rates.join(slow, (F.col("topic") == F.col("_topic")) & (F.col("offset") == F.col("_offset"))).drop("_topic", "_offset")
        hit = (F.col("failure_rate") >= failed_at) | (F.col("slow_call_rate") >= slow_at)
        j = j.select(F.lit(name).alias("circuit"), "*", F.when(hit, "OPEN").otherwise("CLOSED").alias("state"))
        out = j if out is None else out.unionByName(j)
    return out


# ------------------------------------------------------------------ traces
def parse_traceparent(tp) -> Column:
    """``00-<32>-<16>-<2>`` → struct(trace_id, span_id, sampled); NULL
    when malformed, when an id is all zeros or flags are not hex."""
    t = F.col(tp) if isinstance(tp, str) else tp
    parts = F.split(t, "-", -1)
    ok = (t.isNotNull() & (F.trim(t) != "") & (F.size(parts) == 4)
          & (F.try_element_at(parts, F.lit(1)) == "00") & (F.length(F.try_element_at(parts, F.lit(2))) == 32)
          & (F.length(F.try_element_at(parts, F.lit(3))) == 16) & (F.length(F.try_element_at(parts, F.lit(4))) == 2)
          & ~F.try_element_at(parts, F.lit(2)).rlike("^0+$") & ~F.try_element_at(parts, F.lit(3)).rlike("^0+$")
          & F.try_element_at(parts, F.lit(4)).rlike("^[0-9a-fA-F]{2}$"))
    flags = F.conv(F.try_element_at(parts, F.lit(4)), 16, 10).cast("int")
    return F.when(ok, F.struct(F.try_element_at(parts, F.lit(2)).alias("trace_id"),
                               F.try_element_at(parts, F.lit(3)).alias("span_id"),
                               ((flags % 2) == 1).alias("sampled")))


def format_traceparent(trace_id="trace_id", span_id="span_id", sampled="sampled") -> Column:
    """``00-trace-span-01`` (``00`` when not sampled)."""
    s = F.col(sampled) if isinstance(sampled, str) else sampled
    return F.concat_ws("-", F.lit("00"), F.col(trace_id), F.col(span_id), F.when(s, "01").otherwise("00"))


def span_duration_ms(start="started_at", end="ended_at") -> Column:
    """end − start in milliseconds."""
    return (F.unix_millis(F.col(end).cast("timestamp")) - F.unix_millis(F.col(start).cast("timestamp")))


def trace_summary(spans: DataFrame) -> DataFrame:
    """Per trace — span count, root name (first parentless span, else the
    first span), start, longest span duration, any error; newest first."""
    d = span_duration_ms()
    g = spans.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("span_count"),
        F.min_by("name", F.when(F.col("parent_span_id").isNull(), F.struct("started_at", "span_id"))).alias("_root"),
        F.min_by("name", F.struct("started_at", "span_id")).alias("_first"),
        F.min("started_at").alias("started_at"), F.max("started_at").alias("_latest"),
        F.coalesce(F.max(d), F.lit(0)).alias("total_duration_ms"),
        F.bool_or(F.col("status") == "ERROR").alias("has_error"))
    return g.select("trace_id", "span_count", F.coalesce("_root", "_first").alias("root_name"), "started_at",
                    "total_duration_ms", "has_error", F.col("_latest").alias("latest_at"))


def recent_traces(spans: DataFrame, limit: int = 50) -> DataFrame:
    """A35 as a list: the traces with the newest spans first (a top-k)."""
    return trace_summary(spans).orderBy(F.col("latest_at").desc(), "trace_id").limit(limit)


def trace_spans(spans: DataFrame, trace_id: str) -> DataFrame:
    """Spans of one trace by start."""
    return spans.filter(F.col("trace_id") == trace_id).orderBy("started_at", "span_id")


def bounded_span_history(spans: DataFrame, n: int = 1000) -> DataFrame:
    """The newest ``n`` spans (a top-k, not a global sort)."""
    return spans.orderBy(F.col("started_at").desc(), F.col("span_id").desc()).limit(n)


def link_consumer_spans(messages: DataFrame, spans: DataFrame) -> DataFrame:
    """a consumer span's parent is the span named by the message's
    traceparent (same trace); without a valid one the consumer span is a root
    in a trace of its own. Left join on the parent's trace and span id."""
    p = messages.withColumn("_tp", parse_traceparent("traceparent"))
    linked = p.select("span_id", F.col("_tp.trace_id").alias("parent_trace_id"),
                      F.col("_tp.span_id").alias("parent_span_id"), F.col("_tp.sampled").alias("sampled"))
    known = spans.select(F.col("trace_id").alias("parent_trace_id"), F.col("span_id").alias("parent_span_id"),
                         F.col("name").alias("parent_name"))
    out = linked.join(known, ["parent_trace_id", "parent_span_id"], "left")
    return out.select("span_id", "parent_trace_id", "parent_span_id", "sampled", "parent_name",
                      F.col("parent_span_id").isNull().alias("is_root"))


# ------------------------------------------------------------------ connectors
def connector_status_join(connectors: DataFrame, status: DataFrame) -> DataFrame:
    """Connectors with a status row (missing status dropped)."""
    return connectors.join(status, "connector")


def connector_detail(connectors: DataFrame, status: DataFrame, tasks: DataFrame) -> DataFrame:
    """Connector ⟕ status ⟕ task counts; state UNKNOWN when missing."""
    t = tasks.groupBy("connector").agg(F.count(F.lit(1)).alias("task_count"),
                                       F.count_if(F.col("state") == "RUNNING").alias("running_tasks"),
                                       F.count_if(F.col("state") == "FAILED").alias("failed_tasks"))
    j = connectors.join(status, "connector", "left").join(t, "connector", "left")
    return j.select("connector", "type", F.coalesce("state", F.lit("UNKNOWN")).alias("state"), "worker_id",
                    F.coalesce("task_count", F.lit(0)).alias("task_count"),
                    F.coalesce("running_tasks", F.lit(0)).alias("running_tasks"),
                    F.coalesce("failed_tasks", F.lit(0)).alias("failed_tasks"))


def connector_health(connectors: DataFrame, status: DataFrame, tasks: DataFrame) -> DataFrame:
    """Counts over the connector list by connector state (a connector
    without status counts, but in no state); any FAILED connector → DOWN, any
    PAUSED → DEGRADED, else UP. Failed tasks are reported and do not decide."""
    listed = connectors.select("connector").join(status.select("connector", "state"), "connector", "left")
    c = listed.agg(F.count(F.lit(1)).alias("connectors"),
                   *[F.count_if(F.col("state") == s).alias(s.lower()) for s in ("RUNNING", "PAUSED", "FAILED")])
    t = tasks.agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("state") == "FAILED").alias("failed_tasks"))
    h = attach_one_row(c, t)
    return h.withColumn("health", F.when(F.col("failed") > 0, "DOWN")
                        .when(F.col("paused") > 0, "DEGRADED").otherwise("UP"))


def connector_state_changes(history: DataFrame) -> DataFrame:
    """State changes per connector; the first sighting is not a change."""
    w = Window.partitionBy("connector").orderBy("checked_at")
    prev = F.lag("state").over(w)
    return (history.select("connector", "checked_at", prev.alias("previous_state"), "state")
            .filter(F.col("previous_state").isNotNull() & (F.col("previous_state") != F.col("state"))))
