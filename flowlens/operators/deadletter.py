"""Dead-letter analytics, reprocessing decisions and retention (A13–A25,
A43–A44, P6–P10, T5, U2–U7, F9, F19).

Input: the ``failed_messages`` table (id, original_topic, partition_id,
offset_id, message_key, message_value, error_message, status, created_at,
resolved_at, retry_count). ``as_of`` replaces the wall clock everywhere.

Every report is a partial+final hash aggregate (``count_if``/``sum``/``min``/
``max``) — one scan, no sort of raw rows, hot topics combined map-side.
Mutations return a new version of the table, never update in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.functions.classify import alert_level, classify_error, classify_error_short
from flowlens.operators.common import attach_one_row, top_k_per_group

STATUSES = ("PENDING", "RETRIED", "RESOLVED", "IGNORED")
MAX_RETRY_COUNT = 5          # reprocess retry cap (configuration default)
RETENTION_DAYS = {"RESOLVED": 7, "IGNORED": 3, "RETRIED": 30}
PENDING_ARCHIVE_DAYS = 90


def _ts(v) -> Column:
    return F.lit(v).cast("timestamp_ntz") if not isinstance(v, Column) else v


def _minus(as_of, *, days: int = 0, hours: int = 0, mins: int = 0) -> Column:
    return _ts(as_of) - F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(mins))


# ------------------------------------------------------------ aggregates
def failed_stats_topic_status(fm: DataFrame) -> DataFrame:
    """Count by (topic, status)."""
    return fm.groupBy("original_topic", "status").agg(F.count(F.lit(1)).alias("message_count"))


def failed_statistics(fm: DataFrame) -> DataFrame:
    """The four status totals in one row (per-topic detail is A13)."""
    return fm.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES],
                  F.count(F.lit(1)).alias("total"))


def error_pattern_groups(fm: DataFrame, samples: int = 5) -> DataFrame:
    """PENDING messages by F3 error type — count, affected topics, first
    and last occurrence, the ``samples`` smallest ids; most frequent first."""
    p = fm.filter(F.col("status") == "PENDING").withColumn("error_type", classify_error("error_message"))
    g = p.groupBy("error_type").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.array_join(F.array_sort(F.collect_set("original_topic")), ",").alias("affected_topics"),
        F.min("created_at").alias("first_occurrence"),
        F.max("created_at").alias("last_occurrence"),
    )
    ids = top_k_per_group(p.select("error_type", "id"), ["error_type"], ["id"], samples)
    ids = ids.groupBy("error_type").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",")
        .alias("sample_ids"))
    return g.join(ids, "error_type").orderBy(F.col("message_count").desc(), "error_type")


def topic_failure_analysis(fm: DataFrame) -> DataFrame:
    """Status pivot per topic, total and pending rate (%)."""
    g = fm.groupBy(F.col("original_topic").alias("topic")).agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES])
    total = sum((F.col(s.lower()) for s in STATUSES), F.lit(0))
    g = g.withColumn("total", total)
    return g.withColumn("pending_rate", F.when(F.col("total") > 0, F.col("pending") / F.col("total") * 100)
                        .otherwise(F.lit(0.0))).orderBy(F.col("total").desc(), "topic")


def hourly_failure_trend(spark: SparkSession, fm: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """PENDING created in [as_of − hours, as_of], counted per clock hour
    and zero-filled over the ``hours`` buckets ending at as_of's hour.

    Buckets start at the truncated hour, so the oldest partial hour is not
    reported (the reference behaves the same way)."""
    now = _ts(as_of)
    counts = (fm.filter((F.col("status") == "PENDING") & F.col("created_at").between(_minus(as_of, hours=hours), now))
              .groupBy(F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("hour"))
              .agg(F.count(F.lit(1)).alias("message_count")))
    grid = spark.range(hours).select(
        F.date_trunc("hour", now - F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).cast("timestamp_ntz").alias("hour"))
    return (F.broadcast(grid).join(counts, "hour", "left")
            .select("hour", F.coalesce("message_count", F.lit(0)).alias("message_count")).orderBy("hour"))


def _retry_agg(fm: DataFrame) -> DataFrame:
    retried = F.col("status") == "RETRIED"
    return fm.agg(
        F.count_if(retried).alias("total_retried"),
        F.count_if((F.col("status") == "PENDING") & (F.col("retry_count") > 0)).alias("pending_after_retry"),
        F.coalesce(F.avg(F.when(retried, F.col("retry_count"))), F.lit(0.0)).alias("avg_retries_for_success"),
    )


def retry_efficiency(fm: DataFrame) -> DataFrame:
    """Retried, pending-with-retries, mean retries of RETRIED, success %."""
    a = _retry_agg(fm)
    d = F.col("total_retried") + F.col("pending_after_retry")
    return a.withColumn("success_rate", F.when(d > 0, F.col("total_retried") / d * 100).otherwise(F.lit(0.0)))


def retry_distribution(fm: DataFrame, status: str | None = None) -> DataFrame:
    """Message count by retry count (optionally one status), ascending."""
    f = fm if status is None else fm.filter(F.col("status") == status)
    return f.groupBy("retry_count").agg(F.count(F.lit(1)).alias("message_count")).orderBy("retry_count")


def failures_per_day(fm: DataFrame, since) -> DataFrame:
    """Count by calendar day of ``created_at`` since ``since``."""
    return (fm.filter(F.col("created_at") >= _ts(since))
            .groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("message_count"))
            .orderBy("day"))


def recent_hour_count(fm: DataFrame, as_of) -> DataFrame:
    """Pending count of the 1-hour trend (current clock hour only)."""
    now = _ts(as_of)
    return fm.agg(F.count_if((F.col("status") == "PENDING")
                             & F.col("created_at").between(_minus(as_of, hours=1), now)
                             & (F.date_trunc("hour", "created_at") == F.date_trunc("hour", now)))
                  .alias("recent_hour_count"))


def dlt_dashboard(fm: DataFrame, as_of, top: int = 5) -> DataFrame:
    """Status totals, top topics, retry success %, recent-hour count and
    alert level — one row.

    A per-topic aggregate (partial+final) gives the totals by one global
    aggregate and the top topics by a top-k: at most ``top`` topics are
    gathered, however many there are."""
    now = _ts(as_of)
    st = F.col("status")
    recent = ((st == "PENDING") & F.col("created_at").between(_minus(as_of, hours=1), now)
              & (F.date_trunc("hour", "created_at") == F.date_trunc("hour", now)))
    t = fm.groupBy(F.col("original_topic").alias("topic")).agg(
        *[F.count_if(st == x).alias(x.lower()) for x in STATUSES],
        F.count_if((st == "PENDING") & (F.col("retry_count") > 0)).alias("_p"),
        F.count_if(recent).alias("_recent"))
    total = sum((F.col(x.lower()) for x in STATUSES), F.lit(0))
    s = t.agg(*[F.coalesce(F.sum(x.lower()), F.lit(0)).cast("long").alias(x.lower()) for x in STATUSES],
              F.coalesce(F.sum("_p"), F.lit(0)).cast("long").alias("_p"),
              F.coalesce(F.sum("_recent"), F.lit(0)).cast("long").alias("recent_hour_count"))
    first = t.select((-total).alias("k"), "topic").orderBy("k", "topic").limit(top)
    ranked = F.array_sort(F.collect_list(F.struct("k", "topic")))
    s = attach_one_row(s, first.agg(F.array_join(F.transform(ranked, lambda x: x["topic"]), ",").alias("top_topics")))
    d = F.col("retried") + F.col("_p")
    return s.select(*[x.lower() for x in STATUSES], "recent_hour_count",
                    F.when(d > 0, F.col("retried") / d * 100).otherwise(F.lit(0.0)).alias("retry_success_rate"),
                    alert_level("pending", "recent_hour_count").alias("alert_level"), "top_topics")


def dlt_topic_detail(fm: DataFrame) -> DataFrame:
    """Per topic — pending, retried, mean retries of pending (0 if none)."""
    pend = F.col("status") == "PENDING"
    return fm.groupBy(F.col("original_topic").alias("topic")).agg(
        F.count_if(pend).alias("pending_count"),
        F.count_if(F.col("status") == "RETRIED").alias("retried_count"),
        F.coalesce(F.avg(F.when(pend, F.col("retry_count"))), F.lit(0.0)).alias("avg_retry_count"))


def dlt_topic_error_types(fm: DataFrame) -> DataFrame:
    """A22 (distribution): PENDING count per (topic, F4 error type)."""
    return (fm.filter(F.col("status") == "PENDING")
            .groupBy(F.col("original_topic").alias("topic"), classify_error_short("error_message").alias("error_type"))
            .agg(F.count(F.lit(1)).alias("message_count")))


def dlt_health(fm: DataFrame, as_of) -> DataFrame:
    """CRITICAL if pending > 1000; WARNING if > 100 or > 50 added in 10 min."""
    now = _ts(as_of)
    pend = F.col("status") == "PENDING"
    a = fm.agg(F.count_if(pend).alias("pending_count"),
               F.count_if(pend & F.col("created_at").between(_minus(as_of, mins=10), now)).alias("recent_added_count"))
    p, r = F.col("pending_count"), F.col("recent_added_count")
    st = F.when(p > 1000, "CRITICAL").when(p > 100, "WARNING").when(r > 50, "WARNING").otherwise("HEALTHY")
    a = a.withColumn("status", st)
    msg = (F.when(F.col("status") == "CRITICAL",
                  F.format_string("Critical: %d pending messages, %d added in last 10 min", p, r))
           .when(F.col("status") == "WARNING", F.format_string("Warning: %d pending messages need attention", p))
           .otherwise(F.lit("Healthy: DLT queue is under control")))
    return a.withColumn("message", msg)


def dlt_detailed_dashboard(spark: SparkSession, fm: DataFrame, as_of) -> dict[str, DataFrame]:
    """The detailed dashboard as named frames (A21, A15, A17(24), A16, A18)."""
    return {
        "summary": dlt_dashboard(fm, as_of),
        "error_patterns": error_pattern_groups(fm),
        "hourly_trend": hourly_failure_trend(spark, fm, as_of, 24),
        "topic_analysis": topic_failure_analysis(fm),
        "retry_analysis": retry_efficiency(fm),
    }


def distinct_topics(fm: DataFrame) -> DataFrame:
    """DISTINCT topic, sorted."""
    return fm.select(F.col("original_topic").alias("topic")).distinct().orderBy("topic")


def _older(as_of, status: str, days: int) -> Column:
    return (F.col("status") == status) & (F.col("created_at") <= _minus(as_of, days=days))


def cleanup_preview(fm: DataFrame, as_of) -> DataFrame:
    """Rows each retention rule would touch (cutoffs inclusive)."""
    a = fm.agg(*[F.count_if(_older(as_of, s, d)).alias(f"{s.lower()}_to_delete") for s, d in RETENTION_DAYS.items()],
               F.count_if(_older(as_of, "PENDING", PENDING_ARCHIVE_DAYS)).alias("pending_to_archive"))
    return a.withColumn("total_to_affect", F.col("resolved_to_delete") + F.col("ignored_to_delete")
                        + F.col("retried_to_delete") + F.col("pending_to_archive"))


# ------------------------------------------------------------ filters / reads
def search_failed_messages(fm: DataFrame, status=None, topic=None, start=None, end=None,
                           min_retry=None) -> DataFrame:
    """Conjunction of the supplied filters only; newest first."""
    cond = F.lit(True)
    if status is not None:
        cond &= F.col("status") == status
    if topic is not None:
        cond &= F.col("original_topic") == topic
    if start is not None:
        cond &= F.col("created_at") >= _ts(start)
    if end is not None:
        cond &= F.col("created_at") <= _ts(end)
    if min_retry is not None:
        cond &= F.col("retry_count") >= min_retry
    return fm.filter(cond).orderBy(F.col("created_at").desc(), F.col("id").desc())


def search_error_text(fm: DataFrame, keyword: str) -> DataFrame:
    """Error message contains ``keyword`` (case-sensitive), newest first."""
    return fm.filter(F.col("error_message").contains(keyword)).orderBy(F.col("created_at").desc(), F.col("id").desc())


def failed_by(fm: DataFrame, *, topic=None, status=None, not_status=None, key=None, between=None) -> DataFrame:
    """Derived single-column filters (BETWEEN inclusive)."""
    f = fm
    if topic is not None:
        f = f.filter(F.col("original_topic") == topic)
    if status is not None:
        f = f.filter(F.col("status") == status)
    if not_status is not None:
        f = f.filter(F.col("status") != not_status)
    if key is not None:
        f = f.filter(F.col("message_key") == key)
    if between is not None:
        f = f.filter(F.col("created_at").between(_ts(between[0]), _ts(between[1])))
    return f


def list_failed(fm: DataFrame, status=None, topic=None, strict_parity: bool = False) -> DataFrame:
    """topic+status, else status, else all. With ``strict_parity`` a topic
    without a status is ignored, as in the reference; by default it filters."""
    if status is not None and topic is not None:
        return fm.filter((F.col("original_topic") == topic) & (F.col("status") == status))
    if status is not None:
        return fm.filter(F.col("status") == status)
    if topic is not None and not strict_parity:
        return fm.filter(F.col("original_topic") == topic)
    return fm


def reprocessable(fm: DataFrame, max_retry: int = MAX_RETRY_COUNT, limit: int = 50,
                  topic: str | None = None) -> DataFrame:
    """P10: PENDING under the retry cap, oldest first, first ``limit`` rows.
    Per topic: no retry cap, limit 100 by default."""
    if topic is not None:
        f = fm.filter((F.col("original_topic") == topic) & (F.col("status") == "PENDING"))
    else:
        f = fm.filter((F.col("status") == "PENDING") & (F.col("retry_count") < max_retry))
    return f.orderBy("created_at", "id").limit(limit)


def failure_summaries(fm: DataFrame) -> DataFrame:
    return fm.select("id", F.col("original_topic").alias("topic"),
                     classify_error_short("error_message").alias("error_type"), "retry_count", "created_at")


def recent_failures(fm: DataFrame, n: int = 10, per_topic: bool = True) -> DataFrame:
    """T5: newest ``n`` PENDING per topic (or overall) as summaries."""
    p = failure_summaries(fm.filter(F.col("status") == "PENDING"))
    order = [F.col("created_at").desc(), F.col("id").desc()]
    if per_topic:
        return top_k_per_group(p, ["topic"], order, n, rank_col="rank")
    return p.orderBy(*order).limit(n)


# ------------------------------------------------------------ decisions / mutations
def reprocess_decision(fm: DataFrame, requests: DataFrame, as_of, max_retry: int = MAX_RETRY_COUNT) -> DataFrame:
    """outcome of reprocessing each requested id, with the row's new state.

    NOT_FOUND / INVALID_STATUS / MAX_RETRY_EXCEEDED skip; a NULL value fails
    the send (FAILED, retry +1); otherwise SUCCESS (RETRIED, resolved_at =
    as_of, retry +1). ``requests`` has a column ``id``; an optional ``seq``
    orders repeated requests of one id. After a success the row is no longer
    PENDING, so the later requests of that id are INVALID_STATUS; after a
    failed send each further one meets the risen retry count.
    """
    seq = F.col("seq") if "seq" in requests.columns else F.lit(0)
    again = requests.select("id", (F.row_number().over(Window.partitionBy("id").orderBy(seq)) - 1).alias("_nth"))
    j = again.join(fm.select("id", "status", "retry_count", "message_value", "resolved_at"),
                                   "id", "left")
    found = F.col("status").isNotNull()
    pending, fails = F.col("status") == "PENDING", F.col("message_value").isNull()
    # The row as the n-th request of its id finds it.
    retries = F.when(pending & fails, F.least(F.col("retry_count") + F.col("_nth"), F.greatest(F.col("retry_count"), F.lit(max_retry)))) \
        .otherwise(F.col("retry_count"))
    sent = pending & ~fails & (F.col("retry_count") < max_retry)
    outcome = (F.when(~found, "NOT_FOUND").when(~pending | (sent & (F.col("_nth") > 0)), "INVALID_STATUS")
               .when(retries >= max_retry, "MAX_RETRY_EXCEEDED").when(fails, "FAILED").otherwise("SUCCESS"))
    j = j.withColumn("outcome", outcome).withColumn("_retries", retries.cast("int"))
    return j.select(
        "id", "outcome", F.when(sent, F.lit("RETRIED")).otherwise(F.col("status")).alias("new_status"),
        F.when(sent, F.col("retry_count") + 1).when(F.col("outcome") == "FAILED", F.col("_retries") + 1)
        .otherwise(F.col("_retries")).alias("new_retry_count"),
        F.when(sent, _ts(as_of)).otherwise(F.col("resolved_at")).alias("new_resolved_at"),
    )


def reprocess_outcomes(decisions: DataFrame) -> DataFrame:
    """Batch totals — success, failed, skipped."""
    o = F.col("outcome")
    return decisions.agg(F.count(F.lit(1)).alias("total"), F.count_if(o == "SUCCESS").alias("success"),
                         F.count_if(o == "FAILED").alias("failed"),
                         F.count_if(~o.isin("SUCCESS", "FAILED")).alias("skipped"))


def apply_reprocess(fm: DataFrame, decisions: DataFrame) -> DataFrame:
    """New version of the table after F9 (retry count rises on failure too)."""
    tried = decisions.filter(F.col("outcome").isin("SUCCESS", "FAILED"))
    last = F.max_by(F.struct("new_status", "new_retry_count", "new_resolved_at"), "new_retry_count").alias("_d")
    d = tried.groupBy("id").agg(last).select("id", "_d.*")  # one row per id, whatever was requested
    j = fm.join(d, "id", "left")
    hit = F.col("new_status").isNotNull()
    return j.select(*[F.when(hit, F.col(n)).otherwise(F.col(c)).alias(c) if n else F.col(c)
                      for c, n in [(c, {"status": "new_status", "retry_count": "new_retry_count",
                                        "resolved_at": "new_resolved_at"}.get(c)) for c in fm.columns]])


def bulk_update_status(fm: DataFrame, ids: DataFrame, new_status: str, as_of) -> DataFrame:
    """Set status and resolved_at (for any target status) for ``ids``.

    Semi-join flag: the id list is de-duplicated and joined, never collected."""
    flag = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    j = fm.join(flag, "id", "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    return j.select(*[
        F.when(hit, F.lit(new_status)).otherwise(F.col("status")).alias("status") if c == "status" else
        F.when(hit, _ts(as_of)).otherwise(F.col("resolved_at")).alias("resolved_at") if c == "resolved_at" else
        F.col(c) for c in fm.columns])


def ignore_resolve(fm: DataFrame, message_id: int) -> DataFrame:
    """Whether a one-row status change would apply (missing id -> false).
    Apply it with :func:`bulk_update_status` on the same id."""
    return (fm.filter(F.col("id") == message_id).agg((F.count(F.lit(1)) > 0).alias("updated"))
            .select(F.lit(message_id).alias("id"), "updated"))


def retention_cleanup(fm: DataFrame, as_of) -> DataFrame:
    """U4: delete RESOLVED > 7 d, IGNORED > 3 d, RETRIED > 30 d (inclusive)."""
    expired = F.lit(False)
    for s, d in RETENTION_DAYS.items():
        expired = expired | _older(as_of, s, d)
    return fm.filter(~expired)


def archive_old_pending(fm: DataFrame, as_of, days: int = PENDING_ARCHIVE_DAYS) -> DataFrame:
    """PENDING older than ``days`` become IGNORED (resolved_at = as_of)."""
    old = _older(as_of, "PENDING", days)
    return fm.select(*[
        F.when(old, F.lit("IGNORED")).otherwise(F.col("status")).alias("status") if c == "status" else
        F.when(old, _ts(as_of)).otherwise(F.col("resolved_at")).alias("resolved_at") if c == "resolved_at" else
        F.col(c) for c in fm.columns])


def full_cleanup(fm: DataFrame, as_of) -> DataFrame:
    """U4 then U5 in one pass — rows archived now survive this run."""
    return archive_old_pending(retention_cleanup(fm, as_of), as_of)


def delete_by_status(fm: DataFrame, status: str) -> DataFrame:
    """Drop all rows of a status."""
    return fm.filter(F.col("status") != status)


def delete_by_ids(fm: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop listed ids (anti-join)."""
    return fm.join(ids.select("id"), "id", "left_anti")


def delete_before(fm: DataFrame, status: str, cutoff) -> DataFrame:
    """Drop rows of ``status`` created strictly before ``cutoff``."""
    return fm.filter(~((F.col("status") == status) & (F.col("created_at") < _ts(cutoff))))


def retry_schedule(fm: DataFrame, attempts: int = 3, delay_ms: int = 1000, multiplier: int = 2,
                   max_delay_ms: int = 10000) -> DataFrame:
    """route of each failure after its retries — next retry topic with its
    back-off delay ``min(delay·mult^k, max)``, or the ``.DLT`` topic once
    ``attempts`` are used up."""
    k = F.col("retry_count")
    delay = F.least(F.lit(delay_ms) * F.pow(F.lit(multiplier), k), F.lit(max_delay_ms)).cast("long")
    to_dlt = k + 1 >= attempts
    return fm.select(
        "id", "original_topic", "retry_count",
        F.when(to_dlt, F.lit(None).cast("long")).otherwise(delay).alias("backoff_ms"),
        F.when(to_dlt, F.concat("original_topic", F.lit(".DLT")))
         .otherwise(F.concat("original_topic", F.lit("-retry"))).alias("route_topic"))
