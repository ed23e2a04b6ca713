"""Blocked (skew-safe) computations give the same answer for any block size."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowlens.operators import common as C
from flowlens.operators import ops as O
from flowlens.sources import fixtures as fx
from flowlens.streaming import jobs as J


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_rolling_failure_rate_block_invariant(spark):
    a = fx.activity_log(spark, SF_SMALL)
    big = O.rolling_failure_rate(a, 10, 5, 50.0, block=1 << 30)
    for blk in (3, 17, 64):
        small = O.rolling_failure_rate(a, 10, 5, 50.0, block=blk)
        assert _rows(small, "topic", "offset", "failure_rate", "calls", "state") == \
            _rows(big, "topic", "offset", "failure_rate", "calls", "state")


def test_micro_batches_slice_invariant(spark):
    a = fx.activity_log(spark, SF_SMALL).select("topic", "partition", "offset", "key", "record_ts")
    ref = J.micro_batches(a, "record_ts", 1440, 7, ["record_ts", "offset"], sub_interval="1440 minutes")
    for sub in ("1 minute", "17 minutes"):
        got = J.micro_batches(a, "record_ts", 1440, 7, ["record_ts", "offset"], sub_interval=sub)
        assert _rows(got, "offset", "bucket_start", "chunk") == _rows(ref, "offset", "bucket_start", "chunk")


def test_late_event_audit_block_invariant(spark):
    e = fx.order_events(spark, SF_SMALL)
    ref = J.late_event_audit(e, block=1 << 30)
    for blk in (5, 128):
        assert _rows(J.late_event_audit(e, block=blk), "offset", "stream_time") == _rows(ref, "offset", "stream_time")


def test_top_k_per_group_exact(spark):
    df = spark.range(0, 500).select((F.col("id") % 3).alias("g"), F.col("id")).repartition(7)
    got = _rows(C.top_k_per_group(df, ["g"], [F.col("id").desc()], 4), "g", "id")
    expect = sorted((g, i) for g in range(3) for i in sorted((x for x in range(500) if x % 3 == g), reverse=True)[:4])
    assert got == expect


def test_prefix_scan_block_invariant(spark):
    df = spark.range(0, 400).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 401).alias("o"),
                                    F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"))
    specs = [("s_in", "sum", F.lit(1).cast("long"), True), ("s_ex", "sum", F.col("o"), False),
             ("mx", "max", F.col("o"), False), ("last", "last", F.col("v"), True)]
    ref = _rows(C.prefix_scan(df, ["k"], "o", specs, block=1 << 30), "k", "o", "s_in", "s_ex", "mx", "last")
    for blk in (1, 9, 50):
        assert _rows(C.prefix_scan(df, ["k"], "o", specs, block=blk), "k", "o", "s_in", "s_ex", "mx", "last") == ref
    rows = {(r.k, r.o): r for r in C.prefix_scan(df, ["k"], "o", specs, block=9).collect()}
    for k in range(3):
        seq = sorted(r for r in rows.values() if r.k == k)
        seq = sorted(seq, key=lambda r: r.o)
        for i, r in enumerate(seq):
            assert r.s_in == i + 1
            assert r.s_ex == (sum(x.o for x in seq[:i]) if i else None)


def test_saga_and_store_block_invariant(spark):
    from flowlens.operators import projections as P
    from flowlens.operators import saga as G
    from flowlens.sources import decode
    ev = decode.decode_saga_envelope(fx.saga_events(spark, SF_SMALL))
    starts = fx.saga_starts(spark, SF_SMALL)
    big = _rows(G._prefix(G.events_with_known_saga(ev, starts), 1 << 30), "saga_id", "offset", "_adv_before",
                "_pay_before", "_reason_after", "_status_set")
    small = _rows(G._prefix(G.events_with_known_saga(ev, starts), 2), "saga_id", "offset", "_adv_before",
                  "_pay_before", "_reason_after", "_status_set")
    assert big == small
    store = _rows(P.event_store_append(ev), "aggregate_id", "offset", "version")
    assert all(v >= 1 for _, _, v in store)
