"""Streams over tables that are folders of part files, one file per batch."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from flowlens.operators import projections as P
from flowlens.sources import decode
from flowlens.sources import fixtures as fx
from flowlens.sources.tables import TABLES, table_path
from flowlens.streaming import jobs as J
from oracle import compare, rows_hash

FILES = 5


def _folder_tables(tmp, reverse=False, tables=("events", "orders")):
    """SF_SMALL with some tables cut into five files; reversed: the newest rows arrive first."""
    for t in TABLES:
        src, dst = table_path(SF_SMALL, t), f"{tmp}/{t}.parquet"
        if t not in tables:
            os.symlink(src, dst)
            continue
        os.makedirs(dst)
        rows = pq.read_table(src)
        step = -(-rows.num_rows // FILES)
        for k in range(FILES):
            f = f"{dst}/part-{k}.parquet"
            pq.write_table(rows.slice(k * step, step), f)
            age = k if reverse else FILES - k
            os.utime(f, (1_700_000_000 - age * 60, 1_700_000_000 - age * 60))
    return str(tmp)


@pytest.fixture(scope="module")
def in_order(tmp_path_factory):
    return _folder_tables(tmp_path_factory.mktemp("in_order"))


@pytest.fixture(scope="module")
def newest_first(tmp_path_factory):
    return _folder_tables(tmp_path_factory.mktemp("newest_first"), reverse=True)


STREAMS = ["stream_product_stats", "stream_hourly_count", "stream_hourly_late", "stream_dedup", "stream_compact",
           "stream_saga", "stream_projection", "stream_dlt_capture", "exactly_once_fanout"]


@pytest.mark.parametrize("key", STREAMS)
def test_stream_over_five_files_matches_oracle(spark, in_order, key):
    r = compare(spark, key, in_order, E.queries(), E.oracle_sql())
    assert r["ok"] and r["spark_rows"] > 0, r


@pytest.mark.parametrize("key", ["stream_product_stats", "stream_dedup", "stream_compact", "stream_projection"])
def test_order_of_files_does_not_matter(spark, newest_first, key):
    r = compare(spark, key, newest_first, E.queries(), E.oracle_sql())
    assert r["ok"], r


def test_late_rows_are_never_lost(spark, newest_first):
    counts, late = J.stream_hourly_count(spark, newest_first, "late_timestamp")
    n = fx.order_events(spark, newest_first).count()
    assert counts.agg(F.sum("order_count")).first()[0] + late.count() == n
    assert late.count() > 0.5 * n  # all but the newest file's rows are late


def test_inventory_stream_over_files(spark, in_order):
    stream = {r.seq: (r.outcome, r.reserved_after) for r in J.stream_inventory(spark, in_order).collect()}
    batch = {r.seq: (r.outcome, r.reserved_after) for r in E.queries()["inventory_reservations"](spark, in_order).collect()}
    assert stream == batch


def test_micro_batches_honour_max_files(spark, in_order, tmp_path):
    sizes = []
    q = J.stream_micro_batches(spark, lambda: fx.order_events(spark, in_order), lambda b, i: sizes.append(b.count()), 2,
                               str(tmp_path / "ck"))
    q.awaitTermination()
    assert len(sizes) == 3 and sum(sizes) == fx.order_events(spark, in_order).count()


def _view(df):
    cols = df.columns
    return rows_hash(cols, [tuple(r) for r in df.collect()])[0]


def test_replayed_and_half_written_batches_give_the_same_view(spark, tmp_path):
    ev = decode.decode_saga_envelope(fx.saga_events(spark, SF_SMALL)).cache()
    cut = ev.agg(F.percentile_approx("offset", 0.5)).first()[0]
    parts = [ev.filter(F.col("offset") <= cut), ev.filter(F.col("offset") > cut)]
    once = J.BucketedView(spark, str(tmp_path / "once"), "order_id", ev.schema, P.order_summary_view, buckets=8)
    twice = J.BucketedView(spark, str(tmp_path / "twice"), "order_id", ev.schema, P.order_summary_view, buckets=8)
    for i, p in enumerate(parts):
        once.write(p, i)
        twice.write(p, i)
        twice.write(p, i)  # a finished batch comes again
    twice.write(parts[0], 0)  # even an older one
    # a batch that stopped after its events, before its view
    half = J.BucketedView(spark, str(tmp_path / "half"), "order_id", ev.schema, P.order_summary_view, buckets=8)
    half.write(parts[0], 0)
    parts[1].withColumn("_bucket", half._bucket()).write.partitionBy("_bucket").parquet(f"{half.events_path}/_batch=1")
    first = _view(half.latest())
    half.write(parts[1], 1)
    expect = _view(P.order_summary_view(ev))
    assert _view(once.latest()) == _view(twice.latest()) == _view(half.latest()) == expect
    assert first == _view(P.order_summary_view(parts[0]))


def test_a_batch_rewrites_only_the_buckets_it_touched(spark, tmp_path):
    ev = decode.decode_saga_envelope(fx.saga_events(spark, SF_SMALL)).cache()
    v = J.BucketedView(spark, str(tmp_path), "order_id", ev.schema, P.order_summary_view, buckets=16)
    v.write(ev, 0)
    one = ev.filter(F.col("order_id") == ev.select("order_id").first()[0])
    v.write(one, 1)
    assert spark.read.parquet(f"{v.root}/v=1").select("_bucket").distinct().count() == 1
    assert _view(v.latest()) == _view(P.order_summary_view(ev.unionByName(one)))


def test_unreadable_view_is_an_error(spark, tmp_path):
    v = J.BucketedView(spark, str(tmp_path), "order_id", pa.schema([]), P.order_summary_view)
    assert v.latest() is None
    os.makedirs(f"{v.root}/v=0/_bucket=1")
    with open(f"{v.root}/v=0/_bucket=1/part-0.parquet", "wb") as f:
        f.write(b"not parquet")
    with pytest.raises(Exception):
        v.latest().collect()
