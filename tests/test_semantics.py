"""Hand-made edge frames for the traps of SURVEY §7.3 and the reference's
saga golden cases."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from flowlens.functions.classify import classify_error, classify_error_short
from flowlens.operators import dedup as U
from flowlens.operators import ops as O
from flowlens.operators import projections as P
from flowlens.operators import routing as R
from flowlens.operators import saga as G
from flowlens.operators import state as S
from flowlens.operators import stats
from flowlens.sources import decode

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def _envelope(offset, etype, **payload):
    p = {"timestamp": (T0 + dt.timedelta(minutes=offset)).strftime("%Y-%m-%dT%H:%M:%S"), **payload}
    return (offset, json.dumps({"eventType": etype, "payload": json.dumps(p)}))


def _events(spark, rows):
    return decode.decode_saga_envelope(spark.createDataFrame(rows, "offset LONG, value STRING"))


def _starts(spark, sagas):
    return spark.createDataFrame(
        [(s, "ORD-" + s, "customer-1", "product-1", 2, Decimal("10000.00"), "ORDER_PENDING", "CREATE_ORDER", T0)
         for s in sagas],
        "saga_id STRING, order_id STRING, customer_id STRING, product_id STRING, quantity INT, "
        "total_amount DECIMAL(19,2), status STRING, current_step STRING, created_at TIMESTAMP_NTZ")


def _state(spark, rows, sagas=("s1",)):
    out = G.saga_state(_starts(spark, sagas), _events(spark, rows)).collect()
    return {r.saga_id: r for r in out}


def _cmds(spark, rows, sagas=("s1",)):
    out = G.saga_command_log(_starts(spark, sagas), _events(spark, rows)).orderBy("seq").collect()
    return [r.command for r in out if r.saga_id == "s1"]


# ------------------------------------------------------------------ saga golden cases
def test_saga_start(spark):
    st = _state(spark, [])["s1"]
    assert (st.status, st.current_step) == ("ORDER_PENDING", "CREATE_ORDER")
    assert _cmds(spark, []) == ["CREATE_ORDER"]


def test_saga_order_created(spark):
    rows = [_envelope(1, "ORDER_CREATED", sagaId="s1", orderId="ORD-s1", customerId="c", productId="p",
                      quantity=2, totalAmount=10000)]
    st = _state(spark, rows)["s1"]
    assert (st.status, st.current_step) == ("PAYMENT_PENDING", "PROCESS_PAYMENT")
    assert _cmds(spark, rows) == ["CREATE_ORDER", "PROCESS_PAYMENT"]


def _created_paid():
    return [_envelope(1, "ORDER_CREATED", sagaId="s1", orderId="ORD-s1", customerId="c", productId="p", quantity=2,
                      totalAmount=10000),
            _envelope(2, "PAYMENT_COMPLETED", sagaId="s1", orderId="ORD-s1", paymentId="pay-1", amount=10000)]


def test_saga_payment_completed(spark):
    st = _state(spark, _created_paid())["s1"]
    assert (st.status, st.current_step, st.payment_id) == ("INVENTORY_PENDING", "RESERVE_INVENTORY", "pay-1")
    assert _cmds(spark, _created_paid())[-1] == "RESERVE_INVENTORY"


def test_saga_completed_does_not_advance_step(spark):
    rows = _created_paid() + [_envelope(3, "INVENTORY_RESERVED", sagaId="s1", orderId="ORD-s1", productId="p", quantity=2)]
    st = _state(spark, rows)["s1"]
    assert (st.status, st.current_step) == ("COMPLETED", "RESERVE_INVENTORY")
    assert st.completed_at is not None


def test_saga_payment_failed_compensates_with_cancel_order(spark):
    rows = [_created_paid()[0], _envelope(2, "PAYMENT_FAILED", sagaId="s1", orderId="ORD-s1", reason="no money")]
    st = _state(spark, rows)["s1"]
    assert (st.status, st.failure_reason) == ("COMPENSATING", "no money")
    assert _cmds(spark, rows)[-1] == "CANCEL_ORDER"


def test_saga_inventory_failed_cancels_payment(spark):
    rows = _created_paid() + [_envelope(3, "INVENTORY_FAILED", sagaId="s1", orderId="ORD-s1", productId="p",
                                        requestedQuantity=2, availableQuantity=0, reason="no stock")]
    st = _state(spark, rows)["s1"]
    assert st.status == "COMPENSATING"
    assert _cmds(spark, rows)[-1] == "CANCEL_PAYMENT"


def test_saga_order_cancelled_is_compensated(spark):
    rows = [_created_paid()[0], _envelope(2, "ORDER_CANCELLED", sagaId="s1", orderId="ORD-s1", reason="x")]
    assert _state(spark, rows)["s1"].status == "COMPENSATED"


def test_saga_failure_in_create_order_step_fails(spark):
    rows = [_envelope(1, "PAYMENT_FAILED", sagaId="s1", orderId="ORD-s1", reason="early")]
    st = _state(spark, rows)["s1"]
    assert (st.status, st.failure_reason) == ("FAILED", "early")
    assert _cmds(spark, rows) == ["CREATE_ORDER"]


def test_saga_unknown_saga_ignored(spark):
    rows = [_envelope(1, "ORDER_CREATED", sagaId="ghost", orderId="ORD-g", customerId="c", productId="p", quantity=1,
                      totalAmount=1)]
    assert set(_state(spark, rows)) == {"s1"}


def test_payment_cancelled_changes_no_state(spark):
    rows = _created_paid() + [_envelope(3, "PAYMENT_CANCELLED", sagaId="s1", orderId="ORD-s1", paymentId="pay-1",
                                        reason="r")]
    assert _state(spark, rows)["s1"].status == "INVENTORY_PENDING"


def test_envelope_rejects_malformed(spark):
    rows = [(1, '{"eventType":"ORDER_SHIPPED","payload":"{}"}'), (2, '{"payload":"{}"}'),
            (3, '{"eventType":"ORDER_CREATED"}'), (4, '{"eventType":"ORDER_CREATED","payload":{"sagaId":"s"}}'),
            (5, "not json"), _envelope(6, "ORDER_CANCELLED", sagaId="s", orderId="o", reason="r")]
    got = [r.offset for r in _events(spark, rows).collect()]
    assert got == [6]


# ------------------------------------------------------------------ projections
def test_order_created_overwrites_and_double_counts(spark):
    rows = [_envelope(1, "ORDER_CREATED", sagaId="s1", orderId="o1", customerId="c1", productId="p", quantity=1,
                      totalAmount=5),
            _envelope(2, "PAYMENT_FAILED", sagaId="s1", orderId="o1", reason="r"),
            _envelope(3, "ORDER_CREATED", sagaId="s1", orderId="o1", customerId="c1", productId="p", quantity=3,
                      totalAmount=7)]
    ev = _events(spark, rows)
    s = P.order_summary_view(ev).collect()[0]
    assert (s.order_status, s.quantity, s.payment_status, s.failure_reason) == ("PENDING", 3, None, None)
    c = P.customer_order_stats(ev).collect()[0]
    assert (c.total_orders, c.failed_orders) == (2, 1)


def test_update_to_missing_order_is_skipped_but_logged(spark):
    rows = [_envelope(1, "PAYMENT_COMPLETED", sagaId="s9", orderId="o9", paymentId="p9", amount=3)]
    ev = _events(spark, rows)
    assert P.order_summary_view(ev).count() == 0
    assert P.order_history_view(ev).count() == 1
    assert P.event_store_append(ev).count() == 1


def test_inventory_reserved_adds_confirmed_history(spark):
    rows = [_envelope(1, "INVENTORY_RESERVED", sagaId="s1", orderId="o1", productId="p", quantity=2)]
    h = sorted(r.event_type for r in P.order_history_view(_events(spark, rows)).collect())
    assert h == ["INVENTORY_RESERVED", "ORDER_CONFIRMED"]


def test_average_order_value_half_up(spark):
    df = spark.createDataFrame([(Decimal("0.05"), 2), (Decimal("10.00"), 0)], "total_spent DECIMAL(38,2), completed_orders LONG")
    got = [r.v for r in df.select(P.average_order_value().alias("v")).collect()]
    assert got == [Decimal("0.03"), Decimal("0.00")]


# ------------------------------------------------------------------ statistics, errors, state, dedup, routing
def test_cancel_subtracts_revenue_keeps_quantity_and_first_name(spark):
    df = spark.createDataFrame(
        [(1, "p", "first", 2, Decimal("10.00"), "CREATED"), (2, "p", "second", 3, Decimal("1.00"), "REFUNDED"),
         (3, "", "a", 1, Decimal("5.00"), "CREATED"), (4, "", "b", 1, Decimal("2.00"), "CANCELLED")],
        "offset LONG, product_id STRING, product_name STRING, quantity INT, price DECIMAL(19,2), event_type STRING")
    got = {r.product_id: r for r in stats.product_order_stats(df).collect()}
    p = got["p"]
    assert (p.product_name, p.total_orders, p.total_quantity, p.total_revenue, p.cancelled_orders) == \
        ("first", 1, 2, Decimal("17.00"), 1)
    e = got[""]  # an empty key restarts on every event: only the last counts
    assert (e.product_name, e.total_orders, e.total_revenue, e.cancelled_orders) == ("b", 0, Decimal("-2.00"), 1)


@pytest.mark.parametrize("msg,full,short", [
    (None, "Unknown", "Unknown"), ("  \n ", "Unknown", "Unknown"),
    ("x DeserializationException y", "Deserialization Error", "DeserializationException"),
    ("a SerializationException", "Serialization Error", "SerializationException"),
    ("Exception: call\ncaused by TimeoutException", "Timeout", "Other"),
    ("boom: FooBarError happened", "FooBarError", "FooBarError"), ("plain", "Other Error", "Other"),
    ("nullpointerexception lower", "NullPointerException", "Other"),
])
def test_error_classifiers(spark, msg, full, short):
    df = spark.createDataFrame([(msg,)], "m STRING")
    r = df.select(classify_error("m").alias("a"), classify_error_short("m").alias("b")).collect()[0]
    assert (r.a, r.b) == (full, short)


def test_compaction_tombstone_wins(spark):
    df = spark.createDataFrame([("t", "k1", 1, "a"), ("t", "k1", 2, None), ("t", "k2", 1, "b"), ("t", "k2", 3, "c")],
                               "topic STRING, key STRING, offset LONG, value STRING")
    got = {(r.key, r.value) for r in S.compact_state(df).collect()}
    assert got == {("k2", "c")}


def test_business_key_strategies(spark):
    df = spark.createDataFrame([("t", 0, 5, "k", '{"paymentId":"P1","orderId":null}'), ("t", 0, 6, "k", '{"x":1}'),
                                ("t", 0, 7, None, "not json")],
                               "topic STRING, partition INT, offset LONG, key STRING, value STRING")
    got = [r.i for r in df.select(U.message_id_business().alias("i")).orderBy("offset").collect()]
    assert got == ["biz-P1", "t-0-6", "biz-0-7"]
    parity = [r.i for r in df.select(U.message_id_business(strict_parity=True).alias("i")).orderBy("offset").collect()]
    assert parity[1] == "biz-null"


def test_tenant_from_topic_longest_registered_prefix(spark):
    msgs = spark.createDataFrame([("tenant-tenant-a-x", "k", None), ("tenant-b-x", "k", None),
                                  ("other", "tenant-c:k", None), ("tenant-tenant-a-x", "k", "hdr")],
                                 "topic STRING, key STRING, tenant_header STRING")
    tenants = spark.createDataFrame([("tenant-a",), ("b",)], "tenant_id STRING")
    first_to_last = lambda df: [r.tenant_id for r in sorted(  # noqa: E731  joined rows come in any order
        df.collect(), key=lambda r: (["tenant-tenant-a-x", "tenant-b-x", "other"].index(r.topic) if r.tenant_header is None else 3))]
    got = first_to_last(R.extract_tenant(msgs, tenants))
    assert got == ["tenant-a", "b", "tenant-c", "hdr"]
    parity = first_to_last(R.extract_tenant(msgs, strict_parity=True))
    assert parity[0] == "tenant"


def test_trace_duration_is_longest_span(spark):
    df = spark.createDataFrame([
        ("t", "a", None, "root", T0, T0 + dt.timedelta(milliseconds=5), "OK"),
        ("t", "b", "a", "child", T0 + dt.timedelta(seconds=10), T0 + dt.timedelta(seconds=10, milliseconds=7), "ERROR")],
        "trace_id STRING, span_id STRING, parent_span_id STRING, name STRING, started_at TIMESTAMP_NTZ, "
        "ended_at TIMESTAMP_NTZ, status STRING")
    r = O.trace_summary(df).collect()[0]
    assert (r.span_count, r.root_name, r.total_duration_ms, r.has_error) == (2, "root", 7, True)


def test_parse_traceparent_cases(spark):
    good = "00-" + "a" * 32 + "-" + "b" * 16 + "-01"
    cases = [good, good[:-2] + "00", None, " ", "00-x-y", "01" + good[2:], "00-" + "0" * 32 + "-" + "b" * 16 + "-01",
             good[:-2] + "zz"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i INT, tp STRING")
    got = [r.p for r in df.select("i", O.parse_traceparent("tp").alias("p")).orderBy("i").collect()]
    assert got[0].sampled is True and got[1].sampled is False
    assert all(g is None for g in got[2:])


def test_product_stats_two_step_equals_single_pass(spark):
    from conftest import SF_SMALL
    from flowlens.sources import fixtures as fx
    e = fx.order_events(spark, SF_SMALL)
    a = sorted(map(tuple, stats.product_order_stats(e, single_pass=False).collect()))
    b = sorted(map(tuple, stats.product_order_stats(e, single_pass=True).collect()))
    assert a == b
