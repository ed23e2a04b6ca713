"""Operators without a SQL twin: checked against plain-Python versions."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_CHECK, SF_SMALL
from flowlens.functions.murmur2 import murmur2_array, murmur2_scalar
from flowlens.operators import inventory as I
from flowlens.sources import fixtures as fx

Q = E.queries()


def test_murmur2_known_vectors():
    # Published test vectors of the Kafka client's murmur2.
    assert murmur2_scalar(b"21") == -973932308
    assert murmur2_scalar(b"foobar") == -790332482
    assert murmur2_scalar(b"a-little-bit-long-string") == -985981536


def test_murmur2_vectorized_equals_scalar():
    rnd = random.Random(7)
    keys = [bytes(rnd.randrange(256) for _ in range(rnd.randrange(0, 50))) for _ in range(2000)]
    out = murmur2_array(keys)
    assert [int(x) for x in out] == [murmur2_scalar(k) for k in keys]


def test_murmur2_udf_on_fixture_keys(spark):
    rows = Q["murmur2_hash"](spark, SF_SMALL).collect()
    kv = {r.event_id: r for r in rows}
    src = {r.event_id: r for r in fx.routing_keys(spark, SF_SMALL).collect()}
    for eid, r in kv.items():
        text = src[eid].key if src[eid].key is not None else src[eid].value
        assert r.murmur2 == murmur2_scalar(text.encode("utf-8"))


def _pos(h):
    return h & 0x7FFFFFFF


def test_business_key_partition_ranges(spark):
    src = {r.event_id: r for r in fx.routing_keys(spark, SF_SMALL).collect()}
    for r in Q["business_key_partition"](spark, SF_SMALL).collect():
        n, k = r.num_partitions, r.key
        assert 0 <= r.partition < n
        if k is None:
            assert r.partition == _pos(murmur2_scalar(src[r.event_id].value.encode())) % n
            continue
        u, h = k.upper(), _pos(murmur2_scalar(k.encode()))
        start, count = ((0, 3) if u.startswith("ORDER-") else (3, 3) if u.startswith("PAYMENT-")
                        else (6, 3) if u.startswith(("INVENTORY-", "PRODUCT-")) else (None, None))
        if start is None:
            assert r.partition == h % n
        else:
            es = min(start, n - 1)
            ec = min(count, n - es)
            assert r.partition == (h % n if ec <= 0 else es + h % ec)


def test_vip_and_priority_partitions(spark):
    for r in Q["vip_customer_partition"](spark, SF_SMALL).collect():
        assert 0 <= r.partition < r.num_partitions
        if r.key in ("CUSTOMER-VIP-001", "GOLD-001"):
            assert r.partition == 0
        elif r.key is not None and r.num_partitions > 1:
            assert r.partition >= 1
    for r in Q["priority_partition"](spark, SF_SMALL).collect():
        n = r.num_partitions
        assert 0 <= r.partition < n
        if n == 1:
            assert r.partition == 0
        elif r.priority == "HIGH":
            assert r.partition == 0
        elif r.priority == "MEDIUM":
            assert 1 <= r.partition <= min(2, n - 1)
        else:
            assert r.partition >= min(3, n - 1)


def _python_fold(commands, stock):
    reserved, out = {}, {}
    for c in sorted(commands, key=lambda c: c.seq):
        if c.product_id not in stock:
            out[c.seq] = "NOT_FOUND"
            continue
        r = reserved.get(c.product_id, 0)
        if c.command == "RESERVE":
            if stock[c.product_id] - r >= c.quantity:
                r += c.quantity
                out[c.seq] = "RESERVED"
            else:
                out[c.seq] = "INSUFFICIENT"
        else:
            r = max(0, r - c.quantity)
            out[c.seq] = "RELEASED"
        reserved[c.product_id] = r
    return out


@pytest.mark.parametrize("sf", [SF_SMALL])
def test_inventory_fold_matches_python(spark, sf):
    cmds = fx.inventory_commands(spark, sf).collect()
    stock = {r.product_id: r.quantity for r in fx.inventory(spark, sf).collect()}
    expect = _python_fold(cmds, stock)
    got = {r.seq: r.outcome for r in Q["inventory_reservations"](spark, sf).collect()}
    assert got == expect


def test_inventory_counts_match_fixture_notes(spark):
    got = {r.outcome: r.commands for r in Q["inventory_outcome_counts"](spark, SF_CHECK).collect()}
    assert got == {"RESERVED": 4623, "INSUFFICIENT": 3047, "RELEASED": 1940, "NOT_FOUND": 390}


def test_inventory_fold_survives_many_partitions(spark):
    c, s = fx.inventory_commands(spark, SF_SMALL), fx.inventory(spark, SF_SMALL)
    a = {r.seq: r.outcome for r in I.inventory_reservations(c, s, 1).collect()}
    b = {r.seq: r.outcome for r in I.inventory_reservations(c, s, 13).collect()}
    assert a == b


def test_stream_inventory_equals_batch(spark):
    batch = {r.seq: (r.outcome, r.reserved_after) for r in Q["inventory_reservations"](spark, SF_SMALL).collect()}
    stream = {r.seq: (r.outcome, r.reserved_after) for r in Q["stream_inventory"](spark, SF_SMALL).collect()}
    assert batch == stream


def test_inventory_projection_consistent(spark):
    inv = {r.product_id: r for r in Q["inventory_projection"](spark, SF_SMALL).collect()}
    for r in inv.values():
        assert r.available_quantity == r.quantity - r.reserved_quantity
        assert 0 <= r.reserved_quantity <= r.quantity
    assert "PROD-24" not in inv
