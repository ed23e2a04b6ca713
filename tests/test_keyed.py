"""Block composition, keyed-state streams, atomic outputs, polled extracts, deep pages."""

import os
import random
import re

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from flowlens.operators import commands as K
from flowlens.operators import inventory as I
from flowlens.operators import ops as O
from flowlens.operators import saga as G
from flowlens.operators.blockfold import BlockTable, _replay, _tables
from flowlens.operators.paging import SortedPages
from flowlens.plans.q_keyed import _records
from flowlens.sources import decode
from flowlens.sources import fixtures as fx
from flowlens.sources.tables import TABLES, table_path
from flowlens.streaming import jobs as J
from flowlens.streaming import keyed, ordered
from flowlens.streaming.manifest import AtomicOutputs
from flowlens.streaming.polling import PolledExtract
from oracle import compare
from test_streams_files import _folder_tables


def _rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect() if cols else df.collect()), key=str)


# ------------------------------------------------------------------ A9
def test_block_table_equals_one_fold_per_start():
    rng = random.Random(3)
    for total, top in ((5, 5), (30, 30), (7, 12), (0, 0)):
        cmds = [rng.choice(["RESERVE", "RESERVE", "RELEASE"]) for _ in range(300)]
        amounts = [rng.randint(1, 6) for _ in cmds]
        t = BlockTable(top, total)
        for k in range(0, 300, 70):
            t.apply(cmds[k: k + 70], amounts[k: k + 70])
        for start, end in enumerate(t.table().tolist()):
            r = start
            for c, n in zip(cmds, amounts):
                r = max(0, r - n) if c == "RELEASE" else r + n if total - r >= n else r
            assert r == end


@pytest.mark.parametrize("block", [1, 7, 250, 1 << 20])
def test_reservations_do_not_depend_on_blocks(spark, block):
    commands, stock = fx.stock_commands(spark, SF_SMALL), fx.stock(spark, SF_SMALL)
    got = _rows(I.inventory_reservations(commands, stock, block=block), "seq", "outcome", "available_before", "reserved_after")
    state = {r.product_id: [r.quantity, r.reserved_quantity] for r in stock.collect()}
    want = []
    for c in sorted(commands.collect(), key=lambda c: c.seq):
        if c.product_id not in state:
            want.append((c.seq, "NOT_FOUND", None, None))
            continue
        total, r = state[c.product_id]
        before = total - r
        outcome = "RELEASED" if c.command == "RELEASE" else "RESERVED" if before >= c.quantity else "INSUFFICIENT"
        r = max(0, r - c.quantity) if outcome == "RELEASED" else r + c.quantity if outcome == "RESERVED" else r
        state[c.product_id][1] = r
        want.append((c.seq, outcome, before, r))
    assert got == sorted(want, key=str)


def test_a_hot_product_is_spread_over_tasks(spark):
    rows = [(k, "P", f"O-{k}", 1 + k % 3, "RESERVE" if k % 2 else "RELEASE") for k in range(2000)]
    c = spark.createDataFrame(rows, "seq LONG, product_id STRING, order_id STRING, quantity INT, command STRING")
    s = spark.createDataFrame([("P", 50, 0)], "product_id STRING, quantity INT, reserved_quantity INT")
    out = I.inventory_reservations(c, s, num_partitions=8, block=100)
    parts = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 3 and max(r["count"] for r in parts) < 1200


def test_blocks_of_few_commands_share_a_frame():
    """A batch is replayed as one frame, however many products it holds, across batches too."""
    n = 3000
    b = pd.DataFrame({"seq": range(2 * n), "product_id": [f"P{k // 2:05d}" for k in range(2 * n)], "blk": 0, "order_id": "O",
                      "command": "RESERVE", "quantity": 2, "stock_quantity": 3, "reserved_quantity": 0, "start": 0})
    columns = [c.split()[0] for c in I.OUT_SCHEMA.split(", ")]
    for cut in (2 * n, 5):  # the second cut parts a product's two commands
        out = list(_replay(columns)(iter([b[:cut], b[cut:]])))
        assert len(out) == (1 if cut == 2 * n else 2)
        assert pd.concat(out)["outcome"].tolist() == ["RESERVED", "INSUFFICIENT"] * n
    effects = pd.concat(_tables(iter([b[:5], b[5:]])))
    assert len(effects) == n and effects["effect"].map(lambda e: np.frombuffer(e, np.int32).tolist()).tolist() == [[2, 3, 2, 3]] * n


# ------------------------------------------------------------------ streams over folders of files
@pytest.fixture(scope="module")
def newest_first(tmp_path_factory):
    return _folder_tables(tmp_path_factory.mktemp("keyed_newest"), reverse=True)


def _shuffled(tmp, name):
    """SF_SMALL with one table's rows shuffled over five files of many row groups."""
    for t in TABLES:
        src, dst = table_path(SF_SMALL, t), f"{tmp}/{t}.parquet"
        if t != name:
            os.symlink(src, dst)
            continue
        os.makedirs(dst)
        rows = pq.read_table(src)
        rows = rows.take(np.random.default_rng(5).permutation(rows.num_rows))
        step = -(-rows.num_rows // 5)
        for k in range(5):
            pq.write_table(rows.slice(k * step, step), f"{dst}/part-{k}.parquet", row_group_size=40)
    return str(tmp)


@pytest.mark.parametrize("key", ["stream_saga_commands", "stream_customer_stats", "stream_order_history", "stream_sample_latest"])
def test_any_order_of_files_gives_the_batch_rows(spark, newest_first, key):
    r = compare(spark, key, newest_first, E.queries(), E.oracle_sql())
    assert r["ok"] and r["spark_rows"] > 0, r


def test_sagas_go_on_from_their_state_and_repeat_nothing(spark, newest_first, tmp_path):
    base = str(tmp_path / "sagas")
    commands, states = (_rows(x) for x in keyed.run_sagas(spark, newest_first, base=base))
    again, same = (_rows(x) for x in keyed.run_sagas(spark, newest_first, base=base))  # no new rows in the input
    assert again == commands and same == states
    events = decode.decode_saga_envelope(fx.saga_events(spark, SF_SMALL))
    assert commands == _rows(K.saga_commands(fx.saga_starts(spark, SF_SMALL), events))


def test_redelivered_events_give_no_second_command(spark):
    starts, events = fx.saga_starts(spark, SF_SMALL), decode.decode_saga_envelope(fx.saga_events(spark, SF_SMALL))
    rows = keyed.saga_input(starts, events).filter("saga_id IN ('saga-6', 'saga-16')").collect()

    class State:
        exists, value = False, None

        @property
        def get(self):
            return self.value

        def update(self, v):
            self.exists, self.value = True, v

    out = {}
    for saga in ("saga-6", "saga-16"):
        mine = pd.DataFrame([r.asDict() for r in rows if r.saga_id == saga])
        state = State()
        first = pd.concat(keyed._saga_step((saga,), iter([mine]), state))
        second = pd.concat(keyed._saga_step((saga,), iter([mine]), state))
        assert (second["kind"] == "STATE").all()
        out[saga] = first[first["kind"] == "COMMAND"]["command"].tolist()
    assert out["saga-6"] == ["CREATE_ORDER", "PROCESS_PAYMENT", "RESERVE_INVENTORY", "CANCEL_PAYMENT", "CANCEL_ORDER"]


def test_sagas_are_folded_in_one_sorted_pass(spark):
    """No operator that calls Python once per saga; earlier states come as rows of the same pass."""
    starts, events = fx.saga_starts(spark, SF_SMALL), decode.decode_saga_envelope(fx.saga_events(spark, SF_SMALL))
    out = keyed.orchestrate(keyed.saga_input(starts, events), None)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    whole = _rows(out.filter("kind = 'COMMAND'"), "saga_id", "seq", "command", "payment_id", "reason")
    early = keyed.orchestrate(keyed.saga_input(starts, events.filter("offset % 10 <= 2")), None)
    states = early.filter("kind = 'STATE'").withColumnRenamed("reason", "failure_reason")
    none = starts.limit(0)
    late = keyed.orchestrate(keyed.saga_input(none, events), states)  # the early events come again
    parts = early.unionByName(late).filter("kind = 'COMMAND'")
    assert _rows(parts, "saga_id", "seq", "command", "payment_id", "reason") == whole


def test_a_redelivered_creation_does_not_take_an_order_back(spark):
    schema = "order_id STRING, offset LONG, event_type STRING, customer_id STRING, total_amount DECIMAL(19,2), quantity INT, event_ts TIMESTAMP_NTZ"
    rows = spark.createDataFrame([("O", 5, "ORDER_CREATED", "A", None, 1, None), ("O", 21, "INVENTORY_RESERVED", None, None, None, None),
                                  ("O", 21, "INVENTORY_RESERVED", None, None, None, None), ("N", 3, "PAYMENT_FAILED", None, None, None, None),
                                  ("N", 4, "ORDER_CREATED", "C", None, 2, None)], schema)
    owners = spark.createDataFrame([("O", "B", None, 7, 20)], keyed.ORDER_STATE)
    got = keyed.owned_events(rows, owners)
    assert _rows(got.select("order_id", "offset", "owner.customer_id", "owner.quantity")) == [("N", 4, "C", 2), ("O", 21, "B", 7)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan


def test_the_saga_view_keeps_what_its_fold_reads(spark, monkeypatch):
    """Events of the view carry no payload: they are written, shuffled and folded again per bucket."""
    seen = []
    plain = J.BucketedView.__init__
    monkeypatch.setattr(J.BucketedView, "__init__", lambda self, spark, base, key, schema, *a, **b: (
        seen.append(schema.fieldNames()), plain(self, spark, base, key, schema, *a, **b))[1])
    out = J.stream_saga(spark, SF_SMALL)
    assert sorted(seen[0]) == sorted(G.PREFIX_COLUMNS)
    assert _rows(out) == _rows(G.saga_state(fx.saga_starts(spark, SF_SMALL), decode.decode_saga_envelope(fx.saga_events(spark, SF_SMALL))))


def test_payload_has_the_fields_of_its_command(spark):
    import json
    for r in K.command_outbox(E.queries()["saga_commands"](spark, SF_SMALL)).filter("aggregate_id = 'saga-6'").collect():
        names = [K.JSON_NAMES[f] for f in K.COMMAND_FIELDS[r.event_type]]
        assert list(json.loads(r.payload)) == ["sagaId", "orderId", *names]


def test_stock_stream_over_shuffled_files_equals_the_batch(spark, tmp_path):
    sf = _shuffled(tmp_path, "events")
    cols = ("seq", "outcome", "reserved_after")
    got = ordered.run_ordered_stock(spark, lambda: fx.inventory_commands(spark, sf), fx.inventory(spark, sf))
    assert _rows(got, *cols) == _rows(E.queries()["inventory_reservations"](spark, SF_SMALL), *cols)


def test_waiting_commands_are_released_by_product():
    """A bucket's commands wait as blocks; what is due goes with its product's smaller ``seq``, the rest stays."""
    class State:
        def __init__(self):
            self.rows, self.map, self.calls = [], {}, 0

        def exists(self):
            return bool(self.rows or self.map)

        def get(self):
            return iter(self.rows)

        def appendList(self, rows):
            self.calls += 1
            self.rows += rows

        def put(self, rows):
            self.rows = rows

        def clear(self):
            self.rows = []

        def getValue(self, key):
            return self.map.get(key)

        def updateValue(self, key, value):
            self.map[key] = value

    class Handle:
        def registerTimer(self, at):
            self.at = at

    class At:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentProcessingTimeInMs(self):
            return self.ms

    p = ordered.OrderedStock(1000)
    p.handle, p.stock, p.waiting = Handle(), State(), State()
    cols = ["seq", "product_id", "order_id", "quantity", "command", "stock_quantity", "reserved_quantity", "found", "bucket"]
    rows = lambda *r: iter([pd.DataFrame([(s, q, "O", 2, "RESERVE", 3, 0, True, 1) for s, q in r], columns=cols)])
    many = [(k, f"Q{k}") for k in range(100, 200)]
    assert sum(map(len, p.handleInputRows((1,), rows((5, "A"), (9, "B"), *many), At(0)))) == 0
    assert p.waiting.calls == 1  # not one call per product
    assert sum(map(len, p.handleInputRows((1,), rows((3, "A"), (7, "A"), (8, "C")), At(500)))) == 0
    out = pd.concat(p.handleExpiredTimer((1,), At(1000), None))
    got = out.loc[~out["product_id"].str.startswith("Q"), ["seq", "product_id", "outcome", "reserved_after"]]
    assert list(got.itertuples(index=False, name=None)) == [(3, "A", "RESERVED", 2), (5, "A", "INSUFFICIENT", 2), (9, "B", "RESERVED", 2)]
    out = pd.concat(p.handleExpiredTimer((1,), At(1500), None))
    assert out["seq"].tolist() == [7, 8] and out["outcome"].tolist() == ["INSUFFICIENT", "RESERVED"] and not p.waiting.rows


def test_groups_by_size_over_five_files(spark, tmp_path):
    sf = _folder_tables(tmp_path, tables=("events",))
    got = ordered.run_size_or_time(spark, lambda: _records(spark, sf), 7)
    sizes = got.groupBy("topic", "partition", "chunk").count()
    assert sizes.agg(F.max("count")).first()[0] == 7
    last = sizes.groupBy("topic", "partition").agg(F.max("chunk").alias("last"))
    assert sizes.join(last, ["topic", "partition"]).filter("chunk < last AND count < 7").count() == 0
    assert got.count() == fx.activity_log(spark, SF_SMALL).count()


def test_first_delivery_in_a_shuffled_batch(spark, tmp_path):
    sf = _shuffled(tmp_path, "events")
    got = ordered.run_first_deliveries(spark, sf, max_files=5)
    assert got.count() == got.select("message_id").distinct().count() and got.count() > 0
    first = fx.deliveries(spark, SF_SMALL).filter("trim(value) <> ''").groupBy(
        F.coalesce("message_id_hdr", F.concat_ws("-", "topic", "partition", "offset")).alias("m")).agg(
        F.min(F.struct("offset", "delivery")).alias("f")).select("m", "f.offset", "f.delivery")
    assert _rows(got, "message_id", "offset", "delivery") == _rows(first)


def test_first_deliveries_call_no_python_per_id(spark):
    rows = [("a", 4, 0), ("a", 2, 1), ("b", 3, 0), ("b", 3, 1), ("c", 1, 0)]
    batch = spark.createDataFrame(rows, "message_id STRING, offset LONG, delivery INT")
    out = ordered.first_deliveries(batch, spark.createDataFrame([("c",)], "message_id STRING"))
    assert _rows(out, "message_id", "offset", "delivery") == [("a", 2, 1), ("b", 3, 0)]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "")
    assert len(_rows(ordered.first_deliveries(batch, None))) == 3


@pytest.mark.parametrize("days, copies", [(7, 1), (0, 2)])
def test_an_id_is_known_until_it_expires(spark, tmp_path, days, copies):
    """The same events in two files: with a retention of nothing both give first deliveries."""
    for t in TABLES:
        os.symlink(table_path(SF_SMALL, t), f"{tmp_path}/{t}.parquet") if t != "events" else os.makedirs(f"{tmp_path}/{t}.parquet")
    for k in range(2):
        pq.write_table(pq.read_table(table_path(SF_SMALL, "events")), f"{tmp_path}/events.parquet/part-{k}.parquet")
    once = ordered.run_first_deliveries(spark, SF_SMALL).count()
    assert ordered.run_first_deliveries(spark, str(tmp_path), retention_days=days).count() == copies * once


# ------------------------------------------------------------------ atomic outputs
def test_outputs_appear_together_or_not_at_all(spark, tmp_path):
    out = AtomicOutputs(spark, str(tmp_path / "atomic"))
    rows = spark.range(10)
    makes = {"a": lambda b: b.withColumn("x", F.col("id") * 2), "b": lambda b: b.filter("id % 2 = 0")}

    def broken(_):
        raise RuntimeError("stopped between the two writes")

    assert out.read("a") is None
    with pytest.raises(RuntimeError):
        out.write(rows, 0, {"a": makes["a"], "b": broken})
    assert out.read("a") is None and out.read("b") is None  # the first output was written, and is not seen
    out.write(rows, 0, makes)
    out.write(rows, 0, makes)  # a replay
    assert (out.read("a").count(), out.read("b").count()) == (10, 5)
    with pytest.raises(RuntimeError):
        out.write(rows, 1, {"a": makes["a"], "b": broken})
    assert (out.read("a").count(), out.read("b").count()) == (10, 5)
    out.publish(0, "0" * 32, {"a": "nowhere", "b": "nowhere"})  # two attempts raced: one of them counts, for both outputs
    assert out.published() == [0]


# ------------------------------------------------------------------ polled extract
@pytest.mark.parametrize("mode", ["incrementing", "timestamp+incrementing"])
def test_polls_give_each_row_once(spark, tmp_path, mode):
    src = fx.incremental_source(spark, SF_SMALL)
    key = F.col("id") if mode == "incrementing" else F.year("updated_at")
    cuts = [300, 301, 900, None] if mode == "incrementing" else [1994, 1996, 1996, None]
    base, seen = str(tmp_path / "polls"), 0
    for cut in cuts:
        grown = src if cut is None else src.filter(key < cut)
        seen += PolledExtract(spark, lambda rows=grown: rows, base, mode).poll()  # a new object each time: a restart
    polled = PolledExtract(spark, lambda: src, base, mode)
    assert seen == src.count() and _rows(polled.rows()) == _rows(src)
    assert polled.poll() == 0

    polled = PolledExtract(spark, lambda: src, str(tmp_path / "broken"), mode)
    publish, polled.out.publish = polled.out.publish, lambda *a: (_ for _ in ()).throw(RuntimeError("stopped"))
    with pytest.raises(RuntimeError):
        polled.poll()
    assert polled.rows() is None and polled.mark() is None
    polled.out.publish = publish
    assert polled.poll() == src.count() and _rows(polled.rows()) == _rows(src)


# ------------------------------------------------------------------ pages and circuits
def test_pages_of_a_sorted_frame(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 101).alias("v"))
    want = [r.id for r in df.orderBy(F.col("v").desc(), "id").collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart
    try:
        pages = SortedPages(df.repartition(7), "v", descending=True, key="id")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(pages.ranked.starts) > 1
    for page in (0, 1, 17, 39):
        got = sorted(pages.page(page, 25).collect(), key=lambda r: r["rank"])
        assert [r.id for r in got] == want[25 * page: 25 * page + 25]
        assert {(r.total_elements, r.total_pages) for r in got} == {(1000, 40)}
    assert pages.page(40, 25).count() == 0
    plan = pages.page(17, 25)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*__part#\d+", plan), plan  # other partitions are not read


def test_circuits_do_not_depend_on_blocks(spark):
    a = fx.activity_log(spark, SF_SMALL)
    ms = F.unix_millis(F.col("consumed_ts").cast("timestamp")) - F.unix_millis(F.col("record_ts").cast("timestamp"))
    assert _rows(O.circuit_states(a, ms, block=13)) == _rows(O.circuit_states(a, ms))
