"""Order statistics: per-product aggregate, hourly counts, top-k and lookups.

The per-product aggregate is commutative apart from the first-seen name, which
``min_by(name, offset)`` makes order-free. The pass over the events is a
partial+final hash aggregate on (product, name) with numeric buffers only, so
a hot product is combined map-side and never lands in one task as raw rows.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators.fold import Fold, keyed_fold

ADDING = ("CREATED", "CONFIRMED")
SUBTRACTING = ("CANCELLED", "REFUNDED")


def total_amount(price: Column | str = "price", quantity: Column | str = "quantity") -> Column:
    """exact ``price * quantity`` (decimal times int stays decimal)."""
    p = F.col(price) if isinstance(price, str) else price
    q = F.col(quantity) if isinstance(quantity, str) else quantity
    return (p * q.cast("decimal(10,0)")).cast("decimal(38,2)")


def product_order_stats(events: DataFrame, key: str = "product_id", order_col: str = "offset",
                        single_pass: bool | None = None) -> DataFrame:
    """A1: per product — orders, quantity, revenue, cancellations, first name.

    CREATED/CONFIRMED add an order, its quantity and revenue; CANCELLED/REFUNDED
    add a cancellation and subtract revenue but keep quantity. An empty key
    restarts the aggregate on every event, so only its last event counts.

    Two steps so the pass over the events is a hash aggregate: every buffer
    of step 1 is a number (sums, min/max offset, ``max_by`` of a number by
    offset), keyed by (product, name); step 2 folds the small
    (product, name) table into one row per product, picking the first-seen
    name and — for the empty key — the last event's contribution.

    A stream cannot chain two aggregations, so streaming input (or
    ``single_pass=True``) uses one aggregate with ``min_by``/``max_by``
    (a sort-based aggregate, kept in the state store).
    """
    if single_pass if single_pass is not None else events.isStreaming:
        return _product_order_stats_single(events, key, order_col)
    t = F.col("event_type")
    amt = total_amount()
    add, sub = t.isin(*ADDING), t.isin(*SUBTRACTING)
    o = F.col(order_col)
    e = events.select(
        F.col(key).alias("_k"), "product_name", o.alias("_off"),
        add.cast("long").alias("_o"),
        F.when(add, F.col("quantity")).otherwise(0).cast("long").alias("_q"),
        F.when(add, amt).when(sub, -amt).otherwise(F.lit(0)).cast("decimal(38,2)").alias("_r"),
        sub.cast("long").alias("_c"),
    )
    pairs = e.groupBy("_k", "product_name").agg(
        F.min("_off").alias("_first"), F.max("_off").alias("_last"),
        *[F.sum(c).alias("s" + c) for c in ("_o", "_q", "_r", "_c")],
        *[F.max_by(c, "_off").alias("l" + c) for c in ("_o", "_q", "_r", "_c")],
    )
    last = F.max_by(F.struct("l_o", "l_q", "l_r", "l_c", "product_name"), F.col("_last"))
    g = pairs.groupBy("_k").agg(
        F.min_by("product_name", "_first").alias("_first_name"),
        *[F.sum("s" + c).alias("t" + c) for c in ("_o", "_q", "_r", "_c")],
        last.alias("_lastrow"),
    )
    empty = F.col("_k") == ""
    pick = lambda c: F.when(empty, F.col(f"_lastrow.l{c}")).otherwise(F.col(f"t{c}"))
    return g.select(
        F.col("_k").alias("product_id"),
        F.when(empty, F.col("_lastrow.product_name")).otherwise(F.col("_first_name")).alias("product_name"),
        pick("_o").alias("total_orders"), pick("_q").alias("total_quantity"),
        pick("_r").cast("decimal(38,2)").alias("total_revenue"), pick("_c").alias("cancelled_orders"),
    )


def _product_order_stats_single(events: DataFrame, key: str, order_col: str) -> DataFrame:
    t = F.col("event_type")
    amt = total_amount()
    add, sub = t.isin(*ADDING), t.isin(*SUBTRACTING)
    e = events.select(
        key, "product_name", order_col,
        add.cast("long").alias("_o"),
        F.when(add, F.col("quantity")).otherwise(0).cast("long").alias("_q"),
        F.when(add, amt).when(sub, -amt).otherwise(F.lit(0)).cast("decimal(38,2)").alias("_r"),
        sub.cast("long").alias("_c"),
    )
    last = F.max_by(F.struct("_o", "_q", "_r", "_c", "product_name"), F.col(order_col))
    g = e.groupBy(key).agg(
        F.min_by("product_name", order_col).alias("_first_name"),
        F.sum("_o").alias("_to"), F.sum("_q").alias("_tq"),
        F.sum("_r").alias("_tr"), F.sum("_c").alias("_tc"),
        last.alias("_last"),
    )
    empty = F.col(key) == ""
    return g.select(
        F.col(key).alias("product_id"),
        F.when(empty, F.col("_last.product_name")).otherwise(F.col("_first_name")).alias("product_name"),
        F.when(empty, F.col("_last._o")).otherwise(F.col("_to")).alias("total_orders"),
        F.when(empty, F.col("_last._q")).otherwise(F.col("_tq")).alias("total_quantity"),
        F.when(empty, F.col("_last._r")).otherwise(F.col("_tr")).cast("decimal(38,2)").alias("total_revenue"),
        F.when(empty, F.col("_last._c")).otherwise(F.col("_tc")).alias("cancelled_orders"),
    )


def _no_orders() -> tuple:
    return (None, None, 0, 0, Decimal(0), 0, None, None, 0, 0, Decimal(0), 0)


def _add_order(state: tuple, row: tuple) -> tuple:
    offset, name, kind, quantity, price = row
    amount = price * quantity if price is not None and quantity is not None else Decimal(0)
    if kind in ADDING:
        own = (1, quantity or 0, amount, 0)
    elif kind in SUBTRACTING:
        own = (0, 0, -amount, 1)
    else:
        own = (0, 0, Decimal(0), 0)
    return _join_orders(state, (offset, name, *own, offset, name, *own))


def _join_orders(a: tuple, b: tuple) -> tuple:
    if a[0] is None or b[0] is None:
        return b if a[0] is None else a
    first = min(a[:2], b[:2], key=lambda s: (s[0], s[1] or ""))
    last = max(a[6:], b[6:], key=lambda s: (s[0], s[1] or ""))
    return (*first, *(x + y for x, y in zip(a[2:6], b[2:6])), *last)


def _order_result(key, state: tuple) -> tuple:
    return state[7:] if key == "" else state[1:6]


_SUMS = "orders long, quantity long, revenue decimal(38,2), cancelled long"
ORDER_STATS = Fold(
    inputs=("offset", "product_name", "event_type", "quantity", "price"),
    state=f"first long, first_name string, {_SUMS}, last long, last_name string, "
          + ", ".join(f"last_{c}" for c in _SUMS.split(", ")),
    result="product_name string, total_orders long, total_quantity long, total_revenue decimal(38,2), cancelled_orders long",
    init=_no_orders, step=_add_order, merge=_join_orders, finish=_order_result)


def folded_order_stats(events: DataFrame, **how) -> DataFrame:
    """The statistics of :func:`product_order_stats` as a pluggable fold:
    the aggregate is four functions, and any other set of four runs the same way.
    Offsets are not null; a null price or quantity counts as 0."""
    return keyed_fold(events, "product_id", ORDER_STATS, **how)


def hourly_order_count(events: DataFrame, ts_col: str = "timestamp", key: str = "product_id",
                       size: str = "1 hour") -> DataFrame:
    """A2: tumbling-window count of all event types per product."""
    return (events.groupBy(F.window(ts_col, size).alias("w"), F.col(key).alias("product_id"))
            .agg(F.count(F.lit(1)).alias("order_count"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "product_id", "order_count"))


def top_products(stats: DataFrame, n: int = 10) -> DataFrame:
    """Highest revenue first; ties broken by product id. A top-k
    (``TakeOrderedAndProject``), never a global sort."""
    return stats.orderBy(F.col("total_revenue").desc(), F.col("product_id")).limit(n)


def product_hourly_series(hourly: DataFrame, product_id: str, start, end) -> DataFrame:
    """One product's windows whose start lies in ``[start, end]``."""
    return hourly.filter((F.col("product_id") == product_id)
                         & F.col("window_start").between(F.lit(start).cast("timestamp"),
                                                         F.lit(end).cast("timestamp")))


def product_stats_lookup(stats: DataFrame, product_id: str) -> DataFrame:
    """Point read of one product's statistics."""
    return stats.filter(F.col("product_id") == product_id)
