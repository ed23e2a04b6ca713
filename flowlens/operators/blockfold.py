"""Stock reservations of hot products by function composition.

Each command depends on all commands of its product before it, so no window sum
gives its outcome. But a command is a function of the reserved count, which lies in
0..quantity, and functions compose: a block of commands is a table of quantity + 1
numbers, whatever the block's length.

1. Every (product, block of ``seq``) gives its table; blocks run in parallel.
2. Per product the tables are applied in block order to the stock row's reserved
   count, which gives the count that each block starts with: one number is carried, and
   a block costs one row here.
3. Every block is replayed from its start, again in parallel.

So a product with a third of all commands is spread over as many tasks as it has
blocks, and the block size changes no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESERVE = "RESERVE"
MERGE_EVERY = 64  # commands after which equal counts of a table are merged


class BlockTable:
    """What a block of commands makes of every reserved count 0..top."""

    def __init__(self, top: int, total: int):
        self.total = total
        self.counts = np.arange(top + 1, dtype=np.int64)  # distinct counts reached so far
        self.index = np.arange(top + 1)  # start count -> its place in ``counts``

    def apply(self, commands: list[str], amounts: list[int]) -> None:
        v = self.counts
        for k, (command, n) in enumerate(zip(commands, amounts), 1):
            v = np.where(self.total - v >= n, v + n, v) if command == RESERVE else np.maximum(v - n, 0)
            if k % MERGE_EVERY == 0 and len(v) > 1:
                v, at = np.unique(v, return_inverse=True)
                self.index = at[self.index]
        self.counts = v

    def table(self) -> np.ndarray:
        return self.counts[self.index]


class _Runs:
    """Stretches of equal (product, block) in batches sorted by both. A batch's columns are
    taken as lists at once: most blocks hold a few commands only, and a frame for each
    of them would cost far more than its commands."""

    def __init__(self, batches: Iterator[pd.DataFrame]):
        self.batches, self.last = batches, None

    def __iter__(self) -> Iterator[tuple[pd.DataFrame, list[tuple[tuple, int, int, bool]]]]:
        """Batches with their stretches: (key, first row, end, whether the key is new)."""
        for b in self.batches:
            if len(b) == 0:
                continue
            products, blocks = b["product_id"].to_numpy(dtype=object), b["blk"].to_numpy()
            cuts = np.flatnonzero((products[1:] != products[:-1]) | (blocks[1:] != blocks[:-1])) + 1
            heads = [0, *cuts.tolist()]
            out = []
            for head, end in zip(heads, [*heads[1:], len(b)]):
                key = (products[head], int(blocks[head]))
                out.append((key, head, end, key != self.last))
                self.last = key
            yield b, out


def _tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, table, base = None, None, None
    out = []

    def done():
        if table is not None:
            out.append((*key, base, table.table().astype(np.int32).tobytes()))

    for b, runs in _Runs(batches):
        commands, amounts = b["command"].tolist(), b["quantity"].tolist()
        totals, bases = b["stock_quantity"].tolist(), b["reserved_quantity"].tolist()
        for new_key, head, end, is_new in runs:
            if is_new:
                done()
                key, base, total = new_key, int(bases[head]), int(totals[head])
                table = BlockTable(max(total, base, 0), total)
            table.apply(commands[head:end], amounts[head:end])
            if len(out) >= 1000:
                yield _table_frame(out)
                out.clear()
    done()
    yield _table_frame(out)


def _table_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["product_id", "blk", "base", "effect"])


def _starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tables sorted by product and block → the count that each block starts with."""
    product, count = None, 0
    for b in batches:
        out = []
        for p, blk, base, effect in b[["product_id", "blk", "base", "effect"]].itertuples(index=False):
            if p != product:
                product, count = p, base
            out.append((p, blk, count))
            count = int(np.frombuffer(effect, dtype=np.int32)[count])
        yield pd.DataFrame(out, columns=["s_product", "s_blk", "start"])


def _replay(out_columns: list[str]):
    from flowlens.operators.inventory import StockFold

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = None
        for b, runs in _Runs(batches):
            commands, amounts = b["command"].tolist(), b["quantity"].tolist()
            totals, starts = b["stock_quantity"].tolist(), b["start"].tolist()
            outcome, before, after = [], [], []
            for key, head, end, is_new in runs:
                if is_new:
                    fold = StockFold(key[0], int(starts[head]))
                for whole, part in zip((outcome, before, after), fold.outcomes(int(totals[head]), commands[head:end], amounts[head:end])):
                    whole += part
            made = b[["seq", "product_id", "order_id", "command"]].assign(
                quantity=b["quantity"].to_numpy().astype(np.int32), outcome=outcome, available_before=before, reserved_after=after)
            yield made[out_columns]

    return rows


def blocked_fold(found: DataFrame, out_schema: str, block: int, partitions: int | None = None) -> DataFrame:
    """Outcomes of commands whose product has a stock row (``found`` holds
    product_id, seq, command, quantity, stock_quantity, reserved_quantity)."""
    n = [partitions] if partitions else []
    rows = found.withColumn("blk", F.floor(F.col("seq") / F.lit(block)).cast("long")).repartition(*n, "product_id", "blk")
    ordered = rows.sortWithinPartitions("product_id", "blk", "seq")
    tables = ordered.select("product_id", "blk", "command", "quantity", "stock_quantity", "reserved_quantity").mapInPandas(
        _tables, "product_id string, blk long, base int, effect binary")
    starts = (tables.repartition(*n, "product_id").sortWithinPartitions("product_id", "blk")
              .mapInPandas(_starts, "s_product string, s_blk long, start int"))
    joined = rows.join(starts.hint("merge"), (F.col("product_id") == F.col("s_product")) & (F.col("blk") == F.col("s_blk")))
    columns = [c.split()[0] for c in out_schema.split(", ")]
    # Inside a partition of the join the rows of a block lie together; sorted by seq they replay.
    replayed = joined.sortWithinPartitions("product_id", "blk", "seq")
    return replayed.mapInPandas(_replay(columns), out_schema)
