"""Inventory reservations.

A reservation succeeds iff ``quantity − reserved >= n``; a release lowers
``reserved`` but never below 0; a rejected reservation consumes nothing.
Because rejections depend on everything before them, the fold is sequential
per product — no window sum can express it.

Plan: commands ⟕ stock on product (J9); commands without a stock row are
answered at once. The others are folded by
:func:`flowlens.operators.blockfold.blocked_fold`: blocks of a product become
tables of what they do to every reserved count, the tables are applied in
order, and the blocks are replayed from their starts. No task holds more than a
block of a hot product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators.blockfold import blocked_fold

OUT_SCHEMA = ("seq LONG, product_id STRING, order_id STRING, command STRING, quantity INT, outcome STRING, "
              "available_before INT, reserved_after INT")


def available_stock(quantity="quantity", reserved="reserved_quantity") -> Column:
    """``quantity − reserved``."""
    return F.col(quantity) - F.col(reserved)


def reserve_against_stock(commands: DataFrame, stock: DataFrame) -> DataFrame:
    """Each command with its product's stock row; ``found`` is false
    (reason "Inventory not found") when the product has no stock row."""
    j = commands.join(stock.select("product_id", F.col("quantity").alias("stock_quantity"), "reserved_quantity"),
                      "product_id", "left")
    return j.withColumn("found", F.col("stock_quantity").isNotNull()).withColumn(
        "reason", F.when(~F.col("found"), F.lit("Inventory not found")))


class StockFold:
    """The reserved count of one product, and its commands applied in order."""

    def __init__(self, product, reserved: int | None = None):
        self.product, self.reserved = product, reserved

    def outcomes(self, total: int, commands: list[str], amounts: list[int]) -> tuple[list[str], list[int], list[int]]:
        """Outcome, available count before and reserved count after each command, in order."""
        r, outcome, before, after = self.reserved, [], [], []
        for command, n in zip(commands, amounts):
            before.append(total - r)
            if command != "RESERVE":
                r = max(0, r - n)
                outcome.append("RELEASED")
            elif total - r >= n:
                r += n
                outcome.append("RESERVED")
            else:
                outcome.append("INSUFFICIENT")
            after.append(r)
        self.reserved = r
        return outcome, before, after

    def apply(self, b: pd.DataFrame) -> pd.DataFrame:
        """Outcomes of the product's commands, in the order of the rows."""
        found, stock = b["found"].to_numpy(), b["stock_quantity"].to_numpy()
        outcome = np.full(len(b), "NOT_FOUND", dtype=object)
        before, after = np.full(len(b), None, dtype=object), np.full(len(b), None, dtype=object)
        if len(b) and found[0]:  # a product has a stock row or has none
            if self.reserved is None:
                self.reserved = int(b["reserved_quantity"].iloc[0])
            outcome[:], before[:], after[:] = self.outcomes(int(stock[0]), b["command"].tolist(), b["quantity"].tolist())
        return pd.DataFrame({"seq": b["seq"].to_numpy(), "product_id": b["product_id"].to_numpy(),
                             "order_id": b["order_id"].to_numpy(), "command": b["command"].to_numpy(),
                             "quantity": b["quantity"].to_numpy().astype(np.int32), "outcome": outcome,
                             "available_before": before, "reserved_after": after})


def inventory_reservations(commands: DataFrame, stock: DataFrame, num_partitions: int | None = None,
                           block: int = 1 << 20) -> DataFrame:
    """Outcome of every command — RESERVED, INSUFFICIENT, RELEASED or
    NOT_FOUND (a missing product, releases included). ``block`` consecutive
    values of ``seq`` are folded in one task."""
    j = reserve_against_stock(commands, stock).fillna({"reserved_quantity": 0})
    none = F.lit(None).cast("int")
    missing = j.filter(~F.col("found")).select("seq", "product_id", "order_id", "command", F.col("quantity").cast("int").alias("quantity"),
                                               F.lit("NOT_FOUND").alias("outcome"), none.alias("available_before"),
                                               none.alias("reserved_after"))
    return blocked_fold(j.filter("found"), OUT_SCHEMA, block, num_partitions).unionByName(missing)


def inventory_after(stock: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Stock per product after the commands — quantity, reserved, available."""
    last = outcomes.filter(F.col("outcome") != "NOT_FOUND").groupBy("product_id").agg(
        F.max_by("reserved_after", "seq").alias("_r"))
    j = stock.join(last, "product_id", "left")
    r = F.coalesce("_r", "reserved_quantity")
    return j.select("product_id", "quantity", r.alias("reserved_quantity"), (F.col("quantity") - r).alias("available_quantity"))


def inventory_lookup(inv: DataFrame, product_id: str) -> DataFrame:
    """One product's stock."""
    return inv.filter(F.col("product_id") == product_id)
