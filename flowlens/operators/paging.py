"""Sorting and paging (T3): one page of a sorted frame plus its totals.

The page is a top-k (``orderBy().offset().limit()`` becomes
``TakeOrderedAndProject`` over the first ``(page+1)·size`` rows), never a
global sort; the totals are one count aggregate, cross-joined as one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.common import attach_one_row
from flowlens.operators.ranking import Ranked


def paged(df: DataFrame, page: int, size: int, sort_col: str, descending: bool = False,
          key: str | None = None) -> DataFrame:
    """Rows of page ``page`` (0-based) of ``size``, sorted by ``sort_col`` then
    ``key``, with ``total_elements`` and ``total_pages`` on every row."""
    o = F.col(sort_col).desc() if descending else F.col(sort_col).asc()
    order = [o] + ([F.col(key)] if key else [])
    content = df.orderBy(*order).offset(page * size).limit(size)
    totals = df.agg(F.count(F.lit(1)).alias("total_elements")).withColumn(
        "total_pages", F.ceil(F.col("total_elements") / F.lit(size)).cast("long"))
    return attach_one_row(content, totals)


class SortedPages:
    """Pages of a frame that is sorted once (T2–T4, deep pages).

    ``offset().limit()`` keeps ``page * size`` rows in every task and in one final
    task. Here the rows are range sorted and written once, and a page reads only the
    partitions that hold its ranks, so page one million costs what page one costs."""

    def __init__(self, df: DataFrame, sort_col: str, descending: bool = False, key: str | None = None):
        o = F.col(sort_col).desc() if descending else F.col(sort_col).asc()
        self.ranked = Ranked(df, [o] + ([F.col(key).asc()] if key else []))

    def page(self, page: int, size: int) -> DataFrame:
        """Rows of page ``page`` (0-based), with their rank and the totals."""
        total = self.ranked.total
        return self.ranked.page(page, size).withColumn("total_elements", F.lit(total).cast("long")) \
            .withColumn("total_pages", F.lit(-(-total // size)).cast("long"))
