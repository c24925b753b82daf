"""Row browsing: text search, ordering, paging, head."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.plans.ranking import with_position

PAGE_SIZE = 20  # fixed value: rows per page


def _needle_rx(n: str, regex: bool) -> str:
    return "(?iu)" + (n if regex else re.escape(n))


def row_search(df: DataFrame, query: str | None, *, columns: Sequence[str] | None = None,
               regex: bool = True) -> DataFrame:
    """Rows where EVERY whitespace-separated needle matches (case-insensitive,
    a regex unless ``regex=False``) at least one column's text. Missing cells
    read as 'nan'. Blank query -> all rows. One filter, no shuffle."""
    needles = (query or "").split()
    if not needles:
        return df
    cols = list(columns) if columns is not None else df.columns
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols}

    def one(n: str) -> Column:
        rx = _needle_rx(n, regex)
        return reduce(lambda a, b: a | b, [t.rlike(rx) for t in text.values()])

    return df.where(reduce(lambda a, b: a & b, [one(n) for n in needles]))


def sort_ts(df: DataFrame, order: Sequence[str] = ("ts", "rid")) -> DataFrame:
    """Global time order (range-partitioned sort); use only at output."""
    return df.orderBy(*order)


def head_n(df: DataFrame, n: int = 100, order: Sequence[str] = ("ts", "rid")) -> DataFrame:
    """First n rows in time order (per-partition top-n, then merge)."""
    return df.orderBy(*order).limit(n)


def page_bounds(total: int, page: int, size: int = PAGE_SIZE) -> tuple[int, int, int, int]:
    """(page clamped to [1, pages], pages = max(1, ceil(total/size)), start, end) — 0-based [start, end)."""
    pages = max(1, math.ceil(total / size)) if total > 0 else 1
    p = max(1, min(int(page), pages))
    start = (p - 1) * size
    return p, pages, start, min(start + size, total)


def page_rows(df: DataFrame, page: int, *, size: int = PAGE_SIZE, order: Sequence[str] = ("ts", "rid")) -> DataFrame:
    """Rows of one page with their 1-based row number and page metadata.

    Only the pieces of the order that the page touches are sorted, so a deep page costs
    the same as the first."""
    total = df.count()
    p, pages, start, end = page_bounds(total, page, size)
    pos = with_position(df, [], list(order), only=lambda first, stop, total: (first < end) & (stop > start))
    rows = pos.where((F.col("pos") >= start) & (F.col("pos") < end))
    return rows.select(
        (F.col("pos") + 1).alias("row_num"), F.lit(p).cast("long").alias("page"),
        F.lit(pages).cast("long").alias("total_pages"), F.lit(total).cast("long").alias("total_rows"),
        *[c for c in df.columns]).orderBy("row_num")
