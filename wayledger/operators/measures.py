"""Order and revenue measures, plain and compared, grouped by stored or derived labels.

Blank order ids never survive cleaning, so a count of rows is the count of orders and the id column
does not have to be read.

Every measure also works on a condensed table, in which a row stands for many bookings with equal keys: it holds their number in
``WEIGHT`` and the sum of their amounts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


WEIGHT = "bookings"


def weight(table: DataFrame) -> Column:
    """Bookings that a row stands for."""
    return F.col(WEIGHT) if WEIGHT in table.columns else F.lit(1).cast("bigint")


def counted(table: DataFrame, condition: str | None = None) -> Column:
    """Number of bookings, of those that meet a condition if one is given."""
    if WEIGHT not in table.columns:
        return F.count_if(F.expr(condition)) if condition else F.count(F.lit(1))
    return F.coalesce(F.sum(F.when(F.expr(condition), F.col(WEIGHT)) if condition else F.col(WEIGHT)), F.lit(0).cast("bigint"))


def orders(table: DataFrame) -> Column:
    return counted(table).alias("orders")


def condense(flagged: DataFrame, *groupings: Sequence[str]) -> DataFrame:
    """One row per flags and keys of each grouping, from one pass; ``grouping`` tells the groupings apart, by their place.

    Keys of other groupings are NULL in a row, so a report reads the rows of the one grouping that holds its keys."""
    flags = [c for c in ("is_cur", "is_prev") if c in flagged.columns]
    keys = list(dict.fromkeys(k for g in groupings for k in g))
    # not grouping sets: two uses of them in one plan differ in column ids, and Spark then finds the cached table for the first use only
    place = F.lit(0) if len(groupings) == 1 else F.explode(F.array(*[F.lit(i) for i in range(len(groupings))]))
    each = flagged.withColumn("grouping", place)
    for key in keys:
        own = [i for i, g in enumerate(groupings) if key in g]
        if len(own) < len(groupings):
            each = each.withColumn(key, F.when(F.col("grouping").isin(own), F.col(key)))
    table = each.groupBy(*flags, *keys, "grouping").agg(counted(flagged).alias(WEIGHT), F.coalesce(F.sum("twd_amount"), F.lit(0.0)).alias("twd_amount"))
    return table.select(*flags, *keys, WEIGHT, "twd_amount", "grouping")


def revenue() -> Column:
    return F.coalesce(F.sum("twd_amount"), F.lit(0.0)).alias("revenue")


def compared(table: DataFrame) -> list[Column]:
    """Current and previous orders and revenue from rows flagged ``is_cur`` / ``is_prev``."""
    def amount(flag: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(flag), F.col("twd_amount"))), F.lit(0.0))

    return [
        counted(table, "is_cur").alias("orders"),
        counted(table, "is_prev").alias("prev_orders"),
        amount("is_cur").alias("revenue"),
        amount("is_prev").alias("prev_revenue"),
    ]


MEASURES = ("orders", "revenue")
COMPARED = ("orders", "prev_orders", "revenue", "prev_revenue")


def with_keys(bookings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose grouping keys are all present; a missing key is no group."""
    for key in keys:
        bookings = bookings.filter(F.col(key).isNotNull())
    return bookings


def summarize(bookings: DataFrame, *keys: str) -> DataFrame:
    """Orders and revenue per key."""
    return with_keys(bookings, keys).groupBy(*keys).agg(orders(bookings), revenue())


def compare(flagged: DataFrame, *keys: str, keep_vanished: bool = False) -> DataFrame:
    """Current and previous measures per key from one pass.

    Keys seen only in the previous period are dropped (a left join on the current period) unless
    ``keep_vanished`` asks for the union of keys (a full outer join).
    """
    table = with_keys(flagged, keys).groupBy(*keys).agg(*compared(flagged))
    return table if keep_vanished else table.filter(F.col("orders") > 0)


def regroup(table: DataFrame, labels: Mapping[str, Column], *keys: str) -> DataFrame:
    """Roll an aggregate up to labels derived from its keys.

    Used after a first grouping by product name, so that costly text rules run once per product
    instead of once per booking; sums of sums stay exact.
    """
    sums = [F.sum(c).alias(c) for c in table.columns if c in COMPARED]
    return table.withColumns(dict(labels)).groupBy(*keys, *labels).agg(*sums)


def differences(table: DataFrame) -> DataFrame:
    added = {"orders_diff": F.col("orders") - F.col("prev_orders")}
    if "revenue" in table.columns:
        added["revenue_diff"] = F.col("revenue") - F.col("prev_revenue")
    return table.withColumns(added)


def change_pct(current: Column, previous: Column) -> Column:
    """Percent change, defined only against a positive previous value."""
    return F.when(previous > 0, F.try_divide(current - previous, previous) * 100)


def ratio(amount: Column, count: Column) -> Column:
    """amount / count, 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(amount, count), F.lit(0.0))


def share_pct(part: Column, total: Column) -> Column:
    """Percent of a total, one decimal, half-even on the scaled value."""
    return F.rint(F.try_divide(part, total) * 100 * 10) / 10
