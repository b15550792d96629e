"""Top lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayledger.operators.measures import WEIGHT, counted, orders, revenue, with_keys


def top(table: DataFrame, by: str, n: int, ties: Sequence[str]) -> DataFrame:
    """The n largest rows; equal values are ordered by the key columns."""
    return table.orderBy(F.desc(by), *ties).limit(n)


def numbered(ranked: DataFrame, by: str, ties: Sequence[str]) -> DataFrame:
    """Add 1-based positions to a list already cut to a handful of rows."""
    return ranked.withColumn("rank_no", F.row_number().over(Window.orderBy(F.desc(by), *ties)))


def product_rank(
    flagged: DataFrame,
    by: str = "orders",
    n: int = 10,
    with_city: bool = False,
    labels: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Top products by current orders, or by growth over the previous period.

    Products are counted per (id, name[, city]) now but per id before, so the previous count repeats on
    every variant of an id; that needs a real join of two aggregates.  Each side reads only its own
    period and is aggregated before it is joined, so a hot id brings its distinct variants to the join,
    not its bookings.
    ``labels`` are extra columns computed from the product name after grouping.
    """
    keys = ["bnb_id", "bnb_name"] + (["bnb_city"] if with_city else [])
    if by == "orders":
        ranked = top(_sold(flagged, keys), "orders", n, keys)
    elif by == "growth":
        sold = _condensed_growth(flagged, keys) if WEIGHT in flagged.columns else _growth(flagged, keys)
        ranked = top(sold.withColumn("growth", F.col("orders") - F.col("prev_orders")), "growth", n, keys)
    else:
        raise ValueError(f"rank by 'orders' or 'growth', not {by!r}")
    return numbered(ranked.withColumns(dict(labels or {})), by, keys)


def _sold(flagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    return with_keys(flagged.filter("is_cur"), keys).groupBy(*keys).agg(orders(flagged), revenue())


def _growth(flagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current measures per key and previous orders per id, each side from its own months."""
    previous = with_keys(flagged.filter("is_prev"), ["bnb_id"]).groupBy("bnb_id").agg(counted(flagged).alias("prev_orders"))
    return _sold(flagged, keys).join(previous, "bnb_id", "left").withColumn(
        "prev_orders", F.coalesce("prev_orders", F.lit(0).cast("bigint"))
    )


def _condensed_growth(flagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same of a condensed table, which is read once: previous orders are summed over the variants of an id."""
    amount = F.coalesce(F.sum(F.when(F.col("is_cur"), F.col("twd_amount"))), F.lit(0.0))
    variants = with_keys(flagged, ["bnb_id"]).groupBy(*keys).agg(
        counted(flagged, "is_cur").alias("orders"), amount.alias("revenue"), counted(flagged, "is_prev").alias("prev_orders")
    )
    everywhere = F.sum("prev_orders").over(Window.partitionBy("bnb_id"))
    return with_keys(variants.withColumn("prev_orders", everywhere).filter("orders > 0"), keys)
