"""Overview page: headline figures, product lines, best sellers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayledger.operators.measures import change_pct, compare, compared, differences, ratio, share_pct, summarize
from wayledger.operators.ranking import numbered, top


def _kpis(table: DataFrame, *keys: str) -> DataFrame:
    """Figures, previous figures and percent change from a compared aggregate."""
    average = ratio(F.col("revenue"), F.col("orders"))
    previous = ratio(F.col("prev_revenue"), F.col("prev_orders"))
    return table.withColumns({"avg_order": average, "prev_avg_order": previous}).select(
        *keys,
        "revenue", "prev_revenue", change_pct(F.col("revenue"), F.col("prev_revenue")).alias("revenue_pct"),
        "orders", "prev_orders", change_pct(F.col("orders"), F.col("prev_orders")).alias("orders_pct"),
        "avg_order", "prev_avg_order",
        change_pct(F.col("avg_order"), F.col("prev_avg_order")).alias("avg_order_pct"),
    )


def kpi_overview(flagged: DataFrame) -> DataFrame:
    return _kpis(flagged.agg(*compared(flagged)))


def kpi_by_line(flagged: DataFrame) -> DataFrame:
    """The same figures for each product line that sold in the current period."""
    return _kpis(compare(flagged, "product_line"), "product_line").orderBy("product_line")


def product_line_summary(bookings: DataFrame) -> DataFrame:
    return summarize(bookings, "product_line").orderBy(F.desc("revenue"), "product_line")


def product_line_share(bookings: DataFrame) -> DataFrame:
    """Product lines with their percent of revenue; the window covers one row per line."""
    total: Column = F.sum("revenue").over(Window.partitionBy())
    return (
        summarize(bookings, "product_line")
        .withColumn("share_pct", share_pct(F.col("revenue"), total))
        .orderBy(F.desc("revenue"), "product_line")
    )


def product_line_detail(flagged: DataFrame) -> DataFrame:
    table = differences(compare(flagged, "product_line"))
    return table.select(
        "product_line", "orders", "prev_orders", "orders_diff", "revenue", "prev_revenue", "revenue_diff"
    ).orderBy(F.desc("revenue"), "product_line")


def top_products(bookings: DataFrame, n: int = 10) -> DataFrame:
    keys = ["bnb_name", "product_line"]
    best = top(summarize(bookings, *keys), "revenue", n, keys)
    return numbered(best, "revenue", keys).withColumn("avg_order", ratio(F.col("revenue"), F.col("orders")))
