"""Reports shared by every single product line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayledger.functions.calendar import travel_month
from wayledger.operators.measures import orders, summarize
from wayledger.operators.ranking import top


def of_line(bookings: DataFrame, line: str) -> DataFrame:
    return bookings.filter(F.col("product_line") == line)


def line_top_products(bookings: DataFrame, line: str, n: int = 20) -> DataFrame:
    return top(summarize(of_line(bookings, line), "bnb_name"), "revenue", n, ["bnb_name"])


def line_type_share(bookings: DataFrame, line: str, several: bool = False) -> DataFrame:
    """Orders and revenue per type; with ``several`` only where there is more than one type."""
    table = summarize(of_line(bookings, line), "bnb_type")
    if several:
        types = F.count(F.lit(1)).over(Window.partitionBy())  # one row for each type
        table = table.withColumn("_types", types).filter("_types > 1").drop("_types")
    return table.orderBy(F.desc("revenue"), "bnb_type")


def checkin_monthly(bookings: DataFrame, line: str) -> DataFrame:
    months = of_line(bookings, line).withColumn("check_in_month", travel_month(F.col("check_in")))
    return summarize(months, "check_in_month").orderBy("check_in_month")


def platform_share(bookings: DataFrame, line: str) -> DataFrame:
    known = of_line(bookings, line).filter(F.col("platform").isNotNull())
    return known.groupBy("platform").agg(orders(known)).orderBy(F.desc("orders"), "platform")
