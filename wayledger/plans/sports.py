"""Sports page: event type by country."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayledger.functions import rules
from wayledger.operators.measures import summarize
from wayledger.plans.lines import of_line

TOTAL = "合計"
COUNTRY_COLUMNS = {"日本": "japan", "台灣": "taiwan", "韓國": "korea", "其他海外": "other"}


def seb_type_summary(bookings: DataFrame) -> DataFrame:
    return summarize(of_line(bookings, "SEB"), "seb_type").orderBy(F.desc("revenue"), "seb_type")


def seb_country_summary(bookings: DataFrame) -> DataFrame:
    return summarize(of_line(bookings, "SEB"), "seb_country").orderBy(F.desc("revenue"), "seb_country")


def _sales(bookings: DataFrame) -> DataFrame:
    """Sales per type and country plus one zero row for every cell of the full grid.

    Whoever sums over this sees all cells; no join is needed to complete the grid.
    """
    sold = summarize(of_line(bookings, "SEB"), "seb_type", "seb_country")
    countries = F.array(*[F.lit(c) for c in rules.SEB_COUNTRIES])
    zeros = (
        bookings.sparkSession.range(0, 1, 1, 1)
        .select(F.explode(F.array(*[F.lit(t) for t in rules.SEB_TYPES])).alias("seb_type"))
        .select("seb_type", F.explode(countries).alias("seb_country"))
        .withColumns({"orders": F.lit(0).cast("bigint"), "revenue": F.lit(0.0)})
    )
    return sold.unionByName(zeros)


def seb_cross(bookings: DataFrame) -> DataFrame:
    """Grid cells plus row, column and grand totals; intensity is set for selling cells only."""
    cube = _sales(bookings).cube("seb_type", "seb_country").agg(
        F.sum("orders").alias("orders"), F.sum("revenue").alias("revenue"), F.grouping_id().alias("level")
    )
    is_cell = F.col("level") == 0
    largest = F.max(F.when(is_cell, F.col("revenue"))).over(Window.partitionBy())
    shade = F.when(is_cell & (F.col("revenue") > 0), F.sqrt(F.col("revenue") / F.col("largest")))
    return cube.withColumn("largest", largest).select(
        F.coalesce("seb_type", F.lit(TOTAL)).alias("seb_type"),
        F.coalesce("seb_country", F.lit(TOTAL)).alias("seb_country"),
        "orders", "revenue", shade.alias("intensity"),
    )


def seb_cross_pivot(bookings: DataFrame) -> DataFrame:
    """One row per type and a total row, revenue and orders per country and in total."""
    table = (
        seb_cross(bookings)
        .groupBy("seb_type")
        .pivot("seb_country", [*COUNTRY_COLUMNS, TOTAL])
        .agg(F.sum("revenue").alias("revenue"), F.sum("orders").alias("orders"))
    )
    names = {**COUNTRY_COLUMNS, TOTAL: "total"}
    return table.select(
        "seb_type",
        *[
            F.col(f"`{label}_{measure}`").alias(f"{name}_{measure}")
            for measure in ("revenue", "orders")
            for label, name in names.items()
        ],
    )


def seb_type_order(bookings: DataFrame) -> DataFrame:
    """Types with their place by revenue and by orders (five rows in the windows)."""
    totals = _sales(bookings).groupBy("seb_type").agg(
        F.sum("revenue").alias("revenue"), F.sum("orders").alias("orders")
    )

    def place(measure: str):
        return F.row_number().over(Window.orderBy(F.desc(measure), "seb_type"))

    return totals.withColumns({"by_revenue": place("revenue"), "by_orders": place("orders")}).orderBy("by_revenue")
