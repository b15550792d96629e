"""Group-tour page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayledger.functions import classify as C
from wayledger.operators.measures import counted, regroup, share_pct, summarize
from wayledger.operators.ranking import product_rank
from wayledger.plans.lines import of_line

LINE = "GIT"


def region_distribution(bookings: DataFrame) -> DataFrame:
    """Orders, revenue and share of revenue per destination region."""
    products = summarize(of_line(bookings, LINE), "bnb_name")
    regions = regroup(products, {"region": C.tour_region(F.col("bnb_name"))})
    total = F.sum("revenue").over(Window.partitionBy())
    return regions.withColumn("share_pct", share_pct(F.col("revenue"), total)).orderBy(F.desc("revenue"), "region")


def region_options(bookings: DataFrame) -> DataFrame:
    names = of_line(bookings, LINE).select("bnb_name").distinct()
    return names.select(C.tour_region(F.col("bnb_name")).alias("region")).distinct().orderBy("region")


def region_picker(flagged: DataFrame) -> DataFrame:
    """Regions of either period, each with the orders it had in both; one pass."""
    products = of_line(flagged, LINE).groupBy("bnb_name").agg(
        counted(flagged, "is_cur").alias("orders"), counted(flagged, "is_prev").alias("prev_orders")
    )
    return regroup(products, {"region": C.tour_region(F.col("bnb_name"))}).orderBy("region")


def tour_rank(flagged: DataFrame, by: str = "orders", regions: Sequence[str] = ()) -> DataFrame:
    """Product ranking with the region; the region picker applies to both periods."""
    tours = of_line(flagged, LINE)
    if regions:
        tours = tours.filter(C.tour_region(F.col("bnb_name")).isin(list(regions)))
    return product_rank(tours, by, labels={"region": C.tour_region(F.col("bnb_name"))})
