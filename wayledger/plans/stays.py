"""Stays and camping page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayledger.functions import classify as C
from wayledger.functions import rules
from wayledger.operators.filters import stay_view
from wayledger.operators.measures import regroup, revenue, orders, summarize
from wayledger.operators.ranking import product_rank, top
from wayledger.plans.lines import of_line

MARKETS = ["TW", "KR", "JP"]


def region_stats(bookings: DataFrame, line: str, view: str = rules.STAY_VIEW_ALL) -> DataFrame:
    """Orders, revenue and average order value per place; Taiwanese cities by their county name."""
    cities = summarize(stay_view(of_line(bookings, line), view), "bnb_city")
    place = F.col("bnb_city")
    if line == "TW":
        place = F.coalesce(C.county(place), place)
    aov = F.rint(F.try_divide("revenue", "orders"))
    return regroup(cities, {"region": place}).withColumn("aov", aov).orderBy(F.desc("revenue"), "region")


def region_revenue_top(bookings: DataFrame, line: str, n: int = 20) -> DataFrame:
    return top(region_stats(bookings, line), "revenue", n, ["region"])


def region_aov_top(bookings: DataFrame, line: str, n: int = 20, min_orders: int = 5) -> DataFrame:
    """Places by average order value among those with enough orders, or among all if none has.

    The flag comes from a window over one row per place.
    """
    stats = region_stats(bookings, line)
    most = F.max("orders").over(Window.partitionBy())
    eligible = (F.col("orders") >= min_orders) | (F.col("_most") < min_orders)
    return top(stats.withColumn("_most", most).filter(eligible).drop("_most"), "aov", n, ["region"])


def accommodation_region(bookings: DataFrame, line: str, n: int = 20) -> DataFrame:
    return top(summarize(of_line(bookings, line), "bnb_city"), "revenue", n, ["bnb_city"])


def county_map(bookings: DataFrame) -> DataFrame:
    """Orders and revenue per county; cities outside the county table are left out."""
    cities = summarize(of_line(bookings, "TW"), "bnb_city").withColumn("county", C.county(F.col("bnb_city")))
    return regroup(cities.filter(F.col("county").isNotNull()), {}, "county").orderBy("county")


def view_split(bookings: DataFrame) -> DataFrame:
    """Orders and revenue of each market under the three views, from one pass over the bookings."""
    whole = F.col("bnb_type").eqNullSafe(F.lit(rules.WHOLE_UNIT_TYPE))
    halves = (
        bookings.filter(F.col("product_line").isin(MARKETS))
        .groupBy("product_line", whole.alias("is_whole"))
        .agg(orders(bookings), revenue())
    )
    own = F.when(F.col("is_whole"), rules.STAY_VIEW_WHOLE).otherwise(rules.STAY_VIEW_ROOMS)
    views = halves.withColumn("view", F.explode(F.array(F.lit(rules.STAY_VIEW_ALL), own)))
    return regroup(views, {}, "product_line", "view").orderBy("product_line", "view")


def hoshino_orders(bookings: DataFrame, line: str = "JP") -> DataFrame:
    brand = of_line(bookings, line).filter(C.is_hoshino(F.col("bnb_name")))
    return summarize(brand, "bnb_name").orderBy(F.desc("revenue"), "bnb_name")


def stay_rank(flagged: DataFrame, line: str, by: str = "orders", view: str = rules.STAY_VIEW_ALL) -> DataFrame:
    return product_rank(stay_view(of_line(flagged, line), view), by, with_city=True)
