"""Cruise page: brands, ships, destinations, lead times; homeport and fly cruises."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayledger.functions import classify as C
from wayledger.functions import rules
from wayledger.functions.calendar import lead_days, travel_month
from wayledger.operators.drivers import ship_compare
from wayledger.operators.measures import COMPARED, change_pct, compare, compared, counted, differences, orders, regroup, revenue, summarize, weight
from wayledger.operators.ranking import product_rank, top
from wayledger.plans.lines import of_line

#: Column of a condensed table with the days from order to travel.
LEAD = "lead"
SHIP_OF: dict[str, Callable[[Column], Column]] = {
    rules.HOMEPORT: C.homeport_ship,
    rules.FLY_CRUISE: C.cruise_ship,
}


def of_type(bookings: DataFrame, cruise_type: str) -> DataFrame:
    """Cruise bookings of one type (other lines carry an empty type)."""
    return of_line(bookings, "Cruise").filter(F.col("cruise_type") == cruise_type)


def trip_length(cruise_type: str) -> Column:
    """Homeport trips are sold by days (nights + 1), fly cruises by nights."""
    if cruise_type == rules.HOMEPORT:
        return F.concat((F.col("nights") + 1).cast("string"), F.lit(" 天"))
    return F.concat(F.col("nights").cast("string"), F.lit(" 晚"))


def kpi_cruise(flagged: DataFrame) -> DataFrame:
    """Figures for all cruises and for each type, with mean order value and mean nights."""
    nights = F.col("nights") * weight(flagged)
    by_type = of_line(flagged, "Cruise").groupBy("cruise_type").agg(
        *compared(flagged), F.sum(F.when(F.col("is_cur"), nights)).alias("nights")
    )
    table = by_type.rollup("cruise_type").agg(*[F.sum(m).alias(m) for m in (*COMPARED, "nights")])
    scope = F.coalesce("cruise_type", F.lit("Cruise"))
    aov = F.coalesce(F.try_divide("revenue", "orders"), F.lit(0.0))
    prev_aov = F.coalesce(F.try_divide("prev_revenue", "prev_orders"), F.lit(0.0))
    return table.filter(F.col("orders") > 0).select(
        scope.alias("scope"),
        "revenue", "prev_revenue", change_pct(F.col("revenue"), F.col("prev_revenue")).alias("revenue_pct"),
        "orders", "prev_orders", change_pct(F.col("orders"), F.col("prev_orders")).alias("orders_pct"),
        aov.alias("aov"), prev_aov.alias("prev_aov"), change_pct(aov, prev_aov).alias("aov_pct"),
        F.try_divide("nights", "orders").alias("avg_nights"),
    ).orderBy("scope")


def cruise_type_summary(bookings: DataFrame) -> DataFrame:
    return summarize(of_line(bookings, "Cruise"), "cruise_type").orderBy(F.desc("revenue"), "cruise_type")


def cruise_by_brand(bookings: DataFrame) -> DataFrame:
    products = summarize(of_line(bookings, "Cruise"), "bnb_name", "cruise_type")
    return regroup(products, {"brand": C.cruise_brand(F.col("bnb_name"))}, "cruise_type").select(
        "brand", "cruise_type", "orders", "revenue"
    ).orderBy("brand", "cruise_type")


def ship_summary(bookings: DataFrame, cruise_type: str) -> DataFrame:
    """Orders and revenue per ship, named by the rule of the cruise type."""
    products = summarize(of_type(bookings, cruise_type), "bnb_name")
    return regroup(products, {"ship": SHIP_OF[cruise_type](F.col("bnb_name"))}).orderBy(F.desc("revenue"), "ship")


def cruise_checkin_distribution(bookings: DataFrame) -> DataFrame:
    months = of_line(bookings, "Cruise").withColumn("check_in_month", travel_month(F.col("check_in")))
    return summarize(months, "check_in_month", "cruise_type").orderBy("check_in_month", "cruise_type")


def nights_distribution(bookings: DataFrame) -> DataFrame:
    return of_line(bookings, "Cruise").groupBy("nights").agg(orders(bookings)).orderBy("nights")


def brand_days(bookings: DataFrame, cruise_type: str = rules.HOMEPORT) -> DataFrame:
    products = of_type(bookings, cruise_type).groupBy("bnb_name", "nights").agg(revenue())
    return regroup(products, {"brand": C.cruise_brand(F.col("bnb_name")), "days": trip_length(cruise_type)}).orderBy("brand", "days")


def month_brand(bookings: DataFrame) -> DataFrame:
    """Orders per cruise type, travel month and brand."""
    months = of_line(bookings, "Cruise").withColumn("check_in_month", travel_month(F.col("check_in")))
    products = months.groupBy("cruise_type", "check_in_month", "bnb_name").agg(orders(bookings))
    return regroup(products, {"brand": C.cruise_brand(F.col("bnb_name"))}, "cruise_type", "check_in_month").select(
        "cruise_type", "check_in_month", "brand", "orders"
    ).orderBy("cruise_type", "check_in_month", "brand")


def _cells(flagged: DataFrame, cruise_type: str) -> DataFrame:
    """Compared orders at (brand, ship, length, month), keeping what vanished."""
    trips = of_type(flagged, cruise_type).withColumns(
        {"length": trip_length(cruise_type), "month": travel_month(F.col("check_in"))}
    )
    products = trips.groupBy("bnb_name", "length", "month").agg(
        counted(trips, "is_cur").alias("orders"), counted(trips, "is_prev").alias("prev_orders")
    )
    labels = {"brand": C.cruise_brand(F.col("bnb_name")), "ship": SHIP_OF[cruise_type](F.col("bnb_name"))}
    return regroup(products, labels, "length", "month")


def ship_table(flagged: DataFrame, cruise_type: str) -> DataFrame:
    """Ships now and before with the main driver of the change."""
    dim = "天數" if cruise_type == rules.HOMEPORT else "晚數"
    return ship_compare(_cells(flagged, cruise_type), dim)


def trip_length_compare(flagged: DataFrame, cruise_type: str = rules.HOMEPORT, ships: Sequence[str] = ()) -> DataFrame:
    """Orders per trip length now and before, in order of length; optionally for some ships only."""
    cells = _cells(flagged, cruise_type)
    if ships:
        cells = cells.filter(F.col("ship").isin(list(ships)))
    table = cells.groupBy(F.col("length").alias("days")).agg(
        F.sum("orders").alias("orders"), F.sum("prev_orders").alias("prev_orders")
    )
    return differences(table).orderBy(F.regexp_extract("days", "([0-9]+)", 1).cast("int"), "days")


def ship_picker(flagged: DataFrame, cruise_type: str) -> DataFrame:
    """Ships of either period, each with the orders it had in both; one pass.

    The trip-length table offers all of them, the rankings those with current orders."""
    products = of_type(flagged, cruise_type).groupBy("bnb_name").agg(
        counted(flagged, "is_cur").alias("orders"), counted(flagged, "is_prev").alias("prev_orders")
    )
    return regroup(products, {"ship": SHIP_OF[cruise_type](F.col("bnb_name"))}).orderBy("ship")


def ship_options(bookings: DataFrame, cruise_type: str) -> DataFrame:
    names = of_type(bookings, cruise_type).select("bnb_name").distinct()
    return names.select(SHIP_OF[cruise_type](F.col("bnb_name")).alias("ship")).distinct().orderBy("ship")


def cruise_rank(flagged: DataFrame, cruise_type: str, by: str = "orders", ships: Sequence[str] = ()) -> DataFrame:
    """Product ranking of one cruise type; the ship picker applies to both periods."""
    trips = of_type(flagged, cruise_type)
    if ships:
        trips = trips.filter(SHIP_OF[cruise_type](F.col("bnb_name")).isin(list(ships)))
    return product_rank(trips, by)


def _mentions(products: DataFrame) -> DataFrame:
    """One row per product and destination it names."""
    return products.withColumn("destination", F.explode(C.cruise_destinations(F.col("bnb_name"))))


def destination_heat(bookings: DataFrame, n: int = 20) -> DataFrame:
    """Orders and revenue per destination; a trip with several stops counts for each."""
    products = summarize(of_line(bookings, "Cruise"), "bnb_name")
    table = regroup(_mentions(products), {}, "destination")
    return top(table, "orders", n, ["destination"])


def destination_compare(flagged: DataFrame, cruise_type: str, n: int = 15) -> DataFrame:
    """Destinations by current orders against the previous period; empty when nothing sold now.

    The window covers one row per destination keyword.
    """
    products = compare(of_type(flagged, cruise_type), "bnb_name", keep_vanished=True)
    heat = differences(regroup(_mentions(products), {}, "destination").drop("revenue", "prev_revenue"))
    sold = heat.withColumn("_best", F.max("orders").over(Window.partitionBy())).filter("_best > 0").drop("_best")
    return top(sold, "orders", n, ["destination"])


def _leads(bookings: DataFrame, cruise_type: str) -> DataFrame:
    """Orders per lead time in days: a few hundred rows whatever the number of bookings."""
    trips = of_type(bookings, cruise_type)
    if LEAD not in bookings.columns:
        trips = trips.select(lead_days(F.col("order_date"), F.col("check_in")).alias(LEAD))
    return trips.filter(F.col(LEAD).isNotNull()).groupBy(F.col(LEAD).alias("lead")).agg(orders(trips))


def lead_time_histogram(bookings: DataFrame, cruise_type: str = rules.HOMEPORT) -> DataFrame:
    """Orders per lead-time bin; all bins appear, also empty ones."""
    leads = _leads(bookings, cruise_type)
    edges = list(zip(rules.LEAD_TIME_EDGES, rules.LEAD_TIME_EDGES[1:]))
    counts = [
        F.coalesce(
            F.sum(F.when((F.col("lead") > low) & (F.col("lead") <= high), F.col("orders"))),
            F.lit(0).cast("bigint"),
        ).alias(f"bin{number}")
        for number, (low, high) in enumerate(edges)
    ]
    bins = F.array(
        *[
            F.struct(F.lit(number).alias("bin_no"), F.lit(label).alias("lead_bin"), F.col(f"bin{number}").alias("orders"))
            for number, label in enumerate(rules.LEAD_TIME_LABELS)
        ]
    )
    return leads.agg(*counts).select(F.inline(bins))


def lead_time_stats(bookings: DataFrame, cruise_type: str = rules.HOMEPORT) -> DataFrame:
    """Exact interpolated median, mean, and the median in 30-day months."""
    stats = _leads(bookings, cruise_type).agg(
        F.percentile("lead", 0.5, F.col("orders")).alias("median_days"),
        F.try_divide(F.sum(F.col("lead") * F.col("orders")), F.sum("orders")).alias("mean_days"),
    )
    return stats.withColumn("median_months", F.col("median_days") / 30)
