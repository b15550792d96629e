"""Whole report pages: a page is a dict of named DataFrames, nothing runs until one of them is used.

Pages take bookings flagged by ``flag_periods`` and filtered; single-period tables read the current span.  All tables of a page come from
one condensed table, a few groupings of the bookings made in one pass, which is cached when the first table runs: a page reads its
bookings once.  ``release`` (or leaving a ``with`` block) gives the cache up.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayledger.functions import rules
from wayledger.functions.calendar import lead_days, month_start
from wayledger.operators import trends
from wayledger.operators.filters import search, stay_view
from wayledger.operators.measures import condense
from wayledger.operators.periods import Period
from wayledger.operators.ranking import product_rank
from wayledger.plans import channels, cruise, insights, lines, orders, overview, sports, stays, tours, traffic


class Page(dict[str, DataFrame]):
    """Tables by name, over one shared table."""

    def __init__(self, shared: DataFrame | None, **tables: DataFrame):
        super().__init__(tables)
        self.shared = shared

    def release(self) -> None:
        if self.shared is not None:
            self.shared.unpersist()

    def __enter__(self) -> Page:
        return self

    def __exit__(self, *_) -> None:
        self.release()


def _shared(flagged: DataFrame, *groupings: Sequence[str]) -> list[DataFrame]:
    """The cached condensed table, and its rows of each grouping."""
    table = condense(flagged, *groupings).persist(StorageLevel.MEMORY_AND_DISK)
    return [table, *(table.filter(F.col("grouping") == place) for place in range(len(groupings)))]


def _by_month(flagged: DataFrame) -> DataFrame:
    """Travel dates cut to their month, all that a page shows of them."""
    return flagged.withColumn("check_in", month_start(F.col("check_in")).cast("timestamp_ntz"))


def _current(flagged: DataFrame) -> DataFrame:
    return flagged.filter("is_cur")


def overview_page(
    flagged: DataFrame, holidays: DataFrame, period: Period, freq: str = "D", bar_freq: str = "W",
    averages: Sequence[int] = (5, 10, 20, 60),
) -> Page:
    by_day = flagged.withColumn("order_date", F.col("order_date").cast("date").cast("timestamp_ntz"))
    shared, days, products = _shared(by_day, ["order_date", "product_line"], ["bnb_name", "product_line"])
    current = _current(days)
    return Page(
        shared,
        kpis=overview.kpi_overview(days),
        lines=overview.product_line_share(current),
        trend=trends.revenue_trend(current, freq),
        holidays=trends.holiday_clusters(holidays, period.start, period.end),
        bars=trends.moving_averages(trends.gmv_ohlc(current, bar_freq), averages),
        detail=overview.product_line_detail(days),
        top_products=overview.top_products(_current(products)),
    )


def cruise_page(
    flagged: DataFrame, cruise_type: str, rank_ships: Sequence[str] = (), length_ships: Sequence[str] = ()
) -> Page:
    """Homeport or fly cruises; one picker narrows the rankings, another the trip-length table."""
    with_lead = lines.of_line(flagged, "Cruise").withColumn(cruise.LEAD, lead_days(F.col("order_date"), F.col("check_in")))
    shared, trips, leads = _shared(
        _by_month(with_lead),
        ["product_line", "cruise_type", "bnb_id", "bnb_name", "nights", "check_in"],
        ["product_line", "cruise_type", cruise.LEAD],
    )
    of_type = cruise.of_type(_current(trips), cruise_type)
    page = Page(
        shared,
        kpis=cruise.kpi_cruise(trips),
        month_brand=cruise.month_brand(of_type),
        ships=cruise.ship_table(trips, cruise_type),
        ship_picker=cruise.ship_picker(trips, cruise_type),
        rank_orders=cruise.cruise_rank(trips, cruise_type, "orders", rank_ships),
        rank_growth=cruise.cruise_rank(trips, cruise_type, "growth", rank_ships),
        destinations=cruise.destination_compare(trips, cruise_type),
        lead_times=cruise.lead_time_histogram(_current(leads), cruise_type),
        lead_stats=cruise.lead_time_stats(_current(leads), cruise_type),
    )
    if cruise_type == rules.HOMEPORT:
        page["brand_days"] = cruise.brand_days(_current(trips), cruise_type)
        page["trip_lengths"] = cruise.trip_length_compare(trips, cruise_type, length_ships)
    else:
        page["top_products"] = lines.line_top_products(of_type, "Cruise")
        page["nights"] = cruise.nights_distribution(of_type)
    return page


def tours_page(flagged: DataFrame, regions: Sequence[str] = ()) -> Page:
    shared, sold = _shared(_by_month(lines.of_line(flagged, tours.LINE)), ["product_line", "bnb_id", "bnb_name", "check_in"])
    return Page(
        shared,
        kpis=overview.kpi_overview(sold),
        regions=tours.region_distribution(_current(sold)),
        months=lines.checkin_monthly(_current(sold), tours.LINE),
        region_picker=tours.region_picker(sold),
        rank_orders=tours.tour_rank(sold, "orders", regions),
        rank_growth=tours.tour_rank(sold, "growth", regions),
    )


def stays_page(flagged: DataFrame, line: str, view: str = rules.STAY_VIEW_ALL) -> Page:
    """One market or camping under one view; type shares for Taiwan, one brand's hotels for Japan."""
    viewed = stay_view(lines.of_line(flagged, line), view)
    shared, sold = _shared(_by_month(viewed), ["product_line", "bnb_type", "bnb_city", "bnb_id", "bnb_name", "check_in"])
    current = _current(sold)
    page = Page(
        shared,
        kpis=overview.kpi_overview(sold),
        regions_by_revenue=stays.region_revenue_top(current, line),
        regions_by_aov=stays.region_aov_top(current, line),
        months=lines.checkin_monthly(current, line),
        rank_orders=stays.stay_rank(sold, line, "orders", view),
        rank_growth=stays.stay_rank(sold, line, "growth", view),
    )
    if line == "TW" and view != rules.STAY_VIEW_WHOLE:
        page["types"] = lines.line_type_share(current, line, several=True)
    if line == "JP" and view != rules.STAY_VIEW_WHOLE:
        page["hoshino"] = stays.hoshino_orders(current, line)
    return page


def line_page(flagged: DataFrame, line: str, has_travel_date: bool = True, has_types: bool = True) -> Page:
    """Rail, eSIM, day tours, sports: lines without a travel date show platforms instead of months; ``has_types`` adds the share of
    types where there is more than one."""
    products = ["product_line", "bnb_type", "seb_type", "seb_country", "bnb_id", "bnb_name", "check_in"]
    shared, sold, platforms = _shared(_by_month(lines.of_line(flagged, line)), products, ["product_line", "platform"])
    current = _current(sold)
    page = Page(
        shared,
        kpis=overview.kpi_overview(sold),
        top_products=lines.line_top_products(current, line),
        rank_orders=product_rank(sold, "orders"),
        rank_growth=product_rank(sold, "growth"),
    )
    if has_types:
        page["types"] = lines.line_type_share(current, line, several=True)
    if has_travel_date:
        page["months"] = lines.checkin_monthly(current, line)
    else:
        page["platforms"] = lines.platform_share(_current(platforms), line)
    if line == "SEB":
        page["cross"] = sports.seb_cross(current)
        page["cross_table"] = sports.seb_cross_pivot(current)
        page["type_order"] = sports.seb_type_order(current)
    return page


def sports_page(flagged: DataFrame) -> Page:
    return line_page(flagged, "SEB", has_types=False)


def channels_page(flagged: DataFrame) -> Page:
    shared, sold = _shared(flagged, ["affiliate_id", "product_line"])
    return Page(
        shared,
        compare=channels.channel_compare(sold),
        by_line=channels.marketing_channel(_current(sold)),
        pivot=channels.channel_line_pivot(_current(sold)),
    )


def search_page(flagged: DataFrame, keyword: str = "", product_lines: Sequence[str] = (), literal: bool = False) -> Page:
    """The bookings found, and their totals; the bookings found are what is shared."""
    found = search(_current(flagged), keyword, product_lines, literal).select(*orders.ORDER_COLUMNS)
    found = found.persist(StorageLevel.MEMORY_AND_DISK)
    return Page(found, totals=orders.order_totals(found), orders=orders.order_list(found))


def traffic_page(weeks: DataFrame, channel_weeks: DataFrame, as_of: date, window: str = "近12週") -> Page:
    """Weekly users and channels; booking filters do not apply."""
    shown = traffic.last_weeks(weeks, traffic.WINDOWS[window])
    windowed = traffic.channel_window(channel_weeks, shown)
    return Page(
        None,
        kpis=traffic.wau_kpi(shown, as_of),
        weeks=shown.orderBy("week_start", "yearweek"),
        channel_weeks=windowed,
        channel_order=traffic.channel_order(windowed),
        channel_kpis=traffic.channel_kpi(windowed, as_of),
    )


def insights_page(flagged: DataFrame, period: Period, as_of: date) -> Page:
    entries = insights.insights(flagged, period, as_of).persist(StorageLevel.MEMORY_AND_DISK)
    return Page(entries, lines=entries, report=insights.insight_report(entries))


def stacked(page: Page) -> DataFrame:
    """All tables of a page as one: a row for each number, with its table, the texts and dates of its row, and its column."""
    parts = []
    for name, table in page.items():
        numbers = [c for c, kind in table.dtypes if kind in ("int", "bigint", "double")]
        texts = [F.col(c).cast("string") for c, _ in table.dtypes if c not in numbers]
        row = table.select(F.concat_ws(" | ", *texts).alias("subject"), *[F.col(c).cast("double").alias(c) for c in numbers])
        if not numbers:
            row, numbers = row.withColumn("rows", F.lit(1.0)), ["rows"]
        parts.append(row.unpivot("subject", numbers, "measure", "value").select(F.lit(name).alias("section"), "subject", "measure", "value"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
