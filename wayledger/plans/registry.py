"""Every report as a query over the test tables: ``name -> (spark, sf_dir) -> DataFrame``.

Compare queries split the whole order history into a current and a previous half, so they too read
every booking; the last-90-days preset is exercised by its own entries.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayledger.functions import rules
from wayledger.operators import filters, periods, trends
from wayledger.operators.clean import clean_bookings
from wayledger.operators.filters import filter_bookings
from wayledger.operators.periods import Period, flag_periods
from wayledger.operators.ranking import product_rank
from wayledger.plans import channels, cruise, insights, lines, orders, overview, pages, sports, stays, tours, traffic
from wayledger.sources import testdata
from wayledger.sources.traffic import weekly_channel_users, weekly_users

AS_OF = date(2001, 8, 1)
HALVES = Period.before(date(1998, 4, 17), date(2001, 8, 1))
LAST_90 = Period.before(date(2001, 5, 4), date(2001, 8, 1))
HOLIDAY_SPAN = (date(1995, 6, 1), date(2001, 8, 1))
SEARCH_WORD = "沖繩|OKINAWA|^7-"
SEARCH_LINES = ["Cruise", "GIT", "JP", "其他"]
FILTER_LINES = ["Cruise", "GIT", "TW", "SEB"]
FILTER_CHANNELS = [rules.DIRECT_CHANNEL, "aff_6", "aff_8"]
FILTER_STATUSES = ["completed", "confirmed"]
WAU_ROWS = 52
RANK_SHIPS = ["莎倫娜號", "海洋富士號"]
LENGTH_SHIPS = ["地中海榮耀號"]
PICKED_REGIONS = ["北海道", "越南"]

Query = Callable[[SparkSession, str], DataFrame]


def iso(table: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text, so that two engines can be compared byte for byte."""
    return table.withColumns(
        {name: F.col(name).cast("string") for name, kind in table.dtypes if kind in ("date", "timestamp_ntz")}
    )


def every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clean bookings."""
    return clean_bookings(testdata.raw_bookings(spark, sf_dir))


def booked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean bookings under the default filters: all dates, every known status."""
    return filter_bookings(every(spark, sf_dir))


def flagged(spark: SparkSession, sf_dir: str, period: Period = HALVES) -> DataFrame:
    """Clean bookings of both spans under the default filters; the source is pruned to their dates."""
    raw = testdata.raw_bookings(spark, sf_dir, period.first, period.last)
    return filter_bookings(flag_periods(clean_bookings(raw), period))


def _weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly_users(testdata.raw_wau(spark, sf_dir))


def _channel_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly_channel_users(testdata.raw_channel_users(spark, sf_dir))


def _shown_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.channel_window(_channel_weeks(spark, sf_dir), traffic.last_weeks(_weeks(spark, sf_dir), WAU_ROWS))


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.search(booked(spark, sf_dir), SEARCH_WORD, SEARCH_LINES)



QUERIES: dict[str, Query] = {
    # cleaning, options and filters
    "clean_bookings": lambda s, d: iso(every(s, d)),
    "period_bounds": lambda s, d: iso(periods.period_bounds(every(s, d), AS_OF)),
    "affiliate_options": lambda s, d: filters.channel_options(every(s, d)),
    "status_options": lambda s, d: filters.status_options(every(s, d)),
    "filtered_bookings": lambda s, d: iso(
        filter_bookings(
            every(s, d), date(1996, 1, 1), date(2001, 6, 30), FILTER_LINES, FILTER_STATUSES, FILTER_CHANNELS
        ).select(*orders.ORDER_COLUMNS)
    ),
    # overview
    "kpi_overview": lambda s, d: overview.kpi_overview(flagged(s, d)),
    "kpi_overview_90d": lambda s, d: overview.kpi_overview(flagged(s, d, LAST_90)),
    "kpi_by_line": lambda s, d: overview.kpi_by_line(flagged(s, d)),
    "product_line_summary": lambda s, d: overview.product_line_summary(booked(s, d)),
    "product_line_share": lambda s, d: overview.product_line_share(booked(s, d)),
    "product_line_detail": lambda s, d: overview.product_line_detail(flagged(s, d)),
    "product_line_detail_90d": lambda s, d: overview.product_line_detail(flagged(s, d, LAST_90)),
    "top_products": lambda s, d: overview.top_products(booked(s, d)),
    "revenue_trend_day": lambda s, d: iso(trends.revenue_trend(booked(s, d), "D")),
    "revenue_trend_week": lambda s, d: iso(trends.revenue_trend(booked(s, d), "W")),
    "revenue_trend_month": lambda s, d: iso(trends.revenue_trend(booked(s, d), "M")),
    "gmv_ohlc_week": lambda s, d: iso(trends.gmv_ohlc(booked(s, d), "W")),
    "gmv_ohlc_month": lambda s, d: iso(trends.gmv_ohlc(booked(s, d), "M")),
    "gmv_ohlc_ma": lambda s, d: iso(trends.moving_averages(trends.gmv_ohlc(booked(s, d), "W"))),
    "holiday_clusters": lambda s, d: iso(trends.holiday_clusters(testdata.holidays(s, d), *HOLIDAY_SPAN)),
    # cruises
    "kpi_cruise": lambda s, d: cruise.kpi_cruise(flagged(s, d)),
    "cruise_type_summary": lambda s, d: cruise.cruise_type_summary(booked(s, d)),
    "cruise_by_brand": lambda s, d: cruise.cruise_by_brand(booked(s, d)),
    "cruise_ship_summary": lambda s, d: cruise.ship_summary(booked(s, d), rules.FLY_CRUISE),
    "homeport_ship_summary": lambda s, d: cruise.ship_summary(booked(s, d), rules.HOMEPORT),
    "cruise_checkin_distribution": lambda s, d: cruise.cruise_checkin_distribution(booked(s, d)),
    "cruise_nights_distribution": lambda s, d: cruise.nights_distribution(booked(s, d)),
    "homeport_brand_days": lambda s, d: cruise.brand_days(booked(s, d)),
    "cruise_month_brand": lambda s, d: cruise.month_brand(booked(s, d)),
    "homeport_ship_compare": lambda s, d: cruise.ship_table(flagged(s, d), rules.HOMEPORT),
    "fly_ship_compare": lambda s, d: cruise.ship_table(flagged(s, d), rules.FLY_CRUISE),
    "homeport_days_compare": lambda s, d: cruise.trip_length_compare(flagged(s, d)),
    "homeport_rank_orders": lambda s, d: cruise.cruise_rank(flagged(s, d), rules.HOMEPORT, "orders"),
    "fly_rank_growth": lambda s, d: cruise.cruise_rank(flagged(s, d), rules.FLY_CRUISE, "growth"),
    "homeport_ship_options": lambda s, d: cruise.ship_options(booked(s, d), rules.HOMEPORT),
    "cruise_destination_heat": lambda s, d: cruise.destination_heat(booked(s, d)),
    "dest_heat_compare": lambda s, d: cruise.destination_compare(flagged(s, d), rules.FLY_CRUISE),
    "homeport_dest_heat_compare": lambda s, d: cruise.destination_compare(flagged(s, d), rules.HOMEPORT),
    "lead_time_histogram": lambda s, d: cruise.lead_time_histogram(booked(s, d)),
    "lead_time_stats": lambda s, d: cruise.lead_time_stats(booked(s, d)),
    "fly_lead_time_histogram": lambda s, d: cruise.lead_time_histogram(booked(s, d), rules.FLY_CRUISE),
    "fly_lead_time_stats": lambda s, d: cruise.lead_time_stats(booked(s, d), rules.FLY_CRUISE),
    # group tours
    "git_region_distribution": lambda s, d: tours.region_distribution(booked(s, d)),
    "git_top_products": lambda s, d: lines.line_top_products(booked(s, d), "GIT"),
    "git_region_options": lambda s, d: tours.region_options(booked(s, d)),
    "git_rank_orders": lambda s, d: tours.tour_rank(flagged(s, d), "orders"),
    "git_rank_growth": lambda s, d: tours.tour_rank(flagged(s, d), "growth"),
    # stays and camping
    "stay_region_stats": lambda s, d: stays.region_stats(booked(s, d), "TW"),
    "stay_region_revenue_top": lambda s, d: stays.region_revenue_top(booked(s, d), "TW"),
    "stay_region_aov_top": lambda s, d: stays.region_aov_top(booked(s, d), "JP"),
    "accommodation_region": lambda s, d: stays.accommodation_region(booked(s, d), "KR"),
    "tw_city_geo": lambda s, d: stays.county_map(booked(s, d)),
    "stay_view_split": lambda s, d: stays.view_split(booked(s, d)),
    "stay_type_share": lambda s, d: lines.line_type_share(booked(s, d), "TW"),
    "hoshino_orders": lambda s, d: stays.hoshino_orders(booked(s, d)),
    "stay_rank_orders": lambda s, d: stays.stay_rank(flagged(s, d), "JP", "orders"),
    "stay_rank_growth": lambda s, d: stays.stay_rank(flagged(s, d), "KR", "growth"),
    # sports
    "seb_type_summary": lambda s, d: sports.seb_type_summary(booked(s, d)),
    "seb_country_summary": lambda s, d: sports.seb_country_summary(booked(s, d)),
    "seb_cross": lambda s, d: sports.seb_cross(booked(s, d)),
    "seb_cross_pivot": lambda s, d: sports.seb_cross_pivot(booked(s, d)),
    "seb_type_order": lambda s, d: sports.seb_type_order(booked(s, d)),
    # any line
    "line_top_products": lambda s, d: lines.line_top_products(booked(s, d), "SEB"),
    "line_type_share": lambda s, d: lines.line_type_share(booked(s, d), "高鐵"),
    "checkin_monthly": lambda s, d: lines.checkin_monthly(booked(s, d), "GIT"),
    "platform_share": lambda s, d: lines.platform_share(booked(s, d), "eSIM"),
    "product_rank_orders": lambda s, d: product_rank(flagged(s, d), "orders"),
    "product_rank_growth": lambda s, d: product_rank(flagged(s, d), "growth"),
    # channels
    "marketing_channel": lambda s, d: channels.marketing_channel(booked(s, d)),
    "channel_summary": lambda s, d: channels.channel_summary(booked(s, d)),
    "channel_compare": lambda s, d: channels.channel_compare(flagged(s, d)),
    "channel_line_pivot": lambda s, d: channels.channel_line_pivot(booked(s, d)),
    # order search
    "order_search": lambda s, d: iso(orders.order_list(_searched(s, d))),
    "order_search_summary": lambda s, d: orders.order_totals(_searched(s, d)),
    # weekly users
    "wau_weekly": lambda s, d: iso(_weeks(s, d)),
    "wau_channel_weekly": lambda s, d: iso(_channel_weeks(s, d)),
    "wau_kpi": lambda s, d: iso(traffic.wau_kpi(traffic.last_weeks(_weeks(s, d), WAU_ROWS), AS_OF)),
    "wau_channel_window": lambda s, d: iso(_shown_channels(s, d)),
    "wau_channel_order": lambda s, d: traffic.channel_order(_shown_channels(s, d)),
    "wau_channel_kpi": lambda s, d: traffic.channel_kpi(_shown_channels(s, d), AS_OF),
    # pickers
    "homeport_ship_picker": lambda s, d: cruise.ship_picker(flagged(s, d), rules.HOMEPORT),
    "git_region_picker": lambda s, d: tours.region_picker(flagged(s, d)),
    "homeport_days_compare_picked": lambda s, d: cruise.trip_length_compare(flagged(s, d), rules.HOMEPORT, LENGTH_SHIPS),
    "homeport_rank_growth_picked": lambda s, d: cruise.cruise_rank(flagged(s, d), rules.HOMEPORT, "growth", RANK_SHIPS),
    "git_rank_growth_picked": lambda s, d: tours.tour_rank(flagged(s, d), "growth", PICKED_REGIONS),
    # whole pages, every number of every table
    "page_overview": lambda s, d: pages.stacked(pages.overview_page(flagged(s, d), testdata.holidays(s, d), HALVES)),
    "page_homeport": lambda s, d: pages.stacked(pages.cruise_page(flagged(s, d), rules.HOMEPORT, RANK_SHIPS, LENGTH_SHIPS)),
    "page_fly": lambda s, d: pages.stacked(pages.cruise_page(flagged(s, d), rules.FLY_CRUISE)),
    "page_tours": lambda s, d: pages.stacked(pages.tours_page(flagged(s, d), PICKED_REGIONS)),
    "page_stays_tw": lambda s, d: pages.stacked(pages.stays_page(flagged(s, d), "TW", rules.STAY_VIEW_ROOMS)),
    "page_stays_jp": lambda s, d: pages.stacked(pages.stays_page(flagged(s, d), "JP")),
    "page_sports": lambda s, d: pages.stacked(pages.sports_page(flagged(s, d))),
    "page_rail": lambda s, d: pages.stacked(pages.line_page(flagged(s, d), "高鐵")),
    "page_esim": lambda s, d: pages.stacked(pages.line_page(flagged(s, d), "eSIM", has_travel_date=False, has_types=False)),
    "page_channels": lambda s, d: pages.stacked(pages.channels_page(flagged(s, d))),
    "page_search": lambda s, d: pages.stacked(pages.search_page(flagged(s, d), SEARCH_WORD, SEARCH_LINES)),
    "page_traffic": lambda s, d: pages.stacked(pages.traffic_page(_weeks(s, d), _channel_weeks(s, d), AS_OF, "近52週")),
    # report
    "insights": lambda s, d: insights.insights(flagged(s, d), HALVES, AS_OF),
    "insights_90d": lambda s, d: insights.insights(flagged(s, d, LAST_90), LAST_90, AS_OF),
    "insight_report": lambda s, d: insights.insight_report(insights.insights(flagged(s, d), HALVES, AS_OF)),
}
