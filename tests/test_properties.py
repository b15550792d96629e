"""Totals that must agree with each other on the small test tables."""

import pytest
from pyspark.sql import functions as F

from wayledger.functions import rules
from wayledger.operators import trends
from wayledger.plans import channels, cruise, overview, sports
from wayledger.plans import registry as R


@pytest.fixture(scope="module")
def booked(spark, small):
    table = R.booked(spark, small).cache()
    yield table
    table.unpersist()


def total(table, column="revenue"):
    return table.agg(F.sum(column)).first()[0]


def test_lines_add_up(booked):
    lines = overview.product_line_summary(booked)
    assert total(lines) == total(booked, "twd_amount")
    assert total(lines, "orders") == booked.count()


@pytest.mark.parametrize("freq", trends.FREQUENCIES)
def test_trend_keeps_all_dated_revenue(booked, freq):
    assert total(trends.revenue_trend(booked, freq)) == total(booked.filter("order_date IS NOT NULL"), "twd_amount")


def test_pivot_holds_all_revenue(booked):
    pivot = channels.channel_line_pivot(booked)
    cells = sum((F.col(c) for c in channels.LINE_COLUMNS.values()), F.lit(0.0))
    assert pivot.agg(F.sum(cells)).first()[0] == total(booked, "twd_amount")


def test_cross_table_totals(booked):
    table = sports.seb_cross(booked).collect()
    grand = [r for r in table if r.seb_type == r.seb_country == sports.TOTAL]
    assert len(table) == 30 and len(grand) == 1
    assert grand[0].orders == booked.filter("product_line = 'SEB'").count()
    assert grand[0].revenue == sum(r.revenue for r in table if sports.TOTAL not in (r.seb_type, r.seb_country))


def test_lead_time_bins_hold_every_valid_lead(booked):
    for kind in (rules.HOMEPORT, rules.FLY_CRUISE):
        valid = cruise.of_type(booked, kind).filter("check_in >= order_date").count()
        assert total(cruise.lead_time_histogram(booked, kind), "orders") == valid


def test_halves_cover_every_dated_booking(spark, small, booked):
    flagged = R.flagged(spark, small)
    assert flagged.count() == booked.filter("order_date IS NOT NULL").count()
    assert flagged.filter("is_cur AND is_prev").isEmpty()
