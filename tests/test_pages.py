"""Report pages: every table of every page computes from one scan, and pages agree with the single reports.

Each page's numbers are compared with SQL in test_oracle.py (``page_*``)."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from wayledger.functions import rules
from wayledger.operators.filters import filter_bookings
from wayledger.operators.measures import condense
from wayledger.operators.periods import Period, date_bounds, flag_periods, period_bounds
from wayledger.plans import pages
from wayledger.plans import registry as R
from wayledger.sources import testdata
from wayledger.sources.bookings import edge_months, read_clean, write_clean

WEEK = Period.before(date(2024, 3, 4), date(2024, 3, 10))


@pytest.fixture(scope="module")
def flagged(spark, small):
    table = R.flagged(spark, small).cache()
    yield table
    table.unpersist()


def rows(table):
    return table and table.collect()


def filled(page, may_be_empty=()):
    for name, table in page.items():
        assert table.columns, name
        if name not in may_be_empty:
            assert not table.isEmpty(), name
    return page


def test_overview(spark, small, flagged):
    page = filled(pages.overview_page(flagged, testdata.holidays(spark, small), R.HALVES))
    current = flagged.filter("is_cur").count()
    assert page["kpis"].first().orders == current
    assert page["lines"].agg(F.sum("orders")).first()[0] == current
    assert page["detail"].agg(F.sum("orders")).first()[0] == current


@pytest.mark.parametrize("kind", [rules.HOMEPORT, rules.FLY_CRUISE])
def test_cruise(flagged, kind):
    page = filled(pages.cruise_page(flagged, kind))
    ships = [r.ship for r in page["ship_picker"].collect() if r.orders]
    narrowed = pages.cruise_page(flagged, kind, rank_ships=ships[:1])
    assert not narrowed["rank_growth"].isEmpty()
    assert rows(narrowed.get("trip_lengths")) == rows(page.get("trip_lengths"))
    other = pages.cruise_page(flagged, kind, length_ships=ships[:1])
    assert rows(other["rank_growth"]) == rows(page["rank_growth"]) != rows(narrowed["rank_growth"])
    assert page["ships"].agg(F.sum("orders")).first()[0] == flagged.filter(F.col("is_cur") & (F.col("cruise_type") == kind)).count()


def test_tours(flagged):
    filled(pages.tours_page(flagged))
    assert {r.region for r in pages.tours_page(flagged, ["越南"])["rank_growth"].collect()} == {"越南"}


@pytest.mark.parametrize("line", ["TW", "KR", "JP", "Camping"])
def test_stays(flagged, line):
    page = filled(pages.stays_page(flagged, line))
    assert ("types" in page, "hoshino" in page) == (line == "TW", line == "JP")


def test_stay_views_split_the_market(flagged):
    def count(view):
        return pages.stays_page(flagged, "TW", view)["kpis"].first().orders
    assert count(rules.STAY_VIEW_WHOLE) + count(rules.STAY_VIEW_ROOMS) == count(rules.STAY_VIEW_ALL)


def test_lines(flagged):
    assert "platforms" in filled(pages.line_page(flagged, "eSIM", has_travel_date=False), ("types",))
    assert "months" in filled(pages.line_page(flagged, "高鐵"))
    page = filled(pages.sports_page(flagged))
    assert "types" not in page and "cross" in page


def test_types_are_shown_only_where_there_are_several(clean):
    week = flag_periods(clean({"bnb_type": "eSIM"}, {"bnb_type": "THSR Tickets"}, {"bnb_type": "THSR Holiday"}), WEEK)
    assert pages.line_page(week, "eSIM")["types"].isEmpty()
    assert pages.line_page(week, "高鐵")["types"].count() == 2


def test_picker_keeps_vanished_ships(clean):
    names = ["探索星號 基隆出發", "莎倫娜號 基隆出發"]
    table = clean(*({"bnb_type": "Cruise", "bnb_name": n, "order_date": d} for n, d in zip(names, ("2024-03-05", "2024-02-27"), strict=True)))
    page = pages.cruise_page(flag_periods(table, WEEK), rules.HOMEPORT)
    assert [tuple(r) for r in page["ship_picker"].collect()] == [("探索星號", 1, 0), ("莎倫娜號（台灣登船）", 0, 1)]
    page.release()


def leaves(table):
    found = table._jdf.queryExecution().withCachedData().collectLeaves()
    return [found.apply(n) for n in range(found.size())]


PAGES = {
    "overview": lambda f: pages.overview_page(f, f.select(F.to_date("order_date").alias("d"), F.lit("x").alias("name")).limit(0), R.HALVES),
    "homeport": lambda f: pages.cruise_page(f, rules.HOMEPORT, R.RANK_SHIPS, R.LENGTH_SHIPS),
    "fly": lambda f: pages.cruise_page(f, rules.FLY_CRUISE),
    "tours": pages.tours_page,
    "stays": lambda f: pages.stays_page(f, "TW"),
    "rail": lambda f: pages.line_page(f, "高鐵"),
    "esim": lambda f: pages.line_page(f, "eSIM", has_travel_date=False),
    "sports": pages.sports_page,
    "channels": pages.channels_page,
    "search": lambda f: pages.search_page(f, "沖繩"),
    "insights": lambda f: pages.insights_page(f, R.HALVES, R.AS_OF),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_a_page_scans_its_bookings_once(spark, small, tmp_path, name):
    """Every table reads the one cached table, and that is made by one scan of the stored bookings."""
    path = str(tmp_path / "clean")
    write_clean(R.every(spark, small).limit(200), path)
    page = PAGES[name](filter_bookings(flag_periods(read_clean(spark, path), R.HALVES)))
    cached = set()
    for table_name, table in page.items():
        if table_name == "holidays":
            continue
        kinds = [leaf.nodeName() for leaf in leaves(table)]
        assert not [k for k in kinds if "Relation" in k and k not in ("InMemoryRelation", "LocalRelation")], (table_name, kinds)
        cached |= {leaf.cacheBuilder().cachedPlan().toString() for leaf in leaves(table) if leaf.nodeName() == "InMemoryRelation"}
    assert len(cached) == 1
    plan = cached.pop()
    assert len(re.findall("FileScan parquet", plan.split("== Initial Plan ==")[-1])) == 1
    page.release()
    assert not page.shared.storageLevel.useMemory


@pytest.mark.parametrize("name", sorted(set(PAGES) - {"search", "insights"}))
def test_a_stacked_page_reads_the_shared_table_alone(spark, small, name):
    """Also where all tables are in one plan: each of them is found in the cache, none reads the bookings again."""
    page = PAGES[name](R.flagged(spark, small))
    page.pop("holidays", None)
    kinds = {leaf.nodeName() for leaf in leaves(pages.stacked(page))}
    assert "InMemoryRelation" in kinds and "LogicalRelation" not in kinds, kinds
    page.release()


def test_a_key_that_is_null_is_a_group_of_its_grouping(spark):
    table = spark.createDataFrame([("a", None, 1.0), ("a", None, 2.0), (None, "x", 4.0)], "k string, m string, twd_amount double")
    got = condense(table, ["k", "m"], ["m"]).collect()
    assert sorted((r.grouping, r.k, r.m, r.bookings, r.twd_amount) for r in got if r.k) == [(0, "a", None, 2, 3.0)]
    assert sorted(((r.grouping, r.k, r.m, r.bookings, r.twd_amount) for r in got if not r.k), key=str) == [
        (0, None, "x", 1, 4.0), (1, None, None, 2, 3.0), (1, None, "x", 1, 4.0),
    ]


def test_date_bounds_read_two_months(spark, clean, tmp_path):
    path = str(tmp_path / "clean")
    table = clean(*({"order_date": d} for d in ("2024-01-30", "2024-01-09", "2024-02-11", "2024-03-01", "2024-03-28", None, "x")))
    write_clean(table, path)
    edge = edge_months(spark, path)
    plan = edge._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PartitionFilters: \[.*order_month.*2024-01, ?2024-03", plan)
    assert {r[0].split("order_month=")[1][:7] for r in edge.select(F.input_file_name()).collect()} == {"2024-01", "2024-03"}
    assert period_bounds(edge, date(2024, 4, 1)).collect() == period_bounds(table, date(2024, 4, 1)).collect()
    assert tuple(date_bounds(edge).first()) == (date(2024, 1, 9), date(2024, 3, 28))
    write_clean(clean({"order_date": None}), path)
    assert tuple(date_bounds(edge_months(spark, path)).first()) == (None, None)


def test_channels_search_insights(flagged):
    filled(pages.channels_page(flagged))
    found = filled(pages.search_page(flagged, "沖繩", ["GIT"]))
    assert found["orders"].count() == found["totals"].first().orders
    report = filled(pages.insights_page(flagged, R.HALVES, R.AS_OF))["report"].first().report
    assert report.startswith("### 📈 本期概況\n- 統計期間：1998-04-17 ～ 2001-08-01") and report.count("### ") >= 5


def test_traffic(spark, small):
    page = filled(pages.traffic_page(R._weeks(spark, small), R._channel_weeks(spark, small), R.AS_OF))
    assert page["weeks"].count() == 12
    assert page["kpis"].first().latest_week == date(2001, 7, 22)
