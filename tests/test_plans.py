"""What the physical plans must and must not hold."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from wayledger.operators.clean import clean_bookings
from wayledger.operators.filters import filter_bookings
from wayledger.operators.periods import Period, flag_periods
from wayledger.operators.ranking import product_rank
from wayledger.plans import cruise, insights, overview
from wayledger.plans import registry as R
from wayledger.functions import rules
from wayledger.sources.bookings import read_clean, write_clean

HUGE_METHOD = 8000  # bytes; the JIT compiler leaves longer methods interpreted


def plan(table):
    return table._jdf.queryExecution().explainString(
        table.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture(scope="module")
def stored(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clean") / "bookings")
    write_clean(R.every(spark, small), path)
    return read_clean(spark, path)


@pytest.mark.parametrize("name", sorted(R.QUERIES))
def test_no_python_and_no_cartesian_product(spark, small, name):
    text = plan(R.QUERIES[name](spark, small))
    for word in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct"):
        assert word not in text


@pytest.mark.parametrize(
    "report",
    [overview.kpi_overview, overview.product_line_detail, cruise.kpi_cruise,
     lambda f: cruise.ship_table(f, rules.HOMEPORT), lambda f: insights.insights(f, R.HALVES, R.AS_OF)],
)
def test_compare_reads_its_input_once(stored, report):
    assert len(re.findall(r"\(\d+\) Scan parquet", plan(report(flag_periods(stored, R.HALVES))))) == 1


def test_stored_table_keeps_every_booking(spark, small, stored):
    direct = R.every(spark, small)
    assert stored.count() == direct.count()
    assert stored.drop("order_month").exceptAll(direct.select(stored.drop("order_month").columns)).isEmpty()


def test_period_prunes_month_folders_and_columns(stored):
    period = Period.before(date(2001, 5, 4), date(2001, 8, 1))
    text = plan(overview.product_line_detail(filter_bookings(flag_periods(stored, period))))
    partition_filters = re.search(r"PartitionFilters: (.*)", text).group(1)
    assert "order_month" in partition_filters and "2001-02" in partition_filters and "2001-08" in partition_filters
    assert "IsNotNull(booking_status)" in re.search(r"PushedFilters: (.*)", text).group(1)
    columns = re.search(r"ReadSchema: struct<(.*)>", text).group(1)
    assert {c.split(":")[0] for c in columns.split(",")} == {"order_date", "booking_status", "twd_amount", "product_line"}


def test_each_side_of_a_ranking_reads_its_own_months(stored):
    period = Period.before(date(2001, 5, 4), date(2001, 8, 1))
    text = plan(product_rank(filter_bookings(flag_periods(stored, period)), "growth"))
    def own_months(filters):
        return re.findall(r"order_month#\d+ [<>]= (\d{4}-\d{2})", filters)[-2:]
    found = [own_months(filters) for filters in re.findall(r"PartitionFilters: (.*)", text)]
    assert found == [["2001-05", "2001-08"], ["2001-02", "2001-05"]]


def test_line_report_pushes_the_line_down(stored):
    text = plan(cruise.cruise_type_summary(stored))
    assert "EqualTo(product_line,Cruise)" in text


def test_literal_catalogue_is_broadcast_even_without_a_size_threshold(spark, small):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(R.QUERIES["product_line_summary"](spark, small))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert text.count("BroadcastHashJoin Inner") == 1 and text.count("SortMergeJoin Inner") == 1


def test_dates_prune_orders_at_the_scan(spark, small):
    text = plan(overview.kpi_overview(R.flagged(spark, small, R.LAST_90)))
    assert "GreaterThanOrEqual(o_orderdate" in text


def test_name_rules_run_after_the_first_grouping(stored):
    """Brand rules sit above the exchange, on one row per product."""
    text = plan(cruise.cruise_by_brand(stored))
    tree = text[: text.index("(1) Scan")]
    assert tree.count("Exchange") >= 2
    scan_side = text[text.index("(1) Scan"):text.index("Exchange\nInput")]
    assert "costa" not in scan_side


def test_lead_window_cut_is_pushed_before_the_shuffle(stored):
    text = plan(insights.insights(flag_periods(stored, R.HALVES), R.HALVES, R.AS_OF))
    assert text.count("WindowGroupLimit") >= 2


def test_insights_shuffle_narrow_groups(stored):
    """The first shuffle carries sums of three narrow groupings, partly summed before it."""
    text = plan(insights.insights(flag_periods(stored, R.HALVES), R.HALVES, R.AS_OF))
    tree = text[: text.index("(1) Scan")]
    lowest = tree.splitlines()
    at = max(i for i, row in enumerate(lowest) if "Exchange" in row)
    assert "HashAggregate" in lowest[at + 1] and "Expand" in lowest[at + 2]


def method_sizes(table):
    stages = table._jdf.queryExecution().debug().codegenToSeq()
    return [stages.apply(n)._3().maxMethodCodeSize() for n in range(stages.size())]


@pytest.fixture
def whole_plans(spark):
    """Without re-planning at run time, so that every stage's code can be asked for beforehand."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_cleaning_code_is_small_enough_to_be_compiled(spark, small, tmp_path, whole_plans):
    path = str(tmp_path / "raw")
    from wayledger.sources.testdata import raw_bookings

    raw_bookings(spark, small).write.parquet(path)
    sizes = method_sizes(clean_bookings(spark.read.parquet(path)))
    assert sizes and max(sizes) < HUGE_METHOD


@pytest.mark.parametrize("name", sorted(R.QUERIES))
def test_query_code_is_small_enough_to_be_compiled(spark, small, name, whole_plans):
    assert max(method_sizes(R.QUERIES[name](spark, small)), default=0) < HUGE_METHOD
