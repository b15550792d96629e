"""Timing of the headline queries; prints one JSON line.

``queries`` start from the raw text bookings each time.  ``stored`` times the intended production flow:
clean once into month folders, then run reports on that table.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from wayledger.functions import rules
from wayledger.operators.filters import filter_bookings
from wayledger.operators.periods import flag_periods
from wayledger.plans import cruise, insights, overview
from wayledger.plans import registry as R
from wayledger.session import local_session
from wayledger.sources.bookings import read_clean, write_clean

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "clean_bookings", "kpi_overview", "product_line_share", "product_line_detail", "top_products",
    "revenue_trend_week", "gmv_ohlc_ma", "kpi_cruise", "cruise_by_brand", "homeport_ship_compare",
    "fly_rank_growth", "cruise_destination_heat", "dest_heat_compare", "lead_time_stats",
    "git_region_distribution", "stay_region_aov_top", "stay_view_split", "seb_cross", "product_rank_growth",
    "channel_compare", "channel_line_pivot", "order_search", "wau_channel_kpi", "insights",
]


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def run(table) -> None:
    """Compute every row and column without storing them."""
    table.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    run(R.QUERIES["product_line_summary"](spark, SF_DIR))  # start the engine

    queries = {name: timed(lambda: run(R.QUERIES[name](spark, SF_DIR))) for name in HEADLINE}

    # on a cluster BENCH_STORE names a shared folder by URI; a machine's own folder serves local runs only
    path = os.environ.get("BENCH_STORE") or os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), "clean")
    stored = {"write_clean": timed(lambda: write_clean(R.every(spark, SF_DIR), path))}

    def flagged(period=R.HALVES):
        return filter_bookings(flag_periods(read_clean(spark, path), period))

    reports = {
        "product_line_detail": lambda: overview.product_line_detail(flagged()),
        "product_line_detail_90d": lambda: overview.product_line_detail(flagged(R.LAST_90)),
        "kpi_cruise": lambda: cruise.kpi_cruise(flagged()),
        "homeport_ship_compare": lambda: cruise.ship_table(flagged(), rules.HOMEPORT),
        "insights": lambda: insights.insights(flagged(), R.HALVES, R.AS_OF),
    }
    stored |= {name: timed(lambda: run(build())) for name, build in reports.items()}

    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "stored": stored,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
