"""Weekly active users page; booking filters do not apply here.

Inputs are one row per week, or per week and channel bucket, so the unpartitioned windows and sorts
below see calendar weeks only.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayledger.functions.calendar import week_start

WINDOWS = {"近12週": 12, "近26週": 26, "近52週": 52, "全部": None}


def last_weeks(weeks: DataFrame, n: int | None) -> DataFrame:
    """The newest n rows; a year's last week and the next year's first may be two rows of one Sunday."""
    newest_first = weeks.orderBy(F.desc("week_start"), F.desc("yearweek"))
    return newest_first.limit(n) if n else newest_first


def wau_kpi(weeks: DataFrame, as_of: date) -> DataFrame:
    """Latest complete week against the one before, the running week with its projection, the mean."""
    sunday = week_start(F.lit(as_of))
    complete = F.col("week_start") < sunday
    running = F.col("week_start") == sunday
    order = Window.partitionBy("complete").orderBy(F.desc("week_start"), F.desc("yearweek"))
    ranked = weeks.withColumn("complete", complete).withColumn("place", F.row_number().over(order))

    def nth(column: str, place: int, is_complete: bool):
        return F.max(F.when((F.col("complete") == is_complete) & (F.col("place") == place), F.col(column)))

    days = F.least(F.date_diff(F.lit(as_of), sunday) + 1, F.lit(7))
    picked = ranked.agg(
        F.coalesce(nth("week_start", 1, True), nth("week_start", 1, False)).alias("latest_week"),
        F.coalesce(nth("wau", 1, True), nth("wau", 1, False)).alias("latest_wau"),
        nth("wau", 2, True).alias("prev_wau"),
        F.max(F.when(running, F.col("week_start"))).alias("running_week"),
        F.min_by("wau", F.when(running, F.col("yearweek"))).alias("running_wau"),
        F.avg("wau").cast("bigint").alias("mean_wau"),
    ).filter(F.col("latest_week").isNotNull())
    projected = F.rint(F.col("running_wau") / days * 7).cast("bigint")
    return picked.select(
        "latest_week", "latest_wau",
        F.coalesce("prev_wau", F.lit(0).cast("bigint")).alias("prev_wau"),
        F.when(F.col("prev_wau") != 0, F.col("latest_wau") - F.col("prev_wau")).alias("wau_diff"),
        "running_week", "running_wau",
        F.when(F.col("running_wau").isNotNull(), days).cast("bigint").alias("days_elapsed"),
        projected.alias("projected_wau"),
        (projected - F.col("running_wau")).alias("projected_rest"),
        "mean_wau",
    )


def channel_window(channel_weeks: DataFrame, weeks: DataFrame) -> DataFrame:
    """Channel rows of the weeks on display."""
    return channel_weeks.join(weeks.select("week_start"), "week_start", "left_semi")


def channel_order(windowed: DataFrame) -> DataFrame:
    return windowed.groupBy("channel").agg(F.sum("users").alias("users")).orderBy(F.desc("users"), "channel")


def channel_kpi(windowed: DataFrame, as_of: date) -> DataFrame:
    """Per channel: latest complete week, the one before, difference and percent change."""
    newest_first = Window.partitionBy("channel", "complete").orderBy(F.desc("week_start"))
    ranked = windowed.withColumn("complete", F.col("week_start") < week_start(F.lit(as_of))).withColumn(
        "place", F.row_number().over(newest_first)
    )

    def nth(place: int):
        return F.max(F.when(F.col("complete") & (F.col("place") == place), F.col("users")))

    diff = F.col("users") - F.col("prev_users")
    return (
        ranked.groupBy("channel")
        .agg(F.sum("users").alias("total_users"), nth(1).alias("users"), nth(2).alias("prev_users"))
        .select(
            "channel", "total_users", "users", "prev_users", diff.alias("users_diff"),
            F.when(F.col("prev_users") != 0, F.try_divide(diff, F.col("prev_users")) * 100).alias("users_pct"),
        )
        .orderBy(F.desc("total_users"), "channel")
    )
