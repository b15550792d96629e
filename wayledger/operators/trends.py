"""Calendar series: zero-filled revenue trend, open/high/low/close bars, moving averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayledger.functions.calendar import month_start, week_start

FREQUENCIES = ("D", "W", "M")


def _bucket(day: Column, freq: str) -> Column:
    return {"D": day, "W": week_start(day), "M": month_start(day)}[freq]


def _label(bucket: Column, freq: str) -> Column:
    """Weeks are named by their Saturday, months by their last day."""
    return {"D": bucket, "W": F.date_add(bucket, 6), "M": F.last_day(bucket)}[freq]


def _daily(bookings: DataFrame) -> DataFrame:
    return (
        bookings.filter(F.col("order_date").isNotNull())
        .groupBy(F.to_date("order_date").alias("day"))
        .agg(F.sum("twd_amount").alias("gmv"))
    )


def revenue_trend(bookings: DataFrame, freq: str = "W") -> DataFrame:
    """Revenue per day, week or month from the first to the last order, empty buckets as 0.

    Gaps are filled by letting each bucket emit itself and the empty ones up to its successor, so the
    input is read once and no spine has to be joined.  The unpartitioned window sees calendar buckets
    only, never bookings.
    """
    step = {"D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAY", "M": "INTERVAL 1 MONTH"}[freq]
    buckets = _daily(bookings).groupBy(_bucket(F.col("day"), freq).alias("bucket")).agg(F.sum("gmv").alias("gmv"))
    following = F.lead("bucket").over(Window.orderBy("bucket"))
    upto = F.coalesce(F.date_sub(following, 1), F.col("bucket"))
    filled = buckets.withColumn("upto", upto).select(
        "gmv", F.posexplode(F.sequence("bucket", "upto", F.expr(step))).alias("gap", "bucket")
    )
    return filled.select(
        _label(F.col("bucket"), freq).alias("bucket_end"),
        F.when(F.col("gap") == 0, F.col("gmv")).otherwise(0.0).alias("revenue"),
    ).orderBy("bucket_end")


def gmv_ohlc(bookings: DataFrame, freq: str = "W") -> DataFrame:
    """First, highest, lowest and last daily revenue of each bucket that has orders."""
    return (
        _daily(bookings)
        .groupBy(_label(_bucket(F.col("day"), freq), freq).alias("bucket_end"))
        .agg(
            F.min_by("gmv", "day").alias("open"),
            F.max("gmv").alias("high"),
            F.min("gmv").alias("low"),
            F.max_by("gmv", "day").alias("close"),
        )
        .orderBy("bucket_end")
    )


def moving_averages(bars: DataFrame, sizes: Sequence[int] = (5, 10, 20, 60)) -> DataFrame:
    """Mean close over the last n bars, NULL until n bars exist.  Runs on calendar buckets only."""
    averages = {}
    for size in sizes:
        frame = Window.orderBy("bucket_end").rowsBetween(-(size - 1), 0)
        averages[f"ma{size}"] = F.when(F.count("close").over(frame) == size, F.avg("close").over(frame))
    return bars.withColumns(averages)


def holiday_clusters(holidays: DataFrame, start, end, gap_days: int = 3) -> DataFrame:
    """Runs of holidays at most ``gap_days`` apart, named by their most frequent holiday.

    Dates are cut to the range before merging.  Equal counts go to the name seen first.  One row per
    calendar day goes in, so the unpartitioned window stays small.
    """
    days = holidays.filter(F.col("d").between(F.lit(start), F.lit(end))).select(
        "d", F.split_part("name", F.lit("（"), F.lit(1)).alias("name")
    )
    by_day = Window.orderBy("d")
    opens = F.coalesce(F.date_diff("d", F.lag("d").over(by_day)) > gap_days, F.lit(True))
    islands = days.withColumn("opens", opens.cast("int")).withColumn("island", F.sum("opens").over(by_day))
    named = islands.groupBy("island", "name").agg(
        F.count(F.lit(1)).alias("times"), F.min("d").alias("first_d"), F.max("d").alias("last_d")
    )
    return (
        named.groupBy("island")
        .agg(
            F.min("first_d").alias("start"),
            F.max("last_d").alias("end"),
            F.min_by("name", F.struct(-F.col("times"), "first_d", "name")).alias("name"),
        )
        .drop("island")
        .orderBy("start")
    )
