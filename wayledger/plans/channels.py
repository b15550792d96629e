"""Marketing-channel page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayledger.functions import classify as C
from wayledger.functions import rules
from wayledger.operators.measures import compare, ratio, summarize

LINE_COLUMNS = dict(
    zip(
        rules.PRODUCT_LINES,
        ["cruise", "camping", "tw", "kr", "jp", "stay_other", "seb", "rail", "git", "esim", "day_tour", "other"],
    )
)


def with_channel(bookings: DataFrame) -> DataFrame:
    return bookings.withColumn("channel", C.channel(F.col("affiliate_id")))


def marketing_channel(bookings: DataFrame) -> DataFrame:
    table = summarize(with_channel(bookings), "channel", "product_line")
    return table.orderBy(F.desc("revenue"), "channel", "product_line")


def channel_summary(bookings: DataFrame) -> DataFrame:
    table = summarize(with_channel(bookings), "channel").withColumnRenamed("revenue", "gmv")
    return table.withColumn("aov", ratio(F.col("gmv"), F.col("orders"))).orderBy("channel")


def channel_compare(flagged: DataFrame) -> DataFrame:
    """Channels of the current period against the previous one."""
    table = compare(with_channel(flagged), "channel").withColumnsRenamed(
        {"revenue": "gmv", "prev_revenue": "prev_gmv"}
    )
    table = table.withColumns(
        {
            "aov": ratio(F.col("gmv"), F.col("orders")),
            "prev_aov": ratio(F.col("prev_gmv"), F.col("prev_orders")),
        }
    )
    return table.select(
        "channel",
        "orders", "prev_orders", (F.col("orders") - F.col("prev_orders")).alias("orders_diff"),
        "gmv", "prev_gmv", (F.col("gmv") - F.col("prev_gmv")).alias("gmv_diff"),
        "aov", "prev_aov", (F.col("aov") - F.col("prev_aov")).alias("aov_diff"),
    ).orderBy(F.desc("gmv"), "channel")


def channel_line_pivot(bookings: DataFrame) -> DataFrame:
    """Revenue per channel (rows) and product line (columns), 0 where nothing sold."""
    table = with_channel(bookings).groupBy("channel").pivot("product_line", rules.PRODUCT_LINES).agg(F.sum("twd_amount"))
    return table.select(
        "channel",
        *[F.coalesce(F.col(f"`{line}`"), F.lit(0.0)).alias(name) for line, name in LINE_COLUMNS.items()],
    ).orderBy("channel")
