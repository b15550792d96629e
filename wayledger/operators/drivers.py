"""Main driver: which trip length and which travel month moved a ship's orders most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayledger.functions.text import whole

MONTH_DIM = "出發月份"
MIN_CHANGE = 3


def ship_compare(cells: DataFrame, length_dim: str) -> DataFrame:
    """Per (brand, ship): current, previous, difference and a sentence naming the main drivers.

    ``cells`` holds compared orders at (brand, ship, length, month).  Grouping sets give the ship
    totals and both driver dimensions from that one table; the best candidate of a dimension is the
    row with the highest score, then the smallest value.
    """
    rolled = cells.groupingSets(
        [
            [F.col("brand"), F.col("ship")],
            [F.col("brand"), F.col("ship"), F.col("length")],
            [F.col("brand"), F.col("ship"), F.col("month")],
        ],
        "brand", "ship", "length", "month",
    ).agg(
        F.sum("orders").alias("orders"),
        F.sum("prev_orders").alias("prev_orders"),
        F.grouping("length").alias("no_length"),
        F.grouping("month").alias("no_month"),
    )
    diff = F.col("orders") - F.col("prev_orders")
    growth = F.coalesce(
        F.when(F.col("prev_orders") > 0, F.try_divide(diff, F.col("prev_orders")) * 100),
        F.when(diff > 0, 999.0).otherwise(-999.0),
    )
    scored = rolled.withColumns(
        {"diff": diff, "growth": F.abs(growth), "score": F.abs(diff) * F.sqrt(F.abs(growth))}
    )
    rate = F.when(
        F.col("prev_orders") > 0,
        F.concat(F.replace(whole(F.col("growth")), F.lit(","), F.lit("")), F.lit("%")),
    ).otherwise("新增")

    def best(dim: str, value: str, other: str) -> Column:
        """Sentence of the strongest candidate along one dimension, NULL when there is none."""
        candidate = (F.col(f"no_{value}") == 0) & (F.col(f"no_{other}") == 1) & (F.abs("diff") >= MIN_CHANGE)
        sentence = F.concat(
            F.lit(f"{dim}："), F.col(value),
            F.when(F.col("diff") > 0, " ▲").otherwise(" ▼"),
            F.abs("diff").cast("string"), F.lit("單（"), rate, F.lit("）"),
        )
        return F.min_by(sentence, F.when(candidate, F.struct(-F.col("score"), F.col(value))))

    is_total = (F.col("no_length") == 1) & (F.col("no_month") == 1)
    return (
        scored.groupBy("brand", "ship")
        .agg(
            F.max(F.when(is_total, F.col("orders"))).alias("orders"),
            F.max(F.when(is_total, F.col("prev_orders"))).alias("prev_orders"),
            best(length_dim, "length", "month").alias("by_length"),
            best(MONTH_DIM, "month", "length").alias("by_month"),
        )
        .select(
            "brand", "ship", "orders", "prev_orders",
            (F.col("orders") - F.col("prev_orders")).alias("orders_diff"),
            F.coalesce(
                F.nullif(F.concat_ws(" / ", "by_length", "by_month"), F.lit("")), F.lit("–")
            ).alias("main_driver"),
        )
        .orderBy("brand", F.desc("orders"), "ship")
    )
