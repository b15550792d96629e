"""Raw text bookings -> typed, filtered and classified bookings.

One narrow pass without a shuffle: coerce types, drop filler rows, tidy names, drop pseudo orders,
then label.  The same function serves batch tables and file streams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wayledger.functions import classify as C
from wayledger.functions import rules
from wayledger.functions.text import (
    collapse_spaces, has_ink, known, strip_markup, to_amount, to_count, to_moment,
)

MOMENTS = ["order_date", "check_in", "check_out"]
COUNTS = ["guests", "adult", "child", "nights", "rooms"]
TEXTS = [
    "order_id", "booking_status", "platform", "bnb_city", "bnb_id", "bnb_type",
    "affiliate_id", "coupon", "column_switch_3",
]
LABELS = ["product_line", "cruise_type", "seb_type", "seb_country"]
CLEAN_COLUMNS = [*MOMENTS, *TEXTS, "bnb_name", "bnb_name_lower", "tags", *COUNTS, "twd_amount", *LABELS]


def clean_bookings(raw: DataFrame, date_forms: Sequence[str] = (), observation: Observation | None = None) -> DataFrame:
    """Clean bookings.  ``date_forms`` are accepted besides year-month-day; ``observation`` counts, in the same pass, the texts of each
    date column that none of the forms could read (``unreadable_order_date`` and so on)."""
    real = has_ink(F.col("order_id"))
    for word in rules.PSEUDO_ORDER_WORDS:
        real = real & ~F.col("bnb_name").contains(word)
    # The filter looks at the name before spaces are collapsed, which cannot create or break a
    # pseudo-order word, so queries that never show the name do not pay for tidying it.
    plain = raw.withColumn("bnb_name", strip_markup(known(F.col("bnb_name")), "translate")).filter(real)
    typed = plain.select(
        *[to_moment(F.col(c), date_forms).alias(c) for c in MOMENTS],
        *([F.col(c).alias(f"_{c}") for c in MOMENTS] if observation else []),
        *TEXTS,
        collapse_spaces(F.col("bnb_name")).alias("bnb_name"),
        F.lower(known(F.col("tags"))).alias("tags"),
        *[to_count(F.col(c)).alias(c) for c in COUNTS],
        to_amount(F.col("twd_amount")).alias("twd_amount"),
    )
    if observation:
        lost = {c: F.col(f"_{c}").isNotNull() & F.col(c).isNull() for c in MOMENTS}
        typed = typed.observe(observation, *[F.count_if(x).alias(f"unreadable_{c}") for c, x in lost.items()])
    labelled = (
        typed.withColumn("bnb_name_lower", F.lower("bnb_name"))
        .withColumn("product_line", C.product_line(F.col("bnb_type"), F.col("column_switch_3"), F.col("tags")))
        .withColumns(
            {
                "cruise_type": C.cruise_type(F.col("product_line"), F.col("bnb_name")),
                "seb_type": C.seb_type(F.col("product_line"), F.col("bnb_type"), F.col("bnb_name")),
                "seb_country": C.seb_country(F.col("product_line"), F.col("column_switch_3"), F.col("bnb_name")),
            }
        )
    )
    return labelled.select(*CLEAN_COLUMNS)
