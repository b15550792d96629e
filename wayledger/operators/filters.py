"""Booking filters and the option lists behind them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayledger.functions import classify as C
from wayledger.functions import rules
from wayledger.functions.text import known
from wayledger.operators.periods import within

ALL_STATUSES = "all"


def filter_bookings(
    bookings: DataFrame,
    start: date | None = None,
    end: date | None = None,
    product_lines: Sequence[str] | None = None,
    statuses: Sequence[str] | str | None = ALL_STATUSES,
    channels: Sequence[str] | None = None,
) -> DataFrame:
    """AND of the given parts.

    ``statuses="all"`` is the default selection of every known status, which drops bookings without
    one; an empty list or None switches that part off.  ``channels=None`` is off, an empty list
    matches nothing, and the direct label stands for every empty spelling.  Any other plain string
    in place of a list is an error.
    """
    if isinstance(product_lines, str) or isinstance(channels, str) or (isinstance(statuses, str) and statuses != ALL_STATUSES):
        raise ValueError("product_lines, statuses and channels take lists, not a plain string")
    kept = bookings.filter(within(bookings, start, end))
    if product_lines:
        kept = kept.filter(F.col("product_line").isin(list(product_lines)))
    if statuses == ALL_STATUSES:
        kept = kept.filter(F.col("booking_status").isNotNull())
    elif statuses:
        kept = kept.filter(F.col("booking_status").isin(list(statuses)))
    if channels is not None:
        kept = kept.filter(_in_channels(channels))
    return kept


def _in_channels(channels: Sequence[str]) -> Column:
    affiliate = F.col("affiliate_id")
    named = [c for c in channels if c != rules.DIRECT_CHANNEL]
    match = F.coalesce(affiliate.isin(named), F.lit(False)) if named else F.lit(False)
    if rules.DIRECT_CHANNEL in channels:
        match = match | (C.channel(affiliate) == rules.DIRECT_CHANNEL)
    return match


def channel_options(bookings: DataFrame) -> DataFrame:
    """Channels ordered by the count of their most frequent raw spelling."""
    return (
        bookings.groupBy("affiliate_id")
        .agg(F.count(F.lit(1)).alias("spelled"))
        .groupBy(C.channel(F.col("affiliate_id")).alias("channel"))
        .agg(F.max("spelled").alias("top_count"))
        .orderBy(F.desc("top_count"), "channel")
    )


def status_options(bookings: DataFrame) -> DataFrame:
    return bookings.filter(F.col("booking_status").isNotNull()).select("booking_status").distinct().orderBy("booking_status")


def stay_view(bookings: DataFrame, view: str) -> DataFrame:
    """Whole units, everything but whole units (a missing type counts as not whole), or all stays."""
    whole = F.col("bnb_type").eqNullSafe(F.lit(rules.WHOLE_UNIT_TYPE))
    if view == rules.STAY_VIEW_WHOLE:
        return bookings.filter(whole)
    if view == rules.STAY_VIEW_ROOMS:
        return bookings.filter(~whole)
    if view == rules.STAY_VIEW_ALL:
        return bookings
    raise ValueError(f"unknown stay view {view!r}")


def _compiled(bookings: DataFrame, pattern: str) -> None:
    """ValueError for an expression that the executors could not use."""
    try:
        bookings.sparkSession._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException as error:
        raise ValueError(f"not a regular expression: {error}") from None


def search(bookings: DataFrame, keyword: str = "", product_lines: Sequence[str] = (), literal: bool = False) -> DataFrame:
    """Bookings whose id, name or city matches the keyword (a regular expression unless ``literal``).

    Expressions are Java's, with Unicode classes, and are checked by the engine that runs them before any task starts.
    """
    if product_lines:
        bookings = bookings.filter(F.col("product_line").isin(list(product_lines)))
    wanted = keyword.strip().lower()
    if not wanted:
        return bookings
    if not literal:
        _compiled(bookings, f"(?U){wanted}")
    hit = F.lit(False)
    for column in ("order_id", "bnb_name", "bnb_city"):
        text = F.lower(known(F.col(column)))
        hit = hit | (text.contains(wanted) if literal else text.rlike(f"(?U){wanted}"))
    return bookings.filter(hit)
