"""Reporting periods: presets, the comparison period, and the two flags every compare is built on."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayledger.functions import rules
from wayledger.functions.calendar import week_start
from wayledger.functions.text import moment

MONTH_PARTITION = "order_month"


@dataclass(frozen=True)
class Period:
    """A current span and the span it is compared with; all bounds are inclusive dates.

    The two spans are independent and may overlap: a weekly preset keeps its seven-day shift after
    its dates were edited by hand.
    """

    start: date
    end: date
    prev_start: date
    prev_end: date

    @classmethod
    def before(cls, start: date, end: date) -> Period:
        """Compare with the equally long span just before."""
        prev_end = start - timedelta(days=1)
        return cls(start, end, prev_end - (end - start), prev_end)

    @classmethod
    def week_ago(cls, start: date, end: date) -> Period:
        """Compare with the same days one week earlier."""
        week = timedelta(days=7)
        return cls(start, end, start - week, end - week)

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1

    @property
    def first(self) -> date:
        return min(self.start, self.prev_start)

    @property
    def last(self) -> date:
        return max(self.end, self.prev_end)


def within(bookings: DataFrame, start: date | None, end: date | None) -> Column:
    """Order date in [start, end]; the end is midnight of the end day.  NULL dates do not pass.

    On a stored clean table the months are bounded too, so that whole month folders are skipped.
    """
    bounds = []
    by_month = MONTH_PARTITION in bookings.columns
    if start is not None:
        bounds.append(F.col("order_date") >= moment(start))
        if by_month:
            bounds.append(F.col(MONTH_PARTITION) >= f"{start:%Y-%m}")
    if end is not None:
        bounds.append(F.col("order_date") <= moment(end))
        if by_month:
            bounds.append(F.col(MONTH_PARTITION) <= f"{end:%Y-%m}")
    return reduce(Column.__and__, bounds, F.lit(True))


def flag_periods(bookings: DataFrame, period: Period) -> DataFrame:
    """Keep bookings of either span and mark them ``is_cur`` / ``is_prev``.

    Reports aggregate conditionally on the flags, so a compare reads its input once.
    """
    current = within(bookings, period.start, period.end)
    previous = within(bookings, period.prev_start, period.prev_end)
    return bookings.filter(current | previous).withColumns({"is_cur": current, "is_prev": previous})


def date_bounds(bookings: DataFrame) -> DataFrame:
    """One row: oldest and newest order day."""
    return bookings.agg(
        F.to_date(F.min("order_date")).alias("oldest"), F.to_date(F.max("order_date")).alias("newest")
    )


def period_bounds(bookings: DataFrame, as_of: date) -> DataFrame:
    """One row per preset with its clamped span and comparison span.

    Of a stored table pass ``sources.bookings.edge_months(spark, path)``: all that its first and last day need."""
    today = F.lit(as_of)
    sunday = week_start(today)
    oldest, newest = F.col("oldest"), F.col("newest")

    def span(preset: str, start: Column, end: Column, weekly: bool = False) -> Column:
        return F.struct(
            F.lit(preset).alias("preset"), start.alias("start"), end.alias("end"), F.lit(weekly).alias("weekly")
        )

    presets = F.array(
        span(rules.PRESET_YESTERDAY, F.date_sub(today, 1), F.date_sub(today, 1)),
        span(rules.PRESET_THIS_WEEK, sunday, F.least(F.date_add(sunday, 6), newest), weekly=True),
        span(rules.PRESET_LAST_WEEK, F.date_sub(sunday, 7), F.date_sub(sunday, 1), weekly=True),
        span(rules.PRESET_LAST_7, F.date_sub(newest, 6), newest),
        span(rules.PRESET_LAST_30, F.date_sub(newest, 29), newest),
        span(rules.PRESET_LAST_90, F.date_sub(newest, 89), newest),
        span(rules.PRESET_CUSTOM, F.greatest(oldest, F.date_sub(newest, 90)), newest),
    )

    def clamp(day: str) -> Column:
        return F.greatest(oldest, F.least(F.col(day), newest))

    clamped = (
        date_bounds(bookings)
        .filter(newest.isNotNull())
        .select("oldest", "newest", F.inline(presets))
        .withColumns({"start": clamp("start"), "end": clamp("end")})
        .withColumn("start", F.least("start", "end"))
        .withColumn("days", F.date_diff("end", "start") + 1)
    )
    shift = F.when(F.col("weekly"), F.lit(7)).otherwise(F.col("days"))
    return clamped.select(
        "preset", "start", "end",
        F.date_sub("start", shift).alias("prev_start"),
        F.date_sub("end", shift).alias("prev_end"),
        "days",
    )


def resolve_period(bookings: DataFrame, preset: str, as_of: date) -> Period:
    """The named preset as literal dates, which later filters can push down to the scan."""
    row = period_bounds(bookings, as_of).filter(F.col("preset") == preset).first()
    if row is None:
        raise ValueError(f"no dated bookings, or unknown preset {preset!r}")
    return Period(row.start, row.end, row.prev_start, row.prev_end)
