"""Calendar arithmetic: weeks run Sunday to Saturday, months are calendar months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_start(day: Column) -> Column:
    """Sunday on or before the day."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def yearweek_to_sunday(yearweek: Column) -> Column:
    """``YYYYWW`` -> Sunday of that week; week 01 is the one that holds January 1st."""
    january = F.make_date(F.substring(yearweek, 1, 4).try_cast("int"), F.lit(1), F.lit(1))
    weeks = F.substring(yearweek, 5, 2).try_cast("int") - 1
    return F.date_add(week_start(january), weeks * 7)


def month_text(moment: Column) -> Column:
    """``yyyy-MM``, taken from the date itself so that the session time zone has no say."""
    return F.substring(moment.cast("date").cast("string"), 1, 7)


def travel_month(moment: Column) -> Column:
    """Month of a travel date; a missing date is the group ``NaT``."""
    return F.coalesce(month_text(moment), F.lit("NaT"))


def lead_days(ordered: Column, travels: Column) -> Column:
    """Whole 24-hour days from order to travel; NULL when unknown or negative."""
    return F.when(travels >= ordered, F.extract(F.lit("DAY"), travels - ordered).cast("bigint"))
