"""Order search page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayledger.operators.measures import orders, revenue
from wayledger.sources.bookings import EXPORT_NAMES

ORDER_COLUMNS = list(EXPORT_NAMES)


def order_list(found: DataFrame) -> DataFrame:
    """Newest first, undated last."""
    return found.select(*ORDER_COLUMNS).orderBy(F.desc_nulls_last("order_date"), "order_id")


def order_totals(found: DataFrame) -> DataFrame:
    return found.agg(orders(found), revenue())
