"""Weekly traffic feeds: headerless text, year-week in the first column, junk rows allowed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayledger.functions.calendar import yearweek_to_sunday
from wayledger.functions.classify import channel_bucket
from wayledger.functions.text import known, strip, to_number


def read_feed(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """A headerless CSV as text columns ``_c0``, ``_c1``, …; a missing path reads as an empty feed."""
    schema = ", ".join(f"_c{n} string" for n in range(columns))
    try:
        return spark.read.schema(schema).option("escape", '"').csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _weeks(raw: DataFrame, users: str) -> DataFrame:
    """Rows that start with six digits and carry a number."""
    yearweek = strip(F.col("_c0"))
    return (
        raw.withColumns({"yearweek": yearweek, "_users": to_number(F.col(users))})
        .filter(F.col("yearweek").rlike("^[0-9]{6}$") & F.col("_users").isNotNull())
        .withColumns(
            {"_users": F.col("_users").try_cast("bigint"), "week_start": yearweek_to_sunday(F.col("yearweek"))}
        )
    )


def weekly_users(raw: DataFrame) -> DataFrame:
    """``yearweek, week_start, wau`` in calendar order."""
    return (
        _weeks(raw, "_c1")
        .select("yearweek", "week_start", F.col("_users").alias("wau"))
        .orderBy("week_start", "yearweek")
    )


def weekly_channel_users(raw: DataFrame) -> DataFrame:
    """``week_start, channel, users``: channel groups folded into buckets and summed."""
    return (
        _weeks(raw, "_c2")
        .groupBy("week_start", channel_bucket(known(F.col("_c1"))).alias("channel"))
        .agg(F.sum("_users").alias("users"))
        .orderBy("week_start", "channel")
    )
