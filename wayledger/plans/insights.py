"""Rule-based text report over a current and a previous period."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayledger.functions import classify as C
from wayledger.functions.calendar import travel_month
from wayledger.functions.text import moment, one_decimal, whole
from wayledger.operators.measures import change_pct
from wayledger.operators.periods import Period

# Section headings and market names of the report.
HEADINGS = {
    1: "### 📈 本期概況",
    2: "### 💰 各產品線業績",
    3: "### 🚢 郵輪洞察",
    4: "### 🏠 住宿洞察",
    5: "### 📣 前5大行銷管道",
    6: "### ⚠️ 注意事項",
}
MARKETS = {"TW": "台灣", "JP": "日本", "KR": "韓國"}
TOP_CHANNELS = 5
CANCEL_ALERT_PCT = 15
FEW_ORDERS = 10

# Levels of the report, and the columns that name a row of each; a level is derived from one of three groupings of the bookings.
TOTAL, LINE, TYPE, MONTH, CITY, CHANNEL = range(6)
LEVEL_KEYS = {TOTAL: [], LINE: ["product_line"], TYPE: ["cruise_type"], MONTH: ["month"], CITY: ["product_line", "city"], CHANNEL: ["channel"]}
GROUPINGS = [
    (["product_line", "cruise_type", "month"], [TOTAL, LINE, TYPE, MONTH]),
    (["product_line", "city"], [CITY]),
    (["channel"], [CHANNEL]),
]
LEVEL_COLUMNS = ["product_line", "cruise_type", "month", "city", "channel"]


def _levels(flagged: DataFrame, as_of: date) -> DataFrame:
    """Every aggregate the report needs, from one pass over the bookings.

    Bookings are grouped side by side by (line, type, month), (line, city) and channel, three narrow groupings that shrink before
    their shuffle however many cities and channels there are; the levels are sums over those groups.

    Channels, months and the cities of a line are ranked and cut to what the report prints.  In that contest every row of the other
    levels is alone, so one constant limit holds for all and Spark applies it before the shuffle.  The places of lines and types, which
    are all printed, are numbered among the rows that are left.
    """
    line = F.col("product_line")
    facts = flagged.select(
        line,
        F.when(line == "Cruise", F.col("cruise_type")).alias("cruise_type"),
        F.when((line == "Cruise") & (F.col("check_in") > moment(as_of)), travel_month(F.col("check_in"))).alias("month"),
        F.when(line.isin(list(MARKETS)), F.col("bnb_city")).alias("city"),
        C.channel(F.col("affiliate_id")).alias("channel"),
        "is_cur", "is_prev", "nights", "twd_amount",
        (F.col("is_cur") & F.col("booking_status").eqNullSafe(F.lit("canceled"))).alias("is_canceled"),
    )

    def amount(flag: str, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(flag), F.col(column))), F.lit(0))

    columns = {c: F.col(c) for c in LEVEL_COLUMNS}
    groups = facts.groupingSets([[columns[c] for c in keys] for keys, _ in GROUPINGS], *columns.values()).agg(
        F.grouping_id().alias("grouping"),
        F.count_if("is_cur").alias("orders"),
        F.count_if("is_prev").alias("prev_orders"),
        amount("is_cur", "twd_amount").alias("revenue"),
        amount("is_prev", "twd_amount").alias("prev_revenue"),
        amount("is_cur", "nights").alias("nights"),
        F.count_if("is_canceled").alias("canceled"),
    )
    # a bit of grouping_id is set where the column is rolled up, the first column being the highest bit
    def bits(keys) -> int:
        return sum(0 if c in keys else 1 << (len(LEVEL_COLUMNS) - 1 - i) for i, c in enumerate(LEVEL_COLUMNS))

    feeds = F.coalesce(*[F.when(F.col("grouping") == bits(keys), F.array(*map(F.lit, levels))) for keys, levels in GROUPINGS])
    level = F.col("level")
    kept = {c: F.when(level.isin([x for x, keys in LEVEL_KEYS.items() if c in keys]), F.col(c)) for c in LEVEL_COLUMNS}
    measures = ["orders", "prev_orders", "revenue", "prev_revenue", "nights", "canceled"]
    table = groups.withColumn("level", F.explode(feeds)).withColumns(kept).groupBy("level", *LEVEL_COLUMNS)
    named = table.agg(*[F.sum(m).alias(m) for m in measures]).withColumn(
        "subject", F.coalesce(*[F.when(level == x, F.col(keys[-1])) for x, keys in LEVEL_KEYS.items() if keys])
    )
    sold = named.filter((level == TOTAL) | ((F.col("orders") > 0) & F.col("subject").isNotNull()))

    size = F.when(level == MONTH, F.col("orders").cast("double")).otherwise(F.col("revenue"))
    order = [size.desc(), "subject"]
    alone = F.when(level.isin(LINE, TYPE), F.col("subject")).when(level == CITY, F.col("product_line"))
    best = sold.withColumn("_at", F.row_number().over(Window.partitionBy("level", alone).orderBy(*order)))
    best = best.filter(F.col("_at") <= TOP_CHANNELS).filter(~level.isin(MONTH, CITY) | (F.col("_at") == 1))
    contest = Window.partitionBy("level", F.when(level == CITY, F.col("product_line"))).orderBy(*order)
    return best.withColumn("place", F.row_number().over(contest)).drop("_at")


def _entry(section: int, order, subject, line: Column, value=None, pct=None, orders=None, when=None) -> Column:
    """One report line as a struct, NULL when its condition does not hold."""
    entry = F.struct(
        F.lit(section).alias("section_no"),
        (order if isinstance(order, Column) else F.lit(order)).cast("int").alias("order_no"),
        (subject if isinstance(subject, Column) else F.lit(subject)).alias("subject"),
        F.lit(value).cast("double").alias("value"),
        F.lit(pct).cast("double").alias("pct"),
        F.lit(orders).cast("bigint").alias("orders"),
        line.alias("line"),
    )
    return entry if when is None else F.when(when, entry)


def _against(previous: Column, pct: Column, unit: str) -> Column:
    """Change against the previous period, or nothing without one.  No change points down."""
    return F.when(
        previous > 0,
        F.concat(
            F.lit("，較前期 "), F.when(pct > 0, "↑").otherwise("↓"), F.lit(" "), one_decimal(F.abs(pct)), F.lit("%（前期 "),
            F.lit("" if unit else "NT$"), whole(previous), F.lit(f" {unit}" if unit else ""), F.lit("）"),
        ),
    ).otherwise("")


def insights(flagged: DataFrame, period: Period, as_of: date) -> DataFrame:
    """Report lines ``(section_no, line_no, subject, value, pct, orders, line)``.

    After the aggregation there are under a hundred rows; the windows that follow see only those.
    """
    levels = _levels(flagged, as_of)
    everything, same_line = Window.partitionBy(), Window.partitionBy("product_line")
    level, rev, n, place = F.col("level"), F.col("revenue"), F.col("orders"), F.col("place")

    def at(wanted: int, column: Column) -> Column:
        return F.when(level == wanted, column)

    known = levels.withColumns(
        {
            "line_total": F.sum(at(LINE, rev)).over(everything),
            "type_total": F.sum(at(TYPE, rev)).over(everything),
            "top_city": F.max(F.when((level == CITY) & (place == 1), F.col("city"))).over(same_line),
        }
    )
    money = F.concat(F.lit("NT$"), whole(rev))
    rev_pct = change_pct(rev, F.col("prev_revenue"))
    orders_pct = change_pct(n, F.col("prev_orders"))
    share = F.coalesce(F.try_divide(rev, F.col("line_total")) * 100, F.lit(0.0))
    type_share = F.try_divide(rev, F.col("type_total")) * 100
    cancel_rate = F.try_divide(F.col("canceled"), n) * 100
    mean_nights = F.try_divide(F.col("nights"), n)
    city = F.coalesce("top_city", F.lit("–"))
    is_total, is_line = level == TOTAL, level == LINE
    market = C.lookup(F.col("product_line"), MARKETS)
    market_order = F.array_position(F.array(*[F.lit(m) for m in MARKETS]), F.col("product_line"))
    subject = F.col("subject")

    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    entries = F.array(
        _entry(1, 1, "period",
               F.lit(f"- 統計期間：{period.start} ～ {period.end}（共 {period.days} 天）"), when=is_total),
        _entry(1, 2, "revenue", text("- 本期營收 ", money, _against(F.col("prev_revenue"), rev_pct, "")),
               rev, rev_pct, when=is_total),
        _entry(1, 3, "orders",
               text("- 本期訂單數 ", whole(n), " 筆", _against(F.col("prev_orders"), orders_pct, "筆")),
               None, orders_pct, n, when=is_total),
        _entry(2, place, subject,
               text("- **", subject, "**：", money, "（", one_decimal(share), "%），", n.cast("string"), " 單"),
               rev, share, n, when=is_line),
        _entry(3, place, subject, text("- ", subject, "：", money, "（", one_decimal(type_share), "%）"),
               rev, type_share, n, when=level == TYPE),
        _entry(3, 100, "mean_nights", text("- 平均出遊晚數：", one_decimal(mean_nights), " 晚"),
               mean_nights, when=is_line & (subject == "Cruise")),
        _entry(3, 101, "peak_month", text("- 未來出發最熱月份：", subject),
               None, None, n, when=(level == MONTH) & (place == 1)),
        _entry(4, market_order, market, text("- **", market, "**：", money, "，熱門城市 ", city),
               rev, when=is_line & market.isNotNull()),
        _entry(5, place, subject, text("- **", subject, "**：", money),
               rev, when=(level == CHANNEL) & (place <= TOP_CHANNELS)),
        _entry(6, 0, "canceled",
               text("⚠️ 取消率偏高：", one_decimal(cancel_rate), f"%（超過 {CANCEL_ALERT_PCT}% 警戒線）"),
               None, cancel_rate, F.col("canceled"), when=is_total & (cancel_rate > CANCEL_ALERT_PCT)),
        _entry(6, place, subject,
               text("⚠️ **", subject, "** 訂單量極少（", n.cast("string"), " 單），可能需要關注"),
               None, None, n, when=is_line & (n < FEW_ORDERS)),
    )
    lines = known.select(F.inline(F.array_compact(entries)))
    numbered = Window.partitionBy("section_no").orderBy("order_no")
    return lines.withColumn("line_no", F.row_number().over(numbered)).select(
        "section_no", "line_no", "subject", "value", "pct", "orders", "line"
    ).orderBy("section_no", "line_no")


def insight_report(lines: DataFrame) -> DataFrame:
    """The whole report as one text (a bounded number of lines goes in)."""
    heading = C.lookup(F.col("section_no").cast("string"), {str(k): v for k, v in HEADINGS.items()})

    def in_order(order: str, column: str) -> Column:
        """The column's values as an array ordered by another column."""
        return F.transform(F.sort_array(F.collect_list(F.struct(order, column))), lambda pair: pair[column])

    sections = lines.groupBy("section_no").agg(F.array_join(in_order("line_no", "line"), "\n").alias("body"))
    headed = sections.withColumn("section", F.concat(heading, F.lit("\n"), F.col("body")))
    return headed.agg(F.array_join(in_order("section_no", "section"), "\n\n").alias("report"))
