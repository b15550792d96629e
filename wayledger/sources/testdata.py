"""Bridge from the star-schema test tables to the inputs of the engine.

One booking per line item.  The SQL keeps to syntax two engines share, so the query side and the
checking side read the very same text; ``{...}`` names are filled with table names or DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# (type, column_switch_3, tags, city, name), numbered from 0; None is SQL NULL.
CATALOGUE = [
    ("Cruise", "-", "cruise", "Keelung", "麗星郵輪 探索星號 基隆啟航 那霸 石垣 4天"),
    ("Cruise", "-", "cruise", "Keelung", "地中海郵輪 MSC榮耀號 (基隆出發) 沖繩 鹿兒島 5天"),
    ("Cruise", "-", None, "Keelung", "歌詩達郵輪 莎倫娜號 釜山 佐世保 6天"),
    ("Cruise", "-", "cruise", "Kaohsiung", "三井海洋富士號 高雄登船 宮古 5天"),
    ("Cruise", "-", "cruise", "Singapore", "MSC榮耀號 新加坡登船 檳城 馬六甲 5天"),
    ("Cruise", "-", "cruise", "Seattle", "公主遊輪 藍寶石公主號 西雅圖出發 阿拉斯加 冰河灣 8天"),
    ("Cruise", "-", "cruise", "Rome", "名人郵輪 Celebrity Xcel 羅馬上船 希臘 土耳其 9天"),
    ("Cruise", "-", "cruise", None, "迪士尼郵輪 Disney Adventure 贈登船迎賓套裝 4天"),
    ("Cruise", "-", "cruise", "Keelung", "挪威太陽號 基隆-東京移航 10天"),
    ("Cruise", "-", "cruise", "Hong Kong", "皇家加勒比 海洋光譜號 香港登船 越南 5天"),
    ("Cruise", "-", "cruise", "London", "皇后郵輪 伊莉莎白女王號 上船 8天"),
    ("Cruise", "-", "cruise", None, "探索星號 移航 石垣 3天"),
    ("Cruise", "-", "cruise", "Phuket", "星夢郵輪 雲頂夢號 登船 普吉 5天"),
    ("Cruise", "-", "cruise", None, "神秘遊船 探險之旅"),
    ("Cruise", "-", None, None, "郵輪補款專用"),
    ("Group tour", "Taiwan", None, None, "北海道函館5日"),
    ("Group tour", "Taiwan", None, None, "沖繩古宇利4日"),
    ("Group tour", "Taiwan", None, None, "立山黑部合掌村6日"),
    ("Group tour", "Taiwan", None, None, "<translate=12>京阪神奈良5日</translate>"),
    ("Group tour", "Korea", None, None, "首爾江原道5日"),
    ("Group tour", "-", None, None, "奧捷布拉格10日"),
    ("Group tour", "-", None, None, "越南峴港5日"),
    ("Group tour", "-", None, None, "南極探險"),
    ("Hotel", "Taiwan", None, "Taipei City", "台北晶華酒店"),
    ("Bnb / Apartment", "Taiwan", "Family", "Yilan County", "宜蘭包棟民宿"),
    ("Bnb / Apartment", "Taiwan", "Camping,Family", "Miaoli County", "苗栗露營民宿"),
    ("Campground", "-", None, "Nantou County", "南投營地"),
    ("Hostel", "Korea", None, "Seoul", "首爾明洞青旅"),
    ("Hotel", "Japan", None, "Karuizawa", "星野 輕井澤"),
    ("Villa", "japan", None, "Okinawa", "HOSHINO RISONARE"),
    ("Motel", "Taiwan", None, "Unknown City", "未知旅店"),
    ("Economy Hotel", "Thailand", None, "Bangkok", "曼谷旅店"),
    ("Serviced apartment", "Korea", None, None, "釜山公寓"),
    ("Sport Activities", "Japan", None, "Tokyo", "富士山馬拉松"),
    ("Sport Activities", "Taiwan", None, None, "Challenge Taiwan 鐵人三項"),
    ("ski", "-", None, None, "新潟滑雪 4天"),
    ("Sport Activities", "基本方案", None, None, "WBC 經典賽 東京 觀賽"),
    ("Sport Activities", "Australia", None, "Sydney", "Sydney Race 2025"),
    ("Sport Activities", None, None, None, "日月潭泳渡"),
    ("Sport Activities", "-", None, None, "首爾 JTBC RUN"),
    ("Sport Activities", "-", None, None, "城市RUN賽"),
    ("THSR Holiday", "Taiwan", None, None, "高鐵假期 台南"),
    ("THSR Tickets", "Taiwan", None, None, "高鐵車票更名手續費"),
    ("eSIM", "-", None, None, "日本 eSIM 7天"),
    ("Attraction Tickets", "Taiwan", None, "Taipei City", "台北101門票"),
    ("Transportation", "Taiwan", None, None, "機場接送　　專車"),
    (None, None, None, None, "禮券"),
    ("THSR Upselling", "Taiwan", None, None, None),
]


def _literal(value) -> str:
    return "cast(NULL AS string)" if value is None else f"'{value}'"


def catalogue_sql() -> str:
    rows = ",\n".join(
        f"({number}, {', '.join(_literal(v) for v in row)})" for number, row in enumerate(CATALOGUE)
    )
    return f"SELECT * FROM (VALUES {rows}) AS c(cid, type, cs3, tags, city, name)"


# What line items alone determine is spelled out below the join, so neither side of it carries all of the text building.
RAW_BOOKINGS = """
SELECT
  CASE WHEN undated THEN 'bad-date' ELSE cast(ordered AS string) END AS order_date,
  order_id,
  CASE WHEN unknown THEN NULL WHEN o_orderstatus = 'F' THEN 'completed'
       WHEN o_orderstatus = 'O' THEN 'confirmed' ELSE 'canceled' END AS booking_status,
  platform,
  city AS bnb_city,
  bnb_id,
  name AS bnb_name,
  type AS bnb_type,
  CASE WHEN unplanned THEN NULL ELSE cast(ordered + wait AS string) END AS check_in,
  cast(ordered + wait + stay AS string) AS check_out,
  tags AS tags,
  affiliate_id,
  coupon,
  cs3 AS column_switch_3,
  guests, adult, child, nights, rooms, twd_amount
FROM (
  SELECT l_orderkey, cast(l_partkey % 48 AS int) AS product, wait, quantity % 8 AS stay,
         l_orderkey % 997 = 3 AS undated, l_partkey % 503 = 7 AS unknown, l_orderkey % 89 = 5 AS unplanned,
         CASE WHEN blank = 0 THEN '  ' WHEN blank = 1 THEN NULL
              ELSE cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) END AS order_id,
         CASE l_returnflag WHEN 'A' THEN 'web' WHEN 'N' THEN 'ios' ELSE 'android' END AS platform,
         'B' || cast(l_partkey % 480 AS string) AS bnb_id,
         CASE WHEN affiliate = 0 THEN NULL WHEN affiliate > 4 THEN 'aff_' || cast(affiliate AS string)
              WHEN affiliate = 1 THEN '' ELSE substr('-0 ', affiliate - 1, 1) END AS affiliate_id,
         CASE WHEN l_linenumber = 1 THEN 'WELCOME' END AS coupon,
         cast(l_linenumber + quantity % 3 AS string) AS guests,
         cast(l_linenumber AS string) AS adult,
         cast(quantity % 3 AS string) AS child,
         CASE WHEN odd = 9 THEN 'x' WHEN odd = 10 THEN '2.7' ELSE cast(quantity % 8 AS string) END AS nights,
         '1' AS rooms,
         CASE WHEN l_orderkey % 103 = 4 THEN 'n/a'
              WHEN price >= 1000 THEN
                   cast(cast(floor(price / 1000) AS int) AS string) || ',' || lpad(cast(price % 1000 AS string), 3, '0')
              ELSE cast(price AS string) END AS twd_amount
  FROM (
    SELECT *, cast(l_quantity AS int) AS quantity, cast(floor(l_extendedprice) AS int) AS price,
           cast((l_partkey * 7 + l_linenumber * 31) % 240 - 10 AS int) AS wait,
           cast((l_orderkey * 7 + l_linenumber) % 211 AS int) AS blank, cast(l_suppkey % 9 AS int) AS affiliate,
           cast(l_orderkey % 101 AS int) AS odd
    FROM {lineitem}
  ) AS numbers
) AS items
JOIN (SELECT *, cast(o_orderdate AS date) AS ordered FROM {orders}) AS placed ON l_orderkey = o_orderkey
JOIN {catalogue} ON cid = product
"""

WEEKS = """
SELECT o_custkey, o_orderpriority,
       cast(year(o_orderdate) * 100 + 1 + cast(floor((dayofyear(o_orderdate) - 1
            + dayofweek(make_date(year(o_orderdate), 1, 1)) - dayofweek(date '2000-01-02')) / 7) AS int)
            AS string) AS yw
FROM {orders}
"""

RAW_WAU = f"""
SELECT yw AS _c0, cast(count(DISTINCT o_custkey) AS string) AS _c1 FROM ({WEEKS}) AS weeks GROUP BY yw
UNION ALL SELECT 'yearWeek', 'activeUsers'
UNION ALL SELECT '199899', 'not a number'
"""

RAW_CHANNEL_USERS = f"""
SELECT yw AS _c0,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Paid Search' WHEN '2-HIGH' THEN 'Organic Search'
            WHEN '3-MEDIUM' THEN 'Direct' WHEN '4-NOT SPECIFIED' THEN 'Email' ELSE 'Mystery' END AS _c1,
       cast(count(DISTINCT o_custkey) AS string) AS _c2
FROM ({WEEKS}) AS weeks GROUP BY 1, 2
UNION ALL SELECT 'yearWeek', 'channel', 'activeUsers'
"""

# Days with clearly more orders than the mean day stand in for a holiday calendar.
HOLIDAYS = """
SELECT d, CASE orders % 3 WHEN 0 THEN '節日甲（補假）' WHEN 1 THEN '節日甲' ELSE '節日乙' END AS name
FROM (SELECT cast(o_orderdate AS date) AS d, count(*) AS orders FROM {orders} GROUP BY 1) AS days
WHERE orders >= (SELECT m + 1.3 * sqrt(m) FROM
  (SELECT cast(count(*) AS double) / count(DISTINCT o_orderdate) AS m FROM {orders}) AS mean_day)
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_bookings(spark: SparkSession, sf_dir: str, since=None, until=None) -> DataFrame:
    """Bookings as text.  ``since``/``until`` (inclusive dates) prune orders at the scan.

    Orders grow with line items, so the two are joined by a shuffle at every size."""
    orders = _table(spark, sf_dir, "orders")
    if since is not None:
        orders = orders.filter(F.col("o_orderdate") >= F.lit(str(since)).cast("timestamp_ntz"))
    if until is not None:
        orders = orders.filter(F.col("o_orderdate") < F.lit(str(until)).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
    return spark.sql(
        RAW_BOOKINGS,
        lineitem=_table(spark, sf_dir, "lineitem"),
        orders=orders.hint("merge"),
        catalogue=F.broadcast(spark.sql(catalogue_sql())),  # 48 literal rows at any scale
    )


def raw_wau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RAW_WAU, orders=_table(spark, sf_dir, "orders"))


def raw_channel_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RAW_CHANNEL_USERS, orders=_table(spark, sf_dir, "orders"))


def holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(HOLIDAYS, orders=_table(spark, sf_dir, "orders"))
