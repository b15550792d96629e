"""The same questions in plain SQL for an independent engine.

Only inputs are shared with the Spark side: the bridge text, word lists and parameters.  The logic is
stated a second time and, where it can be, in another way: joins instead of conditional sums, a
calendar spine instead of gap filling, one statement per report section instead of grouping sets.
"""

from __future__ import annotations

import re

from wayledger.functions import rules
from wayledger.plans import registry as R
from wayledger.plans.channels import LINE_COLUMNS
from wayledger.plans.insights import HEADINGS, MARKETS
from wayledger.plans.orders import ORDER_COLUMNS
from wayledger.plans.sports import COUNTRY_COLUMNS
from wayledger.sources import testdata

SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]+"
AS_OF = f"date '{R.AS_OF}'"
SUNDAY = f"({AS_OF} - cast(dayofweek({AS_OF}) AS int))"


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def hit(column: str, words, flags: str = "") -> str:
    pattern = "|".join(re.escape(w).replace("\\ ", " ") for w in words)
    return f"regexp_matches({column}, '{flags}{pattern}')"


def found(column: str, pattern: str, flags: str = "") -> str:
    """A plain pattern in this engine's words: its own word edges know ASCII only."""
    pattern = re.sub(r"\\b(\w+)\\b", r"(^|[^\\p{L}\\p{N}_])\1([^\\p{L}\\p{N}_]|$)", pattern)
    return f"regexp_matches({column}, '{flags}{pattern}')"


def chain(column: str, ordered, default: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({column}, '{pattern}') THEN '{label}'" for label, pattern in ordered)
    return f"CASE {whens} ELSE {default} END"


def mapped(column: str, table: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {column} WHEN NULL THEN NULL {whens} ELSE {default} END"


def day(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d')"


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


MONTH = "coalesce(strftime(check_in, '%Y-%m'), 'NaT')"

_LINE = f"""CASE
  WHEN bnb_type = 'Cruise' THEN 'Cruise'
  WHEN bnb_type = 'Campground' OR (bnb_type = 'Bnb / Apartment' AND contains(tags, 'camping')) THEN 'Camping'
  WHEN bnb_type IN ('Bnb / Apartment','Economy Hotel','Hostel','Hotel','Motel','Serviced apartment','Villa') THEN
    CASE WHEN lower(coalesce(column_switch_3,'')) LIKE '%taiwan%' THEN 'TW'
         WHEN lower(coalesce(column_switch_3,'')) LIKE '%korea%' THEN 'KR'
         WHEN lower(coalesce(column_switch_3,'')) LIKE '%japan%' THEN 'JP' ELSE '住宿(其他)' END
  WHEN bnb_type IN ('Sport Activities','ski') THEN 'SEB'
  WHEN bnb_type IN ('THSR Holiday','THSR Upselling','THSR Tickets') THEN '高鐵'
  WHEN bnb_type = 'Group tour' THEN 'GIT'
  WHEN bnb_type = 'eSIM' THEN 'eSIM'
  WHEN bnb_type IN ('Attraction Tickets','Land tour','Tours & Experiences','Transportation') THEN 'Day Tour'
  ELSE '其他' END"""

_CRUISE_TYPE = f"""CASE WHEN product_line <> 'Cruise' THEN ''
  WHEN {found('bnb_name', rules.FOREIGN_EMBARK)} THEN '飛航郵輪'
  WHEN regexp_matches(bnb_name, '[（(](基隆|高雄)') OR regexp_matches(bnb_name, '(基隆|高雄)\\s*[-－]')
    OR regexp_matches(bnb_name, '(基隆|高雄)\\s*(蘇澳)?\\s*(啟航|出發|登船|上船)') THEN '母港出發'
  WHEN regexp_matches(bnb_name, '(^|[^贈送迎])(登船|上下船|上船)') THEN '飛航郵輪'
  WHEN contains(bnb_name, '移航') THEN '飛航郵輪'
  WHEN {hit('bnb_name', rules.HOMEPORT_FLEET_NAMES)} THEN '母港出發'
  ELSE '飛航郵輪' END"""

_SEB_TYPE = f"""CASE WHEN product_line <> 'SEB' THEN ''
  WHEN {found('bnb_name', rules.SPECTATE)} THEN '{rules.SEB_SPECTATE}'
  WHEN {found('bnb_name', rules.TRIATHLON, '(?i)')} THEN '{rules.SEB_TRIATHLON}'
  WHEN bnb_type = 'ski' OR {found('bnb_name', rules.SKI, '(?i)')} THEN '{rules.SEB_SKI}'
  WHEN {found('bnb_name', rules.MARATHON, '(?i)')} THEN '{rules.SEB_MARATHON}'
  ELSE '{rules.SEB_OTHER}' END"""

_SEB_COUNTRY = f"""CASE WHEN product_line <> 'SEB' THEN ''
  WHEN lower(trim(column_switch_3)) = 'japan' THEN '日本'
  WHEN lower(trim(column_switch_3)) = 'korea' THEN '韓國'
  WHEN lower(trim(column_switch_3)) = 'taiwan' THEN '台灣'
  WHEN lower(trim(coalesce(column_switch_3, 'nan'))) NOT IN ('', '-', 'nan', '基本方案') THEN '其他海外'
  WHEN {hit('bnb_name', rules.TAIWAN_PLACES)} THEN '台灣'
  WHEN {hit('bnb_name', rules.KOREA_PLACES, '(?i)')} THEN '韓國'
  WHEN {hit('bnb_name', rules.JAPAN_PLACES)} THEN '日本'
  ELSE '其他海外' END"""

_BRAND = chain("lower(bnb_name)", rules.CRUISE_BRANDS, "'其他郵輪'")
_MOVES = "CASE WHEN contains(bnb_name, '移航') THEN '（移航）' ELSE '' END"
_FOUND = f"regexp_extract(bnb_name, '{rules.SHIP_PATTERN}')"
_BARE = f"""CASE WHEN starts_with({_FOUND}, '三井海洋') AND length({_FOUND}) > 5 THEN substr({_FOUND}, 5)
  WHEN starts_with({_FOUND}, '公主') AND length({_FOUND}) > 3 THEN substr({_FOUND}, 3)
  WHEN starts_with({_FOUND}, '名人') AND length({_FOUND}) > 3 THEN substr({_FOUND}, 3) ELSE {_FOUND} END"""
_SHIP = f"""CASE WHEN contains(lower(bnb_name), 'xcel') THEN '名人極上號' WHEN {_FOUND} = '' THEN '（無船名）'
  ELSE coalesce(nullif(replace(replace(replace(replace({_BARE}, '郵輪', ''), '遊輪', ''), 'MSC', ''), '地中海', ''), ''),
                '（無船名）') || {_MOVES} END"""
_HOME_SHIP = f"""CASE WHEN {hit('lower(bnb_name)', ['三井', '富士'])} THEN '海洋富士號' || {_MOVES}
  WHEN {hit('lower(bnb_name)', ['msc', '地中海'])} THEN '地中海榮耀號' || {_MOVES}
  WHEN {hit('lower(bnb_name)', ['歌詩達', 'costa'])} THEN '莎倫娜號' || {_MOVES}
  WHEN {hit('lower(bnb_name)', ['麗星', '探索', 'star cruises'])} THEN '探索星號' || {_MOVES}
  ELSE {_SHIP} || '（台灣登船）' END"""
_REGION = "CASE " + " ".join(
    f"WHEN {hit('bnb_name', words)} THEN '{region}'" for region, words in rules.TOUR_REGIONS
) + " ELSE '其他' END"
_CHANNEL = f"""CASE WHEN regexp_replace(coalesce(affiliate_id, 'nan'), '^{SPACE}|{SPACE}$', '', 'g') IN ('', '-', '0', 'nan')
  THEN '直接/未知' ELSE affiliate_id END"""


def _count(column: str) -> str:
    return f"coalesce(cast(trunc(try_cast({column} AS double)) AS bigint), 0) AS {column}"


def _between(period_start, period_end) -> str:
    return f"order_date >= timestamp '{period_start}' AND order_date <= timestamp '{period_end}'"


def bookings(body: str, period=R.HALVES) -> str:
    """A statement over the clean bookings: ``clean``, ``booked``, ``cur``, ``prev``."""
    return f"""WITH catalogue AS ({testdata.catalogue_sql()}),
raw AS ({testdata.RAW_BOOKINGS.format(lineitem='lineitem', orders='orders', catalogue='catalogue')}),
typed AS (
  SELECT try_cast(order_date AS timestamp) AS order_date, try_cast(check_in AS timestamp) AS check_in,
    try_cast(check_out AS timestamp) AS check_out,
    order_id, booking_status, platform, bnb_city, bnb_id, bnb_type, affiliate_id, coupon, column_switch_3,
    trim(regexp_replace(regexp_replace(coalesce(bnb_name, 'nan'), '</?translate[^>]*>', '', 'g'),
                        '{SPACE}', ' ', 'g')) AS bnb_name,
    lower(coalesce(tags, 'nan')) AS tags,
    {_count('guests')}, {_count('adult')}, {_count('child')}, {_count('nights')}, {_count('rooms')},
    coalesce(try_cast(replace(twd_amount, ',', '') AS double), 0) AS twd_amount
  FROM raw WHERE order_id IS NOT NULL AND regexp_replace(order_id, '{SPACE}', '', 'g') <> ''
),
lined AS (
  SELECT *, lower(bnb_name) AS bnb_name_lower, {_LINE} AS product_line FROM typed
  WHERE NOT contains(bnb_name, '補款') AND NOT contains(bnb_name, '更名手續費')
),
clean AS (
  SELECT *, {_CRUISE_TYPE} AS cruise_type, {_SEB_TYPE} AS seb_type, {_SEB_COUNTRY} AS seb_country FROM lined
),
booked AS (SELECT *, {_CHANNEL} AS channel FROM clean WHERE booking_status IS NOT NULL),
cur AS (SELECT * FROM booked WHERE {_between(period.start, period.end)}),
prev AS (SELECT * FROM booked WHERE {_between(period.prev_start, period.prev_end)})
{body}"""


def summary(keys: str, source: str = "booked", where: str = "true", limit: str = "") -> str:
    nulls = " AND ".join(f"{k.split(' AS ')[0]} IS NOT NULL" for k in keys.split(" | "))
    names = ", ".join(keys.split(" | "))
    group = ", ".join(str(n + 1) for n in range(len(keys.split(" | "))))
    return (
        f"SELECT {names}, count(*) AS orders, coalesce(sum(twd_amount), 0) AS revenue FROM {source} "
        f"WHERE {where} AND {nulls} GROUP BY {group} {limit}"
    )


def _pct(cur: str, prev: str) -> str:
    return f"CASE WHEN {prev} > 0 THEN ({cur} - {prev}) / {prev} * 100 END"


def _kpis(period=R.HALVES, where: str = "true") -> str:
    side = "SELECT count(*) AS orders, coalesce(sum(twd_amount), 0) AS revenue FROM"
    return bookings(
        f""", c AS (SELECT *, CASE WHEN orders = 0 THEN 0.0 ELSE revenue / orders END AS aov FROM ({side} cur WHERE {where})),
p AS (SELECT *, CASE WHEN orders = 0 THEN 0.0 ELSE revenue / orders END AS aov FROM ({side} prev WHERE {where}))
SELECT c.revenue, p.revenue AS prev_revenue, {_pct('c.revenue', 'p.revenue')} AS revenue_pct,
  c.orders, p.orders AS prev_orders, {_pct('c.orders', 'p.orders')} AS orders_pct,
  c.aov AS avg_order, p.aov AS prev_avg_order, {_pct('c.aov', 'p.aov')} AS avg_order_pct
FROM c CROSS JOIN p""",
        period,
    )


def _kpi_by_line() -> str:
    side = "SELECT product_line, count(*) AS orders, sum(twd_amount) AS revenue, avg(twd_amount) AS aov FROM"
    return bookings(
        f""", c AS ({side} cur GROUP BY 1), p0 AS ({side} prev GROUP BY 1),
p AS (SELECT c.product_line, coalesce(p0.orders, 0) AS orders, coalesce(p0.revenue, 0) AS revenue,
      coalesce(p0.aov, 0) AS aov FROM c LEFT JOIN p0 USING (product_line))
SELECT c.product_line, c.revenue, p.revenue AS prev_revenue, {_pct('c.revenue', 'p.revenue')} AS revenue_pct,
  c.orders, p.orders AS prev_orders, {_pct('c.orders', 'p.orders')} AS orders_pct,
  c.aov AS avg_order, p.aov AS prev_avg_order, {_pct('c.aov', 'p.aov')} AS avg_order_pct
FROM c JOIN p USING (product_line)"""
    )


def _kpi_cruise() -> str:
    side = """SELECT scope, count(*) AS orders, sum(twd_amount) AS revenue, avg(twd_amount) AS aov, avg(nights) AS nights
FROM (SELECT *, unnest(['Cruise', cruise_type]) AS scope FROM {} WHERE product_line = 'Cruise') GROUP BY 1"""
    return bookings(
        f""", c AS ({side.format('cur')}), p0 AS ({side.format('prev')}),
p AS (SELECT c.scope, coalesce(p0.orders, 0) AS orders, coalesce(p0.revenue, 0) AS revenue,
      coalesce(p0.aov, 0) AS aov FROM c LEFT JOIN p0 USING (scope))
SELECT c.scope, c.revenue, p.revenue AS prev_revenue, {_pct('c.revenue', 'p.revenue')} AS revenue_pct,
  c.orders, p.orders AS prev_orders, {_pct('c.orders', 'p.orders')} AS orders_pct,
  c.aov, p.aov AS prev_aov, {_pct('c.aov', 'p.aov')} AS aov_pct, c.nights AS avg_nights
FROM c JOIN p USING (scope)"""
    )


def _line_detail(period=R.HALVES) -> str:
    return bookings(
        f""", c AS ({summary('product_line', 'cur')}), p AS ({summary('product_line', 'prev')})
SELECT product_line, c.orders, coalesce(p.orders, 0) AS prev_orders, c.orders - coalesce(p.orders, 0) AS orders_diff,
  c.revenue, coalesce(p.revenue, 0) AS prev_revenue, c.revenue - coalesce(p.revenue, 0) AS revenue_diff
FROM c LEFT JOIN p USING (product_line)""",
        period,
    )


def _with_share(inner: str) -> str:
    return bookings(
        f"""SELECT *, round_even(revenue / (SELECT sum(revenue) FROM ({inner})) * 100 * 10, 0) / 10 AS share_pct
FROM ({inner})"""
    )


_DAILY = """daily AS (SELECT cast(order_date AS date) AS d, sum(twd_amount) AS gmv FROM booked
  WHERE order_date IS NOT NULL GROUP BY 1)"""
_WEEK = "d - cast(dayofweek(d) AS int)"


def _trend(bucket: str, step: str, label: str) -> str:
    return bookings(
        f""", {_DAILY}, b AS (SELECT cast({bucket} AS date) AS b, sum(gmv) AS gmv FROM daily GROUP BY 1),
spine AS (SELECT cast(unnest(generate_series(min(b)::timestamp, max(b)::timestamp, INTERVAL {step})) AS date) AS b FROM b)
SELECT {day(label)} AS bucket_end, coalesce(gmv, 0) AS revenue FROM spine LEFT JOIN b USING (b)"""
    )


def _ohlc(label: str) -> str:
    return f""", {_DAILY}, bars AS (SELECT {day(label)} AS bucket_end, arg_min(gmv, d) AS open, max(gmv) AS high,
  min(gmv) AS low, arg_max(gmv, d) AS close FROM daily GROUP BY 1)"""


def _averages() -> str:
    parts = []
    for size in (5, 10, 20, 60):
        frame = f"OVER (ORDER BY bucket_end ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"
        parts.append(f"CASE WHEN count(*) {frame} = {size} THEN avg(close) {frame} END AS ma{size}")
    return ", ".join(parts)


def _holidays(start=R.HOLIDAY_SPAN[0], end=R.HOLIDAY_SPAN[1]) -> str:
    return f"""WITH h AS (SELECT d, string_split(name, '（')[1] AS name FROM ({testdata.HOLIDAYS.format(orders='orders')})
  WHERE d >= date '{start}' AND d <= date '{end}'),
flagged AS (SELECT *, CASE WHEN date_diff('day', lag(d) OVER (ORDER BY d), d) <= 3 THEN 0 ELSE 1 END AS opens FROM h),
islands AS (SELECT *, sum(opens) OVER (ORDER BY d) AS island FROM flagged),
names AS (SELECT island, name, count(*) AS n, min(d) AS first_d FROM islands GROUP BY 1, 2),
best AS (SELECT island, name, row_number() OVER (PARTITION BY island ORDER BY n DESC, first_d, name) AS rn FROM names)
SELECT {day('min(d)')} AS start, {day('max(d)')} AS "end", best.name
FROM islands JOIN best ON best.island = islands.island AND rn = 1 GROUP BY islands.island, best.name"""


def _periods() -> str:
    return bookings(
        f""", b AS (SELECT cast(min(order_date) AS date) AS lo, cast(max(order_date) AS date) AS hi FROM clean),
r AS (SELECT '昨天' AS preset, {AS_OF} - 1 AS s, {AS_OF} - 1 AS e, false AS weekly, lo, hi FROM b
  UNION ALL SELECT '本週', {SUNDAY}, least({SUNDAY} + 6, hi), true, lo, hi FROM b
  UNION ALL SELECT '前一週', {SUNDAY} - 7, {SUNDAY} - 1, true, lo, hi FROM b
  UNION ALL SELECT '近7天', hi - 6, hi, false, lo, hi FROM b
  UNION ALL SELECT '近30天', hi - 29, hi, false, lo, hi FROM b
  UNION ALL SELECT '近90天', hi - 89, hi, false, lo, hi FROM b
  UNION ALL SELECT '自訂', greatest(lo, hi - 90), hi, false, lo, hi FROM b),
k AS (SELECT preset, weekly, greatest(lo, least(s, hi)) AS s, greatest(lo, least(e, hi)) AS e FROM r),
o AS (SELECT preset, weekly, least(s, e) AS s, e FROM k),
n AS (SELECT *, cast(e - s + 1 AS int) AS days FROM o)
SELECT preset, {day('s')} AS start, {day('e')} AS "end",
  {day('CASE WHEN weekly THEN s - 7 ELSE s - days END')} AS prev_start,
  {day('CASE WHEN weekly THEN e - 7 ELSE s - 1 END')} AS prev_end, days FROM n"""
    )


def _of(kind: str) -> str:
    return f"product_line = 'Cruise' AND cruise_type = '{kind}'"


def _ship_cells(kind: str, ship: str) -> str:
    length = "cast(nights + 1 AS varchar) || ' 天'" if kind == rules.HOMEPORT else "cast(nights AS varchar) || ' 晚'"
    def side(table: str) -> str:
        return f"""SELECT {_BRAND} AS brand, {ship} AS ship, {length} AS length, {MONTH} AS month
  FROM {table} WHERE {_of(kind)}"""
    return f", c AS ({side('cur')}), p AS ({side('prev')})"


def _ship_compare(kind: str, ship: str) -> str:
    dim = "天數" if kind == rules.HOMEPORT else "晚數"
    def wide(column: str, name: str, order: int) -> str:
        return f"""SELECT {order} AS dim_no, '{name}' AS dim, brand, ship, v, coalesce(a.n, 0) AS n, coalesce(b.n, 0) AS m
  FROM (SELECT brand, ship, {column} AS v, count(*) AS n FROM c GROUP BY ALL) AS a
  FULL JOIN (SELECT brand, ship, {column} AS v, count(*) AS n FROM p GROUP BY ALL) AS b USING (brand, ship, v)"""
    return bookings(
        f"""{_ship_cells(kind, ship)},
wide AS ({wide('length', dim, 1)} UNION ALL {wide('month', '出發月份', 2)}),
scored AS (SELECT *, abs(n - m) AS change, CASE WHEN m > 0 THEN abs((n - m) / m * 100) ELSE 999.0 END AS growth FROM wide),
best AS (SELECT *, row_number() OVER (PARTITION BY brand, ship, dim ORDER BY change * sqrt(growth) DESC, v) AS rn
  FROM scored WHERE change >= 3),
said AS (SELECT brand, ship, string_agg(dim || '：' || v || CASE WHEN n > m THEN ' ▲' ELSE ' ▼' END || change || '單（'
    || CASE WHEN m > 0 THEN format('{{:.0f}}', growth) || '%' ELSE '新增' END || '）', ' / ' ORDER BY dim_no) AS main_driver
  FROM best WHERE rn = 1 GROUP BY 1, 2),
ships AS (SELECT brand, ship, coalesce(a.n, 0) AS orders, coalesce(b.n, 0) AS prev_orders
  FROM (SELECT brand, ship, count(*) AS n FROM c GROUP BY ALL) AS a
  FULL JOIN (SELECT brand, ship, count(*) AS n FROM p GROUP BY ALL) AS b USING (brand, ship))
SELECT brand, ship, orders, prev_orders, orders - prev_orders AS orders_diff, coalesce(main_driver, '–') AS main_driver
FROM ships LEFT JOIN said USING (brand, ship)"""
    )


def _days_compare(where: str = "true") -> str:
    return bookings(
        f"""{_ship_cells(rules.HOMEPORT, _HOME_SHIP)}
SELECT days, coalesce(a.n, 0) AS orders, coalesce(b.n, 0) AS prev_orders, coalesce(a.n, 0) - coalesce(b.n, 0) AS orders_diff
FROM (SELECT length AS days, count(*) AS n FROM c WHERE {where} GROUP BY 1) AS a
FULL JOIN (SELECT length AS days, count(*) AS n FROM p WHERE {where} GROUP BY 1) AS b USING (days)"""
    )


def _picker(label: str, name: str, where: str) -> str:
    return bookings(
        f"""SELECT {name}, cast(sum(n) AS bigint) AS orders, cast(sum(m) AS bigint) AS prev_orders FROM (
  SELECT {label} AS {name}, 1 AS n, 0 AS m FROM cur WHERE {where} UNION ALL SELECT {label}, 0, 1 FROM prev WHERE {where}) GROUP BY 1"""
    )


def _now(sql: str) -> str:
    """The statement over current bookings alone instead of all booked ones."""
    start = sql.index("\nprev AS (")
    end = sql.index("\n", start + 1)
    return sql[:end] + sql[end:].replace("FROM booked", "FROM cur")


def _stacked(**sections: tuple[str, str, str]) -> str:
    """Numbers of several tables in one: section -> (statement, its text columns, its number columns)."""
    parts = []
    for section, (sql, texts, numbers) in sections.items():
        names = numbers.split()
        subject = f"concat_ws(' | ', {', '.join(texts.split())})" if texts else "''"
        values = ", ".join(f"cast({n} AS double)" for n in names) if names else "1.0"
        parts.append(
            f"""SELECT '{section}' AS section, {subject} AS subject, unnest([{quoted(names or ['rows'])}]) AS measure,
unnest([{values}]) AS value FROM ({sql})"""
        )
    return "\nUNION ALL\n".join(parts)


_SALES = "orders revenue"
_RANKED, _GROWN = "orders revenue rank_no", "orders revenue prev_orders growth rank_no"
_AGAINST = "orders prev_orders orders_diff"
_KPI = "revenue prev_revenue revenue_pct orders prev_orders orders_pct avg_order prev_avg_order avg_order_pct"


def _rank_sections(where: str, **shape: bool) -> dict[str, tuple[str, str, str]]:
    texts = "bnb_id bnb_name" + (" bnb_city" if shape.get("city") else "") + (" region" if shape.get("region") else "")
    return {
        "rank_orders": (_rank(where, "orders", **shape), texts, _RANKED),
        "rank_growth": (_rank(where, "growth", **shape), texts, _GROWN),
    }


def _months(where: str) -> tuple[str, str, str]:
    return _now(bookings(summary(f"{MONTH} AS check_in_month", where=where))), "check_in_month", _SALES


def _best_sellers(where: str) -> tuple[str, str, str]:
    return _now(_top(summary("bnb_name", where=where), "revenue", 20, "bnb_name")), "bnb_name", _SALES


def _types(where: str) -> tuple[str, str, str]:
    return _now(bookings(f"SELECT * FROM ({summary('bnb_type', where=where)}) QUALIFY count(*) OVER () > 1")), "bnb_type", _SALES


def _cruise_page(kind: str, ship: str, picked: str, **more: tuple[str, str, str]) -> str:
    return _stacked(
        kpis=(
            _kpi_cruise(), "scope",
            "revenue prev_revenue revenue_pct orders prev_orders orders_pct aov prev_aov aov_pct avg_nights",
        ),
        month_brand=(
            bookings(
                f"SELECT cruise_type, {MONTH} AS check_in_month, {_BRAND} AS brand, count(*) AS orders FROM cur WHERE {_of(kind)} GROUP BY ALL"
            ),
            "cruise_type check_in_month brand", "orders",
        ),
        ships=(_ship_compare(kind, ship), "brand ship main_driver", _AGAINST),
        ship_picker=(_picker(ship, "ship", _of(kind)), "ship", "orders prev_orders"),
        **_rank_sections(f"{_of(kind)} AND {picked}"),
        destinations=(_dest_compare(kind), "destination", _AGAINST),
        lead_times=(_now(_lead_histogram(kind)), "lead_bin", "bin_no orders"),
        lead_stats=(_now(_lead_stats(kind)), "", "median_days mean_days median_months"),
        **more,
    )


def _pages() -> dict[str, str]:
    home, fly, git = rules.HOMEPORT, rules.FLY_CRUISE, _line("GIT")
    rooms = f"{_line('TW')} AND bnb_type IS DISTINCT FROM 'Bnb / Apartment'"
    tw_rooms = _regions("TW", _TW_CITY).replace("product_line = 'TW'", rooms)
    jp, rail, esim = _regions("JP", "bnb_city"), _line("高鐵"), _line("eSIM")
    picked_ships = f"{_HOME_SHIP} IN ({quoted(R.RANK_SHIPS)})"

    def by_aov(regions: str) -> str:
        return _now(
            bookings(
                f"""SELECT * FROM ({regions}) WHERE orders >= 5
OR NOT EXISTS (SELECT * FROM ({regions}) WHERE orders >= 5) ORDER BY aov DESC, region LIMIT 20"""
            )
        )

    def stays(where: str, regions: str, **more: tuple[str, str, str]) -> str:
        return _stacked(
            kpis=(_kpis(where=where), "", _KPI),
            regions_by_revenue=(_now(_top(regions, "revenue", 20, "region")), "region", "orders revenue aov"),
            regions_by_aov=(by_aov(regions), "region", "orders revenue aov"),
            months=_months(where),
            **_rank_sections(where, city=True),
            **more,
        )

    def line(where: str, **more: tuple[str, str, str]) -> str:
        return _stacked(kpis=(_kpis(where=where), "", _KPI), top_products=_best_sellers(where), **_rank_sections(where), **more)

    hoshino = f"{_line('JP')} AND (contains(bnb_name, '星野') OR contains(lower(bnb_name), 'hoshino'))"
    return {
        "homeport_ship_picker": _picker(_HOME_SHIP, "ship", _of(home)),
        "git_region_picker": _picker(_REGION, "region", git),
        "homeport_days_compare_picked": _days_compare(f"ship IN ({quoted(R.LENGTH_SHIPS)})"),
        "homeport_rank_growth_picked": _rank(f"{_of(home)} AND {picked_ships}", "growth"),
        "git_rank_growth_picked": _rank(f"{git} AND {_REGION} IN ({quoted(R.PICKED_REGIONS)})", "growth", region=True),
        "page_overview": _stacked(
            kpis=(_kpis(), "", _KPI),
            lines=(_now(_with_share(summary("product_line"))), "product_line", "orders revenue share_pct"),
            trend=(_now(_trend("d", "1 DAY", "b")), "bucket_end", "revenue"),
            holidays=(_holidays(R.HALVES.start, R.HALVES.end), 'start "end" name', ""),
            bars=(
                _now(bookings(f"{_ohlc(f'{_WEEK} + 6')} SELECT *, {_averages()} FROM bars")), "bucket_end",
                "open high low close ma5 ma10 ma20 ma60",
            ),
            detail=(_line_detail(), "product_line", "orders prev_orders orders_diff revenue prev_revenue revenue_diff"),
            top_products=(_now(_top_products()), "bnb_name product_line", "orders revenue rank_no avg_order"),
        ),
        "page_homeport": _cruise_page(
            home, _HOME_SHIP, picked_ships,
            brand_days=(_now(_brand_days()), "brand days", "revenue"),
            trip_lengths=(_days_compare(f"ship IN ({quoted(R.LENGTH_SHIPS)})"), "days", _AGAINST),
        ),
        "page_fly": _cruise_page(
            fly, _SHIP, "true",
            top_products=_best_sellers(_of(fly)),
            nights=(bookings(f"SELECT nights, count(*) AS orders FROM cur WHERE {_of(fly)} GROUP BY 1"), "", "nights orders"),
        ),
        "page_tours": _stacked(
            kpis=(_kpis(where=git), "", _KPI),
            regions=(_now(_with_share(summary(f"{_REGION} AS region", where=git))), "region", "orders revenue share_pct"),
            months=_months(git),
            region_picker=(_picker(_REGION, "region", git), "region", "orders prev_orders"),
            **_rank_sections(f"{git} AND {_REGION} IN ({quoted(R.PICKED_REGIONS)})", region=True),
        ),
        "page_stays_tw": stays(rooms, tw_rooms, types=_types(rooms)),
        "page_stays_jp": stays(_line("JP"), jp, hoshino=(_now(bookings(summary("bnb_name", where=hoshino))), "bnb_name", _SALES)),
        "page_sports": line(
            _line("SEB"),
            months=_months(_line("SEB")),
            cross=(_now(_seb_cross()), "seb_type seb_country", "orders revenue intensity"),
            cross_table=(
                _now(_seb_pivot()), "seb_type", " ".join(f"{n}_{m}" for m in ("revenue", "orders") for n in (*COUNTRY_COLUMNS.values(), "total"))
            ),
            type_order=(_now(_seb_order()), "seb_type", "revenue orders by_revenue by_orders"),
        ),
        "page_rail": line(rail, types=_types(rail), months=_months(rail)),
        "page_esim": line(
            esim,
            platforms=(
                bookings(f"SELECT platform, count(*) AS orders FROM cur WHERE {esim} AND platform IS NOT NULL GROUP BY 1"), "platform", "orders"
            ),
        ),
        "page_channels": _stacked(
            compare=(_channel_compare(), "channel", "orders prev_orders orders_diff gmv prev_gmv gmv_diff aov prev_aov aov_diff"),
            by_line=(_now(bookings(summary("channel | product_line"))), "channel product_line", _SALES),
            pivot=(_now(_pivot()), "channel", " ".join(LINE_COLUMNS.values())),
        ),
        "page_search": _stacked(
            totals=(bookings(f"SELECT count(*) AS orders, coalesce(sum(twd_amount), 0) AS revenue FROM cur WHERE {_SEARCHED}"), "", _SALES),
            orders=(
                bookings(f"SELECT {_ORDER_LIST} FROM cur WHERE {_SEARCHED}"),
                " ".join(c for c in ORDER_COLUMNS if c not in ("nights", "twd_amount")), "nights twd_amount",
            ),
        ),
        "page_traffic": _stacked(
            kpis=(
                _wau_kpi(), "latest_week running_week",
                "latest_wau prev_wau wau_diff running_wau days_elapsed projected_wau projected_rest mean_wau",
            ),
            weeks=(weeks(f"SELECT yearweek, {day('week_start')} AS week_start, wau FROM shown"), "yearweek week_start", "wau"),
            channel_weeks=(weeks(f"SELECT {day('week_start')} AS week_start, channel, users FROM shown_channels"), "week_start channel", "users"),
            channel_order=(weeks("SELECT channel, cast(sum(users) AS bigint) AS users FROM shown_channels GROUP BY 1"), "channel", "users"),
            channel_kpis=(_channel_kpi(), "channel", "total_users users prev_users users_diff users_pct"),
        ),
    }


_PLACES = "(VALUES " + ", ".join(f"('{p}')" for p in rules.CRUISE_DESTINATIONS) + ") AS k(destination)"
_NAMED = "contains(replace(bnb_name, '地中海郵輪', ''), destination)"


def _dest_compare(kind: str) -> str:
    def side(table: str) -> str:
        return f"SELECT destination, count(*) AS n FROM {table} JOIN {_PLACES} ON {_NAMED} WHERE {_of(kind)} GROUP BY 1"
    return bookings(
        f""", w AS (SELECT destination, coalesce(a.n, 0) AS orders, coalesce(b.n, 0) AS prev_orders
  FROM ({side('cur')}) AS a FULL JOIN ({side('prev')}) AS b USING (destination))
SELECT *, orders - prev_orders AS orders_diff FROM w WHERE (SELECT sum(orders) FROM w) > 0
ORDER BY orders DESC, destination LIMIT 15"""
    )


def _leads(kind: str) -> str:
    return f""", leads AS (SELECT cast(floor((epoch(check_in) - epoch(order_date)) / 86400) AS bigint) AS lead
  FROM booked WHERE {_of(kind)} AND check_in IS NOT NULL AND order_date IS NOT NULL), kept AS (SELECT * FROM leads WHERE lead >= 0)"""


def _lead_histogram(kind: str) -> str:
    bins = ", ".join(
        f"({n}, '{label}', {low}, {high})"
        for n, (label, low, high) in enumerate(
            zip(rules.LEAD_TIME_LABELS, rules.LEAD_TIME_EDGES, rules.LEAD_TIME_EDGES[1:])
        )
    )
    return bookings(
        f"""{_leads(kind)} SELECT bin_no, lead_bin, count(lead) AS orders
FROM (VALUES {bins}) AS b(bin_no, lead_bin, low, high) LEFT JOIN kept ON lead > low AND lead <= high GROUP BY 1, 2"""
    )


def _lead_stats(kind: str) -> str:
    return bookings(
        f"""{_leads(kind)} SELECT median(lead) AS median_days, avg(lead) AS mean_days, median(lead) / 30 AS median_months
FROM kept"""
    )


def _rank(where: str, by: str, city: bool = False, region: bool = False) -> str:
    keys = ["bnb_id", "bnb_name"] + (["bnb_city"] if city else [])
    cols = ", ".join(keys)
    present = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    extra = f", {_REGION} AS region" if region else ""
    ranked = f""", c AS (SELECT {cols}, count(*) AS orders, sum(twd_amount) AS revenue FROM cur
  WHERE {where} AND {present} GROUP BY ALL),
p AS (SELECT bnb_id, count(*) AS prev_orders FROM prev WHERE {where} AND bnb_id IS NOT NULL GROUP BY 1),
j AS (SELECT {cols}, orders, revenue, coalesce(prev_orders, 0) AS prev_orders,
  orders - coalesce(prev_orders, 0) AS growth FROM c LEFT JOIN p USING (bnb_id))"""
    shown = f"{cols}, orders, revenue" + (", prev_orders, growth" if by == "growth" else "")
    return bookings(
        f"""{ranked} SELECT {shown}{extra}, row_number() OVER (ORDER BY {by} DESC, {cols}) AS rank_no FROM j
ORDER BY {by} DESC, {cols} LIMIT 10"""
    )


def _top(inner: str, by: str, n: int, ties: str) -> str:
    return bookings(f"SELECT * FROM ({inner}) ORDER BY {by} DESC, {ties} LIMIT {n}")


_TW_CITY = mapped("bnb_city", rules.TAIWAN_COUNTIES, "bnb_city")


def _regions(line: str, place: str) -> str:
    return f"""SELECT *, round_even(revenue / orders, 0) AS aov FROM
  ({summary(f'{place} AS region', where=f"product_line = '{line}' AND bnb_city IS NOT NULL")})"""


_GRID = f""", grid AS (SELECT * FROM (VALUES {", ".join(f"('{t}')" for t in rules.SEB_TYPES)}) AS t(seb_type)
  CROSS JOIN (VALUES {", ".join(f"('{c}')" for c in rules.SEB_COUNTRIES)}) AS c(seb_country)),
sold AS ({summary('seb_type | seb_country', where="product_line = 'SEB'")}),
cells AS (SELECT seb_type, seb_country, coalesce(orders, 0) AS orders, coalesce(revenue, 0) AS revenue
  FROM grid LEFT JOIN sold USING (seb_type, seb_country))"""


def _seb_pivot() -> str:
    names = {**COUNTRY_COLUMNS, None: "total"}
    columns = ", ".join(
        f"""{'cast(' if m == 'orders' else ''}coalesce(sum({m}){f" FILTER (WHERE seb_country = '{label}')" if label else ''}, 0)"""
        f"""{' AS bigint)' if m == 'orders' else ''} AS {name}_{m}"""
        for m in ("revenue", "orders") for label, name in names.items()
    )
    return bookings(
        f"""{_GRID} SELECT seb_type, {columns} FROM cells GROUP BY 1
UNION ALL SELECT '合計' AS seb_type, {columns} FROM cells"""
    )


def _pivot() -> str:
    columns = ", ".join(
        f"coalesce(sum(twd_amount) FILTER (WHERE product_line = '{line}'), 0) AS {name}"
        for line, name in LINE_COLUMNS.items()
    )
    return bookings(f"SELECT channel, {columns} FROM booked GROUP BY 1")


def _channel_compare() -> str:
    side = "SELECT channel, count(*) AS orders, sum(twd_amount) AS gmv, sum(twd_amount) / count(*) AS aov FROM"
    return bookings(
        f""", c AS ({side} cur GROUP BY 1), p AS ({side} prev GROUP BY 1),
j AS (SELECT channel, c.orders, coalesce(p.orders, 0) AS prev_orders, c.gmv, coalesce(p.gmv, 0) AS prev_gmv,
  c.aov, coalesce(p.aov, 0) AS prev_aov FROM c LEFT JOIN p USING (channel))
SELECT channel, orders, prev_orders, orders - prev_orders AS orders_diff, gmv, prev_gmv, gmv - prev_gmv AS gmv_diff,
  aov, prev_aov, aov - prev_aov AS aov_diff FROM j"""
    )


_ORDER_LIST = ", ".join(
    f"{stamp(c)} AS {c}" if c in ("order_date", "check_in", "check_out") else c for c in ORDER_COLUMNS
)
_SEARCHED = f"""product_line IN ({quoted(R.SEARCH_LINES)}) AND (regexp_matches(lower(order_id), '{R.SEARCH_WORD.lower()}')
  OR regexp_matches(lower(bnb_name), '{R.SEARCH_WORD.lower()}')
  OR regexp_matches(lower(coalesce(bnb_city, 'nan')), '{R.SEARCH_WORD.lower()}'))"""


def _week_of(column: str) -> str:
    january = f"make_date(cast(substr({column}, 1, 4) AS int), 1, 1)"
    return f"({january} - cast(dayofweek({january}) AS int) + 7 * (cast(substr({column}, 5, 2) AS int) - 1))"


_VALID = "regexp_matches(trim(_c0), '^[0-9]{{6}}$') AND try_cast({} AS double) IS NOT NULL"


def weeks(body: str) -> str:
    bucket = mapped("_c1", rules.CHANNEL_BUCKETS, "'直接/未知'")
    return f"""WITH feed AS ({testdata.RAW_WAU.format(orders='orders')}),
channel_feed AS ({testdata.RAW_CHANNEL_USERS.format(orders='orders')}),
wau AS (SELECT trim(_c0) AS yearweek, {_week_of('trim(_c0)')} AS week_start,
  cast(trunc(try_cast(_c1 AS double)) AS bigint) AS wau FROM feed WHERE {_VALID.format('_c1')}),
channels AS (SELECT {_week_of('trim(_c0)')} AS week_start, {bucket} AS channel,
  cast(sum(cast(trunc(try_cast(_c2 AS double)) AS bigint)) AS bigint) AS users
  FROM channel_feed WHERE {_VALID.format('_c2')} GROUP BY 1, 2),
shown AS (SELECT * FROM wau ORDER BY week_start DESC, yearweek DESC LIMIT {R.WAU_ROWS}),
shown_channels AS (SELECT * FROM channels WHERE week_start IN (SELECT week_start FROM shown))
{body}"""


def _wau_kpi() -> str:
    days = f"least({AS_OF} - {SUNDAY} + 1, 7)"
    return weeks(
        f""", done AS (SELECT *, row_number() OVER (ORDER BY week_start DESC, yearweek DESC) AS rn FROM shown
  WHERE week_start < {SUNDAY}),
latest AS (SELECT * FROM done WHERE rn = 1), before AS (SELECT * FROM done WHERE rn = 2),
running AS (SELECT *, cast(round_even(wau / {days} * 7, 0) AS bigint) AS projected FROM shown
  WHERE week_start = {SUNDAY} ORDER BY yearweek LIMIT 1)
SELECT {day('latest.week_start')} AS latest_week, latest.wau AS latest_wau, coalesce(before.wau, 0) AS prev_wau,
  CASE WHEN before.wau <> 0 THEN latest.wau - before.wau END AS wau_diff,
  {day('running.week_start')} AS running_week, running.wau AS running_wau,
  CASE WHEN running.wau IS NOT NULL THEN cast({days} AS bigint) END AS days_elapsed,
  running.projected AS projected_wau, running.projected - running.wau AS projected_rest,
  (SELECT cast(trunc(avg(wau)) AS bigint) FROM shown) AS mean_wau
FROM latest LEFT JOIN before ON true LEFT JOIN running ON true"""
    )


def _channel_kpi() -> str:
    return weeks(
        f""", done AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY week_start DESC) AS rn
  FROM shown_channels WHERE week_start < {SUNDAY})
SELECT t.channel, t.total_users, a.users, b.users AS prev_users, a.users - b.users AS users_diff,
  CASE WHEN b.users <> 0 THEN (a.users - b.users) / b.users * 100 END AS users_pct
FROM (SELECT channel, cast(sum(users) AS bigint) AS total_users FROM shown_channels GROUP BY 1) AS t
LEFT JOIN done AS a ON a.channel = t.channel AND a.rn = 1
LEFT JOIN done AS b ON b.channel = t.channel AND b.rn = 2"""
    )


def _insight_lines(period) -> str:
    arrow = "CASE WHEN {0} > 0 THEN '↑' ELSE '↓' END || ' ' || format('{{:.1f}}', abs({0})) || '%'"
    market = mapped("product_line", MARKETS)
    return f""", t AS (SELECT
    (SELECT coalesce(sum(twd_amount), 0) FROM cur) AS rev, (SELECT coalesce(sum(twd_amount), 0) FROM prev) AS prev_rev,
    (SELECT count(*) FROM cur) AS n, (SELECT count(*) FROM prev) AS prev_n,
    (SELECT count(*) FROM cur WHERE booking_status = 'canceled') AS canceled),
tt AS (SELECT *, {_pct('rev', 'prev_rev')} AS rev_pct, {_pct('n', 'prev_n')} AS n_pct, canceled / n * 100 AS rate FROM t),
pl AS (SELECT product_line, count(*) AS n, sum(twd_amount) AS rev, avg(nights) AS nights,
  row_number() OVER (ORDER BY sum(twd_amount) DESC, product_line) AS pos FROM cur GROUP BY 1),
ct AS (SELECT cruise_type, count(*) AS n, sum(twd_amount) AS rev,
  row_number() OVER (ORDER BY sum(twd_amount) DESC, cruise_type) AS pos FROM cur WHERE product_line = 'Cruise' GROUP BY 1),
peak AS (SELECT strftime(check_in, '%Y-%m') AS month, count(*) AS n FROM cur
  WHERE product_line = 'Cruise' AND check_in > timestamp '{R.AS_OF}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
city AS (SELECT product_line, bnb_city, row_number() OVER (PARTITION BY product_line
  ORDER BY sum(twd_amount) DESC, bnb_city) AS pos FROM cur WHERE bnb_city IS NOT NULL GROUP BY 1, 2),
ch AS (SELECT channel, sum(twd_amount) AS rev, row_number() OVER (ORDER BY sum(twd_amount) DESC, channel) AS pos
  FROM cur GROUP BY 1),
entries AS (
  SELECT 1 AS section_no, 1 AS ord, 'period' AS subject, cast(NULL AS double) AS value, cast(NULL AS double) AS pct,
    cast(NULL AS bigint) AS orders, '- 統計期間：{period.start} ～ {period.end}（共 {period.days} 天）' AS line FROM tt
  UNION ALL SELECT 1, 2, 'revenue', rev, rev_pct, NULL, '- 本期營收 NT$' || format('{{:,.0f}}', rev)
    || CASE WHEN prev_rev > 0 THEN '，較前期 ' || {arrow.format('rev_pct')} || '（前期 NT$' || format('{{:,.0f}}', prev_rev) || '）'
       ELSE '' END FROM tt
  UNION ALL SELECT 1, 3, 'orders', NULL, n_pct, n, '- 本期訂單數 ' || format('{{:,}}', n) || ' 筆'
    || CASE WHEN prev_n > 0 THEN '，較前期 ' || {arrow.format('n_pct')} || '（前期 ' || format('{{:,}}', prev_n) || ' 筆）'
       ELSE '' END FROM tt
  UNION ALL SELECT 2, pos, product_line, pl.rev, pl.rev / tt.rev * 100, pl.n, '- **' || product_line || '**：NT$'
    || format('{{:,.0f}}', pl.rev) || '（' || format('{{:.1f}}', pl.rev / tt.rev * 100) || '%），' || pl.n || ' 單' FROM pl, tt
  UNION ALL SELECT 3, pos, cruise_type, rev, rev / (SELECT sum(rev) FROM ct) * 100, n, '- ' || cruise_type || '：NT$'
    || format('{{:,.0f}}', rev) || '（' || format('{{:.1f}}', rev / (SELECT sum(rev) FROM ct) * 100) || '%）' FROM ct
  UNION ALL SELECT 3, 100, 'mean_nights', nights, NULL, NULL, '- 平均出遊晚數：' || format('{{:.1f}}', nights) || ' 晚'
    FROM pl WHERE product_line = 'Cruise'
  UNION ALL SELECT 3, 101, 'peak_month', NULL, NULL, n, '- 未來出發最熱月份：' || month FROM peak
  UNION ALL SELECT 4, CASE product_line WHEN 'TW' THEN 1 WHEN 'JP' THEN 2 ELSE 3 END, {market}, rev, NULL, NULL,
    '- **' || {market} || '**：NT$' || format('{{:,.0f}}', rev) || '，熱門城市 ' || coalesce(bnb_city, '–')
    FROM pl LEFT JOIN (SELECT product_line, bnb_city FROM city WHERE pos = 1) AS best USING (product_line)
    WHERE product_line IN ('TW', 'JP', 'KR')
  UNION ALL SELECT 5, pos, channel, rev, NULL, NULL, '- **' || channel || '**：NT$' || format('{{:,.0f}}', rev)
    FROM ch WHERE pos <= 5
  UNION ALL SELECT 6, 0, 'canceled', NULL, rate, canceled, '⚠️ 取消率偏高：' || format('{{:.1f}}', rate) || '%（超過 15% 警戒線）'
    FROM tt WHERE rate > 15
  UNION ALL SELECT 6, pos, product_line, NULL, NULL, n, '⚠️ **' || product_line || '** 訂單量極少（' || n || ' 單），可能需要關注'
    FROM pl WHERE n < 10),
lines AS (SELECT section_no, row_number() OVER (PARTITION BY section_no ORDER BY ord) AS line_no,
  subject, value, pct, orders, line FROM entries)"""


def _insights(period=R.HALVES) -> str:
    return bookings(f"{_insight_lines(period)} SELECT * FROM lines", period)


def _report() -> str:
    heading = "CASE section_no " + " ".join(f"WHEN {n} THEN '{h}'" for n, h in HEADINGS.items()) + " END"
    return bookings(
        f"""{_insight_lines(R.HALVES)}, sections AS (SELECT section_no,
  {heading} || chr(10) || string_agg(line, chr(10) ORDER BY line_no) AS body FROM lines GROUP BY 1)
SELECT string_agg(body, chr(10) || chr(10) ORDER BY section_no) AS report FROM sections"""
    )


def _clean() -> str:
    from wayledger.operators.clean import CLEAN_COLUMNS, MOMENTS

    return bookings("SELECT " + ", ".join(f"{stamp(c)} AS {c}" if c in MOMENTS else c for c in CLEAN_COLUMNS) + " FROM clean")


def _line(name: str) -> str:
    return f"product_line = '{name}'"


def _seb_cross() -> str:
    return bookings(
        f"""{_GRID} SELECT coalesce(seb_type, '合計') AS seb_type, coalesce(seb_country, '合計') AS seb_country,
cast(sum(orders) AS bigint) AS orders, sum(revenue) AS revenue,
CASE WHEN grouping(seb_type) = 0 AND grouping(seb_country) = 0 AND sum(revenue) > 0
  THEN sqrt(sum(revenue) / (SELECT max(revenue) FROM cells)) END AS intensity
FROM cells GROUP BY CUBE (seb_type, seb_country)"""
    )


def _seb_order() -> str:
    return bookings(
        f"""{_GRID}, totals AS (SELECT seb_type, sum(revenue) AS revenue, cast(sum(orders) AS bigint) AS orders
FROM cells GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY revenue DESC, seb_type) AS by_revenue,
row_number() OVER (ORDER BY orders DESC, seb_type) AS by_orders FROM totals"""
    )


def _top_products() -> str:
    return bookings(
        f"""SELECT *, row_number() OVER (ORDER BY revenue DESC, bnb_name, product_line) AS rank_no,
revenue / orders AS avg_order FROM ({summary('bnb_name | product_line')}) ORDER BY revenue DESC, bnb_name, product_line LIMIT 10"""
    )


def _brand_days() -> str:
    return bookings(
        f"""SELECT {_BRAND} AS brand, cast(nights + 1 AS varchar) || ' 天' AS days, sum(twd_amount) AS revenue
FROM booked WHERE {_of(rules.HOMEPORT)} GROUP BY 1, 2"""
    )


def oracle() -> dict[str, str]:
    cruise = _line("Cruise")
    home, fly = rules.HOMEPORT, rules.FLY_CRUISE
    jp_regions = _regions("JP", "bnb_city")
    return {
        "clean_bookings": _clean(),
        "period_bounds": _periods(),
        "affiliate_options": bookings(
            f"""SELECT channel, max(n) AS top_count FROM (SELECT {_CHANNEL} AS channel, count(*) AS n FROM clean
GROUP BY affiliate_id, 1) GROUP BY 1"""
        ),
        "status_options": bookings("SELECT DISTINCT booking_status FROM clean WHERE booking_status IS NOT NULL"),
        "filtered_bookings": bookings(
            f"""SELECT {_ORDER_LIST} FROM booked WHERE {_between('1996-01-01', '2001-06-30')}
AND product_line IN ({quoted(R.FILTER_LINES)}) AND booking_status IN ({quoted(R.FILTER_STATUSES)})
AND channel IN ({quoted(R.FILTER_CHANNELS)})"""
        ),
        "kpi_overview": _kpis(),
        "kpi_overview_90d": _kpis(R.LAST_90),
        "kpi_by_line": _kpi_by_line(),
        "product_line_summary": bookings(summary("product_line")),
        "product_line_share": _with_share(summary("product_line")),
        "product_line_detail": _line_detail(),
        "product_line_detail_90d": _line_detail(R.LAST_90),
        "top_products": _top_products(),
        "revenue_trend_day": _trend("d", "1 DAY", "b"),
        "revenue_trend_week": _trend(_WEEK, "7 DAY", "b + 6"),
        "revenue_trend_month": _trend("date_trunc('month', d)", "1 MONTH", "last_day(b)"),
        "gmv_ohlc_week": bookings(f"{_ohlc(f'{_WEEK} + 6')} SELECT * FROM bars"),
        "gmv_ohlc_month": bookings(f"{_ohlc('last_day(d)')} SELECT * FROM bars"),
        "gmv_ohlc_ma": bookings(f"{_ohlc(f'{_WEEK} + 6')} SELECT *, {_averages()} FROM bars"),
        "holiday_clusters": _holidays(),
        "kpi_cruise": _kpi_cruise(),
        "cruise_type_summary": bookings(summary("cruise_type", where=cruise)),
        "cruise_by_brand": bookings(summary(f"{_BRAND} AS brand | cruise_type", where=cruise)),
        "cruise_ship_summary": bookings(summary(f"{_SHIP} AS ship", where=_of(fly))),
        "homeport_ship_summary": bookings(summary(f"{_HOME_SHIP} AS ship", where=_of(home))),
        "cruise_checkin_distribution": bookings(summary(f"{MONTH} AS check_in_month | cruise_type", where=cruise)),
        "cruise_nights_distribution": bookings(f"SELECT nights, count(*) AS orders FROM booked WHERE {cruise} GROUP BY 1"),
        "homeport_brand_days": _brand_days(),
        "cruise_month_brand": bookings(
            f"""SELECT cruise_type, {MONTH} AS check_in_month, {_BRAND} AS brand, count(*) AS orders
FROM booked WHERE {cruise} GROUP BY 1, 2, 3"""
        ),
        "homeport_ship_compare": _ship_compare(home, _HOME_SHIP),
        "fly_ship_compare": _ship_compare(fly, _SHIP),
        "homeport_days_compare": _days_compare(),
        "homeport_rank_orders": _rank(_of(home), "orders"),
        "fly_rank_growth": _rank(_of(fly), "growth"),
        "homeport_ship_options": bookings(f"SELECT DISTINCT {_HOME_SHIP} AS ship FROM booked WHERE {_of(home)}"),
        "cruise_destination_heat": bookings(
            f"""SELECT destination, count(*) AS orders, sum(twd_amount) AS revenue FROM booked JOIN {_PLACES} ON {_NAMED}
WHERE {cruise} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""
        ),
        "dest_heat_compare": _dest_compare(fly),
        "homeport_dest_heat_compare": _dest_compare(home),
        "lead_time_histogram": _lead_histogram(home),
        "lead_time_stats": _lead_stats(home),
        "fly_lead_time_histogram": _lead_histogram(fly),
        "fly_lead_time_stats": _lead_stats(fly),
        "git_region_distribution": _with_share(summary(f"{_REGION} AS region", where=_line("GIT"))),
        "git_top_products": _top(summary("bnb_name", where=_line("GIT")), "revenue", 20, "bnb_name"),
        "git_region_options": bookings(f"SELECT DISTINCT {_REGION} AS region FROM booked WHERE {_line('GIT')}"),
        "git_rank_orders": _rank(_line("GIT"), "orders", region=True),
        "git_rank_growth": _rank(_line("GIT"), "growth", region=True),
        "stay_region_stats": bookings(_regions("TW", _TW_CITY)),
        "stay_region_revenue_top": _top(_regions("TW", _TW_CITY), "revenue", 20, "region"),
        "stay_region_aov_top": bookings(
            f"""SELECT * FROM ({jp_regions}) WHERE orders >= 5
OR NOT EXISTS (SELECT * FROM ({jp_regions}) WHERE orders >= 5) ORDER BY aov DESC, region LIMIT 20"""
        ),
        "accommodation_region": _top(summary("bnb_city", where=_line("KR")), "revenue", 20, "bnb_city"),
        "tw_city_geo": bookings(summary(f"{mapped('bnb_city', rules.TAIWAN_COUNTIES)} AS county", where=_line("TW"))),
        "stay_view_split": bookings(
            " UNION ALL ".join(
                f"""SELECT product_line, '{view}' AS view, count(*) AS orders, sum(twd_amount) AS revenue FROM booked
WHERE product_line IN ('TW', 'KR', 'JP') AND {condition} GROUP BY 1"""
                for view, condition in (
                    (rules.STAY_VIEW_ALL, "true"),
                    (rules.STAY_VIEW_WHOLE, "bnb_type IS NOT DISTINCT FROM 'Bnb / Apartment'"),
                    (rules.STAY_VIEW_ROOMS, "bnb_type IS DISTINCT FROM 'Bnb / Apartment'"),
                )
            )
        ),
        "stay_type_share": bookings(summary("bnb_type", where=_line("TW"))),
        "hoshino_orders": bookings(
            summary("bnb_name", where=f"{_line('JP')} AND (contains(bnb_name, '星野') OR contains(lower(bnb_name), 'hoshino'))")
        ),
        "stay_rank_orders": _rank(_line("JP"), "orders", city=True),
        "stay_rank_growth": _rank(_line("KR"), "growth", city=True),
        "seb_type_summary": bookings(summary("seb_type", where=_line("SEB"))),
        "seb_country_summary": bookings(summary("seb_country", where=_line("SEB"))),
        "seb_cross": _seb_cross(),
        "seb_cross_pivot": _seb_pivot(),
        "seb_type_order": _seb_order(),
        "line_top_products": _top(summary("bnb_name", where=_line("SEB")), "revenue", 20, "bnb_name"),
        "line_type_share": bookings(summary("bnb_type", where=_line("高鐵"))),
        "checkin_monthly": bookings(summary(f"{MONTH} AS check_in_month", where=_line("GIT"))),
        "platform_share": bookings(
            f"SELECT platform, count(*) AS orders FROM booked WHERE {_line('eSIM')} AND platform IS NOT NULL GROUP BY 1"
        ),
        "product_rank_orders": _rank("true", "orders"),
        "product_rank_growth": _rank("true", "growth"),
        "marketing_channel": bookings(summary("channel | product_line")),
        "channel_summary": bookings(
            """SELECT channel, count(*) AS orders, sum(twd_amount) AS gmv, sum(twd_amount) / count(*) AS aov
FROM booked GROUP BY 1"""
        ),
        "channel_compare": _channel_compare(),
        "channel_line_pivot": _pivot(),
        "order_search": bookings(f"SELECT {_ORDER_LIST} FROM booked WHERE {_SEARCHED}"),
        "order_search_summary": bookings(
            f"SELECT count(*) AS orders, coalesce(sum(twd_amount), 0) AS revenue FROM booked WHERE {_SEARCHED}"
        ),
        "wau_weekly": weeks(f"SELECT yearweek, {day('week_start')} AS week_start, wau FROM wau"),
        "wau_channel_weekly": weeks(f"SELECT {day('week_start')} AS week_start, channel, users FROM channels"),
        "wau_kpi": _wau_kpi(),
        "wau_channel_window": weeks(f"SELECT {day('week_start')} AS week_start, channel, users FROM shown_channels"),
        "wau_channel_order": weeks("SELECT channel, cast(sum(users) AS bigint) AS users FROM shown_channels GROUP BY 1"),
        "wau_channel_kpi": _channel_kpi(),
        "insights": _insights(),
        "insights_90d": _insights(R.LAST_90),
        "insight_report": _report(),
        **_pages(),
    }
