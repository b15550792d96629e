"""Edge cases on literal rows."""

import csv
from datetime import date

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from wayledger.functions import rules
from wayledger.functions.calendar import yearweek_to_sunday
from wayledger.operators import filters, periods, trends
from wayledger.operators.clean import clean_bookings
from wayledger.operators.measures import compare
from wayledger.operators.periods import Period, flag_periods
from wayledger.operators.ranking import product_rank
from wayledger.plans import channels, cruise, overview, stays, traffic
from wayledger.plans.orders import order_list, order_totals
from wayledger.sources.bookings import (
    STAGING, SourceTableError, compact, finish_swaps, read_bookings_csv, read_clean, replace_month, write_clean, write_order_list,
)
from wayledger.sources.traffic import read_feed, weekly_channel_users, weekly_users
from wayledger.streaming.ingest import ingest

WEEK = Period.before(date(2024, 3, 4), date(2024, 3, 10))
NOW, BEFORE = "2024-03-05", "2024-02-28"


def rows(table):
    return [tuple(row) for row in table.collect()]


# -- coercion ---------------------------------------------------------------

@pytest.mark.parametrize(
    ("text", "count"),
    [("3", 3), ("2.7", 2), ("-2.7", -2), (" 4 ", 4), ("1e3", 1000), ("+5", 5), (".9", 0), ("x", 0), ("1d", 0),
     ("NaN", 0), ("Infinity", 0), ("", 0), (None, 0), ("99999999999999999999999999999999999999999", 0)],
)
def test_counts(clean, text, count):
    assert clean({"nights": text}).first().nights == count


@pytest.mark.parametrize(
    ("text", "amount"),
    [("2,100", 2100.0), ("1,234,567.5", 1234567.5), ("-30", -30.0), ("n/a", 0.0), (None, 0.0), ("5f", 0.0), ("12.34", 12.34)],
)
def test_amounts(clean, text, amount):
    assert clean({"twd_amount": text}).first().twd_amount == amount


@pytest.mark.parametrize(
    ("text", "shown"),
    [("2024-01-05", "2024-01-05 00:00:00"), ("2024/1/6", "2024-01-06 00:00:00"),
     ("2024-01-05 15:30:00", "2024-01-05 15:30:00"), ("bad-date", None), ("2024-02-30", None), (None, None), ("", None)],
)
def test_dates(clean, text, shown):
    moment = clean({"order_date": text}).select(F.date_format("order_date", "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert moment == shown


@pytest.mark.parametrize("blank", ["", "  ", "　", "\t\x1f ", None])
def test_blank_ids_are_dropped(clean, blank):
    assert clean({"order_id": blank}, {"order_id": "　A"}).count() == 1


@pytest.mark.parametrize(
    ("name", "tidy"),
    [(" a　　b\tc ", "a b c"), ("<translate=7>海 島</translate>", "海 島"), ("a  b", "a b"), ("\x1ca\x85", "a"),
     (None, "nan"), ("<b>x</b>", "<b>x</b>"), ("<translate>　x", "x")],
)
def test_names(clean, name, tidy):
    assert clean({"bnb_name": name}).first().bnb_name == tidy


def test_pseudo_order_hidden_by_markup(clean):
    assert clean({"bnb_name": "補<translate=1>款"}).isEmpty()
    assert clean({"bnb_name": "補 款"}).count() == 1


def test_large_numbers_keep_their_value(clean):
    def amount(text):
        return clean({"twd_amount": text}).first().twd_amount
    for text in ("1e19", "9999999999999999999", "-12345678901234567890123.5", "1e300", " 3.5e2 ", "1,234,567,890,123,456,789,012"):
        assert amount(text) == float(text.replace(",", ""))
    for text in ("1d", "1f", "NaN", "inf", "0x10", "1e", ".", "--1", "1 2"):
        assert amount(text) == 0
    counts = clean({"guests": "1e19", "adult": "2.9e3", "child": "-7.9", "nights": "12345678901234567890"}).first()
    assert (counts.guests, counts.adult, counts.child, counts.nights) == (0, 2900, -7, 0)


def test_date_forms_and_unreadable_dates(spark, raw, tmp_path):
    table = raw(
        *({"order_date": d} for d in ("1/5/2024", "20240105", "2024.1.5", "2024/1/5", "5 January", None)),
        {"order_date": "2024-01-05", "check_in": "soon", "check_out": "20240107"},
    )
    seen = Observation()
    write_clean(clean_bookings(table, ["M/d/yyyy", "yyyyMMdd", "yyyy.M.d"], seen), str(tmp_path / "clean"))
    assert seen.get == {"unreadable_order_date": 1, "unreadable_check_in": 1, "unreadable_check_out": 0}
    days = [r.order_date and r.order_date.date() for r in read_clean(spark, str(tmp_path / "clean")).collect()]
    assert sorted(days, key=str) == [date(2024, 1, 5)] * 5 + [None] * 2
    assert clean_bookings(table).filter("order_date is not null").count() == 2


# -- sources ----------------------------------------------------------------

HEADER = (
    "twd_amount,order_date,order_id,booking status,platform,bnb city,bnb_id,bnb_name,bnb_type,check_in,check_out,"
    "tags,column switch 1,column switch 2,column switch 3,guests,adult,child,nights,rooms"
)
LINE = '"2,100",2024-03-05,A1,completed,web,NA,B1,"二行\n名稱 ""引號""",Hotel,2024-04-01,,null,,-,Taiwan,2,2,0,2.7,1'


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_binds_by_name(spark, tmp_path):
    row = read_bookings_csv(spark, write(tmp_path / "b.csv", f"{HEADER}\n{LINE}\n"), "keep").first()
    assert (row.twd_amount, row.order_id, row.booking_status) == ("2,100", "A1", "completed")
    assert (row.bnb_city, row.tags, row.affiliate_id, row.coupon) == (None, None, None, "-")
    assert row.bnb_name == '二行\n名稱 "引號"'


@pytest.mark.parametrize(
    "text",
    ["#REF!,order_date\n1,2\n", "order_id,twd_amount\n1,2\n", f"{HEADER}\n", "order_date\n2024-01-01\n"],
)
def test_unusable_sources(spark, tmp_path, text):
    with pytest.raises(SourceTableError):
        read_bookings_csv(spark, write(tmp_path / "b.csv", text))


ONE_LINE = LINE.replace("\n", "")


def test_files_bind_their_own_headers(spark, tmp_path):
    """Other column order, a further column, a byte-order mark, an empty file; further columns and unnamed ones do not matter."""
    names = HEADER.split(",")
    values = dict(zip(names, next(csv.reader([ONE_LINE])), strict=True))
    turned = ["comment", *reversed(names), "", "comment"]
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "1.csv", f"{HEADER}\n{ONE_LINE}\n{ONE_LINE}\n")
    with open(tmp_path / "in" / "2.csv", "w", encoding="utf-8-sig", newline="") as out:
        rows = csv.writer(out)
        rows.writerows([turned, ["x, y", *(values[n] for n in reversed(names)), "z", "w"]])
    write(tmp_path / "in" / "3.csv", "")
    found = read_bookings_csv(spark, str(tmp_path / "in")).collect()
    assert len(found) == 3 and len(set(found)) == 1
    assert (found[0].twd_amount, found[0].bnb_name, found[0].rooms) == ("2,100", '二行名稱 "引號"', "1")
    write(tmp_path / "in" / "4.csv", "order_date\n2024-01-01\n")
    with pytest.raises(SourceTableError, match="4.csv"):
        read_bookings_csv(spark, str(tmp_path / "in"))


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    lines = [ONE_LINE.replace("A1", f"A{i}") for i in range(3000)]
    path = write(tmp_path / "b.csv", "\n".join([HEADER, *lines]) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        table, whole = read_bookings_csv(spark, path), read_bookings_csv(spark, path, "keep")
        assert table.rdd.getNumPartitions() > 5 and whole.rdd.getNumPartitions() == 1
        assert table.select("order_id").distinct().count() == table.count() == 3000
        assert table.exceptAll(whole).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_broken_lines_are_refused_or_counted(spark, tmp_path):
    short = ",".join(ONE_LINE.split(",")[:12])
    path = write(tmp_path / "b.csv", "\n".join([HEADER, ONE_LINE, LINE, short, ONE_LINE]) + "\n")
    for action in (lambda t: t.count(), lambda t: t.select("order_id").collect()):
        with pytest.raises(Exception, match="broken over several lines"):
            action(read_bookings_csv(spark, path))
    seen = Observation()
    assert read_bookings_csv(spark, path, "count", seen).count() == 2
    assert (seen.get["broken_lines"], seen.get["ragged_lines"]) == (2, 1)
    kept = read_bookings_csv(spark, path, "keep").collect()
    assert len(kept) == 4 and [r.rooms for r in kept] == ["1", "1", None, "1"]
    with pytest.raises(ValueError, match="observation"):
        read_bookings_csv(spark, path, "count")
    with pytest.raises(SourceTableError, match="line break"):
        read_bookings_csv(spark, write(tmp_path / "h.csv", 'order_date,"a\nb"\n1,2\n'))


def test_missing_feeds_are_empty(spark, tmp_path):
    nowhere = str(tmp_path / "nowhere.csv")
    assert weekly_users(read_feed(spark, nowhere, 2)).columns == ["yearweek", "week_start", "wau"]
    assert weekly_users(read_feed(spark, nowhere, 2)).isEmpty()
    assert weekly_channel_users(read_feed(spark, nowhere, 3)).isEmpty()


def test_feed_junk_and_year_boundary(spark, tmp_path):
    wau = write(tmp_path / "w.csv", "yearWeek,activeUsers\n202353,10\n 202401 ,12.9\n202402,x\n2024,5\n")
    assert rows(weekly_users(read_feed(spark, wau, 2))) == [
        ("202353", date(2023, 12, 31), 10), ("202401", date(2023, 12, 31), 12),
    ]
    channel = write(tmp_path / "c.csv", "202353,Email,4\n202401,SMS,5\n202401,Mystery,1\n202401,,2\n")
    assert rows(weekly_channel_users(read_feed(spark, channel, 3))) == [
        (date(2023, 12, 31), "CRM", 9), (date(2023, 12, 31), "直接/未知", 3),
    ]


def test_only_junk_is_an_empty_feed(spark, tmp_path):
    assert weekly_users(read_feed(spark, write(tmp_path / "w.csv", "a,b\n"), 2)).isEmpty()


def test_yearweek(spark):
    table = spark.createDataFrame([("202401",), ("202410",), ("199501",), ("200001",)], "yw string")
    found = [r[0] for r in table.select(yearweek_to_sunday(F.col("yw"))).collect()]
    assert found == [date(2023, 12, 31), date(2024, 3, 3), date(1995, 1, 1), date(1999, 12, 26)]


def test_order_list_export(spark, clean, tmp_path):
    table = clean(
        {"order_id": "A", "order_date": "2024-03-01"}, {"order_id": "B", "order_date": "2024-03-02", "check_in": "2024-04-01 08:00:00"},
        {"order_id": "C", "order_date": None, "bnb_name": '逗號, "引號"'},
    )
    assert [r.order_id for r in order_list(table).collect()] == ["B", "A", "C"]
    out = str(tmp_path / "orders")
    write_order_list(order_list(table).coalesce(1), out)
    back = spark.read.option("header", True).option("escape", '"').csv(out)
    assert back.columns[:2] == ["訂單編號", "下單日期"] and len(back.columns) == 11
    shown = {r["訂單編號"]: r for r in back.collect()}
    assert shown["B"]["下單日期"] == "2024-03-02" and shown["B"]["入住/出發"] == "2024-04-01 08:00:00"
    assert shown["C"]["下單日期"] is None and shown["C"]["商品名稱"] == '逗號, "引號"'


def inbox(tmp_path):
    (tmp_path / "in").mkdir()
    return [str(tmp_path / n) for n in ("in", "clean", "mark")]


def test_stream_ingests_each_file_once(spark, tmp_path):
    source, target, mark = inbox(tmp_path)
    write(tmp_path / "in" / "1.csv", f"{HEADER}\n{ONE_LINE}\n")
    ingest(spark, source, target, mark).awaitTermination()
    assert read_clean(spark, target).count() == 1
    names = HEADER.split(",")
    values = dict(zip(names, next(csv.reader([ONE_LINE.replace("A1", "A2")])), strict=True))
    with open(tmp_path / "in" / "2.csv", "w", newline="") as out:  # another column order
        csv.writer(out).writerows([names[::-1], [values[n] for n in names[::-1]]])
    write(tmp_path / "in" / "3.csv", f"{HEADER}\n")
    ingest(spark, source, target, mark).awaitTermination()
    ingest(spark, source, target, mark).awaitTermination()
    found = read_clean(spark, target).orderBy("order_id").collect()
    assert [(r.order_id, r.twd_amount, r.nights, r.product_line) for r in found] == [("A1", 2100.0, 2, "TW"), ("A2", 2100.0, 2, "TW")]


def test_repeated_batch_counts_once(spark, tmp_path):
    """A batch whose end was not noted down runs again; so does one that left half of its files."""
    source, target, mark = inbox(tmp_path)
    write(tmp_path / "in" / "1.csv", f"{HEADER}\n{ONE_LINE}\n")
    ingest(spark, source, target, mark).awaitTermination()
    write(tmp_path / "in" / "2.csv", "\n".join([HEADER, *(ONE_LINE.replace("A1", f"B{i}") for i in range(7))]) + "\n")
    ingest(spark, source, target, mark).awaitTermination()
    last = max((tmp_path / "mark" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    half = next(p for p in (tmp_path / "clean").rglob("*.parquet") if p.parent.name.endswith("1"))
    (half.parent / "part-half.parquet").write_bytes(half.read_bytes())
    assert read_clean(spark, target).count() > 8
    ingest(spark, source, target, mark).awaitTermination()
    assert read_clean(spark, target).count() == 8
    fresh = str(tmp_path / "other-mark")  # another stream's first batch does not replace this stream's
    write(tmp_path / "in" / "3.csv", f"{HEADER}\n{ONE_LINE}\n")
    ingest(spark, source, target, fresh).awaitTermination()
    assert read_clean(spark, target).count() == 8 + 9


def stored_files(tmp_path, month):
    return sorted(p.name for p in (tmp_path / "clean" / f"order_month={month}").rglob("*.parquet"))


def test_one_month_is_replaced_alone(spark, raw, tmp_path):
    target = str(tmp_path / "clean")
    write_clean(clean_bookings(raw(*({"order_id": f"F{m}{i}", "order_date": f"2024-0{m}-05"} for m in (1, 2, 3) for i in range(4)))), target)
    write_clean(clean_bookings(raw({"order_id": "S", "order_date": "2024-02-06"})), target, "stream-0000000001")
    before = {m: stored_files(tmp_path, f"2024-0{m}") for m in (1, 3)}
    again = clean_bookings(raw({"order_id": "N", "order_date": "2024-02-07"}))
    replace_month(again, target, "2024-02")
    assert {m: stored_files(tmp_path, f"2024-0{m}") for m in (1, 3)} == before
    table = read_clean(spark, target)
    assert [r.order_id for r in table.filter("order_month = '2024-02'").collect()] == ["N"] and table.count() == 9
    with pytest.raises(Exception, match="outside 2024-03"):
        replace_month(again, target, "2024-03")
    assert read_clean(spark, target).count() == 9
    # a swap that stopped after the old month was deleted is finished by the next one, half a staged month is dropped
    staged = tmp_path / "clean" / STAGING
    staged.mkdir()
    (tmp_path / "clean" / "order_month=2024-01").rename(staged / "order_month=2024-01")
    (staged / "order_month=2024-01" / "_SUCCESS").touch()
    (staged / "order_month=2024-03").mkdir()
    finish_swaps(spark, target)
    assert read_clean(spark, target).count() == 9 and not staged.exists()


def test_increments_are_compacted(spark, raw, tmp_path):
    target = str(tmp_path / "clean")
    write_clean(clean_bookings(raw({"order_id": "F"}, {"order_id": "G", "order_date": "x"})), target)
    for n in range(6):
        write_clean(clean_bookings(raw({"order_id": f"S{n}"}, {"order_id": f"T{n}", "order_date": None})), target, f"a-b-{n:010d}")
    ids = sorted(r.order_id for r in read_clean(spark, target).collect())
    assert compact(spark, target, most_files=4) == ["2024-03", "__HIVE_DEFAULT_PARTITION__"]
    assert sorted(r.order_id for r in read_clean(spark, target).collect()) == ids and len(ids) == 14
    assert len(stored_files(tmp_path, "2024-03")) == 2  # the newest batch stays apart and can still be repeated
    write_clean(clean_bookings(raw({"order_id": "S5"}, {"order_id": "T5", "order_date": None})), target, "a-b-0000000005")
    assert sorted(r.order_id for r in read_clean(spark, target).collect()) == ids
    assert compact(spark, target, most_files=4) == []


# -- filters and periods ----------------------------------------------------

def test_end_is_midnight_and_null_dates_fail(clean):
    table = clean({"order_date": "2024-03-10 15:00:00"}, {"order_date": "2024-03-10"}, {"order_date": None})
    assert filters.filter_bookings(table, end=date(2024, 3, 10)).count() == 1
    assert filters.filter_bookings(table).count() == 3


def test_status_selection(clean):
    table = clean({"booking_status": None}, {"booking_status": "completed"}, {"booking_status": "canceled"})
    assert filters.filter_bookings(table).count() == 2
    assert filters.filter_bookings(table, statuses=[]).count() == 3
    assert filters.filter_bookings(table, statuses=["canceled"]).count() == 1


def test_channel_selection(clean):
    table = clean(*[{"affiliate_id": a} for a in (None, "", "-", "0", " ", "　", "nan", "aff", " aff ")])
    assert filters.filter_bookings(table, channels=[rules.DIRECT_CHANNEL]).count() == 7
    assert filters.filter_bookings(table, channels=["aff"]).count() == 1
    assert filters.filter_bookings(table, channels=[" aff ", rules.DIRECT_CHANNEL]).count() == 8
    assert filters.filter_bookings(table, channels=[]).count() == 0
    assert filters.filter_bookings(table).count() == 9


def test_channel_options_rank_by_raw_spelling(clean):
    raw_ids = [None] * 2 + ["-"] * 2 + ["a"] * 3 + ["b"]
    assert [r.channel for r in filters.channel_options(clean(*[{"affiliate_id": a} for a in raw_ids])).collect()] == [
        "a", rules.DIRECT_CHANNEL, "b",
    ]


def test_stay_views_put_missing_types_with_rooms(clean):
    table = clean({"bnb_type": None}, {"bnb_type": "Hotel"}, {"bnb_type": "Bnb / Apartment"})
    assert [filters.stay_view(table, v).count() for v in (rules.STAY_VIEW_WHOLE, rules.STAY_VIEW_ROOMS, rules.STAY_VIEW_ALL)] == [1, 2, 3]


def test_search_is_a_pattern_unless_literal(clean):
    table = clean({"bnb_name": "海島(南)", "bnb_city": "Seoul"}, {"bnb_name": "山", "bnb_city": None})
    assert filters.search(table, "SEOUL|山").count() == 2
    assert filters.search(table, "nan").count() == 1
    assert filters.search(table, "(", literal=True).count() == 1
    assert filters.search(table, "  ").count() == 2
    for odd in ("(", "(a)?(?(1)b)", "a{2,1}"):  # the second is an expression in other dialects only
        with pytest.raises(ValueError, match="not a regular expression"):
            filters.search(table, odd)
    assert filters.search(table, r"^\w+\(").count() == 1  # letters of every script
    assert filters.search(table, "[a-z&&[^t-z]]{5}").count() == 0  # Java's intersection of classes
    assert rows(order_totals(filters.search(table, "absent"))) == [(0, 0.0)]


def test_overlapping_weeks_count_twice(clean):
    span = Period.week_ago(date(2024, 3, 1), date(2024, 3, 10))
    flagged = flag_periods(clean({"order_date": "2024-03-02"}, {"order_date": "2024-03-09"}, {"order_date": "2024-02-24"}), span)
    assert rows(flagged.agg(F.count_if("is_cur"), F.count_if("is_prev"))) == [(2, 2)]


def test_presets_follow_the_data_and_are_clamped(clean):
    table = clean({"order_date": "2024-03-01"}, {"order_date": "2024-03-12"})
    found = {r.preset: r for r in periods.period_bounds(table, date(2024, 3, 13)).collect()}
    def span(preset):
        r = found[preset]
        return tuple(d.isoformat()[5:] for d in (r.start, r.end, r.prev_start, r.prev_end))
    assert span("昨天") == ("03-12", "03-12", "03-11", "03-11")
    assert span("本週") == ("03-10", "03-12", "03-03", "03-05")
    assert span("前一週") == ("03-03", "03-09", "02-25", "03-02")
    assert span("近7天") == ("03-06", "03-12", "02-28", "03-05")
    assert span("近90天") == span("自訂") == ("03-01", "03-12", "02-18", "02-29")
    late = {r.preset: r for r in periods.period_bounds(table, date(2024, 5, 1)).collect()}
    assert (late["本週"].start, late["本週"].end) == (date(2024, 3, 12), date(2024, 3, 12))
    assert periods.resolve_period(table, "近7天", date(2024, 3, 13)) == Period(
        date(2024, 3, 6), date(2024, 3, 12), date(2024, 2, 28), date(2024, 3, 5)
    )


# -- compares and ranks -----------------------------------------------------

def test_vanished_keys(clean):
    table = clean({"order_date": BEFORE, "bnb_type": "eSIM", "affiliate_id": "gone"}, {"order_date": NOW, "bnb_type": "Hotel"},
                  {"order_date": BEFORE, "bnb_type": "Cruise", "bnb_name": "探索星號 那霸"},
                  {"order_date": NOW, "bnb_type": "Cruise", "bnb_name": "探索星號 石垣"})
    flagged = flag_periods(table, WEEK)
    assert {r.product_line for r in overview.product_line_detail(flagged).collect()} == {"住宿(其他)", "Cruise"}
    assert {r.channel for r in channels.channel_compare(flagged).collect()} == {rules.DIRECT_CHANNEL}
    assert rows(cruise.destination_compare(flagged, rules.HOMEPORT)) == [("石垣", 1, 0, 1), ("那霸", 0, 1, -1)]
    assert compare(flagged, "product_line", keep_vanished=True).count() == 3


def test_destinations_empty_without_current_sales(clean):
    table = clean({"order_date": BEFORE, "bnb_type": "Cruise", "bnb_name": "探索星號 那霸"})
    assert cruise.destination_compare(flag_periods(table, WEEK), rules.HOMEPORT).isEmpty()


def test_previous_count_repeats_on_every_variant_of_an_id(clean):
    table = clean(
        *[{"order_date": NOW, "bnb_id": "B1", "bnb_name": n} for n in ("甲", "甲", "乙")],
        *[{"order_date": BEFORE, "bnb_id": "B1", "bnb_name": "舊"}] * 4,
        {"order_date": NOW, "bnb_id": None}, {"order_date": BEFORE, "bnb_id": "B9"},
    )
    ranked = product_rank(flag_periods(table, WEEK), "growth").select("bnb_name", "orders", "prev_orders", "growth", "rank_no")
    assert rows(ranked) == [("甲", 2, 4, -2, 1), ("乙", 1, 4, -3, 2)]


def test_rank_with_city_drops_missing_cities(clean):
    table = clean({"order_date": NOW, "bnb_city": None}, {"order_date": NOW, "bnb_city": "Seoul"})
    assert product_rank(flag_periods(table, WEEK), with_city=True).count() == 1
    assert product_rank(flag_periods(table, WEEK)).first().orders == 2


def cruise_orders(when, n, nights="1", check_in="2024-05-01", name="探索星號 那霸"):
    return [{"order_date": when, "bnb_type": "Cruise", "bnb_name": name, "nights": nights, "check_in": check_in}] * n


def driver(clean, *groups):
    table = clean(*[row for group in groups for row in group])
    return cruise.ship_table(flag_periods(table, WEEK), rules.HOMEPORT).first().main_driver


def test_driver_new_and_too_small(clean):
    assert driver(clean, cruise_orders(NOW, 3)) == "天數：2 天 ▲3單（新增） / 出發月份：2024-05 ▲3單（新增）"
    assert driver(clean, cruise_orders(NOW, 2)) == "–"
    assert driver(clean, cruise_orders(NOW, 1), cruise_orders(BEFORE, 5)) == "天數：2 天 ▼4單（80%） / 出發月份：2024-05 ▼4單（80%）"


def test_driver_tie_takes_the_smallest_value(clean):
    found = driver(clean, cruise_orders(NOW, 3, "4", "2024-06-01"), cruise_orders(NOW, 3, "2", None), cruise_orders(NOW, 3, "9", "2024-05-01"))
    assert found == "天數：10 天 ▲3單（新增） / 出發月份：2024-05 ▲3單（新增）"


def test_trip_lengths_sort_by_number(clean):
    table = clean(*cruise_orders(NOW, 1, "9"), *cruise_orders(NOW, 1, "1"), *cruise_orders(BEFORE, 1, "3", name="地中海號 基隆出發"))
    flagged = flag_periods(table, WEEK)
    assert rows(cruise.trip_length_compare(flagged)) == [("2 天", 1, 0, 1), ("4 天", 0, 1, -1), ("10 天", 1, 0, 1)]
    assert rows(cruise.trip_length_compare(flagged, ships=["地中海榮耀號"])) == [("4 天", 0, 1, -1)]
    assert cruise.cruise_rank(flagged, rules.HOMEPORT, ships=["地中海榮耀號"]).isEmpty()


# -- series -----------------------------------------------------------------

def test_weeks_run_sunday_to_saturday_and_gaps_are_zero(clean):
    table = clean(
        {"order_date": "2024-03-02", "twd_amount": "5"}, {"order_date": "2024-03-03", "twd_amount": "7"},
        {"order_date": "2024-03-09", "twd_amount": "1"}, {"order_date": "2024-03-24", "twd_amount": "2"}, {"order_date": None},
    )
    assert rows(trends.revenue_trend(table, "W")) == [
        (date(2024, 3, 2), 5.0), (date(2024, 3, 9), 8.0), (date(2024, 3, 16), 0.0), (date(2024, 3, 23), 0.0), (date(2024, 3, 30), 2.0),
    ]
    assert rows(trends.gmv_ohlc(table, "W")) == [
        (date(2024, 3, 2), 5.0, 5.0, 5.0, 5.0), (date(2024, 3, 9), 7.0, 7.0, 1.0, 1.0), (date(2024, 3, 30), 2.0, 2.0, 2.0, 2.0),
    ]
    assert trends.revenue_trend(table, "D").count() == 23


def test_months_end_on_their_last_day(clean):
    table = clean({"order_date": "2023-12-31", "twd_amount": "1"}, {"order_date": "2024-02-10", "twd_amount": "2"})
    assert rows(trends.revenue_trend(table, "M")) == [(date(2023, 12, 31), 1.0), (date(2024, 1, 31), 0.0), (date(2024, 2, 29), 2.0)]


def test_moving_average_waits_for_enough_bars(spark):
    bars = spark.createDataFrame([(n, float(n)) for n in range(1, 7)], "bucket_end int, close double")
    assert [r.ma5 for r in trends.moving_averages(bars, [5]).orderBy("bucket_end").collect()] == [None] * 4 + [3.0, 4.0]


def test_holiday_clusters(spark):
    days = [("2001-05-03", "範圍外"), ("2001-06-22", "端午節（補假）"), ("2001-06-25", "端午節"), ("2001-07-10", "假日甲"),
            ("2001-07-13", "假日乙"), ("2001-07-14", "假日乙"), ("2001-07-18", "假日丙")]
    table = spark.createDataFrame(days, "d string, name string").withColumn("d", F.to_date("d"))
    assert rows(trends.holiday_clusters(table, date(2001, 5, 4), date(2001, 8, 1))) == [
        (date(2001, 6, 22), date(2001, 6, 25), "端午節"), (date(2001, 7, 10), date(2001, 7, 14), "假日乙"),
        (date(2001, 7, 18), date(2001, 7, 18), "假日丙"),
    ]


def test_lead_time_bins(clean):
    days = {-1: None, 0: 0, 30: 0, 31: 1, 180: 4, 181: 5}
    table = clean(*[
        row for d in days for row in cruise_orders("2024-03-05", 1, check_in=str(date.fromordinal(date(2024, 3, 5).toordinal() + d)))
    ], *cruise_orders("2024-03-05", 1, check_in=None), *cruise_orders("2024-03-05 12:00:00", 1, check_in="2024-03-05"))
    assert [r.orders for r in cruise.lead_time_histogram(table).collect()] == [2, 1, 0, 0, 1, 1]
    assert rows(cruise.lead_time_stats(table)) == [(31.0, 84.4, 31.0 / 30)]


# -- stays, traffic, figures ------------------------------------------------

def test_aov_rounds_half_even_and_falls_back(clean):
    def stay(city, amounts):
        return [{"bnb_type": "Hotel", "column_switch_3": "Japan", "bnb_city": city, "twd_amount": str(a)} for a in amounts]
    few = clean(*stay("甲", [2, 3]), *stay("乙", [3, 4]), *stay("丙", [9]))
    assert [(r.region, r.aov) for r in stays.region_aov_top(few, "JP").collect()] == [("丙", 9.0), ("乙", 4.0), ("甲", 2.0)]
    enough = clean(*stay("甲", [1] * 5), *stay("乙", [9]))
    assert [r.region for r in stays.region_aov_top(enough, "JP").collect()] == ["甲"]


def test_percent_change_needs_a_positive_base(clean):
    row = overview.kpi_overview(flag_periods(clean({"order_date": NOW}), WEEK)).first()
    assert (row.revenue, row.prev_revenue, row.revenue_pct, row.orders_pct, row.prev_avg_order) == (100.0, 0.0, None, None, 0.0)
    empty = overview.kpi_overview(flag_periods(clean({"order_date": "2020-01-01"}), WEEK)).first()
    assert (empty.revenue, empty.orders, empty.avg_order) == (0.0, 0, 0.0)


def test_running_week_projection(spark):
    weeks = spark.createDataFrame(
        [("202409", date(2024, 2, 25), 70), ("202410", date(2024, 3, 3), 80), ("202411", date(2024, 3, 10), 25)],
        "yearweek string, week_start date, wau bigint",
    )
    row = traffic.wau_kpi(weeks, date(2024, 3, 13)).first()
    assert (row.latest_wau, row.prev_wau, row.wau_diff, row.days_elapsed, row.projected_wau, row.mean_wau) == (80, 70, 10, 4, 44, 58)
    lone = traffic.wau_kpi(weeks.filter("wau = 25"), date(2024, 3, 13)).first()
    assert (lone.latest_wau, lone.prev_wau, lone.wau_diff) == (25, 0, None)
    assert traffic.wau_kpi(weeks.limit(0), date(2024, 3, 13)).isEmpty()


def test_session_time_zone_has_no_say(spark, clean):
    """Midnight does not exist on some days of this zone."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        table = clean(*cruise_orders("1995-10-15", 1, check_in="1999-10-03"))
        text = table.select(F.col("order_date").cast("string")).first()[0]
        assert text == "1995-10-15 00:00:00"
        assert rows(cruise.cruise_checkin_distribution(table)) == [("1999-10", rules.HOMEPORT, 1, 100.0)]
        assert rows(trends.revenue_trend(table, "D")) == [(date(1995, 10, 15), 100.0)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_full_load_and_increment_share_a_table(spark, raw, tmp_path):
    source, target, mark = inbox(tmp_path)
    write_clean(clean_bookings(raw(*({"order_id": f"F{i}"} for i in range(5)))), target)
    row = dict.fromkeys(HEADER.split(","), "") | {"order_date": "2024-03-05", "order_id": "S1", "booking_status": "completed"}
    (tmp_path / "in" / "a.csv").write_text(HEADER + "\n" + ",".join(row[c] for c in HEADER.split(",")) + "\n")
    ingest(spark, source, target, mark).awaitTermination()
    assert read_clean(spark, target).count() == 6


@pytest.mark.parametrize("part", [{"statuses": "completed"}, {"product_lines": "x"}, {"channels": "x"}])
def test_filters_reject_plain_strings(part):
    with pytest.raises(ValueError, match="lists"):
        filters.filter_bookings(None, **part)
