"""Expected labels for the product catalogue, row by row."""

import pytest
from pyspark.sql import functions as F

from wayledger.functions import classify as C
from wayledger.functions import rules
from wayledger.sources.testdata import CATALOGUE

HOME, FLY = rules.HOMEPORT, rules.FLY_CRUISE
NONE = "（無船名）"

# cid -> (type, brand, ship under the rule of its type, destinations)
CRUISES = {
    0: (HOME, "麗星郵輪", "探索星號", {"那霸", "石垣"}),
    1: (HOME, "MSC", "地中海榮耀號", {"沖繩", "鹿兒島"}),
    2: (HOME, "歌詩達", "莎倫娜號", {"釜山", "佐世保"}),
    3: (HOME, "三井", "海洋富士號", {"宮古"}),
    4: (FLY, "MSC", "榮耀號", {"新加坡", "檳城", "馬六甲"}),
    5: (FLY, "公主遊輪", "藍寶石公主號", {"西雅圖", "阿拉斯加", "冰河灣"}),
    6: (FLY, "名人郵輪", "名人極上號", {"希臘", "土耳其"}),
    7: (FLY, "迪士尼", NONE, set()),
    8: (HOME, "挪威郵輪", "挪威太陽號（移航）（台灣登船）", {"東京", "挪威"}),
    9: (FLY, "皇家加勒比", "海洋光譜號", {"加勒比", "越南"}),
    10: (FLY, "皇后郵輪", "伊莉莎白女王號", set()),
    11: (FLY, "麗星郵輪", "探索星號（移航）", {"石垣"}),
    12: (FLY, "星夢郵輪", "雲頂夢號", {"普吉"}),
    13: (FLY, "其他郵輪", NONE, set()),
}
REGIONS = {15: "北海道", 16: "沖繩", 17: "北陸", 18: "關西", 19: "韓國", 20: "歐洲", 21: "越南", 22: "其他"}
SPORTS = {
    33: ("🏃 馬拉松", "日本"), 34: ("🏊 鐵人三項", "台灣"), 35: ("⛷️ 滑雪", "日本"), 36: ("⚾ 觀賽", "日本"),
    37: ("🏃 馬拉松", "其他海外"), 38: ("🎽 其他", "台灣"), 39: ("🏃 馬拉松", "韓國"), 40: ("🎽 其他", "其他海外"),
}
LINES = (
    {cid: "Cruise" for cid in CRUISES} | {cid: "GIT" for cid in REGIONS} | {cid: "SEB" for cid in SPORTS}
    | {23: "TW", 24: "TW", 25: "Camping", 26: "Camping", 27: "KR", 28: "JP", 29: "JP", 30: "TW", 31: "住宿(其他)",
       32: "KR", 41: "高鐵", 43: "eSIM", 44: "Day Tour", 45: "Day Tour", 46: "其他", 47: "高鐵"}
)
EXCLUDED = {14, 42}


@pytest.fixture(scope="module")
def labelled(clean):
    rows = [
        {"order_id": str(cid), "bnb_type": kind, "column_switch_3": cs3, "tags": tags, "bnb_city": city, "bnb_name": name}
        for cid, (kind, cs3, tags, city, name) in enumerate(CATALOGUE)
    ]
    name = F.col("bnb_name")
    table = clean(*rows).select(
        "order_id", "bnb_name", "bnb_name_lower", "tags", "product_line", "cruise_type", "seb_type", "seb_country",
        C.cruise_brand(name).alias("brand"), C.cruise_ship(name).alias("ship"),
        C.homeport_ship(name).alias("home_ship"), C.tour_region(name).alias("region"),
        C.cruise_destinations(name).alias("destinations"), C.is_hoshino(name).alias("hoshino"),
    )
    return {int(row.order_id): row for row in table.collect()}


def test_pseudo_orders_are_dropped(labelled):
    assert set(range(len(CATALOGUE))) - set(labelled) == EXCLUDED
    assert set(LINES) == set(labelled)


@pytest.mark.parametrize("cid", sorted(LINES))
def test_product_line(labelled, cid):
    assert labelled[cid].product_line == LINES[cid]


@pytest.mark.parametrize("cid", sorted(CRUISES))
def test_cruise(labelled, cid):
    kind, brand, ship, destinations = CRUISES[cid]
    row = labelled[cid]
    assert (row.cruise_type, row.brand) == (kind, brand)
    assert (row.home_ship if kind == HOME else row.ship) == ship
    assert set(row.destinations) == destinations


def test_plain_ship_drops_brand_prefix(labelled):
    assert labelled[3].ship == "富士號"


@pytest.mark.parametrize("cid", sorted(REGIONS))
def test_region(labelled, cid):
    assert labelled[cid].region == REGIONS[cid]


@pytest.mark.parametrize("cid", sorted(SPORTS))
def test_sport(labelled, cid):
    assert (labelled[cid].seb_type, labelled[cid].seb_country) == SPORTS[cid]


def test_labels_of_other_lines_are_empty(labelled):
    for cid, row in labelled.items():
        assert (row.cruise_type == "") == (cid not in CRUISES)
        assert (row.seb_type == "") == (row.seb_country == "") == (cid not in SPORTS)


def test_names(labelled):
    assert labelled[18].bnb_name == "京阪神奈良5日"
    assert labelled[45].bnb_name == "機場接送 專車"
    assert labelled[47].bnb_name == "nan"
    assert labelled[25].tags == "camping,family"
    assert labelled[29].bnb_name_lower == "hoshino risonare"
    assert [cid for cid, row in labelled.items() if row.hoshino] == [28, 29]
