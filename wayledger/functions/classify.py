"""Ordered text rules that turn product attributes into business labels.

Every function maps Columns to a Column.  Nothing here is a Python UDF, so the rules run inside the
generated code of whatever stage uses them, and labels a query does not ask for are pruned away.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayledger.functions import rules
from wayledger.functions.text import alternation, known, matches, mentions, strip


def first_hit(text: Column, ordered: Iterable[tuple[str, str]], default: Column) -> Column:
    """Label of the first ``(label, pattern)`` whose pattern occurs in the text."""
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(label)) for label, pattern in ordered], default)


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    """Value for the key from a small literal table, NULL when absent."""
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), key)


# -- product lines ----------------------------------------------------------

def product_line(bnb_type: Column, switch: Column, tags: Column) -> Column:
    line, market = lookup(bnb_type, rules.LINE_OF_TYPE), F.lower(known(switch))
    stay = (
        F.when((bnb_type == rules.WHOLE_UNIT_TYPE) & known(tags).contains("camping"), "Camping")
        .when(market.contains("taiwan"), "TW")
        .when(market.contains("korea"), "KR")
        .when(market.contains("japan"), "JP")
        .otherwise("住宿(其他)")
    )
    return F.when(line == rules.STAY, stay).otherwise(F.coalesce(line, F.lit("其他")))


# -- cruises ----------------------------------------------------------------

def cruise_type(line: Column, name: Column) -> Column:
    """Homeport or fly cruise for cruise bookings, empty text for everything else."""
    sails_from_home = first_hit(
        name,
        [
            (rules.FLY_CRUISE, rules.FOREIGN_EMBARK),
            (rules.HOMEPORT, rules.HOME_DEPARTURE),
            (rules.FLY_CRUISE, f"{rules.ANY_EMBARK}|{rules.REPOSITIONING}"),
            (rules.HOMEPORT, alternation(rules.HOMEPORT_FLEET_NAMES)),
        ],
        F.lit(rules.FLY_CRUISE),
    )
    return F.when(line == "Cruise", sails_from_home).otherwise("")


def cruise_brand(name: Column) -> Column:
    return first_hit(F.lower(name), rules.CRUISE_BRANDS, F.lit(rules.OTHER_BRAND))


def _repositioning_mark(name: Column) -> Column:
    return F.when(name.contains(rules.REPOSITIONING), f"（{rules.REPOSITIONING}）").otherwise("")


def cruise_ship(name: Column) -> Column:
    """Ship name found in the product name, without the brand words stuck to it."""
    found = F.regexp_extract(name, rules.SHIP_PATTERN, 0)
    ship = found
    for prefix in reversed(rules.SHIP_BRAND_PREFIXES):
        more_than_suffix = found.startswith(prefix) & (F.length(found) > len(prefix) + 1)
        ship = F.when(more_than_suffix, F.substring(found, len(prefix) + 1, 2**31 - 1)).otherwise(ship)
    for filler in rules.SHIP_FILLERS:
        ship = F.replace(ship, F.lit(filler), F.lit(""))
    named = F.concat(
        F.when(ship == "", rules.NO_SHIP).otherwise(ship), _repositioning_mark(name)
    )
    without_alias = F.when(found == "", rules.NO_SHIP).otherwise(named)
    return first_hit(F.lower(name), rules.SHIP_ALIASES, without_alias)


def homeport_ship(name: Column) -> Column:
    """Fixed homeport fleet by brand; any other ship that boards in Taiwan is marked as such."""
    fleet = first_hit(F.lower(name), rules.HOMEPORT_SHIPS, F.lit(None).cast("string"))
    return F.coalesce(
        F.concat(fleet, _repositioning_mark(name)),
        F.concat(cruise_ship(name), F.lit("（台灣登船）")),
    )


def cruise_destinations(name: Column) -> Column:
    """Array of every destination the product name mentions (the brand name does not count)."""
    text = F.replace(name, F.lit(rules.DESTINATION_BRAND_NOISE), F.lit(""))
    places = F.array(*[F.lit(place) for place in rules.CRUISE_DESTINATIONS])
    return F.filter(places, lambda place: text.contains(place))


# -- sports -----------------------------------------------------------------

def seb_type(line: Column, bnb_type: Column, name: Column) -> Column:
    kind = (
        F.when(matches(name, rules.SPECTATE), rules.SEB_SPECTATE)
        .when(matches(name, rules.TRIATHLON, ignore_case=True), rules.SEB_TRIATHLON)
        .when((known(bnb_type) == "ski") | matches(name, rules.SKI, ignore_case=True), rules.SEB_SKI)
        .when(matches(name, rules.MARATHON, ignore_case=True), rules.SEB_MARATHON)
        .otherwise(rules.SEB_OTHER)
    )
    return F.when(line == "SEB", kind).otherwise("")


def seb_country(line: Column, switch: Column, name: Column) -> Column:
    market = F.lower(strip(known(switch)))
    by_name = (
        F.when(mentions(name, rules.TAIWAN_PLACES), "台灣")
        .when(mentions(name, rules.KOREA_PLACES, ignore_case=True), "韓國")
        .when(mentions(name, rules.JAPAN_PLACES), "日本")
        .otherwise("其他海外")
    )
    country = F.coalesce(lookup(market, rules.COUNTRY_SWITCH), F.lit("其他海外"))
    resolved = F.when(country == rules.BY_NAME, by_name).otherwise(country)
    return F.when(line == "SEB", resolved).otherwise("")


# -- tours, channels, places ------------------------------------------------

def tour_region(name: Column, regions=rules.TOUR_REGIONS) -> Column:
    ordered = [(region, alternation(words)) for region, words in regions]
    return first_hit(name, ordered, F.lit(rules.OTHER_REGION))


def channel(affiliate_id: Column) -> Column:
    """Marketing channel: the raw id, or the direct label for every spelling of "none"."""
    empty = strip(known(affiliate_id)).isin(rules.EMPTY_CHANNEL_VALUES)
    return F.when(empty, rules.DIRECT_CHANNEL).otherwise(affiliate_id)


def channel_bucket(group: Column) -> Column:
    return F.coalesce(lookup(group, rules.CHANNEL_BUCKETS), F.lit(rules.DIRECT_CHANNEL))


def county(city: Column) -> Column:
    """Chinese county name, NULL for cities outside the table."""
    return lookup(city, rules.TAIWAN_COUNTIES)


def is_hoshino(name: Column) -> Column:
    return mentions(name, rules.HOSHINO_WORDS, ignore_case=True)
