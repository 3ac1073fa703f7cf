"""Predicates and lookups over tag maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the tagging rules.
DEFAULT_SPEEDS = {
    "motorway": 120, "motorway_link": 60, "trunk": 100, "trunk_link": 50, "primary": 80, "primary_link": 50, "secondary": 70,
    "secondary_link": 50, "tertiary": 60, "tertiary_link": 50, "unclassified": 50, "residential": 30, "living_street": 20,
    "service": 20, "footway": 5, "path": 5, "cycleway": 20, "bridleway": 10, "steps": 2,
}
FALLBACK_SPEED, WALKING_SPEED, KM_PER_MILE = 50, 5, 1.60934
VEHICLE_HIGHWAYS = ["motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service"]
FOOT_HIGHWAYS = ["footway", "path", "cycleway", "bridleway", "steps"]
AREA_UNLESS_NO = ["amenity", "boundary", "building", "building:part", "craft", "historic", "indoor", "landuse", "leisure", "military", "office", "place", "public_transport", "ruins", "shop", "tourism"]
AREA_IF = {
    "barrier": ["city_wall", "ditch", "hedge", "retaining_wall", "wall", "spikes"],
    "highway": ["services", "rest_area", "escape", "elevator"],
    "power": ["plant", "substation", "generator", "transformer"],
    "railway": ["station", "turntable", "roundhouse", "platform"],
    "waterway": ["riverbank", "dock", "boatyard", "dam"],
}
AREA_UNLESS = {
    "aeroway": ["no", "taxiway"],
    "area:highway": ["no"],
    "man_made": ["no", "cutline", "embankment", "pipeline"],
    "natural": ["no", "coastline", "cliff", "ridge", "arete", "tree_row"],
}
AREA_RELATIONS, LINE_RELATIONS, POINT_RELATIONS = ["multipolygon", "boundary", "site"], ["route", "waterway", "multilinestring", "canal"], ["multipoint"]
TRANSIT_EXTRACT = {
    "nodes": [],
    "ways": [("highway", None), ("public_transport", "platform"), ("railway", "platform"), ("park_ride", None)],
    "relations": [("type", "restriction")],
}


def tag(tags: Column, key: str) -> Column:
    """A tag's value, or null."""
    return tags[key]


def has_key(tags: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(tags, key), F.lit(False))


def has_value(tags: Column, key: str, value: str) -> Column:
    return F.coalesce(tag(tags, key) == value, F.lit(False))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def truthy(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def matches_rules(tags: Column, rules: list[tuple[str, str | None]]) -> Column:
    """Any of the rules (key, value or None for all values); without rules, everything passes. Keys and values are
    trimmed, blank keys don't count, blank values are any."""
    clean = [(k.strip(), (v or "").strip()) for k, v in rules if k.strip()]
    return any_of([has_value(tags, k, v) if v else has_key(tags, k) for k, v in clean]) if clean else F.lit(True)


def vehicle_way(tags: Column) -> Column:
    return F.coalesce(tag(tags, "highway").isin(VEHICLE_HIGHWAYS), F.lit(False))


def foot_way(tags: Column) -> Column:
    return F.coalesce(tag(tags, "highway").isin(FOOT_HIGHWAYS), F.lit(False))


def polygonish(tags: Column) -> Column:
    return any_of([truthy(tag(tags, k)) for k in ("building", "landuse", "natural")])


def crossing_candidate(tags: Column) -> Column:
    """Ways that may be joined where they cross: with a highway, and no area."""
    return tag(tags, "highway").isNotNull() & ~polygonish(tags)


def should_connect(a: Column, b: Column) -> Column:
    """Whether crossing ways are joined: both highways, none an area, on one layer, without bridge or tunnel (any value)."""
    apart = any_of([truthy(tag(t, k)) for t in (a, b) for k in ("bridge", "tunnel")])
    layer = lambda t: F.coalesce(tag(t, "layer"), F.lit("0"))
    return crossing_candidate(a) & crossing_candidate(b) & ~apart & (layer(a) == layer(b))


def is_area(refs: Column, tags: Column) -> Column:
    """Whether a way is an area: closed, of three references or more, and tagged as one, or not at all."""
    closed = (F.size(refs) >= 3) & (F.element_at(refs, 1) == F.element_at(refs, -1))
    bare = tags.isNull() | (F.size(tags) == 0)
    value = lambda k: tag(tags, k)
    implied = [truthy(value(k)) & (value(k) != "no") for k in AREA_UNLESS_NO]
    implied += [F.coalesce(value(k).isin(v), F.lit(False)) for k, v in AREA_IF.items()]
    implied += [truthy(value(k)) & ~value(k).isin(v) for k, v in AREA_UNLESS.items()]
    rule = F.when(bare, True).when(has_key(tags, "area"), value("area") != "no").otherwise(F.coalesce(any_of(implied), F.lit(False)))
    return F.coalesce(closed, F.lit(False)) & rule


def relation_kind(tags: Column, members: Column) -> Column:
    kind = F.lower(tag(tags, "type"))
    nested = F.when(F.exists(members, lambda m: m["type"] == "relation"), "super").otherwise("logic")
    return F.when(kind.isin(AREA_RELATIONS), "area").when(kind.isin(LINE_RELATIONS), "line").when(kind.isin(POINT_RELATIONS), "point").otherwise(nested)


def max_speed(value: Column) -> Column:
    """maxspeed in km/h: a number, with km/h or mph after it, walk or none; else null."""
    v = F.lower(F.trim(value))
    metric = F.nullif(F.regexp_extract(v, r"^(\d+)\s*(?:km/h|kmh|kph)?$", 1), F.lit(""))
    miles = F.nullif(F.regexp_extract(v, r"^(\d+)\s*mph$", 1), F.lit(""))
    return F.when(metric.isNotNull(), metric.cast("int")).when(miles.isNotNull(), F.floor(miles.cast("int") * KM_PER_MILE + 0.5).cast("int")).when(v.isin("walk", "none"), WALKING_SPEED)


def speed_limit(tags: Column, defaults: dict[str, int] | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in (defaults or DEFAULT_SPEEDS).items() for x in kv])
    highway = tag(tags, "highway")
    return F.coalesce(max_speed(tag(tags, "maxspeed")), F.when(highway.isNotNull(), table[highway]), F.lit(FALLBACK_SPEED))


def version(tags: Column) -> Column:
    return F.coalesce(tag(tags, "ext:osm_version").try_cast("double"), F.lit(0.0))


def one_way(tags: Column) -> Column:
    return F.coalesce(tag(tags, "oneway").isin("yes", "1"), F.lit(False))


def sorted_entries(tags: Column) -> Column:
    """A map in a form that can be compared."""
    return F.array_sort(F.map_entries(F.coalesce(tags, F.create_map().cast("map<string,string>"))))


def without_repeats(refs: Column) -> Column:
    """Elements that differ from the one after them: of a run, the last stays."""
    return F.filter(refs, lambda x, i: (i == F.size(refs) - 1) | (x != F.get(refs, i + 1)))
