"""Map-feature tags: classification, lengths and selectors as Column expressions over MAP<STRING, STRING>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layers with their subtypes in order of importance.
LAYERS: dict[str, list[str]] = {
    "roads": ["motorway", "trunk", "primary", "secondary", "tertiary", "residential", "unclassified", "living_street", "service", "pedestrian", "track"],
    "trails": ["path", "footway", "bridleway", "cycleway", "steps"],
    "railways": ["rail", "light_rail", "subway", "tram", "monorail", "narrow_gauge", "funicular"],
    "water": ["river", "stream", "canal", "lake", "reservoir", "pond", "riverbank"],
    "buildings": ["residential", "commercial", "industrial", "retail", "civic", "religious", "other"],
    "greenery": ["park", "forest", "wood", "grass", "meadow", "garden", "pitch", "golf_course"],
    "sand": ["beach", "sand", "dune"],
    "aeroways": ["runway", "taxiway", "apron"],
    "piers": ["pier", "breakwater"],
    "skiruns": ["downhill", "nordic"],
}
#: Metres by class.
WAY_WIDTH_M = {
    "motorway": 20, "trunk": 16, "primary": 12, "secondary": 10, "tertiary": 8, "residential": 6, "unclassified": 6, "living_street": 5, "service": 4, "pedestrian": 4, "track": 3,
    "path": 2, "footway": 2, "cycleway": 2, "bridleway": 2, "steps": 2,
}
AEROWAY_WIDTH_M = {"runway": 45, "taxiway": 20, "apron": 40}
WATERWAY_WIDTH_M = {"river": 20, "canal": 12, "stream": 5}
RAIL_WIDTH_M, PIER_WIDTH_M, SKI_WIDTH_M = 5, 4, 20
DEAD_RAILWAYS = ["abandoned", "disused", "razed", "proposed", "construction"]
#: Building groups.
BUILDING_GROUPS = {
    "residential": ["house", "apartments", "residential", "detached", "terrace", "dormitory"],
    "commercial": ["commercial", "office", "hotel"],
    "industrial": ["industrial", "warehouse", "factory"],
    "retail": ["retail", "supermarket", "shop"],
    "civic": ["civic", "school", "university", "hospital", "government"],
    "religious": ["church", "mosque", "temple", "synagogue", "cathedral"],
}
METRES_PER_LEVEL, DEFAULT_BUILDING_M = 3.0, 6.0
#: What each layer asks of an extract: element type, key, accepted values (None: any).
SELECTORS: dict[str, list[tuple[str, str, list[str] | None]]] = {
    "roads": [("way", "highway", LAYERS["roads"])],
    "trails": [("way", "highway", LAYERS["trails"])],
    "railways": [("way", "railway", LAYERS["railways"])],
    "water": [("way", "waterway", ["river", "stream", "canal", "riverbank"]), ("way", "natural", ["water"]), ("relation", "natural", ["water"]), ("way", "landuse", ["reservoir"])],
    "buildings": [("way", "building", None), ("relation", "building", None), ("way", "building:part", None)],
    "greenery": [("way", "leisure", ["park", "garden", "pitch", "golf_course"]), ("way", "landuse", ["forest", "grass", "meadow", "recreation_ground"]), ("way", "natural", ["wood", "grass", "meadow"]), ("relation", "leisure", ["park", "golf_course"])],
    "sand": [("way", "natural", LAYERS["sand"])],
    "aeroways": [("way", "aeroway", LAYERS["aeroways"])],
    "piers": [("way", "man_made", LAYERS["piers"])],
    "skiruns": [("way", "piste:type", LAYERS["skiruns"])],
}


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def is_set(v: Column) -> Column:
    """Present, and not one of the words for no; an empty value counts as set."""
    return F.coalesce(~v.isin("no", "false", "0"), F.lit(False))


def _in(v: Column, words: list[str]) -> Column:
    return F.coalesce(v.isin(*words), F.lit(False))


def _width(v: Column, table: dict[str, int]) -> Column:
    pairs = [F.lit(x) for k, m in table.items() for x in (k, float(m))]
    return F.try_element_at(F.create_map(*pairs), v)


def building_subtype(tags: Column) -> Column:
    value = F.coalesce(tag(tags, "building"), tag(tags, "building:part"), F.lit("yes"))
    out = F.lit("other")
    for group, words in BUILDING_GROUPS.items():
        out = F.when(value.isin(*words), group).otherwise(out)
    return out


def classify(tags: Column) -> Column:
    """STRUCT<layer, subtype, bridge, width_m>, or null for what is not printed.

    A way under ground is nothing. A highway or railway of another kind is nothing either, whatever
    its other tags; other keys are tried in order.
    """
    t = lambda k: tag(tags, k)
    bridge = is_set(t("bridge"))
    no_width = F.lit(None).cast("double")

    def found(layer: str, subtype: Column, width: Column = no_width) -> Column:
        return F.struct(F.lit(layer).alias("layer"), subtype.alias("subtype"), bridge.alias("bridge"), width.cast("double").alias("width_m"))

    nothing = F.lit(None)
    highway, railway = F.nullif(t("highway"), F.lit("")), F.nullif(t("railway"), F.lit(""))
    road = F.when(_in(highway, LAYERS["roads"]), found("roads", highway, _width(highway, WAY_WIDTH_M))).when(_in(highway, LAYERS["trails"]), found("trails", highway, _width(highway, WAY_WIDTH_M)))
    dead = _in(railway, DEAD_RAILWAYS)
    for state in DEAD_RAILWAYS:
        dead = dead | t(state).isNotNull()
    rail = F.when(~dead & _in(railway, LAYERS["railways"]), found("railways", railway, F.lit(float(RAIL_WIDTH_M))))
    waterway, landuse, natural = t("waterway"), t("landuse"), t("natural")
    water = F.coalesce(t("water"), F.when(_in(landuse, ["reservoir"]), "reservoir").otherwise("lake"))
    rest = (
        F.when(_in(t("aeroway"), LAYERS["aeroways"]), found("aeroways", t("aeroway"), _width(t("aeroway"), AEROWAY_WIDTH_M)))
        .when(_in(t("man_made"), LAYERS["piers"]), found("piers", t("man_made"), F.lit(float(PIER_WIDTH_M))))
        .when(_in(t("piste:type"), LAYERS["skiruns"]), found("skiruns", t("piste:type"), F.lit(float(SKI_WIDTH_M))))
        .when(_in(waterway, ["river", "stream", "canal", "riverbank"]), found("water", waterway, _width(waterway, WATERWAY_WIDTH_M)))
        .when(_in(natural, ["water"]) | _in(landuse, ["reservoir"]), found("water", F.when(water.isin(*LAYERS["water"]), water).otherwise("lake")))
        .when(t("building").isNotNull() | t("building:part").isNotNull(), found("buildings", building_subtype(tags)))
        .when(_in(t("leisure"), LAYERS["greenery"]), found("greenery", t("leisure")))
        .when(_in(landuse, LAYERS["greenery"]), found("greenery", landuse))
        .when(_in(natural, LAYERS["greenery"]), found("greenery", natural))
        .when(_in(natural, LAYERS["sand"]), found("sand", natural))
    )
    buried = is_set(t("tunnel")) | _in(t("location"), ["underground"])
    return F.when(buried, nothing).when(highway.isNotNull(), road).when(railway.isNotNull(), rail).otherwise(rest)


def length_m(v: Column) -> Column:
    """A length in metres: feet and inches, or a number with m, km, ft or mi; else null."""
    s = F.trim(v)
    feet = r"^(\d+(?:\.\d+)?)'\s*(?:(\d+(?:\.\d+)?)\")?$"
    plain = r"(?i)^(-?\d+(?:\.\d+)?)\s*(m|km|ft|mi)?$"
    number = lambda pattern, group: F.regexp_extract(s, pattern, group).try_cast("double")
    unit = F.lower(F.regexp_extract(s, plain, 2))
    factor = F.when(unit == "km", 1000.0).when(unit == "ft", 0.3048).when(unit == "mi", 1609.344).otherwise(1.0)
    imperial = (number(feet, 1) * 12 + F.coalesce(number(feet, 2), F.lit(0.0))) * 0.0254
    return F.when(s.rlike(feet), imperial).when(s.rlike(plain), number(plain, 1) * factor)


def number_prefix(v: Column) -> Column:
    """The number that a text begins with, else null."""
    return F.regexp_extract(v, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def building_height_m(tags: Column) -> Column:
    height, levels = length_m(tag(tags, "height")), number_prefix(tag(tags, "building:levels"))
    return F.when(height > 0, height).when(levels > 0, levels * METRES_PER_LEVEL).otherwise(DEFAULT_BUILDING_M)


def building_min_height_m(tags: Column) -> Column:
    low = length_m(F.coalesce(tag(tags, "min_height"), tag(tags, "building:min_level")))
    return F.when(low > 0, low).otherwise(0.0)


def layer_order(tags: Column) -> Column:
    return F.coalesce(F.regexp_extract(tag(tags, "layer"), r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0).cast("long"))


def selected(kind: Column, tags: Column, layers: list[str]) -> Column:
    """Whether an element is asked for by any of the layers: one pass for all of them."""
    out = F.lit(False)
    for layer in layers:
        for element, key, values in SELECTORS[layer]:
            v = tag(tags, key)
            out = out | ((kind == element) & (v.isNotNull() if values is None else _in(v, values)))
    return out
