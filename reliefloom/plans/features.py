"""Queries over map features: tags, classes, routing, rings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tags as T
from ..operators import osm
from .derived import way_points, way_tags
from .registry import Registry, r6

REG = Registry()
BUILDING_WHEN = " ".join(f"WHEN v IN ({', '.join(repr(w) for w in words)}) THEN '{g}'" for g, words in T.BUILDING_GROUPS.items())


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _widths(column: str, table: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in table.items()) + " END"


#: The tags of each part, by its template.
PART_TAGS = "pt AS (SELECT p_partkey AS way_id, p_size, t, closed, tags FROM part JOIN tags ON t = p_partkey % 25)"
GET = lambda k: f"tags['{k}']"
CLASS_SQL = f"""cls AS (SELECT *, CASE
   WHEN (tags['tunnel'] IS NOT NULL AND tags['tunnel'] NOT IN ('no', 'false', '0')) OR tags['location'] = 'underground' THEN NULL
   WHEN tags['highway'] <> '' THEN CASE WHEN tags['highway'] IN ({_quoted(T.LAYERS['roads'])}) THEN 'roads' WHEN tags['highway'] IN ({_quoted(T.LAYERS['trails'])}) THEN 'trails' END
   WHEN tags['railway'] <> '' THEN CASE WHEN tags['railway'] IN ({_quoted(T.DEAD_RAILWAYS)}) OR {' OR '.join(f"tags['{s}'] IS NOT NULL" for s in T.DEAD_RAILWAYS)} THEN NULL WHEN tags['railway'] IN ({_quoted(T.LAYERS['railways'])}) THEN 'railways' END
   WHEN tags['aeroway'] IN ({_quoted(T.LAYERS['aeroways'])}) THEN 'aeroways'
   WHEN tags['man_made'] IN ({_quoted(T.LAYERS['piers'])}) THEN 'piers'
   WHEN tags['piste:type'] IN ({_quoted(T.LAYERS['skiruns'])}) THEN 'skiruns'
   WHEN tags['waterway'] IN ('river', 'stream', 'canal', 'riverbank') OR tags['natural'] = 'water' OR tags['landuse'] = 'reservoir' THEN 'water'
   WHEN tags['building'] IS NOT NULL OR tags['building:part'] IS NOT NULL THEN 'buildings'
   WHEN tags['leisure'] IN ({_quoted(T.LAYERS['greenery'])}) OR tags['landuse'] IN ({_quoted(T.LAYERS['greenery'])}) OR tags['natural'] IN ({_quoted(T.LAYERS['greenery'])}) THEN 'greenery'
   WHEN tags['natural'] IN ({_quoted(T.LAYERS['sand'])}) THEN 'sand' END AS layer FROM pt),
 sub AS (SELECT *, CASE layer WHEN 'roads' THEN tags['highway'] WHEN 'trails' THEN tags['highway'] WHEN 'railways' THEN tags['railway'] WHEN 'aeroways' THEN tags['aeroway'] WHEN 'piers' THEN tags['man_made'] WHEN 'skiruns' THEN tags['piste:type']
   WHEN 'water' THEN CASE WHEN tags['waterway'] IN ('river', 'stream', 'canal', 'riverbank') THEN tags['waterway'] WHEN coalesce(tags['water'], CASE WHEN tags['landuse'] = 'reservoir' THEN 'reservoir' ELSE 'lake' END) IN ({_quoted(T.LAYERS['water'])}) THEN coalesce(tags['water'], CASE WHEN tags['landuse'] = 'reservoir' THEN 'reservoir' ELSE 'lake' END) ELSE 'lake' END
   WHEN 'buildings' THEN (SELECT CASE {BUILDING_WHEN} ELSE 'other' END FROM (SELECT coalesce(tags['building'], tags['building:part'], 'yes') AS v))
   WHEN 'greenery' THEN CASE WHEN tags['leisure'] IN ({_quoted(T.LAYERS['greenery'])}) THEN tags['leisure'] WHEN tags['landuse'] IN ({_quoted(T.LAYERS['greenery'])}) THEN tags['landuse'] ELSE tags['natural'] END
   WHEN 'sand' THEN tags['natural'] END AS subtype FROM cls),
 kind AS (SELECT *, CASE WHEN layer IN ('roads', 'trails') THEN {_widths('subtype', T.WAY_WIDTH_M)} WHEN layer = 'railways' THEN 5e0 WHEN layer = 'aeroways' THEN {_widths('subtype', T.AEROWAY_WIDTH_M)} WHEN layer = 'piers' THEN 4e0 WHEN layer = 'skiruns' THEN 20e0
   WHEN layer = 'water' AND tags['waterway'] IN ('river', 'stream', 'canal') THEN {_widths('subtype', T.WATERWAY_WIDTH_M)} END AS width_m, coalesce(tags['bridge'] NOT IN ('no', 'false', '0'), false) AS bridge FROM sub)"""
GEOM_SQL = """geom AS (SELECT way_id, count(*) AS n, min_by(lon, seq) AS fx, min_by(lat, seq) AS fy, max_by(lon, seq) AS lx, max_by(lat, seq) AS ly FROM (
   SELECT way_id, seq, lon, lat FROM ways UNION ALL SELECT way_id, 100, lon, lat FROM ways JOIN pt USING (way_id) WHERE closed AND seq = 0) GROUP BY way_id)"""


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, tags, points: each part as a way, closed where its template says so."""
    p = F.struct("seq", F.col("lon").alias("x"), F.col("lat").alias("y"))
    pts = way_points(spark, sf_dir).groupBy("way_id").agg(F.array_sort(F.collect_list(p)).alias("ps"))
    t = way_tags(spark)
    joined = pts.join(F.broadcast(t), F.col("t") == F.col("way_id") % len_templates())
    strip = F.transform("ps", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    points = F.when(F.col("closed"), F.concat(strip, F.slice(strip, 1, 1))).otherwise(strip)
    return joined.select("way_id", "t", F.lit("way").alias("type"), "tags", points.alias("points"))


def len_templates() -> int:
    from .derived import TEMPLATES

    return len(TEMPLATES)


def _tagged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("way_id"))
    return parts.join(F.broadcast(way_tags(spark)), F.col("t") == F.col("way_id") % len_templates())


@REG.add(f"WITH {{TAGS}}, {PART_TAGS}, {CLASS_SQL} SELECT way_id, layer, subtype, CASE WHEN layer IS NOT NULL THEN bridge END AS bridge, width_m FROM kind")
def c01_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer, subtype, bridge and width by the ordered cascade."""
    return osm.classified(_tagged_parts(spark, sf_dir)).select("way_id", "kind.layer", "kind.subtype", "kind.bridge", "kind.width_m")


@REG.add("WITH {TAGS}, " + PART_TAGS + """ SELECT way_id, round(CASE t WHEN 16 THEN 10e0 WHEN 17 THEN 9e0 WHEN 18 THEN 32 * 0.3048e0 ELSE 6e0 END, 6) + 0e0 AS height_m, round(CASE t WHEN 18 THEN (4 * 12 + 6) * 0.0254e0 ELSE 0e0 END, 6) + 0e0 AS min_height_m,
  coalesce(try_cast(regexp_extract(tags['layer'], '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0) AS layer_order FROM pt""".replace("\\\\", "\\"))
def c04_building_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height, minimum height and layer order from tags."""
    t = F.col("tags")
    return _tagged_parts(spark, sf_dir).select("way_id", r6(T.building_height_m(t)).alias("height_m"), r6(T.building_min_height_m(t)).alias("min_height_m"), T.layer_order(t).alias("layer_order"))


@REG.add(r"""WITH v AS (SELECT event_id, CASE event_id % 12 WHEN 0 THEN value || ' m' WHEN 1 THEN value || 'KM' WHEN 2 THEN value || ' ft' WHEN 3 THEN '-' || value || 'mi' WHEN 4 THEN (event_id % 9) || chr(39) || (event_id % 12) || '"' WHEN 5 THEN (event_id % 9) || chr(39) WHEN 6 THEN '' WHEN 7 THEN 'tall' WHEN 8 THEN '  ' || value || '  ' WHEN 9 THEN value || ' miles' WHEN 10 THEN NULL ELSE '.5 m' END AS s FROM events),
 w AS (SELECT event_id, trim(s) AS s, try_cast(regexp_extract(trim(s), '^(-?\d+(?:\.\d+)?)\s*(m|km|ft|mi)?$', 1, 'i') AS DOUBLE) AS n, lower(regexp_extract(trim(s), '^(-?\d+(?:\.\d+)?)\s*(m|km|ft|mi)?$', 2, 'i')) AS u FROM v)
 SELECT event_id, round(CASE WHEN s LIKE '%' || chr(39) || '%' THEN (split_part(s, chr(39), 1)::DOUBLE * 12 + coalesce(try_cast(replace(split_part(s, chr(39), 2), '"', '') AS DOUBLE), 0)) * 0.0254e0 ELSE n * CASE u WHEN 'km' THEN 1000e0 WHEN 'ft' THEN 0.3048e0 WHEN 'mi' THEN 1609.344e0 ELSE 1e0 END END, 6) + 0e0 AS metres FROM w""")
def c06_parse_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = F.col("event_id"), F.col("value").cast("string")
    forms = [F.concat(v, F.lit(" m")), F.concat(v, F.lit("KM")), F.concat(v, F.lit(" ft")), F.concat(F.lit("-"), v, F.lit("mi")), F.concat(e % 9, F.lit("'"), e % 12, F.lit('"')), F.concat(e % 9, F.lit("'")), F.lit(""), F.lit("tall"), F.concat(F.lit("  "), v, F.lit("  ")), F.concat(v, F.lit(" miles")), F.lit(None).cast("string"), F.lit(".5 m")]
    text = F.element_at(F.array(*forms), (e % 12 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", r6(T.length_m(text)).alias("metres"))


ROUTE_SQL = """rt AS (SELECT way_id, layer, n, CASE WHEN layer IS NULL THEN 'skipped' WHEN n < 2 THEN 'ignored' WHEN width_m IS NOT NULL THEN 'line' WHEN n >= 4 AND abs(fx - lx) < 1e-9 AND abs(fy - ly) < 1e-9 THEN 'polygon' ELSE 'skipped' END AS route FROM kind JOIN geom USING (way_id))"""


@REG.add(f"WITH {{TAGS}}, {{WAYS}}, {PART_TAGS}, {CLASS_SQL}, {GEOM_SQL}, {ROUTE_SQL} SELECT way_id, route, (CASE WHEN route = 'polygon' THEN n - 1 ELSE n END)::INT AS points FROM rt")
def c09_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways routed to lines, polygons or neither, with open rings."""
    r = osm.routed(_ways(spark, sf_dir))
    return r.select("way_id", "route", F.size(F.when(F.col("route") == "polygon", osm.open_ring(F.col("points"))).otherwise(F.col("points"))).alias("points"))


@REG.add(f"WITH {{TAGS}}, {{WAYS}}, {PART_TAGS}, {CLASS_SQL}, {GEOM_SQL}, {ROUTE_SQL} SELECT coalesce(layer, 'none') AS layer, count(*) FILTER (WHERE route IN ('line', 'polygon')) AS features, count(*) FILTER (WHERE route = 'skipped') AS skipped FROM rt GROUP BY 1")
def e06_layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each layer, and what was skipped."""
    r = osm.routed(_ways(spark, sf_dir))
    return r.groupBy(F.coalesce("kind.layer", F.lit("none")).alias("layer")).agg(F.count_if(F.col("route").isin("line", "polygon")).alias("features"), F.count_if(F.col("route") == "skipped").alias("skipped"))


def _selector_sql(layers: list[str]) -> str:
    tests = [f"(kind = '{e}' AND " + (f"tags['{k}'] IS NOT NULL" if v is None else f"tags['{k}'] IN ({_quoted(v)})") + ")" for layer in layers for e, k, v in T.SELECTORS[layer]]
    return " OR ".join(tests)


@REG.add(f"""WITH {{TAGS}}, {{WAYS}}, {PART_TAGS}, box AS (SELECT way_id, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM ways GROUP BY way_id), el AS (SELECT *, CASE WHEN way_id % 10 = 0 THEN 'relation' ELSE 'way' END AS kind FROM pt JOIN box USING (way_id))
 SELECT way_id FROM el WHERE coalesce({_selector_sql(['roads', 'water', 'buildings', 'greenery'])}, false) AND w <= 7.70e0 AND e >= 7.66e0 AND s <= 45.99e0 AND n >= 45.96e0""")
def a03_layer_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that four layers ask for in a box: one pass over the extract."""
    w = _ways(spark, sf_dir).withColumn("type", F.when(F.col("way_id") % 10 == 0, "relation").otherwise("way"))
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    inside = (F.array_min(xs) <= 7.70) & (F.array_max(xs) >= 7.66) & (F.array_min(ys) <= 45.99) & (F.array_max(ys) >= 45.96)
    return w.filter(T.selected(F.col("type"), F.col("tags"), ["roads", "water", "buildings", "greenery"]) & inside).select("way_id")


MEMBERS = [("outer", [6, 5, 4, 3], 1.0), ("outer", [6, 7, 0], 1.0), ("outer", [0, 1, 2, 3], 1.0), ("inner", [1, 3, 5], 0.3), ("inner", [1, 7, 5], 0.3)]


@REG.add("""SELECT s_suppkey AS rel_id, role, points::BIGINT AS points, round(points / 2e0 * sin(2 * pi() / points) * r * r * 1e6, 4) + 0e0 AS area FROM supplier, (VALUES ('outer', 8, 0.01e0), ('inner', 4, 0.003e0)) v(role, points, r)""")
def f11_ring_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of relations from fragments in no order: an octagon with a square hole each."""
    table = spark.createDataFrame([(o, role, s, v, r) for o, (role, vs, r) in enumerate(MEMBERS) for s, v in enumerate(vs)], "ord int, role string, seq int, v int, r double")
    a = F.col("v") * (geo_pi() / 4)
    m = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("rel_id")).join(F.broadcast(table), F.lit(True)).select("rel_id", "ord", "role", "seq", (F.lit(7.62) + F.col("rel_id") * 1e-4 + F.cos(a) * F.col("r") * 0.01).alias("x"), (F.lit(45.98) + F.sin(a) * F.col("r") * 0.01).alias("y"))
    rings = osm.assembled_rings(m)
    pts = rings.groupBy("rel_id", "role", "ring").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("ps"))
    from ..functions import geo

    moved = pts.select("rel_id", "role", F.transform("ps", lambda p: geo.point(p["x"] - (F.lit(7.62) + F.col("rel_id") * 1e-4), p["y"] - 45.98)).alias("r"))
    return moved.select("rel_id", "role", F.size("r").cast("long").alias("points"), F.round(F.abs(geo.ring_area(F.col("r"))) * 1e6, 4).alias("area"))


RELATIONS = """rel AS (SELECT s_suppkey AS id, s_suppkey % 25 AS t FROM supplier), kt AS (SELECT t, any_value(layer) AS layer FROM kind GROUP BY t)"""


@REG.add(f"""WITH {{TAGS}}, {{WAYS}}, {PART_TAGS}, {CLASS_SQL}, {GEOM_SQL}, {ROUTE_SQL}, {RELATIONS}
 SELECT 'way' AS type, way_id AS id, 0 AS part, route, layer, (CASE WHEN route = 'polygon' THEN n - 1 ELSE n END)::BIGINT AS points, 0::BIGINT AS inner_points FROM rt
 UNION ALL SELECT 'relation', id, 0, CASE WHEN layer IS NULL THEN 'skipped' WHEN id % 7 = 3 THEN 'ignored' ELSE 'polygon' END, layer, CASE WHEN layer IS NOT NULL AND id % 7 <> 3 THEN 8 END, CASE WHEN layer IS NOT NULL THEN 4 ELSE 0 END FROM rel JOIN kt USING (t)
 UNION ALL SELECT 'relation', id, 1, 'polygon', layer, 3, 4 FROM rel JOIN kt USING (t) WHERE layer IS NOT NULL AND id % 7 <> 3 AND id % 3 = 0""")
def c09_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways and relations of one extract: a relation is its outer rings, each with all inner ones; without an outer ring it is ignored."""
    at = lambda v, r: F.struct((F.sin(v * (geo_pi() / 4)) * r * 0.01 + 45.98).alias("lat"), (F.cos(v * (geo_pi() / 4)) * r * 0.01 + 7.62).alias("lon"))
    member = lambda role, vs, r: F.struct(F.lit("way").alias("type"), F.lit(1).cast("long").alias("ref"), F.lit(role).alias("role"), F.array(*(at(F.lit(float(v)), r) for v in vs)).alias("geometry"))
    whole = F.array(*(member(*m) for m in MEMBERS))
    island = F.array(member("", [0, 2, 5, 0], 0.1))
    rels = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"))
    n = F.col("id")
    members = F.when(n % 7 == 3, F.filter(whole, lambda m: m["role"] == "inner")).when(n % 3 == 0, F.concat(whole, island)).otherwise(whole)
    rels = rels.join(F.broadcast(way_tags(spark)), F.col("t") == n % len_templates()).select(F.lit("relation").alias("type"), "id", "tags", F.lit(None).cast("array<struct<x: double, y: double>>").alias("points"), members.alias("members"))
    ways = _ways(spark, sf_dir).select("type", F.col("way_id").alias("id"), "tags", "points", F.lit(None).cast(rels.schema["members"].dataType).alias("members"))
    r = osm.routed(ways.unionByName(rels))
    ring = F.when(F.col("route") == "polygon", osm.open_ring(F.col("points"))).otherwise(F.col("points"))
    inner = F.aggregate("inners", F.lit(0), lambda s, i: s + F.size(i)).cast("long")
    return r.select("type", "id", "part", "route", "kind.layer", F.size(ring).cast("long").alias("points"), inner.alias("inner_points"))


def geo_pi() -> float:
    from ..functions import geo

    return geo.math.pi
