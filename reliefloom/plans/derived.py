"""Geodata derived from the driver's tables by arithmetic, and the same as DuckDB CTEs.

Queries read these as if they were GPS points, elevation pixels, ways, tags and selections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_GPS = """
  SELECT user_id AS route_id, seq, t_ms, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS ele,
         7.62e0 + 0.12e0 * ((user_id * 31 + s2 * 7919) % 10007) / 10007e0 AS lon,
         45.94e0 + 0.08e0 * ((user_id * 17 + s2 * 104729) % 10007) / 10007e0 AS lat
  FROM (SELECT *, seq - (CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END) AS s2 FROM (
    SELECT event_id, user_id, event_type, value, {time} AS t_ms,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) s) u"""

_DEM = """
  SELECT o_orderkey % 100 AS px, cast(floor(o_orderkey / 100e0) AS bigint) AS py,
         CASE WHEN nd THEN 0 ELSE 127 + o_custkey % 3 END AS r, CASE WHEN nd THEN 0 ELSE (o_orderkey * 37) % 256 END AS g, CASE WHEN nd THEN 0 ELSE o_custkey % 256 END AS b
  FROM (SELECT *, (o_orderkey % 97 < 3) OR (o_orderkey % 100 BETWEEN 40 AND 49 AND floor(o_orderkey / 100e0) BETWEEN 5 AND 10) AS nd FROM orders) o"""

_WAYS = """
  SELECT p_partkey AS way_id, k AS seq, 7.62e0 + 0.12e0 * ((p_partkey * 613 + k * 37) % 1009) / 1009e0 AS lon,
         45.94e0 + 0.08e0 * ((p_partkey * 401 + k * 53) % 1009) / 1009e0 AS lat
  FROM part, (SELECT {each} AS k) z WHERE k < 2 + p_size % 7"""

_SELECTIONS = """
  SELECT c_custkey AS sel_id, -170e0 + c_custkey % 25 * 13.7e0 + c_custkey % 1009 * 0.001e0 AS lon, -60e0 + c_custkey % 25 * 5.2e0 AS lat,
         500e0 + 100e0 * (c_custkey % 25) AS radius_m, c_custkey % 3 AS k FROM customer"""

#: One row of tags for each template: t, closed, and the tags as [key, value] pairs.
TEMPLATES: list[tuple[int, bool, list[tuple[str, str]]]] = [
    (0, False, [("highway", "motorway")]), (1, False, [("highway", "primary"), ("bridge", "yes")]), (2, False, [("highway", "residential")]), (3, False, [("highway", "track"), ("tunnel", "yes")]),
    (4, False, [("highway", "footway")]), (5, False, [("highway", "bus_stop"), ("natural", "water")]), (6, False, [("railway", "rail")]), (7, False, [("railway", "abandoned")]), (8, False, [("railway", "rail"), ("disused", "yes")]),
    (9, False, [("aeroway", "runway")]), (10, False, [("man_made", "pier")]), (11, False, [("piste:type", "nordic")]), (12, False, [("waterway", "river")]), (13, True, [("waterway", "riverbank")]),
    (14, True, [("natural", "water"), ("water", "pond")]), (15, True, [("landuse", "reservoir")]), (16, True, [("building", "church"), ("height", "10 m")]), (17, True, [("building", "yes"), ("building:levels", "3 floors")]),
    (18, True, [("building:part", "yes"), ("height", "32 ft"), ("min_height", "4'6\"")]), (19, True, [("leisure", "park")]), (20, True, [("natural", "beach")]), (21, False, [("highway", "primary"), ("tunnel", "no"), ("layer", "-1")]),
    (22, False, [("highway", "service"), ("location", "underground")]), (23, False, [("amenity", "cafe")]), (24, False, [("natural", "water")]),
]
_ROWS = ", ".join(f"({t}, {str(c).lower()}, '{k}', '{v.replace(chr(39), chr(39) * 2)}')" for t, c, tags in TEMPLATES for k, v in tags)

GPS_SQL = "gps AS (" + _GPS.format(time="epoch_us(ts) // 100000") + ")"
DEM_SQL = "dem AS (" + _DEM + ")"
WAYS_SQL = "ways AS (" + _WAYS.format(each="unnest(range(0, 8))") + ")"
SELECTIONS_SQL = "sel AS (" + _SELECTIONS + ")"
TAGS_SQL = f"tag_rows(t, closed, k, v) AS (VALUES {_ROWS}), tags AS (SELECT t, closed, map_from_entries(list((k, v))) AS tags FROM tag_rows GROUP BY t, closed)"
MODEL_SQL = "model AS (SELECT 7.62e0 AS west, 45.94e0 AS south, 7.74e0 AS east, 46.02e0 AS north, (7.62e0 + 7.74e0) / 2 AS lon0, (45.94e0 + 46.02e0) / 2 AS lat0, cos((45.94e0 + 46.02e0) / 2 * (pi() / 180)) AS c0)"


def _views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def gps_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "events")
    return spark.sql(_GPS.format(time="unix_micros(cast(ts AS timestamp)) div 100000"))


def dem_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "orders")
    return spark.sql(_DEM)


TILE_PX = 16


def dem_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z, x, y, rgb: the pixels as raw tiles of 16 by 16; every eleventh tile is lacking, and pixels that are not there are black."""
    p = dem_pixels(spark, sf_dir).select((F.col("px") % TILE_PX + F.col("py") % TILE_PX * TILE_PX).cast("int").alias("at"), F.floor(F.col("px") / TILE_PX).alias("x"), F.floor(F.col("py") / TILE_PX).alias("y"), *(F.lpad(F.hex(c), 2, "0").alias(c) for c in "rgb"))
    t = p.filter((F.col("x") * 7 + F.col("y") * 3) % 11 != 4).groupBy("x", "y").agg(F.map_from_entries(F.collect_list(F.struct("at", F.concat("r", "g", "b")))).alias("m"))
    each = F.transform(F.sequence(F.lit(0), F.lit(TILE_PX * TILE_PX - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit("000000")))
    return t.select(F.lit(6).alias("z"), "x", "y", F.unhex(F.array_join(each, "")).alias("rgb"))


def way_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "part")
    return spark.sql(_WAYS.format(each="explode(sequence(0, 7))"))


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "customer")
    return spark.sql(_SELECTIONS)


def way_tags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, c, dict(tags)) for t, c, tags in TEMPLATES], "t int, closed boolean, tags map<string,string>")
