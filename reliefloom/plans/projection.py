"""Queries over projections, grids, tiles and selection shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.keys import dealt
from .derived import gps_points, selections
from .registry import Registry, r4, r6

REG = Registry()
DEG_SQL = "(pi() / 180)"

#: The model box that projections refer to.
BOX = (7.62, 45.94, 7.74, 46.02)


def _box() -> tuple:
    return tuple(F.lit(v) for v in BOX)


def _selection_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.lit(0.03)
    return selections(spark, sf_dir).select("sel_id", "lon", "lat", "radius_m", "k", (F.col("lon") - d).alias("west"), (F.col("lat") - d).alias("south"), (F.col("lon") + d).alias("east"), (F.col("lat") + d).alias("north"))


BOXES = "boxes AS (SELECT *, lon - 0.03e0 AS west, lat - 0.03e0 AS south, lon + 0.03e0 AS east, lat + 0.03e0 AS north FROM sel)"


@REG.add("WITH {SELECTIONS}, " + BOXES + f" SELECT sel_id, round((west + east) / 2, 6) + 0e0 AS lon0, round((south + north) / 2, 6) + 0e0 AS lat0, round(cos((south + north) / 2 * {DEG_SQL}), 6) + 0e0 AS cos_lat0 FROM boxes")
def b01_enu_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _selection_boxes(spark, sf_dir)
    o = geo.origin(*(F.col(c) for c in ("west", "south", "east", "north")))
    return b.select("sel_id", o.alias("o")).select("sel_id", *(r6(F.col(f"o.{c}")).alias(c) for c in ("lon0", "lat0", "cos_lat0")))


@REG.add(f"WITH {{GPS}}, {{MODEL}} SELECT route_id, seq, round(6378137 * (lon - lon0) * {DEG_SQL} * c0, 4) + 0e0 AS x_m, round(6378137 * (lat - lat0) * {DEG_SQL}, 4) + 0e0 AS y_m FROM gps, model")
def b02_project_enu(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.project(F.col("lon"), F.col("lat"), geo.origin(*_box()))
    return gps_points(spark, sf_dir).select("route_id", "seq", r4(x).alias("x_m"), r4(y).alias("y_m"))


@REG.add("WITH {GPS} SELECT route_id, seq, round(lon, 6) + 0e0 AS lon, round(lat, 6) + 0e0 AS lat FROM gps")
def b03_unproject_enu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected and back: the round trip gives the input."""
    o = geo.origin(*_box())
    lon, lat = geo.unproject(*geo.project(F.col("lon"), F.col("lat"), o), o)
    return gps_points(spark, sf_dir).select("route_id", "seq", r6(lon).alias("lon"), r6(lat).alias("lat"))


EXTENT = f"ext AS (SELECT *, 6378137 * (east - west) * {DEG_SQL} * cos((south + north) / 2 * {DEG_SQL}) AS ex, 6378137 * (north - south) * {DEG_SQL} AS ey FROM boxes)"


@REG.add("WITH {SELECTIONS}, " + BOXES + ", " + EXTENT + " SELECT sel_id, round(ex, 4) + 0e0 AS extent_x_m, round(ey, 4) + 0e0 AS extent_y_m FROM ext")
def b04_world_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.extent(*(F.col(c) for c in ("west", "south", "east", "north")))
    return _selection_boxes(spark, sf_dir).select("sel_id", r4(x).alias("extent_x_m"), r4(y).alias("extent_y_m"))


@REG.add(
    "WITH RECURSIVE {SELECTIONS}, big AS (SELECT sel_id, lon - 0.6e0 AS west, lat - 0.6e0 AS south, lon + 0.6e0 AS east, lat + 0.6e0 AS north, CASE WHEN sel_id % 3 = 0 THEN NULL ELSE 20e0 + sel_id END AS asked FROM sel), "
    + EXTENT.replace("FROM boxes", "FROM big")
    + """, s AS (SELECT *, 0.4e0 / (100e0 / greatest(ex, ey)) AS printable, least(greatest(greatest(ex, ey) / 600, 5), 500) AS target FROM ext),
    steps AS (SELECT sel_id, ex, ey, printable, target, asked, least(greatest(CASE WHEN asked IS NULL THEN greatest(target, printable) ELSE asked END, 5), 500) AS res, false AS coarsened FROM s
      UNION ALL
      SELECT sel_id, ex, ey, printable, target, asked, res * greatest(1.01e0, sqrt((ceil(ex / res) + 1) * (ceil(ey / res) + 1) / 1500000e0)), true FROM steps WHERE (ceil(ex / res) + 1) * (ceil(ey / res) + 1) > 1500000)
    SELECT sel_id, round(res, 4) + 0e0 AS resolution_m, (ceil(ex / res) + 1)::BIGINT AS cols, (ceil(ey / res) + 1)::BIGINT AS rows, coarsened,
           asked IS NULL AND greatest(target, printable) > target AS nozzle_limited, asked IS NOT NULL AND least(greatest(asked, 5), 500) < printable AS below_nozzle
    FROM steps WHERE (ceil(ex / res) + 1) * (ceil(ey / res) + 1) <= 1500000"""
)
def b05_resolve_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of over a degree, so that the vertex cap has to coarsen some grids."""
    d = F.lit(0.6)
    x, y = geo.extent(F.col("lon") - d, F.col("lat") - d, F.col("lon") + d, F.col("lat") + d)
    asked = F.when(F.col("sel_id") % 3 != 0, F.lit(20.0) + F.col("sel_id"))
    ready = selections(spark, sf_dir).select("sel_id", x.alias("ex"), y.alias("ey"), asked.alias("asked"))
    g = ready.select("sel_id", geo.grid(F.col("ex"), F.col("ey"), F.lit(100.0), F.lit(0.4), F.col("asked")).alias("g"))
    return g.select("sel_id", r4(F.col("g.resolution_m")).alias("resolution_m"), "g.cols", "g.rows", "g.coarsened", "g.nozzle_limited", "g.below_nozzle")


SCALE = """rel AS (SELECT user_id AS route_id, coalesce(min(value), 0) AS lo, coalesce(max(value), 0) * 30 AS hi FROM events GROUP BY user_id),
 sc AS (SELECT route_id, lo, hi, 100e0 / 9000e0 AS s, greatest(0e0, hi - lo + 5e0) AS relief FROM rel)"""


@REG.add(f"""WITH {SCALE} SELECT route_id, round(s, 6) + 0e0 AS scale, round(s * CASE WHEN relief * s * 1.5e0 > 30 AND relief > 0 THEN 30 / (relief * s) ELSE 1.5e0 END, 6) + 0e0 AS z_scale,
 round(CASE WHEN relief * s * 1.5e0 > 30 AND relief > 0 THEN 30 / (relief * s) ELSE 1.5e0 END, 6) + 0e0 AS effective, relief * s * 1.5e0 > 30 AND relief > 0 AS clamped FROM sc""")
def b06_resolve_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("route_id")).agg(F.coalesce(F.min("value"), F.lit(0.0)).alias("lo"), (F.coalesce(F.max("value"), F.lit(0.0)) * 30).alias("hi"))
    s = geo.scale(F.lit(9000.0), F.lit(8000.0), F.lit(100.0), F.col("lo"), F.col("hi"), F.lit(5.0), F.lit(1.5), F.lit(30.0))
    return rel.select("route_id", s.alias("s")).select("route_id", *(r6(F.col(f"s.{c}")).alias(c) for c in ("scale", "z_scale", "effective")), "s.clamped")


@REG.add(f"WITH {{GPS}}, {{MODEL}} SELECT route_id, seq, round(6378137 * (lon - lon0) * {DEG_SQL} * c0 * 0.01e0, 6) + 0e0 AS x_mm, round(6378137 * (lat - lat0) * {DEG_SQL} * 0.01e0, 6) + 0e0 AS y_mm, round(3e0 + greatest(0e0, (ele - 2e0 + 1e0) * 0.015e0), 6) + 0e0 AS z_mm FROM gps, model WHERE ele IS NOT NULL")
def b07_world_to_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.project(F.col("lon"), F.col("lat"), geo.origin(*_box()))
    p = geo.to_print(x, y, F.col("ele"), F.lit(0.01), F.lit(0.015), F.lit(2.0), F.lit(1.0), F.lit(3.0))
    return gps_points(spark, sf_dir).filter("ele IS NOT NULL").select("route_id", "seq", *(r6(v).alias(n) for v, n in zip(p, ("x_mm", "y_mm", "z_mm"))))


@REG.add("SELECT event_id, CASE WHEN value < 10 THEN 10e0 WHEN value > 50 THEN 50e0 ELSE value END AS clamped, CASE WHEN value < 60 THEN 60e0 WHEN value > 50 THEN 50e0 ELSE value END AS crossed FROM events")
def b08_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", geo.clamp(v, 10.0, 50.0).alias("clamped"), geo.clamp(v, 60.0, 50.0).alias("crossed"))


TILES = f"""tl AS (SELECT route_id, seq, lon, lat, z, (lon + 180) / 360 * pow(2e0, z) AS tx, (1 - ln(tan(lat * {DEG_SQL}) + 1 / cos(lat * {DEG_SQL})) / pi()) / 2 * pow(2e0, z) AS ty FROM (SELECT *, (seq % 15)::INT AS z FROM gps))"""


@REG.add(f"WITH {{GPS}}, {TILES} SELECT route_id, seq, z, round(tx, 6) + 0e0 AS tile_x, round(ty, 6) + 0e0 AS tile_y, round(tx / pow(2e0, z) * 360 - 180, 6) + 0e0 AS lon, round(180 / pi() * atan(0.5e0 * (exp(pi() - 2 * pi() * ty / pow(2e0, z)) - exp(-(pi() - 2 * pi() * ty / pow(2e0, z))))), 6) + 0e0 AS lat FROM tl")
def b09_tile_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("z")
    pts = gps_points(spark, sf_dir).withColumn("z", (F.col("seq") % 15).cast("int"))
    t = pts.select("route_id", "seq", "z", geo.tile_x(F.col("lon"), z).alias("tx"), geo.tile_y(F.col("lat"), z).alias("ty"))
    return t.select("route_id", "seq", "z", r6(F.col("tx")).alias("tile_x"), r6(F.col("ty")).alias("tile_y"), r6(geo.tile_lon(F.col("tx"), z)).alias("lon"), r6(geo.tile_lat(F.col("ty"), z)).alias("lat"))


@REG.add(f"WITH {{SELECTIONS}} SELECT sel_id, z, round(40075016.686e0 * cos(lat * {DEG_SQL}) / (pow(2e0, z) * 512), 6) + 0e0 AS metres FROM sel, (SELECT unnest(range(0, 16))::INT AS z)")
def b10_metres_per_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = selections(spark, sf_dir).select("sel_id", "lat", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("z"))
    return each.select("sel_id", "z", r6(geo.metres_per_pixel(F.col("z"), F.col("lat"), 512)).alias("metres"))


@REG.add(f"WITH {{SELECTIONS}} SELECT sel_id, coalesce(min(z) FILTER (WHERE 40075016.686e0 * cos(lat * {DEG_SQL}) / (pow(2e0, z) * 512) <= radius_m / 100), 14)::INT AS zoom FROM sel, (SELECT unnest(range(0, 15))::INT AS z) GROUP BY sel_id")
def b11_choose_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selections(spark, sf_dir).select("sel_id", geo.choose_zoom(F.col("radius_m") / 100, F.col("lat"), 512, 14).alias("zoom"))


def _sql_ty(lat: str) -> str:
    return f"floor((1 - ln(tan({lat} * {DEG_SQL}) + 1 / cos({lat} * {DEG_SQL})) / pi()) / 2 * pow(2e0, z))"


@REG.add(f"""WITH {{SELECTIONS}}, {BOXES}, zs AS (SELECT *, (sel_id % 13)::INT AS z FROM boxes)
 SELECT sel_id, least(greatest(floor((west + 180) / 360 * pow(2e0, z)) - 1, 0), pow(2e0, z) - 1)::BIGINT AS x_min, least(greatest(floor((east + 180) / 360 * pow(2e0, z)) + 1, 0), pow(2e0, z) - 1)::BIGINT AS x_max,
 least(greatest({_sql_ty("north")} - 1, 0), pow(2e0, z) - 1)::BIGINT AS y_min, least(greatest({_sql_ty("south")} + 1, 0), pow(2e0, z) - 1)::BIGINT AS y_max FROM zs""")
def b12_tile_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _selection_boxes(spark, sf_dir).withColumn("z", (F.col("sel_id") % 13).cast("int"))
    return b.select("sel_id", geo.tile_range(F.col("west"), F.col("south"), F.col("east"), F.col("north"), F.col("z")).alias("r")).select("sel_id", "r.x_min", "r.x_max", "r.y_min", "r.y_max")


HAV = f"""CASE WHEN plon IS NOT NULL THEN 2 * 6371008.8e0 * asin(least(1e0, sqrt(pow(sin((lat - plat) * {DEG_SQL} / 2), 2) + cos(plat * {DEG_SQL}) * cos(lat * {DEG_SQL}) * pow(sin((lon - plon) * {DEG_SQL} / 2), 2)))) END"""
PREV = "prev AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat, lag(ele) OVER w AS pele FROM gps WINDOW w AS (PARTITION BY route_id ORDER BY seq))"


@REG.add(f"WITH {{GPS}}, {PREV} SELECT route_id, seq, round({HAV}, 6) + 0e0 AS metres FROM prev WHERE plon IS NOT NULL")
def b14_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tracks import with_previous

    p = with_previous(gps_points(spark, sf_dir), ["lon", "lat"]).filter("prev_lon IS NOT NULL")
    return p.select("route_id", "seq", r6(geo.haversine(F.col("prev_lon"), F.col("prev_lat"), F.col("lon"), F.col("lat"))).alias("metres"))


@REG.add(f"WITH {{GPS}}, {PREV} SELECT route_id, seq, round(sqrt(pow(6378137 * (lon - plon) * {DEG_SQL} * cos(plat * {DEG_SQL}), 2) + pow(6378137 * (lat - plat) * {DEG_SQL}, 2)), 6) + 0e0 AS metres FROM prev WHERE plon IS NOT NULL")
def b15_metres_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tracks import with_previous

    p = with_previous(gps_points(spark, sf_dir), ["lon", "lat"]).filter("prev_lon IS NOT NULL")
    return p.select("route_id", "seq", r6(geo.metres_between(F.col("prev_lon"), F.col("prev_lat"), F.col("lon"), F.col("lat"))).alias("metres"))


@REG.add("""WITH s AS (SELECT event_id, value AS px, (event_id % 7)::DOUBLE AS py, (user_id % 5)::DOUBLE AS ax, 1e0 AS ay, (user_id % 5 + event_id % 4 * 10)::DOUBLE AS bx, (1 + event_id % 4 * 3)::DOUBLE AS yb FROM events),
 t AS (SELECT *, CASE WHEN bx = ax AND yb = ay THEN 0e0 ELSE least(greatest(((px - ax) * (bx - ax) + (py - ay) * (yb - ay)) / ((bx - ax) * (bx - ax) + (yb - ay) * (yb - ay)), 0), 1) END AS t FROM s)
 SELECT event_id, round(sqrt(pow(px - (ax + t * (bx - ax)), 2) + pow(py - (ay + t * (yb - ay)), 2)), 6) + 0e0 AS d FROM t""")
def b16_point_to_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id") % 4
    ax = (F.col("user_id") % 5).cast("double")
    d = geo.point_to_segment(F.col("value"), (F.col("event_id") % 7).cast("double"), ax, F.lit(1.0), ax + k * 10, F.lit(1.0) + k * 3)
    return e.select("event_id", r6(d).alias("d"))


@REG.add("""WITH {SELECTIONS} SELECT sel_id, round(0.15e0 / (100e0 / (radius_m * 20)), 6) + 0e0 AS tolerance_m, greatest(1e0, radius_m / 1000 / 2) AS penetration_mm,
 CASE WHEN k = 0 THEN 0.4e0 ELSE greatest(0.01e0, (k - 1) * 0.3e0) END AS min_width_mm,
 round(greatest(5e0 * (sel_id + 1) * 100 / (radius_m * 20), 0.4e0 * sqrt((5e0 * (sel_id + 1)) / 5e0)), 6) + 0e0 AS ladder_mm FROM sel""")
def b17_print_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simplify tolerance, penetration, minimum width and width ladder."""
    mm = F.lit(100.0) / (F.col("radius_m") * 20)
    return selections(spark, sf_dir).select(
        "sel_id", r6(geo.simplify_tolerance_m(mm)).alias("tolerance_m"), geo.penetration_mm(F.col("radius_m") / 1000).alias("penetration_mm"),
        geo.min_width_mm(F.when(F.col("k") != 0, (F.col("k") - 1) * 0.3), F.lit(0.4)).alias("min_width_mm"), r6(geo.ladder_width_mm(F.lit(5.0) * (F.col("sel_id") + 1), F.lit(5.0), mm, F.lit(0.4))).alias("ladder_mm"),
    )


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sel_id, lon, lat, ring: a rectangle, a circle or a hexagon. A selection is a few bytes and its ring much work: they are dealt over tasks first."""
    b = dealt(_selection_boxes(spark, sf_dir), "sel_id")
    lon, lat, r = F.col("lon"), F.col("lat"), F.col("radius_m")
    ring = F.when(F.col("k") == 0, geo.rectangle_ring(F.col("west"), F.col("south"), F.col("east"), F.col("north"))).when(F.col("k") == 1, geo.circle_ring(lon, lat, r)).otherwise(geo.regular_ring(lon, lat, r, 6, geo.math.pi / 6))
    return b.select("sel_id", "lon", "lat", "radius_m", "k", ring.alias("ring"))


def _vertices(rings: DataFrame, ring: F.Column) -> DataFrame:
    """sel_id, i, p: for a plain posexplode Spark would first filter by the ring's size, which makes each ring once more, before they are dealt."""
    return rings.select("sel_id", F.posexplode_outer(ring).alias("i", "p")).filter("i IS NOT NULL")


RINGS = f"""{BOXES}, ringp AS (
 SELECT sel_id, lon AS clon, lat AS clat, k, i, CASE i WHEN 0 THEN west WHEN 3 THEN west ELSE east END AS x, CASE WHEN i < 2 THEN south ELSE north END AS y FROM boxes, (SELECT unnest(range(0, 4)) AS i) WHERE k = 0
 UNION ALL SELECT sel_id, lon, lat, k, i, lon + cos(i / 192e0 * pi() * 2) * (radius_m / 6378137e0 / {DEG_SQL} / cos(lat * {DEG_SQL})), lat + sin(i / 192e0 * pi() * 2) * (radius_m / 6378137e0 / {DEG_SQL}) FROM boxes, (SELECT unnest(range(0, 192)) AS i) WHERE k = 1
 UNION ALL SELECT sel_id, lon, lat, k, i, lon + cos(pi() / 6 + i / 6e0 * pi() * 2) * radius_m / (6378137e0 * {DEG_SQL} * cos(lat * {DEG_SQL})), lat + sin(pi() / 6 + i / 6e0 * pi() * 2) * radius_m / (6378137e0 * {DEG_SQL}) FROM boxes, (SELECT unnest(range(0, 6)) AS i) WHERE k = 2)"""


@REG.add(f"WITH {{SELECTIONS}}, {RINGS} SELECT sel_id, i, round(x, 6) + 0e0 AS lon, round(y, 6) + 0e0 AS lat FROM ringp")
def b20_selection_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _vertices(_rings(spark, sf_dir), F.col("ring"))
    return each.select("sel_id", F.col("i").cast("long").alias("i"), r6(F.col("p.x")).alias("lon"), r6(F.col("p.y")).alias("lat"))


@REG.add(f"WITH {{SELECTIONS}}, {RINGS} SELECT sel_id, round(min(x), 6) + 0e0 AS west, round(min(y), 6) + 0e0 AS south, round(max(x), 6) + 0e0 AS east, round(max(y), 6) + 0e0 AS north FROM ringp GROUP BY sel_id")
def b21_selection_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _rings(spark, sf_dir).select("sel_id", geo.ring_bbox(F.col("ring")).alias("b"))
    return b.select("sel_id", *(r6(F.col(f"b.{c}")).alias(c) for c in ("west", "south", "east", "north")))


WORLD = f"world AS (SELECT sel_id, k, i, 6378137 * (x - clon) * {DEG_SQL} * cos(clat * {DEG_SQL}) AS x, 6378137 * (y - clat) * {DEG_SQL} AS y FROM ringp)"


@REG.add(f"WITH {{SELECTIONS}}, {RINGS}, {WORLD} SELECT sel_id, i, round(x, 4) + 0e0 AS x_m, round(y, 4) + 0e0 AS y_m FROM world")
def b22_ring_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _vertices(_rings(spark, sf_dir), geo.ring_world(F.col("ring"), geo.point_origin(F.col("lon"), F.col("lat"))))
    return w.select("sel_id", F.col("i").cast("long").alias("i"), r4(F.col("p.x")).alias("x_m"), r4(F.col("p.y")).alias("y_m"))


@REG.add(f"""WITH {{SELECTIONS}}, {RINGS}, {WORLD}, nx AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS yb FROM world WINDOW w AS (PARTITION BY sel_id ORDER BY i))
 SELECT sel_id, round(abs(sum(x * yb - bx * y) / 2) / 1e6, 4) + 0e0 AS area_km2 FROM nx GROUP BY sel_id""")
def b23_selection_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _rings(spark, sf_dir).select("sel_id", geo.ring_world(F.col("ring"), geo.point_origin(F.col("lon"), F.col("lat"))).alias("ring"))
    return w.select("sel_id", r4(F.abs(geo.ring_area(F.col("ring"))) / 1e6).alias("area_km2"))


@REG.add(f"""WITH {{SELECTIONS}}, {{MODEL}}, d AS (SELECT sel_id, lon, lat, lon + (k - 1) * 0.01e0 * (sel_id % 4) AS lon2, lat + 0.002e0 * (sel_id % 5) AS lat2, CASE sel_id % 4 WHEN 0 THEN 'rectangle' WHEN 1 THEN 'square' WHEN 2 THEN 'circle' ELSE 'hexagon' END AS tool FROM sel),
 m AS (SELECT *, 6378137 * (lon2 - lon) * {DEG_SQL} * cos(lat * {DEG_SQL}) AS dx, 6378137 * (lat2 - lat) * {DEG_SQL} AS dy FROM d),
 n AS (SELECT *, CASE tool WHEN 'rectangle' THEN CASE WHEN lon <> lon2 AND lat <> lat2 THEN 4 END WHEN 'square' THEN CASE WHEN greatest(abs(dx), abs(dy)) > 0 THEN 4 END WHEN 'circle' THEN CASE WHEN sqrt(dx * dx + dy * dy) >= 1 THEN 192 END ELSE CASE WHEN sqrt(dx * dx + dy * dy) >= 1 THEN 6 END END AS points FROM m)
 SELECT sel_id, tool, coalesce(points, 0)::INT AS points, round(CASE WHEN points IS NULL THEN NULL WHEN tool = 'rectangle' THEN abs(dy) WHEN tool = 'square' THEN greatest(abs(dx), abs(dy)) WHEN tool = 'circle' THEN 2 * sqrt(dx * dx + dy * dy) ELSE 2 * sqrt(dx * dx + dy * dy) END, 4) + 0e0 AS height_m FROM n""")
def b24_drawn_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = F.element_at(F.array(F.lit("rectangle"), F.lit("square"), F.lit("circle"), F.lit("hexagon")), (F.col("sel_id") % 4 + 1).cast("int"))
    d = selections(spark, sf_dir).select("sel_id", "lon", "lat", (F.col("lon") + (F.col("k") - 1) * F.lit(0.01) * (F.col("sel_id") % 4)).alias("lon2"), (F.col("lat") + F.lit(0.002) * (F.col("sel_id") % 5)).alias("lat2"), tool.alias("tool"))
    s = d.select("sel_id", "tool", geo.dragged_ring(F.col("tool"), F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")).alias("ring"))
    b = geo.ring_bbox(F.col("ring"))
    return s.select("sel_id", "tool", F.coalesce(F.size("ring"), F.lit(0)).alias("points"), r4((b["north"] - b["south"]) * geo.DEG * geo.ENU_RADIUS_M).alias("height_m"))


@REG.add(f"""WITH {{SELECTIONS}}, {RINGS}, c AS (SELECT sel_id, avg(x) AS cx, avg(y) AS cy FROM ringp GROUP BY sel_id),
 dist AS (SELECT sel_id, cx, cy, i, x, y, sqrt(pow(6378137 * (x - cx) * {DEG_SQL} * cos(cy * {DEG_SQL}), 2) + pow(6378137 * (y - cy) * {DEG_SQL}, 2)) AS d FROM ringp JOIN c USING (sel_id)),
 f AS (SELECT sel_id, max(d) AS now, min(cx) AS cx, min(cy) AS cy, min(y) AS south, max(y) AS north FROM dist GROUP BY sel_id),
 g AS (SELECT *, sqrt(pow(6378137 * 0.001e0 * sel_id * {DEG_SQL} * cos(cy * {DEG_SQL}), 2)) AS pointer FROM f)
 SELECT sel_id, round(cx, 6) + 0e0 AS centre_lon, round(cy, 6) + 0e0 AS centre_lat, round(now, 3) + 0e0 AS furthest_m, round(south + 0.5e0, 6) + 0e0 AS moved_south, round((north - south) * greatest(0.02e0, pointer / now), 6) + 0e0 AS resized_height FROM g""")
def b25_edited_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring, c = F.col("ring"), F.col("c")
    # a column for each step: a lambda would evaluate what it refers to again for each vertex
    s = _rings(spark, sf_dir).select("sel_id", "ring", geo.ring_centre(ring).alias("c"))
    s = s.withColumn("far", geo.ring_furthest(ring, c["x"], c["y"]))
    s = s.withColumn("now", geo.metres_between(c["x"], c["y"], F.col("far.x"), F.col("far.y")))
    s = s.withColumn("factor", geo.resize_factor(F.col("now"), geo.metres_between(c["x"], c["y"], c["x"] + F.lit(0.001) * F.col("sel_id"), c["y"])))
    s = s.withColumn("o", geo.point_origin(c["x"], c["y"]))
    s = s.withColumns({"moved": geo.ring_bbox(geo.ring_moved(ring, F.lit(0.25), F.lit(0.5))), "sized": geo.ring_bbox(geo.ring_scaled(ring, F.col("o"), F.col("factor")))})
    return s.select("sel_id", r6(c["x"]).alias("centre_lon"), r6(c["y"]).alias("centre_lat"), (F.round("now", 3) + 0.0).alias("furthest_m"), r6(F.col("moved.south")).alias("moved_south"), r6(F.col("sized.north") - F.col("sized.south")).alias("resized_height"))
