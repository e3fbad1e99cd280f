"""Queries over what is chosen, united or missing: settings filters, windings, parts of a model, failed sources, collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import lines, mesh, osm, raster, rings, rules, surface
from ..operators.keys import shuffled
from ..operators.lineage import cut
from ..sources import extract, geojson, gpx, settings
from .derived import dem_pixels, gps_points
from .features import _ways
from .inputs import _gpx_texts
from .layers import FIELD, HEAD, _circle_edges, _field, _water
from .meshes import BROKEN, SOLID, _broken
from .rasters import VALUE
from .registry import Registry, r4

REG = Registry()
#: What a user asks for: layer, enabled, subtypes.
CHOSEN = [("roads", True, ["motorway", "residential"]), ("railways", False, []), ("water", True, []), ("piers", True, ["breakwater"]), ("aeroways", True, [])]
CHOSEN_SQL = ", ".join(f"('{layer}', {str(on).lower()}, {subs}::VARCHAR[])" for layer, on, subs in CHOSEN)
AREA_SQL = ", ".join(f"({n}, '{a}', {w}e0, {s}e0, {e}e0, {t}e0)" for n, (a, w, s, e, t) in enumerate(settings.AREAS))
COLOUR_SQL = "[" + ", ".join(f"'{c}'" for c in settings.ROUTE_COLOURS) + "]"


@REG.add(HEAD + f", chosen(layer, enabled, subtypes) AS (VALUES {CHOSEN_SQL}) SELECT way_id, kind.layer AS layer, subtype FROM kind JOIN chosen ON chosen.layer = kind.layer WHERE enabled AND (len(subtypes) = 0 OR list_contains(subtypes, subtype))")
def c12_enabled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the layers and classes that the settings ask for."""
    f = osm.classified(_ways(spark, sf_dir)).select("way_id", "kind.layer", "kind.subtype")
    return osm.enabled(f, spark.createDataFrame(CHOSEN, "layer string, enabled boolean, subtypes array<string>"))


@REG.add(HEAD + """, wr AS (SELECT way_id AS ring_id, seq, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS yb FROM wp JOIN rt USING (way_id) WHERE route = 'polygon' AND layer = 'water' AND n >= 4 WINDOW w AS (PARTITION BY way_id ORDER BY seq)),
 a AS (SELECT ring_id, abs(sum(x * yb - bx * y)) / 2 AS area FROM wr GROUP BY ring_id) SELECT ring_id, round(area, 3) + 0e0 AS outer_m2, round(-area / 4, 3) + 0e0 AS hole_m2, round(area * 3 / 4, 3) + 0e0 AS area_m2 FROM a""")
def f14_winding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Water with a hole of half its width: outer rings counter-clockwise, holes clockwise, areas subtracted."""
    w = _water(spark, sf_dir).select("ring_id", geo.wound(F.col("ring")).alias("ring"))
    first = F.col("ring")[0]
    hole = F.transform("ring", lambda p: geo.point(first["x"] + (p["x"] - first["x"]) / 2, first["y"] + (p["y"] - first["y"]) / 2))
    w = w.withColumn("hole", geo.wound(hole, False))
    outer, inner = geo.ring_area(F.col("ring")), geo.ring_area(F.col("hole"))
    r3 = lambda c: F.round(c, 3) + 0.0
    return w.select("ring_id", r3(outer).alias("outer_m2"), r3(inner).alias("hole_m2"), r3(outer + inner).alias("area_m2"))


@REG.add("WITH {GPS}, n AS (SELECT route_id, count(*) AS n FROM gps GROUP BY route_id) SELECT 'r' || route_id || '.gpx' AS file, CASE WHEN n >= 2 AND route_id % 7 <> 3 THEN n ELSE 0 END AS points, CASE WHEN n < 2 OR route_id % 7 = 3 THEN 'gpx-unusable' END AS code FROM n")
def g06_route_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of many files, and a row for each file that gives none (G6): every seventh is cut off in its middle."""
    broken = F.regexp_extract("file", "[0-9]+", 0).cast("long") % 7 == 3
    texts = _gpx_texts(spark, sf_dir).withColumn("text", F.when(broken, F.expr("substring(text, 1, length(text) div 2)")).otherwise(F.col("text")))
    points = gpx.parsed(texts)
    good = points.groupBy("file").agg(F.count("*").alias("points")).withColumn("code", F.lit(None).cast("string"))
    return good.unionByName(gpx.failures(texts, points).withColumn("points", F.lit(0).cast("long")))


@REG.add("WITH e AS (SELECT DISTINCT user_id AS model_id FROM events) SELECT model_id, 'terrain' AS part, NULL AS code FROM e UNION ALL SELECT model_id, CASE WHEN model_id % 6 = 1 THEN NULL ELSE 'features' END, CASE WHEN model_id % 6 = 1 THEN 'osm-unavailable' END FROM e")
def k07_missing_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model whose extract is missing or unreadable gets a warning in place of its features and keeps its terrain (K7)."""
    m = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("model_id")).distinct()
    element = F.lit('{"elements":[{"type":"way","id":1,"tags":{"highway":"path"},"geometry":[{"lat":1.0,"lon":2.0},{"lat":1.1,"lon":2.0}]}]}')
    texts = m.select(F.col("model_id").alias("source"), F.when(F.col("model_id") % 6 == 1, F.lit("<html>busy</html>")).otherwise(element).alias("text"))
    found = extract.parsed(texts).select(F.col("source").alias("model_id")).distinct().withColumn("part", F.lit("features"))
    figures = m.join(found.select("model_id", F.lit(True).alias("ok")), "model_id", "left").select("model_id", F.coalesce("ok", F.lit(False)).alias("extract_found"))
    warnings = rules.judged(figures, "model_id", rules.source_rules()).select("model_id", F.lit(None).cast("string").alias("part"), "code")
    whole = m.withColumn("part", F.lit("terrain")).unionByName(found).withColumn("code", F.lit(None).cast("string"))
    return whole.unionByName(warnings)


@REG.add(f"WITH a(n, area, west, south, east, north) AS (VALUES {AREA_SQL}) SELECT c_custkey AS model_id, area, west, south, east, north FROM customer JOIN a ON c_custkey % 6 = n")
def a07_example_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that name an example area."""
    names = F.array(*(F.lit(a[0]) for a in settings.AREAS))
    m = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("model_id"), F.get(names, (F.col("c_custkey") % 6).cast("int")).alias("area"))
    return settings.with_area(m).select("model_id", "area", "west", "south", "east", "north")


@REG.add(HEAD + """, pg AS (SELECT way_id, list(printf('[%.5f,%.5f]', lon, lat) ORDER BY seq) AS c FROM ways JOIN rt USING (way_id) WHERE route = 'polygon' AND n >= 4 GROUP BY way_id)
 SELECT way_id, '{"type":"Polygon","coordinates":[[' || array_to_string(c, ',') || ',' || c[1] || ']]}' AS geojson FROM pg""")
def a12_geojson_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = osm.routed(_ways(spark, sf_dir)).filter("route = 'polygon'").select("way_id", osm.open_ring(F.col("points")).alias("r")).filter("size(r) >= 3")
    return w.select("way_id", geojson.polygon(F.col("r"), 5).alias("geojson"))


@REG.add("WITH {GPS}, l AS (SELECT route_id, count(*) AS n, list(printf('[%.5f,%.5f]', lon, lat) ORDER BY seq) AS c FROM gps GROUP BY route_id), f AS (SELECT route_id, route_id % 20 AS request, '{\"type\":\"Feature\",\"properties\":{\"color\":\"' || (" + COLOUR_SQL + ")[route_id % 8 + 1] || '\",\"visible\":' || (route_id % 3 <> 0)::VARCHAR || '},\"geometry\":{\"type\":\"LineString\",\"coordinates\":[' || CASE WHEN n >= 2 THEN array_to_string(c, ',') ELSE '' END || ']}}' AS j FROM l) SELECT request, sha256('{\"type\":\"FeatureCollection\",\"features\":[' || string_agg(j, ',' ORDER BY route_id) || ']}') AS sha FROM f GROUP BY request")
def a12_route_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routes of each request as one collection, with colour and visibility."""
    p = gps_points(spark, sf_dir).groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("ps"))
    colours = F.array(*map(F.lit, settings.ROUTE_COLOURS))
    about = F.struct(F.get(colours, (F.col("route_id") % 8).cast("int")).alias("color"), (F.col("route_id") % 3 != 0).alias("visible"))
    f = p.select("route_id", (F.col("route_id") % 20).alias("request"), geojson.feature(geojson.line(F.col("ps"), 5), about).alias("j"))
    g = f.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("route_id", "j"))).alias("fs"))
    return g.select("request", F.sha2(geojson.collection(F.transform("fs", lambda x: x["j"])), 256).alias("sha"))


@REG.add("SELECT o_orderkey AS tile, 'dem:mapterhorn/' || (6 + o_orderkey % 9) || '/' || o_custkey || '/' || o_orderkey % 512 AS key, 'https://tiles.example/' || (6 + o_orderkey % 9) || '/' || o_custkey || '/' || o_orderkey % 512 || '.webp' AS url FROM orders")
def a13_tile_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and addresses of tiles."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    place = (F.lit(6) + F.col("o_orderkey") % 9, F.col("o_custkey"), F.col("o_orderkey") % 512)
    return o.select(F.col("o_orderkey").alias("tile"), settings.tile_key(F.lit("mapterhorn"), *place).alias("key"), settings.tile_url(F.lit("https://tiles.example/{z}/{x}/{y}.webp"), *place).alias("url"))


@REG.add(f"""WITH {{DEM}}, {SOLID}, {BROKEN}, pv AS MATERIALIZED (SELECT model_id AS part, vid, x, row_number() OVER (PARTITION BY model_id ORDER BY vid) - 1 AS at FROM mv), pt AS MATERIALIZED (SELECT model_id AS part, a, b, c, row_number() OVER (PARTITION BY model_id ORDER BY tid) - 1 AS n FROM mt),
 ov AS (SELECT part, coalesce(sum(k) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM (SELECT part, count(*) AS k FROM pv GROUP BY part)), ot AS (SELECT part, coalesce(sum(k) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lead FROM (SELECT part, count(*) AS k FROM pt GROUP BY part))
 SELECT (lead + n)::BIGINT AS tid, pt.part, (first + va.at)::BIGINT AS a, (first + vb.at)::BIGINT AS b, (first + vc.at)::BIGINT AS c, round(va.x::DOUBLE, 4) + 0e0 AS x FROM pt JOIN ov ON ov.part = pt.part JOIN ot ON ot.part = pt.part JOIN pv va ON va.part = pt.part AND va.vid = a JOIN pv vb ON vb.part = pt.part AND vb.vid = b JOIN pv vc ON vc.part = pt.part AND vc.vid = c""")
def g05_united_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four solids as the parts of one model, with dense numbers."""
    t, v = _broken(spark, sf_dir)
    as_part = lambda df: df.withColumnRenamed("model_id", "part").withColumn("model_id", F.lit(0))
    v, t = mesh.merged(as_part(v), as_part(t))
    return t.join(shuffled(v.select("model_id", F.col("vid").alias("a"), "x")), ["model_id", "a"]).select("tid", "part", "a", "b", "c", r4(F.col("x").cast("double")).alias("x"))


#: The footprint's cells as SQL: corner flags, and the crossings of their sides.
CELLS = """c8 AS (SELECT layer, i - dx AS i, j - dy AS j, max(CASE WHEN dx = 0 AND dy = 0 THEN d END) AS v0, max(CASE WHEN dx = 1 AND dy = 0 THEN d END) AS v1, max(CASE WHEN dx = 1 AND dy = 1 THEN d END) AS v2, max(CASE WHEN dx = 0 AND dy = 1 THEN d END) AS v3 FROM fld, (VALUES (0, 0), (1, 0), (1, 1), (0, 1)) o(dx, dy) GROUP BY 1, 2, 3),
 cc AS (SELECT *, coalesce(v0 < {iso}, false)::INT AS a, coalesce(v1 < {iso}, false)::INT AS b, coalesce(v2 < {iso}, false)::INT AS c, coalesce(v3 < {iso}, false)::INT AS e, coalesce((v0 + v1 + v2 + v3) / 4 < {iso}, false) AS joined FROM c8),
 kd AS (SELECT *, abs(a - b) + abs(b - c) + abs(c - e) + abs(e - a) AS cuts, a + b + c + e AS held FROM cc),
 tp AS (SELECT layer, sum(CASE WHEN held = 0 THEN 0 WHEN cuts = 4 AND NOT joined THEN 2 ELSE held + cuts - 2 END) AS faces, sum(cuts // 2) AS rim, sum(a + (a <> b)::INT + (a <> e)::INT) AS points FROM kd GROUP BY layer)"""


def _ground(spark: SparkSession, sf_dir: str, vertices: DataFrame, x: F.Column, y: F.Column) -> DataFrame:
    """model_id, vid, ground: the elevation pixels between their centres, empty ones at sea level."""
    p = dem_pixels(spark, sf_dir)
    v = raster.decoded(F.col("r"), F.col("g"), F.col("b"))
    pixels = p.select("px", "py", F.when(raster.is_nodata(v), F.lit(0.0)).otherwise(v).alias("v"))
    size = p.agg(F.max("px") + 1, F.max("py") + 1).first()  # one row
    probes = vertices.select(F.struct("model_id", "vid").alias("id"), x.alias("x"), y.alias("y"))
    return raster.bilinear(probes, pixels, F.lit(size[0]), F.lit(size[1])).select("id.model_id", "id.vid", F.col("v").alias("ground"))


#: The parts of the cells, as polygons, and their areas.
POLYGONS = """ pl AS (SELECT layer, i, j, list_filter([CASE WHEN a = 1 THEN {'x': i * 20e0, 'y': j * 20e0} END,
   CASE WHEN a <> b THEN {'x': (i + CASE WHEN v0 IS NULL THEN 0e0 WHEN v1 IS NULL THEN 1e0 ELSE (20 - v0) / (v1 - v0) END) * 20e0, 'y': j * 20e0} END, CASE WHEN b = 1 THEN {'x': (i + 1) * 20e0, 'y': j * 20e0} END,
   CASE WHEN b <> c THEN {'x': (i + 1) * 20e0, 'y': (j + CASE WHEN v1 IS NULL THEN 0e0 WHEN v2 IS NULL THEN 1e0 ELSE (20 - v1) / (v2 - v1) END) * 20e0} END, CASE WHEN c = 1 THEN {'x': (i + 1) * 20e0, 'y': (j + 1) * 20e0} END,
   CASE WHEN c <> e THEN {'x': (i + CASE WHEN v3 IS NULL THEN 0e0 WHEN v2 IS NULL THEN 1e0 ELSE (20 - v3) / (v2 - v3) END) * 20e0, 'y': (j + 1) * 20e0} END, CASE WHEN e = 1 THEN {'x': i * 20e0, 'y': (j + 1) * 20e0} END,
   CASE WHEN e <> a THEN {'x': i * 20e0, 'y': (j + CASE WHEN v0 IS NULL THEN 0e0 WHEN v3 IS NULL THEN 1e0 ELSE (20 - v0) / (v3 - v0) END) * 20e0} END], lambda x: x IS NOT NULL) AS p, cuts = 4 AND NOT joined AS split, a FROM kd WHERE held > 0),
 pp AS (SELECT layer, i, j, p FROM pl WHERE NOT split UNION ALL SELECT layer, i, j, unnest(CASE WHEN a = 1 THEN [[p[6], p[1], p[2]], [p[3], p[4], p[5]]] ELSE [[p[1], p[2], p[3]], [p[4], p[5], p[6]]] END) FROM pl WHERE split),
 ar AS (SELECT layer, sum((p[k].x - i * 20e0) * (p[k % len(p) + 1].y - j * 20e0) - (p[k % len(p) + 1].x - i * 20e0) * (p[k].y - j * 20e0)) / 2 AS area FROM (SELECT layer, i, j, p, unnest(range(1, len(p) + 1)) AS k FROM pp) GROUP BY layer)"""


@REG.add(HEAD + f""", {FIELD}, {CELLS.format(iso=20)}, {POLYGONS}
 SELECT layer, 2 * points::BIGINT AS vertices, (2 * faces + 2 * rim)::BIGINT AS triangles, 0::BIGINT AS open_edges, 0::BIGINT AS non_manifold, false AS inverted, round(area * 7 / 1000) + 0e0 AS thousand_m3 FROM tp JOIN ar USING (layer)""")
def i03_draped_solid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each layer's footprint as a solid on the ground: five metres above it, two below."""
    v, t = map(cut, surface.footprint(cut(_field(spark, sf_dir)), 20.0, 20.0))
    ground = _ground(spark, sf_dir, v, (F.col("x") + 5000) / 100, (F.col("y") + 5000) / 100)
    v, t = map(cut, surface.solid(surface.draped(v, ground, 5.0, 2.0, -1e9), t))
    n = v.groupBy("model_id").agg(F.count("*").alias("vertices"))
    return mesh.audit(t, v).join(n, "model_id").select(F.col("model_id").alias("layer"), "vertices", "triangles", "open_edges", "non_manifold", "inverted", (F.round(F.col("volume_mm3") / 1000) + 0.0).alias("thousand_m3"))


@REG.add(HEAD + f""", {FIELD}, {CELLS.format(iso=20)}, {POLYGONS} SELECT layer, sum(cuts // 2)::BIGINT AS points, true AS dense, round(any_value(area)) + 0e0 AS area_m2 FROM kd JOIN ar USING (layer) GROUP BY layer""")
def f12_ring_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rings chained from each layer's contour: all its segments, numbered without gaps, around the area that the cells have."""
    chained = cut(rings.chained(lines.contour(_field(spark, sf_dir), 20.0, 20.0), 20.0))
    dense = chained.groupBy("model_id", "ring").agg((F.max("seq") + 1 == F.count_distinct("seq")).alias("dense")).groupBy("model_id").agg(F.bool_and("dense").alias("dense"))
    total = rings.measured(chained).groupBy("model_id").agg(F.sum("points").alias("points"), (F.round(F.sum("area")) + 0.0).alias("area_m2"))
    return total.join(dense, "model_id").select(F.col("model_id").alias("layer"), "points", "dense", "area_m2")


#: A selection ring of 64 sides around the grid's middle, and the nodes inside it.
CLIP = """cir AS (SELECT u, {r}e0 * cos(u / {n}e0 * 2 * pi()) AS px, {r}e0 * sin(u / {n}e0 * 2 * pi()) AS py, {r}e0 * cos((u + 1) % {n} / {n}e0 * 2 * pi()) AS qx, {r}e0 * sin((u + 1) % {n} / {n}e0 * 2 * pi()) AS qy FROM (SELECT unnest(range(0, {n})) AS u)),
 nd AS (SELECT px - 50 AS i, py - 50 AS j FROM dem),
 msk AS (SELECT i, j, count(*) FILTER (WHERE (py > j * 100e0) <> (qy > j * 100e0) AND i * 100e0 < (qx - px) * (j * 100e0 - py) / (qy - py) + px) % 2 = 1 AS ins FROM nd, cir GROUP BY i, j),
 fld AS (SELECT 0 AS layer, i, j, CASE WHEN ins THEN -1e0 ELSE 1e0 END AS d FROM msk)"""


def _clipped(spark: SparkSession, sf_dir: str, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices and triangles of the elevation grid inside the circle, or another ring: sides cut where the ring crosses them."""
    nodes = dem_pixels(spark, sf_dir).select((F.col("px") - 50).alias("i"), (F.col("py") - 50).alias("j"))
    edges = _circle_edges(spark) if edges is None else edges
    rows = nodes.select(F.lit(0).alias("key"), "j").distinct().withColumn("y", F.col("j") * 100.0)
    spans = lines.row_spans(rows, edges)
    at = F.col("i") * 100.0
    inside = nodes.join(spans, "j").filter((at >= F.col("x_from")) & (at < F.col("x_to"))).select("i", "j").distinct().withColumn("inside", F.lit(True))
    field = nodes.join(inside, ["i", "j"], "left").select(F.lit(0).alias("model_id"), "i", "j", F.when(F.col("inside"), -1.0).otherwise(1.0).alias("d"))
    field = cut(field)
    flat = surface.crossings(surface.cells(field), 0.0).filter("kind = 1").select("model_id", "kind", "i", "j")
    tall = surface.crossings(surface.cells(field), 0.0).filter("kind = 2").select("model_id", "kind", "i", "j")
    sides = flat.withColumns({"bx": (F.col("i") + 1) * 100.0, "by": F.col("j") * 100.0}).unionByName(tall.withColumns({"bx": F.col("i") * 100.0, "by": (F.col("j") + 1) * 100.0}))
    sides = sides.select(F.struct("model_id", "kind", "i", "j").alias("id"), (F.col("i") * 100.0).alias("ax"), (F.col("j") * 100.0).alias("ay"), "bx", "by")
    cuts = rings.crossings(sides, edges, 500.0).select("id.model_id", "id.kind", "id.i", "id.j", "t")
    return surface.footprint(field, 0.0, 100.0, cuts)


@REG.add(f"""WITH {{DEM}}, {VALUE}, {CLIP.format(n=64, r=3000)}, {CELLS.format(iso=0)} SELECT 2 * points::BIGINT AS vertices, (2 * faces + 2 * rim)::BIGINT AS triangles, 0::BIGINT AS open_edges, 0::BIGINT AS non_manifold, false AS inverted, rim::BIGINT AS rim FROM tp WHERE faces > 0""")
def i02_clipped_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terrain inside a selection as a closed solid down to its base (I2, F13: one wall for each edge of the rim)."""
    v, t = map(cut, _clipped(spark, sf_dir))
    rim = mesh.boundary(t).groupBy("model_id").agg(F.count("*").alias("rim"))
    ground = _ground(spark, sf_dir, v, F.col("x") / 100 + 50, F.col("y") / 100 + 50)
    top = v.join(ground, ["model_id", "vid"]).select("model_id", "vid", "x", "y", (F.greatest("ground", F.lit(0.0)) + 300).alias("top"), F.lit(0.0).alias("bottom"))
    v, t = map(cut, surface.solid(top, t))
    n = v.groupBy("model_id").agg(F.count("*").alias("vertices"))
    return mesh.audit(t, v).join(n, "model_id").join(rim, "model_id").select("vertices", "triangles", "open_edges", "non_manifold", "inverted", "rim")


@REG.add(f"""WITH {{DEM}}, {VALUE}, {CLIP.format(n=96, r=2990)}, {CELLS.format(iso=0)},
 sd AS (SELECT 1 AS kind, i, j, v0 AS p, v1 AS q, i * 100e0 AS ax, j * 100e0 AS ay, 100e0 AS dx, 0e0 AS dy FROM kd WHERE a <> b UNION ALL SELECT 2, i, j, v0, v3, i * 100e0, j * 100e0, 0e0, 100e0 FROM kd WHERE a <> e),
 mt AS (SELECT kind, i, j, min(CASE WHEN dx * ry - dy * rx <> 0 THEN CASE WHEN (ox * ry - oy * rx) / (dx * ry - dy * rx) BETWEEN 0 AND 1 AND (ox * dy - oy * dx) / (dx * ry - dy * rx) BETWEEN 0 AND 1 THEN (ox * ry - oy * rx) / (dx * ry - dy * rx) END END) AS t
   FROM (SELECT kind, i, j, dx, dy, qx - px AS rx, qy - py AS ry, px - ax AS ox, py - ay AS oy FROM sd, cir) GROUP BY kind, i, j),
 xp AS (SELECT sd.kind, sd.i, sd.j, ax + dx * u AS x, ay + dy * u AS y FROM (SELECT sd.*, coalesce(least(greatest(t, 0.001e0), 0.999e0), CASE WHEN p IS NULL THEN 0e0 WHEN q IS NULL THEN 1e0 ELSE 0.5e0 END) AS u FROM sd JOIN mt USING (kind, i, j)) sd),
 en AS (SELECT kd.i, kd.j, x, y FROM kd JOIN xp ON (xp.kind = 1 AND xp.i = kd.i AND (xp.j = kd.j OR xp.j = kd.j + 1)) OR (xp.kind = 2 AND xp.j = kd.j AND (xp.i = kd.i OR xp.i = kd.i + 1)) WHERE cuts = 2),
 le AS (SELECT i, j, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) AS len FROM en GROUP BY i, j)
 SELECT (points - (3 * faces + rim) // 2 + faces)::BIGINT AS rings, rim::BIGINT AS points, (SELECT round(sum(len), 3) + 0e0 FROM le) AS length_m FROM tp""")
def f13_boundary_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rim of the terrain inside a ring of 192 points, coarsened to a cell before it cuts: rings, their points and length."""
    a = F.col("id") / 192 * 2 * geo.math.pi
    ring = spark.range(192).select(F.lit(0).alias("ring"), F.col("id").alias("seq"), (F.cos(a) * 2990).alias("x"), (F.sin(a) * 2990).alias("y"))
    shape = rings.measured(rings.coarsened(ring, 100.0)).select(F.col("ring").alias("ring_id"), F.col("shape").alias("ring"), F.array().cast(osm.RINGS).alias("holes"))
    v, t = map(cut, _clipped(spark, sf_dir, cut(lines.ring_edges(shape))))
    rim = rings.boundary_rings(mesh.boundary(t), v)
    around = rings.measured(rim).select("model_id", "ring", "points", F.aggregate(geo._cyclic(F.col("shape")), F.lit(0.0), lambda s, e: s + geo.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])).alias("length"))
    total = around.groupBy("model_id").agg(F.count("*").alias("rings"), F.sum("points").alias("points"), (F.round(F.sum("length"), 3) + 0.0).alias("length_m"))
    models = dem_pixels(spark, sf_dir).select(F.lit(0).alias("model_id")).distinct()  # one that lies outside the ring has no rim
    return models.join(total, "model_id", "left").select(*(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("rings", "points")), "length_m")
