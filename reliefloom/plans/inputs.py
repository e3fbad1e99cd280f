"""Queries over sources, settings, rings and the remaining rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import lines, rings, rules
from ..operators.lineage import cut
from ..sources import extract, gpx, settings
from .derived import gps_points, selections
from .features import CLASS_SQL, GEOM_SQL, PART_TAGS, _ways
from .layers import HEAD, _circle_edges, _field
from .projection import BOXES, EXTENT
from .registry import Registry, r4, r6

REG = Registry()


def _gpx_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each route written as a GPX file: most as tracks, some as routes, some as waypoints only."""
    p = gps_points(spark, sf_dir)
    tag = F.when(F.col("route_id") % 5 == 0, "rtept").when(F.col("route_id") % 5 == 1, "wpt").otherwise("trkpt")
    ele = F.coalesce(F.format_string("<ele>%.2f</ele>", "ele"), F.lit(""))
    at = F.concat(F.lit("<"), tag, F.format_string(' lat="%.15f" lon="%.15f">', "lat", "lon"), F.when(F.col("ele").isNull(), "").otherwise(ele), F.lit("</"), tag, F.lit(">"))
    g = p.groupBy("route_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", at.alias("x")))), lambda v: v["x"]), "").alias("body"))
    open_, close = F.when(F.col("route_id") % 5 == 0, "<rte>").when(F.col("route_id") % 5 == 1, "").otherwise("<trk><trkseg>"), F.when(F.col("route_id") % 5 == 0, "</rte>").when(F.col("route_id") % 5 == 1, "").otherwise("</trkseg></trk>")
    return g.select(F.concat(F.lit("r"), F.col("route_id"), F.lit(".gpx")).alias("file"), F.concat(F.lit("<gpx>"), open_, F.col("body"), close, F.lit("</gpx>")).alias("text"))


@REG.add("WITH {GPS}, n AS (SELECT *, count(*) OVER (PARTITION BY route_id) AS n FROM gps) SELECT 'r' || route_id || '.gpx' AS file, 1 AS track, (seq - 1)::INT AS seq, round(lon, 6) + 0e0 AS lon, round(lat, 6) + 0e0 AS lat, ele FROM n WHERE n >= 2")
def a01_gpx_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes written as GPX text and parsed again: tracks, routes and bare waypoints."""
    return gpx.parsed(_gpx_texts(spark, sf_dir)).select("file", "track", "seq", r6(F.col("lon")).alias("lon"), r6(F.col("lat")).alias("lat"), "ele")


@REG.add("WITH {TAGS}, {WAYS}, " + f"{PART_TAGS}, {CLASS_SQL}, {GEOM_SQL} SELECT way_id AS id, 'way' AS type, n::INT AS points, len(map_keys(tags))::INT AS tags FROM pt JOIN geom USING (way_id)")
def a02_extract_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways written as extract documents and parsed again."""
    points = F.transform("points", lambda p: F.struct(p["y"].alias("lat"), p["x"].alias("lon")))
    e = _ways(spark, sf_dir).select((F.col("way_id") % 50).alias("source"), F.struct(F.lit("way").alias("type"), F.col("way_id").alias("id"), "tags", points.alias("geometry")).alias("e"))
    texts = e.groupBy("source").agg(F.to_json(F.struct(F.collect_list("e").alias("elements"))).alias("text"))
    return extract.parsed(texts).select("id", "type", F.size("points").alias("points"), F.size("tags").alias("tags"))


@REG.add("""WITH r AS (SELECT DISTINCT 'f' || user_id % 30 AS file, user_id AS track FROM events), n AS (SELECT *, row_number() OVER (ORDER BY file, track) - 1 AS n FROM r)
 SELECT file, track, """ + str(settings.ROUTE_COLOURS) + "[n % 8 + 1] AS color FROM n")
def a08_route_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("f"), F.col("user_id") % 30).alias("file"), F.col("user_id").alias("track")).distinct()
    return settings.route_coloured(r)


LAYER_ROWS = ", ".join(f"('{n}', '{k}', {str(on).lower()}, '{c}', {h}e0)" for n, k, on, c, h in settings.LAYER_DEFAULTS)


@REG.add(f"""WITH {{SELECTIONS}}, d(layer, kind, enabled, color, height_mm) AS (VALUES {LAYER_ROWS})
 SELECT sel_id AS model_id, layer, kind, CASE WHEN layer = 'trails' AND sel_id % 2 = 0 THEN true ELSE enabled END AS enabled, color, CASE WHEN layer = 'roads' AND sel_id % 5 = 0 THEN 2.5e0 ELSE height_mm END AS height_mm FROM sel, d""")
def a08_layer_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layers of each model: what is asked for over the defaults."""
    m = selections(spark, sf_dir).select(F.col("sel_id").alias("model_id"))
    n = F.col("model_id")
    trails = m.filter(n % 2 == 0).select("model_id", F.lit("trails").alias("layer"), F.lit(True).alias("enabled"), F.lit(None).cast("double").alias("height_mm"))
    roads = m.filter(n % 5 == 0).select("model_id", F.lit("roads").alias("layer"), F.lit(None).cast("boolean").alias("enabled"), F.lit(2.5).alias("height_mm"))
    return settings.with_layers(m, trails.unionByName(roads)).select("model_id", "layer", "kind", "enabled", "color", "height_mm")


@REG.add("""WITH r AS (SELECT DISTINCT 'f' || user_id % 30 AS file, user_id AS track FROM events), n AS (SELECT *, row_number() OVER (ORDER BY file, track) - 1 AS n FROM r)
 SELECT file, track, CASE WHEN track % 9 = 0 THEN '#000000' ELSE """ + str(settings.ROUTE_COLOURS) + """[n % 8 + 1] END AS color, CASE WHEN track % 4 = 0 THEN 2e0 ELSE 1.5e0 END AS width_mm, 1.2e0 AS height_mm, true AS visible FROM n""")
def a08_route_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes with what is asked for over the defaults."""
    n = F.col("track")
    r = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("f"), F.col("user_id") % 30).alias("file"), F.col("user_id").alias("track")).distinct()
    r = r.withColumns({"color": F.when(n % 9 == 0, "#000000"), "width_mm": F.when(n % 4 == 0, 2.0)})
    return settings.with_style(r).select("file", "track", "color", "width_mm", "height_mm", "visible")


@REG.add("WITH {SELECTIONS}, m AS (SELECT sel_id, CASE WHEN sel_id % 2 = 0 THEN 'mapterhorn' ELSE 'aws-terrarium' END AS dataset, CASE WHEN k = 0 THEN NULL ELSE radius_m / 10 END AS w FROM sel) SELECT sel_id, dataset, CASE WHEN sel_id % 2 = 0 THEN 512 ELSE 256 END AS tile_size, CASE WHEN sel_id % 2 = 0 THEN 14 ELSE 13 END AS max_zoom, coalesce(w, 100e0) AS width_mm, 0.4e0 AS nozzle_mm FROM m")
def a06_model_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models with their dataset and defaults."""
    m = selections(spark, sf_dir).select("sel_id", F.when(F.col("sel_id") % 2 == 0, "mapterhorn").otherwise("aws-terrarium").alias("dataset"), F.when(F.col("k") != 0, F.col("radius_m") / 10).alias("width_mm"))
    return settings.with_defaults(settings.with_dataset(m)).select("sel_id", "dataset", "tile_size", "max_zoom", "width_mm", "nozzle_mm")


@REG.add()
def f12_contour_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The footprint of each layer's network as rings: chained, cleaned, nested."""
    chained = cut(rings.chained(lines.contour(_field(spark, sf_dir), 20.0, 20.0), 20.0))
    clean = rings.cleaned(chained, 20.0)
    shape = rings.measured(clean).select("model_id", "ring", "points", r4(F.col("area")).alias("area"))
    return rings.nested(chained, 20.0).join(shape, ["model_id", "ring"]).select(F.col("model_id").alias("layer"), "outer", "ring", "points", "area")


@REG.add()
def f09_coarsen_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    chained = rings.chained(lines.contour(_field(spark, sf_dir), 20.0, 20.0), 20.0)
    return rings.measured(rings.coarsened(chained, 60.0)).select(F.col("model_id").alias("layer"), "ring", "points", r4(F.col("area")).alias("area"))


@REG.add(HEAD + """, circ AS (SELECT i, 3000e0 * cos(i / 64e0 * 2 * pi()) AS px, 3000e0 * sin(i / 64e0 * 2 * pi()) AS py, 3000e0 * cos((i + 1) % 64 / 64e0 * 2 * pi()) AS qx, 3000e0 * sin((i + 1) % 64 / 64e0 * 2 * pi()) AS qy FROM (SELECT unnest(range(0, 64)) AS i)),
 c AS (SELECT way_id, seq, (bx - x) AS dx, (yb - y) AS dy, qx - px AS rx, qy - py AS ry, px - x AS ox, py - y AS oy FROM sg, circ),
 t AS (SELECT way_id, seq, (ox * ry - oy * rx) / (dx * ry - dy * rx) AS t, (ox * dy - oy * dx) / (dx * ry - dy * rx) AS u FROM c WHERE dx * ry - dy * rx <> 0)
 SELECT way_id AS line_id, seq::BIGINT AS seq, round(least(greatest(min(t), 0.001e0), 0.999e0), 6) + 0e0 AS t FROM t WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 GROUP BY way_id, seq""")
def d05_ring_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where segments cross the selection's ring."""
    from .layers import _segments

    s = _segments(spark, sf_dir).select(F.struct("line_id", "seq").alias("id"), "ax", "ay", "bx", "by")
    c = rings.crossings(s, _circle_edges(spark), 500.0)
    return c.select("id.line_id", F.col("id.seq").cast("long").alias("seq"), r6(F.col("t")).alias("t"))


@REG.add(f"""WITH {{SELECTIONS}}, {BOXES}, {EXTENT}, f AS (SELECT sel_id, ex, ey, 5e0 + sel_id % 9 * 5 AS res, 0.4e0 / (100e0 / greatest(ex, ey)) AS printable FROM ext)
 SELECT sel_id, 'warn' AS level, unnest(list_filter([CASE WHEN res < printable THEN 'below-nozzle-detail' END, CASE WHEN (ceil(ex / res) + 1) * (ceil(ey / res) + 1) > 1500000 THEN 'resolution-coarsened' END, CASE WHEN sel_id % 3 = 0 THEN 'exaggeration-clamped' END], lambda x: x IS NOT NULL)) AS code FROM f""")
def k02_grid_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .projection import _selection_boxes

    x, y = geo.extent(*(F.col(c) for c in ("west", "south", "east", "north")))
    b = _selection_boxes(spark, sf_dir).select("sel_id", x.alias("ex"), y.alias("ey"))
    g = b.select("sel_id", geo.grid(F.col("ex"), F.col("ey"), F.lit(100.0), F.lit(0.4), F.lit(5.0) + F.col("sel_id") % 9 * 5).alias("g"))
    f = g.select("sel_id", "g.below_nozzle", "g.coarsened", (F.col("sel_id") % 3 == 0).alias("clamped"))
    return rules.judged(f, "sel_id", rules.grid_rules())
