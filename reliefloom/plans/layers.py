"""Queries over line layers, masks, distance fields and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import tags as T
from ..operators import lines, mesh, osm, rules
from ..operators.lineage import cut
from .derived import gps_points, selections
from .features import CLASS_SQL, GEOM_SQL, PART_TAGS, ROUTE_SQL, _ways
from .meshes import AUDIT, BROKEN, CORNERS, SOLID, _broken
from .projection import BOX, BOXES, DEG_SQL
from .rasters import _needed, _needed_sql, _stored, STORED
from .registry import Registry, r4, r6
from .routes import XY

REG = Registry()
MM_PER_M, NOZZLE_MM = 0.01, 0.4
AREA_MM2 = 92.0 * 89.0 * 20
FEATURES = f"""{PART_TAGS}, {CLASS_SQL}, {GEOM_SQL}, {ROUTE_SQL},
 wp AS (SELECT way_id, seq, 6378137 * (lon - lon0) * {DEG_SQL} * c0 AS x, 6378137 * (lat - lat0) * {DEG_SQL} AS y FROM ways, model),
 ln AS (SELECT wp.*, kind.layer, subtype, width_m, bridge FROM wp JOIN rt USING (way_id) JOIN kind USING (way_id) WHERE route = 'line'),
 sg AS (SELECT * FROM (SELECT *, lead(x) OVER w AS bx, lead(y) OVER w AS yb FROM ln WINDOW w AS (PARTITION BY way_id ORDER BY seq)) WHERE bx IS NOT NULL),
 lc AS (SELECT layer, subtype, sum(sqrt((bx - x) * (bx - x) + (yb - y) * (yb - y))) AS length_m, max(width_m) AS width_m FROM sg GROUP BY layer, subtype),
 lw AS (SELECT *, greatest(width_m * 0.01e0, 0.4e0 * sqrt(width_m / min(width_m) OVER (PARTITION BY layer))) AS printed_mm FROM lc)"""
HEAD = "WITH {TAGS}, {WAYS}, {MODEL}, " + FEATURES
RANKS = "rk(layer, subtype, rank) AS (VALUES " + ", ".join(f"('{layer}', '{s}', {n})" for layer, subs in T.LAYERS.items() for n, s in enumerate(subs)) + ")"


def _origin():
    return geo.origin(*(F.lit(v) for v in BOX))


def _points(ways: DataFrame, keep: list[str]) -> DataFrame:
    p = ways.select(F.col("way_id").alias("line_id"), *keep, F.posexplode("points").alias("seq", "p"))
    x, y = geo.project(F.col("p.x"), F.col("p.y"), _origin())
    return p.select("line_id", "seq", *keep, x.alias("x"), y.alias("y"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = osm.routed(_ways(spark, sf_dir)).filter("route = 'line'").select("way_id", "points", "kind.layer", "kind.subtype", "kind.width_m", "kind.bridge")
    return lines.segments(_points(w, ["layer", "subtype", "width_m", "bridge"]))


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lines.class_lengths(_segments(spark, sf_dir))
    return c.withColumn("printed_mm", geo.ladder_width_mm(F.col("width_m"), F.col("narrowest_m"), F.lit(MM_PER_M), F.lit(NOZZLE_MM)))


def _ranks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(layer, s, n) for layer, subs in T.LAYERS.items() for n, s in enumerate(subs)], "layer string, subtype string, rank int")


def _water(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = osm.routed(_ways(spark, sf_dir)).filter("route = 'polygon' AND kind.layer = 'water'").select(F.col("way_id").alias("ring_id"), osm.open_ring(F.col("points")).alias("r"), "inners")
    return w.filter("size(r) >= 3").select("ring_id", geo.ring_world(F.col("r"), _origin()).alias("ring"), F.transform("inners", lambda h: geo.ring_world(h, _origin())).alias("holes"))


@REG.add(HEAD + " SELECT layer, subtype, round(length_m, 3) + 0e0 AS length_m, width_m, round(printed_mm, 6) + 0e0 AS printed_mm, round(floor(printed_mm * 20 + 0.5e0) / 20, 6) + 0e0 AS bucket_mm FROM lw")
def e08_class_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, ladder width and width bucket of each class."""
    c = _classes(spark, sf_dir)
    return c.select("layer", "subtype", (F.round("length_m", 3) + 0.0).alias("length_m"), "width_m", r6(F.col("printed_mm")).alias("printed_mm"), r6(lines.width_bucket(F.col("printed_mm"))).alias("bucket_mm"))


@REG.add(HEAD + f", {RANKS}, sp AS (SELECT lw.*, rank, sum(length_m * 0.01e0 * printed_mm) OVER w AS spent, row_number() OVER w AS n FROM lw JOIN rk USING (layer, subtype) WINDOW w AS (PARTITION BY layer ORDER BY rank)) SELECT layer, subtype, max((spent > {AREA_MM2}e0 * 0.25e0 AND n > 1)::INT) OVER (PARTITION BY layer ORDER BY rank) = 0 AS kept FROM sp")
def f07_legible_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.legible(_classes(spark, sf_dir), _ranks(spark), MM_PER_M, AREA_MM2).select("layer", "subtype", "kept")


@REG.add(HEAD + """, wr AS (SELECT way_id AS ring_id, seq, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS yb FROM wp JOIN rt USING (way_id) WHERE route = 'polygon' AND layer = 'water' AND n >= 4 WINDOW w AS (PARTITION BY way_id ORDER BY seq)),
 hit AS (SELECT DISTINCT way_id, seq FROM (SELECT sg.way_id, sg.seq, ring_id FROM sg JOIN wr ON NOT bridge AND (wr.y > (sg.y + sg.yb) / 2) <> (wr.yb > (sg.y + sg.yb) / 2) AND (sg.x + sg.bx) / 2 < (wr.bx - wr.x) * ((sg.y + sg.yb) / 2 - wr.y) / (wr.yb - wr.y) + wr.x GROUP BY sg.way_id, sg.seq, ring_id HAVING count(*) % 2 = 1)),
 mk AS (SELECT sg.way_id, sg.seq, hit.seq IS NOT NULL AS wet FROM sg LEFT JOIN hit ON hit.way_id = sg.way_id AND hit.seq = sg.seq)
 SELECT way_id AS line_id, seq, wet, CASE WHEN NOT wet THEN sum(wet::INT) OVER (PARTITION BY way_id ORDER BY seq) END::BIGINT AS run FROM mk""")
def f08_split_on_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wet segments, and the dry runs between them."""
    return lines.split_on_water(_segments(spark, sf_dir), _water(spark, sf_dir)).select("line_id", F.col("seq").cast("long").alias("seq"), "wet", "run")


@REG.add(HEAD + f""", {RANKS}, sp AS (SELECT lw.*, rank, sum(length_m * 0.01e0 * printed_mm) OVER w AS spent, row_number() OVER w AS n FROM lw JOIN rk USING (layer, subtype) WINDOW w AS (PARTITION BY layer ORDER BY rank)),
 kp AS (SELECT layer, subtype, max((spent > {AREA_MM2}e0 * 0.25e0 AND n > 1)::INT) OVER (PARTITION BY layer ORDER BY rank) = 0 AS kept FROM sp),
 wr AS (SELECT way_id AS ring_id, seq, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS yb FROM wp JOIN rt USING (way_id) WHERE route = 'polygon' AND layer = 'water' AND n >= 4 WINDOW w AS (PARTITION BY way_id ORDER BY seq)),
 ch AS (SELECT sg.* FROM sg JOIN kp USING (layer, subtype) WHERE kept),
 hit AS (SELECT DISTINCT way_id, seq FROM (SELECT ch.way_id, ch.seq, ring_id FROM ch JOIN wr ON NOT bridge AND (wr.y > (ch.y + ch.yb) / 2) <> (wr.yb > (ch.y + ch.yb) / 2) AND (ch.x + ch.bx) / 2 < (wr.bx - wr.x) * ((ch.y + ch.yb) / 2 - wr.y) / (wr.yb - wr.y) + wr.x GROUP BY ch.way_id, ch.seq, ring_id HAVING count(*) % 2 = 1)),
 dn AS (SELECT layer, count(hit.seq) AS drowned FROM ch LEFT JOIN hit ON hit.way_id = ch.way_id AND hit.seq = ch.seq GROUP BY layer)
 SELECT layer, any_value(drowned) AS drowned, count(*) FILTER (WHERE NOT kept) AS dropped_classes, string_agg(subtype, ',' ORDER BY subtype) FILTER (WHERE NOT kept) AS dropped FROM kp LEFT JOIN dn USING (layer) GROUP BY layer""")
def e10_drowned_and_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each layer, the segments under water among what is built of it, and the classes that are too much for the model."""
    classes = cut(lines.legible(_classes(spark, sf_dir), _ranks(spark), MM_PER_M, AREA_MM2))  # a row for each class
    chosen = _segments(spark, sf_dir).join(classes.filter("kept").select("layer", "subtype"), ["layer", "subtype"])
    drowned = lines.split_on_water(chosen, _water(spark, sf_dir)).groupBy("layer").agg(F.count_if("wet").alias("drowned"))
    out = F.array_sort(F.collect_list(F.when(~F.col("kept"), F.col("subtype"))))
    dropped = classes.groupBy("layer").agg(F.size(out).cast("long").alias("dropped_classes"), F.when(F.size(out) > 0, F.array_join(out, ",")).alias("dropped"))
    return dropped.join(drowned, "layer", "left").select("layer", "drowned", "dropped_classes", "dropped")


BUDGET = "g AS (SELECT layer, floor(printed_mm * 20 + 0.5e0) / 20 AS bucket, count(*) AS points FROM ln JOIN lw USING (layer, subtype) GROUP BY 1, 2), o AS (SELECT *, sum(points * 4) OVER (PARTITION BY layer ORDER BY bucket) <= 8000 AS taken FROM g)"


def _budget(spark: SparkSession, sf_dir: str, classes: DataFrame) -> DataFrame:
    """model_id (the layer), grp, points, taken: the width groups of each layer."""
    w = osm.routed(_ways(spark, sf_dir)).filter("route = 'line'").select("kind.layer", "kind.subtype", F.size("points").alias("n"))
    widths = classes.select("layer", "subtype", lines.width_bucket(F.col("printed_mm")).alias("grp"))
    g = w.join(F.broadcast(widths), ["layer", "subtype"]).groupBy(F.col("layer").alias("model_id"), "grp").agg(F.sum("n").alias("points"))
    return lines.within_budget(g.withColumn("rank", F.lit(0)), 8000)


@REG.add(HEAD + f", {BUDGET} SELECT layer, round(bucket, 6) + 0e0 AS bucket_mm, points, taken FROM o")
def g03_triangle_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width groups of each layer, taken in order until the estimate exceeds its budget."""
    return _budget(spark, sf_dir, _classes(spark, sf_dir)).select(F.col("model_id").alias("layer"), r6(F.col("grp")).alias("bucket_mm"), "points", "taken")


@REG.add(HEAD + """, lays AS (SELECT DISTINCT layer FROM ln) SELECT layer, count(DISTINCT way_id) AS features, round(max(printed_mm), 6) + 0e0 AS widest_mm, round(min(printed_mm), 6) + 0e0 AS narrowest_mm, bool_or(printed_mm > ln.width_m * 0.01e0 + 1e-6) AS clamped FROM ln JOIN lw USING (layer, subtype) GROUP BY layer""")
def e10_layer_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = osm.routed(_ways(spark, sf_dir)).filter("route = 'line'").select("way_id", "kind.layer", "kind.subtype", "kind.width_m")
    p = F.col("printed_mm")
    j = w.join(F.broadcast(_classes(spark, sf_dir).select("layer", "subtype", "printed_mm")), ["layer", "subtype"])
    return j.groupBy("layer").agg(F.count("*").alias("features"), r6(F.max(p)).alias("widest_mm"), r6(F.min(p)).alias("narrowest_mm"), F.bool_or(p > F.col("width_m") * MM_PER_M + 1e-6).alias("clamped"))


@REG.add("WITH {TAGS}, {WAYS}, " + f"{PART_TAGS}, {CLASS_SQL}, {GEOM_SQL}, {ROUTE_SQL}, want(layer) AS (VALUES ('roads'), ('trails'), ('railways'), ('aeroways'), ('piers'), ('skiruns'), ('water'), ('gliders')) SELECT layer FROM want WHERE layer NOT IN (SELECT layer FROM rt WHERE route = 'line')")
def d13_empty_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted line layers without features: a left anti join."""
    want = spark.createDataFrame([(x,) for x in ("roads", "trails", "railways", "aeroways", "piers", "skiruns", "water", "gliders")], "layer string")
    return want.join(osm.routed(_ways(spark, sf_dir)).filter("route = 'line'").select("kind.layer"), "layer", "left_anti")


CIRCLE = "circ AS (SELECT i, 3000e0 * cos(i / 64e0 * 2 * pi()) AS ax, 3000e0 * sin(i / 64e0 * 2 * pi()) AS ay, 3000e0 * cos((i + 1) % 64 / 64e0 * 2 * pi()) AS bx, 3000e0 * sin((i + 1) % 64 / 64e0 * 2 * pi()) AS yb FROM (SELECT unnest(range(0, 64)) AS i))"


def _circle_edges(spark: SparkSession) -> DataFrame:
    a = lambda i: i / 64 * 2 * geo.math.pi
    i, n = F.col("id"), (F.col("id") + 1) % 64
    return spark.range(64).select(F.lit(0).alias("key"), (F.cos(a(i)) * 3000).alias("ax"), (F.sin(a(i)) * 3000).alias("ay"), (F.cos(a(n)) * 3000).alias("bx"), (F.sin(a(n)) * 3000).alias("by"))


def _circle() -> F.Column:
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: geo.point(F.cos(i / 64 * 2 * geo.math.pi) * 3000, F.sin(i / 64 * 2 * geo.math.pi) * 3000))


INOUT = """nx AS (SELECT * FROM (SELECT route_id, seq, x, y, lead(x) OVER w AS bx, lead(y) OVER w AS yb FROM xy WINDOW w AS (PARTITION BY route_id ORDER BY seq)) WHERE bx IS NOT NULL),
 par AS (SELECT route_id, seq, any_value(sqrt((nx.bx - x) * (nx.bx - x) + (nx.yb - y) * (nx.yb - y))) AS len, count(i) % 2 = 1 AS inside FROM nx LEFT JOIN circ c ON (c.ay > (y + nx.yb) / 2) <> (c.yb > (y + nx.yb) / 2) AND (x + nx.bx) / 2 < (c.bx - c.ax) * ((y + nx.yb) / 2 - c.ay) / (c.yb - c.ay) + c.ax GROUP BY route_id, seq)"""


def _route_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.project(F.col("lon"), F.col("lat"), _origin())
    return lines.segments(gps_points(spark, sf_dir).select(F.col("route_id").alias("line_id"), "seq", x.alias("x"), y.alias("y")))


def _inside_outside(spark: SparkSession, s: DataFrame) -> DataFrame:
    ring = spark.range(1).select(_circle().alias("ring"))  # the selection: one ring of 64 vertices
    j = s.crossJoin(F.broadcast(ring))
    inside = geo.ring_contains(F.col("ring"), (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2)
    return j.select(F.col("line_id").alias("route_id"), lines.length().alias("len"), inside.alias("inside")).groupBy("route_id").agg(F.sum(F.when(F.col("inside"), F.col("len")).otherwise(0.0)).alias("inside_m"), F.sum(F.when(~F.col("inside"), F.col("len")).otherwise(0.0)).alias("outside_m"))


@REG.add(f"WITH {{GPS}}, {{MODEL}}, {XY}, {CIRCLE}, {INOUT} SELECT route_id, round(sum(CASE WHEN inside THEN len ELSE 0 END), 3) + 0e0 AS inside_m, round(sum(CASE WHEN NOT inside THEN len ELSE 0 END), 3) + 0e0 AS outside_m FROM par GROUP BY route_id")
def e11_inside_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each route inside and outside the selection."""
    r = _inside_outside(spark, _route_segments(spark, sf_dir))
    return r.select("route_id", *((F.round(c, 3) + 0.0).alias(c) for c in ("inside_m", "outside_m")))


@REG.add(f"WITH {{GPS}}, {{MODEL}}, {XY}, {CIRCLE}, {INOUT}, f AS (SELECT route_id, sum(CASE WHEN inside THEN len ELSE 0 END) AS i, sum(CASE WHEN NOT inside THEN len ELSE 0 END) AS o FROM par GROUP BY route_id) SELECT route_id, 'warn' AS level, unnest(list_filter([CASE WHEN route_id % 7 * 0.1e0 < 0.4e0 THEN 'route-width-clamped' END, CASE WHEN o > 1 THEN 'route-clipped' END, CASE WHEN i = 0 THEN 'route-empty' END], lambda x: x IS NOT NULL)) AS code FROM f")
def k05_route_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _inside_outside(spark, _route_segments(spark, sf_dir)).withColumns({"width_mm": F.col("route_id") % 7 * F.lit(0.1), "nozzle_mm": F.lit(NOZZLE_MM)})
    return rules.judged(f, "route_id", rules.route_rules())


GRID = "rows_ AS (SELECT j, -4000e0 + j * 100e0 AS y FROM (SELECT unnest(range(0, 81)) AS j))"
RINGPTS = """ringed AS (SELECT way_id AS key, seq, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS yb FROM wp JOIN rt USING (way_id) WHERE route = 'polygon' AND layer = 'water' AND n >= 4 WINDOW w AS (PARTITION BY way_id ORDER BY seq)),
 cx AS (SELECT key, j, x + (rows_.y - ringed.y) / (yb - ringed.y) * (bx - x) AS x FROM rows_ JOIN ringed ON (ringed.y > rows_.y) <> (yb > rows_.y)),
 pr AS (SELECT key, j, x AS x_from, lead(x) OVER w AS x_to, row_number() OVER w AS n FROM cx WINDOW w AS (PARTITION BY key, j ORDER BY x)),
 mask AS (SELECT DISTINCT key, j, unnest(range(greatest(0, ceil((x_from + 4600) / 100))::BIGINT, least(92, floor((x_to + 4600) / 100))::BIGINT + 1)) AS i FROM pr WHERE n % 2 = 1 AND x_to IS NOT NULL)"""


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = lines.ring_edges(_water(spark, sf_dir))
    rows = edges.select("key").distinct().select("key", F.explode(F.sequence(F.lit(0), F.lit(80))).alias("j")).withColumn("y", F.lit(-4000.0) + F.col("j") * 100)
    return lines.inside_mask(lines.row_spans(rows, edges), -4600.0, 100.0, 93)


@REG.add(HEAD + f", {GRID}, {RINGPTS} SELECT key, count(*) AS nodes, sum(i)::BIGINT AS sum_i, sum(j)::BIGINT AS sum_j FROM mask GROUP BY key")
def d04_inside_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid nodes inside each ring, by scanlines."""
    return _mask(spark, sf_dir).groupBy("key").agg(F.count("*").alias("nodes"), F.sum("i").alias("sum_i"), F.sum(F.col("j").cast("long")).alias("sum_j"))


FIELD = """seg AS (SELECT layer, x AS ax, y AS ay, bx, yb, sqrt(pow(bx - x, 2) + pow(yb - y, 2)) AS len FROM sg), jk AS (SELECT *, unnest(range(floor((least(ay, yb) - 60) / 20)::BIGINT, ceil((greatest(ay, yb) + 60) / 20)::BIGINT + 1)) AS j FROM seg),
 lim AS (SELECT *, ax + CASE WHEN abs(yb - ay) < 1 THEN 0 ELSE (j * 20e0 - ay) * (bx - ax) / (yb - ay) END AS middle, CASE WHEN abs(yb - ay) < 1 THEN abs(bx - ax) + 60 ELSE 60 * len / abs(yb - ay) END AS reach FROM jk),
 ik AS (SELECT *, unnest(range(floor(greatest(least(ax, bx) - 80, middle - reach - 20) / 20)::BIGINT, ceil(least(greatest(ax, bx) + 80, middle + reach + 20) / 20)::BIGINT + 1)) AS i FROM lim),
 tt AS (SELECT *, CASE WHEN ax = bx AND ay = yb THEN 0 ELSE least(greatest(((i * 20e0 - ax) * (bx - ax) + (j * 20e0 - ay) * (yb - ay)) / ((bx - ax) * (bx - ax) + (yb - ay) * (yb - ay)), 0), 1) END AS t FROM ik),
 fld AS (SELECT layer, i, j, min(d) AS d FROM (SELECT layer, i, j, sqrt(pow(i * 20e0 - (ax + t * (bx - ax)), 2) + pow(j * 20e0 - (ay + t * (yb - ay)), 2)) AS d FROM tt) WHERE d <= 60 GROUP BY layer, i, j)"""


def _field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field of each line layer; the layer's name is its model."""
    return lines.distance_field(_segments(spark, sf_dir).withColumn("model_id", F.col("layer")), 20.0, 20.0)


@REG.add(HEAD + f", {FIELD} SELECT layer, i, j, round(d, 3) + 0e0 AS d FROM fld WHERE d < 59.999e0")
def h08_distance_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the network of each line layer, in a band around it."""
    return _field(spark, sf_dir).filter("d < 59.999").select(F.col("model_id").alias("layer"), "i", "j", (F.round("d", 3) + 0.0).alias("d"))


#: The rows of the selection's grid as SQL: where each lies inside the circle.
SPANS = CIRCLE + """, sr AS (SELECT unnest(range(-151, 152)) AS j), sx AS (SELECT j, ax + (j * 20e0 - ay) / (yb - ay) * (bx - ax) AS x FROM sr JOIN circ ON (ay > j * 20e0) <> (yb > j * 20e0)),
 spn AS (SELECT j, min(x) AS x_from, max(x) AS x_to FROM sx GROUP BY j)"""


@REG.add(HEAD + f", {FIELD}, {SPANS} SELECT layer, i, j, round(d, 3) + 0e0 AS d FROM fld WHERE d < 59.999e0 AND EXISTS (SELECT 1 FROM spn WHERE spn.j = fld.j AND i * 20e0 BETWEEN x_from AND x_to)")
def d06_field_in_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of each layer's field that lie in the selection: an equi-join on row and block of columns."""
    rows = spark.range(-151, 152).select(F.lit(0).alias("key"), F.col("id").alias("j"), (F.col("id") * 20.0).alias("y"))
    spans = lines.row_spans(rows, _circle_edges(spark)).select("j", "x_from", "x_to")
    inside = lines.within(_field(spark, sf_dir).filter("d < 59.999"), spans, 20.0)
    return inside.select(F.col("model_id").alias("layer"), "i", "j", (F.round("d", 3) + 0.0).alias("d"))


@REG.add(HEAD + f""", {FIELD}, c8 AS (SELECT layer, i - dx AS i, j - dy AS j, max(CASE WHEN dx = 0 AND dy = 0 THEN d END) AS v0, max(CASE WHEN dx = 1 AND dy = 0 THEN d END) AS v1, max(CASE WHEN dx = 1 AND dy = 1 THEN d END) AS v2, max(CASE WHEN dx = 0 AND dy = 1 THEN d END) AS v3 FROM fld, (VALUES (0, 0), (1, 0), (1, 1), (0, 1)) o(dx, dy) GROUP BY 1, 2, 3),
 cc AS (SELECT layer, i, j, coalesce(v0 < 20, false) AS a, coalesce(v1 < 20, false) AS b, coalesce(v2 < 20, false) AS c, coalesce(v3 < 20, false) AS d FROM c8)
 SELECT layer, count(*) AS cells, sum((a AND NOT b)::INT + (b AND NOT c)::INT + (c AND NOT d)::INT + (d AND NOT a)::INT)::BIGINT AS segments, 0::BIGINT AS open_ends FROM cc WHERE (a <> b) OR (b <> c) OR (c <> d) GROUP BY layer""")
def h09_contour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contours of the layers' footprints: closed, since as many segments begin at each point as end there."""
    c = cut(lines.contour(_field(spark, sf_dir), 20.0, 20.0))
    key = lambda x, y: F.struct(F.floor(F.col(x) * 1e4 + 0.5).alias("x"), F.floor(F.col(y) * 1e4 + 0.5).alias("y"))
    ends = c.select("model_id", key("x0", "y0").alias("p"), F.lit(1).alias("n")).unionByName(c.select("model_id", key("x1", "y1").alias("p"), F.lit(-1).alias("n"))).groupBy("model_id", "p").agg(F.sum("n").alias("n"))
    n = c.groupBy("model_id").agg(F.count_distinct("i", "j").alias("cells"), F.count("*").alias("segments"))
    return n.join(ends.groupBy("model_id").agg(F.count_if(F.col("n") != 0).alias("open_ends")), "model_id").withColumnRenamed("model_id", "layer")


@REG.add(HEAD + f""", {FIELD}, sd AS (SELECT layer, i, j, 0 AS up, d AS p FROM fld UNION ALL SELECT layer, i, j, 1, d FROM fld), pq AS (SELECT sd.*, f.d AS q FROM sd LEFT JOIN fld f ON f.layer = sd.layer AND f.i = sd.i + 1 - up AND f.j = sd.j + up)
 SELECT layer, round((i + (1 - up) * (20 - p) / (q - p)) * 20, 3) + 0e0 AS x, round((j + up * (20 - p) / (q - p)) * 20, 3) + 0e0 AS y FROM pq WHERE (p < 20) <> coalesce(q < 20, false)""")
def h09_contour_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the contours cross the sides of the grid: the start of one segment each (H9)."""
    c = lines.contour(_field(spark, sf_dir), 20.0, 20.0)
    return c.select(F.col("model_id").alias("layer"), (F.round("x0", 3) + 0.0).alias("x"), (F.round("y0", 3) + 0.0).alias("y"))


@REG.add("""WITH f AS (SELECT s_suppkey AS model_id, 0.4e0 + s_suppkey % 5 * 0.2e0 AS base_mm, 0.2e0 AS layer_mm, 40e0 + s_suppkey % 30 AS width_mm, 30e0 AS depth_mm, 0.5e0 + s_suppkey % 9 * 11e0 * (s_suppkey % 2) + s_suppkey % 7 * 0.3e0 AS height_mm, s_suppkey * 30000 AS triangles FROM supplier)
 SELECT model_id, 'warn' AS level, unnest(list_filter([CASE WHEN base_mm < 3 * layer_mm THEN 'thin-base' END, CASE WHEN height_mm - base_mm < layer_mm THEN 'invisible-relief' WHEN height_mm - base_mm < 3 * layer_mm THEN 'low-relief' END, CASE WHEN height_mm > 2 * least(width_mm, depth_mm) THEN 'tipping-risk' END, CASE WHEN triangles > 2000000 THEN 'triangle-count' END], lambda x: x IS NOT NULL)) AS code FROM f""")
def k01_print_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    f = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        s.alias("model_id"), (F.lit(0.4) + s % 5 * F.lit(0.2)).alias("base_mm"), F.lit(0.2).alias("layer_mm"), (F.lit(40.0) + s % 30).alias("width_mm"), F.lit(30.0).alias("depth_mm"),
        (F.lit(0.5) + s % 9 * F.lit(11.0) * (s % 2) + s % 7 * F.lit(0.3)).alias("height_mm"), (s * 30000).alias("triangles"),
    )
    return rules.judged(f, "model_id", rules.print_rules())


@REG.add(f"""WITH {{SELECTIONS}}, {BOXES}, {STORED}, {_needed_sql('SELECT 6 AS z')}, f AS (SELECT sel_id, count(*) FILTER (WHERE s IS NULL) AS missing, count(*) AS tiles FROM need LEFT JOIN (SELECT *, 1 AS s FROM stored) USING (z, x, y) GROUP BY sel_id)
 SELECT sel_id, 'warn' AS level, unnest(list_filter([CASE WHEN sel_id % 4 = 0 THEN 'dem-zoom-reduced' END, CASE WHEN missing > 0 THEN 'dem-partial-coverage' END, CASE WHEN missing * 4 > tiles THEN 'dem-sparse' END], lambda x: x IS NOT NULL)) AS code FROM f""")
def k03_raster_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = _stored(spark, sf_dir).withColumn("there", F.lit(True))
    f = _needed(spark, sf_dir, F.lit(6)).join(have, ["z", "x", "y"], "left").groupBy("sel_id").agg(F.count_if(F.col("there").isNull()).alias("missing"), F.count("*").alias("pixels"))
    f = f.withColumns({"repaired": F.col("missing"), "wanted_zoom": F.lit(6), "zoom": F.when(F.col("sel_id") % 4 == 0, 5).otherwise(6)})
    return rules.judged(f, "sel_id", rules.raster_rules())


@REG.add(f"WITH {{DEM}}, {SOLID}, {BROKEN}, {CORNERS.format(t='mt', v='mv')}, {AUDIT.format(t='mt')}, f AS (SELECT model_id, open_edges = 0 AND non_manifold = 0 AS manifold, v < 0 AS inverted, degenerate FROM ef JOIN so USING (model_id)) SELECT model_id FROM f WHERE manifold AND NOT inverted")
def k06_exportable_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that no failed check blocks (K6)."""
    a = cut(mesh.audit(*_broken(spark, sf_dir)))  # a row for each model, read twice
    return rules.exportable(a.select("model_id"), rules.judged(a, "model_id", rules.mesh_rules()), "model_id")


@REG.add("WITH {SELECTIONS} SELECT sel_id, 'osm:' || printf('%.5f', lon - 0.03e0) || ',' || printf('%.5f', lat - 0.03e0) || ',' || printf('%.5f', lon + 0.03e0) || ',' || printf('%.5f', lat + 0.03e0) || ':' || CASE k WHEN 0 THEN 'roads+water' WHEN 1 THEN 'buildings+roads' ELSE 'water' END AS key FROM sel")
def a13_input_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extract keys: the box to five decimals and the sorted layers."""
    d = F.lit(0.03)
    asked = F.when(F.col("k") == 0, F.array(F.lit("water"), F.lit("roads"))).when(F.col("k") == 1, F.array(F.lit("roads"), F.lit("buildings"))).otherwise(F.array(F.lit("water")))
    box = F.format_string("osm:%.5f,%.5f,%.5f,%.5f:", F.col("lon") - d, F.col("lat") - d, F.col("lon") + d, F.col("lat") + d)
    return selections(spark, sf_dir).select("sel_id", F.concat(box, F.array_join(F.array_sort(asked), "+")).alias("key"))


@REG.add("WITH e AS (SELECT user_id AS key, event_id, epoch_ms(ts) AS stored_ms FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY stored_ms DESC, event_id DESC) AS k, max(stored_ms) OVER () AS now FROM e) SELECT key, event_id FROM n WHERE k = 1 AND now - stored_ms <= 7 * 86400000")
def a14_fresh_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entry of each key, unless it is older than a week."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("stored_ms"))
    newest = e.groupBy("key").agg(F.max(F.struct("stored_ms", "event_id")).alias("m")).select("key", "m.event_id", "m.stored_ms")
    now = e.agg(F.max("stored_ms").alias("now"))  # one row
    return newest.crossJoin(F.broadcast(now)).filter(F.col("now") - F.col("stored_ms") <= 7 * 86400000).select("key", "event_id")


@REG.add("WITH {GPS}, l AS (SELECT route_id, count(*) AS n, list(printf('[%.5f,%.5f]', lon, lat) ORDER BY seq) AS c FROM gps GROUP BY route_id) SELECT route_id, '{\"type\":\"LineString\",\"coordinates\":[' || CASE WHEN n >= 2 THEN array_to_string(c, ',') ELSE '' END || ']}' AS geojson FROM l")
def a12_geojson_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.geojson import line

    p = gps_points(spark, sf_dir).groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("ps"))
    return p.select("route_id", line(F.col("ps"), 5).alias("geojson"))


@REG.add(HEAD + """, b AS (SELECT way_id, seq, x, y, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0, last_value(x) OVER w AS x1, last_value(y) OVER w AS y1 FROM ln WHERE bridge WINDOW w AS (PARTITION BY way_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 t AS (SELECT *, least(greatest(((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 0), 1) AS t FROM b)
 SELECT way_id AS bridge_id, seq::BIGINT AS seq, round(3e0 + way_id % 7 + (way_id % 5 - way_id % 7) * t, 6) + 0e0 AS z FROM t""")
def i07_bridge_deck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decks of bridges: linear between their ends."""
    w = osm.routed(_ways(spark, sf_dir)).filter("route = 'line' AND kind.bridge")
    p = _points(w, []).withColumnRenamed("line_id", "bridge_id")
    first, last = (lambda c: F.min_by(c, "seq")), (lambda c: F.max_by(c, "seq"))
    ends = p.groupBy("bridge_id").agg(first("x").alias("x0"), first("y").alias("y0"), last("x").alias("x1"), last("y").alias("y1"))
    ends = ends.withColumns({"z0": F.lit(3.0) + F.col("bridge_id") % 7, "z1": F.lit(3.0) + F.col("bridge_id") % 5})
    return mesh.bridge_deck(p, ends).select("bridge_id", F.col("seq").cast("long").alias("seq"), r6(F.col("z")).alias("z"))


@REG.add(HEAD + f""", {RANKS}, {BUDGET}, cuts AS (SELECT layer, bool_or(NOT taken) AS truncated FROM o GROUP BY layer), sp AS (SELECT lw.*, rank, sum(length_m * 0.01e0 * printed_mm) OVER w AS spent, row_number() OVER w AS n FROM lw JOIN rk USING (layer, subtype) WINDOW w AS (PARTITION BY layer ORDER BY rank)), kp AS (SELECT *, max((spent > {AREA_MM2}e0 * 0.25e0 AND n > 1)::INT) OVER (PARTITION BY layer ORDER BY rank) = 0 AS kept FROM sp),
 f AS (SELECT layer, count(*) FILTER (WHERE NOT kept) AS dropped, bool_or(kept AND printed_mm > width_m * 0.01e0 + 1e-6) AS clamped, min(printed_mm) FILTER (WHERE kept) AS narrowest FROM kp GROUP BY layer), want(layer) AS (VALUES ('roads'), ('trails'), ('railways'), ('gliders'))
 SELECT layer, 'warn' AS level, unnest(list_filter([CASE WHEN f.dropped IS NULL THEN 'layer-empty' END, CASE WHEN truncated THEN 'feature-budget-reached' END, CASE WHEN dropped > 0 THEN 'classes-below-nozzle' END, CASE WHEN clamped THEN 'feature-width-clamped' END, CASE WHEN narrowest < 0.45e0 - 1e-6 THEN 'feature-below-nozzle' END], lambda x: x IS NOT NULL)) AS code FROM want LEFT JOIN f USING (layer) LEFT JOIN cuts USING (layer)""")
def k04_layer_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = cut(_classes(spark, sf_dir))  # a row for each class
    truncated = _budget(spark, sf_dir, classes).groupBy(F.col("model_id").alias("layer")).agg(F.bool_or(~F.col("taken")).alias("truncated"))
    k = lines.legible(classes, _ranks(spark), MM_PER_M, AREA_MM2)
    f = k.groupBy("layer").agg(F.count("*").alias("features"), F.count_if(~F.col("kept")).alias("dropped"), F.bool_or(F.col("kept") & (F.col("printed_mm") > F.col("width_m") * MM_PER_M + 1e-6)).alias("clamped"), F.min(F.when(F.col("kept"), F.col("printed_mm"))).alias("narrowest_mm"))
    want = spark.createDataFrame([(x,) for x in ("roads", "trails", "railways", "gliders")], "layer string")
    return rules.judged(want.join(f, "layer", "left").join(truncated, "layer", "left"), "layer", rules.layer_rules(0.45))
