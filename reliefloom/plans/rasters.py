"""Queries over elevation pixels and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import raster, rules
from .derived import TILE_PX, dem_pixels, dem_tiles, selections
from .projection import BOX, BOXES, DEG_SQL, _selection_boxes
from .registry import Registry, r4, r6

REG = Registry()
VALUE = "val AS (SELECT px, py, CASE WHEN v > -12000 THEN v END AS v FROM (SELECT px, py, (r * 256 + g + b / 256e0 - 32768)::FLOAT AS v FROM dem))"
SIZE = "size AS (SELECT max(px) + 1 AS w, max(py) + 1 AS h FROM dem)"
SHIFTS = "(VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy)"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = raster.decoded(F.col("r"), F.col("g"), F.col("b"))
    p = dem_pixels(spark, sf_dir).select("px", "py", v.alias("v"))
    return p.withColumn("v", F.when(~raster.is_nodata(F.col("v")), F.col("v")))


@REG.add("WITH {DEM} SELECT px, py, (r * 256 + g + b / 256e0 - 32768)::FLOAT::DOUBLE AS terrarium, round((-10000 + (r * 65536 + g * 256 + b) * 0.1e0)::FLOAT::DOUBLE, 4) + 0e0 AS mapbox, (r * 256 + g + b / 256e0 - 32768) <= -12000 AS nodata FROM dem")
def a05_decode_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevations of both encodings, and which are no data (A5, C14)."""
    rgb = [F.col(c) for c in "rgb"]
    t = raster.decoded(*rgb)
    return dem_pixels(spark, sf_dir).select("px", "py", t.cast("double").alias("terrarium"), r4(raster.decoded(*rgb, encoding="mapbox").cast("double")).alias("mapbox"), raster.is_nodata(t).alias("nodata"))


@REG.add(f"""WITH RECURSIVE {{DEM}}, {VALUE}, f AS (SELECT 0 AS p, px, py, v, v IS NOT NULL AS settled FROM val
 UNION ALL SELECT p + 1, x, y, CASE WHEN own THEN self WHEN k > 0 THEN (acc / k)::FLOAT END, own OR k > 0 FROM (
   SELECT p, px + dx AS x, py + dy AS y, max(v) FILTER (WHERE dx = 0 AND dy = 0) AS self, bool_or(settled) FILTER (WHERE dx = 0 AND dy = 0) AS own, sum(v::DOUBLE) FILTER (WHERE settled AND (dx <> 0 OR dy <> 0)) AS acc, count(*) FILTER (WHERE settled AND (dx <> 0 OR dy <> 0)) AS k
   FROM f, {SHIFTS} WHERE p < 64 GROUP BY p, px + dx, py + dy) WHERE own IS NOT NULL)
 SELECT px, py, round(coalesce(v, (SELECT avg(v::DOUBLE)::FLOAT FROM val))::DOUBLE, 4) + 0e0 AS v FROM f WHERE p = 64""")
def h01_inpaint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps filled ring by ring, up to 64 of them, then with the mean."""
    return raster.inpainted(_values(spark, sf_dir)).select("px", "py", r4(F.col("v").cast("double")).alias("v"))


@REG.add(f"""WITH RECURSIVE {{DEM}}, {VALUE}, f AS (SELECT 0 AS p, px, py, coalesce(v, 0)::FLOAT AS v FROM val
 UNION ALL SELECT p + 1, x, y, (self::DOUBLE + 0.5e0 * (acc / k - self::DOUBLE))::FLOAT FROM (
   SELECT p, px + dx AS x, py + dy AS y, max(v) FILTER (WHERE dx = 0 AND dy = 0) AS self, sum(v::DOUBLE) FILTER (WHERE dx <> 0 OR dy <> 0) AS acc, count(*) FILTER (WHERE dx <> 0 OR dy <> 0) AS k
   FROM f, {SHIFTS} WHERE p < 3 GROUP BY p, px + dx, py + dy) WHERE self IS NOT NULL)
 SELECT px, py, round(v::DOUBLE, 3) + 0e0 AS v FROM f WHERE p = 3""")
def h07_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _values(spark, sf_dir).withColumn("v", F.coalesce("v", F.lit(0.0).cast("float")))
    return raster.smoothed(nodes, 3, size=64).select("px", "py", (F.round(F.col("v").cast("double"), 3) + 0.0).alias("v"))


#: Two models over the same tiles: all of them, and a part that reaches beyond them.
MOSAIC = f"""nt AS (SELECT m, x, y FROM (SELECT (max(py) // 16)::BIGINT AS last FROM dem), (SELECT unnest(range(0, 2)) AS m), (SELECT unnest(range(0, 9)) AS x), (SELECT unnest(range(0, 1000)) AS y) WHERE (m = 0 AND x < 7 AND y <= last) OR (m = 1 AND x >= 4 AND y BETWEEN 1 AND 3)),
 mpx AS (SELECT m AS model_id, x * 16 + k % 16 AS px, y * 16 + k // 16 AS py, (x * 7 + y * 3) % 11 = 4 AS lacking FROM nt, (SELECT unnest(range(0, 256)) AS k)),
 msc AS (SELECT model_id, mpx.px, mpx.py, CASE WHEN NOT lacking THEN val.v END AS v FROM mpx LEFT JOIN val ON val.px = mpx.px AND val.py = mpx.py)"""


def _mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.floor(F.max("py") / TILE_PX).cast("long").alias("last")
    span = dem_pixels(spark, sf_dir).agg(last)  # one row
    one = span.select(F.lit(0).alias("model_id"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("x"), "last").select("model_id", "x", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("y"))
    two = spark.range(4, 9).select(F.lit(1).alias("model_id"), F.col("id").cast("int").alias("x"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("y"))
    return raster.mosaic(one.unionByName(two).withColumn("z", F.lit(6)), dem_tiles(spark, sf_dir), TILE_PX)


@REG.add(f"WITH {{DEM}}, {VALUE}, {MOSAIC} SELECT model_id, px, py, v::DOUBLE AS v FROM msc")
def a04_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of two models from raw tiles, decoded; where the store lacks a tile they have no data (A4, A5)."""
    return _mosaic(spark, sf_dir).select("model_id", "px", "py", F.col("v").cast("double").alias("v"))


@REG.add(f"""WITH RECURSIVE {{DEM}}, {VALUE}, {MOSAIC}, f AS (SELECT 0 AS p, model_id, px, py, v, v IS NOT NULL AS settled FROM msc
 UNION ALL SELECT p + 1, model_id, x, y, CASE WHEN own THEN self WHEN k > 0 THEN (acc / k)::FLOAT END, own OR k > 0 FROM (
   SELECT p, model_id, px + dx AS x, py + dy AS y, max(v) FILTER (WHERE dx = 0 AND dy = 0) AS self, bool_or(settled) FILTER (WHERE dx = 0 AND dy = 0) AS own, sum(v::DOUBLE) FILTER (WHERE settled AND (dx <> 0 OR dy <> 0)) AS acc, count(*) FILTER (WHERE settled AND (dx <> 0 OR dy <> 0)) AS k
   FROM f, {SHIFTS} WHERE p < 64 GROUP BY p, model_id, px + dx, py + dy) WHERE own IS NOT NULL),
 mean AS (SELECT model_id, coalesce(avg(v::DOUBLE), 0)::FLOAT AS mean FROM msc GROUP BY model_id)
 SELECT model_id, px, py, round(coalesce(v, mean)::DOUBLE, 4) + 0e0 AS v FROM f JOIN mean USING (model_id) WHERE p = 64""")
def h01_inpaint_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mosaic's gaps, whole lacking tiles among them, filled ring by ring (A4, H1)."""
    return raster.inpainted(_mosaic(spark, sf_dir)).select("model_id", "px", "py", r4(F.col("v").cast("double")).alias("v"))


#: The pixels as three rasters: as they are, higher and with more gaps, and without a column of 25 in 50.
MODELS = """mdl AS (SELECT m AS model_id, px, py, CASE WHEN m = 1 AND px % 7 = 3 THEN NULL ELSE v + m * 100 END AS v FROM val, (SELECT unnest(range(0, 3)) AS m) WHERE m <> 2 OR px % 50 < 25)"""


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("model_id")
    v = _values(spark, sf_dir).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("model_id"), "*").filter((m != 2) | (F.col("px") % 50 < 25))
    return v.withColumn("v", F.when((m == 1) & (F.col("px") % 7 == 3), None).otherwise(F.col("v") + (m * 100).cast("float")))


@REG.add(f"""WITH RECURSIVE {{DEM}}, {VALUE}, {MODELS}, f AS (SELECT 0 AS p, model_id, px, py, v, v IS NOT NULL AS settled FROM mdl
 UNION ALL SELECT p + 1, model_id, x, y, CASE WHEN own THEN self WHEN k > 0 THEN (acc / k)::FLOAT END, own OR k > 0 FROM (
   SELECT p, model_id, px + dx AS x, py + dy AS y, max(v) FILTER (WHERE dx = 0 AND dy = 0) AS self, bool_or(settled) FILTER (WHERE dx = 0 AND dy = 0) AS own, sum(v::DOUBLE) FILTER (WHERE settled AND (dx <> 0 OR dy <> 0)) AS acc, count(*) FILTER (WHERE settled AND (dx <> 0 OR dy <> 0)) AS k
   FROM f, {SHIFTS} WHERE p < 2 GROUP BY p, model_id, px + dx, py + dy) WHERE own IS NOT NULL), mn AS (SELECT model_id, avg(v::DOUBLE)::FLOAT AS mean FROM mdl GROUP BY model_id)
 SELECT model_id, px, py, round(coalesce(v, mean)::DOUBLE, 4) + 0e0 AS v FROM f JOIN mn USING (model_id) WHERE p = 2""")
def h01_inpaint_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rasters of one table: each is filled from its own pixels, in two rings, then with its own mean."""
    return raster.inpainted(_models(spark, sf_dir), passes=2, size=64).select("model_id", "px", "py", r4(F.col("v").cast("double")).alias("v"))


@REG.add(f"WITH {{DEM}}, {VALUE} SELECT count(*) AS pixels, count(*) FILTER (WHERE v IS NULL) AS repaired, count(*) FILTER (WHERE v IS NULL) > 0.25e0 * count(*) AS sparse, coalesce(min(v), 0)::DOUBLE AS min_m, coalesce(max(v), 0)::DOUBLE AS max_m FROM val")
def e05_raster_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremes, and how much had to be repaired."""
    gap = F.count_if(F.col("v").isNull())
    return _values(spark, sf_dir).agg(F.count("*").alias("pixels"), gap.alias("repaired"), (gap > 0.25 * F.count("*")).alias("sparse"), F.coalesce(F.min("v"), F.lit(0.0)).cast("double").alias("min_m"), F.coalesce(F.max("v"), F.lit(0.0)).cast("double").alias("max_m"))


AT = "probe AS (SELECT event_id AS id, -3e0 + (event_id * 37 % 1063) / 10e0 AS x, -2e0 + (event_id * 53 % 1567) / 10e0 AS y FROM events)"


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(e.alias("id"), (F.lit(-3.0) + (e * 37 % 1063) / 10).alias("x"), (F.lit(-2.0) + (e * 53 % 1567) / 10).alias("y"))


def _filled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    p = _values(spark, sf_dir).withColumn("v", F.coalesce("v", F.lit(0.0).cast("float")))
    w, h = p.agg(F.max("px") + 1, F.max("py") + 1).first()
    return p, w, h


FILLED = "fil AS (SELECT px, py, coalesce(v, 0)::DOUBLE AS v FROM val)"


@REG.add(f"""WITH {{DEM}}, {VALUE}, {SIZE}, {FILLED}, {AT}, cl AS (SELECT id, least(greatest(x, 0), w - 1) AS x, least(greatest(y, 0), h - 1) AS y, w, h FROM probe, size),
 fr AS (SELECT id, floor(x)::BIGINT AS x0, floor(y)::BIGINT AS y0, x - floor(x) AS fx, y - floor(y) AS fy, w, h FROM cl)
 SELECT id, round((a.v * (1 - fx) + b.v * fx) * (1 - fy) + (c.v * (1 - fx) + d.v * fx) * fy, 10) + 0e0 AS v FROM fr JOIN fil a ON a.px = x0 AND a.py = y0 JOIN fil b ON b.px = least(x0 + 1, w - 1) AND b.py = y0
 JOIN fil c ON c.px = x0 AND c.py = least(y0 + 1, h - 1) JOIN fil d ON d.px = least(x0 + 1, w - 1) AND d.py = least(y0 + 1, h - 1)""")
def h02_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples between pixels, clamped at the edges."""
    p, w, h = _filled(spark, sf_dir)
    return raster.bilinear(_probes(spark, sf_dir), p, F.lit(w), F.lit(h)).select("id", (F.round("v", 10) + 0.0).alias("v"))


@REG.add(f"""WITH {{DEM}}, {VALUE}, {FILLED}, {AT}, o AS (SELECT a.i AS dx, b.i AS dy FROM (SELECT unnest(range(-2, 3)) AS i) a, (SELECT unnest(range(-2, 3)) AS i) b)
 SELECT id, round(avg(v), 10) + 0e0 AS v FROM probe, o JOIN fil ON px = floor(x + 0.5e0) + dx AND py = floor(y + 0.5e0) + dy GROUP BY id""")
def h04_box_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _, _ = _filled(spark, sf_dir)
    return raster.box_mean(_probes(spark, sf_dir), p, 2).select("id", (F.round("v", 10) + 0.0).alias("v"))  # exact sums of 256ths: fewer decimals would meet ties


ZOOM, TILE, NODES = 10, 256, 41
ORIGIN_SQL = f"org AS (SELECT floor((7.62e0 + 180) / 360 * 1024 * 256) AS ox, floor((1 - ln(tan(46.02e0 * {DEG_SQL}) + 1 / cos(46.02e0 * {DEG_SQL})) / pi()) / 2 * 1024 * 256) AS oy)"


@REG.add(f"""WITH {{DEM}}, {{MODEL}}, {VALUE}, {SIZE}, {FILLED}, {ORIGIN_SQL}, ext AS (SELECT *, 6378137 * (east - west) * {DEG_SQL} * c0 AS ex, 6378137 * (north - south) * {DEG_SQL} AS ey FROM model),
 nodes AS (SELECT i, j, lon0 + (-ex / 2 + i * ex / 40) / (6378137 * {DEG_SQL} * c0) AS lon, lat0 + (-ey / 2 + j * ey / 40) / (6378137 * {DEG_SQL}) AS lat FROM ext, (SELECT unnest(range(0, 41)) AS i) a, (SELECT unnest(range(0, 41)) AS j) b),
 px AS (SELECT i, j, (lon + 180) / 360 * 1024 * 256 - ox AS x, (1 - ln(tan(lat * {DEG_SQL}) + 1 / cos(lat * {DEG_SQL})) / pi()) / 2 * 1024 * 256 - oy AS y FROM nodes, org),
 o AS (SELECT a.i AS dx, b.i AS dy FROM (SELECT unnest(range(-1, 2)) AS i) a, (SELECT unnest(range(-1, 2)) AS i) b)
 SELECT i, j, round(greatest(avg(v), 0)::FLOAT::DOUBLE, 3) + 0e0 AS h_m FROM px, o JOIN fil ON fil.px = floor(x + 0.5e0) + dx AND fil.py = floor(y + 0.5e0) + dy GROUP BY i, j""")
def h05_build_heightfield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid nodes of the model box, sampled from pixels by box means and cut at sea level (H3 to H5)."""
    west, south, east, north = (F.lit(v) for v in BOX)
    o, (ex, ey) = geo.origin(west, south, east, north), geo.extent(west, south, east, north)
    node = F.sequence(F.lit(0), F.lit(NODES - 1))
    grid = spark.range(1).select(F.explode(node).alias("i")).select("i", F.explode(node).alias("j"))
    lon, lat = geo.unproject(-ex / 2 + F.col("i") * ex / (NODES - 1), -ey / 2 + F.col("j") * ey / (NODES - 1), o)
    z = F.lit(ZOOM)
    x = geo.tile_x(lon, z) * TILE - F.floor(geo.tile_x(west, z) * TILE)
    y = geo.tile_y(lat, z) * TILE - F.floor(geo.tile_y(north, z) * TILE)
    p, _, _ = _filled(spark, sf_dir)
    sampled = raster.box_mean(grid.select(F.struct("i", "j").alias("id"), x.alias("x"), y.alias("y")), p, 1)
    h = F.greatest(F.col("v"), F.lit(0.0)).cast("float").cast("double")
    return sampled.select(F.col("id.i").cast("long").alias("i"), F.col("id.j").cast("long").alias("j"), (F.round(h, 3) + 0.0).alias("h_m"))


#: Grids over the filled pixels: id, box, and the step that was asked for. At this zoom they stand for less than a pixel, three and five pixels.
GRIDS = [(0, 7.63, 45.95, 7.71, 46.0, 150.0), (1, 7.62, 45.94, 7.74, 46.02, 300.0), (2, 7.66, 45.96, 7.70, 46.01, 480.0)]


@REG.add(f"""WITH {{DEM}}, {VALUE}, {SIZE}, {FILLED}, {ORIGIN_SQL}, gr(m, west, south, east, north, res) AS (VALUES {', '.join('(' + ', '.join(f'{v}e0' if isinstance(v, float) else str(v) for v in g) + ')' for g in GRIDS)}),
 mid AS (SELECT *, (west + east) / 2 AS lon0, (south + north) / 2 AS lat0, cos((south + north) / 2 * {DEG_SQL}) AS c0 FROM gr), ext AS (SELECT *, 6378137 * (east - west) * {DEG_SQL} * c0 AS ex, 6378137 * (north - south) * {DEG_SQL} AS ey, floor(res / (40075016.686e0 * c0 / (1024 * 256)) / 2)::BIGINT AS radius FROM mid),
 dim AS (SELECT *, ceil(ex / res)::BIGINT + 1 AS cols, ceil(ey / res)::BIGINT + 1 AS rows FROM ext), nj AS (SELECT *, unnest(range(0, rows)) AS j FROM dim), nodes AS (SELECT *, unnest(range(0, cols)) AS i FROM nj),
 ll AS (SELECT *, lon0 + (-ex / 2 + i * (ex / (cols - 1))) / (6378137 * {DEG_SQL} * c0) AS lon, lat0 + (-ey / 2 + j * (ey / (rows - 1))) / (6378137 * {DEG_SQL}) AS lat FROM nodes),
 px AS (SELECT m, i, j, radius, (lon + 180) / 360 * 1024 * 256 - ox AS x, (1 - ln(tan(lat * {DEG_SQL}) + 1 / cos(lat * {DEG_SQL})) / pi()) / 2 * 1024 * 256 - oy AS y FROM ll, org),
 box AS (SELECT m, i, j, avg(v) AS h FROM px, (SELECT a.k AS dx, b.k AS dy, greatest(abs(a.k), abs(b.k)) AS far FROM (SELECT unnest(range(-2, 3)) AS k) a, (SELECT unnest(range(-2, 3)) AS k) b) o JOIN fil ON fil.px = floor(x + 0.5e0) + dx AND fil.py = floor(y + 0.5e0) + dy WHERE radius >= 1 AND far <= radius GROUP BY m, i, j),
 cl AS (SELECT m, i, j, least(greatest(x, 0), w - 1e0) AS x, least(greatest(y, 0), h - 1e0) AS y, w, h FROM px, size WHERE radius = 0), co AS (SELECT *, floor(x) AS x0, floor(y) AS y0, x - floor(x) AS fx, y - floor(y) AS fy FROM cl),
 bil AS (SELECT m, i, j, (1 - fx) * (1 - fy) * a.v + fx * (1 - fy) * b.v + (1 - fx) * fy * c.v + fx * fy * d.v AS h FROM co JOIN fil a ON a.px = x0 AND a.py = y0 JOIN fil b ON b.px = least(x0 + 1, w - 1) AND b.py = y0 JOIN fil c ON c.px = x0 AND c.py = least(y0 + 1, h - 1) JOIN fil d ON d.px = least(x0 + 1, w - 1) AND d.py = least(y0 + 1, h - 1))
 SELECT m AS model_id, i, j, round(greatest(h, 0)::FLOAT::DOUBLE, 2) + 0e0 AS h_m FROM (SELECT * FROM box UNION ALL SELECT * FROM bil)""")
def h05_heightfields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models with the grid and the sampling radius that their own step asks for."""
    p, w, h = _filled(spark, sf_dir)
    west, north, z = F.lit(BOX[0]), F.lit(BOX[3]), F.lit(ZOOM)
    g = spark.createDataFrame(GRIDS, "model_id int, west double, south double, east double, north double, asked_m double")
    ex, ey = geo.extent(*(F.col(c) for c in ("west", "south", "east", "north")))
    g = g.withColumn("g", geo.grid(ex, ey, F.lit(100.0), F.lit(0.4), F.col("asked_m"))).select("*", "g.resolution_m", "g.cols", "g.rows")
    g = g.withColumns({"z": z, "left": F.floor(geo.tile_x(west, z) * TILE), "top": F.floor(geo.tile_y(north, z) * TILE), "width": F.lit(w), "height": F.lit(h)})
    ids = g.select("model_id")
    field = raster.heightfields(g, p.join(F.broadcast(ids), F.lit(True)), TILE)  # a row for each model
    return field.select("model_id", "i", "j", (F.round(F.col("h_m").cast("double"), 2) + 0.0).alias("h_m"))


STORED = "stored AS (SELECT DISTINCT z, o_orderkey % (1 << z) AS x, o_custkey % (1 << z) AS y FROM (SELECT *, (3 + o_orderkey % 5)::INT AS z FROM orders))"


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that the store holds, at zooms 3 to 7."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("z", (F.lit(3) + F.col("o_orderkey") % 5).cast("int"))
    n = F.pow(F.lit(2.0), "z").cast("long")
    return o.select("z", (F.col("o_orderkey") % n).alias("x"), (F.col("o_custkey") % n).alias("y")).distinct()


def _needed(spark: SparkSession, sf_dir: str, z) -> DataFrame:
    b = _selection_boxes(spark, sf_dir).withColumn("z", z)
    r = b.select("sel_id", "z", geo.tile_range(F.col("west"), F.col("south"), F.col("east"), F.col("north"), F.col("z")).alias("r"))
    return r.select("sel_id", "z", F.explode(F.sequence("r.x_min", "r.x_max")).alias("x"), "r").select("sel_id", "z", "x", F.explode(F.sequence("r.y_min", "r.y_max")).alias("y"))


def _needed_sql(zs: str) -> str:
    ty = lambda lat: f"floor((1 - ln(tan({lat} * {DEG_SQL}) + 1 / cos({lat} * {DEG_SQL})) / pi()) / 2 * pow(2e0, z))"
    return f"""rng AS (SELECT sel_id, z, least(greatest(floor((west + 180) / 360 * pow(2e0, z)) - 1, 0), pow(2e0, z) - 1)::BIGINT AS x0, least(greatest(floor((east + 180) / 360 * pow(2e0, z)) + 1, 0), pow(2e0, z) - 1)::BIGINT AS x1,
 least(greatest({ty('north')} - 1, 0), pow(2e0, z) - 1)::BIGINT AS y0, least(greatest({ty('south')} + 1, 0), pow(2e0, z) - 1)::BIGINT AS y1 FROM boxes, ({zs})),
 need AS (SELECT sel_id, z, x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT sel_id, z, y0, y1, unnest(range(x0, x1 + 1)) AS x FROM rng))"""


@REG.add(f"WITH {{SELECTIONS}}, {BOXES}, {STORED}, {_needed_sql('SELECT 6 AS z')} SELECT sel_id, count(*) AS tiles, count(*) FILTER (WHERE stored.z IS NULL) AS missing FROM need LEFT JOIN stored USING (z, x, y) GROUP BY sel_id".replace("stored.z IS NULL", "s IS NULL").replace("LEFT JOIN stored USING (z, x, y)", "LEFT JOIN (SELECT *, 1 AS s FROM stored) USING (z, x, y)"))
def a04_tile_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that each selection needs, and those that the store lacks."""
    have = _stored(spark, sf_dir).withColumn("there", F.lit(True))
    return _needed(spark, sf_dir, F.lit(6)).join(have, ["z", "x", "y"], "left").groupBy("sel_id").agg(F.count("*").alias("tiles"), F.count_if(F.col("there").isNull()).alias("missing"))


@REG.add(f"WITH {{SELECTIONS}}, {BOXES}, {STORED}, {_needed_sql('SELECT unnest(range(3, 8))::INT AS z')} SELECT sel_id, max(z)::INT AS zoom FROM need JOIN stored USING (z, x, y) GROUP BY sel_id")
def b13_zoom_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finest zoom at which any needed tile is there: all candidate zooms in one pass."""
    need = _needed(spark, sf_dir, F.explode(F.sequence(F.lit(3), F.lit(7)))).withColumnRenamed("sel_id", "model_id")
    return raster.usable_zoom(need, _stored(spark, sf_dir)).filter("zoom IS NOT NULL").withColumnRenamed("model_id", "sel_id")


@REG.add(f"""WITH {{SELECTIONS}}, {BOXES}, {STORED}, {_needed_sql('SELECT unnest(range(6, 8))::INT AS z')}, zm AS (SELECT sel_id, max(CASE WHEN s THEN z END) AS zoom FROM need LEFT JOIN (SELECT *, true AS s FROM stored WHERE x % 3 = 0) USING (z, x, y) GROUP BY sel_id)
 SELECT sel_id, CASE WHEN zoom IS NULL THEN 'fail' ELSE 'warn' END AS level, CASE WHEN zoom IS NULL THEN 'dem-missing' ELSE 'dem-zoom-reduced' END AS code FROM zm WHERE zoom IS NULL OR zoom < 7""")
def b13_missing_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models whose terrain is there at a coarser zoom only, or not at all, from a store that lacks most tiles."""
    need = _needed(spark, sf_dir, F.explode(F.sequence(F.lit(6), F.lit(7)))).withColumnRenamed("sel_id", "model_id")
    f = raster.usable_zoom(need, _stored(spark, sf_dir).filter("x % 3 = 0")).withColumns({"wanted_zoom": F.lit(7), "missing": F.lit(0), "repaired": F.lit(0), "pixels": F.lit(1)})
    return rules.judged(f, "model_id", rules.raster_rules()).withColumnRenamed("model_id", "sel_id")
