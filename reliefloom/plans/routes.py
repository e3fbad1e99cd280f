"""Queries over tracks: statistics, cleaning, densifying, fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import rings, tracks
from .derived import gps_points
from .projection import BOX, DEG_SQL, HAV, PREV
from .registry import Registry, r4, r6

REG = Registry()
STATS = f"stats AS (SELECT route_id, count(*) AS points, coalesce(sum({HAV}), 0) AS distance_m, sum(CASE WHEN ele - pele > 0 THEN ele - pele WHEN ele - pele IS NOT NULL THEN 0 END) AS gain_m, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM prev GROUP BY route_id)"
XY = f"xy AS (SELECT route_id, seq, t_ms, lon, lat, ele, 6378137 * (lon - lon0) * {DEG_SQL} * c0 AS x, 6378137 * (lat - lat0) * {DEG_SQL} AS y FROM gps, model)"
FOLD = """fold AS (
 SELECT route_id, seq, x, y, t_ms AS t, 0 AS dup, 0 AS spike, true AS keep FROM xy WHERE seq = 1
 UNION ALL
 SELECT route_id, seq, CASE WHEN d OR s THEN px ELSE x END, CASE WHEN d OR s THEN py ELSE y END, CASE WHEN d OR s THEN pt ELSE t_ms END, dup + d::INT, spike + s::INT, NOT (d OR s) FROM (
   SELECT *, metres < 0.05e0 AS d, metres >= 0.05e0 AND coalesce(t_ms - pt > 0 AND metres > (t_ms - pt) / 1000e0 * 200e0 / 3.6e0, false) AS s FROM (
     SELECT xy.route_id, xy.seq, xy.x, xy.y, xy.t_ms, f.x AS px, f.y AS py, f.t AS pt, dup, spike, sqrt((xy.x - f.x) * (xy.x - f.x) + (xy.y - f.y) * (xy.y - f.y)) AS metres
     FROM fold f JOIN xy ON xy.route_id = f.route_id AND xy.seq = f.seq + 1)))"""


def _origin():
    return geo.origin(*(F.lit(v) for v in BOX))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.project(F.col("lon"), F.col("lat"), _origin())
    return gps_points(spark, sf_dir).select(F.col("route_id").alias("line_id"), "seq", x.alias("x"), y.alias("y"))


@REG.add("""WITH {GPS}, p AS (SELECT route_id, seq, CASE WHEN seq % 11 = 0 THEN lon * 1e3 WHEN seq % 13 = 0 THEN NULL ELSE lon END AS lon, CASE WHEN seq % 17 = 0 THEN 'nan'::DOUBLE ELSE lat END AS lat, CASE WHEN seq % 7 = 0 THEN 'inf'::DOUBLE ELSE ele END AS ele FROM gps)
 SELECT route_id, seq, round(lon, 6) + 0e0 AS lon, round(lat, 6) + 0e0 AS lat, CASE WHEN isfinite(ele) THEN ele END AS ele FROM p WHERE lon IS NOT NULL AND isfinite(lon) AND isfinite(lat) AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180""")
def c10_point_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("seq")
    p = gps_points(spark, sf_dir).withColumns({
        "lon": F.when(s % 11 == 0, F.col("lon") * 1000).when(s % 13 != 0, F.col("lon")), "lat": F.when(s % 17 == 0, float("nan")).otherwise(F.col("lat")), "ele": F.when(s % 7 == 0, float("inf")).otherwise(F.col("ele")),
    })
    return tracks.valid_points(p).select("route_id", "seq", r6(F.col("lon")).alias("lon"), r6(F.col("lat")).alias("lat"), "ele")


@REG.add("""WITH r AS (SELECT DISTINCT 'ride_' || (user_id % 40) || CASE WHEN user_id % 2 = 0 THEN '.gpx' ELSE '.GPX' END AS file, user_id AS track, CASE WHEN user_id % 3 = 0 THEN ' Trail ' || user_id || ' ' WHEN user_id % 3 = 1 THEN '  ' END AS raw FROM events)
 SELECT file, track, CASE WHEN trim(raw) <> '' THEN trim(raw) WHEN count(*) OVER (PARTITION BY file) > 1 THEN regexp_replace(file, '\\.gpx$', '', 'i') || ' (' || row_number() OVER (PARTITION BY file ORDER BY track) || ')' ELSE regexp_replace(file, '\\.gpx$', '', 'i') END AS name FROM r""".replace("\\\\", "\\"))
def c11_route_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("track")
    file = F.concat(F.lit("ride_"), u % 40, F.when(u % 2 == 0, ".gpx").otherwise(".GPX"))
    r = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("track")).distinct().select(file.alias("file"), "track", F.when(u % 3 == 0, F.concat(F.lit(" Trail "), u, F.lit(" "))).when(u % 3 == 1, "  ").alias("raw_name"))
    return tracks.named(r).select("file", "track", "name")


@REG.add(f"WITH {{GPS}}, {PREV}, {STATS} SELECT route_id, points, round(distance_m, 4) + 0e0 AS distance_m, round(gain_m, 4) + 0e0 AS gain_m, west, south, east, north FROM stats".replace("west, south, east, north FROM stats", "round(west, 6) + 0e0 AS west, round(south, 6) + 0e0 AS south, round(east, 6) + 0e0 AS east, round(north, 6) + 0e0 AS north FROM stats"))
def e01_route_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance, elevation gain and bounds of each route."""
    s = tracks.statistics(gps_points(spark, sf_dir))
    return s.select("route_id", "points", r4(F.col("distance_m")).alias("distance_m"), r4(F.col("gain_m")).alias("gain_m"), *(r6(F.col(c)).alias(c) for c in ("west", "south", "east", "north")))


@REG.add(f"""WITH {{GPS}}, {PREV}, {STATS}, u AS (SELECT route_id % 7 AS grp, min(west) AS w, min(south) AS s, max(east) AS e, max(north) AS n FROM stats WHERE route_id % 5 <> 0 GROUP BY route_id % 7)
 SELECT grp, round(w - greatest((e - w) * 0.15e0, 0.002e0), 6) + 0e0 AS west, round(s - greatest((n - s) * 0.15e0, 0.002e0), 6) + 0e0 AS south, round(e + greatest((e - w) * 0.15e0, 0.002e0), 6) + 0e0 AS east, round(n + greatest((n - s) * 0.15e0, 0.002e0), 6) + 0e0 AS north FROM u""")
def e04_fit_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections fitted to groups of visible routes."""
    s = tracks.statistics(gps_points(spark, sf_dir)).filter(F.col("route_id") % 5 != 0).withColumn("grp", F.col("route_id") % 7)
    return tracks.fitted(s, ["grp"]).select("grp", *(r6(F.col(c)).alias(c) for c in ("west", "south", "east", "north")))


@REG.add(f"WITH RECURSIVE {{GPS}}, {{MODEL}}, {XY}, {FOLD} SELECT route_id, (max(seq) - arg_max(dup, seq) - arg_max(spike, seq))::INT AS kept, arg_max(dup, seq)::INT AS duplicates, arg_max(spike, seq)::INT AS spikes FROM fold GROUP BY route_id")
def f01_denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.denoised(gps_points(spark, sf_dir), _origin())


@REG.add(f"WITH RECURSIVE {{GPS}}, {{MODEL}}, {XY}, {FOLD} SELECT fold.route_id, fold.seq, round(lon, 6) + 0e0 AS lon, round(lat, 6) + 0e0 AS lat FROM fold JOIN gps USING (route_id, seq) WHERE keep")
def f01_denoised_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.denoise_points(gps_points(spark, sf_dir), _origin()).select("route_id", "seq", r6(F.col("lon")).alias("lon"), r6(F.col("lat")).alias("lat"))


#: Points that stay, by recursion over intervals split at their farthest point; then the walk over them, a step at a time.
SIMPLER = """pn AS (SELECT route_id AS line, seq, x, y FROM xy),
 iv AS (SELECT line, min(seq) AS a, max(seq) AS b FROM pn GROUP BY line
   UNION ALL SELECT line, CASE h WHEN 0 THEN a ELSE -far.k END, CASE h WHEN 0 THEN -far.k ELSE b END FROM (
     SELECT line, a, b, max({'d': d, 'k': -seq}) AS far FROM (SELECT line, a, b, seq, sqrt(pow(x - (ax + t * (bx - ax)), 2) + pow(y - (ay + t * (b_y - ay)), 2)) AS d FROM (
       SELECT iv.line, a, b, p.seq, p.x, p.y, f.x AS ax, f.y AS ay, l.x AS bx, l.y AS b_y, CASE WHEN f.x = l.x AND f.y = l.y THEN 0 ELSE least(1, greatest(0, ((p.x - f.x) * (l.x - f.x) + (p.y - f.y) * (l.y - f.y)) / (pow(l.x - f.x, 2) + pow(l.y - f.y, 2)))) END AS t
       FROM iv JOIN pn p ON p.line = iv.line AND p.seq > a AND p.seq < b JOIN pn f ON f.line = iv.line AND f.seq = a JOIN pn l ON l.line = iv.line AND l.seq = b)) GROUP BY line, a, b), (VALUES (0), (1)) s(h) WHERE far.d > 400),
 st AS (SELECT line, a AS seq FROM iv UNION SELECT line, b FROM iv), vx AS (SELECT line, list(x ORDER BY seq) AS sx, list(y ORDER BY seq) AS sy, count(*) AS n FROM st JOIN pn USING (line, seq) GROUP BY line),
 ln AS (SELECT line, list(x ORDER BY seq) AS px, list(y ORDER BY seq) AS py, count(*) AS m FROM pn GROUP BY line),
 wk AS (SELECT line, 1::BIGINT AS i, 1::BIGINT AS j, 0e0 AS worst FROM ln
   UNION ALL SELECT line, CASE WHEN go THEN i ELSE i + 1 END, CASE WHEN go THEN j + 1 ELSE j END, CASE WHEN go THEN worst ELSE greatest(worst, sqrt(pow(x - (ax + t * (bx - ax)), 2) + pow(y - (ay + t * (b_y - ay)), 2))) END FROM (
     SELECT *, CASE WHEN ax = bx AND ay = b_y THEN 0 ELSE least(1, greatest(0, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / (pow(bx - ax, 2) + pow(b_y - ay, 2)))) END AS t FROM (
       SELECT wk.line, i, j, worst, px[i] AS x, py[i] AS y, sx[j] AS ax, sy[j] AS ay, sx[least(j + 1, n)] AS bx, sy[least(j + 1, n)] AS b_y, j + 1 < n AND (px[i] - sx[j + 1]) * (px[i] - sx[j + 1]) + (py[i] - sy[j + 1]) * (py[i] - sy[j + 1]) < (px[i] - sx[j]) * (px[i] - sx[j]) + (py[i] - sy[j]) * (py[i] - sy[j]) AS go
       FROM wk JOIN ln USING (line) JOIN vx USING (line) WHERE i <= m))),
 dv AS (SELECT line, max(worst) AS deviation FROM wk GROUP BY line)"""


@REG.add(f"WITH RECURSIVE {{GPS}}, {{MODEL}}, {XY}, {SIMPLER} SELECT line AS line_id, n AS kept, round(deviation, 4) + 0e0 AS deviation FROM vx JOIN dv USING (line)")
def f02_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that stay within 400 m, and how far each line moved."""
    lines = _lines(spark, sf_dir)
    simple = tracks.simplified(lines, 400.0)
    moved = tracks.max_deviation(lines.select(F.col("line_id").cast("long"), "seq", "x", "y"), simple)
    kept = simple.groupBy("line_id").agg(F.count("*").alias("kept"))
    return kept.join(moved, "line_id").select("line_id", "kept", r4(F.col("deviation")).alias("deviation"))


NEXT = "nx AS (SELECT *, lead(x) OVER w AS bx, lead(y) OVER w AS yb, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM xy WINDOW w AS (PARTITION BY route_id ORDER BY seq))"


@REG.add(f"""WITH {{GPS}}, {{MODEL}}, {XY}, {NEXT}, st AS (SELECT *, greatest(1, coalesce(ceil(sqrt((bx - x) * (bx - x) + (yb - y) * (yb - y)) / 750), 1))::INT AS steps FROM nx), ex AS (SELECT *, unnest(range(0, steps)) AS sub FROM st)
 SELECT route_id AS line_id, seq, sub::INT AS sub, round(CASE WHEN sub = 0 THEN x ELSE x + (bx - x) * (sub / steps::DOUBLE) END, 3) + 0e0 AS x, round(CASE WHEN sub = 0 THEN y ELSE y + (yb - y) * (sub / steps::DOUBLE) END, 3) + 0e0 AS y FROM ex""")
def f03_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.resampled(_lines(spark, sf_dir), 750.0).select("line_id", "seq", "sub", (F.round("x", 3) + 0.0).alias("x"), (F.round("y", 3) + 0.0).alias("y"))


@REG.add(f"""WITH {{GPS}}, {{MODEL}}, {XY}, {NEXT}, cl AS (SELECT route_id, seq, x, y, coalesce(bx, fx) AS bx, coalesce(yb, fy) AS yb FROM nx), st AS (SELECT *, greatest(1, ceil(sqrt((bx - x) * (bx - x) + (yb - y) * (yb - y)) / 900))::INT AS steps FROM cl), ex AS (SELECT *, unnest(range(0, steps)) AS sub FROM st)
 SELECT route_id AS line_id, seq, sub::INT AS sub, round(x + (bx - x) * (sub / steps::DOUBLE), 4) + 0e0 AS x, round(y + (yb - y) * (sub / steps::DOUBLE), 4) + 0e0 AS y FROM ex""")
def f04_densify_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.densified_rings(_lines(spark, sf_dir), 900.0).select("line_id", "seq", "sub", r4(F.col("x")).alias("x"), r4(F.col("y")).alias("y"))


@REG.add("WITH {GPS}, n AS (SELECT *, count(*) OVER (PARTITION BY route_id) AS n, row_number() OVER (PARTITION BY route_id ORDER BY seq) - 1 AS i FROM gps) SELECT route_id, seq FROM n WHERE i % ceil(n / 20e0)::BIGINT = 0 OR i = n - 1")
def f06_cap_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.capped(gps_points(spark, sf_dir), 20).select("route_id", "seq")


@REG.add(f"""WITH RECURSIVE {{GPS}}, {{MODEL}}, {XY}, {FOLD}, kept AS (SELECT fold.route_id, fold.seq, gps.lon, gps.lat, gps.ele FROM fold JOIN gps USING (route_id, seq) WHERE keep),
 prev AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat, lag(ele) OVER w AS pele FROM kept WINDOW w AS (PARTITION BY route_id ORDER BY seq)), {STATS},
 box AS (SELECT route_id, points, distance_m, gain_m, west - greatest((east - west) * 0.15e0, 0.002e0) AS west, south - greatest((north - south) * 0.15e0, 0.002e0) AS south, east + greatest((east - west) * 0.15e0, 0.002e0) AS east, north + greatest((north - south) * 0.15e0, 0.002e0) AS north FROM stats),
 ext AS (SELECT *, 6378137 * (east - (west + east) / 2) * {DEG_SQL} * cos((south + north) / 2 * {DEG_SQL}) - 6378137 * (west - (west + east) / 2) * {DEG_SQL} * cos((south + north) / 2 * {DEG_SQL}) AS ex,
   6378137 * (north - (south + north) / 2) * {DEG_SQL} - 6378137 * (south - (south + north) / 2) * {DEG_SQL} AS ey FROM box),
 res AS (SELECT *, least(greatest(greatest(least(greatest(greatest(ex, ey) / 600, 5), 500), 0.4e0 / (100e0 / greatest(ex, ey))), 5), 500) AS res FROM ext)
 SELECT route_id, points, round(distance_m, 4) + 0e0 AS distance_m, round(gain_m, 4) + 0e0 AS gain_m, round(west, 6) + 0e0 AS west, round(south, 6) + 0e0 AS south, round(east, 6) + 0e0 AS east, round(north, 6) + 0e0 AS north,
        (ceil(ex / res) + 1)::BIGINT AS cols, (ceil(ey / res) + 1)::BIGINT AS rows FROM res""")
def flagship_route_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks cleaned, measured, and a model fitted to each: the grid that it would be printed on."""
    stats = tracks.statistics(tracks.denoise_points(gps_points(spark, sf_dir), _origin()))
    box = tracks.fitted(stats, ["route_id"])
    all_ = stats.drop("west", "south", "east", "north").join(box, "route_id")
    ex, ey = geo.extent(*(F.col(c) for c in ("west", "south", "east", "north")), cos=geo.libm_cos)  # the longest side has 250 cells, give or take a bit
    g = all_.withColumns({"ex": ex, "ey": ey}).withColumn("g", geo.grid(F.col("ex"), F.col("ey"), F.lit(100.0), F.lit(0.4), F.lit(None).cast("double")))
    return g.select("route_id", "points", r4(F.col("distance_m")).alias("distance_m"), r4(F.col("gain_m")).alias("gain_m"), *(r6(F.col(c)).alias(c) for c in ("west", "south", "east", "north")), "g.cols", "g.rows")


def _dist(a: str, b: str) -> str:
    return f"sqrt(({a}x - {b}x) * ({a}x - {b}x) + ({a}y - {b}y) * ({a}y - {b}y))"


def _apart_sql(least: float, fewest: int, smallest: int) -> str:
    """Routes as rings, by recursion: `tr`, the points so far from the last kept, without those at the end that are too near the first."""
    return f"""pn AS (SELECT route_id AS ring, seq - 1 AS n, x, y, count(*) OVER (PARTITION BY route_id) AS m FROM xy),
 ap AS (SELECT ring, n, x AS lx, y AS ly, true AS keep FROM pn WHERE n = 0 AND m >= {smallest}
   UNION ALL SELECT ring, n, CASE WHEN far THEN x ELSE lx END, CASE WHEN far THEN y ELSE ly END, far FROM (SELECT pn.ring, pn.n, x, y, lx, ly, {_dist('', 'l')} >= {least} AS far FROM ap JOIN pn ON pn.ring = ap.ring AND pn.n = ap.n + 1)),
 kp AS (SELECT ring, n, x, y, row_number() OVER (PARTITION BY ring ORDER BY n) - 1 AS k FROM ap JOIN pn USING (ring, n) WHERE keep),
 fs AS (SELECT ring, x AS fx, y AS fy FROM kp WHERE k = 0),
 lst AS (SELECT ring, greatest(coalesce(max(k) FILTER (WHERE {_dist('', 'f')} >= {least}), 0), {fewest - 1}) AS last FROM kp JOIN fs USING (ring) GROUP BY ring),
 tr AS (SELECT ring, n, k, x, y, count(*) OVER (PARTITION BY ring) AS size FROM kp JOIN lst USING (ring) WHERE k <= last)"""


@REG.add(f"""WITH RECURSIVE {{GPS}}, {{MODEL}}, {XY}, {_apart_sql(1500, 3, 4)}
 SELECT ring, n AS seq, round(x, 3) + 0e0 AS x, round(y, 3) + 0e0 AS y FROM tr WHERE size >= 3 UNION ALL SELECT ring, n, round(x, 3) + 0e0, round(y, 3) + 0e0 FROM pn WHERE ring NOT IN (SELECT ring FROM tr WHERE size >= 3)""")
def f09_coarsen_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes as rings, with points at least 1500 m apart."""
    out = rings.coarsened(_rings(spark, sf_dir), 1500.0)
    return out.select("ring", "seq", *((F.round(c, 3) + 0.0).alias(c) for c in "xy"))


@REG.add(f"""WITH RECURSIVE {{GPS}}, {{MODEL}}, {XY}, {_apart_sql(500, 1, 1)},
 cy AS (SELECT ring, k, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny, size FROM tr WHERE size >= 3 WINDOW w AS (PARTITION BY ring ORDER BY k)),
 bt AS (SELECT ring, -1::BIGINT AS k, x AS lx, y AS ly, false AS keep FROM cy WHERE k = size - 1
   UNION ALL SELECT ring, k, CASE WHEN off >= 100 THEN x ELSE lx END, CASE WHEN off >= 100 THEN y ELSE ly END, off >= 100 FROM (
     SELECT *, sqrt(pow(x - (lx + t * (nx - lx)), 2) + pow(y - (ly + t * (ny - ly)), 2)) AS off FROM (
       SELECT cy.ring, cy.k, x, y, nx, ny, lx, ly, CASE WHEN nx = lx AND ny = ly THEN 0 ELSE least(1, greatest(0, ((x - lx) * (nx - lx) + (y - ly) * (ny - ly)) / ((nx - lx) * (nx - lx) + (ny - ly) * (ny - ly)))) END AS t FROM bt JOIN cy ON cy.ring = bt.ring AND cy.k = bt.k + 1))),
 ok AS (SELECT ring FROM bt WHERE keep GROUP BY ring HAVING count(*) >= 3),
 res AS (SELECT ring, k, x, y FROM cy JOIN (SELECT ring, k FROM bt WHERE keep) USING (ring, k) WHERE ring IN (SELECT ring FROM ok) UNION ALL SELECT ring, k, x, y FROM cy WHERE ring NOT IN (SELECT ring FROM ok))
 SELECT ring, row_number() OVER (PARTITION BY ring ORDER BY k) - 1 AS seq, round(x, 3) + 0e0 AS x, round(y, 3) + 0e0 AS y FROM res""")
def f10_clean_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes as rings, without points that are near the last one or hardly off the straight line."""
    out = rings.cleaned(_rings(spark, sf_dir), 2000.0)
    return out.select("ring", "seq", *((F.round(c, 3) + 0.0).alias(c) for c in "xy"))


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(F.col("line_id").alias("ring"), (F.col("seq").cast("long") - 1).alias("seq"), "x", "y")
