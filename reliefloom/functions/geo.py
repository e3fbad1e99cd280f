"""Projections, tile arithmetic and selection shapes as Column expressions.

Lon/lat in degrees, world metres in a local east-north-up frame, print millimetres. All functions take
and return Columns; none needs a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Radii and limits that results depend on.
ENU_RADIUS_M = 6378137.0
HAVERSINE_RADIUS_M = 6371008.8
CIRCUMFERENCE_M = 40075016.686
DEG = math.pi / 180
MAX_GRID_VERTICES = 1_500_000
AUTO_GRID_TARGET = 600
MIN_RESOLUTION_M, MAX_RESOLUTION_M = 5.0, 500.0
SIMPLIFY_TOLERANCE_MM = 0.15
CIRCLE_SEGMENTS = 192


def clamp(v: Column, lo, hi) -> Column:
    """Below lo gives lo, else above hi gives hi; lo wins where both hold."""
    lo, hi = F.lit(lo), F.lit(hi)
    return F.when(v < lo, lo).when(v > hi, hi).otherwise(v)


def round_half_up(v: Column) -> Column:
    return F.floor(v + 0.5)


def hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


@F.pandas_udf(DoubleType())
def libm_cos(v: pd.Series) -> pd.Series:
    """The C library's cosine. Java's differs from it in the last bit now and then, which tells where a length is just a whole number of cells."""
    return v.map(lambda x: math.cos(x) if math.isfinite(x) else math.nan, na_action="ignore")


def origin(west: Column, south: Column, east: Column, north: Column, cos: Callable[[Column], Column] = F.cos) -> Column:
    lat0 = (south + north) / 2
    return F.struct(((west + east) / 2).alias("lon0"), lat0.alias("lat0"), cos(lat0 * DEG).alias("cos_lat0"))


def point_origin(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("lon0"), lat.alias("lat0"), F.cos(lat * DEG).alias("cos_lat0"))


def project(lon: Column, lat: Column, o: Column) -> tuple[Column, Column]:
    return ENU_RADIUS_M * (lon - o["lon0"]) * DEG * o["cos_lat0"], ENU_RADIUS_M * (lat - o["lat0"]) * DEG


def unproject(x_m: Column, y_m: Column, o: Column) -> tuple[Column, Column]:
    return o["lon0"] + x_m / (ENU_RADIUS_M * DEG * o["cos_lat0"]), o["lat0"] + y_m / (ENU_RADIUS_M * DEG)


def extent(west: Column, south: Column, east: Column, north: Column, cos: Callable[[Column], Column] = F.cos) -> tuple[Column, Column]:
    """Width and height of a box in metres, in its own frame."""
    o = origin(west, south, east, north, cos)
    (x0, y0), (x1, y1) = project(west, south, o), project(east, north, o)
    return x1 - x0, y1 - y0


def grid(extent_x: Column, extent_y: Column, width_mm: Column, nozzle_mm: Column, resolution_m: Column) -> Column:
    """Grid of a model; null resolution means automatic. Coarsens until the vertex cap holds."""
    longest = F.greatest(extent_x, extent_y)
    printable = nozzle_mm / (width_mm / longest)
    target = clamp(longest / AUTO_GRID_TARGET, MIN_RESOLUTION_M, MAX_RESOLUTION_M)
    auto = F.greatest(target, printable)
    start = F.when(resolution_m.isNull(), clamp(auto, MIN_RESOLUTION_M, MAX_RESOLUTION_M)).otherwise(clamp(resolution_m, MIN_RESOLUTION_M, MAX_RESOLUTION_M))
    nodes = lambda res: (F.ceil(extent_x / res) + 1).cast("double") * (F.ceil(extent_y / res) + 1)
    # each step divides the number of nodes by 1.02 at least: 64 steps reach a factor of 3, the square root rule far more
    coarser = lambda res: F.when(nodes(res) > MAX_GRID_VERTICES, res * F.greatest(F.lit(1.01), F.sqrt(nodes(res) / MAX_GRID_VERTICES))).otherwise(res)
    res = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, lambda a, _: coarser(a))
    return F.struct(
        res.alias("resolution_m"), (F.ceil(extent_x / res) + 1).alias("cols"), (F.ceil(extent_y / res) + 1).alias("rows"), (nodes(start) > MAX_GRID_VERTICES).alias("coarsened"),
        printable.alias("printable_m"), (resolution_m.isNull() & (auto > target)).alias("nozzle_limited"), (resolution_m.isNotNull() & (start < printable)).alias("below_nozzle"),
    )


def scale(extent_x: Column, extent_y: Column, width_mm: Column, min_m: Column, max_m: Column, sea_offset_m: Column, exaggeration: Column, max_height_mm: Column) -> Column:
    s = width_mm / F.greatest(extent_x, extent_y)
    relief = F.greatest(F.lit(0.0), max_m - min_m + sea_offset_m)
    clamped = (relief * s * exaggeration > max_height_mm) & (relief > 0)
    effective = F.when(clamped, max_height_mm / (relief * s)).otherwise(exaggeration)
    return F.struct(s.alias("scale"), (s * effective).alias("z_scale"), effective.alias("effective"), clamped.alias("clamped"))


def to_print(x_m: Column, y_m: Column, h_m: Column, s: Column, z: Column, min_m: Column, sea_offset_m: Column, base_mm: Column) -> tuple[Column, Column, Column]:
    relief = (h_m - min_m + sea_offset_m) * z
    return x_m * s, y_m * s, base_mm + F.when(relief < 0, 0.0).otherwise(relief)


def tile_x(lon: Column, z: Column) -> Column:
    return (lon + 180) / 360 * F.pow(F.lit(2.0), z)


def tile_y(lat: Column, z: Column) -> Column:
    rad = lat * DEG
    return (1 - F.ln(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2 * F.pow(F.lit(2.0), z)


def tile_lon(x: Column, z: Column) -> Column:
    return x / F.pow(F.lit(2.0), z) * 360 - 180


def tile_lat(y: Column, z: Column) -> Column:
    n = math.pi - 2 * math.pi * y / F.pow(F.lit(2.0), z)
    return F.atan((F.exp(n) - F.exp(-n)) * 0.5) * (180 / math.pi)


def metres_per_pixel(z: Column, lat: Column, tile_size: int) -> Column:
    return CIRCUMFERENCE_M * F.cos(lat * DEG) / (F.pow(F.lit(2.0), z) * tile_size)


def choose_zoom(target_m: Column, lat: Column, tile_size: int, max_zoom: int) -> Column:
    """Lowest zoom whose pixels are no larger than the target, else the highest."""
    fine = F.filter(F.sequence(F.lit(0), F.lit(max_zoom)), lambda z: metres_per_pixel(z, lat, tile_size) <= target_m)
    return F.coalesce(F.get(fine, F.lit(0)), F.lit(max_zoom))


def tile_range(west: Column, south: Column, east: Column, north: Column, z: Column, margin: int = 1) -> Column:
    last = F.pow(F.lit(2.0), z) - 1
    at = lambda v: clamp(v, 0.0, last).cast("long")
    return F.struct(
        at(F.floor(tile_x(west, z)) - margin).alias("x_min"), at(F.floor(tile_x(east, z)) + margin).alias("x_max"),
        at(F.floor(tile_y(north, z)) - margin).alias("y_min"), at(F.floor(tile_y(south, z)) + margin).alias("y_max"),
    )


def haversine(a_lon: Column, a_lat: Column, b_lon: Column, b_lat: Column) -> Column:
    s = F.pow(F.sin((b_lat - a_lat) * DEG / 2), 2) + F.cos(a_lat * DEG) * F.cos(b_lat * DEG) * F.pow(F.sin((b_lon - a_lon) * DEG / 2), 2)
    root = F.sqrt(s)
    return 2 * HAVERSINE_RADIUS_M * F.asin(F.when(root > 1, 1.0).otherwise(root))  # least() would turn null into 1


def metres_between(a_lon: Column, a_lat: Column, b_lon: Column, b_lat: Column) -> Column:
    return hypot(*project(b_lon, b_lat, point_origin(a_lon, a_lat)))


def point_to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = clamp(F.try_divide((px - ax) * dx + (py - ay) * dy, square), 0.0, 1.0)
    return F.when(square == 0, hypot(px - ax, py - ay)).otherwise(hypot(px - (ax + t * dx), py - (ay + t * dy)))


def simplify_tolerance_m(mm_per_m: Column) -> Column:
    return F.try_divide(F.lit(SIMPLIFY_TOLERANCE_MM), mm_per_m)


def penetration_mm(height_mm: Column) -> Column:
    return F.greatest(F.lit(1.0), height_mm / 2)


def min_width_mm(explicit_mm: Column, nozzle_mm: Column) -> Column:
    """Null means automatic: one nozzle width."""
    return F.when(explicit_mm.isNull(), nozzle_mm).otherwise(F.greatest(F.lit(0.01), explicit_mm))


def ladder_width_mm(width_m: Column, narrowest_m: Column, mm_per_m: Column, floor_mm: Column) -> Column:
    """Printed width: natural, but no less than the floor raised by the root of the class's relative width."""
    raised = F.when((width_m > 0) & (narrowest_m > 0), floor_mm * F.sqrt(F.try_divide(width_m, narrowest_m))).otherwise(floor_mm)
    return F.greatest(width_m * mm_per_m, raised)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def rectangle_ring(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.array(point(west, south), point(east, south), point(east, north), point(west, north))


def circle_ring(lon: Column, lat: Column, radius_m: Column) -> Column:
    d_lat = radius_m / ENU_RADIUS_M / DEG
    d_lon = d_lat / F.cos(lat * DEG)
    angle = lambda i: i / CIRCLE_SEGMENTS * math.pi * 2
    return F.transform(F.sequence(F.lit(0), F.lit(CIRCLE_SEGMENTS - 1)), lambda i: point(lon + F.cos(angle(i)) * d_lon, lat + F.sin(angle(i)) * d_lat))


def regular_ring(lon: Column, lat: Column, radius_m: Column, sides: int, turn: float = 0.0) -> Column:
    o = point_origin(lon, lat)
    angle = lambda i: F.lit(turn) + i / sides * math.pi * 2
    return F.transform(F.sequence(F.lit(0), F.lit(sides - 1)), lambda i: point(*unproject(F.cos(angle(i)) * radius_m, F.sin(angle(i)) * radius_m, o)))


def ring_bbox(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


def ring_world(ring: Column, o: Column) -> Column:
    return F.transform(ring, lambda p: point(*project(p["x"], p["y"], o)))


def _cyclic(ring: Column) -> Column:
    return F.arrays_zip(ring.alias("a"), F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)).alias("b"))


def ring_area(ring: Column) -> Column:
    """Signed area: positive if counter-clockwise."""
    return F.aggregate(_cyclic(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule; an edge counts where exactly one of its ends lies above the point."""
    crosses = F.filter(_cyclic(ring), lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.when(e["b"]["y"] == e["a"]["y"], 1.0).otherwise(e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))
    return F.size(crosses) % 2 == 1


def ring_centre(ring: Column) -> Column:
    n = F.size(ring)
    total = lambda c: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[c])
    return point(total("x") / n, total("y") / n)


def ring_furthest(ring: Column, lon: Column, lat: Column) -> Column:
    """The first vertex of those furthest from a point."""
    ranked = F.transform(ring, lambda p: F.struct(metres_between(lon, lat, p["x"], p["y"]).alias("d"), p.alias("p")))
    return F.aggregate(ranked, F.struct(F.lit(-1.0).alias("d"), F.get(ring, F.lit(0)).alias("p")), lambda a, r: F.when(r["d"] > a["d"], r).otherwise(a))["p"]


def ring_moved(ring: Column, d_lon: Column, d_lat: Column) -> Column:
    return F.transform(ring, lambda p: point(p["x"] + d_lon, p["y"] + d_lat))


def resize_factor(now_m: Column, pointer_m: Column) -> Column:
    """How much a ring grows when its furthest vertex follows a pointer; at least 0.02, and 1 for a point."""
    return F.when(now_m > 0, F.greatest(F.lit(0.02), F.try_divide(pointer_m, now_m))).otherwise(1.0)


def ring_scaled(ring: Column, o: Column, factor: Column) -> Column:
    """A ring scaled about the origin of a frame."""
    return F.transform(ring, lambda p: point(*unproject(*(v * factor for v in project(p["x"], p["y"], o)), o)))


def dragged_ring(tool: Column, lon: Column, lat: Column, to_lon: Column, to_lat: Column) -> Column:
    """Ring of a shape drawn from one point to another; null where the shape has no size."""
    rect = rectangle_ring(F.least(lon, to_lon), F.least(lat, to_lat), F.greatest(lon, to_lon), F.greatest(lat, to_lat))
    o = point_origin(lon, lat)
    dx, dy = project(to_lon, to_lat, o)
    side = F.greatest(F.abs(dx), F.abs(dy))
    sign = lambda v: F.when(v < 0, -1.0).otherwise(1.0)
    c_lon, c_lat = unproject(sign(dx) * side, sign(dy) * side, o)
    square = rectangle_ring(F.least(lon, c_lon), F.least(lat, c_lat), F.greatest(lon, c_lon), F.greatest(lat, c_lat))
    radius = hypot(dx, dy)
    return (
        F.when((tool == "rectangle") & (lon != to_lon) & (lat != to_lat), rect)
        .when((tool == "square") & (side > 0), square)
        .when((tool == "circle") & (radius >= 1), circle_ring(lon, lat, radius))
        .when((tool == "hexagon") & (radius >= 1), regular_ring(lon, lat, radius, 6, math.pi / 6))
    )


def wound(ring: Column, outer: Column | bool = True) -> Column:
    """The ring counter-clockwise if it is an outer one, clockwise if a hole; one without area counts as clockwise."""
    return F.when((ring_area(ring) > 0) == (outer if isinstance(outer, Column) else F.lit(outer)), ring).otherwise(F.reverse(ring))
