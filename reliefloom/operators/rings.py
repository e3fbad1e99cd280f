"""Rings from contour segments: chaining, cleaning, coarsening, nesting, and edge crossings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .chains import ranked_chains
from .keys import model
from .lineage import cut
from .runs import RUN, State, by_length, folded, in_step, numbers, whole_keys
from .surface import vertex_id

KEY_CELLS = 1e-6
CLOSE_CELLS, FLAT_CELLS = 0.25, 0.05
LEAST_AREA_CELLS = 4


def chained(segments: DataFrame, cell_m: float) -> DataFrame:
    """[model_id,] ring, seq, x, y: closed chains of directed segments ([model_id,] i, j, x0, y0, x1, y1).

    A segment's number is its cell and its place in it. Each segment knows its follower, and the chain's order follows
    from that. Where several segments leave a point, they follow in scan order, and each arriving segment takes its own.
    """
    m = model(segments)
    key = lambda c: F.floor(F.col(c) / (cell_m * KEY_CELLS) + 0.5)
    s = segments.withColumns({"ka": key("x0"), "kb": key("y0"), "kc": key("x1"), "kd": key("y1")})
    s = s.filter("ka != kc OR kb != kd")  # a contour through a node leaves segments without length
    scan = ["j", "i", "x0", "y0", "x1", "y1"]
    place = F.row_number().over(Window.partitionBy(*m, "i", "j").orderBy(*scan[2:])) - 1  # a cell has two at most
    s = cut(s.withColumn("id", vertex_id(place, F.col("j"), F.col("i"))))
    out = s.select(*m, F.col("ka").alias("p"), F.col("kb").alias("q"), F.row_number().over(Window.partitionBy(*m, "ka", "kb").orderBy(*scan)).alias("n"), F.col("id").alias("next"))
    into = s.select(*m, "id", F.col("kc").alias("p"), F.col("kd").alias("q"), F.row_number().over(Window.partitionBy(*m, "kc", "kd").orderBy(*scan)).alias("n"))
    ring = ranked_chains(into.join(out, [*m, "p", "q", "n"]).select(*m, "id", "next"), m)
    return s.select(*m, "id", "x0", "y0").join(ring, [*m, "id"]).select(*m, "ring", "seq", F.col("x0").alias("x"), F.col("y0").alias("y"))


def boundary_rings(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """model_id, ring, seq, vid, x, y: rings of a surface's directed boundary edges (model_id, u, v), the surface on their left.

    Where several rings meet in a vertex, an edge that arrives goes on with the edge that is next clockwise, seen
    from where it came: the surface lies between the two, so that each ring goes round one piece of it and never
    crosses itself. Around a vertex this is an order by angle, not a pairing of all edges. A ring is named by its least
    edge (u, v), which comes first.
    """
    at = lambda n: vertices.select("model_id", F.col("vid").alias(n), F.col("x").alias(f"x_{n}"), F.col("y").alias(f"y_{n}"))
    e = cut(edges.select("model_id", "u", "v").join(at("u"), ["model_id", "u"]).join(at("v"), ["model_id", "v"]))
    angle = lambda a, b: F.atan2(F.col(f"y_{b}") - F.col(f"y_{a}"), F.col(f"x_{b}") - F.col(f"x_{a}"))
    none = F.lit(None).cast(dict(e.dtypes)["u"])
    leaving = e.select("model_id", F.col("u").alias("w"), angle("u", "v").alias("turn"), F.lit(0).alias("kind"), F.col("v").alias("to"), none.alias("came"))
    coming = e.select("model_id", F.col("v").alias("w"), angle("v", "u").alias("turn"), F.lit(1).alias("kind"), none.alias("to"), F.col("u").alias("came"))
    around = Window.partitionBy("model_id", "w")
    before = F.last("to", ignorenulls=True).over(around.orderBy("turn", "kind", "to").rowsBetween(Window.unboundedPreceding, 0))
    last = F.max_by("to", F.when(F.col("kind") == 0, F.struct("turn", "to"))).over(around)
    met = leaving.unionByName(coming).select("model_id", "w", "kind", "came", F.coalesce(before, last).alias("go")).filter("kind = 1 AND go IS NOT NULL")
    ring = ranked_chains(met.select("model_id", F.struct(F.col("came").alias("u"), F.col("w").alias("v")).alias("id"), F.struct(F.col("w").alias("u"), F.col("go").alias("v")).alias("next")), ["model_id"])
    placed = ring.select("model_id", "ring", "seq", F.col("id.u").alias("u"))
    return placed.join(at("u"), ["model_id", "u"]).select("model_id", "ring", "seq", F.col("u").alias("vid"), F.col("x_u").alias("x"), F.col("y_u").alias("y"))


def _apart(pdf: pd.DataFrame, least: float, last: State) -> tuple[list[int], State]:
    """Which points lie at least so far from the last one kept, and the last one kept."""
    kept = []
    for n, (x, y) in enumerate(zip(pdf["x"].to_numpy(), pdf["y"].to_numpy())):
        if last is None or np.hypot(x - last[0], y - last[1]) >= least:
            kept.append(n)
            last = (x, y)
    return kept, last


def _bent(pdf: pd.DataFrame, least: float, last: State) -> tuple[list[int], State]:
    """Which points lie at least so far off the straight line from the last one kept to the point after them (nx, ny)."""
    kept = []
    for n, (x, y, nx, ny) in enumerate(zip(*(pdf[c].to_numpy() for c in ("x", "y", "nx", "ny")))):
        if last is None:  # a guess, until the run before has ended
            kept.append(n)
            last = (x, y)
            continue
        dx, dy = nx - last[0], ny - last[1]
        square = dx * dx + dy * dy
        t = min(1.0, max(0.0, ((x - last[0]) * dx + (y - last[1]) * dy) / square)) if square else 0.0
        if np.hypot(x - (last[0] + t * dx), y - (last[1] + t * dy)) >= least:
            kept.append(n)
            last = (x, y)
    return kept, last


def _apart_step(p: np.ndarray, last: np.ndarray, least: float) -> np.ndarray:
    """`_apart` for one point (x, y) of each of many rings."""
    return np.hypot(p[0] - last[0], p[1] - last[1]) >= least


def _bent_step(p: np.ndarray, last: np.ndarray, least: float) -> np.ndarray:
    """`_bent` for one point (x, y, nx, ny) of each of many rings."""
    (x, y, nx, ny), (lx, ly) = p, last
    dx, dy = nx - lx, ny - ly
    square = dx * dx + dy * dy
    t = np.divide((x - lx) * dx + (y - ly) * dy, square, out=np.zeros(len(x)), where=square != 0)
    t = np.fmin(1.0, np.fmax(0.0, t))
    return np.hypot(x - (lx + t * dx), y - (ly + t * dy)) >= least


#: A fold over one ring or run, with the same over many rings and the columns that it reads.
STEPS = {_apart: (_apart_step, ["x", "y"]), _bent: (_bent_step, ["x", "y", "nx", "ny"])}


def _fold(rings: DataFrame, keys: list[str], order: str, least: float, judge: Callable, first: DataFrame | None = None) -> DataFrame:
    """The points that `judge` keeps, walking along each ring, many rings at a time; in runs where a ring is long."""
    short, long = by_length(rings, keys, order, RUN)
    names, state, given = rings.columns, "_sx double, _sy double", first is not None
    if first is not None:
        short = short.join(first, keys)

    step, columns = STEPS[judge]

    def whole(t: pa.Table, begin: np.ndarray) -> pa.Table:
        at = np.stack(numbers(t, *columns))
        last = np.stack(numbers(t, "_sx", "_sy"))[:, begin] if given else np.zeros((2, len(begin)))
        kept = np.zeros(t.num_rows, bool)
        for k, (who, rows) in enumerate(in_step(begin, np.diff(np.append(begin, t.num_rows)))):
            keep = step(at[:, rows], last[:, who], least) if given or k else np.ones(len(who), bool)
            kept[rows] = keep
            last[:, who[keep]] = at[:2, rows[keep]]
        return t.filter(pa.array(kept)).select(names)

    out = whole_keys(short, keys, [order], whole, rings.schema)
    if long is None:
        return out
    end = lambda pdf, last: judge(pdf, least, last)[1]
    kept = lambda pdf, last: pdf.iloc[judge(pdf, least, last)[0]][names]
    return out.unionByName(folded(long, keys, state, end, kept, rings.schema, first))


def _numbered(points: DataFrame, keys: list[str]) -> DataFrame:
    """points with `seq` numbered anew from 0: within runs of a ring, then over its runs."""
    w = Window.partitionBy(*keys, "_run").orderBy("seq")
    runs = points.withColumn("_run", F.floor(F.col("seq") / RUN))
    sizes = runs.groupBy(*keys, "_run").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = runs.withColumn("_k", F.row_number().over(w)).join(sizes.select(*keys, "_run", before.alias("_before")), [*keys, "_run"])
    return placed.withColumn("seq", F.col("_before") + F.col("_k") - 1).drop("_run", "_k", "_before")


def _trimmed(points: DataFrame, keys: list[str], least: float, fewest: int) -> DataFrame:
    """points (seq from 0) without those at the end that are too near the first; at least `fewest` stay."""
    start = points.filter("seq = 0").select(*keys, F.col("x").alias("_fx"), F.col("y").alias("_fy"))
    far = F.max(F.when(geo.hypot(F.col("x") - F.col("_fx"), F.col("y") - F.col("_fy")) >= least, F.col("seq")))
    last = points.join(start, keys).groupBy(*keys).agg(F.greatest(F.coalesce(far, F.lit(0)), F.lit(fewest - 1)).alias("_last"))
    return points.join(last, keys).filter("seq <= _last").drop("_last")


def cleaned(rings: DataFrame, cell_m: float) -> DataFrame:
    """Rings without near-repeated and nearly straight points; each is judged against the last point kept.

    Rings that come to fewer than three points go; one whose points are all nearly straight keeps them.
    """
    keys = [*model(rings), "ring"]
    apart = _numbered(_fold(rings.select(*keys, "seq", "x", "y"), keys, "seq", cell_m * CLOSE_CELLS, _apart), keys)
    apart = cut(_trimmed(apart, keys, cell_m * CLOSE_CELLS, 1))
    size = apart.groupBy(*keys).agg(F.count("*").alias("_size"))
    apart = apart.join(size.filter("_size >= 3"), keys)
    after = apart.select(*keys, ((F.col("seq") - 1 + F.col("_size")) % F.col("_size")).alias("seq"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    closed = cut(apart.drop("_size").join(after, [*keys, "seq"]))
    end = apart.filter("seq = _size - 1").select(*keys, F.col("x").alias("_sx"), F.col("y").alias("_sy"))
    bent = cut(_fold(closed, keys, "seq", cell_m * FLAT_CELLS, _bent, cut(end)).select(*keys, "seq", "x", "y"))
    enough = bent.groupBy(*keys).count().filter("count >= 3").select(*keys)
    straight = closed.select(*keys, "seq", "x", "y").join(enough, keys, "left_anti")
    out = bent.join(enough, keys, "left_semi").unionByName(straight)
    return _numbered(out, keys).select(*keys, F.col("seq").cast(rings.schema["seq"].dataType).alias("seq"), "x", "y")


def coarsened(rings: DataFrame, least_m: float) -> DataFrame:
    """Rings whose points are at least so far apart; rings that would have fewer than three stay as they are, and so do those of three."""
    keys = [*model(rings), "ring"]
    sizes = cut(rings.groupBy(*keys).count())
    long = rings.join(sizes.filter("count > 3").select(*keys), keys, "left_semi")
    apart = _fold(long.select(*rings.columns), keys, "seq", least_m, _apart)
    seq = F.col("seq").alias("_seq")
    trimmed = cut(_trimmed(_numbered(apart.withColumn("_seq", seq), keys), keys, least_m, 3).withColumn("seq", F.col("_seq")).select(*rings.columns))
    enough = trimmed.groupBy(*keys).count().filter("count >= 3").select(*keys)
    return trimmed.join(enough, keys, "left_semi").unionByName(rings.join(enough, keys, "left_anti").select(*rings.columns))


def measured(rings: DataFrame) -> DataFrame:
    """[model_id,] ring, points, area (signed), shape ARRAY<STRUCT<x, y>>."""
    m = model(rings)
    g = rings.groupBy(*m, "ring").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("ps")).select(*m, "ring", F.transform("ps", lambda p: geo.point(p["x"], p["y"])).alias("shape"))
    return g.select(*m, "ring", F.size("shape").cast("long").alias("points"), geo.ring_area(F.col("shape")).alias("area"), "shape")


def nested(rings: DataFrame, cell_m: float) -> DataFrame:
    """[model_id,] outer, ring: each hole with the smallest outer ring that holds its first point; outers with themselves. Tiny rings and loose holes go."""
    m = model(rings)
    shapes = measured(rings).filter(F.abs("area") >= LEAST_AREA_CELLS * cell_m * cell_m)
    outers = shapes.filter("area > 0").select(*m, F.col("ring").alias("outer"), F.col("area").alias("size"), F.col("shape").alias("around"))
    size = 100 * cell_m
    at = lambda v: F.floor(v / size)
    box = outers.withColumn("b", geo.ring_bbox(F.col("around")))
    cells = box.withColumn("cx", F.explode(F.sequence(at(F.col("b.west")), at(F.col("b.east"))))).withColumn("cy", F.explode(F.sequence(at(F.col("b.south")), at(F.col("b.north")))))
    probe = shapes.filter("area < 0").select(*m, "ring", F.get("shape", F.lit(0)).alias("p")).withColumns({"cx": at(F.col("p.x")), "cy": at(F.col("p.y"))})
    inside = probe.join(cells, [*m, "cx", "cy"]).filter(geo.ring_contains(F.col("around"), F.col("p.x"), F.col("p.y")))
    holes = inside.groupBy(*m, "ring").agg(F.min_by("outer", "size").alias("outer"))
    return outers.select(*m, "outer", F.col("outer").alias("ring")).unionByName(holes.select(*m, "outer", "ring"))


def crossings(edges: DataFrame, ring_edges: DataFrame, cell_m: float) -> DataFrame:
    """[model_id,] id, t: the smallest place along each edge (id, ax, ay, bx, by) where a ring edge crosses it, kept off its ends."""
    at = lambda v: F.floor(v / cell_m)
    c = F.col
    m = model(ring_edges)

    def dealt(df: DataFrame) -> DataFrame:
        x = F.explode(F.sequence(at(F.least("ax", "bx")), at(F.greatest("ax", "bx"))))
        y = F.explode(F.sequence(at(F.least("ay", "by")), at(F.greatest("ay", "by"))))
        return df.withColumn("cx", x).withColumn("cy", y)

    other = dealt(ring_edges.select(*m, "ax", "ay", "bx", "by")).withColumnsRenamed({"ax": "px", "ay": "py", "bx": "qx", "by": "qy"})
    j = dealt(edges).join(other, [*m, "cx", "cy"])
    dx, dy, rx, ry = c("bx") - c("ax"), c("by") - c("ay"), c("qx") - c("px"), c("qy") - c("py")
    d = dx * ry - dy * rx
    t = F.try_divide((c("px") - c("ax")) * ry - (c("py") - c("ay")) * rx, d)
    u = F.try_divide((c("px") - c("ax")) * dy - (c("py") - c("ay")) * dx, d)
    hit = j.select(*m, "id", t.alias("t"), u.alias("u")).filter("t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1")
    return hit.groupBy(*m, "id").agg(geo.clamp(F.min("t"), 0.001, 0.999).alias("t"))
