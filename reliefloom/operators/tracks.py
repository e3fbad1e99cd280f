"""Track operators: cleaning, statistics, densifying, capping, simplifying and fitting.

Input is one row for each point: route_id, seq, lon, lat and, where known, ele and t_ms. A route of at
most RUN points is one group. A longer one is numbered and cut into runs of RUN points, which are folded
in parallel: each starts from what the run before it ended with, and is folded again when that changes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import geo
from .lineage import cut
from .runs import State, by_length, folded, in_runs, in_step, numbers, whole_keys

# Limits that results depend on.
MAX_POINTS = 50_000
RUN = 10_000  # points that a task folds at a time; results do not depend on it
KEPT, DUPLICATE, SPIKE = 0, 1, 2
DUPLICATE_M = 0.05
MAX_SPEED_MS = 200 / 3.6
FIT_PADDING = 0.15
LEAST_PADDING_DEG = 0.002


def _route() -> WindowSpec:
    return Window.partitionBy("route_id").orderBy("seq")


def with_previous(points: DataFrame, columns: list[str]) -> DataFrame:
    """points with `prev_<column>`: the values of the route's point before."""
    return points.withColumns({f"prev_{c}": F.lag(c).over(_route()) for c in columns})


def valid_points(points: DataFrame) -> DataFrame:
    """Finite points on the globe; an elevation that is not finite becomes null."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    ok = points.filter(finite("lon") & finite("lat") & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    return ok.withColumn("ele", F.when(finite("ele"), F.col("ele")))


def capped(points: DataFrame, most: int = MAX_POINTS) -> DataFrame:
    """Every stride-th point of a long route, and its last."""
    n = F.count("*").over(Window.partitionBy("route_id"))
    numbered = points.withColumns({"_n": n, "_i": F.row_number().over(_route()) - 1})
    return numbered.filter((F.col("_i") % F.ceil(F.col("_n") / most) == 0) | (F.col("_i") == F.col("_n") - 1)).drop("_n", "_i")


def statistics(points: DataFrame) -> DataFrame:
    """route_id, points, distance_m, gain_m and the route's box.

    A pair of points without both elevations gives no gain; a route without such a pair has null.
    """
    p = with_previous(points, ["lon", "lat", "ele"])
    metres = geo.haversine(F.col("prev_lon"), F.col("prev_lat"), F.col("lon"), F.col("lat"))
    rise = F.col("ele") - F.col("prev_ele")
    return p.groupBy("route_id").agg(
        F.count("*").alias("points"), F.coalesce(F.sum(metres), F.lit(0.0)).alias("distance_m"), F.sum(F.when(rise > 0, rise).when(rise.isNotNull(), 0.0)).alias("gain_m"),
        F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"),
    )


def _judged_run(pdf: pd.DataFrame, last: tuple | None) -> tuple[list[int], tuple | None]:
    """The verdict on each point, and the last point kept."""
    verdicts = []
    for x, y, t in zip(pdf["_x"], pdf["_y"], pdf["t_ms"]):
        t = None if pd.isna(t) else t
        verdict = KEPT
        if last is not None:
            d = float(np.hypot(x - last[0], y - last[1]))
            dt = None if t is None or last[2] is None else (t - last[2]) / 1000
            if not d >= DUPLICATE_M:
                verdict = DUPLICATE
            elif dt is not None and dt > 0 and d > MAX_SPEED_MS * dt:
                verdict = SPIKE
        verdicts.append(verdict)
        if verdict == KEPT:
            last = (x, y, t)
    return verdicts, last


def judged(points: DataFrame, origin) -> DataFrame:
    """points with `verdict`: KEPT, DUPLICATE or SPIKE, against the last point that was kept."""
    x, y = geo.project(F.col("lon"), F.col("lat"), origin)
    short, long = by_length(points.withColumns({"_x": x, "_y": y}), ["route_id"], "seq", RUN)
    schema = short.drop("_x", "_y").withColumn("verdict", F.lit(0)).schema

    def whole(rows: pa.Table, begin: np.ndarray) -> pa.Table:
        at = np.stack(numbers(rows, "_x", "_y", "t_ms"))
        last, verdict = np.zeros((3, len(begin))), np.full(rows.num_rows, KEPT, "int32")
        for k, (who, n) in enumerate(in_step(begin, np.diff(np.append(begin, rows.num_rows)))):
            if k:
                (x, y, t), (lx, ly, lt) = at[:, n], last[:, who]
                d, dt = np.hypot(x - lx, y - ly), (t - lt) / 1000  # without both times: NaN, and no spike
                verdict[n] = np.where(~(d >= DUPLICATE_M), DUPLICATE, np.where((dt > 0) & (d > MAX_SPEED_MS * dt), SPIKE, KEPT))
            keep = verdict[n] == KEPT
            last[:, who[keep]] = at[:, n[keep]]
        return rows.append_column("verdict", pa.array(verdict)).select(schema.names)

    out = whole_keys(short, ["route_id"], ["seq"], whole, schema)
    if long is None:
        return out

    def end(pdf: pd.DataFrame, last: State) -> State:
        x, y, t = _judged_run(pdf, last)[1]
        return float(x), float(y), None if t is None else float(t)

    def verdicts(pdf: pd.DataFrame, last: State) -> pd.DataFrame:
        return pdf.assign(verdict=_judged_run(pdf, last)[0])[schema.names]

    return out.unionByName(folded(long, ["route_id"], "_sx double, _sy double, _st double", end, verdicts, schema))


def denoised(points: DataFrame, origin) -> DataFrame:
    """route_id, kept, duplicates, spikes: how many points stay and why others go."""
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1)).cast("int")
    return judged(points, origin).groupBy("route_id").agg(n(KEPT).alias("kept"), n(DUPLICATE).alias("duplicates"), n(SPIKE).alias("spikes"))


def denoise_points(points: DataFrame, origin) -> DataFrame:
    """The points that denoising keeps."""
    return judged(points, origin).filter(F.col("verdict") == KEPT).select(*points.columns)


def resampled(lines: DataFrame, longest: float) -> DataFrame:
    """line_id, seq, sub, x, y: points are put into segments longer than `longest`; given points stay exact."""
    w = Window.partitionBy("line_id").orderBy("seq")
    s = lines.select("line_id", "seq", "x", "y", F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by"))
    steps = F.greatest(F.lit(1), F.coalesce(F.ceil(geo.hypot(F.col("bx") - F.col("x"), F.col("by") - F.col("y")) / longest), F.lit(1))).cast("int")
    each = s.withColumn("steps", steps).select("line_id", "seq", "x", "y", "bx", "by", "steps", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)).alias("sub"))
    t = F.col("sub") / F.col("steps")
    at = lambda a, b: F.when(F.col("sub") == 0, F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * t).alias(a)
    return each.select("line_id", "seq", "sub", at("x", "bx"), at("y", "by"))


def densified_rings(rings: DataFrame, longest: float) -> DataFrame:
    """The same for closed rings: the last point leads back to the first."""
    w = Window.partitionBy("line_id").orderBy("seq")
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    closed = rings.select("line_id", "seq", "x", "y", F.coalesce(F.lead("x").over(w), F.first("x").over(ends)).alias("bx"), F.coalesce(F.lead("y").over(w), F.first("y").over(ends)).alias("by"))
    steps = F.greatest(F.lit(1), F.ceil(geo.hypot(F.col("bx") - F.col("x"), F.col("by") - F.col("y")) / longest)).cast("int")
    each = closed.withColumn("steps", steps).select("*", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)).alias("sub"))
    t = F.col("sub") / F.col("steps")
    return each.select("line_id", "seq", "sub", (F.col("x") + (F.col("bx") - F.col("x")) * t).alias("x"), (F.col("y") + (F.col("by") - F.col("y")) * t).alias("y"))


def _kept(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker with a stack: which points stay."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    stack = [(0, len(x) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        px, py, dx, dy = x[a + 1 : b], y[a + 1 : b], x[b] - x[a], y[b] - y[a]
        square = dx * dx + dy * dy
        t = np.clip(((px - x[a]) * dx + (py - y[a]) * dy) / square, 0, 1) if square else np.zeros(len(px))
        d = np.hypot(px - (x[a] + t * dx), py - (y[a] + t * dy))
        at = int(d.argmax())
        if d[at] > tolerance:
            keep[a + 1 + at] = True
            stack += [(a, a + 1 + at), (a + 1 + at, b)]
    return keep


def _kept_of_many(x: np.ndarray, y: np.ndarray, begin: np.ndarray, tolerance: float) -> np.ndarray:
    """`_kept` for many lines, one after another: all their pieces are split in one round, then all pieces of these."""
    a, b = begin, np.append(begin[1:], len(x)) - 1
    keep = np.zeros(len(x), bool)
    keep[a] = keep[b] = True
    while True:
        a, b = a[b - a > 1], b[b - a > 1]
        if not len(a):
            return keep
        n = b - a - 1
        start = np.cumsum(n) - n
        of = np.repeat(np.arange(len(a)), n)
        at = np.arange(len(of)) - start[of] + a[of] + 1
        ax, ay, dx, dy = (v[of] for v in (x[a], y[a], x[b] - x[a], y[b] - y[a]))
        square = dx * dx + dy * dy
        t = np.clip(np.divide((x[at] - ax) * dx + (y[at] - ay) * dy, square, out=np.zeros(len(at)), where=square != 0), 0, 1)
        d = np.hypot(x[at] - (ax + t * dx), y[at] - (ay + t * dy))
        far = np.maximum.reduceat(d, start)
        split = far > tolerance
        hit = np.flatnonzero((d == far[of]) & split[of])
        m = at[hit[np.unique(of[hit], return_index=True)[1]]]  # the first of the farthest
        keep[m] = True
        a, b = np.concatenate([a[split], m]), np.concatenate([m, b[split]])


def simplified(lines: DataFrame, tolerance: float) -> DataFrame:
    """line_id, seq, x, y of the points that stay; lines of two points, and a tolerance of 0, change nothing.

    A segment of more than RUN points is split at its farthest point, one aggregation a round for all of
    them, until each piece fits one task.
    """
    schema = "line_id long, seq long, x double, y double"

    def run(t: pa.Table, begin: np.ndarray) -> pa.Table:
        return t.filter(pa.array(_kept_of_many(*numbers(t, "x", "y"), begin, tolerance))).drop(["_i"])

    ready = lines.select(F.col("line_id").cast("long"), F.col("seq").cast("long"), "x", "y")
    if tolerance <= 0:
        return ready
    short, long = by_length(ready, ["line_id"], "seq", RUN)
    out = whole_keys(short, ["line_id"], ["seq"], run, schema)
    if long is None:
        return out

    def inner(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, first = pdf.sort_values("_i"), pdf.iloc[0]
        x, y = (np.concatenate([[first["a"][c]], pdf[c].to_numpy(), [first["b"][c]]]) for c in ("x", "y"))
        return pdf[_kept(x, y, tolerance)[1:-1]][["line_id", "seq", "x", "y"]]

    point = F.struct("_i", "seq", "x", "y")
    ends = cut(long.groupBy("line_id").agg(F.min_by(point, "_i").alias("a"), F.max_by(point, "_i").alias("b")))
    stay = [ends.select("line_id", F.explode(F.array("a", "b")).alias("p"))]
    todo, small = long.join(ends, "line_id").filter("_i > a._i AND _i < b._i").drop("_run"), []
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    square = dx * dx + dy * dy
    t = F.when(square != 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("x") - F.col("a.x")) * dx + (F.col("y") - F.col("a.y")) * dy) / square))).otherwise(0.0)
    away = F.hypot(F.col("x") - (F.col("a.x") + t * dx), F.col("y") - (F.col("a.y") + t * dy))
    while True:
        todo = cut(todo)
        big = F.col("b._i") - F.col("a._i") > RUN
        small.append(todo.filter(~big))
        todo = todo.filter(big).withColumn("d", away)
        split = todo.groupBy("line_id", F.col("a._i").alias("_a")).agg(F.max_by(point, F.struct("d", -F.col("_i"))).alias("m"), F.max("d").alias("far"))
        split = cut(split.filter(F.col("far") > tolerance).drop("far"))  # at most one for RUN points
        if split.isEmpty():
            break
        stay.append(split.select("line_id", F.col("m").alias("p")))
        todo = todo.drop("d").withColumn("_a", F.col("a._i")).join(split, ["line_id", "_a"]).filter("_i != m._i")
        before = F.col("_i") < F.col("m._i")
        todo = todo.withColumns({"a": F.when(before, F.col("a")).otherwise(F.col("m")), "b": F.when(before, F.col("m")).otherwise(F.col("b"))}).drop("_a", "m")
    rest = reduce(DataFrame.unionByName, small).withColumn("_a", F.col("a._i"))
    out = out.unionByName(rest.groupBy("line_id", "_a").applyInPandas(inner, schema))
    return out.unionByName(reduce(DataFrame.unionByName, stay).select("line_id", "p.seq", "p.x", "p.y"))


def _walked(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray, j: int, whole: bool) -> tuple[int, int, float]:
    """How many points are walked, the pointer after them, and their largest distance.

    Unless the vertices are `whole`, that is reach the line's end, the walk stops where it needs a later one.
    """
    worst, reach = 0.0, len(sx) if whole else len(sx) - 1
    for n in range(len(x)):
        while j + 2 < reach and (x[n] - sx[j + 1]) ** 2 + (y[n] - sy[j + 1]) ** 2 < (x[n] - sx[j]) ** 2 + (y[n] - sy[j]) ** 2:
            j += 1
        if not whole and j + 2 >= reach:
            return n, j, worst
        k = min(j + 1, len(sx) - 1)
        dx, dy = sx[k] - sx[j], sy[k] - sy[j]
        square = dx * dx + dy * dy
        t = min(1.0, max(0.0, ((x[n] - sx[j]) * dx + (y[n] - sy[j]) * dy) / square)) if square else 0.0
        worst = max(worst, float(np.hypot(x[n] - (sx[j] + t * dx), y[n] - (sy[j] + t * dy))))
    return len(x), j, worst


def _walked_of_many(x: np.ndarray, y: np.ndarray, vertex: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """`_walked` for many lines, a point of all of them at a time: each has its vertices first, then its points."""
    many = np.add.reduceat(vertex.astype(int), begin) if len(begin) else begin
    size = np.diff(np.append(begin, len(x)))
    j, worst = begin.copy(), np.zeros(len(begin))
    size, end = np.where(many > 0, size - many, 0), begin + many  # a line without vertices has not moved
    for who, at in in_step(end, size):
        px, py, stop = x[at], y[at], end[who]
        on = np.arange(len(who))
        while len(on):
            v = j[who[on]]
            w = np.minimum(v + 1, stop[on] - 1)
            nearer = (px[on] - x[w]) ** 2 + (py[on] - y[w]) ** 2 < (px[on] - x[v]) ** 2 + (py[on] - y[v]) ** 2
            on = on[(v + 2 < stop[on]) & nearer]
            j[who[on]] += 1
        v = j[who]
        w = np.minimum(v + 1, stop - 1)
        dx, dy = x[w] - x[v], y[w] - y[v]
        square = dx * dx + dy * dy
        t = np.divide((px - x[v]) * dx + (py - y[v]) * dy, square, out=np.zeros(len(who)), where=square != 0)
        t = np.fmin(1.0, np.fmax(0.0, t))
        worst[who] = np.fmax(worst[who], np.hypot(px - (x[v] + t * dx), py - (y[v] + t * dy)))
    return worst


def max_deviation(lines: DataFrame, simple: DataFrame) -> DataFrame:
    """line_id, deviation: the largest distance of a point to its segment of the simplified line, found walking forward.

    Runs of a long line carry the number of the segment; a task has a run and two blocks of vertices.
    """

    def run(t: pa.Table, begin: np.ndarray) -> pa.Table:
        worst = _walked_of_many(*numbers(t, "x", "y"), t.column("_vertex").to_numpy(), begin)
        return pa.table({"line_id": t.column("line_id").take(pa.array(begin)), "deviation": worst})

    def walked(points: DataFrame, vertices: DataFrame) -> DataFrame:
        both = (df.select("line_id", "seq", "x", "y", F.lit(v).alias("_vertex")) for df, v in ((vertices, True), (points, False)))
        return whole_keys(reduce(DataFrame.unionByName, both), ["line_id"], [F.desc("_vertex"), "seq"], run, "line_id long, deviation double")

    short, long = by_length(lines, ["line_id"], "seq", RUN)
    if long is None:
        return walked(short, simple)
    names = cut(long.select("line_id").distinct())
    simple = cut(simple)
    out = walked(short, simple.join(names, "line_id", "left_anti"))
    vertices = in_runs(simple.join(names, "line_id", "left_semi"), ["line_id"], "seq", RUN).select("line_id", "seq", "x", "y", F.col("_i").alias("_v"), F.col("_run").alias("_block"))
    size, at = RUN, ["line_id", "_run"]

    def walk(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("_i"), b.sort_values("_v")
        if not len(b):
            return pd.DataFrame({"line_id": [key[0]], "_run": [key[1]], "at": [int(a["_i"].max()) + 1], "j": [0], "far": [0.0], "ended": [True]})
        at, j, n = (int(a[c].iloc[0]) for c in ("_at", "_j", "_many"))
        a, low = a[a["_i"] >= at], int(b["_v"].iloc[0])
        went, j, far = _walked(*(v[c].to_numpy() for v in (a, b) for c in ("x", "y")), j - low, low + len(b) >= n)
        return pd.DataFrame({"line_id": [key[0]], "_run": [key[1]], "at": [at + went], "j": [j + low], "far": [far], "ended": [went == len(a)]})

    # One row for each run: the vertex it starts from, how far it has come. It is first tried from the last vertex before it:
    # vertices are points of the line.
    order = Window.partitionBy("line_id").orderBy("_run")
    inside = long.select("line_id", "seq", "_run").join(vertices.select("line_id", "seq"), ["line_id", "seq"]).groupBy(*at).agg(F.count("*").alias("_passed"))
    states = long.select(*at).distinct().join(inside, at, "left").join(vertices.groupBy("line_id").agg(F.count("*").alias("_many")), "line_id", "left")
    passed = F.coalesce(F.sum("_passed").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    states = states.select(*at, F.coalesce("_many", F.lit(0)).alias("_many"), F.greatest(passed - 1, F.lit(0)).cast("long").alias("_from"))
    states = cut(states.select("*", (F.col("_run") * size).alias("_at"), F.col("_from").alias("_j"), F.lit(0.0).alias("_worst"), F.lit(False).alias("_done")))
    while not (todo := states.filter("NOT _done")).isEmpty():
        block = F.floor(F.col("_j") / size)
        p = long.join(todo.select(*at, "_at", "_j", "_many"), at)
        near = todo.select(F.col("line_id").alias("_of"), F.col("_run").alias("_by"), F.explode(F.array(block, block + 1)).alias("_near"))
        v = vertices.join(near, (F.col("line_id") == F.col("_of")) & (F.col("_block") == F.col("_near"))).select("_of", "_by", "x", "y", "_v")
        got = p.groupBy(*at).cogroup(v.groupBy("_of", "_by")).applyInPandas(walk, "line_id long, _run long, at long, j long, far double, ended boolean")
        met = states.join(got, at, "left").select(*at, "_many", "_from", F.coalesce("at", "_at").alias("_at"), F.coalesce("j", "_j").alias("_j"), F.greatest("_worst", "far").alias("_worst"), F.coalesce("ended", "_done").alias("_done"))
        told = met.withColumn("_told", F.lag(F.when(F.col("_done"), F.col("_j"))).over(order))
        again = F.coalesce(F.col("_told") != F.col("_from"), F.lit(False))  # the run before ended elsewhere than was tried
        anew = {"_from": F.col("_told"), "_at": F.col("_run") * size, "_j": F.col("_told"), "_worst": F.lit(0.0), "_done": F.lit(False)}
        states = cut(told.select(*at, "_many", *(F.when(again, to).otherwise(F.col(c)).alias(c) for c, to in anew.items())))
    return out.unionByName(states.groupBy("line_id").agg(F.max("_worst").alias("deviation")))


def fitted(stats: DataFrame, by: list[str], padding: float = FIT_PADDING) -> DataFrame:
    """The union of the boxes of each group's routes, padded."""
    u = stats.groupBy(*by).agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))
    lon = F.greatest((F.col("east") - F.col("west")) * padding, F.lit(LEAST_PADDING_DEG))
    lat = F.greatest((F.col("north") - F.col("south")) * padding, F.lit(LEAST_PADDING_DEG))
    return u.select(*by, (F.col("west") - lon).alias("west"), (F.col("south") - lat).alias("south"), (F.col("east") + lon).alias("east"), (F.col("north") + lat).alias("north"))


def named(routes: DataFrame) -> DataFrame:
    """routes (file, track, raw_name) with `name`: the trimmed name, else the file's base, numbered if it has several."""
    base = F.regexp_replace("file", "(?i)\\.gpx$", "")
    n = F.count("*").over(Window.partitionBy("file"))
    i = F.row_number().over(Window.partitionBy("file").orderBy("track"))
    own = F.trim("raw_name")
    return routes.withColumn("name", F.when(own != "", own).otherwise(F.when(n > 1, F.concat(base, F.lit(" ("), i, F.lit(")"))).otherwise(base)))
