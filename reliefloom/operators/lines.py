"""Line-layer operators: lengths, legibility, width ladder, water splits, masks, distance fields, contours.

Spatial joins are equi-joins on a coarse cell key with the exact test as a residual: a bare range or
containment condition would be a nested loop over all pairs. Tables may hold many models: `model_id` is part
of every key, where it is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .keys import model

# Fixed values.
COVERAGE_LIMIT = 0.25
BUCKETS_PER_MM = 20
TRIANGLES_PER_POINT = 4

TILE = 64  # nodes along each side of a tile that bands are cut to
DEAL = 8  # tasks for each shuffle partition that make a field's nodes


def segments(points: DataFrame) -> DataFrame:
    """line_id, seq, ax, ay, bx, by: consecutive points of each line (line_id, seq, x, y and what else is there)."""
    w = Window.partitionBy(*model(points), "line_id").orderBy("seq")
    return points.withColumns({"bx": F.lead("x").over(w), "by": F.lead("y").over(w)}).filter("bx IS NOT NULL").withColumnsRenamed({"x": "ax", "y": "ay"})


def length() -> Column:
    return geo.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))


def class_lengths(segs: DataFrame) -> DataFrame:
    """layer, subtype, length_m, width_m, narrowest_m (of the layer)."""
    m = model(segs)
    by = segs.groupBy(*m, "layer", "subtype").agg(F.sum(length()).alias("length_m"), F.max("width_m").alias("width_m"))
    return by.withColumn("narrowest_m", F.min(F.when(F.col("width_m") > 0, F.col("width_m"))).over(Window.partitionBy(*m, "layer")))


def legible(classes: DataFrame, ranks: DataFrame, mm_per_m: float, area_mm2: float) -> DataFrame:
    """classes with `kept`: in order of importance, the first that would overfill the model cuts all after it; the first class always stays."""
    c = classes.filter("length_m > 0").join(F.broadcast(ranks), ["layer", "subtype"])
    w = Window.partitionBy(*model(classes), "layer").orderBy("rank")
    spent = F.sum(F.col("length_m") * mm_per_m * F.col("printed_mm")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    over = (spent > area_mm2 * COVERAGE_LIMIT) & (F.row_number().over(w) > 1)
    marked = c.withColumns({"_over": over.cast("int")})
    return marked.withColumn("kept", F.max("_over").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 0).drop("_over")


def width_bucket(width_mm: Column) -> Column:
    return geo.round_half_up(width_mm * BUCKETS_PER_MM) / BUCKETS_PER_MM


def in_rings(probes: DataFrame, rings: DataFrame, cell_m: float) -> DataFrame:
    """[model_id,] id of the probes (id, x, y) that lie in any ring (ring_id, ring) of their model and in none of its `holes`, if it has them.

    Cells that no edge touches and whose centre is inside lie wholly inside: a probe there needs no
    geometry, and such cells are one row each, however many rings cover them. Only the other probes
    meet the rings whose edges touch their cell, up to the first that holds them.
    """
    rings = rings if "holes" in rings.columns else rings.withColumn("holes", F.array().cast("array<array<struct<x: double, y: double>>>"))
    m = model(rings)
    at = lambda v: F.floor(v / cell_m)
    inside = lambda x, y: geo.ring_contains(F.col("ring"), x, y) & ~F.exists("holes", lambda h: geo.ring_contains(h, x, y))
    edges = F.concat(geo._cyclic(F.col("ring")), F.flatten(F.transform("holes", geo._cyclic)))
    box = rings.select(*m, "ring", "holes", edges.alias("edges"), geo.ring_bbox(F.col("ring")).alias("b"))
    cells = box.select("*", F.explode(F.sequence(at(F.col("b.west")), at(F.col("b.east")))).alias("cx")).select("*", F.explode(F.sequence(at(F.col("b.south")), at(F.col("b.north")))).alias("cy"))
    x, y, half = (F.col("cx") + 0.5) * cell_m, (F.col("cy") + 0.5) * cell_m, cell_m / 2 * (1 + 1e-9)

    def touches(e: Column) -> Column:
        a, b = e["a"], e["b"]
        overlap = lambda c, v: (F.least(a[c], b[c]) <= v + half) & (F.greatest(a[c], b[c]) >= v - half)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        return overlap("x", x) & overlap("y", y) & (F.abs(dx * (y - a["y"]) - dy * (x - a["x"])) <= (F.abs(dx) + F.abs(dy)) * half)

    judged = cells.select(*m, "ring", "holes", "cx", "cy", F.exists("edges", touches).alias("touched"), inside(x, y).alias("middle"))
    whole = judged.filter("middle AND NOT touched").select(*m, "cx", "cy").distinct()
    p = probes.withColumns({"cx": at(F.col("x")), "cy": at(F.col("y"))})
    part = judged.filter("touched").select(*(F.col(k).alias(f"r_{k}") for k in m), F.col("cx").alias("rx"), F.col("cy").alias("ry"), "ring", "holes")
    exact = (F.col("cx") == F.col("rx")) & (F.col("cy") == F.col("ry")) & inside(F.col("x"), F.col("y"))
    for k in m:
        exact = (F.col(k) == F.col(f"r_{k}")) & exact
    cell = [*m, "cx", "cy"]
    found = p.join(whole, cell, "left_anti").join(part, exact, "left_semi")
    return p.join(whole, cell, "left_semi").select(*m, "id").union(found.select(*m, "id")).distinct()


def split_on_water(segs: DataFrame, rings: DataFrame, cell_m: float = 1000.0) -> DataFrame:
    """segs with `wet` and, for dry ones, the number of their run; a segment is wet if its midpoint is in water, a bridge never."""
    m = model(segs)
    mid = segs.filter("NOT bridge").select(*m, F.struct("line_id", "seq").alias("id"), ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
    wet = in_rings(mid, rings, cell_m).select(*m, "id.line_id", "id.seq", F.lit(True).alias("wet"))
    marked = segs.join(wet, [*m, "line_id", "seq"], "left").withColumn("wet", F.coalesce("wet", F.lit(False)))
    w = Window.partitionBy(*m, "line_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("run", F.when(~F.col("wet"), F.sum(F.col("wet").cast("int")).over(w)))


def ring_edges(rings: DataFrame) -> DataFrame:
    """key, ax, ay, bx, by: the edges of each ring (ring_id, ring, holes) and of those of its holes that lie in it."""
    within = F.filter("holes", lambda h: F.exists(h, lambda p: geo.ring_contains(F.col("ring"), p["x"], p["y"])))
    e = rings.select("ring_id", "ring", within.alias("holes"))
    e = e.select(F.col("ring_id").alias("key"), F.explode(F.concat(geo._cyclic(F.col("ring")), F.flatten(F.transform("holes", geo._cyclic)))).alias("e"))
    return e.select("key", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def row_spans(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """key, j, x_from, x_to: where each row (key, j, y) lies inside a ring, from its sorted crossings taken in pairs."""
    crossed = rows.join(edges, "key").filter((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y")))
    x = F.col("ax") + (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    w = Window.partitionBy("key", "j").orderBy("x")
    pairs = crossed.select("key", "j", x.alias("x")).withColumns({"n": F.row_number().over(w), "x_to": F.lead("x").over(w)})
    return pairs.filter("n % 2 = 1 AND x_to IS NOT NULL").select("key", "j", F.col("x").alias("x_from"), "x_to")


def inside_mask(spans: DataFrame, x0: float, step: float, cols: int) -> DataFrame:
    """key, i, j of the grid nodes in the spans, ends included."""
    lo = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("x_from") - x0) / step))
    hi = F.least(F.lit(cols - 1).cast("long"), F.floor((F.col("x_to") - x0) / step))
    return spans.withColumns({"lo": lo, "hi": hi}).filter("lo <= hi").select("key", "j", F.explode(F.sequence("lo", "hi")).alias("i")).distinct()


def band_strips(segs: DataFrame, half_width_m: float | Column, cell_m: float) -> DataFrame:
    """[model_id,] ax, ay, bx, by, band, j0, j1, i0, i1: the part of each segment's band in each tile of the grid.

    A strip has TILE x TILE nodes at most, however long the segment is and however wide its band. A segment that is there
    several times has its strips once: the least distance to it is the same.
    """
    m, c = model(segs), F.col
    s = segs.select(*m, "ax", "ay", "bx", "by", (F.lit(half_width_m) + 2 * cell_m).alias("band")).distinct()
    s = s.withColumns({"j0": F.floor((F.least("ay", "by") - c("band")) / cell_m), "j1": F.ceil((F.greatest("ay", "by") + c("band")) / cell_m)})
    tile = lambda v: F.floor(v / TILE)
    s = s.select("*", F.explode(F.sequence(tile(c("j0")), tile(c("j1")))).alias("tj"))
    # the piece of the segment that is within the band of the tiles of this row: t from t0 to t1
    low, high = c("tj") * (TILE * cell_m) - c("band"), (c("tj") * TILE + (TILE - 1)) * cell_m + c("band")
    p, q = (F.coalesce(F.try_divide(y - c("ay"), c("by") - c("ay")), F.lit(v)) for y, v in ((low, 0.0), (high, 1.0)))
    s = s.withColumns({"t0": F.greatest(F.lit(0.0), F.least(p, q)), "t1": F.least(F.lit(1.0), F.greatest(p, q))}).filter("t0 <= t1")
    s = s.withColumns({"x0": c("ax") + (c("bx") - c("ax")) * c("t0"), "x1": c("ax") + (c("bx") - c("ax")) * c("t1")})
    first, last = tile((F.least("x0", "x1") - c("band")) / cell_m), tile(F.ceil((F.greatest("x0", "x1") + c("band")) / cell_m))
    s = s.select("*", F.explode(F.sequence(first, last)).alias("ti"))
    ends = [F.greatest("j0", c("tj") * TILE).alias("j0"), F.least("j1", c("tj") * TILE + (TILE - 1)).alias("j1"), (c("ti") * TILE).alias("i0"), (c("ti") * TILE + (TILE - 1)).alias("i1")]
    return s.select(*m, "ax", "ay", "bx", "by", "band", *ends)


def distance_field(segs: DataFrame, half_width_m: float | Column, cell_m: float) -> DataFrame:
    """[model_id,] i, j, d: least distance of each grid node to a segment of its model, for nodes within the band; others are absent.

    Strips, of bounded work each, are dealt evenly over DEAL tasks for each shuffle partition before their nodes are
    made: in ranges of model and tile, so that the nodes of a place are nearly one row each before they are shuffled, and by a
    hash within a tile, so that a crowded one is shared too.
    """
    m, c = model(segs), F.col
    tasks = DEAL * int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    strips = band_strips(segs, half_width_m, cell_m)
    dx, dy = c("bx") - c("ax"), c("by") - c("ay")
    square = dx * dx + dy * dy
    # what is the same in all rows of a strip is worked out before they are made: the loop over nodes stays small enough to be compiled
    once = {"dx": dx, "dy": dy, "per_square": F.coalesce(F.try_divide(F.lit(1.0), square), F.lit(0.0)), "slope": F.try_divide(dx, dy), "reach": F.try_divide(c("band") * F.sqrt(square), F.abs(dy)),
            "low": F.least("ax", "bx") - c("band"), "high": F.greatest("ax", "bx") + c("band"), "most": c("band") * c("band")}
    dealt = strips.withColumns(once).drop("bx", "by", "band").repartitionByRange(tasks, *m, F.floor(c("j0") / TILE), "i0", F.xxhash64(*strips.columns))
    each = dealt.select("*", F.explode(F.sequence("j0", "j1")).alias("j")).withColumn("y", c("j") * cell_m - c("ay"))
    # in a row, only nodes within the band of the whole line, so that slanted segments don't fill their tiles
    middle = c("ax") + c("y") * c("slope")
    lo, hi = F.floor(F.greatest(c("low"), middle - c("reach")) / cell_m), F.ceil(F.least(c("high"), middle + c("reach")) / cell_m)
    each = each.select(*m, "j", "ax", "y", "dx", "dy", "per_square", "most", (c("y") * c("dy")).alias("along"), F.greatest("i0", lo).alias("lo"), F.least("i1", hi).alias("hi")).filter("lo <= hi")
    each = each.select(*m, "j", "ax", "y", "dx", "dy", "per_square", "most", "along", F.explode(F.sequence("lo", "hi")).alias("i")).withColumn("x", c("i") * cell_m - c("ax"))
    each = each.withColumn("t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c("x") * c("dx") + c("along")) * c("per_square"))))
    off_x, off_y = c("x") - c("t") * c("dx"), c("y") - c("t") * c("dy")
    near = each.select(*m, "i", "j", "most", (off_x * off_x + off_y * off_y).alias("d2")).filter(c("d2") <= c("most"))
    return near.groupBy(*m, "i", "j").agg(F.sqrt(F.min("d2")).alias("d"))


def within(field: DataFrame, spans: DataFrame, cell_m: float) -> DataFrame:
    """The nodes of a field that lie in the spans ([model_id,] j, x_from, x_to) of a selection, one row each.

    Spans are cut to blocks of TILE columns: the join is one on (row, block), with the ends tested only inside a block.
    """
    m = model(spans)
    block = lambda x: F.floor(x / (cell_m * TILE))
    s = spans.filter("x_from <= x_to").select(*(F.col(k).alias(f"s_{k}") for k in [*m, "j"]), "x_from", "x_to", F.explode(F.sequence(block(F.col("x_from")), block(F.col("x_to")))).alias("s_block"))
    x = F.col("i") * cell_m
    on = (block(x) == F.col("s_block")) & (x >= F.col("x_from")) & (x <= F.col("x_to"))
    for k in [*m, "j"]:
        on = on & (F.col(k) == F.col(f"s_{k}"))
    return field.join(s, on, "left_semi")


def contour(field: DataFrame, iso: float, cell_m: float) -> DataFrame:
    """[model_id,] i, j, x0, y0, x1, y1: boundary segments of {d < iso}, the inside on their left.

    Around a cell, counter-clockwise, the boundary starts where the walk leaves the inside and ends
    where it enters it again. With two of each, the cell's mean decides: inside, a start goes to the
    next end of the walk; outside, to the one before.
    """
    m = model(field)
    corners = F.array(*(F.struct(F.lit(-dx).alias("dx"), F.lit(-dy).alias("dy"), F.lit(k).alias("k")) for k, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))))
    each = field.select(*m, "i", "j", "d", F.explode(corners).alias("c")).select(*m, (F.col("i") + F.col("c.dx")).alias("i"), (F.col("j") + F.col("c.dy")).alias("j"), F.col("c.k").alias("k"), "d")
    far = F.lit(float("inf"))
    at = lambda n: F.coalesce(F.max(F.when(F.col("k") == n, F.col("d"))), far)
    cells = each.groupBy(*m, "i", "j").agg(F.array(*(at(n) for n in range(4))).alias("v"))
    v = lambda k: F.element_at("v", (k % 4 + 1).cast("int"))
    ks = F.sequence(F.lit(0), F.lit(3))
    starts = F.filter(ks, lambda k: (v(k) < iso) & (v(k + 1) >= iso))
    ends = F.filter(ks, lambda k: (v(k) >= iso) & (v(k + 1) < iso))
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / 4
    s = cells.select(*m, "i", "j", "v", starts.alias("starts"), ends.alias("ends"), (mean < iso).alias("middle")).filter("size(starts) > 0")
    s = s.select(*m, "i", "j", "v", "ends", "middle", F.explode("starts").alias("a"))
    turn = lambda e: F.when(F.col("middle"), (e - F.col("a") + 4) % 4).otherwise((F.col("a") - e + 4) % 4)
    s = s.withColumn("b", F.array_min(F.transform("ends", lambda e: F.struct(turn(e).alias("turn"), e.alias("e"))))["e"])

    def place(k: Column) -> tuple[Column, Column]:
        """Where the boundary crosses edge k, from corner k to corner k + 1."""
        p, q = v(k), v(k + 1)
        t = F.when((p == far) & (q == far), 0.5).when(p == far, 0.0).when(q == far, 1.0).otherwise(geo.clamp(F.try_divide(F.lit(iso) - p, q - p), 0.0, 1.0))
        x = F.when(k == 0, t).when(k == 1, 1.0).when(k == 2, 1.0 - t).otherwise(0.0)
        y = F.when(k == 0, 0.0).when(k == 1, t).when(k == 2, 1.0).otherwise(1.0 - t)
        return (F.col("i") + x) * cell_m, (F.col("j") + y) * cell_m

    (x0, y0), (x1, y1) = place(F.col("a")), place(F.col("b"))
    return s.select(*m, "i", "j", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def within_budget(groups: DataFrame, budget: int) -> DataFrame:
    """groups (rank, grp, points) with `taken`: in each model's order, until the estimate of a group exceeds what is left."""
    w = Window.partitionBy(*model(groups)).orderBy("rank", "grp").rowsBetween(Window.unboundedPreceding, 0)
    return groups.withColumn("taken", F.sum(F.col("points") * TRIANGLES_PER_POINT).over(w) <= budget)
