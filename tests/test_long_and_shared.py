"""Operators whose work is cut to pieces: against the same work in one piece, or a plain loop."""

import math
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from reliefloom.functions import geo
from reliefloom.operators import lines, mesh, osm, raster, rings, rules, runs, tracks
from reliefloom.sources import stl

RING = "ring long, seq long, x double, y double"


def walk(seed, n):
    """A wobbly ring with crowded and straight stretches."""
    rng = np.random.default_rng(seed)
    a = np.sort(rng.uniform(0, 2 * math.pi, n))
    a[n // 3 : n // 2] = np.linspace(a[n // 3], a[n // 2], n // 2 - n // 3)
    r = 100 + rng.normal(0, 0.4, n) * (np.arange(n) % 7 == 0)
    return [(float(x), float(y)) for x, y in zip(r * np.cos(a), r * np.sin(a))]


def plain_apart(points, least, fewest):
    kept = [points[0]]
    for p in points[1:]:
        if math.dist(p, kept[-1]) >= least:
            kept.append(p)
    while len(kept) > fewest and math.dist(kept[0], kept[-1]) < least:
        kept.pop()
    return kept


def plain_cleaned(points, cell):
    kept, out = plain_apart(points, cell * 0.25, 2), []
    if len(kept) < 3:
        return []
    for n, p in enumerate(kept):
        a, b = out[-1] if out else kept[-1], kept[(n + 1) % len(kept)]
        d = (b[0] - a[0], b[1] - a[1])
        square = d[0] ** 2 + d[1] ** 2
        t = min(1.0, max(0.0, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / square)) if square else 0.0
        if math.dist(p, (a[0] + t * d[0], a[1] + t * d[1])) >= cell * 0.05:
            out.append(p)
    return out if len(out) >= 3 else kept


def plain_coarsened(points, least):
    kept = plain_apart(points, least, 3) if len(points) > 3 else points
    return kept if len(kept) >= 3 else points


def by_ring(df):
    out = {}
    for r in df.orderBy("ring", "seq").collect():
        out.setdefault(r.ring, []).append((r.x, r.y))
    return out


@pytest.mark.parametrize("run", [10_000, 37])
def test_rings_are_cleaned_in_runs_as_in_one_piece(spark, monkeypatch, run):
    monkeypatch.setattr(rings, "RUN", run)
    shapes = {1: walk(1, 400), 2: walk(2, 90), 3: [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0)], 4: [(0.0, 0.0), (0.1, 0.0), (0.0, 0.1), (0.05, 0.05)], 5: [(float(i), 0.0) for i in range(50)], 6: [(0.0, 0.0), (5.0, 0.0)]}
    df = spark.createDataFrame([(k, n, *p) for k, ps in shapes.items() for n, p in enumerate(ps)], RING).repartition(3)
    clean = by_ring(rings.cleaned(df, 6.0))
    assert clean == {k: c for k, ps in shapes.items() if (c := plain_cleaned(ps, 6.0))}
    assert set(clean) == {1, 2, 3, 5} and len(clean[1]) < 100
    assert [r.seq for r in rings.cleaned(df, 6.0).filter("ring = 1").orderBy("seq").collect()] == list(range(len(clean[1])))
    assert by_ring(rings.coarsened(df, 8.0)) == {k: plain_coarsened(ps, 8.0) for k, ps in shapes.items()}


def test_a_very_long_ring_is_dealt_over_many_tasks(spark):
    n = 120_000
    a = F.col("id") / n * 2 * math.pi
    r = F.lit(1e5) + F.sin(a * 997) * 300
    ring = spark.range(n).select(F.lit(1).cast("long").alias("ring"), F.col("id").alias("seq"), (F.cos(a) * r).alias("x"), (F.sin(a) * r).alias("y"))
    points = [(x.x, x.y) for x in ring.orderBy("seq").collect()]
    assert by_ring(rings.cleaned(ring, 30.0)) == {1: plain_cleaned(points, 30.0)}


def test_runs_number_rows_and_keep_null_keys_together(spark):
    df = spark.createDataFrame([(k, n * 3 + 100) for k in (1, 2, None) for n in range(50 if k == 1 else 8)], "k long, seq long").repartition(4)
    short, long = runs.by_length(df, ["k"], "seq", 10)
    assert {r.k for r in short.collect()} == {2, None} and short.count() == 16
    got = sorted((r.seq, r["_i"], r["_run"]) for r in long.collect())
    assert got == [(n * 3 + 100, n, n // 10) for n in range(50)]
    assert runs.by_length(df, ["k"], "seq", 50)[1] is None


def test_a_band_is_cut_into_strips_of_bounded_work(spark):
    rng = np.random.default_rng(4)
    segs = [tuple(map(float, rng.uniform(-3000, 3000, 4))) for _ in range(25)] + [(0.0, 0.0, 0.0, 0.0), (-4000.0, 10.0, 4000.0, 10.0), (5.0, -4000.0, 5.0, 4000.0), (0.0, 0.0, 1e5, 1e5)]
    df = spark.createDataFrame(segs, "ax double, ay double, bx double, by double")
    strips = lines.band_strips(df, 60.0, 20.0)
    size = (F.col("j1") - F.col("j0") + 1) * (F.col("i1") - F.col("i0") + 1)
    assert strips.agg(F.max(size)).first()[0] <= lines.TILE**2
    assert strips.filter("bx = 1e5").count() < 4 * 1e5 / (lines.TILE * 20)  # a few for each row of tiles: a long slanted line does not fill its box of 6000
    near = spark.createDataFrame(segs[:-1], df.schema)
    got = {(r.i, r.j): r.d for r in lines.distance_field(near, 60.0, 20.0).collect()}
    i, j = np.meshgrid(np.arange(-210, 211), np.arange(-210, 211), indexing="ij")
    x, y, least = i * 20.0, j * 20.0, np.full(i.shape, np.inf)
    for ax, ay, bx, by in segs[:-1]:
        square = (bx - ax) ** 2 + (by - ay) ** 2
        t = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / square, 0, 1) if square else 0.0
        least = np.minimum(least, np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
    want = {(int(i[k]), int(j[k])): least[k] for k in zip(*np.nonzero(least < 99.999))}
    assert want.keys() <= got.keys() and all(abs(got[k] - d) < 1e-6 for k, d in want.items()) and all(least[a + 210, b + 210] < 100.001 for a, b in got)


def test_nodes_are_dealt_evenly(spark):
    """No task of the field makes more than its share, though all segments lie in one place."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([tuple(map(float, rng.uniform(0, 4000, 4))) for _ in range(4000)], "ax double, ay double, bx double, by double").coalesce(1)
    tasks = lines.DEAL * int(spark.conf.get("spark.sql.shuffle.partitions"))
    strips = lines.band_strips(df, 20.0, 20.0)
    size = (F.col("j1") - F.col("j0") + 1) * (F.col("i1") - F.col("i0") + 1)
    work = [r["w"] for r in strips.repartition(tasks, F.xxhash64(*strips.columns)).groupBy(F.spark_partition_id()).agg(F.sum(size).alias("w")).collect()]
    assert max(work) <= sum(work) / (4 * tasks / lines.DEAL)


def test_spans_of_many_blocks(spark):
    field = spark.createDataFrame([(i, j, 1.0) for i in range(-300, 300, 7) for j in (0, 1)], "i long, j long, d double")
    spans = spark.createDataFrame([(0, -2500.0, 3000.0), (0, 2900.0, 3100.0), (1, 5.0, 4.0), (1, 70.0, 70.0)], "j long, x_from double, x_to double")
    got = sorted((r.i, r.j) for r in lines.within(field, spans, 10.0).collect())
    assert got == sorted([(i, 0) for i in range(-300, 300, 7) if -2500 <= i * 10 <= 3100] + [(7, 1)] * (7 in range(-300, 300, 7)))
    assert "BroadcastNestedLoopJoin" not in lines.within(field, spans, 10.0)._jdf.queryExecution().toString()


def test_rims_part_at_pinched_vertices(spark):
    """Two squares that touch in a corner, and a square with a square hole that touches its rim."""
    at = {0: (0, 0), 1: (1, 0), 2: (1, 1), 3: (0, 1), 4: (2, 1), 5: (2, 2), 6: (1, 2)}
    squares = [(0, 1), (1, 2), (2, 3), (3, 0), (2, 4), (4, 5), (5, 6), (6, 2)]
    holed = {10: (0, 0), 11: (4, 0), 12: (4, 4), 13: (0, 4), 14: (2, 1), 15: (1, 2)}
    hole = [(10, 11), (11, 12), (12, 13), (13, 10), (10, 15), (15, 14), (14, 10)]
    edges = spark.createDataFrame([(0, *e) for e in squares] + [(1, *e) for e in hole], "model_id int, u long, v long")
    vertices = spark.createDataFrame([(m, k, float(x), float(y)) for m, vs in ((0, at), (1, holed)) for k, (x, y) in vs.items()], "model_id int, vid long, x double, y double")
    got = {}
    for r in rings.boundary_rings(edges, vertices).orderBy("seq").collect():
        got.setdefault((r.model_id, tuple(r.ring)), []).append(r.vid)
    assert sorted(v for (m, _), v in got.items() if m == 0) == [[0, 1, 2, 3], [2, 4, 5, 6]]
    assert [v for (m, _), v in got.items() if m == 1] == [[10, 11, 12, 13, 10, 15, 14]]  # one piece, so one rim, which meets itself


def plain_stl(header, corners):
    body = b""
    for p in corners:
        a, b, c = (np.array(x, np.float32).astype(float) for x in p)
        n = np.cross(b - a, c - a)
        length = math.sqrt(float((n * n).sum()))
        n = n / length if length > 0 else np.zeros(3)
        body += struct.pack("<12fH", *n, *a, *b, *c, 0)
    return header.encode()[:80].ljust(80, b"\0") + struct.pack("<I", len(corners)) + body


def test_stl_files_equal_a_plain_writer(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stl, "RUN", 7)
    rng = np.random.default_rng(6)
    models = {"a": 40, "b": 1, "c": 23}
    v = [(m, k, *map(float, rng.integers(0, 9, 3))) for m in models for k in range(12)]
    t = [(m, int(tid), *map(int, rng.integers(0, 12, 3))) for m, n in models.items() for tid in rng.choice(10**12, n, replace=False)]
    triangles = spark.createDataFrame(t, "model_id string, tid long, a long, b long, c long").repartition(5)
    vertices = spark.createDataFrame(v, "model_id string, vid long, x float, y float, z float")
    names = spark.createDataFrame([("a", "one.stl"), ("b", "two.stl"), ("c", "three.stl"), ("d", "none.stl")], "model_id string, file string")
    folder = str(tmp_path / "out")
    stl.write_files(triangles, vertices, names, folder, "Relief model")
    place = {(m, k): p for m, k, *p in v}
    assert sorted(os.listdir(folder)) == ["one.stl", "three.stl", "two.stl"]
    for m, file in (("a", "one.stl"), ("b", "two.stl"), ("c", "three.stl")):
        want = plain_stl("Relief model", [[place[m, x] for x in abc] for _, _, *abc in sorted(r for r in t if r[0] == m)])
        with open(os.path.join(folder, file), "rb") as f:
            assert f.read() == want
    back = spark.read.format("binaryFile").load(folder).select(stl.triangle_count(F.col("content")).alias("n"))
    assert sorted(r.n for r in back.collect()) == [1, 23, 40]
    chunks = stl.chunks(stl.facets(triangles, vertices), "Relief model", 7).filter("model_id = 'a'").orderBy("chunk").collect()
    with open(os.path.join(folder, "one.stl"), "rb") as f:
        assert b"".join(bytes(c.bytes) for c in chunks) == f.read()


def test_stl_files_need_all_records(tmp_path):
    w = stl.StlWriter(str(tmp_path), "x")
    with pytest.raises(ValueError, match="missing"):
        w.commit([stl.Written({"a.stl": (3, 5)}), stl.Written({"a.stl": (1, 5)}), None])
    w.abort([])
    assert os.listdir(tmp_path) == []
    with pytest.raises(ValueError, match="mounted"):
        stl.StlWriter("s3a://bucket/x", "x")


def test_mosaic_of_lacking_and_broken_tiles(spark):
    size = 4
    raw = bytes(v for k in range(16) for v in (128, k, 64))
    tiles = spark.createDataFrame([(3, 1, 1, raw), (3, 2, 1, raw[:-1])], "z int, x long, y long, rgb binary")
    needed = spark.createDataFrame([("m", 3, x, 1) for x in (1, 2, 3)] + [("n", 3, 1, 1)], "model_id string, z int, x long, y long")
    got = {(r.model_id, r.px, r.py): r.v for r in raster.mosaic(needed, tiles, size).collect()}
    assert len(got) == 4 * size * size
    for k in range(16):
        at = (4 + k % 4, 4 + k // 4)
        assert got["m", *at] == got["n", *at] == k + 0.25
        assert got["m", at[0] + 4, at[1]] is None and got["m", at[0] + 8, at[1]] is None
    black = spark.createDataFrame([(3, 1, 1, bytes(48))], tiles.schema)
    assert {r.v for r in raster.mosaic(needed.limit(1), black, size).collect()} == {None}


def test_relations_of_fragments_in_any_order(spark):
    """Closed chains in both directions, one that stays open, a ring of one member, and a point met four times."""
    frag = lambda rel, o, role, *ps: [(rel, o, role, s, float(x), float(y)) for s, (x, y) in enumerate(ps)]
    rows = [
        *frag(1, 0, "outer", (5, 0), (0, 0)), *frag(1, 1, "", (5, 5), (5, 0)), *frag(1, 2, "outer", (5, 5), (0, 5), (0, 0)), *frag(1, 3, "inner", (1, 1), (2, 1), (2, 2), (1, 1)), *frag(1, 4, "label", (9, 9), (8, 8)),
        *frag(2, 3, "outer", (2, 0), (3, 0)), *frag(2, 1, "outer", (1, 0), (2, 0)), *frag(2, 2, "outer", (1, 0), (0, 0)), *frag(2, 4, "outer", (7, 7), (8, 8)), *frag(2, 5, "outer", (float("nan"), 0), (1, 1)),
        *frag(3, 0, "outer", (0, 0), (1, 0), (1, 1), (0, 0)), *frag(3, 1, "outer", (0, 0), (-1, 0), (-1, -1)), *frag(3, 2, "outer", (-1, -1), (0, 0)),
    ]
    df = spark.createDataFrame(rows, "rel_id long, ord int, role string, seq int, x double, y double").repartition(3)
    got = {}
    for r in osm.assembled_rings(df).orderBy("seq").collect():
        got.setdefault((r.rel_id, r.role, r.ring), []).append((r.x, r.y))
    assert got == {
        (1, "outer", 0): [(5, 0), (0, 0), (0, 5), (5, 5)], (1, "inner", 0): [(1, 1), (2, 1), (2, 2)], (2, "outer", 0): [(0, 0), (1, 0), (2, 0), (3, 0)],
        (3, "outer", 0): [(0, 0), (1, 0), (1, 1)], (3, "outer", 1): [(0, 0), (-1, 0), (-1, -1)],
    }


def test_a_ring_of_many_members(spark):
    n = 3000
    rng = np.random.default_rng(8)
    at = lambda k: (math.cos(k / n * 2 * math.pi), math.sin(k / n * 2 * math.pi))
    order = rng.permutation(n)
    rows = [(1, int(order[k]), "outer", s, *at(j)) for k in range(n) for s, j in enumerate(((k + 1) % n, k) if k % 3 else (k, (k + 1) % n))]
    out = osm.assembled_rings(spark.createDataFrame(rows, "rel_id long, ord int, role string, seq int, x double, y double"))
    assert out.count() == n and out.select("ring").distinct().count() == 1


@pytest.mark.parametrize("wide", [1 << 20, 5])
def test_fans_around_small_and_wide_vertices(spark, monkeypatch, wide):
    """Against union-find; with WIDE = 5 most vertices go through rounds over all tasks."""
    monkeypatch.setattr(mesh, "WIDE", wide)
    rng = np.random.default_rng(9)
    t = [(m, k, *map(int, rng.choice(40, 3, replace=False))) for m in (0, 1) for k in range(150)]
    got = {}
    for r in mesh.fans(spark.createDataFrame(t, "model_id int, tid long, a long, b long, c long").repartition(3)).collect():
        got[r.model_id, r.tid, r.n] = (r.v, r.fan)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for m, _, *abc in t:
        for n in range(3):
            v, p, q = abc[n], abc[(n + 1) % 3], abc[(n + 2) % 3]
            a, b = find((m, v, p)), find((m, v, q))
            root[max(a, b)] = min(a, b)
    assert got == {(m, tid, n): (abc[n], find((m, abc[n], abc[(n + 1) % 3]))[2]) for m, tid, *abc in t for n in range(3)}


def test_a_vertex_of_a_hundred_thousand_triangles(spark):
    n = 100_000
    hub = spark.range(n).select(F.lit(0).alias("model_id"), F.col("id").alias("tid"), F.lit(-1).cast("long").alias("a"), F.col("id").alias("b"), ((F.col("id") + 1) % (n // 2) + F.floor(F.col("id") / (n // 2)) * (n // 2)).alias("c"))
    at = mesh.fans(hub).filter("v = -1").groupBy("fan").count().collect()
    assert sorted((r.fan, r["count"]) for r in at) == [(0, n // 2), (n // 2, n // 2)]


def test_failed_parts_block_their_model(spark):
    t, v = (df.withColumn("model_id", F.lit("whole")) for df in cube(spark))
    parts = spark.createDataFrame([("ok", "terrain", "whole"), ("ok", "roads", "whole"), ("bad", "terrain", "whole"), ("bad", "roads", "open"), ("flat", "terrain", "open")], "model string, part string, shape string")
    both_t = t.unionByName(t.filter("tid > 0").withColumn("model_id", F.lit("open")))
    both_v = v.unionByName(v.withColumn("model_id", F.lit("open")))
    shaped = lambda df: parts.join(df.withColumnRenamed("model_id", "shape"), "shape").drop("shape")
    warnings = rules.part_warnings(shaped(both_t), shaped(both_v), merged=["roads"])
    assert sorted((r.model, r.part, r.level, r.code) for r in warnings.collect()) == [("bad", "roads", "fail", "part-not-manifold"), ("flat", "terrain", "fail", "not-manifold")]


def cube(spark):
    from .test_operators import cube as made

    return made(spark)


def test_a_key_that_keeps_nearly_nothing_takes_few_rounds(spark, monkeypatch):
    """Rows 0 and 200 are kept, whatever the runs start from; each other row hands its state on."""
    df = spark.createDataFrame([(k, n) for k in (1, 2) for n in range(400)], "k long, seq long").repartition(4)
    long = runs.by_length(df, ["k"], "seq", 10)[1]
    rounds = []
    monkeypatch.setattr(runs, "cut", lambda d, own=runs.cut: rounds.append(1) or own(d))

    def end(pdf, last):
        for n in pdf["seq"]:
            if last is None or n in (0, 200):
                last = (float(n),)
        return last

    def rows(pdf, last):
        return pdf.assign(start=-1.0 if last is None else last[0])[["k", "seq", "start"]]

    got = runs.folded(long, ["k"], "at double", end, rows, "k long, seq long, start double").collect()
    assert {(r.k, r.seq): r.start for r in got} == {(k, n): -1.0 if n < 10 else 0.0 if n < 210 else 200.0 for k in (1, 2) for n in range(400)}
    assert len(rounds) <= 9  # 40 runs: the first starts, then two tables for each round


def test_a_long_route_that_never_moves(spark):
    n = 190_000
    points = spark.range(n).select(F.lit(1).cast("long").alias("route_id"), F.col("id").alias("seq"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"), F.lit(None).cast("double").alias("ele"), F.col("id").alias("t_ms"))
    assert [tuple(r) for r in tracks.denoised(points, geo.point_origin(F.lit(1.0), F.lit(2.0))).collect()] == [(1, 1, n - 1, 0)]


def test_many_short_keys_are_folded_together(spark, monkeypatch):
    """Against the plain folds, however the keys lie over batches."""
    monkeypatch.setattr(runs, "MANY", 50)
    shape = {k: walk(k, 3 + 7 * k) for k in range(20)}
    df = spark.createDataFrame([(k, n, x, y) for k, ps in shape.items() for n, (x, y) in enumerate(ps)], RING).repartition(3)
    got = by_ring(rings.cleaned(df, 8.0))
    assert got == {k: out for k, ps in shape.items() if (out := plain_cleaned(ps, 8.0))}
    lines_ = df.withColumnRenamed("ring", "line_id")
    simple = tracks.simplified(lines_, 0.3)
    for made in (simple, tracks.max_deviation(lines_, simple)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "FlatMap" not in plan  # not a call of Python for each key
    want = {}
    for k, ps in shape.items():
        x, y = np.array(ps).T
        keep = tracks._kept(x, y, 0.3)
        want[k] = (int(keep.sum()), tracks._walked(x, y, x[keep], y[keep], 0, True)[2])
    n = {r.line_id: r["count"] for r in simple.groupBy("line_id").count().collect()}
    assert {r.line_id: (n[r.line_id], r.deviation) for r in tracks.max_deviation(lines_, simple).collect()} == want


def test_batches_hold_whole_keys(monkeypatch):
    for size in (np.array([3, 0, 5, 1]), np.array([], int)):
        first = np.cumsum(size) - size
        seen = [(int(w), int(r)) for who, rows in runs.in_step(first, size) for w, r in zip(who, rows)]
        assert sorted(seen) == [(k, int(first[k]) + n) for k in range(len(size)) for n in range(size[k])]


def test_a_segment_that_is_there_again_has_its_strips_once(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0, 300.0, 40.0)] * 50 + [(2, 0.0, 0.0, 300.0, 40.0)], "model_id long, ax double, ay double, bx double, by double")
    strips = lines.band_strips(s, 10.0, 10.0).groupBy("model_id").count().collect()
    assert len({r["count"] for r in strips}) == 1 and len(strips) == 2
    field = lines.distance_field(s, 10.0, 10.0)
    assert [r.n for r in field.groupBy("model_id").agg(F.count("*").alias("n"), F.round(F.sum("d"), 6).alias("d")).groupBy("n", "d").count().select(F.col("count").alias("n")).collect()] == [2]


def test_a_solid_of_many_parts_is_judged_once(spark, monkeypatch):
    t, v = (df.withColumn("model_id", F.lit("whole")) for df in cube(spark))
    t = t.unionByName(t.filter("tid > 0").withColumn("model_id", F.lit("open")))
    v = v.unionByName(v.withColumn("model_id", F.lit("open")))
    rows = [("ok", "terrain", "whole"), ("ok", "roads", "whole"), ("bad", "terrain", "whole"), ("bad", "roads", "open"), ("flat", "terrain", "open")] + [(f"m{n}", "terrain", "open") for n in range(30)]
    parts = spark.createDataFrame(rows, "model string, part string, solid string")
    judged = []
    for name in ("repaired", "audit"):
        monkeypatch.setattr(mesh, name, lambda t, v, own=getattr(mesh, name): judged.append(t.count()) or own(t, v))
    got = sorted((r.model, r.part, r.level, r.code) for r in rules.shared_part_warnings(parts, t, v, merged=["roads"]).collect())
    assert judged == [23, 23]  # 12 triangles and 11, once after repair and once as they are
    assert got == sorted([("bad", "roads", "fail", "part-not-manifold"), ("flat", "terrain", "fail", "not-manifold")] + [(f"m{n}", "terrain", "fail", "not-manifold") for n in range(30)])


def test_repair_counts_every_shape_of_doubled_numbers(spark):
    """Vertex numbers that are there twice: the audits of one pass against a join of each."""
    t, v = cube(spark)
    v = v.unionByName(v.filter("vid < 3").withColumns({"x": F.col("x") + 5, "z": F.col("z") * 2}))
    t = t.unionByName(t.filter("tid = 0").select("model_id", (F.col("tid") + 100).alias("tid"), "a", F.col("a").alias("b"), "c"))
    wt, wv = mesh.welded(t, v)
    audits = {r["model_id"]: r.asDict() for r in mesh.audit(wt, wv).collect()}, {r["model_id"]: r.asDict() for r in mesh.audit(mesh.without_degenerates(wt, wv), wv).collect()}
    bad = lambda a: a["open_edges"] + a["non_manifold"]
    for r in mesh.repaired(t, v).collect():
        w, c = (a[r.model_id] for a in audits)
        use = bad(w) > 0 and bad(c) < bad(w)
        got, want = r.asDict(), {"cleaned": use, **(c if use else w)}
        assert math.isclose(got.pop("volume_mm3"), want.pop("volume_mm3"), rel_tol=1e-9, abs_tol=1e-9) and got == want
