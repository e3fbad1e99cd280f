"""Meshes looked up a block of vertices at a time: the same as by joins, wherever blocks end."""

import random

import pytest
from pyspark.sql import functions as F

from reliefloom.operators import blocks, lines, mesh, raster, runs, surface
from reliefloom.plans import meshes, parts
from reliefloom.sources import stl


def tangle(spark, seed=3):
    """Two models of random triangles, some of them several times, over vertices of which some are there twice or not at all, some at one place."""
    r = random.Random(seed)
    spots = [(x / 4, y / 2, z / 8) for x in range(3) for y in range(3) for z in range(3)]
    v = [(m, n, *r.choice(spots)) for m in (0, 1) for n in range(40) if n % 13 != 5] + [(m, n, *r.choice(spots)) for m in (0, 1) for n in range(0, 40, 7)]
    t = [(m, k, *(r.randrange(40) for _ in "abc")) for m in (0, 1) for k in range(120)] + [(1, k, 2 * k, 2 * k + 1, 2 * k + 2) for k in range(10)] * 3 + [(m, 500 + k, k, k + 1, (k + 2) % 40) for m in (0, 1) for k in range(39)]
    made = spark.createDataFrame(t, "model_id int, tid long, a long, b long, c long"), spark.createDataFrame(v, "model_id int, vid long, x float, y float, z float")
    return tuple(df.withColumn("model_id", F.concat(F.lit("m"), "model_id")) if seed % 2 else df.withColumn("model_id", F.struct("model_id", F.lit("p").alias("part"))) for df in made)


def by_joins(t, v):
    solid = mesh.with_corners(t, v).groupBy("model_id").agg(F.count("*").alias("triangles"), F.count_if(mesh.degenerate()).alias("degenerate"), F.round(F.abs(mesh.volume()), 9).alias("volume"))
    return sorted(map(tuple, mesh.edge_faults(t).join(solid, "model_id").select("model_id", "triangles", "open_edges", "non_manifold", "degenerate", "volume").collect()))


def blocked(a):
    return sorted(map(tuple, a.select("model_id", "triangles", "open_edges", "non_manifold", "degenerate", F.round("volume_mm3", 9)).collect()))


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize("block", [blocks.in_a_row, lambda v: F.shiftright(v, 3), lambda v: v % 5, lambda v: v])
def test_blocks_see_what_joins_see(spark, block, seed, monkeypatch):
    monkeypatch.setattr(blocks, "MANY", 50)
    monkeypatch.setattr(blocks, "SHAPES", 10)
    t, v = tangle(spark, seed)
    assert blocked(mesh.audit(t, v, block)) == by_joins(t, v)
    now = mesh._first_at(v, 1e-5)
    want = t
    for c in "abc":
        want = want.join(now.select("model_id", F.col("vid").alias(c), F.col("to").alias(f"_{c}")), ["model_id", c])
    want = want.select("model_id", "tid", *(F.col(f"_{c}").alias(c) for c in "abc"))
    assert sorted(map(tuple, blocks.renumbered(t, now, block).collect())) == sorted(map(tuple, want.collect()))
    # what is left without the triangles that have no area
    names = ["model_id", "c_shapes", "c_open", "c_many", "c_flat", "v"]
    got = blocks.measured(t, v, mesh.DEGENERATE_MM4, block, cleaned=True).withColumn("v", F.round(F.abs("c_v"), 9)).select(*names)
    assert sorted(map(tuple, got.collect())) == by_joins(mesh.without_degenerates(t, v), v)


def shuffled_rows(spark, df):
    """Exchanges in the plan that Spark starts with."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_triangles_are_dealt_once_for_an_audit(spark, sf):
    made = shuffled_rows(spark, meshes.e13_mesh_audit(spark, sf))
    assert "SortMergeJoin [model_id" not in made  # three joins of the triangles, and their edges dealt again


def test_repaired_solids_are_not_kept(spark, sf, monkeypatch):
    kept = []
    for module in (mesh, meshes):
        monkeypatch.setattr(module, "cut", lambda df, own=module.cut: kept.append(df.columns) or own(df))
    assert meshes.k06_part_rules(spark, sf).count() == 7 and meshes.i12_repair(spark, sf).count() == 4 and meshes.i10_weld(spark, sf).count() == 4
    assert kept == []  # the triangles were, four times


@pytest.mark.parametrize("block", [blocks.in_a_row, lambda v: F.shiftright(v, 3), lambda v: v % 5])
def test_a_triangle_has_its_corners_once(spark, block, monkeypatch):
    monkeypatch.setattr(blocks, "MANY", 50)
    t, v = tangle(spark)
    got = sorted(map(tuple, blocks.cornered(t, v, block).collect()))
    one = v.groupBy("model_id", "vid").agg(F.min(F.struct("x", "y", "z")).alias("p")).select("model_id", "vid", "p.*")
    want = mesh.with_corners(t, one).select("model_id", "tid", *(f"{c}{k}" for c in "abc" for k in "xyz"))
    assert got == sorted(map(tuple, want.collect())) and len(got) < mesh.with_corners(t, v).count()


def test_files_have_a_record_for_each_triangle(spark, tmp_path):
    """Numbers that several vertices have gave a triangle a record for each choice."""
    t = spark.createDataFrame([("a", 5, 0, 1, 2), ("a", 9, 1, 3, 2)], "model_id string, tid long, a long, b long, c long")
    v = spark.createDataFrame([("a", 0, 0.0, 0.0, 0.0), ("a", 1, 1.0, 0.0, 0.0), ("a", 2, 0.0, 1.0, 0.0), ("a", 3, 1.0, 1.0, 0.0), ("a", 3, 4.0, 4.0, 0.0)], "model_id string, vid long, x float, y float, z float")
    stl.write_files(t, v, spark.createDataFrame([("a", "a.stl")], "model_id string, file string"), str(tmp_path), "x")
    data = (tmp_path / "a.stl").read_bytes()
    assert len(data) == 84 + 2 * 50 and int.from_bytes(data[80:84], "little") == 2


def test_numbered_rows_are_kept_once_and_small(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(runs, "cut", lambda df: kept.append(df) or df.checkpoint())
    rows = spark.range(5000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 5003).alias("o"))
    got = runs.in_runs(rows, ["k"], "o", 100).collect()
    want = {k: sorted(n * 7919 % 5003 for n in range(k, 5000, 3)) for k in range(3)}
    assert kept == [] and len(got) == 5000 and all(want[r.k][r._i] == r.o and r._run == r._i // 100 for r in got)  # twice, as checkpoints


def test_parts_are_renumbered_in_one_shuffle(spark, sf):
    made = shuffled_rows(spark, parts.g05_united_parts(spark, sf))
    assert made.count("SortMergeJoin [model_id") <= 1  # the query's own, for x; there were three more of the triangles


@pytest.mark.parametrize("block", [blocks.in_a_row, lambda v: F.shiftright(v, 3), lambda v: v % 5])
def test_boundaries_are_those_of_all_edges(spark, block, monkeypatch):
    monkeypatch.setattr(blocks, "MANY", 50)
    t, _ = tangle(spark)
    t = t.filter("a <> b AND b <> c AND a <> c")
    assert sorted(map(tuple, blocks.boundary(t, block).collect())) == sorted(map(tuple, mesh.boundary(t).collect()))


def test_a_point_between_pixels_is_one_row(spark):
    pixels = spark.createDataFrame([(x, y, None if (x, y) == (1, 1) else float(x + 10 * y)) for x in range(3) for y in range(3) if (x, y) != (2, 0)], "px long, py long, v float")
    points = spark.createDataFrame([(0, 0.25, 0.0), (1, -3.0, 9.0), (2, 1.5, 0.0), (3, 0.5, 0.5), (4, 2.0, 2.0), (5, 2.0, 0.0)], "id long, x double, y double")
    got = raster.bilinear(points, pixels, F.lit(3), F.lit(3))
    assert "Exchange" in shuffled_rows(spark, got) and "dx" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[1].split("Aggregate")[0]  # it was four
    assert {r.id: r.v for r in got.collect()} == {0: 0.25, 1: 20.0, 2: 0.5, 3: 2.75, 4: 22.0, 5: 0.0}


def test_nodes_of_a_place_are_made_together(spark):
    s = spark.createDataFrame([(m, 0.0, 10.0 * k, 900.0, 7.0 * k) for m in range(6) for k in range(40)], "model_id long, ax double, ay double, bx double, by double")
    made = lines.distance_field(s, 50.0, 20.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [model_id" in made  # by a hash of the strip: each task had nodes of all places


def test_a_tile_of_a_solid_is_one_block(spark):
    at = lambda i, j, n: surface.tile_of(surface.vertex_id(surface.UP, F.lit(i), F.lit(j)) * 2 + n)
    spots = [(0, 0, 0), (63, 63, 1), (0, 64, 0), (64, 0, 0), (-1, 0, 1), (-64, 5, 0)]
    got = spark.range(1).select(*(at(*s).alias(str(k)) for k, s in enumerate(spots))).first()
    assert got[0] == got[1] and got[4] == got[5] and len(set(got)) == 4


def test_sides_are_numbered_without_their_corners(spark, sf, monkeypatch):
    kept = []
    monkeypatch.setattr(meshes, "cut", lambda df, own=meshes.cut: kept.append(df.columns) or own(df))
    made = shuffled_rows(spark, meshes.i04_subdivide(spark, sf))
    assert not [c for c in kept if "ax" in c]  # the halved triangles, as a checkpoint
    dealt = [line for line in made.splitlines() if "Window [min(" in line or "windowspecdefinition" in line]
    assert dealt and not any("x#" in line for line in dealt)
