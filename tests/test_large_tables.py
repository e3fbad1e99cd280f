"""What grows with a table is dealt over tasks, and is not taken for as small as what it was made from."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from reliefloom.operators import keys, mesh, raster, surface
from reliefloom.plans import layers, meshes, projection


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def _grid(spark, cols, rows):
    n = spark.range(cols * rows)
    nodes = n.select(F.lit(0).alias("model_id"), (F.col("id") % cols).alias("i"), F.floor(F.col("id") / cols).alias("j")).withColumns({"x": F.col("i").cast("float"), "y": F.col("j").cast("float"), "z": F.lit(5.0).cast("float")})
    return nodes, nodes.groupBy("model_id").agg((F.max("i") + 1).alias("cols"), (F.max("j") + 1).alias("rows"))


def test_one_model_is_counted_out_by_many_tasks(spark):
    v, t = mesh.terrain_solid(*_grid(spark, 40, 600))
    sizes = sorted(r["count"] for r in t.groupBy(F.spark_partition_id()).count().collect())
    assert sum(sizes) == 2 * 39 * 599 + 3 * 2 * (40 + 600 - 2)
    assert sizes[-1] < sum(sizes) * 0.7  # one task made all cells
    assert t.select("tid").distinct().count() == sum(sizes)


def test_counted_numbers_are_whole(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0), ("c", 4096), ("d", 10_000)], "k string, n long")
    got = keys.counted(df, F.col("n"), "at").groupBy("k").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.count_distinct("at").alias("d"))
    assert sorted(map(tuple, got.collect())) == [("a", 1, 0, 0, 1), ("c", 4096, 0, 4095, 4096), ("d", 10_000, 0, 9999, 10_000)]


def test_triangles_and_vertices_are_not_broadcast(spark):
    v, t = mesh.terrain_solid(*_grid(spark, 20, 20))
    for made in (mesh.with_corners(t, v), mesh.vertex_normals(t, v), mesh.welded(t, v)[0]):
        assert "BroadcastHashJoin" not in plan(made)
    assert "BuildLeft" not in plan(mesh.subdivided(t, v)[0])  # a row for each model may be broadcast, on the right


@pytest.mark.parametrize("query", [meshes.e17_vertex_normals, meshes.e19_longest_edge])
def test_only_a_row_for_each_model_goes_to_the_driver(spark, sf, query):
    made = plan(query(spark, sf)).split("Initial Plan")[0]
    assert made.count("SortMergeJoin") >= 3  # the corners
    assert {re.sub(r"#\d+", "", k) for k in re.findall(r"Broadcast\w+Join (\[[^\]]*\])", made)} <= {"[model_id]"}  # vertices were broadcast, by model and number


def test_box_means_are_shared_and_not_broadcast(spark):
    pixels = spark.range(100).select((F.col("id") % 10).alias("px"), F.floor(F.col("id") / 10).alias("py"), F.col("id").cast("double").alias("v"))
    points = spark.range(3000).select("id", (F.col("id") % 3).cast("double").alias("x"), F.lit(1.2).alias("y"))
    got = raster.box_mean(points, pixels, 1)
    assert "BroadcastHashJoin" not in plan(got)
    want = [sum(10 * j + i for j in (0, 1, 2) for i in range(max(0, x - 1), x + 2)) / (3 * len(range(max(0, x - 1), x + 2))) for x in range(3)]
    rows = got.collect()
    assert len(rows) == 3000 and all(r["v"] == want[r["id"] % 3] for r in rows)
    assert "BroadcastHashJoin" not in plan(raster.bilinear(points, pixels, F.lit(10), F.lit(10)))


def test_selections_are_dealt_before_their_rings_are_made(spark, sf):
    parts = projection._rings(spark, sf).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1
    made = projection.b20_selection_ring(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "cos" in made.lower() and "cos" not in made.lower().split("repartitionbyexpression")[1]  # rings are made after the deal only


def test_files_are_read_back_by_their_heads(spark, sf):
    files = meshes.a09_stl_files(spark, sf)
    assert "content:binary" not in files._jdf.queryExecution().executedPlan().toString()  # the columns that are read
    assert files.filter("bytes != 84 + 50 * triangles").isEmpty()


def test_draped_surfaces_are_not_broadcast(spark):
    v = spark.range(50).select(F.lit(0).alias("model_id"), F.col("id").alias("vid"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    ground = v.select("model_id", "vid", (F.col("vid") * 2.0).alias("ground"))
    got = surface.draped(v, ground, 5.0, 2.0, 0.0)
    assert "BroadcastHashJoin" not in plan(got)
    assert sorted((r["vid"], r["top"], r["bottom"]) for r in got.collect()) == [(n, n * 2.0 + 5, max(0.0, n * 2.0 - 2)) for n in range(50)]


def test_models_are_judged_once(spark, sf):
    got = layers.k06_exportable_models(spark, sf)
    assert "orders.parquet" not in plan(got)  # the audit was made for the models, and again for what fails
    assert [r["model_id"] for r in got.collect()] == [0]


def test_edges_are_dealt_before_they_are_counted(spark):
    v, t = mesh.terrain_solid(*_grid(spark, 20, 20))
    faults = mesh.edge_faults(t)
    assert "RepartitionByExpression [model_id" in faults._jdf.queryExecution().optimizedPlan().toString()  # a task held all the edges it met
    assert [tuple(r) for r in faults.collect()] == [(0, 0, 0)]


def test_corners_with_several_vertices_are_chosen_in_one_task(spark):
    v = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 0.0), (0, 2, 0.0, 1.0, 0.0), (0, 3, 0.0, 1.0, 0.0), (0, 0, 5.0, 5.0, 0.0), (0, 3, 1.0, 0.0, 0.0)], "model_id int, vid long, x float, y float, z float")
    t = spark.createDataFrame([(0, 0, 0, 1, 3), (0, 1, 0, 3, 2), (0, 2, 1, 1, 2)], "model_id int, tid long, a long, b long, c long")
    got = mesh.welded_without_degenerates(t, v)
    assert plan(got).split("Initial Plan")[0].count("SortMergeJoin") == 4  # three times the corners, once the vertices: it was six and two, of ever more rows
    # the same by joins of every choice
    spots = [tuple(r) for r in v.select("vid", "x", "y", "z").collect()]
    to = [(n, min(m for m, *q in spots if q == p)) for n, *p in spots]
    want = []
    for tid, *corners in [tuple(r)[1:] for r in t.collect()]:
        for a, b, c in itertools.product(*([(w, x, y) for n, w in to if n == k for m, x, y, _ in spots if m == w] for k in corners)):
            if len({a[0], b[0], c[0]}) == 3 and ((b[1] - a[1]) * (c[2] - a[2]) - (b[2] - a[2]) * (c[1] - a[1])) ** 2 / 4 > 1e-12:
                want.append((0, tid, a[0], b[0], c[0]))
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


def test_quarters_carry_their_corners(spark):
    v, t = mesh.terrain_solid(*_grid(spark, 7, 5))
    tops = v.groupBy("model_id").agg((F.max("vid") + 1).alias("top"))
    quarters = mesh.quarters(mesh.halved(mesh.with_corners(t, v)), tops)
    t4, v4 = mesh.subdivided(t, v)
    columns = ["model_id", "tid", "a", "b", "c", *(f"{p}{k}" for p in "abc" for k in "xyz")]
    made, joined = (sorted(map(tuple, x.select(*columns).collect())) for x in (quarters, mesh.with_corners(t4, v4)))
    assert made == joined and len(made) == 4 * t.count()
    got, audit = mesh.checked(quarters, "new").first(), mesh.audit(t4, v4).first()
    assert (got["triangles"], got["open_edges"], got["non_manifold"], got["new"]) == (len(made), 0, 0, v4.count() - v.count()) and abs(got["v"] - audit["volume_mm3"]) < 1e-9
