"""Defaults of layers and routes, zooms that a store can serve, grids sampled by their own step."""

import pytest
from pyspark.sql import functions as F

from reliefloom.functions import geo
from reliefloom.operators import raster, rules
from reliefloom.sources import settings


def test_layers_get_defaults(spark):
    models = spark.createDataFrame([(1,), (2,)], "model_id long")
    given = spark.createDataFrame([(1, "roads", None, 9.0), (2, "trails", True, None)], "model_id long, layer string, enabled boolean, height_mm double")
    got = {(r.model_id, r.layer): (r.enabled, r.height_mm, r.color) for r in settings.with_layers(models, given).collect()}
    assert len(got) == 2 * len(settings.LAYER_DEFAULTS)
    assert got[1, "roads"] == (True, 9.0, "#4A4A4A") and got[2, "roads"] == (True, 1.0, "#4A4A4A") and got[2, "trails"][:2] == (True, 0.6) and got[1, "trails"][0] is False
    strange = spark.createDataFrame([(1, "lava", True, None)], given.schema)
    with pytest.raises(Exception, match="Unknown layer: lava"):
        settings.with_layers(models, strange).collect()
    assert settings.with_layers(models, given.limit(0)).count() == len(got)


def test_routes_get_styles(spark):
    r = spark.createDataFrame([("a", 1, None, 3.0), ("a", 2, "#123456", None), ("b", 1, None, None)], "file string, track int, color string, width_mm double")
    got = [(x.file, x.track, x.color, x.width_mm, x.height_mm, x.visible) for x in settings.with_style(r).orderBy("file", "track").collect()]
    first, _, third = settings.ROUTE_COLOURS[:3]
    assert got == [("a", 1, first, 3.0, 1.2, True), ("a", 2, "#123456", 1.5, 1.2, True), ("b", 1, third, 1.5, 1.2, True)]
    assert settings.with_style(r.select("file", "track")).filter("color IS NULL OR width_mm != 1.5").count() == 0


def test_zooms_that_the_store_serves(spark):
    needed = spark.createDataFrame([(m, z, x, 0) for m in (1, 2, 3) for z in (5, 6, 7) for x in (m, m + 10)], "model_id long, z int, x long, y long")
    stored = spark.createDataFrame([(5, 1, 0), (6, 11, 0), (6, 11, 0), (5, 2, 0), (7, 99, 0)], "z int, x long, y long")
    zoom = raster.usable_zoom(needed, stored)
    assert {r.model_id: r.zoom for r in zoom.collect()} == {1: 6, 2: 5, 3: None}
    figures = zoom.withColumns({"wanted_zoom": F.lit(6), "missing": F.lit(0), "repaired": F.lit(0), "pixels": F.lit(1)})
    warnings = rules.judged(figures, "model_id", rules.raster_rules())
    assert sorted(tuple(r) for r in warnings.collect()) == [(2, "warn", "dem-zoom-reduced"), (3, "fail", "dem-missing")]
    assert sorted(r.model_id for r in rules.exportable(zoom.select("model_id"), warnings, "model_id").collect()) == [1, 2]


def test_grids_are_sampled_by_their_step(spark):
    """A plane rises by 1 a pixel: means and values between pixels are the plane's own; below the sea it is cut."""
    z, tile = 10, 256
    box = (7.62, 45.94, 7.74, 46.02)
    left, top = (spark.range(1).select(F.floor(v)).first()[0] for v in (geo.tile_x(F.lit(box[0]), F.lit(z)) * tile, geo.tile_y(F.lit(box[3]), F.lit(z)) * tile))
    pixels = spark.range(120 * 120).select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("model_id"), (F.col("id") % 120).alias("px"), F.floor(F.col("id") / 120).alias("py")).withColumn("v", (F.col("px") - F.when(F.col("model_id") == 3, 1000).otherwise(0)).cast("float"))
    grids = spark.createDataFrame([(1, 7.65, 45.96, 7.70, 46.0, z, 100.0, 9, 5), (2, 7.65, 45.96, 7.70, 46.0, z, 480.0, 4, 3), (3, 7.65, 45.96, 7.70, 46.0, z, 480.0, 2, 1)], "model_id int, west double, south double, east double, north double, z int, resolution_m double, cols long, rows long")
    grids = grids.withColumns({"left": F.lit(left), "top": F.lit(top), "width": F.lit(120), "height": F.lit(120)})
    got = {(r.model_id, r.i, r.j): r.h_m for r in raster.heightfields(grids, pixels, tile).collect()}
    assert len(got) == 45 + 12 + 2
    lon = lambda i, n: 7.65 + 0.05 * i / (n - 1)
    at = lambda v: (v + 180) / 360 * 2**z * tile - left
    assert all(abs(h - at(lon(i, 9))) < 1e-2 for (m, i, _), h in got.items() if m == 1)
    assert all(abs(h - int(at(lon(i, 4)) + 0.5)) < 1e-2 for (m, i, _), h in got.items() if m == 2)
    assert {h for (m, _, _), h in got.items() if m == 3} == {0.0}
