"""Dimension tables: elevation datasets, example areas, defaults of models, layers and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tags import LAYERS

# Fixed values.
DATASETS = [("mapterhorn", 512, 14, "terrarium"), ("aws-terrarium", 256, 13, "terrarium")]
AREAS = [
    ("matterhorn", 7.62, 45.94, 7.74, 46.02), ("margalla", 72.96, 33.68, 73.12, 33.78), ("grand-canyon", -112.2, 36.03, -112.02, 36.14), ("fuji", 138.66, 35.3, 138.83, 35.42),
    ("tromso", 18.85, 69.6, 19.15, 69.72), ("flat-nl", 5.4, 52.44, 5.6, 52.54),
]
MODEL_DEFAULTS = {"width_mm": 100.0, "base_mm": 3.0, "exaggeration": 1.5, "max_height_mm": 30.0, "sea_offset_m": 0.0, "smoothing": 0, "layer_mm": 0.2, "nozzle_mm": 0.4}
LAYER_DEFAULTS = [
    ("roads", "line", True, "#4A4A4A", 1.0), ("trails", "line", False, "#8B6F47", 0.6), ("railways", "line", False, "#6B6B6B", 1.0), ("water", "polygon", True, "#3B7EA1", 0.4), ("buildings", "polygon", False, "#D9D2C5", 0.0),
    ("greenery", "polygon", False, "#6E8B58", 0.4), ("sand", "polygon", False, "#D6C08A", 0.3), ("aeroways", "line", False, "#5A5F6B", 0.8), ("piers", "line", False, "#7A6A55", 1.0), ("skiruns", "line", False, "#C8D6E5", 0.6),
]
ROUTE_COLOURS = ["#FF0D00", "#2E86DE", "#F5A623", "#7ED321", "#9B51E0", "#00B8A9", "#E84393", "#FF7A45"]
ROUTE_DEFAULTS = {"width_mm": 1.5, "height_mm": 1.2, "visible": True}


def datasets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DATASETS, "dataset string, tile_size int, max_zoom int, encoding string")


def areas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AREAS, "area string, west double, south double, east double, north double")


def layers(spark: SparkSession) -> DataFrame:
    rows = [(*r, LAYERS[r[0]]) for r in LAYER_DEFAULTS]
    return spark.createDataFrame(rows, "layer string, kind string, enabled boolean, color string, height_mm double, subtypes array<string>")


def with_dataset(models: DataFrame) -> DataFrame:
    """models joined with their dataset; an unknown one is an error."""
    known = models.join(F.broadcast(datasets(models.sparkSession)), "dataset", "left")
    problem = F.raise_error(F.concat(F.lit("Unknown dataset: "), F.col("dataset"))).cast("int")
    return known.withColumn("tile_size", F.when(F.col("tile_size").isNull(), problem).otherwise(F.col("tile_size")))


def with_defaults(models: DataFrame) -> DataFrame:
    """Null or missing settings of models get their defaults."""
    given = set(models.columns)
    return models.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in given else F.lit(v) for k, v in MODEL_DEFAULTS.items()})


def with_layers(models: DataFrame, given: DataFrame) -> DataFrame:
    """A row for each of a model's layers, with what is given for it (model_id, layer and any of enabled, color, height_mm, subtypes) over the defaults.

    A layer that nobody knows is an error.
    """
    table = layers(models.sparkSession)
    names = {c: f"_{c}" for c in ("enabled", "color", "height_mm", "subtypes") if c in given.columns}
    own = given.select("model_id", "layer", *(F.col(c).alias(n) for c, n in names.items()))
    strange = own.join(F.broadcast(table.select("layer")), "layer", "left_anti").agg(F.min("layer").alias("unknown"))  # one row
    each = models.join(F.broadcast(table), F.lit(True)).join(own, ["model_id", "layer"], "left")  # ten layers
    set_ = each.withColumns({c: F.coalesce(F.col(n), F.col(c)) for c, n in names.items()}).drop(*names.values())
    problem = F.raise_error(F.concat(F.lit("Unknown layer: "), F.col("unknown"))).cast("boolean")
    checked = set_.join(F.broadcast(strange), F.lit(True))
    return checked.withColumn("enabled", F.when(F.col("unknown").isNotNull(), problem).otherwise(F.col("enabled"))).drop("unknown")


def with_style(routes: DataFrame) -> DataFrame:
    """Null or missing settings of routes (file, track) get their defaults; without a color they take turns."""
    had = set(routes.columns)
    own = routes.withColumnRenamed("color", "_color") if "color" in had else routes.withColumn("_color", F.lit(None).cast("string"))
    out = route_coloured(own)
    out = out.withColumn("color", F.coalesce("_color", "color")).drop("_color", "_n")
    return out.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in had else F.lit(v) for k, v in ROUTE_DEFAULTS.items()})


def with_area(models: DataFrame) -> DataFrame:
    """models joined with their example area; an unknown one is an error."""
    known = models.join(F.broadcast(areas(models.sparkSession)), "area", "left")
    problem = F.raise_error(F.concat(F.lit("Unknown area: "), F.col("area"))).cast("double")
    return known.withColumn("west", F.when(F.col("west").isNull(), problem).otherwise(F.col("west")))


def tile_key(dataset: Column, z: Column, x: Column, y: Column) -> Column:
    return F.concat(F.lit("dem:"), F.concat_ws("/", dataset, z, x, y))


def tile_url(template: Column, z: Column, x: Column, y: Column) -> Column:
    """A template with {z}, {x} and {y} filled in, the first of each."""
    for name, value in (("z", z), ("x", x), ("y", y)):
        mark = "{%s}" % name
        at = F.instr(template, mark)
        template = F.when(at > 0, F.overlay(template, value.cast("string"), at, len(mark))).otherwise(template)
    return template


def route_coloured(routes: DataFrame) -> DataFrame:
    """routes with `color`: colours in turn, in the order of file and track.

    Routes are numbered inside each file; only the counts of the files, one row each, meet an unpartitioned window.
    """
    per_file = routes.groupBy("file").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per_file.select("file", before.alias("_before"))
    n = F.col("_before") + F.row_number().over(Window.partitionBy("file").orderBy("track")) - 1
    colour = F.element_at(F.array(*map(F.lit, ROUTE_COLOURS)), (n % len(ROUTE_COLOURS) + 1).cast("int"))
    return routes.join(starts, "file").withColumn("color", colour).drop("_before")
