"""GPX tracks, routes and waypoints as point rows, by Spark's own XML functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tracks import valid_points

_POINT = "array<struct<_lat: double, _lon: double, ele: double, time: string>>"
SCHEMA = f"struct<trk: array<struct<name: string, trkseg: array<struct<trkpt: {_POINT}>>>>, rte: array<struct<name: string, rtept: {_POINT}>>, wpt: {_POINT}>"


def time_ms(text: Column) -> Column:
    """Milliseconds of an ISO time; null for what is none."""
    return F.unix_millis(F.try_to_timestamp(text))


def parsed(texts: DataFrame) -> DataFrame:
    """file, track, raw_name, seq, lon, lat, ele, t_ms of `file, text`.

    Each track segment and each route of two or more valid points is a line; a file without any line
    has one of its waypoints. Files that are no XML, or hold no points, give no rows.
    """
    g = texts.select("file", F.from_xml("text", SCHEMA).alias("g"))
    trk = g.select("file", F.posexplode("g.trk").alias("n", "t")).select("file", "n", F.col("t.name").alias("raw_name"), F.posexplode("t.trkseg").alias("s", "seg"))
    trk = trk.select("file", F.lit(0).alias("kind"), "n", "s", "raw_name", F.posexplode("seg.trkpt").alias("seq", "p"))
    rte = g.select("file", F.posexplode("g.rte").alias("n", "t")).select("file", F.lit(1).alias("kind"), "n", F.lit(0).alias("s"), F.col("t.name").alias("raw_name"), F.posexplode("t.rtept").alias("seq", "p"))
    wpt = g.select("file", F.lit(2).alias("kind"), F.lit(0).alias("n"), F.lit(0).alias("s"), F.lit(None).cast("string").alias("raw_name"), F.posexplode("g.wpt").alias("seq", "p"))
    points = trk.unionByName(rte).unionByName(wpt).select("file", "kind", "n", "s", "raw_name", "seq", F.col("p._lon").alias("lon"), F.col("p._lat").alias("lat"), F.col("p.ele").alias("ele"), time_ms(F.col("p.time")).alias("t_ms"))
    line = ["file", "kind", "n", "s"]
    enough = valid_points(points).withColumn("points", F.count("*").over(Window.partitionBy(*line))).filter("points >= 2")
    real = enough.filter("kind < 2").select("file").distinct()
    loose = enough.filter("kind = 2").join(real, "file", "left_anti")
    used = enough.filter("kind < 2").unionByName(loose.select(enough.columns))
    track = F.dense_rank().over(Window.partitionBy("file").orderBy("kind", "n", "s"))
    return used.select("file", track.alias("track"), "raw_name", "seq", "lon", "lat", "ele", "t_ms")


def failures(texts: DataFrame, points: DataFrame) -> DataFrame:
    """file, code: the files of which nothing could be used; the others are not affected."""
    return texts.select("file").distinct().join(points.select("file").distinct(), "file", "left_anti").withColumn("code", F.lit("gpx-unusable"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Points of all GPX files under a path; a file is one row of text while it is parsed."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("text"))
    return parsed(files)
