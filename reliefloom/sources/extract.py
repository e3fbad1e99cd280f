"""Map extracts: JSON documents with an `elements` array, as element rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_GEOMETRY = "array<struct<lat: double, lon: double>>"
ELEMENT = f"struct<type: string, id: bigint, tags: map<string, string>, geometry: {_GEOMETRY}, members: array<struct<type: string, ref: bigint, role: string, geometry: {_GEOMETRY}>>>"
SCHEMA = f"struct<elements: array<{ELEMENT}>>"


def parsed(texts: DataFrame) -> DataFrame:
    """source, type, id, tags, points, members of `source, text`; a document without elements is an error row of `failures`."""
    e = texts.select("source", F.explode(F.from_json("text", SCHEMA)["elements"]).alias("e"))
    points = F.transform(F.coalesce("e.geometry", F.array()), lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    return e.select("source", "e.type", "e.id", "e.tags", points.alias("points"), "e.members")


def failures(texts: DataFrame) -> DataFrame:
    """source of the documents that hold no elements array."""
    return texts.filter(F.from_json("text", SCHEMA)["elements"].isNull()).select("source")


def read(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
    return parsed(files)


def members(elements: DataFrame) -> DataFrame:
    """rel_id, ord, role, seq, x, y: the vertices of relations' way members, as ring assembly takes them."""
    m = elements.filter("type = 'relation'").select(F.col("id").alias("rel_id"), F.posexplode("members").alias("ord", "m")).filter("m.type = 'way'")
    return m.select("rel_id", "ord", F.col("m.role").alias("role"), F.posexplode("m.geometry").alias("seq", "p")).select("rel_id", "ord", "role", "seq", F.col("p.lon").alias("x"), F.col("p.lat").alias("y"))
