"""GeoJSON geometries as text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pairs(points: Column, decimals: int) -> Column:
    form = f"[%.{decimals}f,%.{decimals}f]"
    return F.array_join(F.transform(points, lambda p: F.format_string(form, p["x"], p["y"])), ",")


def line(points: Column, decimals: int = 7) -> Column:
    """A LineString; fewer than two points give no coordinates."""
    body = F.when(F.size(points) >= 2, _pairs(points, decimals)).otherwise("")
    return F.concat(F.lit('{"type":"LineString","coordinates":['), body, F.lit("]}"))


def polygon(ring: Column, decimals: int = 7) -> Column:
    """A Polygon of one ring, closed by its first point."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    return F.concat(F.lit('{"type":"Polygon","coordinates":[['), _pairs(closed, decimals), F.lit("]]}"))


def collection(features: Column) -> Column:
    """A FeatureCollection of an array of features."""
    return F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(features, ","), F.lit("]}"))


def feature(geometry: Column, properties: Column) -> Column:
    """A Feature of a geometry's text and a struct of properties."""
    return F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(properties), F.lit(',"geometry":'), geometry, F.lit("}"))
