"""Registered queries of the library and the DuckDB SQL of each."""

from __future__ import annotations

from .plans import features, inputs, layers, meshes, parts, projection, rasters, routes, solids

_PARTS = (projection, routes, features, rasters, meshes, layers, inputs, parts, solids)
QUERIES = {k: f for p in _PARTS for k, f in p.REG.queries.items()}
ORACLE_SQL = {k: s for p in _PARTS for k, s in p.REG.sql.items()}
