"""Every registered query against its DuckDB SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from reliefloom import queries


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    rows = [tuple(map(norm, r)) for r in df.select(*sorted(df.columns)).collect()]
    if name not in queries.ORACLE_SQL:
        assert rows
        return
    r = duck.execute(queries.ORACLE_SQL[name])
    columns = [x[0] for x in r.description]
    assert sorted(columns) == sorted(df.columns)
    place = [columns.index(c) for c in sorted(columns)]
    assert ordered(rows) == ordered([tuple(norm(row[i]) for i in place) for row in r.fetchall()])
