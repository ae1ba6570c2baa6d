"""Every query with a SQL twin agrees with it on the smallest tables; every other one gives rows."""

import glob
import math
import os

import duckdb
import pytest

from gaugeworks.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def table(columns, rows):
    order = sorted(columns)
    at = [list(columns).index(c) for c in order]
    return order, sorted(repr([plain(r[i]) for i in at]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    got = table(df.columns, df.collect())
    assert len(set(df.columns)) == len(df.columns)
    if name in catalog.ORACLES:
        rel = duck.sql(catalog.ORACLES[name])
        assert got == table(rel.columns, rel.fetchall())
    else:
        assert got[1]


def test_moments_halfway_between_digits(spark, tmp_path):
    """Boxes with a moment that ends in 50 at six digits: the first three go down in SQL, the others up."""
    parts = "(1, 19, 970.6), (2, 3, 992.2), (3, 14, 944.5), (4, 5, 901.8), (5, 5, 904.1)"
    con = duckdb.connect()
    con.sql(f"create table part as select k::bigint as p_partkey, s::int as p_size, p::double as p_retailprice from (values {parts}) x(k, s, p)")
    con.sql(f"copy part to '{tmp_path}/part.parquet' (format parquet)")
    df = catalog.QUERIES["mesh_measures"](spark, str(tmp_path))
    rel = con.sql(catalog.ORACLES["mesh_measures"])
    assert table(df.columns, df.collect()) == table(rel.columns, rel.fetchall())
