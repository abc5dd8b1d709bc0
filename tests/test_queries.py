"""Every registered query of the library equals its DuckDB SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidemark.plans import registry


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ALL))
def test_equals_sql(spark, sf_dir, duck, name):
    run, sql = registry.ALL[name]
    df = run(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(v) for v in r)) for r in df.select(*cols).collect())
    if sql is None:
        assert got
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    order = [names.index(c) for c in cols]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(norm(r[i]) for i in order)) for r in cur.fetchall())
