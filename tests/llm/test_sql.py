"""The newer operators' queries equal their SQL on whole given tables."""

import os

import duckdb
import pytest

from tidemark import llm


@pytest.mark.parametrize("name", ["op11_embedding_neardup", "op12_spelling_variants", "op13_prefix_trie"])
def test_equals_sql(spark, sf_dir, name):
    at = sf_dir.replace("0.001", "0.01")
    con = duckdb.connect()
    for table in os.listdir(at):
        con.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{at}/{table}'")
    cursor = con.execute(llm.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    df = llm.QUERIES[name](spark, at)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, cursor.fetchall()))
