import __spark_entry__ as entry


def test_contract(spark):
    names = entry.queries()
    assert len(names) >= 100 and set(entry.oracle_sql()) <= set(names)
    df = entry.entry(spark)
    assert df.columns and df.limit(1).count() == 1
