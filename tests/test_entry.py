import __spark_entry__ as entry


def test_flagship(spark):
    assert entry.entry(spark).count() == 10


def test_names_match():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) >= 90
