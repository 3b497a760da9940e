import __spark_entry__ as entry


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) > 60 and set(sql) <= set(queries)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
