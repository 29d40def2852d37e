import __spark_entry__ as entry


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert len(queries) >= 57 and set(oracles) <= set(queries)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "total_issues" in out.columns
