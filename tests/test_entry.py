import __spark_entry__ as entry


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 40


def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1
