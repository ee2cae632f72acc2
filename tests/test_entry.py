"""The driver's contract."""

import __spark_entry__


def test_names_and_flagship(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90
    assert all(callable(f) for f in queries.values()) and all(isinstance(s, str) for s in sql.values())
    assert __spark_entry__.entry(spark).columns == ["id", "score", "published_at", "source_id"]
