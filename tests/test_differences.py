"""Queries against their SQL on small tables with what the driver's tables hold only now and then."""

import datetime

import duckdb
import pytest

from gleanery.plans import catalog


@pytest.fixture
def both(spark, tmp_path):
    """Rows of a query from Spark and from DuckDB over the given tables, in one order."""

    def run(name, **tables):
        con = duckdb.connect()
        con.execute("SET timezone = 'UTC'")
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        got = catalog.queries()[name](spark, str(tmp_path))
        want = con.execute(catalog.oracle_sql()[name]).df()
        return sorted(map(tuple, got.select(*want.columns).collect())), sorted(want.itertuples(index=False, name=None))

    return run


def test_the_second_of_the_last_run_isnt_rounded_up(both):
    events = [(1, 1, "view", datetime.datetime(2024, 1, 30, 23, 59, 58, 700000))], "event_id long, user_id long, event_type string, ts timestamp"
    got, want = both("a19_run_freshness", events=events)
    assert got == want and got[0][0] == 1706659198


def test_runs_that_distrust_lastmods_stand_in_the_log(both):
    events = [(1, 1, "view", datetime.datetime(2024, 1, 30))], "event_id long, user_id long, event_type string, ts timestamp"
    pages = [(k, f"https://h.example.com/{k}", "") for k in range(1, 12 * 300)], "page_id long, url string, html string"
    got, want = both("m21_run_log", events=events, pages=pages)
    assert got == want and any("completed_lastmod_distrusted" in r for r in got) and any("completed" in r for r in got)


CUT = ["a&amp;&amp;b&am", "a&amp;b&a", "a&amp;b&", "a&&amp", "a&lt;b&gt", "&quot;a&quot b", "a&amp;lt;b", "a&amp;am;b", "a&nbsp;&nbsp b"]


@pytest.mark.parametrize("name", ["p10_article_titles", "p13_extract_articles"])
def test_headings_cut_in_a_reference(both, name):
    pages = [(40 * k + 3, f"https://h.example.com/{k}", f"<html><title>page</title><body><article><h1>{h}</h1><p>{'long enough text ' * 9}</p></article></body></html>") for k, h in enumerate(CUT)], "page_id long, url string, html string"
    got, want = both(name, pages=pages)
    assert got == want
    assert [r[1 if name.startswith("p10") else 3].strip("　") for r in got] == ["a&&b&am", "a&b&a", "a&b&", "a&&", "a<b>", '"a" b', "a<b", "a&am;b", "a\u00a0\u00a0 b"]
