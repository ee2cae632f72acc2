"""Discovery runs: which lastmods are trusted, and the three ways a run ends."""

import dataclasses
import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleanery.config import CONFIG
from gleanery.operators import discovery

CHILDREN, ENTRIES = "host string, root string, child string, lastmod string", "host string, root string, child string, url string, lastmod string, pos long"

def now():
    return F.lit("2024-06-01").cast("timestamp")


@pytest.fixture(scope="module")
def tables(spark):
    def make(children, entries, seen, cursor="2024-05-10", hosts=("h",)):
        cursors = spark.createDataFrame([("h", dt.datetime.fromisoformat(cursor))] if cursor else [], "host string, cursor timestamp")
        roots = spark.createDataFrame([(h, "r") for h in hosts], "host string, root string")
        return roots, spark.createDataFrame(children, CHILDREN), spark.createDataFrame(entries, ENTRIES), cursors, spark.createDataFrame(seen, "host string, url string")

    return make


def judged(tables, lastmods, seen=(("h", "known"),), cursor="2024-05-10"):
    _, children, _, cursors, known = tables([("h", "r", f"c{k}", m) for k, m in enumerate(lastmods)], [], list(seen), cursor)
    rows = discovery.judged_children(children, cursors, known, now()).orderBy("child").collect()
    return [(r.pathological, r.skipped) for r in rows]


@pytest.mark.parametrize(
    ("lastmods", "want"),
    [
        (["2024-05-10", "2024-05-11"], [(False, True), (False, False)]),
        (["2024-05-01", "2024-05-01"], [(True, False), (True, False)]),
        (["2024-05-01"], [(False, True)]),
        (["2024-05-01", None], [(False, True), (False, False)]),  # a missing one is no sibling, and not pathological
        ([None, None], [(False, False), (False, False)]),
        (["yesterday", "2024-05-01T10:00:00Z"], [(True, False), (False, True)]),
        (["2024-06-02", "2024-06-03"], [(False, False), (True, False)]),
        (["2024-05-10T00:00:00Z", "2024-05-10T00:00:01Z"], [(False, True), (False, False)]),
    ],
)
def test_lastmods(tables, lastmods, want):
    assert judged(tables, lastmods) == want


def test_first_runs_and_hosts_without_a_cursor_skip_nothing(tables):
    assert judged(tables, ["2024-05-01", "2024-05-02"], seen=()) == [(False, False)] * 2
    assert judged(tables, ["2024-05-01", "2024-05-02"], cursor=None) == [(False, False)] * 2


def run(spark, made, alert=CONFIG.lastmod_alert, **more):
    new, runs = discovery.discover(*made, now(), config=dataclasses.replace(CONFIG, lastmod_alert=alert), **more)
    return {(r.host, r.url, r.lastmod) for r in new.collect()}, {r.host: (r.outcome, r.sitemaps_fetched, r.urls_new) for r in runs.collect()}


OLD_AND_NEW = [("h", "r", "old", "2024-05-01"), ("h", "r", "new", "2024-05-20")]
URLS = [("h", "r", "old", "u1", "a", 1), ("h", "r", "new", "u2", "b", 2), ("h", "r", "new", "known", "b", 3), ("h", "r", "new", "u3", "c", 4), ("h", "r", None, "own", "d", 5)]


def test_completed_reads_only_what_changed(spark, tables):
    assert run(spark, tables(OLD_AND_NEW, URLS, [("h", "known")])) == ({("h", "u2", "b"), ("h", "u3", "c")}, {"h": ("completed", 2, 2)})


def test_many_new_urls_distrust_lastmod_and_read_all(spark, tables):
    made = tables(OLD_AND_NEW, URLS, [("h", "known")])
    assert run(spark, made, alert=1) == ({("h", "u1", "a"), ("h", "u2", "b"), ("h", "u3", "c"), ("h", "own", "d")}, {"h": ("completed_lastmod_distrusted", 3, 4)})
    assert run(spark, made, alert=2)[1] == {"h": ("completed", 2, 2)}
    nothing_skipped = tables([("h", "r", "new", "2024-05-20")], URLS, [("h", "known")])
    assert run(spark, nothing_skipped, alert=1)[1] == {"h": ("completed", 2, 2)}


def test_first_run_seeds(spark, tables):
    new, runs = run(spark, tables(OLD_AND_NEW, URLS, []), alert=1)
    assert {u for _, u, _ in new} == {"u1", "u2", "u3", "known"} and runs == {"h": ("seeded", 3, 0)}


def test_roots_without_children_last_entry_and_allow_list(spark, tables):
    entries = [("h", "r", None, "http://h/a/1", "x", 1), ("h", "r", None, "http://h/a/1", "y", 2), ("h", "r", None, "http://h/b/1", "x", 3), ("h", "r", None, "", "x", 4), ("h", "r", None, None, "x", 5), ("g", "r", None, "http://g/q", None, 6)]
    listed = spark.createDataFrame([("h", ["^/a/"])], "host string, patterns array<string>")
    made = tables([], entries, [("h", "known"), ("g", "k")], hosts=("h", "g", "none"))
    new, runs = run(spark, made, allow_list=listed)
    assert new == {("h", "http://h/a/1", "y"), ("g", "http://g/q", None)}
    assert runs == {"h": ("completed", 1, 1), "g": ("completed", 1, 1), "none": ("seeded", 1, 0)}
