"""Containers by ordered selectors, source policies and the union of sources: cases with the results that the rules give."""

from pyspark.sql import functions as F

from gleanery.functions import containers
from gleanery.operators import candidates, merges, metrics
from gleanery.sources import feeds


def test_the_first_selector_that_matches_wins_and_elements_nest():
    page = '<html><body><div class="ad">no</div><div class="x Story-Body"><p>a</p><div>inner</div>b<br></div><article>art</article></body></html>'
    find = containers.container
    assert find(page, ["div.story-body", "article"]) == "<p>a</p><div>inner</div>b<br>"
    assert find(page, ["section", "article"]) == "art"
    assert find(page, ["div"]) == "no"
    assert find("<div>one\n<div>two</div>\nthree</div><div>four</div>", ["div"]) == "one\n<div>two</div>\nthree"
    assert find(page, ["main"]) is None and find(page, None) is None and find(page, []) is None and find(None, ["div"]) is None
    assert find("<article>never ends", ["article"]) is None and find("<article></article>", ["article"]) is None
    assert find("<script>var t = '<article>x</article>';</script><article>y</article>", ["article"]) == "y"


def test_selectors_come_by_host_in_their_order(spark):
    pages = spark.createDataFrame([(1, "a", "<main>m</main><article>x</article>"), (2, "b", "<article>x</article>"), (3, "c", None)], "page_id long, host string, html string")
    rules = spark.createDataFrame([("a", 2, "article"), ("a", 1, "main"), ("c", 1, "main")], "host string, place int, selector string")
    out = containers.article_containers(containers.selectors_by_host(pages, rules), "html", "selectors")
    assert sorted((r["page_id"], r["inner_html"]) for r in out.collect()) == [(1, "m"), (2, None), (3, None)]


def test_allowed_articles(spark):
    rows = spark.createDataFrame([(1, "https://A.example.com/blog/1"), (2, "https://a.example.com/shop"), (3, "https://b.example.com/blog/1"), (4, None)], "pos long, url string")
    rules = spark.createDataFrame([("a.example.com", ["^/blog/", "^/news/"])], "host string, patterns array<string>")
    out = candidates.allowed_articles(rows, rules).orderBy("pos").collect()
    assert [(r["allowed"], r["allowed_for_seeding"]) for r in out] == [(True, True), (False, False), (False, True), (False, True)]


def test_source_policies(spark):
    stored = spark.createDataFrame([("a", "r0", "u0", "t0"), ("b", "r0", "u0", "t0"), ("c", "r0", None, "t0")], "host string, robots_hash string, terms_url string, terms_hash string")
    robots = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("d", 1, "x")], "host string, seq long, robots_text string")
    listed = spark.createDataFrame([("a", "u0"), ("b", "u1"), ("z", "u9")], "host string, terms_url string")
    got = {r["host"]: (r["robots_hash"], r["terms_url"], r["terms_hash"]) for r in merges.sync_source_policy(stored, robots, listed).collect()}
    sha = lambda x: spark.range(1).select(F.sha2(F.lit(x), 256)).first()[0]
    assert got == {"a": (sha("new"), "u0", "t0"), "b": ("r0", "u1", None), "c": ("r0", None, "t0"), "d": (sha("x"), None, None)}


def test_unified_sources(spark):
    schema = "feed int, place int, link string, title string, author string, published_at timestamp"
    one = spark.createDataFrame([(0, k, f"l{k}", f"t{k}", None, None) for k in range(5)] + [(1, 0, "l0", "again", None, None), (1, 1, "l9", "t9", None, None)], schema)
    out = [(r["source_id"], r["url"], r["title"]) for r in feeds.unify_sources({"n": one, "b": one}, 4, {"b": 2}).orderBy("source_id", "place").collect()]
    assert out == [("b", "l0", "t0"), ("b", "l1", "t1"), ("b", "l9", "t9"), ("n", "l0", "t0"), ("n", "l1", "t1"), ("n", "l2", "t2"), ("n", "l3", "t3")]


def test_columns_that_may_not_leave(spark):
    rows = spark.createDataFrame([(1, "x", None), (2, None, None)], "id long, slice string, html string")
    assert sorted(map(tuple, metrics.columns_not_allowed(rows, {"id"}).collect())) == [("html", 0), ("slice", 1)]
    assert metrics.columns_not_allowed(rows, {"id", "slice", "html"}).count() == 0
