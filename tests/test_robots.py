"""Robots rules: the cases of RFC 9309, and paths against every rule by regular expressions."""

import random
import re
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from gleanery.functions.urls import percent_normal
from gleanery.operators.robots import robots_blocked, robots_rules


def rules(spark, *texts):
    rows = [(h, s, t) for h, s, t in texts]
    return {(r.host, r.pattern, r.allow) for r in robots_rules(spark.createDataFrame(rows, "host string, seq long, robots_text string"), "GleanBot").collect()}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("User-agent: *\nDisallow: /a", {("/a", False)}),
        ("User-agent: *\nDisallow: /a\nUser-agent: gleanbot\nAllow: /b", {("/b", True)}),
        ("User-agent: x\nUser-agent: GLEANBOT/2.0\nSitemap: /s\nDisallow: /a # why\n\nCrawl-delay: 1\nAllow: /b", {("/a", False), ("/b", True)}),
        ("User-agent: gleanbot\nDisallow: /a\nUser-agent: y\nDisallow: /c\nUser-agent: gleanbot\nDisallow: /d", {("/a", False), ("/d", False)}),
        ("Disallow: /early\nUser-agent: *\nDisallow:\n", set()),
        ("﻿user-agent:*\r\nDISALLOW :/a\rAllow:/b", {("/a", False), ("/b", True)}),
        ("User-agent: gleanbotter\nDisallow: /", set()),
        ("", set()),
        (None, set()),
    ],
)
def test_groups(spark, text, want):
    assert {r[1:] for r in rules(spark, ("h", 1, text))} == want


def test_latest_snapshot_of_each_host(spark):
    got = rules(spark, ("h", 1, "User-agent: *\nDisallow: /old"), ("h", 2, "User-agent: *\nDisallow: /new"), ("g", 9, "User-agent: *\nDisallow: /g"))
    assert got == {("h", "/new", False), ("g", "/g", False)}


CASES = [
    ("/a/*.pdf$", False, "/a/x.pdf", True), ("/a/*.pdf$", False, "/a/x.pdf?y", False), ("/a/*.pdf$", False, "/a/.pdf", True), ("/b%20c", False, "/b c/d", True), ("/b%20c", False, "/b%20c", True),
    ("/d%65", False, "/de", True), ("/d%2fe", False, "/d/e", False), ("/d%2fe", False, "/d%2Fe", True), ("/猫", False, "/%e7%8c%ab/x", True), ("/x$", False, "/x", True), ("/x$", False, "/xy", False),
    ("/x$y", False, "/x$y", True), ("/a%2Ab", False, "/a*b", True), ("/a%2Ab", False, "/aXb", False), ("*", False, "/any", True), ("/", False, "/robots.txt", False), ("/p*q*r", False, "/p1q2r3", True), ("/p*q*r", False, "/p1r2q3", False),
    ("/ab*ab$", False, "/ab", False), ("/ab*ab$", False, "/abab", True), ("/q", False, "", False), ("/", False, "", True), ("x", False, "/x", False), ("/*?s=", False, "/a?s=1", True), ("/50%", False, "/50%", True),
]


def test_patterns(spark):
    rows = [(f"h{k}", *case) for k, case in enumerate(CASES)]
    df = spark.createDataFrame(rows, "host string, pattern string, allow boolean, path string, want boolean")
    got = robots_blocked(df.select("host", "path", "want"), df.select("host", "pattern", "allow")).collect()
    assert len(got) == len(CASES) and [r for r in got if r.blocked != r.want] == []


def test_longest_rule_wins_and_allow_wins_ties(spark):
    given = spark.createDataFrame([("h", "/a", False), ("h", "/a/b", True), ("h", "/a/*/c", False), ("h", "/t", False), ("h", "/t", True), ("h", "/a/b", True)], "host string, pattern string, allow boolean")
    paths = [("h", p) for p in ("/a", "/a/b", "/a/b/c", "/t", "/z")] + [("other", "/a"), (None, "/a"), ("h", None), ("h", "/a")]
    got = robots_blocked(spark.createDataFrame(paths, "host string, path string"), given).collect()
    assert sorted((r.host or "", r.path or "", r.blocked) for r in got) == sorted([("h", "/a", True), ("h", "/a", True), ("h", "/a/b", False), ("h", "/a/b/c", True), ("h", "/t", False), ("h", "/z", False), ("other", "/a", False), ("", "/a", False), ("h", "", False)])


def test_equals_trying_every_rule(spark):
    rng = random.Random(5)
    bit = lambda letters, n: "".join(rng.choices(letters, k=rng.randint(0, n)))
    given = [(f"h{rng.randrange(3)}", "/" + bit("ab/*", 6) + rng.choice(["", "", "$"]), rng.random() < 0.4) for _ in range(150)]
    paths = [(f"h{rng.randrange(3)}", "/" + bit("ab/", 8)) for _ in range(400)]

    def plainly(host, path):
        hits = [(len(p), allow) for h, p, allow in given if h == host and re.match("".join(".*" if c == "*" else "$" if c == "$" else re.escape(c) for c in p), path)]
        return bool(hits) and not max(hits)[1]

    got = robots_blocked(spark.createDataFrame(paths, "host string, path string"), spark.createDataFrame(given, "host string, pattern string, allow boolean")).collect()
    assert sorted((r.host, r.path, r.blocked) for r in got) == sorted((h, p, plainly(h, p)) for h, p in paths)


def test_paths_meet_rules_by_equal_prefixes_only(spark):
    given = spark.createDataFrame([("h", "/a", False)], "host string, pattern string, allow boolean")
    plan = robots_blocked(given.select("host", F.col("pattern").alias("path")), given)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_percent_coding_keeps_the_meaning(spark):
    texts = ["/a%7Eb", "/%41%2f%e3%81%82 あ", "%", "%zz%4", "/<>", "", "🎉"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(percent_normal(F.col("t"))).collect()]
    assert got == ["/a~b", "/A%2F%E3%81%82%20%E3%81%82", "%25", "%25zz%254", "/%3C%3E", "", "%F0%9F%8E%89"]
    assert all(unquote(g) == unquote(t) for g, t in zip(got, texts, strict=True))
