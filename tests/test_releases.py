"""Releases of several tables, publications into them, extracts, and the counts of runs."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from gleanery.operators import merges, metrics
from gleanery.sources import feeds
from gleanery.sources.releases import Releases

START = dt.datetime(2024, 1, 1)
POSTS = "id long, url string, host string, source_type string, source_id string, source_name string, original_title string, original_excerpt string, author string, thumbnail_url string, published_at timestamp, ai_summary string, ai_title string, category string, tag string, content_hash string, curation_signature string, status string, created_at timestamp, updated_at timestamp"
JUDGED = "url string, host string, lane string, title string, excerpt string, outcome string, detail string, summary string, category string, tag string, criteria_json string, topic_anchor string, rationale_text string, topics array<string>, text_length int, link_density double, paragraph_count int, body_hash string"


def post(k, status="pending"):
    return (k, f"u{k}", "h", "blog", "s", "S", f"t{k}", None, None, None, None, None, None, None, None, None, None, status, START, START)


def judged(url, lane, outcome, title="T", detail=None, topics=("a",), excerpt="x"):
    return (url, "h", lane, title, excerpt, outcome, detail, "sum", "cat", "trend", "{}", "anchor", "why", list(topics), 100, 0.25, 2, "bh")


def store(spark, path):
    made = Releases(spark, f"file://{path}/store")
    tables = {
        "posts": spark.createDataFrame([post(1), post(2), post(3, "retracted")], POSTS), "criteria": spark.createDataFrame([(1, "old", "v0", "m")], "post_id long, criteria_json string, signature string, model_id string"),
        "rationales": spark.createDataFrame([(1, "old", "old", "v0", True)], "post_id long, topic_anchor string, rationale_text string, prompt_version string, evidence_sufficient boolean"),
        "topics": spark.createDataFrame([(1, 0, "old"), (2, 0, "kept")], "post_id long, position int, topic string"),
        "publications": spark.createDataFrame([], "post_id long, published_at timestamp, hash_kind string, body_hash string, text_length int, link_density double, paragraph_count int"),
        "removals": spark.createDataFrame([(3, "retracted", "asked", START)], "post_id long, kind string, reason string, removed_at timestamp"),
    }
    assert made.last() == -1 and made.write(tables) == 0
    return made


def outcomes(spark):
    rows = [judged("u1", "rss", "accepted"), judged("u2", "rss", "title_filter"), judged("u3", "rss", "accepted"), judged("n1", "discovery", "accepted", topics=()), judged("n2", "discovery", "extraction_insufficient", title=None, detail="text_length,link_density"), judged("n3", "discovery", "extraction_insufficient"), judged("n4", "discovery", "title_filter", detail="x"), judged("lost", "rss", "title_filter")]
    return spark.createDataFrame(rows, JUDGED)


def now():
    return F.lit("2024-02-01").cast("timestamp")


def test_publication_goes_through_every_merge(spark, tmp_path):
    made = store(spark, tmp_path)
    assert merges.publish_outcomes(made, outcomes(spark), now(), "v1", "m1") == 1
    posts = {r.url: r for r in made.read("posts").collect()}
    assert {u: r.status for u, r in posts.items()} == {"u1": "published", "u2": "rejected", "u3": "retracted", "n1": "published", "n2": "rejected", "n3": "rejected", "n4": "rejected"}
    assert {u: r.tag for u, r in posts.items() if r.tag} == {"u1": "trend", "u3": "trend", "n1": "classic"}
    assert posts["n2"].original_title == "n2" and posts["n3"].original_title == "T" and posts["u1"].original_title == "t1" and posts["n1"].original_excerpt is None
    assert posts["u1"].content_hash != posts["n1"].content_hash and posts["u1"].curation_signature == "v1"
    url = {r.id: u for u, r in posts.items()}
    assert {url[r.post_id]: r.reason for r in made.read("removals").collect()} == {"u2": "title_filter", "u3": "asked", "n2": "extraction_insufficient:text_length,link_density", "n3": "extraction_insufficient:unknown", "n4": "title_filter:x"}
    assert {url[r.post_id]: (r.hash_kind, r.text_length) for r in made.read("publications").collect()} == {"u1": ("surrogate", None), "n1": ("body", 100)}
    assert sorted((url[r.post_id], r.topic) for r in made.read("topics").collect()) == [("u1", "a"), ("u2", "kept"), ("u3", "a")]
    assert {url[r.post_id]: r.criteria_json for r in made.read("criteria").collect()} == {"u1": "{}", "u3": "{}", "n1": "{}"}
    assert {url[r.post_id]: r.rationale_text for r in made.read("rationales").collect()} == {"u1": "why", "u3": "why", "n1": "why"}
    # the same once more changes nothing
    before = {n: sorted(map(repr, made.read(n).drop("updated_at").collect())) for n in ("posts", "removals", "topics", "publications")}
    assert merges.publish_outcomes(made, outcomes(spark), now(), "v1", "m1") == 2
    assert {n: sorted(map(repr, made.read(n).drop("updated_at").collect())) for n in before} == before


def test_a_run_stopped_half_way_changes_nothing(spark, tmp_path):
    made = store(spark, tmp_path)
    before = {n: sorted(map(repr, made.read(n).collect())) for n in ("posts", "topics", "removals", "publications")}

    def stop(n):
        assert os.path.isdir(tmp_path / "store" / "posts" / f"{n:09d}")
        raise RuntimeError("power")

    with pytest.raises(RuntimeError, match="power"):
        merges.publish_outcomes(made, outcomes(spark), now(), "v1", "m1", before_commit=stop)
    assert made.last() == 0 and {n: sorted(map(repr, made.read(n).collect())) for n in before} == before
    os.makedirs(tmp_path / "store" / "manifests" / "000000001")  # a manifest that wasn't finished counts as none
    assert made.last() == 0
    assert merges.publish_outcomes(made, outcomes(spark), now(), "v1", "m1") == 1 and made.last() == 1
    assert {n: sorted(map(repr, made.read(n, 0).collect())) for n in before} == before  # readers of the release before


def test_release_of_some_tables_keeps_the_others(spark, tmp_path):
    made = Releases(spark, f"file://{tmp_path}/s")
    made.write({"a": spark.range(2), "b": spark.range(3)})
    assert made.write({"a": spark.range(5)}) == 1
    assert made.manifest(1) == {"a": 1, "b": 0} and made.read("a").count() == 5 and made.read("b").count() == 3 and made.read("a", 0).count() == 2


def test_extract_by_three_keys(spark, tmp_path):
    posts = spark.createDataFrame([(k, f" HTTP://h/{k}", f"h{k % 2}", START + dt.timedelta(days=k) if k else None, "é" * (498 + k)) for k in range(5)], "id long, url string, host string, published_at timestamp, original_excerpt string")
    retries = posts.select(F.sha2(F.concat(F.lit("http://h/"), F.col("id").cast("string")), 256).alias("url_hash"), F.lit(None).cast("string").alias("note"))
    gates = spark.createDataFrame([("h0",), ("h1",), ("h9",)], "host string")
    parts = feeds.consistent_extract(posts, 2, by_post={"p": posts.select(F.col("id").alias("post_id"))}, by_url={"r": retries}, by_host={"g": gates}, since=F.lit("2024-01-03").cast("timestamp"))
    assert sorted(r.id for r in parts["posts"].collect()) == [3, 4] and {len(r.original_excerpt) for r in parts["posts"].collect()} == {501}
    counts = {r.table_name: r.n for r in feeds.write_json_lines(parts | {"none": gates.limit(0)}, f"file://{tmp_path}/x").collect()}
    assert counts == {"posts": 2, "p": 2, "r": 2, "g": 2, "none": 0}
    lines = [json.loads(line) for f in (tmp_path / "x" / "r").glob("*.json") for line in f.read_text().splitlines()]
    assert len(lines) == 2 and all(line["note"] is None for line in lines)


def test_counters_and_flags_of_runs(spark):
    log = [("h", 1, o, f) for o, f in [("published", None), ("extraction_insufficient", ["text_length", "link_density"]), ("extraction_insufficient", ["container_not_found"]), ("extraction_insufficient", None), ("retry_expired", None), ("stale_reaped", None), ("not_modified", None), ("robots", None)]]
    log += [("h", 2, "published", None), ("h", 2, "kill_gate", None), ("x", 1, "host_not_allowed", None), ("x", 1, "published", None), ("b", 1, "budget", None), ("b", 2, "time_budget", None), ("b", 2, "no_title", None), ("b", 3, "retry_after", None)]
    base = spark.createDataFrame([("h", 7, 0.5), ("b", 6, 0.9)], "host string, days long, publish_rate double")
    got = {(r.host, r.run): r.asDict() for r in metrics.discovery_outcomes(spark.createDataFrame(log, "host string, run int, outcome string, failed array<string>"), base).collect()}
    assert {len(r) for r in got.values()} == {2 + 20 + 6}
    on = lambda key: {k: v for k, v in got[key].items() if v and k not in ("host", "run")}
    assert on(("h", 1)) == {"processed": 7, "published": 1, "extraction_insufficient": 3, "failed_text_length": 1, "failed_link_density": 1, "failed_container_not_found": 1, "retry_expired": 1, "retry_exhausted": 1, "stale_reaped": 1, "robots": 1, "yield_collapse": True}
    assert on(("h", 2)) == {"processed": 2, "published": 1, "aborted_kill_gate": True}
    assert on(("x", 1)) == {"host_not_allowed": True}
    assert on(("b", 1)) == {"processed": 1, "aborted_budget": True} and on(("b", 2)) == {"processed": 1, "no_title": 1, "budget_exhausted": True} and on(("b", 3)) == {"processed": 1, "aborted_retry_after": True}


def test_funnel_of_a_run(spark):
    fetched = spark.createDataFrame([(1, f"http://a.b/{u}") for u in ("a", "a?utm_x=1", "b", "c", "d", "e", "f", "g", "h", "i")] + [(1, "mailto:x"), (2, "http://a.b/z")], "run int, url string")
    done = [("a", "published", None), ("b", "save_failed", None), ("c", "skipped", None), ("d", "extraction_insufficient", None), ("e", "title_filter", None), ("f", "rate_capped", None), ("g", "retry_exhausted", "llm_transient"), ("h", "retry_exhausted", "rate_capped"), ("i", "removed", None)]
    outcomes_ = spark.createDataFrame([(1, f"http://a.b/{u}", o, d) for u, o, d in done], "run int, url string, outcome string, detail string")
    rows = {r.run: r for r in metrics.stage_funnel(fetched, outcomes_).collect()}
    one = rows[1]
    assert (one.fetched, one.deduped, one.inserted, one.skipped, one.evidence_passed, one.title_passed, one.cap_passed, one.published, one.retried) == (11, 9, 8, 1, 5, 3, 1, 1, 3)
    assert {(d.reason, d.n) for d in one.dropped} == {("extraction_insufficient", 1), ("removed", 1), ("retry_exhausted", 2), ("title_filter", 1)}
    assert (rows[2].fetched, rows[2].deduped, rows[2].published) == (1, 1, 0)
