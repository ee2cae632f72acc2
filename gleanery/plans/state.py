"""Queries of the keyed merges and of the checks over tables."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from gleanery.config import CONFIG
from gleanery.operators import feed, merges, metrics
from gleanery.plans.catalog import at, query
from gleanery.plans.reading import FEED, STRIP, title_ok_sql
from gleanery.plans.texts import rule_sql


def _changed(posts):
    """A delta of posts: every third one with another title and status, and new ones."""
    old = posts.where("id % 3 = 0").withColumn("original_title", F.lit("new title")).withColumn("thumbnail_url", F.when(F.col("id") % 2 == 0, F.concat(F.lit("new"), F.col("url")))).withColumn("status", F.lit("pending"))
    new = posts.where("id % 50 = 0").withColumn("id", F.col("id") + 1_000_000_000).withColumn("url", F.concat(F.col("url"), F.lit("/new")))
    return old.unionByName(new)


@query("SELECT id, url, CASE WHEN id % 3 = 0 THEN 'new title' ELSE original_title END AS original_title, CASE WHEN id % 6 = 0 THEN 'new' || url WHEN id % 3 <> 0 THEN thumbnail_url END AS thumbnail_url, status, category FROM posts UNION ALL SELECT id + 1000000000, url || '/new', original_title, thumbnail_url, status, category FROM posts WHERE id % 50 = 0")
def m01_upsert_posts(t):
    return merges.upsert_posts(t.posts, _changed(t.posts)).select("id", "url", "original_title", "thumbnail_url", "status", "category")


@query("""SELECT p.id, CASE WHEN p.id % 4 = 0 AND p.id % 8 = 0 THEN 'fresh' ELSE ai_title END AS ai_title, category, CASE WHEN p.id % 4 = 0 THEN 'h' || CAST(p.id AS STRING) END AS content_hash, CASE WHEN p.id % 4 = 0 THEN 'v9' ELSE curation_signature END AS curation_signature,
    CASE WHEN p.id % 4 = 0 AND p.id NOT IN (SELECT post_id FROM removals) THEN 'published' ELSE status END AS status FROM posts p""")
def m02_mark_curated(t):
    current = t.posts.select("id", "ai_title", "category", F.lit(None).cast("string").alias("content_hash"), "curation_signature", "status")
    updates = t.posts.where("id % 4 = 0").select(
        "id", (F.col("id") % 8 == 0).alias("has_title"), F.lit("fresh").alias("ai_title"), F.lit(False).alias("has_category"), F.lit("x").alias("category"),
        F.concat(F.lit("h"), F.col("id").cast("string")).alias("content_hash"), F.lit("v9").alias("curation_signature"), F.lit("published").alias("status"),
    )
    return merges.mark_curated(current, updates, t.removals)


@query("SELECT post_id, CASE WHEN post_id % 5 = 0 THEN '{}' ELSE criteria_json END AS criteria_json, CASE WHEN post_id % 5 = 0 THEN 'v9' ELSE signature END AS signature FROM criteria")
def m03_merge_criteria(t):
    delta = t.criteria.where("post_id % 5 = 0").select("post_id", F.lit("{}").alias("criteria_json"), F.lit("v9").alias("signature"))
    return merges.latest(t.criteria, delta, ["post_id"])


@query("SELECT post_id, topic_anchor, CASE WHEN post_id % 2 = 0 AND evidence_sufficient AND topic_anchor IS NOT NULL AND rationale_text IS NOT NULL THEN 'again' ELSE rationale_text END AS rationale_text FROM rationales")
def m04_merge_rationales(t):
    delta = t.rationales.where("post_id % 2 = 0").withColumn("rationale_text", F.when(F.col("rationale_text").isNotNull(), "again"))
    return merges.merge_rationales(t.rationales, delta).select("post_id", "topic_anchor", "rationale_text")


@query("SELECT post_id, position, topic FROM topics WHERE post_id % 6 <> 0 UNION ALL SELECT id, 0, 'a' FROM posts WHERE id % 6 = 0 AND id % 12 <> 0 UNION ALL SELECT id, 1, 'b' FROM posts WHERE id % 6 = 0 AND id % 12 <> 0")
def m05_replace_topics(t):
    lists = t.posts.where("id % 6 = 0").select(F.col("id").alias("post_id"), F.when(F.col("id") % 12 != 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("topics"))
    return merges.replace_topics(t.topics, lists)


_AGAIN = "SELECT url_hash, url, host, 'submit' AS lane, 'rate_capped' AS reason FROM retry_queue WHERE lane = 'rss' UNION ALL SELECT 'n' || CAST(event_id AS STRING), 'https://new.example.com/' || CAST(event_id AS STRING), 'new.example.com', 'evergreen', 'llm_transient' FROM events WHERE event_type = 'view' AND event_id % 7 = 0"


@query(f"""WITH f AS ({_AGAIN}), j AS (SELECT coalesce(q.url_hash, f.url_hash) AS url_hash, coalesce(f.url, q.url) AS url, coalesce(f.lane, q.lane) AS lane, coalesce(f.reason, q.reason) AS reason, coalesce(attempts, 0) AS old, f.url_hash IS NOT NULL AS again,
        coalesce(first_queued_at, TIMESTAMP '2024-01-20') AS first_queued_at, next_attempt_at, expires_at FROM retry_queue q FULL JOIN f ON f.url_hash = q.url_hash)
    SELECT url_hash, url, lane, reason, old + CAST(again AS INT) AS attempts, epoch_us(first_queued_at) AS first_queued_at, epoch_us(CASE WHEN NOT again THEN next_attempt_at WHEN old = 0 THEN TIMESTAMP '2024-01-20 01:00:00' WHEN old = 1 THEN TIMESTAMP '2024-01-20 06:00:00' ELSE TIMESTAMP '2024-01-21' END) AS next_attempt_at,
    epoch_us(CASE WHEN again THEN first_queued_at + INTERVAL 72 HOUR ELSE expires_at END) AS expires_at, again AND old >= 3 AS terminal FROM j""")
def m06_schedule_retries(t):
    new = t.events.where("event_type = 'view' and event_id % 7 = 0").selectExpr("concat('n', event_id) AS url_hash", "concat('https://new.example.com/', event_id) AS url", "'new.example.com' AS host", "'evergreen' AS lane", "'llm_transient' AS reason")
    again = t.retry_queue.where("lane = 'rss'").select("url_hash", "url", "host", F.lit("submit").alias("lane"), F.lit("rate_capped").alias("reason"))
    out = merges.schedule_retries(t.retry_queue, again.unionByName(new), at("2024-01-20"))
    return out.select("url_hash", "url", "lane", "reason", "attempts", *(F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("first_queued_at", "next_attempt_at", "expires_at")), "terminal")


_OVER = "SELECT *, CASE WHEN expires_at <= TIMESTAMP '2024-01-20' AND lane IN ('rss', 'discovery') THEN 'retry_exhausted:' || reason || CASE WHEN lane = 'discovery' THEN ':attempts=' || CAST(attempts AS STRING) ELSE '' END ELSE 'kept' END AS outcome FROM retry_queue"


@query(f"SELECT url_hash, outcome FROM ({_OVER})")
def m07_expire_retries(t):
    return merges.expire_retries(t.retry_queue, at("2024-01-20"), ["rss", "discovery"]).select("url_hash", "outcome")


@query(f"""WITH o AS ({_OVER}), gone AS (SELECT * FROM o WHERE outcome <> 'kept'), stored AS (SELECT url, host, 'Stored ' || url_hash AS original_title, CASE WHEN attempts % 2 = 0 THEN 'published' ELSE 'pending' END AS status, attempts % 2 = 0 AS removed FROM retry_queue WHERE attempts < 3)
    SELECT url, host, original_title, CASE WHEN removed THEN 'retracted' WHEN url IN (SELECT url FROM gone) THEN 'rejected' ELSE status END AS status, CASE WHEN removed THEN 'earlier' ELSE (SELECT any_value(outcome) FROM gone WHERE gone.url = stored.url) END AS reason FROM stored
    UNION ALL SELECT url, host, url, 'rejected', outcome FROM gone WHERE url NOT IN (SELECT url FROM stored)""")
def m07_retry_drops(t):
    """Expired urls as dropped posts, some of which are stored, some removed already."""
    stored = t.retry_queue.where("attempts < 3")
    posts = stored.select(F.substring("url_hash", 2, 30).cast("long").alias("id"), "url", "host", F.concat(F.lit("Stored "), "url_hash").alias("original_title"), F.when(F.col("attempts") % 2 == 0, "published").otherwise("pending").alias("status"))
    removals = posts.where("status = 'published'").select(F.col("id").alias("post_id"), F.lit("retracted").alias("kind"), F.lit("earlier").alias("reason"), at("2024-01-01").alias("removed_at"))
    after, removed = merges.dropped_retries(posts, removals, merges.expire_retries(t.retry_queue, at("2024-01-20"), ["rss", "discovery"]), at("2024-01-20"))
    return after.join(removed.select(F.col("post_id").alias("id"), "reason"), "id", "left").select("url", "host", "original_title", "status", "reason")


@query("SELECT post_id, CASE WHEN post_id % 4 = 0 THEN 'body' ELSE hash_kind END AS hash_kind, CASE WHEN post_id % 4 = 0 AND post_id % 8 <> 0 THEN 7 ELSE text_length END AS text_length, link_density FROM publications UNION ALL SELECT post_id + 1000000000, 'body', CASE WHEN post_id % 8 <> 0 THEN 7 END, NULL FROM publications WHERE post_id % 100 = 0")
def m08_record_publications(t):
    base = t.publications.select("post_id", "hash_kind", "text_length", "link_density")
    change = lambda rows: rows.select("post_id", F.lit("body").alias("hash_kind"), F.when(F.col("k") % 8 != 0, 7).alias("text_length"), F.lit(None).cast("double").alias("link_density"))
    keyed = base.withColumn("k", F.col("post_id"))
    delta = change(keyed.where("post_id % 4 = 0")).unionByName(change(keyed.where("post_id % 100 = 0").withColumn("post_id", F.col("post_id") + 1_000_000_000)))
    return merges.record_publications(base, delta)


@query("SELECT p.id, CASE WHEN r.kind = 'retracted' THEN 'retracted' WHEN r.kind IS NOT NULL THEN 'rejected' ELSE p.status END AS status, r.reason AS removed_for FROM posts p LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY removed_at, kind) AS place FROM removals) WHERE place = 1) r ON r.post_id = p.id")
def m09_apply_removals(t):
    return merges.apply_removals(t.posts, t.removals).select("id", "status", "removed_for")


@query("SELECT id, url, status, id IN (SELECT post_id FROM removals) AS already_removed FROM posts WHERE host IN ('src3.example.com', 'src5.example.com') AND status = 'published'")
def m10_retraction_plan(t):
    hosts = t.posts.where("host in ('src3.example.com', 'src5.example.com')").select("host")
    return merges.retraction_plan(t.posts, t.removals, hosts=hosts)


@query("SELECT post_id, kind, reason FROM removals UNION ALL SELECT id, 'retracted', 'asked for' FROM posts WHERE id % 17 < 2 AND id NOT IN (SELECT post_id FROM removals)")
def m10_retract_urls(t):
    plan = merges.retraction_plan(t.posts, t.removals, urls=t.posts.where("id % 17 < 2").select("url"))
    return merges.retract(t.posts, t.removals, plan, "asked for", at("2024-08-01")).select("post_id", "kind", "reason")


@query("SELECT id AS post_id, 'dropped' AS kind, 'stale_pending' AS reason FROM posts WHERE id % 4 = 0 AND created_at <= TIMESTAMP '2024-02-03 05:00:00' - INTERVAL 72 HOUR + INTERVAL 2 DAY")
def m11_reap_stale(t):
    pending = t.posts.withColumn("status", F.when(F.col("id") % 4 == 0, "pending").otherwise("published"))
    return merges.reap_stale(pending, at("2024-02-05 05:00:00"))


@query("SELECT url_hash, host, status FROM discovery_seen UNION ALL SELECT 's' || CAST(event_id AS STRING), 'h' || CAST(user_id AS STRING), 'pending' FROM events WHERE event_id % 3 = 0")
def m12_seed_discovery(t):
    found = t.events.select(F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("url_hash"), F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("host"))
    return merges.seed_discovery(t.discovery_seen, found)


@query("SELECT url_hash, lane FROM retry_queue WHERE CAST(substr(url_hash, 2) AS BIGINT) % 4 <> 0")
def m23_complete_retries(t):
    done = t.retry_queue.where(F.substring("url_hash", 2, 30).cast("long") % 4 == 0)
    return merges.complete_retries(t.retry_queue, done).select("url_hash", "lane")


_FIELDS = " UNION ALL ".join(f"SELECT s.id, '{f}' AS field, s.{f} AS before, c.{f} AS after FROM snapshot s JOIN current c ON c.id = s.id WHERE s.{f} IS DISTINCT FROM c.{f}" for f in ("title", "lang", "source"))


@query(f"{_FIELDS} UNION ALL SELECT id, 'missing_now', NULL, NULL FROM snapshot WHERE id NOT IN (SELECT id FROM current) UNION ALL SELECT id, 'extra_now', NULL, NULL FROM current WHERE id NOT IN (SELECT id FROM snapshot)")
def j08_snapshot_diff(t):
    return merges.restore_plan({"posts": (t.snapshot, t.current, "id", ["title", "lang", "source"])})["posts"]


@query("SELECT id, CASE WHEN s.id IS NULL THEN c.title ELSE s.title END AS title, CASE WHEN s.id IS NULL THEN c.lang ELSE s.lang END AS lang, coalesce(s.source, c.source) AS source FROM snapshot s FULL JOIN current c USING (id)")
def j08_restored(t):
    return merges.restored(t.current, t.snapshot, "id", ["title", "lang", "source"], insert=True)


@query("SELECT rule, count(*) AS n FROM (SELECT 'one_removal_per_post' AS rule FROM removals GROUP BY post_id HAVING count(*) > 1 UNION ALL SELECT 'topic_unique' FROM topics GROUP BY post_id, topic HAVING count(*) > 1) GROUP BY rule")
def c04_key_constraints(t):
    return metrics.key_violations(t.posts, t.topics, t.removals)


@query("SELECT 'original_excerpt' AS column_name, count(original_excerpt) AS n FROM posts UNION ALL SELECT 'ai_summary', count(ai_summary) FROM posts")
def c01_columns_not_allowed(t):
    return metrics.columns_not_allowed(t.posts, set(t.posts.columns) - {"original_excerpt", "ai_summary"})


@query(f"""WITH live AS (SELECT * FROM ({FEED}) WHERE status = 'published'), n AS (SELECT post_id, row_number() OVER (PARTITION BY CAST(published_at + INTERVAL 9 HOUR AS DATE) ORDER BY published_at, post_id) AS place FROM publications WHERE post_id IN (SELECT id FROM live))
    SELECT id, 'title' AS rule FROM live WHERE NOT {title_ok_sql("coalesce(original_title, '')")} UNION ALL SELECT id, 'anchor_length' FROM live WHERE length({STRIP.format(x="topic_anchor")}) < 6 UNION ALL SELECT id, 'anchor_pii' FROM live WHERE {rule_sql("topic_anchor")} IS NOT NULL
    UNION ALL SELECT id, 'rationale_length' FROM live WHERE length(rationale_text) NOT BETWEEN 38 AND 210 UNION ALL SELECT id, 'evidence' FROM live WHERE NOT coalesce(evidence_sufficient, FALSE) UNION ALL SELECT post_id, 'daily_cap' FROM n WHERE place > 20""")
def c03_publish_invariants(t):
    """With a cap of 20 a day, for a day has few publications."""
    rationales = t.rationales
    return metrics.publish_violations(feed.feed_join(t.posts, rationales, t.criteria), t.publications, dataclasses.replace(CONFIG, publish_cap=20))


@query(f"SELECT id FROM ({FEED}) WHERE contains(lower(to_json({{'id': id, 'topic_anchor': topic_anchor, 'rationale_text': rationale_text}})), 'tion the') OR contains(lower(to_json({{'id': id, 'topic_anchor': topic_anchor, 'rationale_text': rationale_text}})), 'because er')")
def c02_scan_for_leaks(t):
    rows = feed.feed_join(t.posts, t.rationales, t.criteria).select("id", "topic_anchor", "rationale_text")
    terms = rows.sparkSession.createDataFrame([("TION the",), ("because er",), ("abc",)], "term string")
    return metrics.leaking_rows(rows, terms, "term").select("id")
