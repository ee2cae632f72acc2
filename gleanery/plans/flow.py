"""Queries of the candidate flow and of hosts."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from gleanery.config import CONFIG
from gleanery.functions import scoring, urls
from gleanery.operators import candidates as cand
from gleanery.operators import discovery, hosts, metrics
from gleanery.plans.catalog import at, query
from gleanery.plans.reading import CANON
from gleanery.sources import feeds


@query(f"SELECT pos, url FROM (SELECT pos, canon AS url, row_number() OVER (PARTITION BY canon ORDER BY pos) AS place FROM (SELECT pos, {CANON.format(u='url')} AS canon FROM candidates) WHERE canon IS NOT NULL) WHERE place = 1")
def w01_dedupe_first(t):
    return cand.dedupe_first(t.candidates).select("pos", "url")


@query("SELECT url, arg_max(lastmod, pos) AS lastmod, count(*) AS seen FROM sitemap_urls GROUP BY url")
def w02_dedupe_last(t):
    return cand.dedupe_last(t.sitemap_urls)


@query("""WITH passing AS (SELECT q.post_id, CAST(q.published_at + INTERVAL 9 HOUR AS DATE) AS day, q.link_density <= 0.7 AND q.paragraph_count >= 1 AS passed, q.published_at FROM publications q), base AS (SELECT day, count(*) // 3 AS n FROM passing GROUP BY day),
    numbered AS (SELECT p.*, row_number() OVER (PARTITION BY day, passed ORDER BY published_at, post_id) AS place FROM passing p)
    SELECT post_id, CAST(epoch(CAST(day AS TIMESTAMP)) AS BIGINT) // 86400 AS day, passed, passed AND coalesce(n, 0) + place <= 150 AS admitted FROM numbered LEFT JOIN base USING (day)""")
def w03_admit_under_cap(t):
    passed = (F.col("link_density") <= CONFIG.max_link_density) & (F.col("paragraph_count") >= CONFIG.min_paragraphs)
    rows = t.publications.select("post_id", cand.jst_day(F.col("published_at")).alias("day"), passed.alias("passed"), "published_at")
    base = rows.groupBy("day").agg(F.floor(F.count("*") / 3).alias("n"))
    return cand.admit_under_cap(rows, "day", ["published_at", "post_id"], CONFIG.publish_cap, base).select("post_id", F.unix_date("day").cast("long").alias("day"), "passed", "admitted")


_SITEMAPS = """sib AS (SELECT host, root, count(lastmod) AS n, count(DISTINCT lastmod) AS d FROM sitemap_children GROUP BY host, root), known AS (SELECT DISTINCT host FROM sitemap_seen),
    cur AS (SELECT DISTINCT host, TIMESTAMP '2024-05-13' AS cursor FROM sitemap_entries WHERE host NOT IN ('m2', 'm9')),
    j AS (SELECT c.*, c.lastmod IS NOT NULL AND (TRY_CAST(c.lastmod AS TIMESTAMP) IS NULL OR TRY_CAST(c.lastmod AS TIMESTAMP) > TIMESTAMP '2024-06-02' OR (n > 1 AND d = 1)) AS pathological, c.host NOT IN (SELECT host FROM known) AS seeding, cursor
        FROM sitemap_children c JOIN sib s ON s.host = c.host AND s.root = c.root LEFT JOIN cur ON cur.host = c.host),
    kids AS (SELECT host, root, child, lastmod, pathological, seeding, NOT seeding AND NOT pathological AND coalesce(TRY_CAST(lastmod AS TIMESTAMP) <= cursor, FALSE) AS skipped FROM j)"""


@query(f"WITH {_SITEMAPS} SELECT * FROM kids")
def w04_lastmod_trust(t):
    return discovery.judged_children(t.sitemap_children, _cursors(t), t.sitemap_seen, at("2024-06-01"))


def _cursors(t):
    return t.sitemap_entries.where("host not in ('m2', 'm9')").select("host", at("2024-05-13").alias("cursor")).distinct()


_FIRST = """parents AS (SELECT DISTINCT host, root FROM kids),
    one AS (SELECT e.host, e.url FROM sitemap_entries e LEFT JOIN parents p ON p.host = e.host AND p.root = e.root LEFT JOIN kids c ON c.host = e.host AND c.root = e.root AND c.child = e.child WHERE (e.child IS NULL AND p.host IS NULL) OR NOT c.skipped),
    first AS (SELECT DISTINCT host, url FROM one EXCEPT SELECT host, url FROM sitemap_seen)"""


@query(f"""WITH {_SITEMAPS}, {_FIRST}, every AS (SELECT DISTINCT host, url FROM sitemap_entries EXCEPT SELECT host, url FROM sitemap_seen),
    f AS (SELECT host, count(*) AS found FROM first GROUP BY host), e AS (SELECT host, count(*) AS n FROM every GROUP BY host),
    r AS (SELECT host, count(DISTINCT root) AS roots FROM sitemap_entries GROUP BY host), c AS (SELECT host, count(*) AS children, count(CASE WHEN NOT skipped THEN 1 END) AS read, bool_or(skipped) AS skipped FROM kids GROUP BY host),
    o AS (SELECT r.host, roots, coalesce(children, 0) AS children, coalesce(read, 0) AS read, coalesce(found, 0) AS found, CASE WHEN r.host NOT IN (SELECT host FROM known) THEN 'seeded' WHEN skipped AND found > 3 THEN 'completed_lastmod_distrusted' ELSE 'completed' END AS outcome
        FROM r LEFT JOIN c USING (host) LEFT JOIN f USING (host))
    SELECT o.host, outcome, roots + CASE WHEN outcome = 'completed_lastmod_distrusted' THEN children ELSE read END AS sitemaps_fetched, CASE outcome WHEN 'seeded' THEN 0 WHEN 'completed' THEN found ELSE n END AS urls_new FROM o LEFT JOIN e USING (host)""")
def w04_discovery_runs(t):
    """With an alert at over 3 new URLs, for the pages are few."""
    roots = t.sitemap_entries.select("host", "root").distinct()
    _, runs = discovery.discover(roots, t.sitemap_children, t.sitemap_entries, _cursors(t), t.sitemap_seen, at("2024-06-01"), config=dataclasses.replace(CONFIG, lastmod_alert=3))
    return runs.drop("cursor")


@query("SELECT fetch_id, CAST(nth AS INT) AS nth, nth > 200 AS exhausted FROM (SELECT fetch_id, row_number() OVER (PARTITION BY host, CAST(ts AS DATE) ORDER BY ts, fetch_id) AS nth FROM fetch_log)")
def w05_request_budget(t):
    return hosts.request_budget(t.fetch_log).select("fetch_id", "nth", "exhausted")


@query("""WITH e AS (SELECT *, status IN (401, 451) AS k3, status = 403 AND purpose <> 'article' AS k5, status = 403 AND purpose = 'article' AS forbidden, status = 429 AS limited FROM fetch_log),
    hashes AS (SELECT fetch_id, robots_hash <> lag(robots_hash) OVER (PARTITION BY host ORDER BY ts, fetch_id) AS changed FROM fetch_log WHERE purpose = 'robots' AND status = 200 AND robots_hash IS NOT NULL),
    limits AS (SELECT fetch_id, ts - lag(ts) OVER (PARTITION BY host ORDER BY ts, fetch_id) < INTERVAL 24 HOUR AS again FROM e WHERE limited),
    f AS (SELECT e.*, sum(CAST(forbidden AS INT)) OVER (PARTITION BY host ORDER BY ts, fetch_id ROWS UNBOUNDED PRECEDING) AS nth, coalesce(changed, FALSE) AS changed, coalesce(again, FALSE) AS again FROM e LEFT JOIN hashes USING (fetch_id) LEFT JOIN limits USING (fetch_id)),
    g AS (SELECT *, CASE WHEN k3 THEN 'K3' WHEN k5 THEN 'K5' WHEN forbidden THEN 'K4' WHEN limited THEN 'K6' WHEN changed THEN 'K1' END AS gate, k3 OR k5 OR changed OR (forbidden AND nth >= 2) OR (limited AND again) AS stops FROM f),
    n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY stops DESC, CASE WHEN stops THEN epoch_us(ts) ELSE -epoch_us(ts) END, CASE WHEN stops THEN fetch_id ELSE -fetch_id END) AS pick FROM g WHERE gate IS NOT NULL),
    h AS (SELECT host, count(*) AS requests, max(nth) AS strikes FROM g GROUP BY host)
    SELECT h.host, gate, CASE WHEN stops AND gate = 'K1' THEN 'stopped' WHEN stops THEN 'permanent' WHEN gate = 'K4' THEN 'cool_off' WHEN gate = 'K6' THEN 'retry_after' END AS state, epoch_us(ts) AS since,
    CASE WHEN NOT stops THEN epoch_us(ts + CASE WHEN gate = 'K4' THEN INTERVAL 24 HOUR ELSE INTERVAL 1 MINUTE END) END AS until, CAST(CASE WHEN stops THEN nth ELSE h.strikes END AS INT) AS strikes, requests
    FROM h LEFT JOIN n ON n.host = h.host AND pick = 1""")
def w06_host_gate_replay(t):
    return hosts.host_gate_replay(t.fetch_log).withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("since", "until")})


@query("SELECT fetch_id, host, round(gap, 3) AS gap FROM (SELECT fetch_id, host, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY host ORDER BY ts, fetch_id)) / 1000000 AS gap FROM fetch_log) WHERE round(gap, 3) < 3000")
def w07_spacing_audit(t):
    return hosts.spacing_audit(t.fetch_log, dataclasses.replace(CONFIG, spacing_seconds=3000)).select("fetch_id", "host", "gap")


@query("""WITH c AS (SELECT id, substr(sha256(CASE WHEN id % 8 = 0 THEN 'other' ELSE original_title END || chr(0) || coalesce(original_excerpt, '')), 1, 16) AS content_hash FROM posts), p AS (SELECT id, substr(sha256(original_title || chr(0) || coalesce(original_excerpt, '')), 1, 16) AS old_hash, curation_signature FROM posts WHERE id % 10 <> 0)
    SELECT c.id, NOT coalesce(p.id IS NOT NULL AND content_hash = old_hash AND curation_signature IS NOT DISTINCT FROM 'v2', FALSE) AS needed FROM c LEFT JOIN p ON p.id = c.id""")
def j05_needs_curation(t):
    hashed = t.posts.withColumn("content_hash", scoring.content_hash(F.col("original_title"), F.col("original_excerpt")))
    found = t.posts.select("id", "url", scoring.content_hash(F.when(F.col("id") % 8 == 0, "other").otherwise(F.col("original_title")), F.col("original_excerpt")).alias("content_hash"))
    return cand.needs_curation(found, hashed.where("id % 10 != 0"), "v2").select("id", "needed")


@query("SELECT 's' || CAST(event_id AS STRING) AS url_hash, 'h' || CAST(user_id AS STRING) AS host FROM events WHERE ('h' || CAST(user_id AS STRING), 's' || CAST(event_id AS STRING)) NOT IN (SELECT (host, url_hash) FROM discovery_seen)")
def j06_new_urls(t):
    found = t.events.select(F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("url_hash"), F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("host"))
    return cand.new_urls(found, t.discovery_seen).select("url_hash", "host")


@query("SELECT r.url_hash, coalesce(p.source_id, 'unknown') AS source_id, coalesce(p.source_name, 'unknown') AS source_name, p.id IS NULL AS orphan FROM retry_queue r LEFT JOIN posts p ON p.id = CAST(substr(r.url_hash, 2) AS BIGINT)")
def j07_source_attribution(t):
    keyed = t.retry_queue.withColumn("id", F.substring("url_hash", 2, 30).cast("long"))
    return cand.attributed(keyed, t.posts).select("url_hash", "source_id", "source_name", "orphan")


@query(f"""WITH o AS (SELECT DISTINCT {CANON.format(u="url")} AS url FROM candidates WHERE pos % 10 = 0 AND pos % 3 <> 0)
    SELECT pos, CASE WHEN o.url IS NULL THEN 'invalid_url' ELSE 'published' END AS outcome FROM (SELECT pos, {CANON.format(u="url")} AS canon FROM candidates) c LEFT JOIN o ON o.url = c.canon""")
def j14_candidate_outcomes(t):
    kept = t.candidates.where("pos % 10 = 0 and pos % 3 != 0").select(urls.canonical_url(F.col("url")).alias("url"), F.lit("published").alias("outcome")).distinct()
    return cand.candidate_outcomes(t.candidates, kept).select("pos", "outcome")


@query(f"""WITH meta AS (SELECT url, title, site FROM (SELECT {CANON.format(u="url")} AS url, title, CAST(NULL AS STRING) AS site, row_number() OVER (PARTITION BY {CANON.format(u="url")} ORDER BY pos) AS n FROM candidates) WHERE n = 1 AND url IS NOT NULL)
    SELECT pos, CASE WHEN canon IS NULL THEN 'invalid_url' WHEN meta.title IS NULL THEN 'no_metadata' WHEN source_name IS NULL THEN 'no_source_name' END AS reason FROM (SELECT *, {CANON.format(u="url")} AS canon FROM candidates) c LEFT JOIN meta ON meta.url = c.canon""")
def src7_submission_candidates(t):
    pages = cand.dedupe_first(t.candidates).select("url", "title", F.lit(None).cast("string").alias("site"))
    return cand.submissions(t.candidates, pages).select("pos", "reason")


@query("SELECT pos, lo <> hi OR known AS duplicate FROM (SELECT pos, min(tag) OVER (PARTITION BY url) AS lo, max(tag) OVER (PARTITION BY url) AS hi, url IN (SELECT url FROM candidates WHERE pos % 70 = 0) AS known FROM candidates)")
def s03_cross_tag_duplicates(t):
    return cand.cross_tag_duplicates(t.candidates, t.candidates.where("pos % 70 = 0")).select("pos", "duplicate")


@query("SELECT id FROM posts WHERE id NOT IN (SELECT post_id FROM publications WHERE link_density < 0.4)")
def s02_resume_except(t):
    done = t.publications.where("link_density < 0.4").select(F.col("post_id").alias("id"))
    return cand.resume_except(t.posts, done).select("id")


@query("""WITH titled AS (SELECT pos, tag, source_name, CASE WHEN title IS NULL THEN NULL ELSE title || CASE WHEN pos % 3 = 0 AND source_name IS NOT NULL THEN ' - ' || source_name ELSE '' END END AS title, url FROM candidates),
    first AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) AS place FROM titled)
    SELECT pos, CASE WHEN source_name IS NOT NULL AND ends_with(title, ' - ' || source_name) THEN substr(title, 1, length(title) - length(source_name) - 3) ELSE title END AS title, source_name AS author FROM first WHERE place = 1""")
def src3_news_entries(t):
    suffix = F.concat(F.lit(" - "), F.col("source_name"))
    title = F.concat(F.col("title"), F.when(F.col("pos") % 3 == 0, F.coalesce(suffix, F.lit(""))).otherwise(""))
    return feeds.news_entries(t.candidates.withColumn("title", title), "pos").select("pos", "title", "author")


_ENTRIES = "SELECT page_id % 3 AS feed, page_id AS place, split_part(url, '?', 1) AS link, 'title ' || CAST(page_id AS STRING) AS title FROM pages"


@query(f"""WITH e AS ({_ENTRIES}), capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY place) AS k FROM e WHERE place % 2 = 1) WHERE k <= 10),
    s AS (SELECT 'notes' AS source_id, feed, place, link, title FROM e WHERE place % 2 = 0 UNION ALL SELECT 'blogs', feed, place, link, title FROM capped),
    one AS (SELECT *, row_number() OVER (PARTITION BY source_id, link ORDER BY feed, place) AS k FROM s), ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY feed, place) AS n FROM one WHERE k = 1)
    SELECT source_id, link AS url, title, n AS place FROM ranked WHERE n <= 20""")
def src4_unify_sources(t):
    rows = t.pages.select((F.col("page_id") % 3).alias("feed"), F.col("page_id").alias("place"), F.substring_index("url", "?", 1).alias("link"), F.concat(F.lit("title "), F.col("page_id").cast("string")).alias("title"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("timestamp").alias("published_at"))
    sources = {"notes": rows.where("place % 2 = 0"), "blogs": rows.where("place % 2 = 1")}
    return feeds.unify_sources(sources, 20, {"blogs": 10}).select("source_id", "url", "title", "place")


@query("SELECT host, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'fetched') AS fetched, count(*) FILTER (status = 'skipped') AS skipped FROM discovery_seen GROUP BY host")
def a03_discovery_status_counts(t):
    return metrics.status_counts(t.discovery_seen)


_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("processed", "published", "dropped", "promotional", "author_present"))


@query(f"SELECT host, CAST(epoch(CAST(day AS TIMESTAMP)) AS BIGINT) // 86400 AS day, {_SUMS} FROM (SELECT * FROM host_metrics UNION ALL SELECT * FROM host_metrics WHERE processed > 2) GROUP BY host, day")
def a04_host_day_metrics(t):
    out = hosts.host_day_metrics(t.host_metrics, t.host_metrics.where("processed > 2"))
    return out.withColumn("day", F.unix_date("day").cast("long"))


_BASE = """SELECT host, count(*) AS days, CASE WHEN sum(processed) > 0 THEN sum(published) / sum(processed) ELSE 0.0 END AS publish_rate, CASE WHEN sum(processed) > 0 THEN sum(promotional) / sum(processed) ELSE 0.0 END AS promotional_rate, CASE WHEN sum(published) > 0 THEN sum(author_present) / sum(published) ELSE 0.0 END AS author_rate
    FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY day DESC) AS place FROM host_metrics WHERE day < DATE '2024-01-25') WHERE place <= 7 GROUP BY host"""


@query(_BASE)
def a05_host_baseline(t):
    return hosts.host_baseline(t.host_metrics, 7, F.lit("2024-01-25").cast("date"))


@query(f"SELECT r.host, days >= 7 AND processed > 0 AND publish_rate > 0 AND published / processed < 0.5 * publish_rate AS collapsed FROM (SELECT host, sum(processed) AS processed, sum(published) AS published FROM host_metrics WHERE day = DATE '2024-01-25' GROUP BY host) r JOIN ({_BASE}) b ON b.host = r.host")
def a06_yield_collapse(t):
    run = t.host_metrics.where(F.col("day") == F.lit("2024-01-25").cast("date")).select("host", "processed", "published")
    return hosts.yield_collapse(hosts.host_baseline(t.host_metrics, 7, F.lit("2024-01-25").cast("date")), run).select("host", "collapsed")


@query("""WITH d AS (SELECT run, string_agg(reason || '=' || n, ',' ORDER BY reason) AS dropped FROM (SELECT run, outcome AS reason, count(*) AS n FROM pipeline_log WHERE outcome IN ('removed', 'extraction_insufficient', 'title_filter', 'retry_exhausted') GROUP BY run, outcome) GROUP BY run)
    SELECT p.run, count(*) + count(*) FILTER (page_id % 10 = 0) AS fetched, count(*) AS deduped, count(*) FILTER (outcome <> 'save_failed') AS inserted, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome IN ('llm_transient', 'title_filter', 'rate_capped', 'retry_exhausted', 'published')) AS evidence_passed,
    count(*) FILTER (outcome IN ('rate_capped', 'published') OR (outcome = 'retry_exhausted' AND detail = 'rate_capped')) AS title_passed, count(*) FILTER (outcome = 'published') AS cap_passed, count(*) FILTER (outcome = 'published') AS published, count(*) FILTER (outcome IN ('llm_transient', 'rate_capped', 'retry_exhausted')) AS retried, any_value(dropped) AS dropped
    FROM pipeline_log p LEFT JOIN d ON d.run = p.run GROUP BY p.run""")
def a07_stage_funnel(t):
    """Every tenth candidate is fetched twice, once with a tracking parameter."""
    twice = t.pipeline_log.where("page_id % 10 = 0").select("run", F.concat("url", F.lit("?utm_source=x")).alias("url"))
    out = metrics.stage_funnel(t.pipeline_log.select("run", "url").unionByName(twice), t.pipeline_log)
    return out.withColumn("dropped", F.array_join(F.transform("dropped", lambda x: F.concat(x["reason"], F.lit("="), x["n"].cast("string"))), ","))


def _counters(flag: str) -> str:
    parts = {"processed": "outcome NOT IN ('stale_reaped', 'time_budget', 'host_not_allowed')", "retry_exhausted": "outcome IN ('retry_exhausted', 'retry_expired')"}
    parts |= {f"failed_{c}": f"outcome = 'extraction_insufficient' AND list_contains(string_split(failed, ','), '{c}')" for c in ("text_length", "link_density", "paragraph_count", "container_not_found")}
    return ", ".join(f"CASE WHEN {flag} THEN 0 ELSE count(*) FILTER ({parts.get(c, f"outcome = '{c}'")}) END AS {c}" for c in metrics.COUNTERS)


@query(f"""WITH c AS (SELECT host, run, {_counters("bool_or(outcome = 'host_not_allowed')")}, bool_or(outcome = 'kill_gate') AS k, bool_or(outcome = 'budget') AS b, bool_or(outcome = 'retry_after') AS r, bool_or(outcome = 'time_budget') AS t, bool_or(outcome = 'host_not_allowed') AS host_not_allowed FROM discovery_log GROUP BY host, run), base AS ({_BASE})
    SELECT c.host, run, {", ".join(f"c.{n}" for n in metrics.COUNTERS)}, k AND NOT host_not_allowed AS aborted_kill_gate, b AND NOT host_not_allowed AS aborted_budget, r AND NOT host_not_allowed AS aborted_retry_after, t AND NOT host_not_allowed AS budget_exhausted, host_not_allowed,
    NOT (k OR b OR r OR host_not_allowed) AND coalesce(c.processed > 0 AND days >= 7 AND publish_rate > 0 AND c.published / c.processed < 0.5 * publish_rate, FALSE) AS yield_collapse FROM c LEFT JOIN base ON base.host = c.host""")
def a08_discovery_outcomes(t):
    rows = t.discovery_log.withColumn("failed", F.split("failed", ","))
    return metrics.discovery_outcomes(rows, hosts.host_baseline(t.host_metrics, 7, F.lit("2024-01-25").cast("date")))


_RECENT = "published_at >= TIMESTAMP '2024-04-08' - INTERVAL 30 DAY"


@query(f"""WITH f AS (SELECT *, lo <> hi OR known AS duplicate, {_RECENT} AS fresh FROM (SELECT *, min(tag) OVER (PARTITION BY url) AS lo, max(tag) OVER (PARTITION BY url) AS hi, url IN (SELECT url FROM candidates WHERE pos % 70 = 0) AS known FROM candidates)),
    v AS (SELECT DISTINCT url FROM candidates WHERE pos % 7 < 3), n AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY published_at DESC, pos) AS place FROM candidates WHERE {_RECENT}),
    e AS (SELECT tag, count(*) AS evaluated, count(*) FILTER (url IN (SELECT url FROM v)) AS passed FROM n WHERE place <= 25 GROUP BY tag),
    t AS (SELECT tag, count(*) AS fetched, count(*) FILTER (fresh) AS recent, round(100 * count(*) FILTER (duplicate) / count(*), 6) AS duplicate_percent FROM f GROUP BY tag),
    p AS (SELECT t.*, coalesce(evaluated, 0) AS evaluated, coalesce(passed, 0) AS passed, CASE WHEN evaluated > 0 THEN round(100 * passed / evaluated, 6) ELSE 0.0 END AS passed_percent FROM t LEFT JOIN e USING (tag))
    SELECT *, recent >= 3 AS enough, passed_percent >= 40 AS good, duplicate_percent <= 50 AS fresh, recent >= 3 AND passed_percent >= 40 AND duplicate_percent <= 50 AS accepted FROM p""")
def a15_source_probe(t):
    verdicts = t.candidates.where("pos % 7 < 3").select("url", F.lit(True).alias("passed"))
    return metrics.source_probe(t.candidates, t.candidates.where("pos % 70 = 0"), verdicts, at("2024-04-08"))


@query("""SELECT CASE WHEN id % 2 = 0 THEN 'main' ELSE 'control' END AS cohort, count(*) AS n, round(count(*) FILTER (author IS NULL) / count(*), 8) AS no_author, round(count(*) FILTER (original_excerpt IS NULL) / count(*), 8) AS no_excerpt, count(*) FILTER (author IS NOT NULL AND original_excerpt IS NOT NULL) AS evaluated,
    count(*) FILTER (author IS NOT NULL AND original_excerpt IS NOT NULL AND status = 'published') AS passed, round(100 * count(*) FILTER (author IS NOT NULL AND original_excerpt IS NOT NULL AND status = 'published') / count(*) FILTER (author IS NOT NULL AND original_excerpt IS NOT NULL), 6) AS passed_percent FROM posts GROUP BY 1""")
def a16_cohort_validation(t):
    return metrics.cohort_validation(t.posts, F.when(F.col("id") % 2 == 0, "main").otherwise("control"), {"no_author": "author", "no_excerpt": "original_excerpt"}, F.col("status") == "published")


@query(f"""WITH {_SITEMAPS}, log AS (SELECT id, host, outcome, finished_at IS NOT NULL AS finished FROM discovery_run), fresh AS (SELECT host, row_number() OVER (ORDER BY host) + (SELECT max(id) FROM log) AS id FROM (SELECT DISTINCT host FROM sitemap_entries)),
    n AS (SELECT host, count(*) AS n FROM sitemap_seen GROUP BY host), {_FIRST}, d AS (SELECT host, count(*) AS found FROM first GROUP BY host), c AS (SELECT host, bool_or(skipped) AS skipped FROM kids GROUP BY host)
    SELECT id, host, outcome, finished, 0 AS fetched FROM log UNION ALL SELECT id, f.host, CASE WHEN f.host = 'm3' THEN 'running' WHEN f.host NOT IN (SELECT host FROM known) THEN 'seeded' WHEN skipped AND found > {CONFIG.lastmod_alert} THEN 'completed_lastmod_distrusted' ELSE 'completed' END, f.host <> 'm3', CASE WHEN f.host = 'm3' THEN 0 ELSE coalesce(n, 0) END FROM fresh f LEFT JOIN n ON n.host = f.host LEFT JOIN d ON d.host = f.host LEFT JOIN c ON c.host = f.host""")
def m21_run_log(t):
    """Runs of the sitemaps' hosts begin and, but for one, end; the log before them stays."""
    log = t.discovery_run.select("id", "host", "started_at", "finished_at", F.lit(0).cast("long").alias("sitemaps_fetched"), F.lit(0).cast("long").alias("urls_new"), F.lit("{}").alias("status_counts"), "outcome")
    begun = hosts.started_runs(log, t.sitemap_entries, at("2024-06-01"))
    roots = t.sitemap_entries.select("host", "root").distinct()
    _, runs = discovery.discover(roots, t.sitemap_children, t.sitemap_entries, _cursors(t), t.sitemap_seen, at("2024-06-01"))
    counts = t.sitemap_seen.groupBy("host").agg(F.lit(0).alias("pending"), F.count("*").alias("fetched"), F.lit(0).alias("skipped"))
    out = hosts.finished_runs(begun, runs.where("host != 'm3'"), counts, at("2024-06-01"))
    return out.select("id", "host", "outcome", F.col("finished_at").isNotNull().alias("finished"), F.coalesce(F.get_json_object("status_counts", "$.fetched").cast("long"), F.lit(0)).alias("fetched"))


@query("SELECT host, epoch_us(CASE WHEN host IN ('m1', 'm5') THEN cursor ELSE TIMESTAMP '2024-06-01' END) AS cursor FROM (SELECT DISTINCT host FROM sitemap_entries) LEFT JOIN (SELECT DISTINCT host, TIMESTAMP '2024-05-13' AS cursor FROM sitemap_entries WHERE host NOT IN ('m2', 'm9')) USING (host)")
def m21_cursors(t):
    runs = t.sitemap_entries.select("host").distinct().withColumn("outcome", F.when(F.col("host").isin("m1", "m5"), "failed").otherwise("completed"))
    return hosts.advanced_cursors(_cursors(t), runs, at("2024-06-01")).select("host", F.unix_micros("cursor").alias("cursor"))


@query("SELECT CAST(floor(epoch(max(started_at))) AS BIGINT) AS last, CAST(date_diff('day', CAST(max(started_at) AS DATE), DATE '2024-02-15') AS INT) AS age_days, date_diff('day', CAST(max(started_at) AS DATE), DATE '2024-02-15') > 10 AS stale FROM discovery_run")
def a19_run_freshness(t):
    out = hosts.run_freshness(t.discovery_run, F.lit("2024-02-15").cast("date"))
    return out.withColumn("last", F.floor(F.col("last").cast("double")).cast("long"))


@query("SELECT host, id, CASE WHEN finished_at IS NULL THEN 'incomplete' ELSE 'ok' END AS status, outcome FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY started_at DESC, id DESC) AS place FROM discovery_run) WHERE place = 1")
def a20_run_status(t):
    return hosts.run_status(t.discovery_run)
