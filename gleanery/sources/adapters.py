"""Inputs of the curation jobs derived from the driver's tables.

Each is one SELECT in the SQL that Spark and DuckDB share, so that a job and its SQL check start from the
same rows. ``k`` is the row's integer key; nothing is random.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from gleanery.sources.tables import small_batches, spread, table

INPUTS: dict[str, str] = {
    "posts": """SELECT doc_id AS id, 'https://' || source || '.example.com/a/' || CAST(doc_id AS STRING) AS url, source || '.example.com' AS host,
        'blog' AS source_type, source AS source_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'Site ' || source END AS source_name,
        substr(split_part(text, chr(10), 1), 1, 60) AS original_title, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE substr(text, 1, 600) END AS original_excerpt,
        CASE WHEN doc_id % 6 = 0 THEN NULL ELSE 'author ' || lang END AS author, CASE WHEN doc_id % 8 = 0 THEN NULL ELSE 'https://img.example.com/' || CAST(doc_id AS STRING) END AS thumbnail_url,
        CASE WHEN doc_id % 11 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' HOUR END AS published_at,
        CASE WHEN doc_id % 7 = 0 THEN NULL ELSE substr(text, 1, 30) END AS ai_title, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE substr(text, 1, 120) END AS ai_summary,
        CASE WHEN doc_id % 23 = 0 THEN NULL ELSE 'cat' || CAST(doc_id % 11 AS STRING) END AS category,
        CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'trend' ELSE 'classic' END AS tag,
        CASE WHEN doc_id % 17 = 0 THEN 'rejected' WHEN doc_id % 19 = 0 THEN 'retracted' ELSE 'published' END AS status,
        CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'v' || CAST(doc_id % 4 AS STRING) END AS curation_signature,
        TIMESTAMP '2024-02-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS created_at, TIMESTAMP '2024-03-01 00:00:00' + (doc_id * 7 % 1000) * INTERVAL '1' MINUTE AS updated_at
        FROM documents""",
    "criteria": """SELECT doc_id AS post_id, CASE
        WHEN doc_id % 31 = 0 THEN '{"firsthand":3,'
        WHEN doc_id % 29 = 0 THEN '{"firsthand":' || CAST(doc_id * 7 % 10 AS STRING) || ',"specific":' || CAST(doc_id * 11 % 10 AS STRING) || ',"weddingDayContent":' || CAST(doc_id * 13 % 10 AS STRING) || ',"promotional":' || CAST(doc_id * 17 % 10 AS STRING) || '}'
        WHEN doc_id % 37 = 0 THEN '{"firsthand":true,"ceremonyDecision":true,"specific":false,"weddingDayContent":true,"promotional":"light"}'
        ELSE '{"firsthand":' || CAST(doc_id * 7 % 10 AS STRING) || ',"ceremonyDecision":' || CAST(doc_id * 3 % 10 AS STRING) || ',"specific":' || CAST(doc_id * 11 % 10 AS STRING) || ',"weddingDayContent":' || CAST(doc_id * 13 % 10 AS STRING) || ',"promotional":' || CASE WHEN doc_id % 41 = 0 THEN '"heavy"' ELSE CAST(doc_id * 17 % 10 AS STRING) END || '}'
        END AS criteria_json, 'v' || CAST(doc_id % 3 AS STRING) AS signature FROM documents WHERE doc_id % 43 <> 0""",
    "rationales": """SELECT doc_id AS post_id, substr(text, 1, 5 + doc_id % 30) AS topic_anchor, CASE WHEN doc_id % 8 = 0 THEN NULL ELSE 'because ' || substr(text, 1, 20 + doc_id % 60) END AS rationale_text,
        CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 10 = 0 THEN 'legacy-1' ELSE 'p' || CAST(doc_id % 2 AS STRING) END AS prompt_version, doc_id % 12 <> 0 AS evidence_sufficient FROM documents WHERE doc_id % 3 <> 0""",
    "topics": """SELECT doc_id AS post_id, CAST(p.position AS INT) AS position, CASE WHEN (doc_id + p.position) % 9 = 0 THEN '演出' ELSE split_part(text, ' ', CAST(p.position + 1 AS INT)) END AS topic
        FROM documents, (SELECT 0 AS position UNION ALL SELECT 1 UNION ALL SELECT 2) p WHERE p.position < doc_id % 4""",
    "publications": """SELECT doc_id AS post_id, TIMESTAMP '2024-05-01 00:00:00' + (doc_id * 13 % 5000) * INTERVAL '1' MINUTE AS published_at, CASE WHEN doc_id % 2 = 0 THEN 'body' ELSE 'surrogate' END AS hash_kind,
        CAST(n_chars AS INT) AS text_length, CAST(doc_id % 90 AS DOUBLE) / 100 AS link_density, CAST(doc_id % 5 AS INT) AS paragraph_count FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""",
    "removals": """SELECT doc_id AS post_id, CASE WHEN doc_id % 17 = 0 THEN 'dropped' ELSE 'retracted' END AS kind, 'reason' || CAST(doc_id % 5 AS STRING) AS reason, TIMESTAMP '2024-06-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS removed_at
        FROM documents WHERE doc_id % 17 = 0 OR doc_id % 19 = 0 UNION ALL
        SELECT doc_id, 'retracted', 'later', TIMESTAMP '2024-07-01 00:00:00' + doc_id * INTERVAL '1' MINUTE FROM documents WHERE doc_id % 34 = 0""",
    "odd_urls": """SELECT page_id * 10 + v.n AS pos, page_id, v.n AS n, CASE v.n WHEN 0 THEN 'HTTP://WWW.Host' || CAST(page_id AS STRING) || '.example.com:80/Path/./x/../' WHEN 1 THEN 'https://h.example.com:443/p/' || CAST(page_id AS STRING) || '?a=1&&b=2'
        WHEN 2 THEN 'https://h.example.com/p?utm%5Fsource=x&q=a%20b&c&k=' || CAST(page_id AS STRING) || '#Top' WHEN 3 THEN '  https://h.example.com:8080/猫/' || CAST(page_id AS STRING) || '//?FBCLID=1 ' WHEN 4 THEN 'https://h.example.com/a/%2e%2E/b c?q="' || CAST(page_id AS STRING) || '"'
        WHEN 5 THEN 'https://bad host/' || CAST(page_id AS STRING) WHEN 6 THEN 'https://h.example.com:70000/' ELSE 'https://u:p@H.example.com/?' END AS url FROM pages, (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) v""",
    "articles": """SELECT page_id, url, lower(split_part(split_part(url, '://', 2), '/', 1)) AS host, replace(replace(replace(replace(html, '<body>', '<body><header><h1>Site name</h1></header>'), '<p>', CASE page_id % 3 WHEN 0 THEN '<p>　' WHEN 1 THEN '<p>\u00a0' ELSE '<p>&nbsp;' END),
        '<title>', CASE page_id % 8 WHEN 0 THEN '<title>　' WHEN 1 THEN '<title></title><x>' ELSE '<title>' END), '<h1>', CASE page_id % 5 WHEN 0 THEN '<h2>' ELSE '<h1 class="t">　' END) AS html FROM pages""",
    "titles": """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN repeat('●○▲', 4) || source WHEN 1 THEN repeat('😀★☂', 4) || source WHEN 2 THEN '　' || substr(text, 1, 1) || '　' WHEN 3 THEN substr(text, 1, 3) || '!!!!' WHEN 4 THEN substr(text, 1, 3) || '\u2003\u2003\u2003\u2003' || source WHEN 5 THEN repeat('☂', 10) || source
        WHEN 6 THEN repeat('☂✈', 6) || source WHEN 7 THEN substr(text, 1, 5) || chr(7) ELSE split_part(text, chr(10), 1) END AS title FROM documents""",
    "discovery_log": """SELECT 'h' || CAST(user_id AS STRING) AS host, CAST(event_id % 3 AS INT) AS run, CASE WHEN event_id % 1009 = 7 THEN 'kill_gate' WHEN event_id % 1009 = 8 THEN 'budget' WHEN event_id % 1009 = 9 THEN 'retry_after' WHEN event_id % 1009 = 10 THEN 'time_budget' WHEN user_id % 40 = 3 THEN 'host_not_allowed' ELSE
        CASE event_id % 21 WHEN 0 THEN 'title_filter' WHEN 1 THEN 'anchor_ungrounded' WHEN 2 THEN 'rate_capped' WHEN 3 THEN 'path_not_allowed' WHEN 4 THEN 'robots' WHEN 5 THEN 'gone' WHEN 6 THEN 'too_large' WHEN 7 THEN 'no_title' WHEN 8 THEN 'enqueued' WHEN 9 THEN 'retry_exhausted' WHEN 10 THEN 'removed'
        WHEN 11 THEN 'retry_expired' WHEN 12 THEN 'stale_reaped' WHEN 13 THEN 'not_modified' WHEN 14 THEN 'extraction_insufficient' WHEN 15 THEN 'extraction_insufficient' ELSE CASE WHEN user_id % 5 = 0 THEN 'no_title' ELSE 'published' END END END AS outcome,
        CASE WHEN event_id % 42 = 14 THEN 'container_not_found' WHEN event_id % 42 = 15 THEN 'text_length,link_density' WHEN event_id % 42 = 35 THEN 'paragraph_count' ELSE 'text_length' END AS failed FROM events""",
    "pipeline_log": """SELECT page_id, CAST(page_id % 4 AS INT) AS run, 'https://p.example.com/' || CAST(page_id AS STRING) AS url, CASE page_id % 11 WHEN 0 THEN 'save_failed' WHEN 1 THEN 'skipped' WHEN 2 THEN 'removed' WHEN 3 THEN 'extraction_insufficient' WHEN 4 THEN 'llm_transient' WHEN 5 THEN 'title_filter' WHEN 6 THEN 'rate_capped'
        WHEN 7 THEN 'retry_exhausted' ELSE 'published' END AS outcome, CASE WHEN page_id % 2 = 0 THEN 'rate_capped' ELSE 'llm_transient' END AS detail FROM pages""",
    "graded": """SELECT 'https://' || source || '.example.com/a/' || CAST(doc_id AS STRING) AS url, source || '.example.com' AS host, 'rss' AS lane, substr(split_part(text, chr(10), 1), 1, 60) AS title, substr(text, 1, 600) AS excerpt, CASE WHEN doc_id % 5 = 0 THEN 'title_filter' ELSE 'accepted' END AS outcome, CAST(NULL AS STRING) AS detail,
        'sum ' || CAST(doc_id AS STRING) AS summary, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'cat9' END AS category, 'trend' AS tag, '{"firsthand":5}' AS criteria_json, 'anchor ' || CAST(doc_id AS STRING) AS topic_anchor, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'because' END AS rationale_text, 'a|b' AS topics, 100 AS text_length, 0.5 AS link_density, 2 AS paragraph_count, 'bh' AS body_hash
        FROM documents WHERE doc_id % 2 = 0 UNION ALL
        SELECT 'https://d.example.com/' || CAST(page_id AS STRING), 'd.example.com', 'discovery', CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'Page ' || CAST(page_id AS STRING) END, NULL, CASE page_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'extraction_insufficient' ELSE 'title_filter' END, CASE WHEN page_id % 6 = 1 THEN 'text_length,link_density' END,
        'sum', 'cat8', 'trend', '{"firsthand":6}', 'anchor', 'because', '', 200, 0.25, 3, 'body' || CAST(page_id AS STRING) FROM pages""",
    "candidates": """SELECT page_id * 10 + v.n AS pos, CASE v.n WHEN 0 THEN url WHEN 1 THEN url || CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END || 'utm_medium=x&fbclid=1'
        WHEN 2 THEN upper(substr(url, 1, 8)) || substr(url, 9) ELSE 'ftp://' || CAST(page_id AS STRING) END AS url, 'tag' || CAST((page_id + v.n) % 3 AS STRING) AS tag, html AS body,
        CASE WHEN page_id % 5 = 0 THEN NULL ELSE 'Page ' || CAST(page_id AS STRING) END AS title, CASE WHEN (page_id + v.n) % 4 = 0 THEN NULL ELSE 'site' || CAST(page_id % 7 AS STRING) END AS source_name,
        TIMESTAMP '2024-04-01 00:00:00' + page_id * INTERVAL '1' HOUR AS published_at FROM pages, (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) v""",
    "allow_list": """SELECT DISTINCT lower(split_part(split_part(url, '://', 2), '/', 1)) AS host, CASE WHEN length(split_part(url, '/', 3)) % 2 = 0 THEN '^/(en|de)/' ELSE '^/fr/. /[0-9]+0$' END AS patterns FROM pages WHERE length(split_part(url, '/', 3)) % 3 <> 0""",
    "fetch_log": """SELECT event_id AS fetch_id, 'h' || CAST(user_id AS STRING) AS host, CASE WHEN event_id % 10 = 0 THEN 'robots' WHEN event_id % 37 = 0 THEN 'sitemap' ELSE 'article' END AS purpose,
        CASE WHEN event_type = 'purchase' AND event_id % 9 = 0 THEN 403 WHEN event_type = 'signup' THEN 304 WHEN event_type = 'error' AND event_id % 5 = 0 THEN 429 WHEN event_id % 511 = 0 THEN 451 ELSE 200 END AS status, CAST(ts AS TIMESTAMP) AS ts,
        CASE WHEN event_id % 10 = 0 THEN 'r' || CAST(user_id % 5 + CASE WHEN event_id % 250 = 0 THEN 1 ELSE 0 END AS STRING) END AS robots_hash FROM events""",
    "retry_queue": """SELECT 'u' || CAST(event_id AS STRING) AS url_hash, 'https://h' || CAST(user_id AS STRING) || '.example.com/a/' || CAST(event_id AS STRING) AS url, 'h' || CAST(user_id AS STRING) || '.example.com' AS host, CASE event_id % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'discovery' ELSE 'evergreen' END AS lane, 'transient' AS reason, CAST(event_id % 5 AS INT) AS attempts,
        CAST(ts AS TIMESTAMP) AS first_queued_at, CAST(ts AS TIMESTAMP) + (1 + event_id % 30) * INTERVAL '1' HOUR AS next_attempt_at, CAST(ts AS TIMESTAMP) + INTERVAL '72' HOUR AS expires_at FROM events WHERE event_type = 'error'""",
    "host_metrics": """SELECT 'h' || CAST(user_id AS STRING) AS host, CAST(ts AS DATE) AS day, COUNT(*) AS processed, SUM(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) AS published, SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS dropped,
        SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS promotional, SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS author_present FROM events GROUP BY user_id, CAST(ts AS DATE)""",
    "discovery_seen": """SELECT 's' || CAST(event_id AS STRING) AS url_hash, 'h' || CAST(user_id AS STRING) AS host, CASE event_type WHEN 'view' THEN 'fetched' WHEN 'click' THEN 'pending' ELSE 'skipped' END AS status FROM events WHERE event_id % 3 <> 0""",
    "discovery_run": """SELECT event_id AS id, 'h' || CAST(user_id AS STRING) AS host, CAST(ts AS TIMESTAMP) AS started_at, CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) + INTERVAL '5' MINUTE END AS finished_at,
        CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS outcome FROM events""",
    "evidence": """SELECT doc_id AS id, source || '.example.com' AS host, CAST(n_chars % 120 AS INT) AS text_length, CAST(doc_id % 101 AS DOUBLE) / 100 AS link_density, CAST(doc_id % 4 AS INT) AS paragraph_count FROM documents""",
    "judged": """SELECT doc_id, quality AS label_quality, CASE WHEN doc_id % 9 = 0 THEN 1 - quality ELSE quality END AS predicted_quality, toxic AS label_toxic, CASE WHEN doc_id % 7 = 0 THEN 1 - toxic ELSE toxic END AS predicted_toxic FROM labels""",
    "reads": """SELECT DISTINCT user_id, event_id % 200 AS post_id FROM events WHERE event_type = 'view'""",
    "snapshot": """SELECT doc_id AS id, substr(text, 1, 40) AS title, lang, source FROM documents""",
    "current": """SELECT doc_id AS id, CASE WHEN doc_id % 15 = 0 THEN 'changed' ELSE substr(text, 1, 40) END AS title, CASE WHEN doc_id % 45 = 0 THEN NULL ELSE lang END AS lang, source FROM documents WHERE doc_id % 90 <> 1
        UNION ALL SELECT doc_id + 1000000000, 'new', lang, source FROM documents WHERE doc_id % 97 = 0""",
    "error_log": """SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 404 ELSE NULL END AS status, CASE event_id % 11 WHEN 0 THEN '429' ELSE NULL END AS code,
        CASE event_id % 6 WHEN 0 THEN 'Rate limit reached' WHEN 1 THEN 'ECONNRESET by peer' WHEN 2 THEN 'API key rejected' WHEN 3 THEN 'quota exhausted' WHEN 4 THEN 'odd' ELSE NULL END AS message FROM events""",
    "raw_topics": """SELECT doc_id AS post_id, lang, split_part(text, ' ', 1) || '|' || split_part(text, ' ', 2) || '|' || split_part(text, ' ', 1) || '|' || substr(text, 1, 3) || '|日程' || '|' || substr(text, 1, 12) AS topics, split_part(text, ' ', 2) AS anchor FROM documents""",
    "terms": """SELECT page_id, CAST(page_id % 40 AS STRING) || '.example.com' AS host, page_id AS seq, CASE WHEN page_id % 80 < 40 THEN 'General terms. Be nice.' WHEN page_id % 3 = 0 THEN 'クロールは禁止です。Be nice.' ELSE 'クロールは歓迎。転載の禁止ではない. ok' END AS body FROM pages""",
    "robots_snapshots": """SELECT lower(split_part(split_part(url, '://', 2), '/', 1)) AS host, page_id AS seq, replace(CASE page_id % 5
        WHEN 0 THEN 'User-agent: *|Disallow: /fr # no French|Allow: /fr/*/|Disallow: /*?page=|Disallow:|Allow: /es|Disallow: /es'
        WHEN 1 THEN '# rules|Disallow: /|User-agent: OtherBot|User-Agent : GleanBot/1.0|Crawl-delay: 5|Disallow: /en/|Allow: /en/*7|Sitemap: /s.xml|Disallow: /*.html$|disallow: /d%65/||User-agent: *|Disallow: /'
        WHEN 2 THEN 'User-agent: OtherBot|Disallow: /|User-agent: gleanbot|Disallow:|User-agent: *|Disallow: /'
        WHEN 3 THEN 'User-agent: gleanbot|Allow: /en/5|User-agent: x|Disallow: /|User-agent: GLEANBOT|Disallow: /en/|Disallow: /*/*5*/$|Disallow: /*utm%5Fsource=feed$'
        ELSE 'User-agent: OtherBot|Disallow: /' END, '|', CASE WHEN page_id % 2 = 0 THEN chr(10) ELSE chr(13) || chr(10) END) AS robots_text FROM pages WHERE page_id % 7 <> 0""",
    "page_verdicts": """SELECT d.url, CASE event_id % 11 WHEN 0 THEN '404' WHEN 1 THEN 'robots' WHEN 2 THEN 'K2' WHEN 3 THEN '304' WHEN 4 THEN 'K5' WHEN 5 THEN 'too_large' WHEN 6 THEN '410' WHEN 7 THEN 'retry_after' ELSE '200' END AS verdict, event_id AS seq
        FROM events, (SELECT DISTINCT 'https://' || source || '.example.com/a/' || CAST(doc_id AS STRING) AS url, doc_id FROM documents) d WHERE d.doc_id = event_id % 997""",
    "terms_verdicts": """SELECT 'src' || CAST(user_id % 40 AS STRING) || '.example.com' AS host, CASE event_id % 13 WHEN 0 THEN 'K2' WHEN 1 THEN 'K3' WHEN 2 THEN 'K1' WHEN 3 THEN 'B1' ELSE 'ok' END AS verdict, event_id AS seq FROM events WHERE user_id % 3 = 0""",
    "sitemap_children": """SELECT DISTINCT 'm' || CAST(page_id % 12 AS STRING) AS host, 'root' || CAST(page_id % 2 AS STRING) AS root, 'c' || CAST(page_id % 10 AS STRING) AS child, CASE page_id % 4 WHEN 0 THEN '2024-05-05'
        WHEN 1 THEN CASE page_id % 10 WHEN 1 THEN 'yesterday' WHEN 3 THEN NULL WHEN 5 THEN '2999-01-01' ELSE '2024-04-01' END ELSE '2024-05-1' || CAST(page_id % 10 AS STRING) END AS lastmod FROM pages WHERE page_id % 12 <> 11""",
    "sitemap_entries": """SELECT 'm' || CAST(page_id % 12 AS STRING) AS host, 'root' || CAST(page_id % 2 AS STRING) AS root, CASE WHEN page_id % 12 = 11 OR page_id % 9 = 0 THEN NULL ELSE 'c' || CAST(page_id % 10 AS STRING) END AS child,
        split_part(url, '?', 1) AS url, CAST(DATE '2024-01-01' + CAST(page_id % 100 AS INT) AS STRING) AS lastmod, page_id AS pos FROM pages""",
    "sitemap_seen": """SELECT DISTINCT 'm' || CAST(page_id % 12 AS STRING) AS host, split_part(url, '?', 1) AS url FROM pages WHERE page_id % 5 < 2 AND page_id % 12 NOT IN (4, 9)""",
    "sitemap_urls": """SELECT page_id AS pos, 'r' || CAST(page_id % 12 AS STRING) AS root, split_part(url, '?', 1) AS url, CASE WHEN page_id % 12 = 0 THEN '2024-05-05' WHEN page_id % 12 = 1 THEN 'yesterday' WHEN page_id % 12 = 2 THEN '2999-01-01' ELSE CAST(DATE '2024-01-01' + CAST(page_id % 100 AS INT) AS STRING) END AS lastmod FROM pages""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def with_inputs(sql: str) -> str:
    """The SQL with a WITH clause for the inputs that it names."""
    used = [name for name in INPUTS if re.search(rf"\b{name}\b", sql)]
    clause = ", ".join(f"{name} AS ({INPUTS[name]})" for name in used)
    body = sql.strip()
    if not used:
        return body
    return f"WITH {clause}, {body[5:]}" if re.match(r"(?i)with\s", body) else f"WITH {clause} {body}"


class Inputs:
    """The inputs, and the tables below them, of one data folder as DataFrames: ``inputs.posts``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        small_batches(spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("documents", "pages"):
            return spread(table(self.spark, self.sf_dir, name))
        if name in TABLES:
            return table(self.spark, self.sf_dir, name)
        if name not in INPUTS:
            raise AttributeError(name)
        sql = INPUTS[name]
        used = {t: table(self.spark, self.sf_dir, t) for t in TABLES if re.search(rf"\bFROM {t}\b", sql)}
        return self.spark.sql(re.sub(r"\bFROM (\w+)\b", lambda m: f"FROM {{{m[1]}}}" if m[1] in used else m[0], sql.replace("{", "{{").replace("}", "}}")), **used)
