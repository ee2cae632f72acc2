"""Queries of the reading side: functions of single rows, joins, ranking, counts."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from gleanery.config import ACCESS_TERMS, CONFIG, ERROR_PATTERNS, GENERIC_TOPICS, LABELS, PROHIBIT_TERMS
from gleanery.functions import containers, scoring, text, urls
from gleanery.operators import candidates as cand
from gleanery.operators import feed, hosts, metrics
from gleanery.plans.catalog import at, epoch, query

_LEVEL = "CASE WHEN json_extract_string({j}, '$.{k}') = 'true' THEN 1.0 ELSE coalesce(TRY_CAST(json_extract_string({j}, '$.{k}') AS DOUBLE), 0.0) END"


def _lv(k: str) -> str:
    return f"(CASE WHEN json_valid(criteria_json) THEN {_LEVEL.format(j='criteria_json', k=k)} ELSE 0.0 END)"


SCORE = f"""CASE WHEN criteria_json IS NULL OR NOT json_valid(criteria_json) THEN 20.0 ELSE
    (CASE WHEN {_lv("ceremonyDecision")} >= 1 AND {_lv("weddingDayContent")} >= 1 THEN 70 ELSE 0 END) + 2 * {_lv("ceremonyDecision")} + 3 * {_lv("firsthand")} + 2 * {_lv("specific")} + 2 * {_lv("weddingDayContent")}
    - (CASE WHEN json_extract_string(criteria_json, '$.promotional') = 'heavy' OR {_lv("promotional")} >= 7 THEN 4 ELSE 0 END) END"""

FEED = f"""SELECT p.*, r.topic_anchor, r.rationale_text, r.evidence_sufficient, c.criteria_json FROM posts p LEFT JOIN rationales r ON r.post_id = p.id LEFT JOIN criteria c ON c.post_id = p.id"""
VISIBLE = "status = 'published' AND source_type = 'blog' AND ((ai_title IS NOT NULL AND ai_summary IS NOT NULL) OR topic_anchor IS NOT NULL OR rationale_text IS NOT NULL) AND coalesce(category <> '', FALSE) AND coalesce(tag <> '', FALSE) AND (rationale_text IS NOT NULL OR (ai_title IS NOT NULL AND ai_summary IS NOT NULL))"

CANON = r"""CASE WHEN regexp_matches({u}, '^(?i:https?)://[^/?#\s]+[^?#]*(\?[^#]*)?(#.*)?$') THEN
    lower(regexp_extract({u}, '^([A-Za-z]+://[^/?#\s]+)', 1)) ||
    CASE WHEN length(regexp_extract({u}, '^[A-Za-z]+://[^/?#\s]+([^?#]*)', 1)) > 1 THEN regexp_replace(regexp_extract({u}, '^[A-Za-z]+://[^/?#\s]+([^?#]*)', 1), '/$', '') ELSE '/' END ||
    CASE WHEN len(list_filter(string_split(regexp_extract({u}, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_full_match(lower(split_part(p, '=', 1)), 'utm_.*|fbclid'))) > 0
        THEN '?' || array_to_string(list_filter(string_split(regexp_extract({u}, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_full_match(lower(split_part(p, '=', 1)), 'utm_.*|fbclid')), '&') ELSE '' END ||
    regexp_extract({u}, '(#.*)$', 1) END"""


@query(f"SELECT pos, url AS given, {CANON.format(u='url')} AS url, sha256(lower(trim(url))) AS url_key FROM candidates")
def p01_canonical_url(t):
    return t.candidates.select("pos", F.col("url").alias("given"), urls.canonical_url(F.col("url")).alias("url"), urls.url_key(F.col("url")).alias("url_key"))


@query("""SELECT pos, url AS given, CASE n WHEN 0 THEN 'http://www.host' || CAST(page_id AS STRING) || '.example.com/Path' WHEN 1 THEN 'https://h.example.com/p/' || CAST(page_id AS STRING) || '?a=1&&b=2' WHEN 2 THEN 'https://h.example.com/p?q=a+b&c=&k=' || CAST(page_id AS STRING) || '#Top'
    WHEN 3 THEN 'https://h.example.com:8080/%E7%8C%AB/' || CAST(page_id AS STRING) || '/' WHEN 4 THEN 'https://h.example.com/b%20c?q=%22' || CAST(page_id AS STRING) || '%22' WHEN 7 THEN 'https://u:p@h.example.com/?' END AS url FROM odd_urls""")
def p01_canonical_cases(t):
    """URLs made by known steps, and what each step has to come to."""
    return t.odd_urls.select("pos", F.col("url").alias("given"), urls.canonical_url(F.col("url")).alias("url"))


@query("SELECT id, substr(sha256(original_title || chr(0) || coalesce(original_excerpt, '')), 1, 16) AS content_hash FROM posts")
def p03_content_hash(t):
    return t.posts.select("id", scoring.content_hash(F.col("original_title"), F.col("original_excerpt")).alias("content_hash"))


@query(r"SELECT pos, coalesce(nullif(trim(source_name), ''), nullif(regexp_replace(lower(CASE WHEN regexp_matches(url, '^(?i:https?)://[^/?#\s]+') THEN regexp_extract(url, '^[A-Za-z]+://([^/?#\s]+)', 1) ELSE '' END), '^www\.', ''), '')) AS source_name FROM candidates")
def p04_source_name(t):
    return t.candidates.select("pos", urls.source_name(F.col("source_name"), F.lit(None).cast("string"), F.col("url")).alias("source_name"))


_HOST = r"lower(regexp_extract({u}, '^[A-Za-z]+://([^/?#\s]+)', 1))"


@query(rf"""WITH rules AS (SELECT host, unnest(string_split(patterns, ' ')) AS pattern FROM allow_list), c AS (SELECT pos, {_HOST.format(u="url")} AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#\s]+([^?#]*)', 1) AS path FROM candidates),
    hit AS (SELECT DISTINCT c.pos FROM c JOIN rules r ON r.host = c.host AND regexp_matches(c.path, r.pattern))
    SELECT pos, pos IN (SELECT pos FROM hit) AS allowed, pos IN (SELECT pos FROM hit) OR host NOT IN (SELECT host FROM allow_list) AS allowed_for_seeding FROM c""")
def p05_allowed_article(t):
    return cand.allowed_articles(t.candidates, t.allow_list.select("host", F.split("patterns", " ").alias("patterns"))).select("pos", "allowed", "allowed_for_seeding")


#: Blanks and pictographs as SQL writes them: of Unicode's data files, not of the jobs.
WS = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
STRIP = f"regexp_replace({{x}}, '^[{WS}]+|[{WS}]+$', '', 'g')"
_BARE = f"regexp_replace({{x}}, '[{WS}]+', '', 'g')"
DECODE = "replace(replace(replace(replace(replace(replace({x}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', ' ')"
TITLE = r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1)"


_PLAIN_TITLE = STRIP.format(x="regexp_replace(" + DECODE.format(x=TITLE) + r", '[ \t\r\n\x{{2028}}\x{{2029}}]+', ' ', 'g')".replace("{{", "{").replace("}}", "}"))


@query(f"SELECT page_id, {_PLAIN_TITLE} AS title FROM articles")
def p06_normalize_titles(t):
    return t.articles.select("page_id", text.normalized_title(F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title>", 1)).alias("title"))


_PICTOGRAPHS = r"[\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21A9}\x{21AA}\x{231A}\x{231B}\x{2328}\x{2388}\x{23CF}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{24C2}\x{25AA}\x{25AB}\x{25B6}\x{25C0}\x{25FB}-\x{25FE}\x{2600}-\x{2605}\x{2607}-\x{2612}\x{2614}-\x{2685}\x{2690}-\x{2705}\x{2708}-\x{2712}\x{2714}\x{2716}\x{1F300}-\x{1F3FA}\x{1F400}-\x{1F53D}\x{1F546}-\x{1F64F}]"


def title_ok_sql(x: str) -> str:
    return rf"""(length({STRIP.format(x=x)}) >= 2 AND NOT regexp_matches({x}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]') AND len(regexp_extract_all({x}, '{_PICTOGRAPHS}')) <= 10
    AND len(list_filter(range(1, length({x}) - 2), lambda i: substr({x}, i, 4) = repeat(substr({x}, i, 1), 4) AND NOT regexp_matches(substr({x}, i, 1), '[\p{{L}}\p{{N}}{WS}]'))) = 0)"""


@query(f"SELECT doc_id, {title_ok_sql('title')} AS title_ok FROM titles")
def p07_title_filter(t):
    return t.titles.select("doc_id", text.title_ok(F.col("title")).alias("title_ok"))


_VISIBLE = r"""array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({stripped}, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '[ \t]+', ' ', 'g'), '[\r\n]+'), lambda x: @STRIP@), lambda x: x <> ''), chr(10))""".replace("@STRIP@", STRIP.format(x="x"))
_STRIPPED = r"regexp_replace({x}, '(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<!--.*?-->', '', 'g')"


@query(f"SELECT page_id, {_VISIBLE.format(stripped=_STRIPPED.format(x='html'))} AS visible_text FROM articles")
def p08_visible_text(t):
    return t.articles.select("page_id", text.visible_text(F.col("html")).alias("visible_text"))


_INNER = r"nullif(regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article>', 1), '')"
_SIGNALS = f"""SELECT page_id, inner_html, length({_BARE.format(x=_VISIBLE.format(stripped=_STRIPPED.format(x="inner_html")))}) AS text_length,
    coalesce(list_sum(list_transform(regexp_extract_all({_STRIPPED.format(x="inner_html")}, '(?is)<a\\b[^>]*>(.*?)</a>', 1), lambda a: length({_BARE.format(x=_VISIBLE.format(stripped="a"))}))), 0) AS link_length,
    len(regexp_extract_all(inner_html, '(?i)<p[\\s>]')) AS paragraph_count FROM (SELECT page_id, {_INNER} AS inner_html FROM articles)"""


@query(f"SELECT page_id, text_length, CASE WHEN text_length > 0 THEN least(1.0, link_length / text_length) ELSE 1.0 END AS link_density, paragraph_count FROM ({_SIGNALS}) WHERE inner_html IS NOT NULL")
def p11_evidence_signals(t):
    inner = containers.article_containers(t.articles.withColumn("selectors", F.array(F.lit("article"))), "html", "selectors").where("inner_html is not null")
    return inner.select("page_id", text.signals(F.col("inner_html")).alias("s")).select("page_id", "s.*")


@query("""SELECT id, host, array_to_string(list_filter([CASE WHEN text_length < 30 THEN 'text_length' END, CASE WHEN link_density > 0.7 THEN 'link_density' END, CASE WHEN paragraph_count < 1 THEN 'paragraph_count' END], lambda x: x IS NOT NULL), ',') AS failed,
    text_length >= 30 AND link_density <= 0.7 AND paragraph_count >= 1 AS passed FROM evidence""")
def p12_evidence_gate(t):
    failed = text.failed_conditions(F.col("text_length"), F.col("link_density"), F.col("paragraph_count"))
    return t.evidence.select("id", "host", F.array_join(failed, ",").alias("failed"), (F.size(failed) == 0).alias("passed"))


PLAIN = r"nullif(trim(regexp_replace({x}, '[ \t\r\n\x{{2028}}\x{{2029}}]+', ' ', 'g')), '')"
_ONE = "nullif(" + STRIP.format(x=r"regexp_replace(@X@, '[ \t\r\n\x{{2028}}\x{{2029}}]+', ' ', 'g')".replace("{{", "{").replace("}}", "}")) + ", '')"
_PAGE = _ONE.replace("@X@", DECODE.format(x="regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g')"))
#: The text of a heading as HTML has it: these references count without their semicolon too.
_TEXT = "regexp_replace(@X@, '&amp;?', '&', 'g')"
for _name, _plain in (("nbsp", "\u00a0"), ("quot", '"'), ("gt", ">"), ("lt", "<")):
    _TEXT = _TEXT.replace("@X@", f"regexp_replace(@X@, '&{_name};?', '{_plain}', 'g')")
_OWN = _ONE.replace("@X@", DECODE.format(x=_TEXT.replace("@X@", "regexp_replace(regexp_extract(inner_html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')")))


@query(f"SELECT page_id, coalesce({_OWN}, {_PAGE}) AS title FROM (SELECT page_id, html, {_INNER} AS inner_html FROM articles)")
def p10_article_titles(t):
    """The heading inside the container: the pages have another one, with the site's name, before it."""
    found = containers.article_containers(t.articles.select("page_id", F.col("html").alias("page"), "html", F.array(F.lit("article")).alias("selectors")), "html", "selectors")
    return found.select("page_id", text.article_title(F.col("heading"), F.col("page")).alias("title"))


@query(f"SELECT page_id, CASE WHEN page_id % 4 <> 3 THEN {_INNER} END AS inner_html FROM pages")
def p09_article_container(t):
    """Hosts of three quarters of the pages are listed, with a selector that fits nothing before the one that does."""
    rows = t.pages.select("page_id", "html", F.when(F.col("page_id") % 4 != 3, F.array(F.lit("div.story-body"), F.lit("article"))).alias("selectors"))
    return containers.article_containers(rows, "html", "selectors").select("page_id", "inner_html")


_FAILED = "list_filter([CASE WHEN text_length < 30 THEN 'text_length' END, CASE WHEN density > 0.7 THEN 'link_density' END, CASE WHEN paragraph_count < 1 THEN 'paragraph_count' END], lambda x: x IS NOT NULL)"


_BITS = ", ".join(f"sum(CASE WHEN (h >> {b}) & 1 = 1 THEN 1 ELSE -1 END) AS b{b}" for b in range(64))
_WORD = " + ".join(f"(CASE WHEN b{b} > 0 THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END)" for b in range(64))


SIMHASH = rf"""(WITH bare AS (SELECT doc_id, {_BARE.format(x="coalesce(text, '')")} AS s FROM {{rows}}),
    shingles AS (SELECT doc_id, unnest(CASE WHEN length(s) >= 4 THEN list_transform(range(1, length(s) - 2), lambda i: substr(s, i, 4)) WHEN length(s) > 0 THEN [s] ELSE [NULL] END) AS shingle FROM bare),
    hashed AS (SELECT doc_id, ('0x' || substr(sha256(shingle), 1, 16))::UBIGINT AS h FROM shingles),
    bits AS (SELECT doc_id, count(h) AS n, {_BITS} FROM hashed GROUP BY doc_id)
    SELECT doc_id, CASE WHEN n = 0 THEN repeat('0', 16) ELSE lower(lpad(to_hex({_WORD}), 16, '0')) END AS simhash FROM bits)"""


_LISTED = "host NOT LIKE 'm.%'"
_READY = f"(SELECT page_id AS doc_id, {_VISIBLE.format(stripped=_STRIPPED.format(x='inner_html'))} AS text FROM (SELECT page_id, {_INNER} AS inner_html FROM articles) WHERE inner_html IS NOT NULL)"


@query(f"""WITH a AS (SELECT page_id, url, host, html, CASE WHEN {_LISTED} THEN {_INNER} END AS inner_html FROM articles),
    s AS (SELECT a.page_id, url, host, {_PAGE} AS page_title, {_OWN.replace("inner_html", "a.inner_html")} AS own, a.inner_html, text_length, CASE WHEN text_length > 0 THEN least(1.0, link_length / text_length) ELSE 1.0 END AS density, paragraph_count FROM a JOIN ({_SIGNALS}) g ON g.page_id = a.page_id),
    o AS (SELECT *, CASE WHEN page_title IS NULL THEN 'no_title' WHEN inner_html IS NULL THEN 'container_not_found' WHEN len({_FAILED}) > 0 THEN 'extraction_insufficient' ELSE 'ready' END AS outcome, page_title IS NOT NULL AND inner_html IS NOT NULL AS judged_here FROM s)
    SELECT page_id, url, host, CASE WHEN page_title IS NOT NULL THEN CASE WHEN inner_html IS NOT NULL THEN coalesce(own, page_title) ELSE page_title END END AS title, outcome, CASE WHEN judged_here THEN text_length END AS text_length, CASE WHEN judged_here THEN density END AS link_density,
    CASE WHEN judged_here THEN paragraph_count END AS paragraph_count, CASE WHEN judged_here THEN array_to_string({_FAILED}, ',') ELSE '' END AS failed, CASE WHEN outcome = 'ready' THEN least(length(r.text), 1500) END AS slice_length, CASE WHEN outcome = 'ready' THEN simhash END AS body_hash
    FROM o LEFT JOIN {_READY} r ON r.doc_id = o.page_id LEFT JOIN {SIMHASH.format(rows=_READY)} h ON h.doc_id = o.page_id""")
def p13_extract_articles(t):
    """Mobile hosts aren't listed; the others have a selector that fits nothing before the one that does."""
    listed = t.articles.where("host not like 'm.%'").select("host").distinct()
    selectors = listed.select("host", F.lit(1).alias("place"), F.lit("div.story-body").alias("selector")).unionByName(listed.select("host", F.lit(2).alias("place"), F.lit("article").alias("selector")))
    return cand.extracted(t.articles, selectors).withColumn("slice_length", F.length("slice")).drop("slice")


@query(f"SELECT * FROM {SIMHASH.format(rows='documents')}")
def p14_simhash64(t):
    return scoring.simhash64(t.documents.select("doc_id", "text"), "doc_id", "text")


@query("""WITH h AS (SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS a, CASE WHEN doc_id % 10 = 3 THEN 'no hash' WHEN doc_id % 10 <> 4 THEN substr(sha256(source || coalesce(text, '')), 1, 16) END AS b FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 10 IN (3, 4) THEN 0.0 ELSE 1 - bit_count(xor(('0x' || a)::UBIGINT, ('0x' || b)::UBIGINT)::HUGEINT) / 64 END AS similarity FROM h""")
def p15_simhash_similarity(t):
    digits = lambda x: F.substring(F.sha2(x, 256), 1, 16)
    text_ = F.coalesce("text", F.lit(""))
    other = F.when(F.col("doc_id") % 10 == 3, "no hash").when(F.col("doc_id") % 10 != 4, digits(F.concat("source", text_)))
    return t.documents.select("doc_id", scoring.simhash_similarity(digits(text_), other).alias("similarity"))


_J = "json_extract_string(criteria_json, '$.{k}')"


@query(f"SELECT post_id, CAST({SCORE} AS DOUBLE) AS score FROM criteria")
def p21_usefulness_score(t):
    return t.criteria.select("post_id", scoring.usefulness(F.col("criteria_json")).alias("score"))


def _shown(k: str) -> str:
    v = _J.format(k=k)
    words = " WHEN 'heavy' THEN 9 WHEN 'light' THEN 4 WHEN 'none' THEN 0 WHEN 'true' THEN 4" if k == "promotional" else " WHEN 'true' THEN 9"
    return f"coalesce(CASE {v}{words} WHEN 'false' THEN 0 ELSE least(9, greatest(0, CAST(floor(TRY_CAST({v} AS DOUBLE)) AS INT))) END, 0)"


COMPLETE = " AND ".join(f"{_J.format(k=k)} IS NOT NULL" for k in ("firsthand", "ceremonyDecision", "specific", "weddingDayContent", "promotional"))


@query("SELECT post_id, " + ", ".join(f"CASE WHEN json_valid(criteria_json) THEN CASE WHEN {COMPLETE} THEN {_shown(k)} END END AS {k.lower()}" for k in ("firsthand", "ceremonyDecision", "specific", "weddingDayContent", "promotional")) + " FROM criteria")
def p22_normalize_criteria(t):
    levels = scoring.display_levels(F.col("criteria_json"))
    return t.criteria.select("post_id", levels.alias("x")).select("post_id", *(F.col(f"x.{k}").alias(k.lower()) for k in ("firsthand", "ceremonyDecision", "specific", "weddingDayContent", "promotional")))


RATIONALE_LABELS = "list_filter([" + ", ".join(f"CASE WHEN {_shown(k)} >= 6 THEN '{label}' END" for k, label in LABELS) + "], lambda x: x IS NOT NULL)"


RATIONALE = "'「' || topic_anchor || '」に関する記事' || CASE WHEN len({labels}) = 0 THEN 'です。自動判定では特筆すべき特徴は検出されませんでした。' ELSE 'で、' || array_to_string({labels}, '、') || 'という特徴が自動判定されました。' END"


@query(f"SELECT post_id, CASE WHEN length(t) BETWEEN 38 AND 210 THEN t END AS rationale FROM (SELECT c.post_id, {RATIONALE.format(labels=RATIONALE_LABELS)} AS t FROM criteria c JOIN rationales r ON r.post_id = c.post_id WHERE json_valid(criteria_json) AND {COMPLETE})")
def p20_render_rationale(t):
    rows = t.criteria.join(t.rationales, "post_id").withColumn("levels", scoring.display_levels(F.col("criteria_json"))).where("levels is not null")
    return rows.select("post_id", scoring.rationale(F.col("topic_anchor"), F.col("levels")).alias("rationale"))


_ERRORS = dict(ERROR_PATTERNS)


@query(f"""SELECT id, CASE WHEN coalesce(status, -1) = 429 OR coalesce(code, '') = '429' OR regexp_matches(coalesce(message, ''), '{_ERRORS["rate_capped"]}') THEN 'rate_capped'
    WHEN coalesce(status, -1) BETWEEN 500 AND 599 OR regexp_matches(coalesce(message, ''), '{_ERRORS["transient"]}') THEN 'transient'
    WHEN coalesce(status, -1) BETWEEN 400 AND 499 OR regexp_matches(coalesce(message, ''), '{_ERRORS["terminal"]}') THEN 'terminal' ELSE 'unknown' END AS kind FROM error_log""")
def p25_classify_errors(t):
    return t.error_log.select("id", text.error_kind(F.col("status"), F.col("code"), F.col("message")).alias("kind"))


@query(rf"""WITH plain AS (SELECT page_id, host, seq, lower(trim(regexp_replace(regexp_replace(body, '<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g'))) AS plain FROM terms), prior AS (SELECT *, lag(plain) OVER (PARTITION BY host ORDER BY seq) AS before FROM plain)
    SELECT page_id, host, CASE WHEN before IS NULL THEN 'baseline' WHEN before = plain THEN 'unchanged' WHEN len(list_filter(regexp_split_to_array(plain, '[。.\n]+'), lambda s: regexp_matches(s, '{ACCESS_TERMS}') AND regexp_matches(s, '{PROHIBIT_TERMS}'))) > 0 THEN 'restrictive_change' ELSE 'benign_change' END AS change FROM prior""")
def p26_classify_terms_change(t):
    return hosts.terms_changes(t.terms).select("page_id", "host", "change")


_ROBOTS = "'User-agent: *' || chr(10) || 'Crawl-delay: ' || CASE WHEN page_id % 4 = 0 THEN '-' ELSE CAST(page_id % 9 AS STRING) END || chr(10) || CASE WHEN page_id % 5 = 0 THEN ' crawl-DELAY : 2.5' || chr(10) ELSE '' END || 'crawl-delay: 0' || chr(10) || 'Disallow: ' || url"


@query(rf"SELECT page_id, list_max(list_filter(list_transform(regexp_extract_all({_ROBOTS}, '(?im)^\s*crawl-delay\s*:\s*([0-9.]+)', 1), lambda x: TRY_CAST(x AS DOUBLE)), lambda x: x > 0)) AS delay FROM pages")
def p27_crawl_delay(t):
    return t.pages.select("page_id", F.expr(_ROBOTS).alias("robots")).select("page_id", text.crawl_delay(F.col("robots")).alias("delay"))


@query("""WITH u AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'https://www.instagram.com/p/' || event_id WHEN 1 THEN 'https://www.tiktok.com/@a/video/' || event_id WHEN 2 THEN 'https://m.youtube.com/watch?v=' || event_id WHEN 3 THEN 'https://youtu.be/' || event_id WHEN 4 THEN 'https://youtube.com/channel/' || event_id ELSE 'https://example.com/p/' || event_id END AS url FROM events)
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'instagram' WHEN 1 THEN 'tiktok' WHEN 2 THEN 'youtube' WHEN 3 THEN 'youtube' ELSE 'none' END AS provider FROM u""")
def p28_embed_provider(t):
    stems = F.array(*map(F.lit, ("https://www.instagram.com/p/", "https://www.tiktok.com/@a/video/", "https://m.youtube.com/watch?v=", "https://youtu.be/", "https://youtube.com/channel/", "https://example.com/p/")))
    url = F.concat(F.element_at(stems, (F.col("event_id") % 6 + 1).cast("int")), F.col("event_id").cast("string"))
    return t.events.select("event_id", urls.embed_provider(url).alias("provider"))


_TOPIC_LIST = "(SELECT post_id, list(topic ORDER BY position) AS topics FROM topics GROUP BY post_id)"
_GENERIC = "[" + ", ".join(f"'{x}'" for x in GENERIC_TOPICS) + "]"


@query(f"SELECT p.id, l.topics IS NULL OR len(list_filter(l.topics, lambda x: list_contains({_GENERIC}, trim(x)))) > 0 AS generic, r.prompt_version IS NULL OR r.prompt_version LIKE 'legacy%' AS legacy FROM posts p LEFT JOIN {_TOPIC_LIST} l ON l.post_id = p.id LEFT JOIN rationales r ON r.post_id = p.id")
def p29_generic_topics(t):
    rows = feed.attach_topics(t.posts.select("id"), t.topics).join(t.rationales.select(F.col("post_id").alias("id"), "prompt_version"), "id", "left")
    return rows.select("id", text.generic_topics(F.col("topics")).alias("generic"), (F.col("prompt_version").isNull() | F.col("prompt_version").startswith("legacy")).alias("legacy"))


@query(f"SELECT id, {VISIBLE} AS visible FROM ({FEED})")
def p31_feed_visible(t):
    return feed.feed_join(t.posts, t.rationales, t.criteria).select("id", feed.visible().alias("visible"))


@query("SELECT id, coalesce(trim(original_excerpt) <> 'null' AND length(trim(original_excerpt)) >= 5, FALSE) AS runnable FROM posts")
def p32_split_preflight(t):
    return feed.split_preflight(t.posts).select("id", "runnable")


@query(f"SELECT id, source_id, topic_anchor, rationale_text, evidence_sufficient, criteria_json FROM ({FEED})")
def j01_feed_join(t):
    return feed.feed_join(t.posts, t.rationales, t.criteria).select("id", "source_id", "topic_anchor", "rationale_text", "evidence_sufficient", "criteria_json")


@query(f"SELECT p.id, coalesce(array_to_string(l.topics, '|'), '') AS topics, coalesce(len(l.topics), 0) AS n FROM posts p LEFT JOIN {_TOPIC_LIST} l ON l.post_id = p.id")
def j02_attach_topics(t):
    return feed.attach_topics(t.posts.select("id"), t.topics).select("id", F.array_join("topics", "|").alias("topics"), F.size("topics").cast("long").alias("n"))


@query("SELECT p.id, p.url, p.host, q.hash_kind, q.text_length FROM posts p LEFT JOIN publications q ON q.post_id = p.id WHERE p.status = 'published' ORDER BY p.updated_at DESC, p.id DESC LIMIT 200")
def j03_revalidation_list(t):
    live = t.posts.where("status = 'published'").join(t.publications.select(F.col("post_id").alias("id"), "hash_kind", "text_length"), "id", "left")
    return live.orderBy(F.desc("updated_at"), F.desc("id")).limit(200).select("id", "url", "host", "hash_kind", "text_length")


@query("SELECT id, url FROM posts WHERE id NOT IN (SELECT post_id FROM removals)")
def j04_exclude_removed(t):
    return t.posts.join(t.removals.select(F.col("post_id").alias("id")), "id", "left_anti").select("id", "url")


@query("""WITH shown AS (SELECT DISTINCT user_id, event_id % 300 AS id FROM events WHERE event_type <> 'error'), r AS (SELECT DISTINCT user_id, post_id FROM reads WHERE post_id % 10 <> 0)
    SELECT s.user_id, s.id, r.post_id IS NOT NULL AS read FROM shown s LEFT JOIN r ON r.user_id = s.user_id AND r.post_id = s.id""")
def j13_read_split(t):
    """Reads as clients store them: ids as text, some with blanks around, some blank, some twice."""
    shown = t.events.where("event_type <> 'error'").select("user_id", (F.col("event_id") % 300).alias("id")).distinct()
    ids = F.when(F.col("post_id") % 10 == 0, "　 ").when(F.col("post_id") % 3 == 0, F.concat(F.lit(" "), F.col("post_id").cast("string"), F.lit("\u00a0"))).otherwise(F.col("post_id").cast("string"))
    stored = t.reads.select("user_id", ids.alias("post_id"))
    return feed.split_reads(shown, stored.unionByName(stored))


@query(f"SELECT id, CAST({SCORE} AS DOUBLE) AS score, CAST(epoch(published_at) AS BIGINT) AS published_at, source_id FROM ({FEED}) WHERE {VISIBLE} ORDER BY score DESC, published_at DESC NULLS LAST, id DESC LIMIT 100")
def t01_feed_ranked(t):
    rows = feed.feed_join(t.posts, t.rationales, t.criteria).where(feed.visible())
    return feed.ranked(rows, 100).select("id", "score", epoch("published_at"), "source_id")


@query(f"SELECT id, CAST({SCORE} AS DOUBLE) AS score, TRUE AS has_more, 48 AS next_count FROM ({FEED}) WHERE {VISIBLE} ORDER BY score DESC, published_at DESC NULLS LAST, id DESC LIMIT 24")
def t02_feed_page(t):
    rows = feed.feed_join(t.posts, t.rationales, t.criteria).where(feed.visible())
    return feed.page(rows, None).select("id", "score", "has_more", "next_count")


@query("SELECT id FROM posts WHERE source_type = 'blog' AND (curation_signature IS NULL OR curation_signature <> 'v2') ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 150")
def t03_stale_candidates(t):
    return feed.stale(t.posts, "v2", 150).select("id")


@query("SELECT id FROM posts WHERE status = 'published' AND (curation_signature IS NULL OR curation_signature <> 'v2') AND coalesce(trim(original_excerpt), '') IN ('', 'null') ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 150")
def t04_sliceless_candidates(t):
    return feed.sliceless(t.posts, "v2", 150).select("id")


@query("SELECT url_hash, lane, attempts FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY next_attempt_at, url_hash) AS place FROM retry_queue WHERE next_attempt_at <= TIMESTAMP '2024-01-20 00:00:00') WHERE place <= 50")
def t05_due_retries(t):
    return feed.due_retries(t.retry_queue, at("2024-01-20 00:00:00"), CONFIG.due_limit).select("url_hash", "lane", "attempts")


@query("SELECT id, url FROM posts WHERE source_id = 'src3' OR url LIKE '%src3%' ORDER BY id LIMIT 60")
def t06_run_selection(t):
    return feed.run_selection(t.posts, "src3", 60).select("id", "url")


@query(f"""WITH newest AS (SELECT * FROM posts WHERE status = 'published' ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 500)
    SELECT p.id FROM newest p LEFT JOIN {_TOPIC_LIST} l ON l.post_id = p.id LEFT JOIN rationales r ON r.post_id = p.id WHERE l.topics IS NULL OR len(list_filter(l.topics, lambda x: list_contains({_GENERIC}, trim(x)))) > 0 OR r.prompt_version IS NULL OR r.prompt_version LIKE 'legacy%'""")
def t07_topic_backfill_candidates(t):
    newest = t.posts.where("status = 'published'").orderBy(F.desc_nulls_last("published_at"), F.desc("id")).limit(500).select("id")
    rows = feed.attach_topics(newest, t.topics).join(t.rationales.select(F.col("post_id").alias("id"), "prompt_version"), "id", "left")
    return rows.where(text.generic_topics(F.col("topics")) | F.col("prompt_version").isNull() | F.col("prompt_version").startswith("legacy")).select("id")


@query("""WITH fresh AS (SELECT id, published_at FROM posts WHERE id % 3 = 0 AND status = 'published'), stale AS (SELECT id, published_at FROM posts WHERE id % 2 = 0 AND status = 'published' AND id NOT IN (SELECT id FROM fresh))
    SELECT id, turn FROM (SELECT *, 0 AS turn FROM fresh UNION ALL SELECT *, 1 FROM stale) ORDER BY turn, coalesce(published_at, TIMESTAMP '1970-01-01') DESC, id DESC LIMIT 400""")
def s01_fresh_then_stale(t):
    live = t.posts.where("status = 'published'").select("id", "published_at")
    return feed.fresh_then_stale(live.where("id % 3 = 0"), live.where("id % 2 = 0"), 400).select("id", "turn")


@query("SELECT id, (row_number() OVER (ORDER BY created_at DESC, id) - 1) // 30 AS batch, (row_number() OVER (ORDER BY created_at DESC, id) - 1) % 30 + 1 AS index FROM posts")
def w08_batch_ids(t):
    return feed.batch_ids(t.posts.select("id", "created_at"), CONFIG.grading_batch, [F.desc("created_at"), "id"]).select("id", "batch", "index")



@query("SELECT source_id, count(*) AS n, count(DISTINCT category) AS categories FROM posts WHERE status = 'published' GROUP BY source_id")
def a00_posts_by_source(t):
    return t.posts.where("status = 'published'").groupBy("source_id").agg(F.count("*").alias("n"), F.count_distinct("category").alias("categories"))


@query("SELECT count(*) AS n FROM publications q JOIN posts p ON p.id = q.post_id WHERE q.published_at >= TIMESTAMP '2024-05-02 15:00:00' AND p.status = 'published'")
def a01_published_since(t):
    return metrics.published_since(t.publications, t.posts, at("2024-05-02 15:00:00"))


@query("SELECT host, count(*) AS n FROM publications q JOIN posts p ON p.id = q.post_id WHERE q.published_at >= TIMESTAMP '2024-05-02 15:00:00' AND p.status = 'published' GROUP BY host")
def a02_published_since_by_host(t):
    return metrics.published_since(t.publications, t.posts, at("2024-05-02 15:00:00"), ["host"])


_PASS = f"json_valid(criteria_json) AND {_lv('ceremonyDecision')} >= 1 AND {_lv('weddingDayContent')} >= 1"


@query("SELECT source_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (json_valid(criteria_json) AND {_lv(k)} > 0) AS {k.lower()}" for k in ("firsthand", "ceremonyDecision", "specific", "weddingDayContent")) + f", count(*) FILTER ({_PASS}) AS passed, round(100 * count(*) FILTER ({_PASS}) / count(*), 4) AS pass_percent FROM posts p JOIN criteria c ON c.post_id = p.id GROUP BY ROLLUP (source_id)")
def a11_gate_pass_by_source(t):
    out = metrics.gate_pass_by_source(t.posts, t.criteria)
    return out.toDF(*(c.lower() for c in out.columns))


_OK = "(text_length >= {a} AND link_density <= {b} AND paragraph_count >= 1)"
_NOW, _THEN = _OK.format(a=30, b=0.7), _OK.format(a=60, b=0.5)


@query(f"SELECT host, count(*) AS n, count(*) FILTER ({_NOW}) AS pass_now, count(*) FILTER ({_THEN}) AS pass_then, count(*) FILTER ({_NOW} AND NOT {_THEN}) AS lost, count(*) FILTER (NOT {_NOW} AND {_THEN}) AS won, round(count(*) FILTER ({_NOW}) / count(*), 8) AS rate_now, round(count(*) FILTER ({_THEN}) / count(*), 8) AS rate_then FROM evidence GROUP BY ROLLUP (host)")
def a12_counterfactual_thresholds(t):
    return metrics.counterfactual_thresholds(t.evidence, _other())


def _other():
    return dataclasses.replace(CONFIG, min_text_length=60, max_link_density=0.5)


_SIDES = " UNION ALL ".join(f"SELECT '{name}' AS condition, {now} AS a, {then} AS b FROM evidence" for name, now, then in (("text_length", "text_length < 30", "text_length < 60"), ("link_density", "link_density > 0.7", "link_density > 0.5"), ("paragraph_count", "paragraph_count < 1", "paragraph_count < 1")))


@query(f"SELECT condition, count(*) FILTER (a) AS failed_now, count(*) FILTER (b) AS failed_then, count(*) FILTER (a AND NOT b) AS mended, count(*) FILTER (b AND NOT a) AS broken FROM ({_SIDES}) GROUP BY condition HAVING bool_or(a OR b)")
def a12_counterfactual_conditions(t):
    return metrics.counterfactual_conditions(t.evidence, _other())


@query("""SELECT source_id, count(*) AS total, CAST(epoch(min(published_at)) AS BIGINT) AS first, CAST(epoch(max(published_at)) AS BIGINT) AS last, count(*) FILTER (published_at >= TIMESTAMP '2024-02-01' - INTERVAL 30 DAY) AS recent, count(*) FILTER (published_at >= TIMESTAMP '2024-02-01' - INTERVAL 30 DAY AND c.post_id IS NOT NULL) AS recent_graded
    FROM posts p LEFT JOIN criteria c ON c.post_id = p.id GROUP BY ROLLUP (source_id)""")
def a13_corpus_stats(t):
    return metrics.corpus_stats(t.posts, t.criteria, at("2024-02-01")).select("source_id", "total", epoch("first"), epoch("last"), "recent", "recent_graded")


@query(f"SELECT CAST({SCORE} AS DOUBLE) AS score, count(*) AS n FROM posts p LEFT JOIN criteria c ON c.post_id = p.id GROUP BY 1")
def a14_score_histogram(t):
    return metrics.score_histogram(t.posts, t.criteria)


_POSITIVE = "greatest(" + ", ".join(_lv(k) for k in ("firsthand", "ceremonyDecision", "specific", "weddingDayContent")) + ") > 0"


@query(f"""WITH rows_ AS (SELECT length(original_excerpt) AS length, {_POSITIVE} AS positive FROM posts p JOIN criteria c ON c.post_id = p.id WHERE json_valid(criteria_json) AND length(original_excerpt) > 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY positive ORDER BY length) AS place, count(*) OVER (PARTITION BY positive) AS n FROM rows_)
    SELECT positive, CAST(max(n) AS BIGINT) AS n, min(length) AS least, max(length) AS largest, max(length) FILTER (place = n // 2 + 1) AS upper_median, round(avg(length), 6) AS mean FROM ranked GROUP BY positive""")
def a14_length_cohorts(t):
    return metrics.length_cohorts(t.posts, t.criteria)


def _agree(k: str, a: str, b: str) -> str:
    n = lambda x, y: f"count(*) FILTER ({a} = {x} AND {b} = {y})"
    return f"SELECT '{k}' AS criterion, {n(1, 1)} AS tp, {n(0, 1)} AS fp, {n(1, 0)} AS fn, {n(0, 0)} AS tn FROM judged"


@query(f"""SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 8) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 8) END AS recall, CASE WHEN tp + fp + fn + tn > 0 THEN round((tp + tn) / (tp + fp + fn + tn), 8) END AS agreement
    FROM ({_agree("quality", "label_quality", "predicted_quality")} UNION ALL {_agree("toxic", "label_toxic", "predicted_toxic")})""")
def a17_label_agreement(t):
    return metrics.agreement(t.judged, {"quality": ("label_quality", "predicted_quality"), "toxic": ("label_toxic", "predicted_toxic")})


@query("""WITH cells AS (SELECT category, tag, count(*) AS n FROM posts WHERE category IS NOT NULL AND tag IS NOT NULL GROUP BY ALL), a AS (SELECT category, sum(n) AS na FROM cells GROUP BY 1), b AS (SELECT tag, sum(n) AS nb FROM cells GROUP BY 1)
    SELECT round(sqrt(greatest(sum(n * n / (na * nb)) - 1, 0.0) / (least(count(DISTINCT category), count(DISTINCT tag)) - 1)), 8) AS cramers_v, round(-sum(n / (SELECT sum(n) FROM cells) * log2(n / (SELECT sum(n) FROM cells))), 8) AS entropy FROM cells JOIN a USING (category) JOIN b USING (tag)""")
def a18_association_entropy(t):
    return metrics.association(t.posts, "category", "tag")


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS different FROM criteria")
def c05_score_parity(t):
    """The score as a Column and as the SQL text over JSON, on every criteria row."""
    return t.criteria.agg(F.count("*").alias("n"), F.count_if(~scoring.usefulness(F.col("criteria_json")).eqNullSafe(F.expr(scoring.usefulness_sql("criteria_json")))).alias("different"))
