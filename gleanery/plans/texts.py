"""Queries over raw feeds, model replies, topics, drift and the plans made from them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleanery.config import CONFIG, HONORIFIC, SAFE_PREFIXES
from gleanery.functions import scoring, topics, urls
from gleanery.operators import feed, merges, metrics, responses, robots
from gleanery.plans.catalog import at, epoch, query
from gleanery.plans.reading import COMPLETE, DECODE, PLAIN, RATIONALE, RATIONALE_LABELS, SCORE, SIMHASH, STRIP, TITLE, WS
from gleanery.sources import feeds
from gleanery.sources.releases import Releases
from gleanery.sources.tables import shared_dir

CATEGORIES = [f"cat{k}" for k in range(11)]


def _xml(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def raw_feeds(t):
    """One feed with one entry for each document: RSS 2, RDF or Atom, by id."""
    k = F.col("doc_id").cast("string")
    picture = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('<img alt="x" src="https://i.example.com/'), k, F.lit('.png">'))).otherwise("")
    body = _xml(F.concat(F.lit("<p>"), F.regexp_replace("text", "[<>&]", ""), F.lit("</p>"), picture))
    media = F.expr("""CASE doc_id DIV 4 % 6 WHEN 0 THEN concat('<hatena:imageurl> https://h.example.com/', doc_id, ' </hatena:imageurl><media:thumbnail url="https://m.example.com/x"/>') WHEN 1 THEN concat('<media:thumbnail url="https://m.example.com/', doc_id, '"/><media:content url="https://c.example.com/x"/>')
        WHEN 2 THEN concat('<media:content url="https://c.example.com/', doc_id, '"/><enclosure url="https://e.example.com/x"/>') WHEN 3 THEN concat('<enclosure url="https://e.example.com/', doc_id, '" type="image/png"/>') WHEN 4 THEN '<enclosure url="https://e.example.com/x" type="audio/mpeg"/>' ELSE '' END""")
    item = F.concat(F.lit("<item><title>T "), k, F.lit("</title><link>https://x.example.com/"), k, F.lit("</link><description>"), body, F.lit("</description><dc:creator>"), F.col("source"), F.lit("</dc:creator><pubDate>Mon, 01 Jan 2024 10:00:00 +0900</pubDate>"), media, F.lit("</item>"))
    entry = F.concat(F.lit("<entry><title>T "), k, F.lit('</title><link rel="self" href="https://x.example.com/self"/><link href="https://x.example.com/'), k, F.lit('"/><summary>'), body, F.lit("</summary><author><name>"), F.col("source"), F.lit("</name></author><updated>2024-01-01T01:00:00Z</updated></entry>"))
    dc = F.lit(' xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:media="http://search.yahoo.com/mrss/" xmlns:hatena="http://www.hatena.ne.jp/info/xmlns#"')
    xml = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("<rss"), dc, F.lit("><channel>"), item, F.lit("</channel></rss>")))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("<RDF"), dc, F.lit(">"), item, F.lit("</RDF>")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("<feed>"), entry, F.lit("</feed>")))
        .otherwise("no feed")
    )
    return t.documents.select("doc_id", xml.alias("xml"))


@query(r"""SELECT doc_id, 'T ' || CAST(doc_id AS STRING) AS title, 'https://x.example.com/' || CAST(doc_id AS STRING) AS link, nullif(substr(trim(regexp_replace(regexp_replace(text, '[<>&]', '', 'g'), '\s+', ' ', 'g')), 1, 600), '') AS excerpt, source AS author, 1704070800 AS published_at FROM documents WHERE doc_id % 4 <> 3""")
def src1_feed_entries(t):
    return feeds.feed_entries(raw_feeds(t)).select("doc_id", "title", "link", "excerpt", "author", epoch("published_at"))


@query("""WITH e AS (SELECT doc_id, CAST(doc_id AS STRING) AS k, CASE WHEN doc_id % 3 = 0 THEN 'https://i.example.com/' || CAST(doc_id AS STRING) || '.png' END AS picture FROM documents WHERE doc_id % 4 <> 3 AND text IS NOT NULL)
    SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN picture ELSE CASE doc_id // 4 % 6 WHEN 0 THEN 'https://h.example.com/' || k WHEN 1 THEN 'https://m.example.com/' || k WHEN 2 THEN 'https://c.example.com/' || k WHEN 3 THEN 'https://e.example.com/' || k ELSE picture END END AS thumbnail_url FROM e""")
def src2_feed_thumbnail(t):
    return feeds.feed_entries(raw_feeds(t)).select("doc_id", "thumbnail_url")


@query("SELECT page_id, 'url' AS kind, split_part(url, '&', 1) AS loc, CASE WHEN page_id % 3 = 0 THEN NULL ELSE '2024-01-0' || CAST(page_id % 9 + 1 AS STRING) END AS lastmod FROM pages UNION ALL SELECT page_id, 'child', 'https://c.example.com/' || CAST(page_id AS STRING), NULL FROM pages WHERE page_id % 5 = 0")
def src5_sitemap_entries(t):
    mod = F.when(F.col("page_id") % 3 == 0, " ").otherwise(F.concat(F.lit("2024-01-0"), (F.col("page_id") % 9 + 1).cast("string")))
    child = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("<sitemap><loc>https://c.example.com/"), F.col("page_id").cast("string"), F.lit("</loc></sitemap>"))).otherwise("<sitemap><loc> </loc></sitemap>")
    xml = F.concat(F.lit("<urlset><url><loc>"), F.substring_index("url", "&", 1), F.lit("</loc><lastmod>"), mod, F.lit("</lastmod></url>"), child, F.lit("</urlset>"))
    return feeds.sitemap_entries(t.pages.select("page_id", xml.alias("xml"))).select("page_id", "kind", "loc", "lastmod")


@query(f"""SELECT page_id, CASE WHEN page_id % 3 = 0 AND contains(html, '<title>') THEN 'OG ' || CAST(page_id AS STRING) ELSE {PLAIN.format(x=DECODE.format(x=TITLE))} END AS title,
    CASE WHEN contains(html, '<title>') THEN CASE WHEN page_id % 5 = 0 THEN 'LD ' || CAST(page_id AS STRING) WHEN page_id % 4 = 1 THEN 'By ' || CAST(page_id AS STRING) END END AS author,
    CASE WHEN contains(html, '<title>') THEN CASE page_id % 5 WHEN 0 THEN 1704164645 WHEN 1 THEN 1706918400 END END AS published_at FROM pages""")
def src6_page_metadata(t):
    """Pages with meta tags and JSON-LD put before their titles: a script that isn't JSON, and one with the author in a node of its graph."""
    extra = F.expr("""concat(CASE WHEN page_id % 3 = 0 THEN concat('<meta property="og:title" content="OG ', page_id, '">') ELSE '' END,
        CASE page_id % 4 WHEN 1 THEN concat('<META content="By ', page_id, '" name="author">') WHEN 2 THEN '<meta property="article:author" content="https://x.example.com/me"><meta name="author" content="undefined">' ELSE '' END,
        CASE page_id % 5 WHEN 0 THEN concat('<script type="application/ld+json">{"author": bad</script><script type="application/ld+json">{"@graph":[{"@type":"WebSite"},{"mainEntity":{"author":[{"name":"LD ', page_id, '"}],"datePublished":"2024-01-02T03:04:05Z"}}]}</script>')
        WHEN 1 THEN '<meta property="article:published_time" content="2024-02-03T00:00:00Z">' ELSE '' END)""")
    rows = t.pages.select("page_id", F.replace("html", F.lit("<title>"), F.concat(extra, F.lit("<title>"))).alias("html"))
    return feeds.page_metadata(rows).select("page_id", "title", "author", epoch("published_at"))


_TOP = "(SELECT * FROM posts ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 200)"


@query(f"""WITH p AS {_TOP} SELECT 'posts' AS part, CAST(id AS STRING) AS key, CASE WHEN length(original_excerpt) > 500 THEN substr(original_excerpt, 1, 500) || '…' ELSE original_excerpt END AS value FROM p
    UNION ALL SELECT 'publications', CAST(post_id AS STRING), hash_kind FROM publications WHERE post_id IN (SELECT id FROM p) UNION ALL SELECT 'removals', CAST(post_id AS STRING), reason FROM removals WHERE post_id IN (SELECT id FROM p)
    UNION ALL SELECT 'evidence', url_hash, host FROM (SELECT sha256(lower(trim(url))) AS url_hash, e.host FROM evidence e JOIN posts USING (id)) WHERE url_hash IN (SELECT sha256(lower(trim(url))) FROM p) UNION ALL SELECT 'gates', host, 'seen' FROM (SELECT DISTINCT host FROM posts) WHERE host IN (SELECT host FROM p)""")
def src8_consistent_extract(t):
    """The extract written as JSON lines and read back."""
    evidence = t.evidence.join(t.posts.select("id", "url"), "id").select(urls.url_key(F.col("url")).alias("url_hash"), "host")
    parts = feeds.consistent_extract(t.posts, 200, by_post={"publications": t.publications, "removals": t.removals}, by_url={"evidence": evidence}, by_host={"gates": t.posts.select("host").distinct()})
    path = f"{shared_dir(t.spark)}/extract-{uuid.uuid4().hex}"
    feeds.write_json_lines(parts, path)
    shown = {"posts": ("id", "original_excerpt"), "publications": ("post_id", "hash_kind"), "removals": ("post_id", "reason"), "evidence": ("url_hash", "host"), "gates": ("host", None)}
    out = None
    for name, (key, value) in shown.items():
        lines = t.spark.read.schema(parts[name].schema).json(f"{path}/{name}")
        rows = lines.select(F.lit(name).alias("part"), F.col(key).cast("string").alias("key"), (F.col(value) if value else F.lit("seen")).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


# The tables have no character that NFKC changes, so the SQL leaves it out; tests/test_rules.py has such characters.
_RULE = r"""CASE WHEN regexp_matches({x}, '@[A-Za-z0-9_.]{{2,}}') THEN 'personal_info_sns_handle' WHEN len(list_filter(regexp_extract_all({x}, '([\p{{L}}\p{{N}}ー]{{1,10}})(?:さん|様|氏|くん|君|ちゃん)', 1), lambda n: n NOT IN ({safe}))) > 0 THEN 'personal_info_honorific' END"""


def rule_sql(x: str) -> str:
    return _RULE.format(x=x, honorific=HONORIFIC, safe=", ".join(f"'{p}'" for p in SAFE_PREFIXES))


_TERMS = r"""list_distinct(list_filter(list_transform(regexp_split_to_array({x}, '(?:の|を|に|は|が|で|と|も|や|から|まで|より|へ|・|、|。|「|」|【|】|\[|\]|\(|\)|\s+)'), lambda t: trim(t)), lambda t: length(t) >= 2 AND NOT regexp_matches(t, '^[\p{{P}}\p{{S}}0-9０-９\s]+$')))"""


@query(f"SELECT doc_id, {rule_sql('text')} AS rule FROM documents")
def p16_pii_scan(t):
    return t.documents.select("doc_id", topics.pii_rule(topics.nfkc("text")).alias("rule"))


@query(f"SELECT post_id, CASE WHEN topic_anchor IS NULL THEN NULL WHEN length({STRIP.format(x='topic_anchor')}) < 6 THEN 'anchor_too_short' WHEN {rule_sql('topic_anchor')} IS NOT NULL THEN 'anchor_prohibited_term' ELSE 'ok' END AS gate FROM rationales")
def p17_anchor_gate(t):
    return t.rationales.select("post_id", topics.anchor_gate(F.col("topic_anchor"), topics.nfkc("topic_anchor")).alias("gate"))


@query(f"SELECT id, array_to_string(list_sort({_TERMS.format(x='original_title')}), '|') AS terms FROM posts")
def p18_feature_terms(t):
    return t.posts.select("id", F.array_join(F.array_sort(topics.feature_terms(topics.nfkc("original_title"))), "|").alias("terms"))


_OWN = f"list_transform(list_filter({_TERMS.format(x='n')}, lambda t: t NOT IN ('理由', '背景', '経緯', '決め手')), lambda t: lower(t))"


@query(rf"""WITH lists AS (SELECT r.post_id, string_split(topics, '|') AS l, original_title AS title, anchor FROM raw_topics r JOIN posts p ON p.id = r.post_id), flat AS (SELECT post_id, title, anchor, unnest(range(len(l))) AS place, unnest(l) AS topic FROM lists), named AS (SELECT *, {STRIP.format(x='topic')} AS n FROM flat),
    weighed AS (SELECT *, CASE WHEN length(n) NOT BETWEEN 2 AND 10 THEN 'length_out_of_bounds' WHEN regexp_matches(n, '[0-9０-９]') THEN 'contains_digit' WHEN regexp_matches(n, '[\p{{P}}\p{{S}}\s]') THEN 'contains_symbol_or_punctuation'
        WHEN {rule_sql("n")} IS NOT NULL THEN 'contains_pii' WHEN coalesce(n = {STRIP.format(x="anchor")}, FALSE) THEN 'identical_to_anchor' END AS first_reason,
        regexp_matches(n, '[\x{{30A1}}-\x{{30FA}}]') AND len({_OWN}) > 0 AND NOT coalesce(list_has_any({_OWN}, list_transform({_TERMS.format(x="coalesce(title, '')")}, lambda t: lower(t))), FALSE) AS ungrounded FROM named),
    able AS (SELECT *, first_reason IS NULL AND NOT ungrounded AS able FROM weighed), counted AS (SELECT *, row_number() OVER (PARTITION BY post_id, able, lower(n) ORDER BY place) AS nth FROM able), ranked AS (SELECT *, sum(CAST(able AND nth = 1 AS INT)) OVER (PARTITION BY post_id ORDER BY place) AS rank FROM counted)
    SELECT post_id, place, topic, n AS normal, coalesce(first_reason, CASE WHEN ungrounded THEN 'ungrounded_proper_noun' WHEN nth > 1 THEN 'duplicate_topic' WHEN rank > 4 THEN 'over_limit' END) AS reason FROM ranked""")
def p19_validate_topics(t):
    rows = t.raw_topics.join(t.posts.select(F.col("id").alias("post_id"), F.col("original_title").alias("title")), "post_id")
    return topics.validate_topics(rows.select("post_id", F.split("topics", r"\|").alias("topics"), "title", "anchor"), "post_id")


_SECRET = b"not a secret: a parameter of the query"
_PADS = ["".join(f"{b ^ pad:02x}" for b in _SECRET.ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query(f"SELECT post_id, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(CAST(post_id AS STRING) || '|' || coalesce(topic_anchor, '') || '|' || coalesce(prompt_version, ''))))) AS signature FROM rationales")
def p30_topic_signature(t):
    fields = [F.col("post_id").cast("string"), F.col("topic_anchor"), F.col("prompt_version")]
    return t.rationales.select("post_id", topics.hmac_signature(fields, _SECRET).alias("signature"))


def model_replies(t):
    """Replies of 30 documents each: one in 10 fenced, one in 25 broken, one item in 400 out of range, some missing or twice."""
    k = F.col("doc_id")
    fields = {
        "index": (k % 30 + 1).cast("int"), "title": F.concat(F.lit("title of "), k.cast("string")), "summary": F.rpad(F.concat(F.lit("summary "), k.cast("string")), 80, "."),
        "category": F.concat(F.lit("cat"), (k % 11).cast("string")), "tag": F.when(k % 2 == 0, "trend").otherwise("classic"), "firsthand": F.when(k % 400 == 7, 12).otherwise(k * 7 % 10).cast("int"), "ceremonyDecision": (k * 3 % 10).cast("int"),
        "specific": (k * 11 % 10).cast("int"), "weddingDayContent": (k * 13 % 10).cast("int"), "promotional": (k * 17 % 10).cast("int"), "topicAnchor": F.lit("an anchor"), "topics": F.array(F.lit("one"), F.lit("t2"), F.lit("three")),
    }
    batch = F.floor(k / 30)
    items = t.documents.where(k % 13 != 0).select(batch.alias("batch_id"), F.struct(*(v.alias(n) for n, v in fields.items())).alias("item"))
    body = F.to_json(F.struct(F.array_sort(F.collect_list("item")).alias("items")))
    b = F.col("batch_id")
    return items.groupBy("batch_id").agg(body.alias("r")).select("batch_id", F.when(b % 25 == 24, F.substring("r", 1, 40)).when(b % 10 == 3, F.concat(F.lit("```json\n"), F.col("r"), F.lit("\n```"))).otherwise(F.col("r")).alias("response"))


@query("""WITH bad AS (SELECT DISTINCT doc_id // 30 AS batch_id FROM documents WHERE doc_id % 400 = 7 AND doc_id % 13 <> 0)
    SELECT doc_id AS id, CASE WHEN ok THEN 'title of ' || CAST(doc_id AS STRING) END AS title, CASE WHEN ok THEN CAST(doc_id * 7 % 10 AS INT) END AS firsthand, CASE WHEN ok THEN 'one|three' END AS topics
    FROM (SELECT doc_id, doc_id % 13 <> 0 AND doc_id // 30 % 25 <> 24 AND doc_id // 30 NOT IN (SELECT batch_id FROM bad) AS ok FROM documents)""")
def p23_parse_model_responses(t):
    inputs = t.documents.select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 30).alias("batch_id"), (F.col("doc_id") % 30 + 1).cast("int").alias("index"))
    return responses.parse_responses(model_replies(t), inputs, CATEGORIES).select("id", "title", "firsthand", F.array_join("topics", "|").alias("topics"))


@query("""SELECT 'd' || CAST(doc_id AS STRING) AS id, CASE WHEN doc_id % 13 = 0 OR doc_id // 25 % 20 = 19 THEN '' ELSE lang || '|' || source END AS topics FROM documents""")
def p24_parse_topic_responses(t):
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    items = t.documents.where("doc_id % 13 != 0").select(F.floor(F.col("doc_id") / 25).alias("batch_id"), F.struct(name.alias("id"), F.array("lang", "source").alias("topics")).alias("item"))
    body = F.to_json(F.struct(F.collect_list("item").alias("items")))
    replies = items.groupBy("batch_id").agg(body.alias("r")).select("batch_id", F.when(F.col("batch_id") % 20 == 19, F.substring("r", 1, 30)).otherwise(F.col("r")).alias("response"))
    return responses.parse_topic_responses(replies, t.documents.select(name.alias("id"))).select("id", F.array_join("topics", "|").alias("topics"))


@query("""SELECT 'r1' AS run, id AS record, host AS source_host, source_id, 200 AS http_status, 'none' AS redirect, CASE WHEN id % 7 = 0 THEN 'blocked_robots' ELSE 'success' END AS gate_reason, length(original_title) AS bytes, 5 AS timing_ms, 1 AS attempt, CASE WHEN id % 7 <> 0 THEN sha256(original_title) END AS digest,
    CASE WHEN id % 7 <> 0 THEN sha256(CAST(id AS STRING) || chr(0) || url || chr(0) || sha256(original_title) || chr(0) || 'v3') END AS signature, 'v3' AS version, coalesce(n, 0) AS old_topics, CASE WHEN id % 7 = 0 THEN coalesce(n, 0) WHEN id % 5 = 0 THEN 0 ELSE 2 END AS new_topics, CASE WHEN id % 7 = 0 THEN 'no_op' ELSE 'success' END AS outcome
    FROM posts LEFT JOIN (SELECT post_id, count(*) AS n FROM topics GROUP BY post_id) l ON l.post_id = id""")
def m19_topic_backfill_audit(t):
    return _audited(t)[0]


def _audited(t):
    """Pages of every seventh post can't be read, every fifth one gets no topics."""
    posts = t.posts.select("id", "url", "source_id")
    fetched = t.posts.select("id", F.when(F.col("id") % 7 == 0, "blocked_robots").otherwise("success").alias("verdict"), F.length("original_title").alias("bytes"), F.lit(5).alias("timing_ms"), F.sha2("original_title", 256).alias("digest"))
    after = t.posts.where("id % 7 != 0").select("id", F.when(F.col("id") % 5 != 0, F.array("source_id", "host")).otherwise(F.array().cast("array<string>")).alias("topics"))
    return responses.topic_audit(feed.attach_topics(posts, t.topics), fetched, after, "r1", "v3"), after


@query("SELECT post_id, position, topic FROM topics WHERE post_id % 7 = 0 OR post_id % 5 = 0 UNION ALL SELECT id, 0, source_id FROM posts WHERE id % 7 <> 0 AND id % 5 <> 0 UNION ALL SELECT id, 1, host FROM posts WHERE id % 7 <> 0 AND id % 5 <> 0")
def m19_backfilled_topics(t):
    audit, after = _audited(t)
    return responses.backfilled_topics(t.topics, audit, after)


_REFETCHED = "(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN substr(text, 1, CAST(floor(length(text) / 2) AS INT)) || reverse(substr(text, 1, CAST(floor(length(text) / 2) AS INT))) ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0)"


@query(f"""WITH old AS {SIMHASH.format(rows="documents")}, new AS {SIMHASH.format(rows=_REFETCHED)},
    j AS (SELECT post_id, hash_kind, new.simhash AS fetched, CASE WHEN new.simhash IS NULL THEN 0.0 ELSE 1 - bit_count(xor(('0x' || old.simhash)::UBIGINT, ('0x' || new.simhash)::UBIGINT)::HUGEINT) / 64 END AS similarity FROM publications p JOIN old ON old.doc_id = post_id LEFT JOIN new ON new.doc_id = post_id)
    SELECT post_id, similarity, CASE WHEN fetched IS NULL THEN 'skipped' WHEN hash_kind <> 'body' THEN 'surrogate_skipped' WHEN similarity < 0.7 THEN 'body_changed' ELSE 'ok' END AS outcome FROM j""")
def j09_body_drift(t):
    """Texts refetched: the last half of every fifth one is replaced, every seventh one is gone."""
    old, new = _hashed(t)
    published = t.publications.select("post_id", "hash_kind").join(old, "post_id")
    return responses.body_drift(published, new, CONFIG.drift_similarity).select("post_id", "similarity", "outcome")


def _hashed(t):
    first = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    new = t.documents.where("doc_id % 7 != 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(first, F.reverse(first))).otherwise(F.col("text")).alias("text"))
    return tuple(scoring.simhash64(df, "doc_id", "text").toDF("post_id", "body_hash") for df in (t.documents.select("doc_id", "text"), new))


@query("""WITH v AS (SELECT url, arg_max(verdict, seq) AS page FROM page_verdicts GROUP BY url), h AS (SELECT host, arg_max(verdict, seq) AS terms FROM terms_verdicts GROUP BY host),
    o AS (SELECT id, CASE WHEN terms IN ('K2', 'K3') THEN 'tos_changed' WHEN terms IN ('K1', 'B1') THEN 'skipped' WHEN page = 'K2' THEN 'tos_changed' WHEN page = 'robots' THEN 'robots_disallowed' WHEN page IN ('404', '410') THEN 'source_gone'
        WHEN page IN ('304', 'too_large') THEN 'ok' WHEN page = '200' THEN 'compare' ELSE 'skipped' END AS outcome FROM posts LEFT JOIN v USING (url) LEFT JOIN h USING (host) WHERE status = 'published' AND id NOT IN (SELECT post_id FROM removals))
    SELECT id, outcome, CASE WHEN outcome IN ('tos_changed', 'robots_disallowed', 'source_gone') THEN outcome END AS reason FROM o""")
def j10_retraction_reasons(t):
    return responses.retraction_reasons(t.posts, t.page_verdicts, t.terms_verdicts, t.removals).select("id", "outcome", "reason")


_PAGE_HOST = "lower(split_part(split_part(url, '://', 2), '/', 1))"
_WEB_PATH = "regexp_extract(url, '://[^/?#]+([^#]*)', 1)"


@query(rf"""WITH u AS (SELECT DISTINCT {_PAGE_HOST} AS host, {_WEB_PATH} AS path FROM pages),
    latest AS (SELECT host, string_split_regex(arg_max(robots_text, seq), '\r\n|\n') AS parts FROM robots_snapshots GROUP BY host), lines AS (SELECT host, unnest(parts) AS line, unnest(range(len(parts))) AS line_no FROM latest),
    keyed AS (SELECT host, line_no, lower(trim(split_part(line, ':', 1))) AS kind, trim(regexp_replace(regexp_replace(line, '#.*$', ''), '^[^:]*:?', '')) AS v FROM lines),
    rows AS (SELECT *, kind = 'user-agent' AND coalesce(lag(kind) OVER (PARTITION BY host ORDER BY line_no), '') <> 'user-agent' AS begins FROM keyed WHERE kind IN ('user-agent', 'allow', 'disallow')),
    grps AS (SELECT *, sum(CAST(begins AS INT)) OVER (PARTITION BY host ORDER BY line_no) AS grp FROM rows), own AS (SELECT DISTINCT host, grp FROM grps WHERE kind = 'user-agent' AND regexp_matches(v, '^(?i)gleanbot(/|$)')),
    every AS (SELECT DISTINCT host, grp FROM grps WHERE kind = 'user-agent' AND v = '*' AND host NOT IN (SELECT host FROM own)),
    r AS (SELECT DISTINCT g.host, replace(replace(v, '%65', 'e'), '%5F', '_') AS v, kind = 'allow' AS allow FROM grps g JOIN (SELECT * FROM own UNION ALL SELECT * FROM every) c ON c.host = g.host AND c.grp = g.grp WHERE kind <> 'user-agent' AND v <> ''),
    hit AS (SELECT u.host, u.path, allow, row_number() OVER (PARTITION BY u.host, u.path ORDER BY length(v) DESC, allow DESC) AS n FROM u JOIN r ON r.host = u.host AND regexp_matches(u.path, '^' || replace(replace(replace(v, '.', '\.'), '?', '\?'), '*', '.*')))
    SELECT u.host, u.path, NOT coalesce(allow, TRUE) AS blocked FROM u LEFT JOIN hit ON hit.host = u.host AND hit.path = u.path AND n = 1""")
def j11_robots_blocked(t):
    urls = t.pages.select(F.expr(_PAGE_HOST).alias("host"), F.regexp_extract("url", "://[^/?#]+([^#]*)", 1).alias("path")).distinct()
    return robots.robots_blocked(urls, robots.robots_rules(t.robots_snapshots, "GleanBot"))


_LISTS = "(SELECT post_id AS id, list(topic ORDER BY position) AS topics FROM topics {w} GROUP BY post_id)"


@query(f"SELECT coalesce(a.id, b.id) AS id, a.topics IS NOT DISTINCT FROM b.topics AS same FROM {_LISTS.format(w='')} a FULL JOIN {_LISTS.format(w='WHERE NOT (post_id % 3 = 0 AND position = 1)')} b ON a.id = b.id")
def j12_topic_shadow_eval(t):
    return _shadow(t).select("id", "same")


def _shadow(t):
    ids = t.topics.select(F.col("post_id").alias("id")).distinct()
    lists = feed.attach_topics(ids, t.topics)
    other = feed.attach_topics(ids, t.topics.where("not (post_id % 3 = 0 and position = 1)")).where("size(topics) > 0")
    return responses.topic_shadow_eval(lists, other)


@query(f"WITH s AS (SELECT a.topics IS NOT DISTINCT FROM b.topics AS same FROM {_LISTS.format(w='')} a FULL JOIN {_LISTS.format(w='WHERE NOT (post_id % 3 = 0 AND position = 1)')} b ON a.id = b.id) SELECT count(*) AS n, count(*) FILTER (same) AS matches, coalesce(avg(CAST(same AS DOUBLE)), 1.0) AS rate FROM s")
def j12_topic_match_rate(t):
    return responses.topic_match_rate(_shadow(t))


@query(f"""WITH v AS (SELECT url, arg_max(verdict, seq) AS page FROM page_verdicts GROUP BY url), h AS (SELECT host, arg_max(verdict, seq) AS terms FROM terms_verdicts GROUP BY host),
    o AS (SELECT id, CASE WHEN terms IN ('K2', 'K3') THEN 'tos_changed' WHEN terms IN ('K1', 'B1') THEN 'skipped' WHEN page = 'K2' THEN 'tos_changed' WHEN page = 'robots' THEN 'robots_disallowed' WHEN page IN ('404', '410') THEN 'source_gone'
        WHEN page IN ('304', 'too_large') THEN 'ok' WHEN page = '200' THEN 'compare' ELSE 'skipped' END AS outcome FROM posts LEFT JOIN v USING (url) LEFT JOIN h USING (host) WHERE status = 'published' AND id NOT IN (SELECT post_id FROM removals)),
    old AS {SIMHASH.format(rows="documents")}, new AS {SIMHASH.format(rows=_REFETCHED)},
    d AS (SELECT post_id, CASE WHEN new.simhash IS NULL THEN 'container_not_found' WHEN post_id % 6 = 0 THEN 'seed' WHEN hash_kind <> 'body' THEN 'surrogate_skipped' WHEN 1 - bit_count(xor(('0x' || old.simhash)::UBIGINT, ('0x' || new.simhash)::UBIGINT)::HUGEINT) / 64 < 0.7 THEN 'body_changed' ELSE 'ok' END AS drift
        FROM publications p JOIN old ON old.doc_id = post_id LEFT JOIN new ON new.doc_id = post_id)
    SELECT CASE WHEN outcome = 'compare' THEN coalesce(drift, 'container_not_found') ELSE outcome END AS outcome, count(*) AS n FROM o LEFT JOIN d ON d.post_id = o.id GROUP BY 1""")
def a09_revalidation_stats(t):
    """Bodies of every sixth publication weren't hashed yet."""
    old, new = _hashed(t)
    published = t.publications.select("post_id", "hash_kind").join(old, "post_id").withColumn("body_hash", F.when(F.col("post_id") % 6 != 0, F.col("body_hash")))
    reasons = responses.retraction_reasons(t.posts, t.page_verdicts, t.terms_verdicts, t.removals)
    return responses.revalidation_stats(reasons, responses.body_drift(published, new, CONFIG.drift_similarity))


_PLAN = "SELECT id, CASE WHEN id % 6 = 0 THEN 'llm_failed' WHEN id % 6 = 1 THEN 'gate_degrade' ELSE 'updated' END AS outcome FROM posts"


@query(f"SELECT id, outcome, outcome <> 'llm_failed' AS writes_texts, outcome <> 'llm_failed' AS writes_score, outcome = 'updated' AS writes_hash FROM ({_PLAN})")
def m16_plan_backfill(t):
    results = t.posts.where("id % 6 != 0").select("id", (F.col("id") % 6 != 1).alias("anchor_ok"))
    return responses.plan_backfill(t.posts.select("id"), results).select("id", "outcome", "writes_texts", "writes_score", "writes_hash")


@query(f"SELECT id, outcome, outcome = 'updated' AS writes_score, outcome = 'updated' AS writes_topics FROM ({_PLAN})")
def m17_plan_sliceless_backfill(t):
    results = t.posts.where("id % 6 != 0").select("id", (F.col("id") % 6 != 1).alias("anchor_ok"))
    return responses.plan_backfill(t.posts.select("id"), results, degrade_omits_score=True).select("id", "outcome", "writes_score", "writes_topics")


@query(f"""WITH p AS (SELECT p.id, p.outcome, CASE WHEN p.id % 4 <> 3 THEN 'anchor_' || (p.id % 3) END AS reason, string_split(topics, '|') AS l FROM ({_PLAN}) p LEFT JOIN raw_topics r ON r.post_id = p.id), d AS (SELECT * FROM p WHERE outcome = 'gate_degrade'),
    rules AS (SELECT {rule_sql("topic")} AS rule FROM (SELECT unnest(list_concat(l, ['佐藤さん', '@abc'])) AS topic FROM d WHERE l IS NOT NULL))
    SELECT 'outcome' AS kind, outcome AS value, count(*) AS n FROM p GROUP BY outcome UNION ALL SELECT 'reason', coalesce(reason, 'unknown'), count(*) FROM d GROUP BY 2 UNION ALL SELECT 'rule', rule, count(*) FROM rules WHERE rule IS NOT NULL GROUP BY rule""")
def a10_outcome_counts(t):
    """Attempts of each post: its raw topics and two that name people."""
    results = t.posts.where("id % 6 != 0").select("id", (F.col("id") % 6 != 1).alias("anchor_ok"))
    planned = responses.plan_backfill(t.posts.select("id"), results).select("id", "outcome", F.when(F.col("id") % 4 != 3, F.concat(F.lit("anchor_"), (F.col("id") % 3).cast("string"))).alias("reason"))
    tried = t.raw_topics.select(F.col("post_id").alias("id"), F.concat(F.split("topics", r"\|"), F.array(F.lit("佐藤さん"), F.lit("@abc"))).alias("tried"))
    broken = F.transform("tried", lambda x: F.array_compact(F.array(topics.pii_rule(x))))
    return responses.backfill_summary(planned.join(tried.select("id", broken.alias("rejected")), "id", "left"))


@query(f"""WITH x AS (SELECT r.post_id, coalesce({COMPLETE}, FALSE) AS good, {RATIONALE.format(labels=RATIONALE_LABELS)} AS t FROM rationales r LEFT JOIN (SELECT post_id, CASE WHEN json_valid(criteria_json) THEN criteria_json END AS criteria_json FROM criteria) c ON c.post_id = r.post_id WHERE contains(rationale_text, 'the'))
    SELECT post_id, CASE WHEN NOT good THEN 'skipped' WHEN length(t) BETWEEN 38 AND 210 THEN 'rendered' ELSE 'error' END AS outcome, CASE WHEN good AND length(t) BETWEEN 38 AND 210 THEN t END AS rationale_text FROM x""")
def m18_rerender_rationales(t):
    return responses.rerendered_rationales(t.rationales, t.criteria, "the")


@query("SELECT post_id, position, topic FROM topics WHERE post_id % 5 <> 0 UNION ALL SELECT id, 0, 'old' FROM posts WHERE id % 10 = 0 UNION ALL SELECT post_id, position, topic FROM topics WHERE post_id % 5 = 0 AND post_id % 10 <> 0")
def m20_rollback_topics(t):
    journal = t.posts.where("id % 5 = 0").select(F.col("id").alias("post_id"), F.when(F.col("id") % 10 == 0, F.lit('{"prior":["old"]}')).otherwise("{}").alias("entry"))
    prior = journal.select("post_id", F.from_json("entry", "prior ARRAY<STRING>")["prior"].alias("topics")).where("topics is not null")
    return merges.replace_topics(t.topics, prior)


@query("SELECT id, CASE WHEN id % 9 = 0 THEN 'youtube' END AS embed_provider FROM posts")
def m22_merge_embeds(t):
    current = t.posts.select("id", F.lit(None).cast("string").alias("embed_provider"))
    return merges.merge_embeds(current, t.posts.where("id % 9 = 0").select("id", F.lit("youtube").alias("embed_provider")))


@query("SELECT url_hash, host, CASE WHEN CAST(substr(url_hash, 2) AS BIGINT) % 5 = 0 THEN 'skipped' WHEN CAST(substr(url_hash, 2) AS BIGINT) % 5 = 1 THEN status ELSE 'fetched' END AS status FROM discovery_seen")
def m13_advance_discovery_status(t):
    k = F.substring("url_hash", 2, 30).cast("long") % 5
    outcomes = t.discovery_seen.select("url_hash", F.when(k == 0, "no_title").when(k == 1, "budget").otherwise("ready").alias("outcome"))
    return merges.advance_discovery_status(t.discovery_seen.select("url_hash", "host", "status"), outcomes)


@query(f"""WITH robots AS (SELECT {_PAGE_HOST} AS host, arg_max(html, page_id) AS robots_text FROM pages WHERE page_id % 4 <> 0 GROUP BY 1), stored AS (SELECT {_PAGE_HOST} AS host, 'old' AS robots_hash, 'https://terms/' || CAST(max(page_id) % 3 AS STRING) AS terms_url, 'th' AS terms_hash FROM pages WHERE page_id % 3 <> 0 GROUP BY 1),
    listed AS (SELECT {_PAGE_HOST} AS host, 'https://terms/' || CAST(max(page_id) % 2 AS STRING) AS terms_url FROM pages WHERE page_id % 5 = 0 GROUP BY 1), hosts AS (SELECT host FROM robots UNION SELECT host FROM stored)
    SELECT h.host, coalesce(sha256(r.robots_text), s.robots_hash) AS robots_hash, coalesce(l.terms_url, s.terms_url) AS terms_url, CASE WHEN l.terms_url IS NULL OR l.terms_url IS NOT DISTINCT FROM s.terms_url THEN s.terms_hash END AS terms_hash
    FROM hosts h LEFT JOIN robots r ON r.host = h.host LEFT JOIN stored s ON s.host = h.host LEFT JOIN listed l ON l.host = h.host""")
def m14_sync_source_policy(t):
    host = F.expr(_PAGE_HOST).alias("host")
    pages = t.pages.select(host, "page_id", "html")
    snapshots = pages.where("page_id % 4 != 0").select("host", F.col("page_id").alias("seq"), F.col("html").alias("robots_text"))
    url = lambda k: F.concat(F.lit("https://terms/"), (F.max("page_id") % k).cast("string")).alias("terms_url")
    stored = pages.where("page_id % 3 != 0").groupBy("host").agg(F.lit("old").alias("robots_hash"), url(3), F.lit("th").alias("terms_hash"))
    return merges.sync_source_policy(stored, snapshots, pages.where("page_id % 5 = 0").groupBy("host").agg(url(2)))


@query("SELECT id, host, coalesce(CASE WHEN id % 6 <> 0 THEN text_length END, 0) AS text_length, coalesce(CASE WHEN id % 6 <> 0 THEN link_density END, 1.0) AS link_density, coalesce(CASE WHEN id % 6 <> 0 THEN paragraph_count END, 0) AS paragraph_count, k AS run FROM evidence, (SELECT 1 AS k UNION ALL SELECT 2) WHERE id % k = 0")
def m15_append_observations(t):
    """Two runs append to one table; the second one saw every other article."""
    path = f"{shared_dir(t.spark)}/observations-{uuid.uuid4().hex}"
    found = lambda c: F.when(F.col("id") % 6 != 0, F.col(c)).alias(c)
    rows = t.evidence.select("id", "host", found("text_length"), found("link_density"), found("paragraph_count"))
    merges.append_observations(rows.withColumn("run", F.lit(1)), path)
    return merges.append_observations(rows.where("id % 2 = 0").withColumn("run", F.lit(2)), path)


@query("SELECT 'posts' AS table_name, count(*) AS n FROM posts UNION ALL SELECT 'rationales', count(*) FROM rationales UNION ALL SELECT 'criteria', count(*) FROM criteria")
def src9_snapshot_write(t):
    tables = {"posts": t.posts.select("id", "ai_title", "ai_summary"), "rationales": t.rationales, "criteria": t.criteria}
    return feeds.snapshot_write(tables, f"{shared_dir(t.spark)}/snapshots-{uuid.uuid4().hex}", "2024-06-01")


@query("""WITH g AS (SELECT o.*, p.id AS known, lane = 'rss' AS feed FROM graded o LEFT JOIN posts p ON p.url = o.url), early AS (SELECT post_id, arg_min(kind, removed_at) AS kind, arg_min(reason, removed_at) AS reason FROM removals GROUP BY post_id),
    every AS (SELECT coalesce(p.url, g.url) AS url, p.id, p.status AS was, p.tag AS old_tag, p.ai_summary AS old_summary, p.category AS old_category, coalesce(p.original_title, g.title, g.url) AS original_title, e.kind, e.reason AS early_reason, g.outcome, g.detail, g.feed, g.title, g.excerpt, g.summary, g.category, g.tag, g.body_hash, g.text_length, g.lane
        FROM posts p FULL JOIN g ON g.url = p.url LEFT JOIN early e ON e.post_id = p.id)
    SELECT url, original_title, CASE WHEN kind = 'retracted' THEN 'retracted' WHEN kind IS NOT NULL THEN 'rejected' WHEN outcome = 'accepted' THEN 'published' WHEN outcome IS NOT NULL THEN 'rejected' ELSE was END AS status, CASE WHEN outcome = 'accepted' THEN CASE WHEN feed THEN tag ELSE 'classic' END ELSE old_tag END AS tag,
    CASE WHEN outcome = 'accepted' THEN summary ELSE old_summary END AS ai_summary, CASE WHEN outcome = 'accepted' AND category IS NOT NULL THEN category ELSE old_category END AS category,
    CASE WHEN outcome = 'accepted' THEN substr(sha256(coalesce(title, url) || chr(0) || CASE WHEN feed THEN coalesce(excerpt, '') ELSE '' END), 1, 16) END AS content_hash,
    coalesce(early_reason, CASE WHEN outcome <> 'accepted' THEN outcome || CASE WHEN outcome = 'extraction_insufficient' THEN ':' || coalesce(detail, 'unknown') ELSE '' END END) AS reason,
    CASE WHEN outcome = 'accepted' AND kind IS NULL THEN CASE WHEN feed THEN 'surrogate' ELSE 'body' END ELSE (SELECT any_value(hash_kind) FROM publications q WHERE q.post_id = every.id) END AS hash_kind,
    CASE WHEN outcome = 'accepted' THEN CASE WHEN lane = 'rss' THEN 2 ELSE 0 END ELSE (SELECT count(*) FROM topics t WHERE t.post_id = every.id) END AS n_topics FROM every""")
def m24_publish_outcomes(t):
    """Feed and discovery outcomes into tables of a new store, then read back as one row for each post."""
    store = Releases(t.spark, f"{shared_dir(t.spark)}/releases-{uuid.uuid4().hex}")
    text_ = F.lit(None).cast("string")
    store.write({
        "posts": t.posts.withColumn("content_hash", text_), "criteria": t.criteria, "rationales": t.rationales, "topics": t.topics, "removals": t.removals,
        "publications": t.publications.withColumn("body_hash", text_),
    })
    graded = t.graded.withColumn("topics", F.when(F.col("topics") == "", F.array().cast("array<string>")).otherwise(F.split("topics", r"\|")))
    merges.publish_outcomes(store, graded, at("2024-09-01"), "v9", "m")
    posts, removals, publications, topic_rows = (store.read(n) for n in ("posts", "removals", "publications", "topics"))
    first = removals.groupBy(F.col("post_id").alias("id")).agg(F.min_by("reason", "removed_at").alias("reason"))
    n_topics = topic_rows.groupBy(F.col("post_id").alias("id")).agg(F.count("*").alias("n_topics"))
    kinds = publications.select(F.col("post_id").alias("id"), "hash_kind")
    rows = posts.join(first, "id", "left").join(n_topics, "id", "left").join(kinds, "id", "left").fillna(0, ["n_topics"])
    return rows.select("url", "original_title", "status", "tag", "ai_summary", "category", "content_hash", "reason", "hash_kind", "n_topics")
