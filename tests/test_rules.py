"""Rules of the curation jobs on boundary cases."""

import datetime as dt
import itertools
import json
import os
import random
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from gleanery.config import CONFIG
from gleanery.functions import scoring, text, topics, urls
from gleanery.operators import candidates, feed, hosts, merges, metrics, responses
from gleanery.sources import feeds

START = dt.datetime(2024, 1, 1)


def one(spark, column, *values, ddl="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], ddl).select(column).collect()]


def test_canonical_urls(spark):
    cases = {
        "HTTPS://Example.COM/Path/?utm_source=x&a=1&fbclid=2#Top": "https://example.com/Path?a=1#Top",
        "http://a.b": "http://a.b/",
        "http://a.b/": "http://a.b/",
        "http://a.b/c/": "http://a.b/c",
        "http://a.b/c?utm_x=1": "http://a.b/c",
        "http://a.b/c?UTM_X=1&B=2": "http://a.b/c?B=2",
        "http://a.b/c?utm%5Fsource=1&q=a%20b&&c": "http://a.b/c?q=a+b&c=",  # written again in form encoding once a parameter goes
        "http://a.b/c?q=a%20b&&c&=": "http://a.b/c?q=a%20b&&c&=",  # as it is otherwise
        "http://a.b/c?q=%&fbclid": "http://a.b/c?q=%25",
        "http://a.b/c?%E7%8C%AB=%e7%8c%ab&utm_x": "http://a.b/c?%E7%8C%AB=%E7%8C%AB",
        "http://a.b/?": "http://a.b/?",
        "http://a.b/?utm_x=1": "http://a.b/",
        "http://a.b/#": "http://a.b/#",
        "http://a.b:80/x": "http://a.b/x",
        "https://a.b:443": "https://a.b/",
        "https://a.b:080/x": "https://a.b:80/x",
        "http://a.b:/x": "http://a.b/x",
        "http://u:p@A.b:81/x": "http://u:p@a.b:81/x",
        "http://a.b/x/../y/./z/..": "http://a.b/y",
        "http://a.b/../..": "http://a.b/",
        "http://a.b/%2E%2e/x/%2e": "http://a.b/x",
        "http://a.b/c//": "http://a.b/c/",
        "http://a.b\\c\\d": "http://a.b/c/d",
        "https:a.b/c": "https://a.b/c",
        " \thttp://a.b/c\nd ": "http://a.b/cd",
        "http://a.b/ア?イ#ウ": "http://a.b/%E3%82%A2?%E3%82%A4#%E3%82%A6",
        "http://a.b/a b<c>?d'e": "http://a.b/a%20b%3Cc%3E?d%27e",
        "http://[2001:DB8::1]:80/": "http://[2001:db8::1]/",
        "https://www.instagram.com/p/CUbHfhpswxt/": "https://www.instagram.com/p/CUbHfhpswxt",
        "http://a b/": None,
        "http://a.b:99999/": None,
        "http://a.b:x/": None,
        "http://": None,
        "javascript:alert(1)": None,
        "ftp://a.b/c": None,
        "nothing": None,
        None: None,
    }
    assert one(spark, urls.canonical_url(F.col("x")), *cases) == list(cases.values())


def test_canonical_urls_are_canonical(spark):
    odd = ["http://A.b:80/x/../%7e y/?utm_a=1&b=%7E#é", "https://a.b//c/?q=+%2B+&fbclid=1", "http://a.b/?a=1&&b"]
    once = one(spark, urls.canonical_url(F.col("x")), *odd)
    assert one(spark, urls.canonical_url(F.col("x")), *once) == once


def test_titles_with_pictographs_and_wide_blanks(spark):
    cases = {"●" * 3 + "○" * 3 + "▲" * 3 + "◆" * 2 + "ok": True, "☂★" * 5: True, "☂★" * 5 + "😀": False, "　題　": False, "　題名　": True, "!!!!": False, "題!!!!": False, "題!!!": True, "題\u3000\u3000\u3000\u3000名": True, "題\x07名": False}
    assert one(spark, text.title_ok(F.col("x")), *cases) == list(cases.values())
    assert one(spark, text.normalized_title(F.col("x")), "　題名\u00a0", "a　b\t\tc", "\ufeff&#x3042;&#12356;&amp;") == ["題名", "a　b c", "あい&"]


def test_wide_blanks_are_no_text(spark):
    html = "<p>　本文　です</p>\n<p>\u00a0x</p>"
    assert one(spark, text.visible_text(F.col("x")), html) == ["本文　です\nx"]
    assert [r.text_length for r in one(spark, text.signals(F.col("x")), html, "<p>　本文　です</p>", "　\u2003\ufeff")] == [5, 4, 0]
    hashes = one(spark, scoring.simhash(F.col("x")), "本文　です", "本文です", "本 文\u00a0で\u2028す")
    assert len(set(hashes)) == 1


def test_feed_texts_keep_noscript_and_decode_numbers(spark):
    html = ["It&#8217;s <noscript>kept</noscript>", "a<script>x</script>b<style>y</style>c", "  a　\u00a0b&nbsp; ", "<!-- c -->d"]
    assert one(spark, text.one_line(F.col("x")), *html) == ["It’s kept", "a b c", "a b", "d"]


def test_metadata_values_end_at_their_own_quote(spark):
    pages = ["""<meta property="og:title" content="It's here"><meta name='description' content='say "hi" > now'>""", """<META content='A "b"' PROPERTY='og:title'>"""]
    rows = feeds.page_metadata(spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "page_id int, html string")).orderBy("page_id").collect()
    assert [r.title for r in rows] == ["It's here", 'A "b"'] and rows[0].description == 'say "hi" > now'


def test_extracted_articles(spark):
    body = "<p>" + "text of the article " * 5 + "</p>"
    pages = [
        (1, "h", f"<title>Page</title><header><h1>Site name</h1></header><article><h1>Real &amp; <b>headline</b></h1>{body}</article>", "Real & headline", "ready"),
        (2, "h", f"<title> Page&nbsp;</title><h1>Site name</h1><article>{body}</article>", "Page", "ready"),
        (3, "other", f"<title>Page</title><article>{body}</article>", "Page", "container_not_found"),
        (4, "h", f"<h1>x</h1><article><h1>Real</h1>{body}</article>", None, "no_title"),
        (5, "h", "<title>Page</title><article><h1>　</h1><p>short</p></article>", "Page", "extraction_insufficient"),
        (6, "h", f"<title>Page</title><main><h1>First</h1><article><h1>Second</h1>{body}</article></main>", "First", "ready"),
        (7, "h", "<title>Page</title>", "Page", "container_not_found"),
        (8, "h", None, None, "no_title"),
        (9, "h", f"<title>Page</title><article><h1>Long</h1><p>{'猫' * 2000}</p></article>", "Long", "ready"),
    ]
    df = spark.createDataFrame([(k, f"u{k}", h, html) for k, h, html, _, _ in pages], "page_id int, url string, host string, html string")
    rules = spark.createDataFrame([("h", 1, "main"), ("h", 2, "article")], "host string, place int, selector string")
    got = {r.page_id: r for r in candidates.extracted(df, rules).collect()}
    assert {k: (r.title, r.outcome) for k, r in got.items()} == {k: (t, o) for k, _, _, t, o in pages}
    assert got[9].slice == "Long " + "猫" * 1495 and len(got[9].body_hash) == 16 and got[5].failed == "text_length" and got[5].body_hash is None and got[3].text_length is None
    inner = f"<h1>Real &amp; <b>headline</b></h1>{body}"
    assert got[1].body_hash == one(spark, scoring.simhash(text.visible_text(F.col("x"))), inner)[0]


def test_embed_providers(spark):
    cases = {
        "https://www.instagram.com/reel/abc/": "instagram", "https://instagram.com/user": "none", "https://www.tiktok.com/@me/video/12": "tiktok", "https://youtu.be/x": "youtube",
        "https://www.youtube.com/watch?v=1": "youtube", "https://www.youtube.com/watch?w=1": "none", "https://youtube.com/shorts/1": "youtube", "x": "none",
    }
    assert one(spark, urls.embed_provider(F.col("x")), *cases) == list(cases.values())


def test_titles(spark):
    assert one(spark, text.normalized_title(F.col("x")), " a&#x3042;&#12354; &amp;lt;\n b　", None) == ["aああ < b", None]
    cases = {"a": False, "ab": True, "a\x07b": False, "!!!!": False, "!!!a": True, "\N{PARTY POPPER} a" * 10: True, "\N{PARTY POPPER} a" * 11: False}
    assert one(spark, text.title_ok(F.col("x")), *cases) == list(cases.values())


def test_visible_text_and_signals(spark):
    html = "<p>Hello <b>world</b></p>\n<script>var a = '<p>';</script><!-- x --><p class='y'>a &amp; b <a href='/'>link</a></p>"
    assert one(spark, text.visible_text(F.col("x")), html) == ["Hello world\na & b link"]
    got = one(spark, text.signals(F.col("x")), html, "", "<a>abc</a>")
    assert [(r.text_length, round(r.link_density, 4), r.paragraph_count) for r in got] == [(17, 0.2353, 3), (0, 1.0, 0), (3, 1.0, 0)]


@pytest.mark.parametrize(("length", "density", "paragraphs", "failed"), [(30, 0.70, 1, []), (29, 0.70, 1, ["text_length"]), (30, 0.71, 0, ["link_density", "paragraph_count"])])
def test_evidence_boundaries(spark, length, density, paragraphs, failed):
    assert one(spark, text.failed_conditions(F.lit(length), F.lit(density), F.lit(paragraphs)), "x") == [failed]


def test_score_over_the_grid(spark):
    """All combinations of five levels, and odd JSON, against the formula in plain Python."""
    names = ("firsthand", "ceremonyDecision", "specific", "weddingDayContent", "promotional")
    grid = list(itertools.product((0, 1, 5, 7, 9), repeat=5))

    def formula(f, c, s, d, p):
        return (70 if c >= 1 and d >= 1 else 0) + 2 * c + 3 * f + 2 * s + 2 * d - 4 * (p >= 7)

    rows = [(json.dumps(dict(zip(names, g, strict=True))), float(formula(*g))) for g in grid]
    rows += [(None, 20.0), ("{", 20.0), ('{"a":1} x', 20.0), ("{}", 0.0), ('{"firsthand":true,"promotional":"heavy"}', -1.0), ('{"ceremonyDecision":"x","weddingDayContent":9}', 18.0)]
    df = spark.createDataFrame(rows, "x string, want double")
    assert df.where(scoring.usefulness(F.col("x")) != F.col("want")).count() == 0
    passed = [formula(*g) for g in grid if g[1] >= 1 and g[3] >= 1]
    assert min(passed) > max(formula(*g) for g in grid if not (g[1] >= 1 and g[3] >= 1))


def test_display_levels(spark):
    cases = ['{"firsthand":true,"ceremonyDecision":3.7,"specific":12,"weddingDayContent":-1,"promotional":"light"}', '{"firsthand":1}', "{", None]
    got = one(spark, scoring.display_levels(F.col("x")), *cases)
    assert got[0].asDict() == {"firsthand": 9, "ceremonyDecision": 3, "specific": 9, "weddingDayContent": 0, "promotional": 4}
    assert got[1:] == [None, None, None]


def test_simhash(spark):
    import hashlib

    def plain(t):
        s = "".join((t or "").split())
        tokens = [s[i : i + 4] for i in range(len(s) - 3)] if len(s) >= 4 else [s] if s else []
        bits = [0] * 64
        for x in tokens:
            h = int(hashlib.sha256(x.encode()).hexdigest()[:16], 16)
            for b in range(64):
                bits[b] += 1 if h >> b & 1 else -1
        return f"{sum(1 << b for b in range(64) if bits[b] > 0):016x}"

    texts = ["a rose is a rose is a rose", "abc", "", None, "ひらがなとカタカナ", "a b\tc\nd e"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    assert {r[0]: r[1] for r in scoring.simhash64(df, "k", "t").collect()} == {k: plain(t) for k, t in enumerate(texts)}
    pair = spark.createDataFrame([("f" * 16, "f" * 15 + "e"), ("f" * 16, "0" * 16), ("x", "f" * 16), (None, "f" * 16)], "a string, b string")
    assert [r[0] for r in pair.select(scoring.simhash_similarity(F.col("a"), F.col("b"))).collect()] == [1 - 1 / 64, 0.0, 0.0, 0.0]


def test_personal_information_and_anchors(spark):
    cases = {"mail @some_one": "personal_info_sns_handle", "田中さん": "personal_info_honorific", "花嫁さん": None, "＠ａｂｃ": "personal_info_sns_handle", "plain": None}
    assert one(spark, topics.pii_rule(topics.nfkc("x")), *cases) == list(cases.values())
    anchors = {"short": "anchor_too_short", "長いアンカーです": "ok", "鈴木様の式の話": "anchor_prohibited_term", None: None}
    assert one(spark, topics.anchor_gate(F.col("x"), topics.nfkc("x")), *anchors) == list(anchors.values())


def test_topics(spark):
    rows = [(1, ["a", "日程", "日程 ", "日程2", "日-程", "アンカー語", "チャペル", "ドレス", "会場", "料理", "装花", "音楽"], "ドレスの話", "アンカー語"), (2, [], "t", None)]
    got = topics.validate_topics(spark.createDataFrame(rows, "id int, topics array<string>, title string, anchor string"), "id").orderBy("place").collect()
    assert [r["reason"] for r in got] == ["length_out_of_bounds", None, "duplicate_topic", "contains_digit", "contains_symbol_or_punctuation", "identical_to_anchor", "ungrounded_proper_noun", None, None, None, "over_limit", "over_limit"]


def test_signature_is_an_hmac(spark):
    import hashlib
    import hmac

    for secret in (b"k", b"long" * 40):
        got = one(spark, topics.hmac_signature([F.col("x"), F.lit("b"), F.lit(None).cast("string")], secret), "a")
        assert got == [hmac.new(secret, b"a|b|", hashlib.sha256).hexdigest()]


def test_terms(spark):
    cases = {"クロールは禁止です。": True, "クロールは歓迎。転載ではない。禁止": False, "robots are 不可\nok": True, "": False}
    assert one(spark, text.restrictive(F.col("x")), *cases) == list(cases.values())
    assert one(spark, text.crawl_delay(F.col("x")), "Crawl-delay: 5\nuser-agent: b\ncrawl-delay: 12.5", "crawl-delay: 0", "none") == [12.5, None, None]


GATE_LOG = "fetch_id long, host string, purpose string, status int, ts timestamp, robots_hash string, x string"
HOUR = dt.timedelta(hours=1)


def gates(spark, logs):
    """Gate states by host of logs of (purpose, status, hours, hash) by host, as (gate, state, hours since, strikes, requests)."""
    rows = [(k, h, p, s, START + at * HOUR, found, "x") for h, log in logs.items() for k, (p, s, at, found) in enumerate(log)]
    got = hosts.host_gate_replay(spark.createDataFrame(rows, GATE_LOG).repartition(3)).collect()
    return {r.host: (r.gate, r.state, r.since and (r.since - START) / HOUR, r.strikes, r.requests) for r in got}


def test_host_gate(spark):
    a, n = "article", None
    cases = {
        "ok": ([(a, 200, 0, n), (a, None, 1, n), (n, 500, 2, n)], (n, n, n, 0, 3)),
        "denied": ([(a, 451, 0, n), (a, 403, 1, n)], ("K3", "permanent", 0, 0, 2)),
        "once": ([(a, 403, 0, n)], ("K4", "cool_off", 0, 1, 1)),
        "twice": ([(a, 403, 0, n), (a, 200, 200, n), (a, 403, 240, n), (a, 403, 241, n)], ("K4", "permanent", 240, 2, 4)),
        "robots": ([("robots", 403, 0, "x")], ("K5", "permanent", 0, 0, 1)),
        "no purpose": ([(n, 403, 0, n)], ("K5", "permanent", 0, 0, 1)),
        "limits": ([(a, 429, 0, n), (a, 429, 23, n)], ("K6", "permanent", 23, 0, 2)),
        "a day": ([(a, 429, 0, n), (a, 429, 24, n)], ("K6", "retry_after", 24, 0, 2)),
        "changed": ([("robots", 200, 0, "x"), ("robots", 404, 1, "y"), (a, 200, 2, "z"), ("robots", 200, 3, n), ("robots", 200, 4, "x"), ("robots", 200, 5, "y"), ("robots", 200, 6, "x"), (a, 451, 7, n)], ("K1", "stopped", 5, 0, 8)),
        "waits": ([(a, 403, 0, n), (a, 429, 5, n), (a, 200, 6, n)], ("K6", "retry_after", 5, 1, 3)),
    }
    assert gates(spark, {h: log for h, (log, _) in cases.items()}) == {h: want for h, (_, want) in cases.items()}
    until = hosts.host_gate_replay(spark.createDataFrame([(1, "a", a, 403, START, n, ""), (1, "b", a, 429, START, n, "")], GATE_LOG)).orderBy("host").collect()
    assert [r.until - START for r in until] == [24 * HOUR, dt.timedelta(seconds=60)]


def test_host_gate_equals_one_request_at_a_time(spark):
    rng = random.Random(8)
    logs = {}
    for h in range(60):
        hot = 400 if h == 0 else 12
        logs[f"h{h}"] = [(rng.choice(["article", "article", "robots", "sitemap"]), rng.choice([200] * (99 if h == 0 else 9) + [403, 429, 451 if h % 2 else 304]), 5 * k, rng.choice("x" * 30 + "y")) for k in range(hot)]
    want = {}
    for h, log in logs.items():
        s = hosts.replay(((p, status, 3600.0 * at, found) for p, status, at, found in log), hosts.new_state())
        want[h] = (s["gate"], s["state"], s["since"] and s["since"] / 3600, s["strikes"], s["requests"])
    assert gates(spark, logs) == want
    assert {v[0] for v in want.values()} >= {"K1", "K3", "K4", "K5", "K6"}


def test_replay_takes_hours_as_seconds():
    run = lambda *events: hosts.replay(iter(events), hosts.new_state())["state"]
    assert run(("article", 429, 0.0, None), ("article", 429, 86399.0, None)) == "permanent" and run(("article", 429, 0.0, None), ("article", 429, 86400.0, None)) == "retry_after"


def test_no_window_covers_a_day_or_a_host(spark):
    """Hot days and all rows are numbered along ranges, and equal ``row_number``."""
    rows = spark.range(2000).select("id", F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 7)).alias("day"), (F.col("id") % 3 > 0).alias("passed"))
    got = candidates.admit_under_cap(rows, "day", ["id"], 700)
    assert [r.id for r in got.where("admitted and day = 'hot'").orderBy("id").collect()] == [k for k in range(2000) if k % 10 and k % 3][:700]
    batches = feed.batch_ids(rows, 30, [F.desc("id")])
    assert {(r.id, r.batch, r["index"]) for r in batches.collect()} == {(1999 - k, k // 30, k % 30 + 1) for k in range(2000)}
    for df in (got, batches):
        windows = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [sum(_place" in line]
        assert windows and all("windowspecdefinition(_range" in w for w in windows)


QUEUE = "url_hash string, url string, host string, lane string, reason string, attempts int, first_queued_at timestamp, next_attempt_at timestamp, expires_at timestamp"


def test_retries(spark):
    queued = [(f"u{k}", f"http://h/{k}", "h", "rss", "r", k, START, START, START + 72 * HOUR) for k in range(5)]
    queue = spark.createDataFrame(queued, QUEUE)
    failed = spark.createDataFrame([(u, f"http://new/{u}", "new", "submit", "late") for u in ("u0", "u1", "u2", "u3", "x")], "url_hash string, url string, host string, lane string, reason string")
    now = F.lit("2024-01-02").cast("timestamp")
    out = merges.schedule_retries(queue, failed, now)
    got = {r.url_hash: r for r in out.collect()}
    day = START + 24 * HOUR
    assert {u: (r.attempts, (r.next_attempt_at - day) / HOUR, r.terminal, r.lane) for u, r in got.items() if u != "u4"} == {
        "u0": (1, 1, False, "submit"), "u1": (2, 6, False, "submit"), "u2": (3, 24, False, "submit"), "u3": (4, 24, True, "submit"), "x": (1, 1, False, "submit"),
    }
    assert tuple(got["u4"])[:9] == queued[4] and not got["u4"].terminal  # it didn't fail
    assert got["u0"].first_queued_at == START and got["x"].first_queued_at == day and got["x"].expires_at == day + 72 * HOUR
    assert {r.url_hash for r in merges.open_retries(out).collect()} == {"u0", "u1", "u2", "u4", "x"}
    edge = queue.withColumn("expires_at", now)
    assert {r["outcome"] for r in merges.expire_retries(edge, now).collect()} == {"retry_exhausted:r"}
    assert {r["outcome"] for r in merges.expire_retries(edge, now, ["discovery"]).collect()} == {"kept"}
    assert {r["outcome"] for r in merges.expire_retries(edge.withColumn("lane", F.lit("discovery")), now, ["discovery"]).collect()} == {f"retry_exhausted:r:attempts={k}" for k in range(5)}


def test_retractions_by_page_and_by_host(spark):
    posts = [(1, "u1", "h", "published"), (2, "u2", "h", "published"), (3, "u3", "k", "published"), (4, "u4", "k", "pending"), (5, "u5", "t", "published"), (6, "u6", "b", "published"), (7, "u7", "h", "published"), (8, "u8", None, "published")]
    df = spark.createDataFrame(posts, "id long, url string, host string, status string")
    pages = spark.createDataFrame([("u1", "200", 1), ("u1", "404", 2), ("u2", "404", 1), ("u2", "200", 2), ("u3", "robots", 1), ("u4", "404", 1), ("u5", "404", 1), ("u6", "410", 1), ("u7", "404", 1)], "url string, verdict string, seq long")
    terms = spark.createDataFrame([("t", "K2", 1), ("b", "K3", 1), ("b", "B1", 2), ("h", "ok", 1)], "host string, verdict string, seq long")
    gone = spark.createDataFrame([(7,)], "post_id long")
    got = {r.id: (r.outcome, r.reason) for r in responses.retraction_reasons(df, pages, terms, gone).collect()}
    assert got == {1: ("source_gone", "source_gone"), 2: ("compare", None), 3: ("robots_disallowed", "robots_disallowed"), 5: ("tos_changed", "tos_changed"), 6: ("skipped", None)}


def test_upsert_refreshes_the_thumbnail(spark):
    names = "id long, url string, " + ", ".join(f"{c} string" for c in (*merges.REFRESHED, "status", "ai_title"))
    old, new = [tuple([1, "u"] + [x] * (len(merges.REFRESHED) + 2)) for x in ("old", "new")]
    row = merges.upsert_posts(spark.createDataFrame([old], names), spark.createDataFrame([new], names)).first()
    assert row.thumbnail_url == "new" and row.original_title == "new" and row.status == "old" and row.ai_title == "old"


@pytest.mark.parametrize(("before", "after", "stops"), [(10, 12, False), (10, 13, True), (10, 8, False), (10, 7, True), (0, 3, True), (3, 0, True), (0, 0, False)])
def test_restoring_stops_before_anything_comes_out(spark, before, after, stops):
    table = lambda n: spark.range(n).select("id", F.lit(n).cast("string").alias("title"))
    folder = urlparse(spark.conf.get("spark.checkpoint.dir")).path
    left = lambda: {f for f in os.listdir(folder) if f.startswith("restore-")} if os.path.isdir(folder) else set()
    known = left()
    pairs = {"posts": (table(5), table(5), "id", ["title"]), "rationales": (table(before), table(after), "id", ["title"])}
    if stops:
        with pytest.raises(merges.SnapshotMismatch, match=f"rationales: {before} rows in the snapshot, {after} now"):
            merges.restore_plan(pairs)
        assert left() == known
    else:
        plans = merges.restore_plan(pairs)
        assert plans["posts"].count() == 0 and plans["rationales"].count() == max(before, after)


def test_restored_rows(spark):
    current = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (4, "d", 8)], "id long, title string, n int")
    snapshot = spark.createDataFrame([(1, "x"), (2, None), (3, "c")], "id long, title string")
    rows = lambda insert: sorted(map(tuple, merges.restored(current, snapshot, "id", ["title"], insert).collect()))
    assert rows(False) == [(1, "x", 5), (2, None, 6), (4, "d", 8)] and rows(True) == [(1, "x", 5), (2, None, 6), (3, "c", None), (4, "d", 8)]


def test_first_removal_wins_in_any_order(spark):
    posts = spark.createDataFrame([(1, "published"), (2, "published"), (3, "pending")], "id long, status string")
    removals = [(1, "retracted", "b", 2), (1, "dropped", "a", 1), (2, "retracted", "x", 1)]
    for rows in (removals, removals[::-1]):
        df = spark.createDataFrame(rows, "post_id long, kind string, reason string, at long").withColumn("removed_at", F.timestamp_seconds("at"))
        got = {r["id"]: (r["status"], r["removed_for"]) for r in merges.apply_removals(posts, df).collect()}
        assert got == {1: ("rejected", "a"), 2: ("retracted", "x"), 3: ("pending", None)}


def test_cap(spark):
    rows = spark.sql("SELECT id, CASE WHEN id < 6 THEN 1 ELSE 2 END AS day, id % 3 <> 2 AS passed FROM range(9)")
    base = spark.createDataFrame([(1, 1)], "day int, n long")
    got = candidates.admit_under_cap(rows, "day", ["id"], 3, base).orderBy("id").collect()
    assert [r["admitted"] for r in got] == [True, True, False, False, False, False, True, True, False]


def test_merges_are_idempotent_and_keep_what_they_must(spark):
    names = "id long, url string, source_name string, original_title string, original_excerpt string, author string, published_at long, updated_at long, status string"
    old = spark.createDataFrame([(1, "a", "s", "t", "e", "x", 1, 1, "published"), (2, "b", "s", "t", None, None, 1, 1, "rejected")], names)
    new = spark.createDataFrame([(9, "a", "S", "T", "E", None, 2, 2, "pending"), (3, "c", "S", "T", "E", "X", 2, 2, "pending")], names)
    once = merges.upsert_posts(old, new)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(once) == [(1, "a", "S", "T", "E", None, 2, 2, "published"), (2, "b", "s", "t", None, None, 1, 1, "rejected"), (3, "c", "S", "T", "E", "X", 2, 2, "pending")]
    assert key(merges.upsert_posts(once, new)) == key(once) == key(merges.upsert_posts(old.repartition(7), new.repartition(3)))


def test_snapshot_diff_and_columns(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "z"), (3, "w", "w")], "id int, p string, q string")
    b = spark.createDataFrame([(1, "x", "n"), (2, "Y", None), (4, "w", "w")], "id int, p string, q string")
    got = sorted((r["id"], r["field"], r["before"], r["after"]) for r in merges.snapshot_diff(a, b, "id", ["p", "q"]).collect() if r["id"] < 3)
    assert got == [(1, "q", None, "n"), (2, "p", "y", "Y"), (2, "q", "z", None)]
    assert merges.snapshot_diff(a, b, "id", ["p"]).where("field like '%_now'").count() == 2
    with pytest.raises(ValueError, match="slice"):
        metrics.assert_columns_allowed(a.withColumn("slice", F.lit(1)), {"id", "p", "q"})


def test_page_counts(spark):
    rows = spark.sql("SELECT id, '{}' AS criteria_json, CAST(NULL AS TIMESTAMP) AS published_at FROM range(30)")
    assert feed.page(rows, 10).count() == 10 and feed.page(rows, 0).count() == CONFIG.page and feed.page(rows, 500).count() == CONFIG.page
    assert [r["id"] for r in feed.page(rows, 3).orderBy(F.desc("id")).collect()] == [29, 28, 27]
    assert {(r["has_more"], r["next_count"]) for r in feed.page(rows, 30).collect()} == {(False, 54)}


def test_feeds(spark):
    rss = """<rss xmlns:media="m" xmlns:content="c"><channel><item><title>A &amp;amp; B</title><link>http://x/1</link><content:encoded>&lt;p&gt;body &lt;img src="http://i/1.png"&gt;&lt;/p&gt;</content:encoded><pubDate>Mon, 01 Jan 2024 00:00:00 +0000</pubDate></item>
    <item><title>C</title><link>http://x/2</link><description/><media:thumbnail url="http://i/2.png"/><author>me</author></item></channel></rss>"""
    atom = """<feed><entry><title>D</title><link rel="edit" href="http://x/e"/><link rel="alternate" href="http://x/3"/><content>text</content><author><name>you</name></author><published>2024-01-02T03:04:05Z</published></entry></feed>"""
    df = spark.createDataFrame([(1, rss), (2, atom), (3, "<html/>"), (4, "broken <"), (5, None)], "f int, xml string")
    got = {r["link"]: r for r in feeds.feed_entries(df).collect()}
    assert set(got) == {"http://x/1", "http://x/2", "http://x/3"}
    assert (got["http://x/1"]["title"], got["http://x/1"]["excerpt"], got["http://x/1"]["thumbnail_url"]) == ("A & B", "body", "http://i/1.png")
    assert (got["http://x/2"]["excerpt"], got["http://x/2"]["author"], got["http://x/2"]["thumbnail_url"]) == (None, "me", "http://i/2.png")
    assert got["http://x/3"]["author"] == "you" and got["http://x/1"]["published_at"].year == 2024
    page = """<title>T</title><meta property="og:title" content="O &amp; G"><meta name="author" content="null"><script type="application/ld+json">{"author":{"name":"Jo"},"datePublished":"2024-05-06T00:00:00Z"}</script>"""
    meta = feeds.page_metadata(spark.createDataFrame([(1, page), (2, "<title>only</title>"), (3, None)], "k int, html string")).orderBy("k").collect()
    assert [(r["title"], r["author"]) for r in meta] == [("O & G", "Jo"), ("only", None), (None, None)]


def test_association(spark):
    rows = spark.createDataFrame([("a", "x")] * 5 + [("b", "y")] * 5 + [(None, "x")], "p string, q string")
    r = metrics.association(rows, "p", "q").first()
    assert (r["cramers_v"], r["entropy"]) == (1.0, 1.0)
