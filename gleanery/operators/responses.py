"""Raw model replies to graded items, and the plans made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import urls

ITEM = "index INT, title STRING, summary STRING, category STRING, tag STRING, firsthand INT, ceremonyDecision INT, specific INT, weddingDayContent INT, promotional INT, topicAnchor STRING, topics ARRAY<STRING>"


def unfenced(reply: Column) -> Column:
    """A reply without the code fence around it."""
    return F.regexp_replace(F.trim(reply), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1")


def parse_responses(replies: DataFrame, inputs: DataFrame, categories: list[str]) -> DataFrame:
    """One row for each input (batch_id, index, id) with its graded item, NULL when it is missing.

    A reply is good only if it parses and all its items keep to the limits; of items with one index the first counts.
    """
    parsed = replies.select("batch_id", F.from_json(unfenced(F.col("response")), f"items ARRAY<STRUCT<{ITEM.replace(' INT', ': INT').replace(' STRING', ': STRING').replace('topics ARRAY', 'topics: ARRAY')}>>").alias("r"))
    flat = parsed.where("r.items is not null").select("batch_id", F.posexplode("r.items").alias("place", "i"))
    i = F.col("i")
    levels = F.lit(True)
    for k in ("firsthand", "ceremonyDecision", "specific", "weddingDayContent", "promotional"):
        levels = levels & F.coalesce(i[k].between(0, 9), F.lit(False))
    good = i["index"].isNotNull() & F.length(i["title"]).between(1, 120) & F.length(i["summary"]).between(60, 200) & i["category"].isin(*categories) & i["tag"].isin("trend", "classic") & F.length(i["topicAnchor"]).between(1, 40) & i["topics"].isNotNull() & levels
    bad = flat.where(~F.coalesce(good, F.lit(False))).select("batch_id").distinct()
    kept = flat.join(bad, "batch_id", "left_anti")
    first = kept.groupBy("batch_id", i["index"].alias("index")).agg(F.min_by("i", "place").alias("i"))
    topics = F.slice(F.filter(i["topics"], lambda t: F.length(t).between(2, 10) & ~t.rlike("[0-9０-９]")), 1, 4)
    item = first.select("batch_id", "index", F.substring(i["title"], 1, 30).alias("title"), i["summary"].alias("summary"), i["category"].alias("category"), i["tag"].alias("tag"), *(i[k].alias(k) for k in ("firsthand", "ceremonyDecision", "specific", "weddingDayContent", "promotional")), i["topicAnchor"].alias("anchor"), topics.alias("topics"))
    return inputs.join(item, ["batch_id", "index"], "left")


def parse_topic_responses(replies: DataFrame, inputs: DataFrame) -> DataFrame:
    """Topics of each input id from replies with ``items`` of (id, topics): the first item of an id counts, a missing id has an empty list."""
    parsed = replies.select("batch_id", F.from_json(unfenced(F.col("response")), "items ARRAY<STRUCT<id: STRING, topics: ARRAY<STRING>>>").alias("r")).where("r.items is not null")
    flat = parsed.select("batch_id", F.posexplode("r.items").alias("place", "i")).where("i.id is not null and i.topics is not null")
    first = flat.groupBy(F.col("i.id").alias("id")).agg(F.min_by("i.topics", F.struct("batch_id", "place")).alias("topics"))
    return inputs.join(first, "id", "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))


#: What an audit row may hold: counts, digests and codes, no text of an article.
AUDIT = (
    "run", "record", "source_host", "source_id", "http_status", "redirect", "gate_reason", "bytes", "timing_ms", "attempt", "digest", "signature", "version", "old_topics", "new_topics", "outcome",
)


def topic_audit(before: DataFrame, fetched: DataFrame, after: DataFrame, run: str, version: str, dry: bool = False) -> DataFrame:
    """An audit row with the fields of ``AUDIT`` for each candidate (id, url, source_id, topics).

    ``fetched`` (id, verdict, bytes, timing_ms, digest) is what came of its page, ``after`` (id, topics) the new topics of
    those that could be read. A page that couldn't be read leaves everything as it is (no_op); the signature covers the
    candidate, its page's digest and the version.
    """
    lists = lambda df: df.select("id", F.col("topics").alias("_new"))
    rows = before.select("id", "url", "source_id", F.size("topics").alias("old_topics")).join(fetched.select("id", "verdict", "bytes", "timing_ms", "digest"), "id", "left").join(lists(after), "id", "left")
    good = F.coalesce(F.col("verdict") == "success", F.lit(False))
    signature = F.sha2(F.concat_ws("\0", F.col("id").cast("string"), "url", "digest", F.lit(version)), 256)
    new = F.coalesce(F.size("_new"), F.lit(0))
    return rows.select(
        F.lit(run).alias("run"), F.col("id").alias("record"), urls.host(F.col("url")).alias("source_host"), "source_id", F.lit(200).alias("http_status"), F.lit("none").alias("redirect"), F.coalesce("verdict", F.lit("not_fetched")).alias("gate_reason"),
        F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("timing_ms", F.lit(0)).alias("timing_ms"), F.lit(1).alias("attempt"), F.when(good, F.col("digest")).alias("digest"), F.when(good, signature).alias("signature"), F.lit(version).alias("version"),
        "old_topics", F.when(good, new).otherwise(F.col("old_topics")).alias("new_topics"), F.when(~good, "no_op").when(F.lit(dry), "dry_run_success").otherwise("success").alias("outcome"),
    )


def backfilled_topics(topics: DataFrame, audit: DataFrame, after: DataFrame) -> DataFrame:
    """Topics after an audited backfill: only lists that aren't empty, of candidates that succeeded, replace the old ones."""
    from gleanery.operators.merges import replace_topics

    done = audit.where("outcome = 'success' and new_topics > 0").select(F.col("record").alias("post_id"))
    return replace_topics(topics, after.select(F.col("id").alias("post_id"), "topics").join(done, "post_id", "left_semi"))


def plan_backfill(candidates: DataFrame, results: DataFrame, degrade_omits_score: bool = False) -> DataFrame:
    """Candidates with ``outcome``: llm_failed (no result), gate_degrade (no good anchor), updated; and what each writes."""
    r = results.select("id", F.lit(True).alias("found"), "anchor_ok")
    joined = candidates.join(r, "id", "left")
    outcome = F.when(F.col("found").isNull(), "llm_failed").when(~F.coalesce("anchor_ok", F.lit(False)), "gate_degrade").otherwise("updated")
    joined = joined.withColumn("outcome", outcome)
    done = F.col("outcome") == "updated"
    some = done | ((F.col("outcome") == "gate_degrade") & F.lit(not degrade_omits_score))
    return joined.withColumn("writes_texts", F.col("outcome") != "llm_failed").withColumn("writes_score", some).withColumn("writes_topics", some).withColumn("writes_hash", done).withColumn("writes_rationale", done)


def body_drift(published: DataFrame, fetched: DataFrame, threshold: float) -> DataFrame:
    """Published posts against refetched pages (both with post_id and a 16-digit hash): outcome by similarity.

    Only body hashes are compared; no page: skipped; no stored hash: seed.
    """
    from gleanery.functions.scoring import simhash_similarity

    joined = published.join(fetched.select("post_id", F.col("body_hash").alias("new_hash")), "post_id", "left")
    alike = simhash_similarity(F.col("body_hash"), F.col("new_hash"))
    outcome = F.when(F.col("new_hash").isNull(), "skipped").when(F.col("body_hash").isNull(), "seed").when(F.col("hash_kind") != "body", "surrogate_skipped").when(alike < threshold, "body_changed").otherwise("ok")
    return joined.withColumn("similarity", alike).withColumn("outcome", outcome)


def retraction_reasons(posts: DataFrame, verdicts: DataFrame, terms: DataFrame, removals: DataFrame) -> DataFrame:
    """Published posts (id, url, host, status) that aren't removed, with ``outcome`` and, where they are to be retracted, ``reason``.

    The latest verdict on a page (url, verdict, seq) counts for its own post only: 404 and 410, robots, and the gates K2 and
    K3 retract it, 304 and too large are fine, 200 is to be compared by its body, anything else leaves it. The latest check of
    a host's terms (host, verdict, seq) counts for all its posts and comes first: K2 and K3 retract, another gate or a spent
    budget leaves them alone whatever the pages say.
    """
    latest = lambda df, key, name: df.groupBy(key).agg(F.max_by("verdict", "seq").alias(name))
    live = posts.where("status = 'published' and host is not null and host != ''").join(removals.select(F.col("post_id").alias("id")), "id", "left_anti")
    joined = live.join(latest(verdicts, "url", "_page"), "url", "left").join(latest(terms, "host", "_terms"), "host", "left")
    page, host = F.col("_page"), F.col("_terms")
    outcome = (
        F.when(host.isin("K2", "K3"), "tos_changed").when(host.rlike("^(K[1-6]|B1)$"), "skipped")
        .when(page.isin("K2", "K3"), "tos_changed").when(page == "robots", "robots_disallowed").when(page.isin("404", "410"), "source_gone")
        .when(page.isin("304", "too_large"), "ok").when(page == "200", "compare").otherwise("skipped")
    )
    rows = joined.withColumn("outcome", outcome).drop("_page", "_terms")
    return rows.withColumn("reason", F.when(F.col("outcome").isin("tos_changed", "robots_disallowed", "source_gone"), F.col("outcome")))


def topic_shadow_eval(current: DataFrame, candidate: DataFrame) -> DataFrame:
    """Topic lists (id, topics) side by side with ``same`` (ordered equality)."""
    return current.select("id", F.col("topics").alias("before")).join(candidate.select("id", F.col("topics").alias("after")), "id", "full_outer").withColumn("same", F.col("before").eqNullSafe(F.col("after")))


def topic_match_rate(compared: DataFrame) -> DataFrame:
    """``(n, matches, rate)`` of ``topic_shadow_eval``; nothing to compare is a full match."""
    return compared.agg(F.count("*").alias("n"), F.count_if("same").alias("matches"), F.coalesce(F.avg(F.col("same").cast("double")), F.lit(1.0)).alias("rate"))


def revalidation_stats(reasons: DataFrame, drift: DataFrame) -> DataFrame:
    """Posts by what came of their revalidation: the outcomes of ``retraction_reasons``, and for pages to ``compare`` those of ``body_drift`` (post_id, outcome); without a container they are ``container_not_found``."""
    bodies = drift.select(F.col("post_id").alias("id"), F.col("outcome").alias("_drift"))
    body = F.coalesce(F.when(F.col("_drift") == "skipped", "container_not_found").otherwise(F.col("_drift")), F.lit("container_not_found"))
    outcome = F.when(F.col("outcome") == "compare", body).otherwise(F.col("outcome"))
    return reasons.join(bodies, "id", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def backfill_summary(rows: DataFrame) -> DataFrame:
    """``(kind, value, n)``: how often each ``outcome`` of a backfill (outcome, reason, rejected) came, each reason of a degrade, and each rule that a degrade's rejected attempts (arrays of rules) broke."""
    one = lambda kind, value: F.array(F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    none = F.array().cast("array<struct<kind: string, value: string>>")
    degraded = F.col("outcome") == "gate_degrade"
    rules = F.transform(F.flatten(F.coalesce("rejected", F.array().cast("array<array<string>>"))), lambda r: F.struct(F.lit("rule").alias("kind"), r.alias("value")))
    labels = F.concat(one("outcome", F.col("outcome")), F.when(degraded, one("reason", F.coalesce("reason", F.lit("unknown")))).otherwise(none), F.when(degraded, rules).otherwise(none))
    return rows.select(F.inline(labels)).where("value is not null").groupBy("kind", "value").agg(F.count("*").alias("n"))


def rerendered_rationales(rationales: DataFrame, criteria: DataFrame, label: str) -> DataFrame:
    """Rationales whose text has a removed ``label``, rendered again from the stored criteria: skipped without usable ones, error if the length is out of bounds."""
    from gleanery.functions import scoring

    rows = rationales.where(F.contains("rationale_text", F.lit(label))).join(criteria.select("post_id", "criteria_json"), "post_id", "left").withColumn("levels", scoring.display_levels(F.col("criteria_json")))
    fresh = scoring.rationale(F.col("topic_anchor"), F.col("levels"))
    outcome = F.when(F.col("levels").isNull(), "skipped").when(fresh.isNull(), "error").otherwise("rendered")
    return rows.select("post_id", outcome.alias("outcome"), F.when(F.col("levels").isNotNull(), fresh).alias("rationale_text"))
