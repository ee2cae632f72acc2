"""Keyed merges: functions of a current table and a delta to the next table.

Plain Parquet has no MERGE, so each is a join or a grouping by key; the result is written as a new snapshot,
or is the body of a foreachBatch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gleanery.config import CONFIG, KEPT_OUTCOMES, SKIPPED_OUTCOMES, Config
from gleanery.functions import scoring
from gleanery.sources.releases import Releases
from gleanery.sources.tables import discarded, kept

#: What a new entry of a known URL may change.
REFRESHED = ("source_name", "original_title", "original_excerpt", "author", "thumbnail_url", "published_at", "updated_at")


def latest(current: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``current`` replaced by, and joined with, those of ``delta``."""
    return current.join(delta.select(*keys), keys, "left_anti").unionByName(delta)


def upsert_posts(current: DataFrame, delta: DataFrame) -> DataFrame:
    """Posts with a delta by url: new urls come in, known ones refresh only ``REFRESHED``; curation and status stay."""
    names = [c for c in current.columns if c != "url"]
    c, d = (df.select("url", F.struct(*names).alias(x)) for df, x in ((current, "c"), (delta, "d")))
    value = lambda n: F.when(F.col("c").isNull() | (F.col("d").isNotNull() & F.lit(n in REFRESHED)), F.col(f"d.{n}")).otherwise(F.col(f"c.{n}")).alias(n)
    return c.join(d, "url", "full_outer").select("url", *map(value, names)).select(*current.columns)


def mark_curated(current: DataFrame, updates: DataFrame, removals: DataFrame) -> DataFrame:
    """Posts with curation results (id, has_title, ai_title, has_category, category, content_hash, curation_signature, status): a value counts only if it was supplied, the status only if the post isn't removed."""
    gone = removals.select(F.col("post_id").alias("id")).distinct().withColumn("gone", F.lit(True))
    more = [c for c in ("ai_summary", "tag") if c in updates.columns and c in current.columns]
    u = updates.select("id", F.struct(*(c for c in updates.columns if c != "id")).alias("u"))
    joined = current.join(u, "id", "left").join(gone, "id", "left")
    given = F.col("u").isNotNull()
    return joined.select(
        *(c for c in current.columns if c not in ("ai_title", "category", "content_hash", "curation_signature", "status", *more)),
        *(F.when(given & F.col(f"u.{c}").isNotNull(), F.col(f"u.{c}")).otherwise(F.col(c)).alias(c) for c in more),
        F.when(given & F.col("u.has_title"), F.col("u.ai_title")).otherwise(F.col("ai_title")).alias("ai_title"),
        F.when(given & F.col("u.has_category"), F.col("u.category")).otherwise(F.col("category")).alias("category"),
        F.when(given, F.col("u.content_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(given, F.col("u.curation_signature")).otherwise(F.col("curation_signature")).alias("curation_signature"),
        F.when(given & F.col("gone").isNull(), F.coalesce("u.status", "status")).otherwise(F.col("status")).alias("status"),
    )


def merge_rationales(current: DataFrame, delta: DataFrame) -> DataFrame:
    """Rationales with those of a delta that have sufficient evidence, an anchor and a text."""
    good = delta.where("evidence_sufficient and topic_anchor is not null and rationale_text is not null")
    return latest(current, good, ["post_id"])


def replace_topics(current: DataFrame, lists: DataFrame) -> DataFrame:
    """Topics with those of the posts in ``lists`` (post_id, topics) replaced; an empty list clears."""
    fresh = lists.select("post_id", F.posexplode("topics").alias("position", "topic"))
    return current.join(lists.select("post_id"), "post_id", "left_anti").unionByName(fresh)


#: Columns of the retry queue.
QUEUE = ("url_hash", "url", "host", "lane", "reason", "attempts", "first_queued_at", "next_attempt_at", "expires_at")


def schedule_retries(queue: DataFrame, failed: DataFrame, now: Column, config: Config = CONFIG) -> DataFrame:
    """The queue after failures (url_hash, url, host, lane, reason), each url once: rows of ``QUEUE`` and ``terminal``.

    A url that fails for the first time enters with one attempt; one that is queued already takes the failure's values, one
    attempt more and the time of its first failure; the wait goes by the attempts before. Beyond the last attempt a row is
    ``terminal``: ``open_retries`` is the next queue, the others are drops. Rows that didn't fail stay as they are.
    """
    hours = F.array(*map(F.lit, config.retry_hours))
    before = F.coalesce(F.col("q.attempts"), F.lit(0))
    wait = F.element_at(hours, F.least(before + 1, F.lit(len(config.retry_hours))).cast("int"))
    q, f = (df.select("url_hash", F.struct(*df.columns).alias(x)) for df, x in ((queue.select(*QUEUE), "q"), (failed.select(*QUEUE[:5]), "f")))
    joined = q.join(f, "url_hash", "full_outer")
    again = F.col("f").isNotNull()
    first = F.coalesce(F.col("q.first_queued_at"), now)
    given = lambda c: F.when(again, F.col(f"f.{c}")).otherwise(F.col(f"q.{c}")).alias(c)
    return joined.select(
        "url_hash", *map(given, QUEUE[1:5]), (before + again.cast("int")).alias("attempts"), first.alias("first_queued_at"),
        F.when(again, now + F.make_interval(hours=wait)).otherwise(F.col("q.next_attempt_at")).alias("next_attempt_at"),
        F.when(again, first + F.make_interval(hours=F.lit(config.retry_ttl_hours))).otherwise(F.col("q.expires_at")).alias("expires_at"),
        (again & (before + 1 > len(config.retry_hours))).alias("terminal"),
    )


def open_retries(scheduled: DataFrame) -> DataFrame:
    """The next queue of ``schedule_retries``."""
    return scheduled.where(~F.col("terminal")).drop("terminal")


def expire_retries(queue: DataFrame, now: Column, lanes: list[str] | None = None) -> DataFrame:
    """Queue rows with ``outcome``: the drop's reason of those expired by ``now`` (of all lanes, or of ``lanes`` only), else kept."""
    drop = F.concat(F.lit("retry_exhausted:"), F.col("reason"), F.when(F.col("lane") == "discovery", F.concat(F.lit(":attempts="), F.col("attempts").cast("string"))).otherwise(""))
    over = (F.col("expires_at") <= now) & (F.col("lane").isin(*lanes) if lanes else F.lit(True))
    return queue.withColumn("outcome", F.when(over, drop).otherwise("kept"))


def dropped_retries(posts: DataFrame, removals: DataFrame, expired: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Posts (id, url, host, original_title, status) and removals (post_id, kind, reason, removed_at) after the rows of ``expire_retries`` that aren't kept.

    Each dropped url has a post: where there is none, a rejected one comes in, named by its url; stored posts are changed
    by the removal alone, and only if they have none yet.
    """
    gone = expired.where("outcome != 'kept'").select("url", F.col("host").alias("_host"), "outcome")
    known = posts.select("url", "id")
    joined = gone.join(known, "url", "left").withColumn("_id", F.coalesce("id", F.xxhash64("url")))
    fresh = joined.where("id is null").select(F.col("_id").alias("id"), "url", F.col("_host").alias("host"), F.col("url").alias("original_title"), F.lit("rejected").alias("status"))
    named = posts.select("id", "url", "host", "original_title", "status").unionByName(fresh)
    dropped = joined.select(F.col("_id").alias("post_id"), F.lit("dropped").alias("kind"), F.col("outcome").alias("reason"), now.alias("removed_at"))
    removed = removals.unionByName(dropped.join(removals.select("post_id"), "post_id", "left_anti"))
    return apply_removals(named, removed).drop("removed_for"), removed


def record_publications(current: DataFrame, delta: DataFrame) -> DataFrame:
    """Publications with a delta; signals that it doesn't supply are kept."""
    names = [c for c in current.columns if c != "post_id"]
    d = delta.select("post_id", *(F.col(c).alias(f"new_{c}") for c in names))
    return current.join(d, "post_id", "full_outer").select("post_id", *(F.coalesce(f"new_{c}", c).alias(c) for c in names))


def apply_removals(posts: DataFrame, removals: DataFrame) -> DataFrame:
    """Posts with the status of their first removal, which wins forever, and its reason."""
    first = removals.groupBy(F.col("post_id").alias("id")).agg(F.min_by(F.struct("kind", "reason"), F.struct("removed_at", "kind")).alias("r"))
    status = F.when(F.col("r.kind") == "retracted", "retracted").when(F.col("r").isNotNull(), "rejected").otherwise(F.col("status"))
    return posts.join(first, "id", "left").withColumn("status", status).withColumn("removed_for", F.col("r.reason")).drop("r")


def reap_stale(posts: DataFrame, now: Column, config: Config = CONFIG) -> DataFrame:
    """Removal rows for posts that are in no final status after the time to live."""
    old = F.col("created_at") <= now - F.make_interval(hours=F.lit(config.stale_hours))
    return posts.where(~F.col("status").isin("published", "rejected", "retracted") & old).select(F.col("id").alias("post_id"), F.lit("dropped").alias("kind"), F.lit("stale_pending").alias("reason"))


def retraction_plan(posts: DataFrame, removals: DataFrame, hosts: DataFrame | None = None, urls: DataFrame | None = None) -> DataFrame:
    """What a retraction would reach: all published posts of ``hosts`` (host), or the posts of ``urls`` (url) in any status, each with whether it is removed already."""
    if (hosts is None) == (urls is None):
        raise ValueError("either hosts or urls")
    chosen = posts.where("status = 'published'").join(hosts.select("host").distinct(), "host", "left_semi") if hosts is not None else posts.join(urls.select("url").distinct(), "url", "left_semi")
    gone = removals.select(F.col("post_id").alias("id")).distinct().withColumn("gone", F.lit(True))
    return chosen.join(gone, "id", "left").select("id", "url", "status", F.col("gone").isNotNull().alias("already_removed"))


def retract(posts: DataFrame, removals: DataFrame, plan: DataFrame, reason: str, now: Column) -> DataFrame:
    """Removals with those of ``retraction_plan``, for a human's ``reason``; what is removed already keeps its first reason."""
    fresh = plan.where("not already_removed").select(F.col("id").alias("post_id"), F.lit("retracted").alias("kind"), F.lit(reason).alias("reason"), now.alias("removed_at"))
    return removals.unionByName(fresh.join(posts.select(F.col("id").alias("post_id")), "post_id", "left_semi"))


def seed_discovery(seen: DataFrame, found: DataFrame) -> DataFrame:
    """Seen URLs with the found ones that aren't there, as pending."""
    return seen.unionByName(found.dropDuplicates(["url_hash"]).join(seen.select("url_hash"), "url_hash", "left_anti").withColumn("status", F.lit("pending")))


def complete_retries(queue: DataFrame, finished: DataFrame) -> DataFrame:
    return queue.join(finished.select("url_hash"), "url_hash", "left_anti")


def snapshot_diff(snapshot: DataFrame, current: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Changes by key: missing_now, extra_now, or one row for each field that differs."""
    s, c = (df.select(key, F.struct(*fields).alias(x)) for df, x in ((snapshot, "s"), (current, "c")))
    joined = s.join(c, key, "full_outer")
    text = lambda side, f: F.col(f"{side}.{f}").cast("string")
    changes = F.array(*(F.struct(F.lit(f).alias("field"), text("s", f).alias("before"), text("c", f).alias("after")) for f in fields))
    kind = F.when(F.col("c").isNull(), "missing_now").when(F.col("s").isNull(), "extra_now")
    one = F.array(F.struct(kind.alias("field"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after")))
    rows = F.when(kind.isNotNull(), one).otherwise(F.filter(changes, lambda x: ~x["before"].eqNullSafe(x["after"])))
    return joined.select(key, F.inline(rows))


class SnapshotMismatch(Exception):
    """A snapshot and the current table differ too much in their numbers of rows to belong together."""


def counts_differ(before: int, after: int, most: float) -> bool:
    """Whether one of two counts is 0 and the other isn't, or they differ by more than the share ``most`` of the first."""
    if not before or not after:
        return before != after
    return abs(after - before) > most * before


def restore_plan(pairs: dict[str, tuple[DataFrame, DataFrame, str, list[str]]], config: Config = CONFIG) -> dict[str, DataFrame]:
    """``snapshot_diff`` of each table of ``pairs`` (snapshot, current, key, fields), if snapshot and current table belong together.

    The rows of both sides are counted while their difference is made (``observe``), so no table is read twice. If the
    numbers of one table differ too much, nothing comes out: ``SnapshotMismatch`` is raised, and what has been
    staged in the shared folder is left to nobody.
    """
    plans, wrong = {}, []
    for name, (snapshot, current, key, fields) in pairs.items():
        if snapshot.isEmpty() or current.isEmpty():  # the plan may leave an empty side out, with its counter
            before, after = snapshot.count(), current.count()
            plans[name] = snapshot_diff(snapshot, current, key, fields)
        else:
            seen, now = Observation(f"{name} snapshot"), Observation(f"{name} now")
            rows = snapshot_diff(snapshot.observe(seen, F.count(F.lit(1)).alias("n")), current.observe(now, F.count(F.lit(1)).alias("n")), key, fields)
            plans[name] = kept(rows, "restore")
            before, after = seen.get["n"], now.get["n"]
        if counts_differ(before, after, config.restore_tolerance):
            wrong.append(f"{name}: {before} rows in the snapshot, {after} now")
    if wrong:
        discarded(*(p for p in plans.values() if p.inputFiles() and "/restore-" in p.inputFiles()[0]))
        raise SnapshotMismatch("; ".join(wrong))
    return plans


def restored(current: DataFrame, snapshot: DataFrame, key: str, fields: list[str], insert: bool = False) -> DataFrame:
    """``current`` with ``fields`` as the snapshot has them, where it has the key; rows that it lacks stay, and what is missing now comes in if ``insert``."""
    old = snapshot.select(key, F.struct(*fields).alias("_s"))
    joined = current.withColumn("_c", F.lit(True)).join(old, key, "full_outer" if insert else "left")
    value = lambda c: F.when(F.col("_s").isNotNull(), F.col(f"_s.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
    return joined.select(*map(value, current.columns))


def merge_embeds(current: DataFrame, fetched: DataFrame) -> DataFrame:
    """Posts (id) with the columns of ``fetched`` (id and any of the posts' columns) where it has a value; stored values stay elsewhere."""
    names = [c for c in fetched.columns if c != "id"]
    joined = current.join(fetched.select("id", F.struct(*names).alias("_f")), "id", "left")
    return joined.select(*(F.coalesce(F.col(f"_f.{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in current.columns))


def advance_discovery_status(seen: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Seen URLs (url_hash, status) after a run (url_hash, outcome): skipped for good, left as they are to come again, else fetched; URLs without an outcome stay."""
    o = F.col("_outcome")
    status = F.when(o.isNull() | o.isin(*KEPT_OUTCOMES), F.col("status")).when(o.isin(*SKIPPED_OUTCOMES), "skipped").otherwise("fetched")
    joined = seen.join(outcomes.select("url_hash", F.col("outcome").alias("_outcome")), "url_hash", "left")
    return joined.withColumn("status", status).select(*seen.columns)


def sync_source_policy(stored: DataFrame, snapshots: DataFrame, listed: DataFrame) -> DataFrame:
    """``(host, robots_hash, terms_url, terms_hash)`` from the stored rows of that form, robots snapshots (host, seq, robots_text) and the allow-list's terms (host, terms_url).

    The latest snapshot of a host gives the robots hash; the listed terms url wins over the stored one, and a change of
    it resets the terms hash, which a change of robots keeps. Hosts that are only listed aren't known yet.
    """
    latest_robots = snapshots.groupBy("host").agg(F.sha2(F.max_by("robots_text", "seq"), 256).alias("_robots"))
    rows = stored.join(latest_robots, "host", "full_outer").join(listed.select("host", F.col("terms_url").alias("_terms")), "host", "left")
    same = F.col("_terms").isNull() | F.col("_terms").eqNullSafe(F.col("terms_url"))
    return rows.select("host", F.coalesce("_robots", "robots_hash").alias("robots_hash"), F.coalesce("_terms", "terms_url").alias("terms_url"), F.when(same, F.col("terms_hash")).alias("terms_hash"))


def append_observations(articles: DataFrame, path: str) -> DataFrame:
    """Appends a row for each processed article, passed or not, to the table at ``path``, and returns the table. A missing container counts as no text, all links, no paragraph."""
    missing = {"text_length": 0, "link_density": 1.0, "paragraph_count": 0}
    rows = articles.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in missing.items()})
    rows.write.mode("append").parquet(path)
    return articles.sparkSession.read.schema(rows.schema).parquet(path)


#: Columns of judged candidates, as ``publication_deltas`` takes them.
JUDGED = (
    "url", "host", "lane", "title", "excerpt", "outcome", "detail", "summary", "category", "tag", "criteria_json", "topic_anchor", "rationale_text", "topics", "text_length", "link_density", "paragraph_count", "body_hash",
)


def publication_deltas(judged: DataFrame, posts: DataFrame, now: Column, signature: str, model: str) -> dict[str, DataFrame]:
    """One outcome table (``JUDGED``, a row for each url) fanned out: ``posts`` and ``updates`` for M-1 and M-2, and ``criteria``, ``rationales``, ``topics``, ``publications`` and ``removals`` for M-3 to M-9.

    ``outcome`` is ``accepted`` or the reason of a drop, ``detail`` more about it. Accepted articles of a feed keep the
    model's tag, and their hash covers title and excerpt, for want of a body; discovered ones are always classic, hashed by
    title, and published with their signals and the hash of their body. Dropped discoveries become rejected posts named by
    their page's title, else by their url; a feed's drops have a post already, and only lose it.
    """
    ids = posts.select("url", F.col("id").alias("_known"))
    rows = judged.select(*JUDGED).join(ids, "url", "left").withColumn("id", F.coalesce("_known", F.xxhash64("url")))
    feed = F.col("lane") != "discovery"
    good = F.col("outcome") == "accepted"
    titled = F.coalesce("title", "url")
    rows = rows.withColumns({"named": titled, "hash": scoring.content_hash(titled, F.when(feed, F.col("excerpt")))})
    empty = lambda kind: F.lit(None).cast(kind)
    fresh = {
        "id": F.col("id"), "host": F.col("host"), "source_type": F.lit("blog"), "source_id": F.when(feed, F.col("lane")).otherwise("evergreen"), "source_name": F.col("host"), "original_title": F.col("named"), "original_excerpt": F.when(feed, F.col("excerpt")),
        "created_at": now, "updated_at": now, "status": F.when(good, "published").otherwise("rejected"),
    }
    kinds = {f.name: f.dataType for f in posts.schema}
    discovered = rows.where(~feed)
    accepted = rows.where(good)
    failed = F.when(F.col("outcome") == "extraction_insufficient", F.coalesce("detail", F.lit("unknown"))).otherwise(F.col("detail"))
    return {
        "posts": discovered.select("url", *(fresh.get(c, empty(kinds[c])).cast(kinds[c]).alias(c) for c in posts.columns if c != "url")).select(*posts.columns),
        "updates": accepted.select(
            "id", F.lit(False).alias("has_title"), empty("string").alias("ai_title"), F.col("category").isNotNull().alias("has_category"), "category", F.col("hash").alias("content_hash"),
            F.lit(signature).alias("curation_signature"), F.lit("published").alias("status"), F.col("summary").alias("ai_summary"), F.when(feed, F.col("tag")).otherwise("classic").alias("tag"),
        ),
        "criteria": accepted.where("criteria_json is not null").select(F.col("id").alias("post_id"), "criteria_json", F.lit(signature).alias("signature"), F.lit(model).alias("model_id")),
        "rationales": accepted.select(F.col("id").alias("post_id"), "topic_anchor", "rationale_text", F.lit(signature).alias("prompt_version"), F.lit(True).alias("evidence_sufficient")),
        "topics": accepted.where("topics is not null").select(F.col("id").alias("post_id"), "topics"),
        "publications": accepted.select(
            F.col("id").alias("post_id"), now.alias("published_at"), F.when(feed, "surrogate").otherwise("body").alias("hash_kind"), F.when(feed, F.col("hash")).otherwise(F.col("body_hash")).alias("body_hash"),
            *(F.when(~feed, F.col(c)).alias(c) for c in ("text_length", "link_density", "paragraph_count")),
        ),
        "removals": rows.where(~good & (~feed | F.col("_known").isNotNull())).select(F.col("id").alias("post_id"), F.lit("dropped").alias("kind"), F.concat_ws(":", "outcome", failed).alias("reason"), now.alias("removed_at")),
    }


def published(current: dict[str, DataFrame], deltas: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after ``publication_deltas``: posts by M-1, M-2 and M-9, criteria by M-3, rationales by M-4, topics by M-5, publications by M-8; a post's first removal stays."""
    removals = current["removals"].unionByName(deltas["removals"].join(current["removals"].select("post_id"), "post_id", "left_anti"))
    live = deltas["updates"].select(F.col("id").alias("post_id")).join(removals.select("post_id"), "post_id", "left_anti")
    posts = mark_curated(upsert_posts(current["posts"], deltas["posts"]), deltas["updates"], removals).select(*current["posts"].columns)
    of_live = lambda name: deltas[name].join(live, "post_id", "left_semi")
    return {
        "posts": apply_removals(posts, removals).drop("removed_for"),
        "criteria": latest(current["criteria"], deltas["criteria"].select(*current["criteria"].columns), ["post_id"]),
        "rationales": merge_rationales(current["rationales"], deltas["rationales"].select(*current["rationales"].columns)),
        "topics": replace_topics(current["topics"], deltas["topics"]),
        "publications": record_publications(current["publications"], of_live("publications").select(*current["publications"].columns)),
        "removals": removals,
    }


def publish_outcomes(store: Releases, judged: DataFrame, now: Column, signature: str, model: str, before_commit: Callable[[int], None] | None = None) -> int:
    """Publishes judged candidates into the tables of ``store``, all of them or none, and returns the release's number."""
    n = store.last()
    current = {name: store.read(name, n) for name in ("posts", "criteria", "rationales", "topics", "publications", "removals")}
    return store.write(published(current, publication_deltas(judged, current["posts"], now, signature, model)), before_commit)
