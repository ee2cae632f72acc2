"""Candidate flow: deduplication, freshness, admission under the cap, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.config import CONFIG, Config
from gleanery.functions import containers, scoring, text, urls
from gleanery.operators.running import running_sums


def dedupe_first(candidates: DataFrame) -> DataFrame:
    """The first candidate of each canonical URL, which replaces its URL; others than web URLs go."""
    canon = candidates.withColumn("url", urls.canonical_url(F.col("url"))).where("url is not null")
    first = F.row_number().over(Window.partitionBy("url").orderBy("pos"))
    return canon.withColumn("place", first).where("place = 1").drop("place")


def dedupe_last(entries: DataFrame) -> DataFrame:
    """The last lastmod of each URL, by position."""
    return entries.groupBy("url").agg(F.max_by("lastmod", "pos").alias("lastmod"), F.count("*").alias("seen"))


def needs_curation(candidates: DataFrame, posts: DataFrame, signature: str) -> DataFrame:
    """Candidates (url, content_hash) with ``needed``: no post of their url, another content hash, or another signature."""
    known = posts.select("url", F.col("content_hash").alias("_hash"), F.col("curation_signature").alias("_signature"), F.lit(True).alias("_known"))
    same = F.col("_known").isNotNull() & F.col("content_hash").eqNullSafe(F.col("_hash")) & F.col("_signature").eqNullSafe(F.lit(signature))
    return candidates.join(known, "url", "left").withColumn("needed", ~same).drop("_hash", "_signature", "_known")


def new_urls(found: DataFrame, seen: DataFrame) -> DataFrame:
    """Found (host, url_hash) that the host hasn't had yet."""
    return found.join(seen, ["host", "url_hash"], "left_anti")


def admit_under_cap(rows: DataFrame, day: str, order: list, cap: int, base: DataFrame | None = None) -> DataFrame:
    """Rows with ``admitted``: gate-passing rows of a day in order, while base and admitted ones stay under the cap.

    A day's running count adds up along the ranges of (day, order), so that no task numbers a whole day; ``base`` (day, n)
    are earlier publications, a row for each day.
    """
    counted = running_sums(rows, [day], order, {"_place": F.coalesce(F.col("passed"), F.lit(False)).cast("long")}, "admitted")
    before = F.lit(0)
    if base is not None:
        counted = counted.join(base.select(day, F.col("n").alias("_base")), day, "left")
        before = F.coalesce("_base", F.lit(0))
    return counted.withColumn("admitted", F.coalesce(F.col("passed"), F.lit(False)) & (before + F.col("_place") <= cap)).select(*rows.columns, "admitted")


def candidate_outcomes(candidates: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row for each candidate: the outcome of its canonical URL, else invalid_url."""
    keyed = candidates.select("pos", F.col("url").alias("given"), urls.canonical_url(F.col("url")).alias("url"))
    return keyed.join(outcomes, "url", "left").select("pos", "given", F.coalesce("outcome", F.lit("invalid_url")).alias("outcome"))


def extracted(pages: DataFrame, selectors: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Pages (page_id, url, host, html) as articles, by the ``selectors`` (host, place, selector) of their hosts.

    ``outcome``: no_title (the page has none), container_not_found (the host isn't listed, or nothing matches),
    extraction_insufficient, or ready. The title is the heading inside the container, else the page's. Ready articles
    have ``slice``, the first characters of their text, for a judge, and ``body_hash``; neither the slice nor any HTML may
    reach an output table. A page is parsed once.
    """
    listed = containers.selectors_by_host(pages.select("page_id", "url", "host", "html", text.page_title(F.col("html")).alias("page_title")), selectors)
    rows = containers.article_containers(listed, "html", "selectors")
    title = F.when(F.col("inner_html").isNotNull(), F.coalesce(F.nullif(text.normalized_title(F.col("heading")), F.lit("")), F.col("page_title"))).otherwise(F.col("page_title"))
    rows = rows.withColumns({"title": title, "s": F.when(F.col("page_title").isNotNull() & F.col("inner_html").isNotNull(), text.signals(F.col("inner_html")))})
    failed = text.failed_conditions(F.col("s.text_length"), F.col("s.link_density"), F.col("s.paragraph_count"), config)
    outcome = F.when(F.col("page_title").isNull(), "no_title").when(F.col("inner_html").isNull(), "container_not_found").when(F.size(failed) > 0, "extraction_insufficient").otherwise("ready")
    rows = rows.withColumn("outcome", outcome).withColumn("ready_text", F.when(F.col("outcome") == "ready", text.visible_text(F.col("inner_html"))))
    rows = rows.withColumn("hash", scoring.simhash(F.col("ready_text")))
    known = F.col("ready_text").isNotNull()
    return rows.select(
        "page_id", "url", "host", F.when(F.col("outcome") != "no_title", F.col("title")).alias("title"), "outcome", "s.text_length", "s.link_density", "s.paragraph_count", F.array_join(failed, ",").alias("failed"),
        F.substring("ready_text", 1, config.slice_chars).alias("slice"), F.when(known, F.col("hash")).alias("body_hash"),
    )


def cross_tag_duplicates(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates with ``duplicate``: the URL is known, or another tag has it too."""
    tags = candidates.groupBy("url").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi"))
    mark = known.select("url").distinct().withColumn("known", F.lit(True))
    return candidates.join(tags, "url").join(mark, "url", "left").withColumn("duplicate", (F.col("lo") != F.col("hi")) | F.col("known").isNotNull()).drop("lo", "hi", "known")


def submissions(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Submitted URLs with page metadata (url, title, site): ``reason`` invalid_url, no_metadata, no_source_name, or NULL when accepted."""
    keyed = candidates.withColumn("canon", urls.canonical_url(F.col("url")))
    meta = pages.select(F.col("url").alias("canon"), F.col("title").alias("meta_title"), "site")
    joined = keyed.join(meta, "canon", "left").withColumn("name", urls.source_name(F.col("source_name"), F.col("site"), F.lit(None).cast("string")))
    reason = F.when(F.col("canon").isNull(), "invalid_url").when(F.col("meta_title").isNull(), "no_metadata").when(F.col("name").isNull(), "no_source_name")
    return joined.withColumn("reason", reason)


def jst_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "Asia/Tokyo"))


def allowed_articles(candidates: DataFrame, allow_list: DataFrame) -> DataFrame:
    """Candidates with ``allowed`` (their host is listed and their path matches one of its patterns) and ``allowed_for_seeding`` (the same, but hosts that aren't listed pass).

    ``allow_list`` has a row for each host, with an array of patterns. Spark broadcasts it if it is small.
    """
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#\s]+)", 1))
    path = F.regexp_extract("url", r"^[A-Za-z]+://[^/?#\s]+([^?#]*)", 1)
    rows = candidates.withColumns({"_host": host, "_path": path}).join(allow_list.select(F.col("host").alias("_host"), "patterns"), "_host", "left")
    fits = F.exists("patterns", lambda p: F.regexp(F.col("_path"), p))
    known = F.col("patterns").isNotNull()
    return rows.withColumns({"allowed": F.coalesce(fits, F.lit(False)), "allowed_for_seeding": F.when(known, F.coalesce(fits, F.lit(False))).otherwise(True)}).drop("_host", "_path", "patterns")


def resume_except(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """What an interrupted job still has to do: ``rows`` whose key isn't in ``done``."""
    return rows.join(done.select(key), key, "left_anti")


def attributed(rows: DataFrame, posts: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with the source of their post, ``unknown`` where the post or its source is missing; ``orphan``: there is no such post."""
    joined = rows.join(posts.select(F.col("id").alias(key), "source_id", "source_name", F.lit(True).alias("_known")), key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("source_id", "source_name")} | {"orphan": F.col("_known").isNull()}).drop("_known")
