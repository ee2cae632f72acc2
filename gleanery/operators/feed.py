"""Reading side: joins of posts with their judgements, ranking, pages, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.config import CONFIG, Config
from gleanery.functions import scoring
from gleanery.functions.unicode import trim
from gleanery.operators.running import numbered


def feed_join(posts: DataFrame, rationales: DataFrame, criteria: DataFrame) -> DataFrame:
    """Posts with their rationale and criteria, each missing one NULL."""
    r = rationales.select(F.col("post_id").alias("id"), "topic_anchor", "rationale_text", "evidence_sufficient")
    c = criteria.select(F.col("post_id").alias("id"), "criteria_json")
    return posts.join(r, "id", "left").join(c, "id", "left")


def attach_topics(posts: DataFrame, topics: DataFrame) -> DataFrame:
    """Posts with ``topics``: their topics in order, an empty array without any."""
    lists = topics.groupBy(F.col("post_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "topic"))), lambda x: x["topic"]).alias("topics"))
    return posts.join(lists, "id", "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))


def visible(source_type: str = "blog", phase: int = 1) -> Column:
    """Whether a row of ``feed_join`` is shown: published, with a category and tag, and texts as the phase asks."""
    texts = F.col("ai_title").isNotNull() & F.col("ai_summary").isNotNull()
    judged = F.col("topic_anchor").isNotNull() | F.col("rationale_text").isNotNull()
    shown = judged if phase == 2 else texts | judged
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return (F.col("status") == "published") & (F.col("source_type") == source_type) & shown & filled("category") & filled("tag") & (F.col("rationale_text").isNotNull() | texts)


def ranked(feed: DataFrame, limit: int, config: Config = CONFIG) -> DataFrame:
    """The best rows: score, then date (missing last), then id, all falling."""
    scored = feed.withColumn("score", scoring.usefulness(F.col("criteria_json"), config))
    return scored.orderBy(F.desc("score"), F.desc_nulls_last("published_at"), F.desc("id")).limit(limit)


def page(feed: DataFrame, count: int | None, config: Config = CONFIG) -> DataFrame:
    """A page of ``count`` rows (an invalid count is the default) with has_more and next_count."""
    count = count if isinstance(count, int) and 1 <= count <= config.page_max else config.page
    top = ranked(feed, count + 1, config).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc_nulls_last("published_at"), F.desc("id"))))
    more = F.max("rank").over(Window.partitionBy()) > count
    grown = min(count + config.page, config.page_max)
    return top.withColumn("has_more", more & F.lit(grown > count)).where(F.col("rank") <= count).withColumn("next_count", F.lit(grown))


def stale(posts: DataFrame, signature: str, limit: int, force: bool = False) -> DataFrame:
    """Posts whose curation signature is missing or another, newest first."""
    wanted = F.lit(True) if force else ~F.col("curation_signature").eqNullSafe(signature)
    return posts.where((F.col("source_type") == "blog") & wanted).orderBy(F.desc_nulls_last("published_at"), F.desc("id")).limit(limit)


def sliceless(posts: DataFrame, signature: str, limit: int) -> DataFrame:
    """Published stale posts without a usable excerpt."""
    bare = F.coalesce(trim(F.col("original_excerpt")), F.lit(""))
    return stale(posts.where((F.col("status") == "published") & bare.isin("", "null")), signature, limit)


def due_retries(queue: DataFrame, now: Column, limit: int, per_lane: bool = True) -> DataFrame:
    """Retries that are due, oldest first, up to a limit for each lane or in all."""
    due = queue.where(F.col("next_attempt_at") <= now)
    order = [F.col("next_attempt_at"), F.col("url_hash")]
    if not per_lane:
        return due.orderBy(*order).limit(limit)
    return due.withColumn("place", F.row_number().over(Window.partitionBy("lane").orderBy(*order))).where(F.col("place") <= limit).drop("place")


def fresh_then_stale(fresh: DataFrame, stale_: DataFrame, budget: int) -> DataFrame:
    """Fresh posts, newest first (no date counts as oldest), then stale ones that aren't among them, up to the budget."""
    rest = stale_.join(fresh.select("id"), "id", "left_anti")
    both = fresh.withColumn("turn", F.lit(0)).unionByName(rest.withColumn("turn", F.lit(1)))
    return both.orderBy("turn", F.desc(F.coalesce("published_at", F.timestamp_seconds(F.lit(0)))), F.desc("id")).limit(budget)


def run_selection(posts: DataFrame, source: str, limit: int) -> DataFrame:
    """Posts of a source (its id, or a part of the url), then the limit."""
    return posts.where((F.col("source_id") == source) | F.col("url").contains(source)).orderBy("id").limit(limit)


def split_preflight(posts: DataFrame) -> DataFrame:
    """Posts with ``runnable``: an excerpt of five characters or more that isn't "null"."""
    text = trim(F.col("original_excerpt"))
    return posts.withColumn("runnable", F.coalesce((text != "null") & (F.length(text) >= 5), F.lit(False)))


def split_reads(shown: DataFrame, reads: DataFrame) -> DataFrame:
    """Feed rows as shown to users (user_id, id, ...) with ``read``: whether the user has read them.

    ``reads`` (user_id, post_id as text) may have blanks around ids, blank ids and repeats; they count once or not at all.
    """
    ids = reads.select("user_id", trim(F.col("post_id").cast("string")).alias("_id")).where("_id != ''").distinct().withColumn("_read", F.lit(True))
    joined = shown.withColumn("_id", F.col("id").cast("string")).join(ids, ["user_id", "_id"], "left")
    return joined.select(*shown.columns, F.col("_read").isNotNull().alias("read"))


def batch_ids(rows: DataFrame, size: int, order: list[str | Column], by: list[str] | None = None) -> DataFrame:
    """All rows, or those of each ``by``, in batches of ``size`` in order: ``batch`` from 0 and ``index`` from 1 within it. The order has to be total; no task numbers all rows."""
    rows = numbered(rows, by or [], order, "_place")
    place = F.col("_place") - 1
    return rows.withColumns({"batch": F.floor(place / size), "index": place % size + 1}).drop("_place")
