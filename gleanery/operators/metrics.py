"""Counts, funnels, agreement and checks over the curated tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.config import CONFIG, Config
from gleanery.functions import scoring, text, topics, unicode
from gleanery.operators.running import numbered


def published_since(publications: DataFrame, posts: DataFrame, since: Column, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Publications since a time whose post is still published, in all or by columns of the post."""
    live = posts.where("status = 'published'").select(F.col("id").alias("post_id"), *by)
    recent = publications.where(F.col("published_at") >= since).select("post_id").join(live, "post_id")
    return recent.groupBy(*by).agg(F.count("*").alias("n")) if by else recent.agg(F.count("*").alias("n"))


def status_counts(seen: DataFrame) -> DataFrame:
    """Pending, fetched and skipped URLs of each host, 0 where there are none."""
    return seen.groupBy("host").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "fetched", "skipped")))


def gate_pass_by_source(posts: DataFrame, criteria: DataFrame) -> DataFrame:
    """Totals, true criteria and gate passes by source and overall (source NULL); invalid JSON counts in the totals only."""
    rows = posts.select(F.col("id").alias("post_id"), "source_id").join(criteria, "post_id")
    valid = scoring.valid_json(F.col("criteria_json"))
    truthy = [F.count_if(valid & (scoring.level(F.col("criteria_json"), k) > 0)).alias(k) for k in ("firsthand", "ceremonyDecision", "specific", "weddingDayContent")]
    passed = F.count_if(scoring.gate_passed(F.col("criteria_json")))
    return rows.rollup("source_id").agg(F.count("*").alias("total"), *truthy, passed.alias("passed"), F.round(100 * passed / F.count("*"), 4).alias("pass_percent"))


def _conditions(config: Config) -> Column:
    return text.failed_conditions(F.col("text_length"), F.col("link_density"), F.col("paragraph_count"), config)


def counterfactual_thresholds(evidence: DataFrame, config: Config) -> DataFrame:
    """Stored signals under the present and under other thresholds, by host and overall: passes, flips both ways and pass rates."""
    rows = evidence.select("host", (F.size(_conditions(CONFIG)) == 0).alias("now"), (F.size(_conditions(config)) == 0).alias("then"))
    rate = lambda c, name: F.round(F.count_if(c) / F.count("*"), 8).alias(name)
    return rows.rollup("host").agg(
        F.count("*").alias("n"), F.count_if("now").alias("pass_now"), F.count_if("then").alias("pass_then"), F.count_if(F.col("now") & ~F.col("then")).alias("lost"), F.count_if(~F.col("now") & F.col("then")).alias("won"),
        rate("now", "rate_now"), rate("then", "rate_then"),
    )


def counterfactual_conditions(evidence: DataFrame, config: Config) -> DataFrame:
    """By condition: how many observations fail it now, under other thresholds, only now, and only then; an observation may fail several."""
    rows = evidence.select(_conditions(CONFIG).alias("now"), _conditions(config).alias("then"))
    each = rows.select(F.explode(F.array_union("now", "then")).alias("condition"), "now", "then")
    has = lambda side: F.array_contains(side, F.col("condition"))
    return each.groupBy("condition").agg(F.count_if(has("now")).alias("failed_now"), F.count_if(has("then")).alias("failed_then"), F.count_if(~has("then")).alias("mended"), F.count_if(~has("now")).alias("broken"))


#: What a run over discovered URLs counts, and the outcomes that end or forbid it.
COUNTERS = (
    "processed", "published", "extraction_insufficient", "failed_text_length", "failed_link_density", "failed_paragraph_count", "failed_container_not_found", "title_filter", "anchor_ungrounded", "rate_capped", "path_not_allowed",
    "robots", "gone", "too_large", "no_title", "enqueued", "retry_exhausted", "removed", "retry_expired", "stale_reaped",
)
ENDS = ("kill_gate", "budget", "retry_after", "time_budget", "host_not_allowed")


def discovery_outcomes(rows: DataFrame, baseline: DataFrame, config: Config = CONFIG) -> DataFrame:
    """A row for each run of a host, with the 20 ``COUNTERS`` and 6 flags, of outcomes (host, run, outcome, failed), one for each URL.

    ``failed`` (an array) are the conditions that an ``extraction_insufficient`` failed, each counted; an expired retry is
    processed, exhausted and expired at once. Rows of ``ENDS`` set ``aborted_kill_gate``, ``aborted_budget``,
    ``aborted_retry_after``, ``budget_exhausted`` and ``host_not_allowed``; a host that isn't allowed counts nothing. A run
    that came to its end collapses by its host's ``baseline`` (host, days, publish_rate) as in ``hosts.yield_collapse``.
    """
    outcome = F.col("outcome")
    extra = F.when(outcome == "extraction_insufficient", F.transform(F.coalesce("failed", F.array().cast("array<string>")), lambda f: F.concat(F.lit("failed_"), f))).otherwise(F.array().cast("array<string>"))
    expired = F.when(outcome == "retry_expired", F.array(F.lit("retry_exhausted"))).otherwise(F.array().cast("array<string>"))
    processed = F.when(~outcome.isin("stale_reaped", "time_budget", "host_not_allowed"), F.array(F.lit("processed"))).otherwise(F.array().cast("array<string>"))
    labels = rows.select("host", "run", F.explode(F.concat(F.array(outcome), extra, expired, processed)).alias("label"))
    counts = labels.groupBy("host", "run").pivot("label", [*COUNTERS, *ENDS]).count().fillna(0)
    allowed = F.col("host_not_allowed") == 0
    ended = {c: F.col(c) > 0 for c in ENDS}
    whole = allowed & ~ended["kill_gate"] & ~ended["budget"] & ~ended["retry_after"]
    rate = F.when(F.col("processed") > 0, F.col("published") / F.col("processed"))
    collapsed = whole & F.coalesce((F.col("days") >= config.yield_days) & (F.col("publish_rate") > 0) & (rate < config.yield_ratio * F.col("publish_rate")), F.lit(False))
    joined = counts.join(baseline.select("host", "days", "publish_rate"), "host", "left")
    return joined.select(
        "host", "run", *(F.when(allowed, F.col(c)).otherwise(0).alias(c) for c in COUNTERS),
        *((allowed & ended[end]).alias(flag) for end, flag in zip(ENDS[:4], ("aborted_kill_gate", "aborted_budget", "aborted_retry_after", "budget_exhausted"), strict=True)), (~allowed).alias("not_allowed"), collapsed.alias("yield_collapse"),
    ).withColumnRenamed("not_allowed", "host_not_allowed")


def stage_funnel(candidates: DataFrame, outcomes: DataFrame) -> DataFrame:
    """By run: candidates fetched, left after deduplication, inserted, skipped, past the evidence, title and cap gates, published, retried, and the drops by reason (an array of reason and n).

    ``candidates`` (run, url) come as fetched; ``outcomes`` (run, url, outcome, detail) are one for each canonical URL:
    save_failed, skipped (curated already), removed, extraction_insufficient, llm_transient, title_filter, rate_capped,
    retry_exhausted (``detail``: after llm_transient or rate_capped) or published.
    """
    from gleanery.functions.urls import canonical_url

    o, d = F.col("outcome"), F.col("detail")
    evidence = ~o.isin("save_failed", "skipped", "removed", "extraction_insufficient")
    title = o.isin("rate_capped", "published") | ((o == "retry_exhausted") & d.eqNullSafe(F.lit("rate_capped")))
    dropped = o.isin("removed", "extraction_insufficient", "title_filter", "retry_exhausted")
    n = lambda condition, name: F.count_if(condition).alias(name)
    by_reason = outcomes.where(dropped).groupBy("run", "outcome").agg(F.count("*").alias("n")).groupBy("run").agg(F.array_sort(F.collect_list(F.struct(F.col("outcome").alias("reason"), "n"))).alias("dropped"))
    fetched = candidates.groupBy("run").agg(F.count("*").alias("fetched"), F.count_distinct(canonical_url(F.col("url"))).alias("deduped"))
    counts = outcomes.groupBy("run").agg(
        n(o != "save_failed", "inserted"), n(o == "skipped", "skipped"), n(evidence, "evidence_passed"), n(title, "title_passed"), n(o == "published", "cap_passed"), n(o == "published", "published"),
        n(o.isin("llm_transient", "rate_capped", "retry_exhausted"), "retried"),
    )
    return fetched.join(counts, "run", "left").join(by_reason, "run", "left").fillna(0)


def corpus_stats(posts: DataFrame, criteria: DataFrame, now: Column) -> DataFrame:
    """Totals, date range, posts of the last 30 days and how many of them are graded, by source and overall."""
    recent = F.col("published_at") >= now - F.make_interval(days=F.lit(30))
    graded = criteria.select(F.col("post_id").alias("id"), F.lit(True).alias("graded"))
    rows = posts.join(graded, "id", "left")
    return rows.rollup("source_id").agg(
        F.count("*").alias("total"), F.min("published_at").alias("first"), F.max("published_at").alias("last"), F.count_if(recent).alias("recent"), F.count_if(recent & F.col("graded").isNotNull()).alias("recent_graded")
    )


def score_histogram(posts: DataFrame, criteria: DataFrame) -> DataFrame:
    rows = posts.select("id").join(criteria.select(F.col("post_id").alias("id"), "criteria_json"), "id", "left")
    return rows.groupBy(scoring.usefulness(F.col("criteria_json")).alias("score")).agg(F.count("*").alias("n"))


def length_cohorts(posts: DataFrame, criteria: DataFrame) -> DataFrame:
    """Excerpt lengths (over 0) of posts whose four criteria are all 0 and of others: number, least, largest, upper median, mean."""
    json = F.col("criteria_json")
    any_ = F.greatest(*(scoring.level(json, k) for k in ("firsthand", "ceremonyDecision", "specific", "weddingDayContent"))) > 0
    rows = posts.select(F.col("id").alias("post_id"), F.length("original_excerpt").alias("length")).where("length > 0").join(criteria.where(scoring.valid_json(json)).select("post_id", any_.alias("positive")), "post_id")
    # lengths repeat, so the median is found on the histogram and no group is sorted whole
    bins = rows.groupBy("positive", "length").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("positive").orderBy("length"))
    all_ = F.sum("m").over(Window.partitionBy("positive"))
    marked = bins.withColumn("upto", upto).withColumn("all", all_)
    return marked.groupBy("positive").agg(
        F.sum("m").alias("n"), F.min("length").alias("least"), F.max("length").alias("largest"),
        F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("length"))).alias("upper_median"), F.round(F.sum(F.col("m") * F.col("length")) / F.sum("m"), 6).alias("mean"),
    )


def agreement(judged: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and agreement of each criterion's predicted against its labelled column."""
    long = judged.select(F.explode(F.array(*(F.struct(F.lit(k).alias("criterion"), F.col(a).alias("label"), F.col(b).alias("predicted")) for k, (a, b) in pairs.items()))).alias("x")).select("x.*")
    count = lambda a, b, name: F.count_if((F.col("label") == a) & (F.col("predicted") == b)).alias(name)
    sums = long.groupBy("criterion").agg(count(1, 1, "tp"), count(0, 1, "fp"), count(1, 0, "fn"), count(0, 0, "tn"))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 8))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return sums.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tp + tn, tp + fp + fn + tn).alias("agreement"))


def association(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cramér's V of two columns and the entropy (bits) of their pairs, from the contingency table."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    ra, rb = (cells.groupBy(c).agg(F.sum("n").alias(f"n_{c}")) for c in (a, b))
    total = cells.agg(F.sum("n").alias("total"), F.count_distinct(a).alias("k"), F.count_distinct(b).alias("l"))
    joined = cells.join(ra, a).join(rb, b).crossJoin(F.broadcast(total))  # one row
    # chi squared over n, without the empty cells: sum n_ij^2 / (n_i n_j) - 1
    phi = F.sum(F.col("n") * F.col("n") / (F.col(f"n_{a}") * F.col(f"n_{b}"))) - 1
    p = F.col("n") / F.col("total")
    small = F.least(F.max("k"), F.max("l")) - 1
    return joined.agg(F.round(F.when(small > 0, F.sqrt(F.greatest(phi, F.lit(0.0)) / small)), 8).alias("cramers_v"), F.round(-F.sum(p * F.log2(p)), 8).alias("entropy"))


def outcome_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


#: What a tag has to reach: candidates of the last 30 days, percent passed of those evaluated, percent of duplicates at most; and how many of a tag are evaluated.
PROBE_RECENT, PROBE_PASSED, PROBE_DUPLICATES, PROBE_EVALUATED = 3, 40, 50, 25


def source_probe(candidates: DataFrame, known: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    """By tag: candidates fetched, those of the last 30 days, evaluated and passed ones, percentages, and whether the tag is worth reading.

    Of a tag's recent candidates the newest are evaluated (``verdicts``: url, passed; without one a candidate hasn't passed). ``enough``,
    ``good`` and ``fresh`` are the three verdicts, ``accepted`` all of them.
    """
    from gleanery.operators.candidates import cross_tag_duplicates

    flagged = cross_tag_duplicates(candidates, known)
    recent = F.coalesce(F.col("published_at") >= now - F.make_interval(days=F.lit(30)), F.lit(False))
    counts = flagged.groupBy("tag").agg(F.count("*").alias("fetched"), F.count_if(recent).alias("recent"), F.round(100 * F.count_if("duplicate") / F.count("*"), 6).alias("duplicate_percent"))
    place = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("published_at"), "pos"))
    newest = candidates.where(recent).withColumn("_place", place).where(F.col("_place") <= PROBE_EVALUATED)
    judged = newest.join(verdicts.groupBy("url").agg(F.bool_or("passed").alias("passed")), "url", "left").groupBy("tag").agg(F.count("*").alias("evaluated"), F.count_if("passed").alias("passed"))
    rows = counts.join(judged, "tag", "left").fillna(0, ["evaluated", "passed"]).withColumn("passed_percent", F.when(F.col("evaluated") > 0, F.round(100 * F.col("passed") / F.col("evaluated"), 6)).otherwise(0.0))
    enough, good, fresh = F.col("recent") >= PROBE_RECENT, F.col("passed_percent") >= PROBE_PASSED, F.col("duplicate_percent") <= PROBE_DUPLICATES
    return rows.withColumns({"enough": enough, "good": good, "fresh": fresh, "accepted": enough & good & fresh})


def key_violations(posts: DataFrame, topics: DataFrame, removals: DataFrame) -> DataFrame:
    """Rules that the tables' keys and domains break, with how many rows do."""
    rule = lambda df, name: df.select(F.lit(name).alias("rule"))
    many = lambda df, keys: df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    gone = removals.select(F.col("post_id").alias("id")).distinct()
    found = [
        rule(many(posts, ["url"]), "url_unique"),
        rule(many(removals, ["post_id"]), "one_removal_per_post"),
        rule(many(topics, ["post_id", "topic"]), "topic_unique"),
        rule(posts.where("status not in ('pending', 'published', 'rejected', 'retracted')"), "status_domain"),
        rule(posts.where("tag not in ('trend', 'classic')"), "tag_domain"),
        rule(posts.where("status = 'published'").join(gone, "id", "left_semi"), "removed_but_published"),
    ]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.groupBy("rule").agg(F.count("*").alias("n"))


def publish_violations(feed: DataFrame, publications: DataFrame, config: Config = CONFIG) -> DataFrame:
    """``(id, rule)``: published rows of ``feed_join`` that break an invariant, one row for each rule: title, anchor_length, anchor_pii, rationale_length, evidence, and daily_cap for the publications of a JST day beyond its cap, in their order."""
    broken = F.array_compact(
        F.array(
            F.when(~text.title_ok(F.coalesce("original_title", F.lit(""))), "title"),
            F.when(F.length(unicode.trim(F.col("topic_anchor"))) < config.anchor_min, "anchor_length"),
            F.when(topics.pii_rule(topics.nfkc("topic_anchor")).isNotNull(), "anchor_pii"),
            F.when(~F.length("rationale_text").between(config.rationale_min, config.rationale_max), "rationale_length"),
            F.when(~F.coalesce("evidence_sufficient", F.lit(False)), "evidence"),
        )
    )
    live = feed.where("status = 'published'")
    day = F.to_date(F.from_utc_timestamp("published_at", "Asia/Tokyo"))
    dated = publications.select("post_id", "published_at", day.alias("_day")).join(live.select(F.col("id").alias("post_id")), "post_id", "left_semi")
    over = numbered(dated, ["_day"], ["published_at", "post_id"], "_place").where(F.col("_place") > config.publish_cap).select(F.col("post_id").alias("id"), F.lit("daily_cap").alias("rule"))
    return live.select("id", F.explode(broken).alias("rule")).unionByName(over)


def leaking_rows(rows: DataFrame, terms: DataFrame, column: str, most: int = 1000) -> DataFrame:
    """Rows whose JSON form contains a sensitive term of over 3 characters, in either case.

    The terms, at most ``most`` of them (more are an error), come to the driver while the plan is made and become part of it.
    """
    listed = [r[0].lower() for r in terms.select(column).where(F.length(column) > 3).distinct().limit(most + 1).collect()]
    if len(listed) > most:
        raise ValueError(f"over {most} terms; split the list")
    body = F.lower(F.to_json(F.struct(*rows.columns)))
    return rows.where(F.exists(F.array(*map(F.lit, listed)), lambda t: F.contains(body, t)) if listed else F.lit(False))


def assert_columns_allowed(rows: DataFrame, allowed: set[str]) -> DataFrame:
    """``rows``; raises if it has a column that isn't allowed."""
    extra = set(rows.columns) - allowed
    if extra:
        raise ValueError(f"columns that may not leave: {sorted(extra)}")
    return rows


def columns_not_allowed(rows: DataFrame, allowed: set[str]) -> DataFrame:
    """``(column_name, n)``: the columns that aren't allowed, with how many values each would let out."""
    extra = sorted(set(rows.columns) - allowed)
    if not extra:
        return rows.sparkSession.createDataFrame([], "column_name string, n long")
    counts = rows.agg(*(F.count(c).alias(c) for c in extra))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in extra))))


def cohort_validation(rows: DataFrame, by: Column, columns: dict[str, str], passed: Column) -> DataFrame:
    """By cohort: rows, the share without a value of each of ``columns`` (name to column), and of those with all of them (``evaluated``) how many ``passed``, in percent (null without any)."""
    whole = F.lit(True)
    for c in columns.values():
        whole = whole & F.col(c).isNotNull()
    shares = [F.round(F.count_if(F.col(c).isNull()) / F.count("*"), 8).alias(name) for name, c in columns.items()]
    out = rows.groupBy(by.alias("cohort")).agg(F.count("*").alias("n"), *shares, F.count_if(whole).alias("evaluated"), F.count_if(whole & F.coalesce(passed, F.lit(False))).alias("passed"))
    return out.withColumn("passed_percent", F.when(F.col("evaluated") > 0, F.round(100 * F.col("passed") / F.col("evaluated"), 6)))
