"""Hosts: budgets, spacing, the gate's replay, metrics, baselines."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.config import CONFIG, Config
from gleanery.operators.running import running_sums


def request_budget(log: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Requests with their number in the host's UTC day, and ``exhausted`` beyond the budget."""
    day = F.to_date("ts")
    place = F.row_number().over(Window.partitionBy("host", "day").orderBy("ts", "fetch_id"))
    return log.withColumn("day", day).withColumn("nth", place).withColumn("exhausted", F.col("nth") > config.requests_per_day)


def spacing_audit(log: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Requests that follow the host's last one too soon, with the gap in seconds."""
    gap = F.col("ts").cast("double") - F.lag(F.col("ts").cast("double")).over(Window.partitionBy("host").orderBy("ts", "fetch_id"))
    return log.withColumn("gap", F.round(gap, 3)).where(F.col("gap") < config.spacing_seconds)


#: Gate states that end by themselves.
PASSING = ("cool_off", "retry_after")


def replay(events: Iterator[tuple[str, int, float, str | None]], state: dict, config: Config = CONFIG) -> dict:
    """The gate state of a host after (purpose, status, seconds, robots hash) in order, one request at a time, as streams need it.

    401 and 451 stop for good (K3); a forbidden article cools off for a day, a second one stops (K4); a
    forbidden robots or sitemap file stops (K5); two rate limits within a day stop (K6); a robots file that isn't the
    one seen before stops until somebody looks (K1). Strikes stay.
    """
    for purpose, status, at, found in events:
        state["requests"] += 1
        if state["state"] in ("permanent", "stopped"):
            continue
        gate = kind = None
        if status in (401, 451):
            gate, kind = "K3", "permanent"
        elif status == 403 and purpose != "article":
            gate, kind = "K5", "permanent"
        elif status == 403:
            state["strikes"] += 1
            gate, kind = "K4", "cool_off" if state["strikes"] < 2 else "permanent"
        elif status == 429:
            last, state["limited"] = state["limited"], at
            again = last is not None and at - last < config.strike_hours * 3600
            gate, kind = "K6", "permanent" if again else "retry_after"
        elif status == 200 and purpose == "robots" and found is not None:
            known, state["robots"] = state["robots"], found
            if known is not None and known != found:
                gate, kind = "K1", "stopped"
        if gate:
            state["gate"], state["state"], state["since"] = gate, kind, at
    return state


def new_state() -> dict:
    return {"gate": None, "state": None, "since": None, "strikes": 0, "limited": None, "robots": None, "requests": 0}


def gate_events(log: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Requests (fetch_id, host, purpose, status, ts, robots_hash) with the ``gate`` that each would raise, its ``kind`` and the host's ``strikes`` so far, by the rules of ``replay``.

    A rule needs of the host's earlier requests only how many articles were forbidden, when the last rate limit was and
    which robots file was seen last: sums and last values along the host's log, which no task holds as a whole.
    """
    article = F.coalesce(F.col("purpose") == "article", F.lit(False))
    forbidden = F.coalesce(F.col("status") == 403, F.lit(False))
    limited, seen = F.when(F.col("status") == 429, F.col("ts")), F.when((F.col("status") == 200) & (F.col("purpose") == "robots"), F.col("robots_hash"))
    rows = running_sums(log, ["host"], ["ts", "fetch_id"], {"strikes": (forbidden & article).cast("long")}, "gates", {"_limited": limited, "_seen": seen})
    again = F.coalesce(F.col("ts").cast("double") - F.col("_limited").cast("double") < config.strike_hours * 3600, F.lit(False))
    gate = F.when(F.col("status").isin(401, 451), "K3").when(forbidden, F.when(article, "K4").otherwise("K5")).when(F.col("status") == 429, "K6").when(seen != F.col("_seen"), "K1")
    g = F.col("gate")
    kind = F.when(g == "K1", "stopped").when((g == "K4") & (F.col("strikes") < 2), "cool_off").when((g == "K6") & ~again, "retry_after").when(g.isNotNull(), "permanent")
    return rows.withColumn("gate", gate).withColumn("kind", kind).drop("_limited", "_seen")


def gate_state(log: DataFrame, config: Config = CONFIG) -> DataFrame:
    """``(host, gate, state, since, until, strikes, requests, limited_at, robots_hash)``: all that a host's log leaves for its next request.

    The first request that stops a host decides; without one, the last that made it wait. ``until`` is when a cool-off or
    a wait ends by itself. These are minima and maxima, so that a host's requests are added up where they are.
    """
    at = lambda *names: F.struct("ts", "fetch_id", *names)
    stops = F.col("kind").isin("permanent", "stopped")
    seen = (F.col("status") == 200) & (F.col("purpose") == "robots") & F.col("robots_hash").isNotNull()
    found = gate_events(log, config).groupBy("host").agg(
        F.min(F.when(stops, at("gate", "kind", "strikes"))).alias("stop"), F.max(F.when(F.col("gate").isNotNull() & ~stops, at("gate", "kind", "strikes"))).alias("wait"),
        F.max("strikes").alias("strikes"), F.count("*").alias("requests"), F.max(F.when(F.col("status") == 429, F.col("ts"))).alias("limited_at"), F.max(F.when(seen, at("robots_hash"))).alias("file"),
    )
    last = F.coalesce("stop", "wait")
    wait = F.when(last["kind"] == "cool_off", F.make_interval(hours=F.lit(config.strike_hours))).when(last["kind"] == "retry_after", F.make_interval(secs=F.lit(config.retry_after_seconds)))
    return found.select(
        "host", last["gate"].alias("gate"), last["kind"].alias("state"), last["ts"].alias("since"), (last["ts"] + wait).alias("until"), F.coalesce(F.col("stop.strikes"), F.col("strikes")).cast("int").alias("strikes"),
        "requests", "limited_at", F.col("file.robots_hash").alias("robots_hash"),
    )


def host_gate_replay(log: DataFrame, config: Config = CONFIG) -> DataFrame:
    """``(host, gate, state, since, until, strikes, requests)``: the gate of each host after its log."""
    return gate_state(log, config).drop("limited_at", "robots_hash")


def host_day_metrics(current: DataFrame, delta: DataFrame) -> DataFrame:
    """Counters of (host, day) with a delta added."""
    names = [c for c in current.columns if c not in ("host", "day")]
    return current.unionByName(delta).groupBy("host", "day").agg(*(F.sum(c).alias(c) for c in names))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def host_baseline(metrics: DataFrame, days: int, before: Column | None = None) -> DataFrame:
    """Rates over each host's latest ``days`` rows (before a day, so that the current run isn't in them)."""
    rows = metrics if before is None else metrics.where(F.col("day") < before)
    latest = rows.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("day")))).where(F.col("place") <= days)
    sums = latest.groupBy("host").agg(F.count("*").alias("days"), *(F.sum(c).alias(c) for c in ("processed", "published", "promotional", "author_present")))
    return sums.select("host", "days", _ratio(F.col("published"), F.col("processed")).alias("publish_rate"), _ratio(F.col("promotional"), F.col("processed")).alias("promotional_rate"), _ratio(F.col("author_present"), F.col("published")).alias("author_rate"))


def yield_collapse(baseline: DataFrame, run: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Hosts of a run with ``collapsed``: a long enough baseline, and a rate under half of it."""
    rate = _ratio(F.col("published"), F.col("processed"))
    flag = (F.col("days") >= config.yield_days) & (F.col("processed") > 0) & (F.col("publish_rate") > 0) & (rate < config.yield_ratio * F.col("publish_rate"))
    return run.join(baseline, "host").withColumn("rate", rate).withColumn("collapsed", flag)


def run_freshness(runs: DataFrame, now: Column, config: Config = CONFIG) -> DataFrame:
    """The latest start, its age in days, and whether that is stale (none is)."""
    age = F.datediff(now, F.max("started_at"))
    return runs.agg(F.max("started_at").alias("last"), age.alias("age_days"), F.coalesce(age > config.freshness_days, F.lit(True)).alias("stale"))


def run_status(runs: DataFrame) -> DataFrame:
    """Each host's last run: incomplete without an end, else ok."""
    last = F.max_by(F.struct("id", "finished_at", "outcome"), F.struct("started_at", "id"))
    return runs.groupBy("host").agg(last.alias("r")).select("host", "r.id", F.when(F.col("r.finished_at").isNull(), "incomplete").otherwise("ok").alias("status"), "r.outcome")


#: Columns of the log of runs.
RUNS = ("id", "host", "started_at", "finished_at", "sitemaps_fetched", "urls_new", "status_counts", "outcome")


def started_runs(log: DataFrame, hosts: DataFrame, now: Column) -> DataFrame:
    """The log of runs (``RUNS``) with a running row for each of ``hosts`` (host), numbered on from the last id."""
    from gleanery.operators.running import numbered

    last = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).first().id
    nothing = F.to_json(F.struct(*(F.lit(0).alias(s) for s in ("pending", "fetched", "skipped"))))
    fresh = numbered(hosts.select("host").distinct(), [], ["host"], "place").select(
        (F.col("place") + last).alias("id"), "host", now.alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit(0).cast("long").alias("sitemaps_fetched"), F.lit(0).cast("long").alias("urls_new"), nothing.alias("status_counts"), F.lit("running").alias("outcome")
    )
    return log.select(*RUNS).unionByName(fresh)


def finished_runs(log: DataFrame, runs: DataFrame, counts: DataFrame, now: Column) -> DataFrame:
    """The log with the end of ``runs`` (host, outcome, sitemaps_fetched, urls_new; as ``discovery.discover`` gives them) on the last running row of each host, with its ``counts`` of seen URLs (host, pending, fetched, skipped)."""
    last = log.where("outcome = 'running'").groupBy("host").agg(F.max("id").alias("id"))
    tally = F.to_json(F.struct(*(F.coalesce(s, F.lit(0)).alias(s) for s in ("pending", "fetched", "skipped"))))
    ends = runs.join(last, "host").join(counts, "host", "left").select("id", F.struct(now.alias("finished_at"), "sitemaps_fetched", "urls_new", tally.alias("status_counts"), "outcome").alias("_e"))
    joined = log.select(*RUNS).join(ends, "id", "left")
    ended = ("finished_at", "sitemaps_fetched", "urls_new", "status_counts", "outcome")
    return joined.select(*(F.when(F.col("_e").isNotNull(), F.col(f"_e.{c}")).otherwise(F.col(c)).alias(c) if c in ended else F.col(c) for c in RUNS))


def advanced_cursors(cursors: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Cursors (host, cursor) after ``runs`` (host, outcome): now for all that didn't fail."""
    done = runs.where("outcome != 'failed'").select("host", now.alias("_now"))
    return cursors.join(done, "host", "full_outer").select("host", F.coalesce("_now", "cursor").alias("cursor"))


def terms_changes(pages: DataFrame) -> DataFrame:
    """Terms texts of a host in order, each classified against the one before: baseline, unchanged, restrictive_change, benign_change."""
    from gleanery.functions import text

    plain = F.lower(F.trim(F.regexp_replace(F.regexp_replace(text.stripped(F.col("body")), "<[^>]+>", " "), "[ \\t]+", " ")))
    rows = pages.withColumn("plain", plain).withColumn("hash", F.sha2("plain", 256))
    before = F.lag("hash").over(Window.partitionBy("host").orderBy("seq"))
    kind = F.when(before.isNull(), "baseline").when(before == F.col("hash"), "unchanged").when(text.restrictive(F.col("plain")), "restrictive_change").otherwise("benign_change")
    return rows.withColumn("change", kind)
