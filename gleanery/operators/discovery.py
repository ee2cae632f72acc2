"""Discovery runs over sitemaps: which child sitemaps are read, which URLs are new, how a run ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.config import CONFIG, Config
from gleanery.operators.candidates import allowed_articles
from gleanery.sources.tables import kept


def judged_children(children: DataFrame, cursors: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """Child sitemaps (host, root, child, lastmod) with ``pathological``, ``seeding`` and ``skipped``.

    A lastmod that doesn't parse, lies over a day ahead, or is the same for all children of a root that have one (more than
    one) is pathological; a missing one isn't. Sound ones up to the host's cursor are skipped, but not while a host has no
    seen URL at all, which is its first run.
    """
    siblings = children.groupBy("host", "root").agg(F.count("lastmod").alias("_n"), F.min("lastmod").alias("_lo"), F.max("lastmod").alias("_hi"))
    known = seen.select("host").distinct().withColumn("_known", F.lit(True))
    rows = children.join(siblings, ["host", "root"]).join(cursors.select("host", "cursor"), "host", "left").join(known, "host", "left")
    at = F.col("lastmod").try_cast("timestamp")
    odd = at.isNull() | (at > now + F.make_interval(days=F.lit(1))) | ((F.col("_n") > 1) & (F.col("_lo") == F.col("_hi")))
    pathological = F.col("lastmod").isNotNull() & F.coalesce(odd, F.lit(True))
    rows = rows.withColumns({"pathological": pathological, "seeding": F.col("_known").isNull()})
    skipped = ~F.col("seeding") & ~F.col("pathological") & F.coalesce(at <= F.col("cursor"), F.lit(False))
    return rows.withColumn("skipped", skipped).select(*children.columns, "pathological", "seeding", "skipped")


def _fresh(entries: DataFrame, seen: DataFrame, allow_list: DataFrame | None) -> DataFrame:
    """New (host, url, lastmod): of entries with one URL the last counts, URLs that the host has seen don't."""
    if allow_list is not None:
        entries = allowed_articles(entries, allow_list).where("allowed_for_seeding")
    last = entries.where("url is not null and url != ''").groupBy("host", "url").agg(F.max_by("lastmod", "pos").alias("lastmod"))
    return last.join(seen.select("host", "url"), ["host", "url"], "left_anti")


def discover(roots: DataFrame, children: DataFrame, entries: DataFrame, cursors: DataFrame, seen: DataFrame, now: Column, allow_list: DataFrame | None = None, config: Config = CONFIG) -> tuple[DataFrame, DataFrame]:
    """New URLs (host, url, lastmod) and runs (host, outcome, sitemaps_fetched, urls_new, cursor) of all hosts of ``roots`` (host, root).

    ``entries`` (host, root, child, url, lastmod, pos) are the URLs of child sitemaps, and with a null child those of roots
    themselves. The first pass leaves skipped children out; where it skipped some and still found over ``lastmod_alert`` new
    URLs, the lastmods can't be trusted and the host's sitemaps are all read again. A root that lists children gives its own
    URLs only then. A first run takes all URLs as seen: none of them is new.
    """
    judged = kept(judged_children(children, cursors, seen, now), "children")
    parents = judged.select("host", "root").distinct()
    of_roots = entries.where("child is null")
    plain = of_roots.join(parents, ["host", "root"], "left_anti")
    read = judged.where("not skipped").select("host", "root", "child").distinct()
    first = kept(_fresh(plain.unionByName(entries.join(read, ["host", "root", "child"], "left_semi")), seen, allow_list), "discovered")

    counts = judged.groupBy("host").agg(F.bool_or("skipped").alias("skipped"), F.count("*").alias("children"), F.count_if(~F.col("skipped")).alias("read"))
    hosts = roots.groupBy("host").agg(F.count("*").alias("roots")).join(counts, "host", "left").join(first.groupBy("host").agg(F.count("*").alias("found")), "host", "left")
    known = seen.select("host").distinct().withColumn("known", F.lit(True))
    hosts = hosts.join(known, "host", "left").fillna(0, ["children", "read", "found"])
    again = F.col("known").isNotNull() & F.coalesce("skipped", F.lit(False)) & (F.col("found") > config.lastmod_alert)
    outcome = F.when(F.col("known").isNull(), "seeded").when(again, "completed_lastmod_distrusted").otherwise("completed")
    hosts = kept(hosts.withColumn("outcome", outcome), "hosts")

    distrusted = hosts.where("outcome = 'completed_lastmod_distrusted'").select("host")
    redone = _fresh(entries.join(distrusted, "host", "left_semi"), seen, allow_list)
    new = first.join(distrusted, "host", "left_anti").unionByName(redone)
    n = new.groupBy("host").agg(F.count("*").alias("n"))
    whole = F.col("outcome") == "completed_lastmod_distrusted"
    runs = hosts.join(n, "host", "left").select(
        "host", "outcome", (F.col("roots") + F.when(whole, F.col("children")).otherwise(F.col("read"))).alias("sitemaps_fetched"),
        F.when(F.col("outcome") == "seeded", 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("urls_new"), now.alias("cursor"),
    )
    return new, runs
