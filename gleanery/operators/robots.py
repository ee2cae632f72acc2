"""Robots rules (RFC 9309): snapshots of robots.txt to rules of an agent, and URLs against these rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions.urls import percent_normal

#: The rules of a host are dealt so many times, so that no task has all URLs of a large host.
SALTS = 16


def robots_rules(snapshots: DataFrame, agent: str) -> DataFrame:
    """``(host, pattern, allow)``: the rules for ``agent`` in the latest snapshot (host, seq, robots_text) of each host.

    A group is a run of User-agent lines with the rules up to the next such run; other lines, such as Sitemap or
    Crawl-delay, end nothing. All groups that name the agent (in any case, before a version) count together; if none does,
    those of ``*`` count. Rules before the first group and empty patterns are no rules. A host's snapshot is one file,
    so its lines are bounded.
    """
    latest = snapshots.groupBy("host").agg(F.max_by("robots_text", "seq").alias("text"))
    lines = latest.select("host", F.posexplode(F.split(F.regexp_replace("text", "^﻿", ""), "\r\n|\r|\n")).alias("line_no", "line"))
    body = F.regexp_replace("line", "#.*$", "")
    keyed = lines.select("host", "line_no", F.lower(F.btrim(F.substring_index(body, ":", 1))).alias("kind"), F.btrim(F.regexp_replace(body, "^[^:]*:?", ""), F.lit(" \t")).alias("value"))
    keyed = keyed.where(F.col("kind").isin("user-agent", "allow", "disallow"))
    along = Window.partitionBy("host").orderBy("line_no")
    begins = (F.col("kind") == "user-agent") & ~F.lag("kind", 1, "").over(along).eqNullSafe(F.lit("user-agent"))
    grouped = keyed.withColumn("begins", begins.cast("int")).withColumn("grp", F.sum("begins").over(along))
    name = F.lower(F.regexp_extract("value", r"^(\*|[A-Za-z_-]+)", 1))
    named = grouped.where("kind = 'user-agent'").groupBy("host", "grp").agg(F.bool_or(name == agent.lower()).alias("own"), F.bool_or(name == "*").alias("every"))
    chosen = named.withColumn("known", F.bool_or("own").over(Window.partitionBy("host"))).where(F.col("own") | (~F.col("known") & F.col("every"))).select("host", "grp")
    rules = grouped.where("kind != 'user-agent' and value != ''").join(chosen, ["host", "grp"])
    return rules.select("host", F.col("value").alias("pattern"), (F.col("kind") == "allow").alias("allow")).distinct()


def _found(path: Column, rest: Column, start: Column) -> Column:
    """Where ``path`` goes on after the texts ``rest`` have been found in it one after the other from ``start`` on; 0 if one isn't there."""

    def step(at: Column, piece: Column) -> Column:
        where = F.position(piece, path, at)
        return F.when(piece == "", at).when((at > 0) & (where > 0), where + F.length(piece)).otherwise(F.lit(0))

    return F.aggregate(rest, start, step)


def robots_blocked(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path with its query) with ``blocked``, by ``rules`` (host, pattern, allow).

    The longest matching pattern wins, allow wins ties, no rule allows, and robots.txt itself is always allowed. ``*`` stands
    for any text, ``$`` at the end for the end; paths and patterns are compared in one percent-coding. The text of a pattern
    before its first ``*`` has to be a prefix of the path, so paths meet patterns by equality of prefixes, of the lengths that
    the host's patterns have; only patterns with the same prefix are then looked at.
    """
    normal = F.regexp_replace(percent_normal(F.col("pattern")), r"\$(?!$)", "%24")
    anchored = F.endswith(normal, F.lit("$"))
    parts = F.split(F.regexp_replace(normal, r"\$$", ""), r"\*", -1)
    shaped = rules.select("host", "allow", F.length(normal).alias("weight"), anchored.alias("anchored"), F.get(parts, F.lit(0)).alias("head"), F.slice(parts, F.lit(2), F.size(parts)).alias("rest"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    lengths = shaped.groupBy("host").agg(F.collect_set(F.length("head")).alias("lengths")).select("*", salts)
    heads = shaped.groupBy("host", "head").agg(F.collect_set(F.struct("weight", "allow", "anchored", "rest")).alias("same")).select("*", salts)

    whole = F.when(F.col("path") == "", "/").otherwise(F.col("path"))
    coded = F.replace(F.replace(percent_normal(whole), F.lit("*"), F.lit("%2A")), F.lit("$"), F.lit("%24"))
    known = urls.select("host", "path").distinct().withColumn("coded", coded).withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    tried = known.join(lengths, ["host", "salt"]).select("host", "path", "salt", "coded", F.explode(F.filter("lengths", lambda n: n <= F.length("coded"))).alias("n"))
    tried = tried.select("host", "path", "salt", "coded", F.substring("coded", F.lit(1), F.col("n")).alias("head"))

    def fits(rule: Column) -> Column:
        path, rest, start = F.col("coded"), rule["rest"], F.length("head") + 1
        last = F.element_at(rest, -1)
        upto = _found(path, F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(0))), start)
        at_end = F.when(F.size(rest) == 0, F.length(path) == F.length("head")).otherwise((upto > 0) & F.endswith(path, last) & (F.length(path) - F.length(last) + 1 >= upto))
        return F.when(rule["anchored"], at_end).otherwise(_found(path, rest, start) > 0)

    best = F.array_max(F.transform(F.filter("same", fits), lambda r: F.struct(r["weight"].alias("weight"), r["allow"].alias("allow"))))
    hits = tried.join(heads, ["host", "head", "salt"]).select("host", "path", best.alias("best")).where("best is not null")
    verdict = hits.groupBy("host", "path").agg(F.max("best").alias("_best"))
    blocked = F.coalesce(~F.col("_best.allow"), F.lit(False)) & ~F.col("path").rlike(r"^/robots\.txt(\?|$)")
    return urls.join(verdict, ["host", "path"], "left").withColumn("blocked", blocked).drop("_best")
