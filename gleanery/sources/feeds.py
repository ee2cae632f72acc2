"""Feeds and sitemaps: tables of raw XML to rows."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from gleanery.config import CONFIG, Config
from gleanery.functions import text, urls
from gleanery.sources.tables import kept

_MEDIA = "`hatena:imageurl` STRING, `media:thumbnail` STRUCT<_url: STRING>, `media:content` STRUCT<_url: STRING>, enclosure STRUCT<_url: STRING, _type: STRING>"
_ITEM = f"STRUCT<title: STRING, link: STRING, description: STRING, `content:encoded` STRING, `dc:creator` STRING, `note:creatorName` STRING, author STRING, pubDate STRING, `dc:date` STRING, {_MEDIA}>"
_ENTRY = "STRUCT<title: STRING, link: ARRAY<STRUCT<_href: STRING, _rel: STRING>>, content: STRING, summary: STRING, author: STRUCT<name: STRING>, `dc:creator` STRING, published: STRING, updated: STRING>"
RSS, RDF, ATOM = f"channel STRUCT<item: ARRAY<{_ITEM}>>", f"item ARRAY<{_ITEM}>", f"entry ARRAY<{_ENTRY}>"


def _blank(c: Column) -> Column:
    return F.nullif(text.trim(c), F.lit(""))


def timestamp(raw: Column) -> Column:
    """ISO and RFC 2822 dates; others NULL."""
    return F.coalesce(F.try_to_timestamp(raw), F.try_to_timestamp(F.regexp_replace(raw, "^[A-Za-z]{3}, *", ""), F.lit("d MMM yyyy HH:mm:ss Z")))


def thumbnail(item: Column, body: Column) -> Column:
    """The item's image by precedence, else the first image of the body."""
    enclosure = F.when(item["enclosure"]["_type"].isNull() | item["enclosure"]["_type"].startswith("image/"), item["enclosure"]["_url"])
    first = text.decoded(F.nullif(F.regexp_extract(body, r"""(?i)<img[^>]+src=["']([^"'>]+)["']""", 1), F.lit("")))
    return F.coalesce(text.decoded(_blank(item["hatena:imageurl"])), item["media:thumbnail"]["_url"], item["media:content"]["_url"], enclosure, first)


def feed_entries(feeds: DataFrame, xml: str = "xml", config: Config = CONFIG) -> DataFrame:
    """Entries of each feed: RSS 2, RDF or Atom, the first that fits; none for XML that isn't a feed. Columns of the feed stay, but for the XML."""
    keep = [c for c in feeds.columns if c != xml]
    parsed = feeds.select(*keep, *(F.from_xml(F.col(xml), ddl).alias(n) for n, ddl in (("rss", RSS), ("rdf", RDF), ("atom", ATOM))))
    items = F.coalesce("rss.channel.item", "rdf.item")
    plain = parsed.where(items.isNotNull()).select(*keep, F.posexplode(items).alias("place", "i"))
    body = F.coalesce(F.col("i.content:encoded"), F.col("i.description"), F.lit(""))
    i = F.col("i")
    rss = plain.select(
        *keep, "place", text.normalized_title(i["title"]).alias("title"), _blank(i["link"]).alias("link"), F.nullif(F.substring(text.one_line(body), 1, config.excerpt_chars), F.lit("")).alias("excerpt"),
        F.coalesce(*(_blank(text.decoded(i[c])) for c in ("dc:creator", "note:creatorName", "author"))).alias("author"), timestamp(F.coalesce(_blank(i["pubDate"]), _blank(i["dc:date"]))).alias("published_at"), thumbnail(i, body).alias("thumbnail_url"),
    )
    entries = parsed.where(items.isNull() & F.col("atom.entry").isNotNull()).select(*keep, F.posexplode("atom.entry").alias("place", "i"))
    content = F.coalesce(F.col("i.content"), F.col("i.summary"), F.lit(""))
    links = F.filter(i["link"], lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate"))
    href = F.coalesce(F.get(links, 0)["_href"], F.get(i["link"], 0)["_href"])
    atom = entries.select(
        *keep, "place", text.normalized_title(i["title"]).alias("title"), _blank(href).alias("link"), F.nullif(F.substring(text.one_line(content), 1, config.excerpt_chars), F.lit("")).alias("excerpt"),
        F.coalesce(_blank(text.decoded(i["author"]["name"])), _blank(text.decoded(i["dc:creator"]))).alias("author"), timestamp(F.coalesce(_blank(i["published"]), _blank(i["updated"]))).alias("published_at"),
        text.decoded(F.nullif(F.regexp_extract(content, r"""(?i)<img[^>]+src=["']([^"'>]+)["']""", 1), F.lit(""))).alias("thumbnail_url"),
    )
    return rss.unionByName(atom)


def news_entries(entries: DataFrame, order: str) -> DataFrame:
    """News entries (title, url, source_name): the first of each url by ``order``, without the source's name at the end of the title; the source is the author."""
    rows = entries.join(entries.groupBy("url").agg(F.min(order).alias(order)), ["url", order], "left_semi")
    suffix = F.concat(F.lit(" - "), F.col("source_name"))
    ends = F.coalesce(F.endswith("title", suffix), F.lit(False))
    title = F.when(ends, F.substring(F.col("title"), F.lit(1), F.length("title") - F.length(suffix))).otherwise(F.col("title"))
    return rows.withColumns({"title": title, "author": F.col("source_name")})


def unify_sources(entries: dict[str, DataFrame], limit: int = 20, per_feed: dict[str, int] | None = None) -> DataFrame:
    """The entries of all sources in one form: ``(source_id, url, title, author, published_at, place)``.

    Each source's entries have feed (a number; earlier feeds win), place (in the feed), link, title, author and
    published_at. A link counts once in a source; ``per_feed`` caps what a feed of a source gives, ``limit`` what a source gives.
    """
    out = None
    for source, rows in entries.items():
        if cap := (per_feed or {}).get(source):
            rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("feed").orderBy("place"))).where(F.col("_k") <= cap).drop("_k")
        first = rows.groupBy("link").agg(F.min_by(F.struct("title", "author", "published_at"), F.struct("feed", "place")).alias("e"), F.min(F.struct("feed", "place")).alias("at"))
        place = F.row_number().over(Window.orderBy("at"))
        one = first.orderBy("at").limit(limit).select(F.lit(source).alias("source_id"), F.col("link").alias("url"), "e.title", "e.author", "e.published_at", place.alias("place"))
        out = one if out is None else out.unionByName(one)
    return out


def sitemap_entries(sitemaps: DataFrame, xml: str = "xml") -> DataFrame:
    """(kind, loc, lastmod) of each sitemap index, URL set or Atom feed; a blank loc is dropped, a blank lastmod NULL."""
    keep = [c for c in sitemaps.columns if c != xml]
    pair = "STRUCT<loc: STRING, lastmod: STRING>"
    ddl = f"sitemap ARRAY<{pair}>, url ARRAY<{pair}>, entry ARRAY<STRUCT<link: STRING, updated: STRING>>"
    parsed = sitemaps.select(*keep, F.from_xml(F.col(xml), ddl).alias("s"))
    of = lambda kind, a, loc, mod: F.transform(F.coalesce(a, F.array()), lambda x: F.struct(F.lit(kind).alias("kind"), _blank(x[loc]).alias("loc"), _blank(x[mod]).alias("lastmod")))
    rows = F.concat(of("child", F.col("s.sitemap"), "loc", "lastmod"), of("url", F.coalesce("s.url", F.transform("s.entry", lambda x: F.struct(x["link"].alias("loc"), x["updated"].alias("lastmod")))), "loc", "lastmod"))
    return parsed.select(*keep, F.inline(rows)).where("loc is not null")


def _first(node, key: str):
    """The first value under ``key`` in a JSON value, the node's own before those below it, in document order."""
    if isinstance(node, dict):
        if node.get(key) not in (None, "", [], {}):
            return node[key]
        node = list(node.values())
    if isinstance(node, list):
        for x in node:
            if (found := _first(x, key)) is not None:
                return found
    return None


def _name(value) -> str | None:
    """The name in an author value: text, an object with a name, or a list of such."""
    if isinstance(value, list):
        return next(filter(None, map(_name, value)), None)
    value = value.get("name") if isinstance(value, dict) else value
    return value if isinstance(value, str) and value.strip() else None


@pandas_udf(StructType([StructField("author", StringType()), StructField("published", StringType())]))
def linked_data(scripts: pd.Series) -> pd.DataFrame:
    """Author and date of a page's JSON-LD scripts, searched recursively, the first hit of any of them; scripts that aren't JSON are left out."""

    def one(texts) -> tuple[str | None, str | None]:
        nodes = []
        for text_ in texts if texts is not None else ():
            try:
                nodes.append(json.loads(text_))
            except (ValueError, RecursionError):
                continue
        date = _first(nodes, "datePublished")
        return next(filter(None, (_name(_first(n, "author")) for n in nodes)), None), date if isinstance(date, str) else None

    return pd.DataFrame(list(map(one, scripts)), columns=["author", "published"])


def page_metadata(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, description, image, site, author and date of pages: og: over plain tags, JSON-LD over meta for author and date.

    Authors that are blank, ``undefined``, ``null`` or longer than 120 characters are none; so is an article:author that is a URL.
    """
    tags = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)<meta\b(?:[^>"']|"[^"]*"|'[^']*')*>"""), F.lit(0))
    attribute = lambda tag, names: F.lower(F.regexp_extract(tag, rf"""(?is)\b(?:{names})\s*=\s*(["'])(.*?)\1""", 2))
    value = lambda tag: F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*(["'])(.*?)\1""", 2)
    named = F.transform(tags, lambda t: F.struct(attribute(t, "property|name").alias("key"), text.decoded(value(t)).alias("value")))
    scripts = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    plain = F.nullif(F.regexp_extract(F.col(html), r"(?is)<title\b[^>]*>(.*?)</title>", 1), F.lit(""))
    keep = [c for c in pages.columns if c != html]
    rows = pages.select(*keep, named.alias("_m"), plain.alias("_title"), linked_data(scripts).alias("_ld"))
    meta = lambda key: F.get(F.filter("_m", lambda x: (x["key"] == key) & (text.trim(x["value"]) != "")), 0)["value"]
    usable = lambda c: F.when((text.trim(c) != "") & ~F.lower(text.trim(c)).isin("undefined", "null") & (F.length(text.trim(c)) <= 120), text.trim(c))
    author = F.coalesce("_ld.author", F.when(~meta("article:author").rlike("^https?://"), meta("article:author")), meta("author"), meta("dc.creator"))
    return rows.select(
        *keep, text.normalized_title(F.coalesce(meta("og:title"), "_title")).alias("title"), F.coalesce(meta("og:description"), meta("description")).alias("description"), meta("og:image").alias("image"),
        meta("og:site_name").alias("site"), usable(author).alias("author"), timestamp(F.coalesce("_ld.published", meta("article:published_time"))).alias("published_at"),
    )


def snapshot_write(tables: dict[str, DataFrame], path: str, name: str) -> DataFrame:
    """Writes each table under ``path/table/snapshot=name`` and returns their row counts, taken while the rows are written."""
    counts = []
    for table, df in tables.items():
        seen = Observation(f"{table} {name}")
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/{table}/snapshot={name}")
        counts.append((table, 0 if df.isEmpty() else seen.get["n"]))
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(counts, "table_name string, n long")


def consistent_extract(posts: DataFrame, limit: int, since: Column | None = None, by_post: dict[str, DataFrame] | None = None, by_url: dict[str, DataFrame] | None = None, by_host: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The newest posts (id, url, host, published_at, original_excerpt...), their excerpts cut at 500 characters, and the rows of other tables that belong to them.

    Tables of ``by_post`` belong by post_id, those of ``by_url`` by url_hash, those of ``by_host`` by host. The posts are written
    once, so that all parts are of the same choice, however often they are read.
    """
    rows = posts if since is None else posts.where(F.col("published_at") >= since)
    top = rows.orderBy(F.desc_nulls_last("published_at"), F.desc("id")).limit(limit)
    cut = F.when(F.length("original_excerpt") > 500, F.concat(F.substring("original_excerpt", 1, 500), F.lit("…"))).otherwise(F.col("original_excerpt"))
    top = kept(top.withColumn("original_excerpt", cut), "extract")
    keys = {"post_id": (F.col("id"), by_post), "url_hash": (urls.url_key(F.col("url")), by_url), "host": (F.col("host"), by_host)}
    out = {"posts": top}
    for key, (column, tables) in keys.items():
        chosen = top.select(column.alias(key)).distinct()
        out |= {name: df.join(chosen, key, "left_semi") for name, df in (tables or {}).items()}
    return out


def write_json_lines(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes each table as JSON lines under ``path/table``, nulls included, and returns their row counts."""
    counts = []
    for table, df in tables.items():
        seen = Observation(f"{table} lines")
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{table}")
        counts.append((table, 0 if df.isEmpty() else seen.get["n"]))
    return next(iter(tables.values())).sparkSession.createDataFrame(counts, "table_name string, n long")
