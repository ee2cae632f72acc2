"""Titles, HTML and topic texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.config import ACCESS_TERMS, CONFIG, ENTITIES, ERROR_PATTERNS, GENERIC_TOPICS, PROHIBIT_TERMS, Config
from gleanery.functions import unicode
from gleanery.functions.unicode import BLANK, trim


def decoded(text: Column) -> Column:
    """Numeric entities, then the named ones in their order."""

    def numeric(text: Column, pattern: str, base: int) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
        prefix = "&#x" if base == 16 else "&#"
        # Spark's char() folds to 256 values, so code points are made through UTF-32
        letter = lambda n: F.decode(F.unhex(F.lpad(F.conv(n, base, 16), 8, "0")), "UTF-32")
        return F.aggregate(found, text, lambda t, n: F.replace(t, F.concat(F.lit(prefix), n, F.lit(";")), letter(n)))

    text = numeric(numeric(text, "&#x([0-9a-fA-F]+);", 16), "&#([0-9]+);", 10)
    for name, plain in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(plain))
    return text


def normalized_title(text: Column) -> Column:
    """Decoded, blanks (not U+3000) as one space, trimmed of all blanks."""
    return trim(F.regexp_replace(decoded(text), "[ \\t\\r\\n\\u2028\\u2029]+", " "))


def title_ok(title: Column) -> Column:
    """Two characters or more, no control characters, no symbol four times in a row, at most ten pictographs (Extended_Pictographic)."""
    found = F.regexp_count(title, F.lit(f"[{unicode.PICTOGRAPH}]"))
    return (F.length(trim(title)) >= 2) & ~title.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]") & ~title.rlike(rf"([^\p{{L}}\p{{N}}{BLANK}])\1{{3}}") & (found <= 10)


def stripped(html: Column) -> Column:
    """HTML without script, style and noscript elements and comments."""
    return F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1>|<!--.*?-->", "")


def visible_text(html: Column) -> Column:
    """Text lines of the HTML: tags as blanks, entities decoded, blanks collapsed, empty lines dropped."""
    text = F.regexp_replace(stripped(html), "<[^>]+>", " ")
    for name, plain in (*ENTITIES[:4], ("&#39;", "'"), ENTITIES[5]):
        text = F.replace(text, F.lit(name), F.lit(plain))
    lines = F.transform(F.split(F.regexp_replace(text, "[ \\t]+", " "), "[\\r\\n]+"), trim)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def one_line(html: Column) -> Column:
    """The feed form: scripts, styles and tags as blanks, all entities decoded, on one line. What noscript holds stays."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), "<[^>]+>", " ")
    return unicode.blanks_as_one(decoded(bare))


def page_title(html: Column) -> Column:
    """The page's title, normalised; blank or missing is NULL."""
    return F.nullif(normalized_title(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), "<[^>]+>", " ")), F.lit(""))


def article_title(heading: Column, html: Column) -> Column:
    """The text of an article's own heading, else the page's title, normalised; blank is NULL."""
    return F.coalesce(F.nullif(normalized_title(heading), F.lit("")), page_title(html))


def signals(html: Column) -> Column:
    """Struct of text_length (without blanks), link_density and paragraph_count of an article's HTML."""
    bare = lambda c: F.length(unicode.without_blanks(c))
    length = bare(visible_text(html))
    links = F.aggregate(F.regexp_extract_all(stripped(html), F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)), F.lit(0), lambda n, a: n + bare(visible_text(a)))
    density = F.when(length > 0, F.least(F.lit(1.0), links / length)).otherwise(1.0)
    return F.struct(length.alias("text_length"), density.alias("link_density"), F.regexp_count(html, F.lit(r"(?i)<p[\s>]")).alias("paragraph_count"))


def failed_conditions(length: Column, density: Column, paragraphs: Column, config: Config = CONFIG) -> Column:
    """Names of the evidence conditions that fail; an empty array passes."""
    return F.array_compact(
        F.array(
            F.when(length < config.min_text_length, "text_length"),
            F.when(density > config.max_link_density, "link_density"),
            F.when(paragraphs < config.min_paragraphs, "paragraph_count"),
        )
    )


def restrictive(terms: Column) -> Column:
    """Whether one sentence has both a term of access and one of prohibition."""
    return F.exists(F.split(terms, r"[。.\n]+"), lambda s: s.rlike(ACCESS_TERMS) & s.rlike(PROHIBIT_TERMS))


def generic_topics(topics: Column) -> Column:
    """No topics, or one of the general ones among them."""
    return topics.isNull() | (F.size(topics) == 0) | F.arrays_overlap(F.transform(topics, trim), F.array(*map(F.lit, GENERIC_TOPICS)))


def error_kind(status: Column, code: Column, message: Column) -> Column:
    """rate_capped, transient, terminal or unknown, in that order."""
    message = F.coalesce(message, F.lit(""))
    status = F.coalesce(status, F.lit(-1))
    number = {"rate_capped": (status == 429) | (F.coalesce(code, F.lit("")) == "429"), "transient": status.between(500, 599), "terminal": status.between(400, 499)}
    return F.coalesce(*(F.when(number[kind] | message.rlike(pattern), kind) for kind, pattern in ERROR_PATTERNS), F.lit("unknown"))


def crawl_delay(robots: Column) -> Column:
    """The largest positive crawl delay of a robots text, NULL without one."""
    found = F.transform(F.regexp_extract_all(robots, F.lit(r"(?im)^\s*crawl-delay\s*:\s*([0-9.]+)"), F.lit(1)), lambda x: x.try_cast("double"))
    return F.array_max(F.filter(found, lambda x: x > 0))
