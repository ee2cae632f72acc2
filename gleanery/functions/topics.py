"""Personal information, anchors and topics; NFKC is the one step that Spark lacks and pandas does."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from gleanery.config import CONFIG, HONORIFIC, SAFE_PREFIXES, Config
from gleanery.functions.unicode import BLANK, trim

# Particles and brackets at which an anchor falls into terms.
PARTICLES = rf"(?:の|を|に|は|が|で|と|も|や|から|まで|より|へ|・|、|。|「|」|【|】|\[|\]|\(|\)|[{BLANK}]+)"
# Nouns that need no source.
CONNECTORS = ("理由", "背景", "経緯", "決め手")


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def pii_rule(normal: Column) -> Column:
    """The rule that an NFKC text breaks: an account handle, or an honorific after other than a safe prefix; NULL for none."""
    handle = normal.rlike(r"@[A-Za-z0-9_.]{2,}")
    named = F.regexp_extract_all(normal, F.lit(HONORIFIC), F.lit(1))
    return F.when(handle, "personal_info_sns_handle").when(F.exists(named, lambda x: ~x.isin(*SAFE_PREFIXES)), "personal_info_honorific")


def anchor_gate(anchor: Column, normal: Column, config: Config = CONFIG) -> Column:
    """ok, anchor_too_short or anchor_prohibited_term; NULL for no anchor."""
    return F.when(anchor.isNull(), None).when(F.length(trim(anchor)) < config.anchor_min, "anchor_too_short").when(pii_rule(normal).isNotNull(), "anchor_prohibited_term").otherwise("ok")


def feature_terms(normal: Column) -> Column:
    """Distinct terms of two characters or more that aren't only digits and symbols."""
    terms = F.transform(F.split(normal, PARTICLES), trim)
    return F.array_distinct(F.filter(terms, lambda t: (F.length(t) >= 2) & ~t.rlike(rf"^[\p{{P}}\p{{S}}0-9０-９{BLANK}]+$")))


def validate_topics(rows: DataFrame, key: str, most: int = 4) -> DataFrame:
    """Topics of ``rows`` (key, topics array, title, anchor), each with the reason why it is dropped, NULL if it is kept.

    Reasons in order: length, digits, symbols, personal information, the anchor itself, a repeat of a kept one,
    katakana without a term in the title; beyond the first ``most`` kept ones: over_limit.
    """
    flat = rows.select(key, F.posexplode("topics").alias("place", "topic"), nfkc("title").alias("title"), nfkc("anchor").alias("anchor")).withColumn("normal", nfkc(trim(F.col("topic"))))
    n = F.col("normal")
    own = F.filter(feature_terms(n), lambda t: ~t.isin(*CONNECTORS))
    grounded = F.arrays_overlap(F.transform(own, lambda t: F.lower(t)), F.transform(feature_terms(F.coalesce("title", F.lit(""))), lambda t: F.lower(t)))
    katakana = n.rlike(r"[\x{30A1}-\x{30FA}]")
    reason = (
        F.when(~F.length(n).between(2, 10), "length_out_of_bounds").when(n.rlike(r"[0-9０-９]"), "contains_digit").when(n.rlike(rf"[\p{{P}}\p{{S}}{BLANK}]"), "contains_symbol_or_punctuation")
        .when(pii_rule(n).isNotNull(), "contains_pii").when(F.coalesce(n == trim(F.col("anchor")), F.lit(False)), "identical_to_anchor")
    )
    ungrounded = katakana & (F.size(own) > 0) & ~F.coalesce(grounded, F.lit(False))
    flat = flat.withColumn("first_reason", reason).withColumn("ungrounded", ungrounded)
    # a repeat of one that was dropped as ungrounded isn't a repeat of a kept one: it is ungrounded itself
    able = F.col("first_reason").isNull() & ~F.col("ungrounded")
    nth = F.row_number().over(Window.partitionBy(key, able, F.lower("normal")).orderBy("place"))
    marked = flat.withColumn("able", able).withColumn("nth", nth)
    kept = F.col("able") & (F.col("nth") == 1)
    rank = F.sum(kept.cast("int")).over(Window.partitionBy(key).orderBy("place"))
    marked = marked.withColumn("kept", kept).withColumn("rank", rank)
    final = F.coalesce("first_reason", F.when(F.col("ungrounded"), "ungrounded_proper_noun"), F.when(F.col("nth") > 1, "duplicate_topic"), F.when(F.col("rank") > most, "over_limit"))
    return marked.select(key, "place", "topic", "normal", final.alias("reason"))


def hmac_signature(fields: list[Column], secret: bytes) -> Column:
    """HMAC-SHA256, in hex, of the fields joined by a bar; the secret is the caller's."""
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    message = F.concat_ws("|", *(F.coalesce(f, F.lit("")) for f in fields)).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)
