"""Mixing sources to target weights: how many words of each document a mix takes.

Sources share all words by weight, none beyond a few times its own size. A source's target is made of complete epochs
first; the rest comes from a weighted sample without replacement (Efraimidis and Spirakis, 2006): each document draws
an exponential key, scaled by its quality weight, and in the order of keys documents are taken until the budget is full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.running import numbered, running_sums

from .stages import written

#: Weights of the sources in the order of their names, repeating; and times a source's size that a target may reach.
SOURCE_WEIGHTS, MOST = (1, 2, 3), 3
#: Quality weights of documents labelled bad and good; those between by their mean label, and those without a label.
BAD, GOOD, UNKNOWN = 0.1, 1.0, 0.5

_WORD = r"[^\x20\x09-\x0D]+"


def label_weights(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``(doc_id, weight)`` from quality labels 0 and 1; several labels of a document count by their mean, rows without id or label not at all."""
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where("doc_id is not null and label is not null")
    return rows.groupBy("doc_id").agg((BAD + (GOOD - BAD) * F.avg("label")).alias("weight"))


def exponential_key(seed: str, doc_id: Column, weight: Column) -> Column:
    """An exponential draw of rate ``weight`` for each id: the smaller, the earlier it is sampled. Weights that aren't positive come last."""
    bits = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 13), 16, 10)
    u = (bits.cast("double") + 0.5) / float(1 << 52)
    return F.when(weight > 0, -F.log(u) / weight).otherwise(float("inf"))


def targets(sources: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` of sources (source, source_size), whose targets add up to all sizes.

    Weights go to the sources by name, by code point, null last. With level c a source gets c times its weight but at
    most ``most`` times its size; the level at which all words are given is found from sums along the order of the
    levels at which sources reach their bounds. Sources may be many: no task holds them all.
    """
    order = [F.asc_nulls_last("source")]
    ranked = numbered(sources, [], order, "place").withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    bounded = ranked.withColumn("bound", most * F.col("source_size")).withColumn("level", F.col("bound") / F.col("w").cast("double"))
    along = running_sums(bounded, [], ["level", "place"], {"bounds": "bound", "ws": "w"}, "levels")
    whole = bounded.agg(F.sum("source_size").alias("words"), F.sum("w").alias("w")).first()
    words, all_w = whole.words or 0, whole.w or 0
    full = F.col("bounds") + F.col("level") * (all_w - F.col("ws")) < words  # at its level not all words are given yet
    spent = along.where(full).agg(F.sum("bound").alias("bounds"), F.sum("w").alias("w")).first()
    rest = all_w - (spent.w or 0)
    level = (words - (spent.bounds or 0)) / rest if rest else 0.0
    return along.select("source", "source_size", F.when(full, F.col("bound").cast("double")).otherwise(level * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: DataFrame, seed: str = "1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", source_weights: tuple[int, ...] = SOURCE_WEIGHTS, most: int = MOST) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``: words of each document, of its source, the source's target, and words that the mix takes, repeats counted.

    ``weights`` has a row (doc_id, weight) for each document with a quality weight; others have ``UNKNOWN``. A source's
    complete epochs take all of its documents; the document at which the rest of its budget ends is taken in part, so that
    a source's words differ from its target by at most a half. Keys depend on the seed and the id only: reruns agree.

    Null texts are empty, empty texts take nothing, a null source is one source. Rows that share an id share its key and
    follow each other by size; null ids count as an empty one. An empty table gives an empty one, other columns are ignored.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(_WORD)).cast("long")
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size")), "sizes")
    shares = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), source_weights, most).select(F.col("source").alias("_source"), "source_size", "target")
    numbered_rows = rows.withColumn("_row", F.monotonically_increasing_id())  # of a written table: the same each time; it splits equal rows over ranges
    without = numbered_rows.where("doc_id is null").withColumn("weight", F.lit(UNKNOWN))
    weighted = numbered_rows.where("doc_id is not null").join(weights.select("doc_id", F.col("weight").cast("double").alias("weight")), "doc_id", "left").select(*numbered_rows.columns, F.coalesce("weight", F.lit(UNKNOWN)).alias("weight"))
    keyed = weighted.unionByName(without).withColumn("_key", exponential_key(seed, F.col("doc_id"), F.col("weight"))).drop("weight")
    along = running_sums(keyed, ["source"], ["_key", "doc_id", "size", "_row"], {"upto": "size"}, "mix")
    joined = along.join(shares, F.col("source").eqNullSafe(F.col("_source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0).cast("long"))
    rest = F.floor(F.col("target") - epochs * F.col("source_size") + 0.5)
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - (F.col("upto") - F.col("size"))))
    return joined.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken"))


def mixed_texts(docs: DataFrame, taken: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, copy, text)``: the texts of a mix, whole ones first, the last one cut after its words, with their blanks. Ids must be unique and not null."""
    chosen = taken.where("taken > 0").select("doc_id", F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    copies = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_taken") - 1) / F.col("_size")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(chosen, "doc_id").withColumn("copy", F.explode(copies))
    left = (F.col("_taken") - F.col("copy") * F.col("_size")).cast("int")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{_WORD}"), F.lit(0)), F.lit(1), left), "")
    return rows.select("doc_id", F.col("copy").cast("int").alias("copy"), F.when(left < F.col("_size"), cut).otherwise(F.col("text")).alias("text"))


#: The same in SQL.
SQL = r"""
WITH w AS (
  SELECT doc_id, 0.1 + (1.0 - 0.1) * avg(quality) AS weight FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), d AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS size,
    -ln((CAST(CAST('0x' || sha256('1:' || coalesce(CAST(d.doc_id AS VARCHAR), ''))[1:13] AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) / CAST(coalesce(w.weight, 0.5) AS DOUBLE) AS key
  FROM documents d LEFT JOIN w ON d.doc_id = w.doc_id
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS bound, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source
), l AS (
  SELECT *, bound / CAST(w AS DOUBLE) AS level, sum(source_size) OVER () AS words, sum(w) OVER () AS all_w FROM s
), f AS (
  SELECT *, sum(bound) OVER (ORDER BY level, source NULLS LAST ROWS UNBOUNDED PRECEDING) + level * (all_w - sum(w) OVER (ORDER BY level, source NULLS LAST ROWS UNBOUNDED PRECEDING)) < words AS is_full FROM l
), t AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(bound AS DOUBLE)
    ELSE (CAST(words AS DOUBLE) - coalesce(sum(CASE WHEN is_full THEN bound END) OVER (), 0)) / (all_w - coalesce(sum(CASE WHEN is_full THEN w END) OVER (), 0)) * w END AS target
  FROM f
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
), p AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, CAST(floor(e.target - e.epochs * e.source_size + 0.5) AS BIGINT) AS rest,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS earlier
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, epochs * size + least(size, greatest(0, rest - earlier)) AS taken FROM p
"""
