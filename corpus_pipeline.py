"""The corpus pipeline: each stage works on all that the one before it kept.

The stages take (spark, docs, sf_dir) and return a DataFrame; ``run`` writes each stage's rows to the
shared folder and reads them again for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import decontaminate, linededup, packing, quality, setjoin
from gleanery.llm.stages import text_batches, written
from gleanery.sources.tables import spread, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 5) scores 0.3 or more."""
    text_batches(spark)
    return quality.accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines (operator 7); one that loses all its words goes. ``n_chars`` follows the text."""
    text_batches(spark)
    out = linededup.dedup_lines(docs.select(*COLUMNS), linededup.LEAST, linededup.NEAR)
    left = F.col("n_dropped") == 0
    return out.where(left | F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", F.when(left, F.col("n_chars")).otherwise(F.length("text"))).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of the n-gram Jaccard join (operator 8). Null ids stay, and so do rows that share the smallest id: they are one document."""
    text_batches(spark)
    docs = docs.select(*COLUMNS)
    copies = setjoin.similar_components(docs).where("component_id != doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which operator 1 finds no benchmark item."""
    text_batches(spark)
    return decontaminate.without(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most 2048 tokens (operator 6)."""
    text_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: Trained models, edit distances and a tokenizer aren't SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spread(table(spark, sf_dir, "documents"))
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
