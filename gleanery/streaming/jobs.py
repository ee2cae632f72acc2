"""Structured Streaming jobs: the incremental forms of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.config import CONFIG, Config
from gleanery.functions import urls
from gleanery.streaming.stateful import GATE_OUT, RETRY_OUT, HostGate, Retries


def stream_ingest(entries: DataFrame, time: str, within: str = "2 days") -> DataFrame:
    """Entries with canonical URLs, the first of each within the watermark; ``merge_batches`` takes them to a table."""
    canon = entries.withColumn("url", urls.canonical_url(F.col("url"))).where("url is not null")
    return canon.withWatermark(time, within).dropDuplicatesWithinWatermark(["url"])


def snapshot(spark: SparkSession, path: str, n: int) -> DataFrame | None:
    """The table under ``path`` as of batch ``n``; None before the first one."""
    versions = _versions(spark, path, n)
    return spark.read.parquet(*(f"{path}/data/{v:09d}/bucket={b}" for b, v in versions.items())) if versions else None


def _versions(spark: SparkSession, path: str, n: int) -> dict[int, int]:
    """The batch that wrote each bucket last."""
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{path}/versions/{n:09d}").collect()} if n >= 0 else {}


def merge_batches(path: str, merge: Callable[[DataFrame, DataFrame], DataFrame], key: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch body: merges batch n into the table under ``path``, which ``snapshot`` reads.

    The table lies in buckets of the key. A batch reads and writes the buckets of its own keys and a list of which batch
    wrote each bucket last, so a repeated batch writes the same again; files of older batches stay for readers of older
    snapshots. ``merge`` has to work key by key.
    """
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("bucket")

    def body(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        delta = batch.dropDuplicates(key).persist()
        touched = sorted(r["bucket"] for r in delta.select(bucket).distinct().collect())
        versions = _versions(spark, path, n - 1)
        old = [f"{path}/data/{versions[b]:09d}/bucket={b}" for b in touched if b in versions]
        current = spark.read.schema(delta.schema).parquet(*old) if old else delta.limit(0)
        merged = merge(current, delta)
        merged.select("*", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{n:09d}")
        delta.unpersist()
        now = versions | {b: n for b in touched}
        spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/{n:09d}")

    return body


def stream_host_budget(log: DataFrame, late: str = "1 hour", config: Config = CONFIG) -> DataFrame:
    """Requests of each host and UTC day, and whether the budget is gone."""
    counts = log.withWatermark("ts", late).groupBy("host", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("requests"))
    return counts.select("host", F.to_date("w.start").alias("day"), "requests", (F.col("requests") >= config.requests_per_day).alias("exhausted"))


def stream_host_metrics(outcomes: DataFrame, late: str = "1 hour") -> DataFrame:
    """Outcomes of each host and JST day (which begins at 15:00 UTC)."""
    w = F.window("ts", "1 day", "1 day", "15 hours").alias("w")
    count = lambda kind: F.count_if(F.col("outcome") == kind).alias(kind)
    sums = outcomes.withWatermark("ts", late).groupBy("host", w).agg(F.count("*").alias("processed"), count("published"), count("dropped"))
    return sums.select("host", F.to_date(F.from_utc_timestamp("w.start", "Asia/Tokyo")).alias("day"), "processed", "published", "dropped")


def with_state_store(spark: SparkSession) -> None:
    """Chooses the state store that keyed state with several variables needs; to be called before such a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_host_gate(log: DataFrame, late: str = "10 minutes", config: Config = CONFIG, initial: DataFrame | None = None) -> DataFrame:
    """The gate of each host after each batch of its requests (fetch_id, host, purpose, status, ts, robots_hash), and when a wait of it ends.

    Requests of one batch are taken in order of time. A stream can go on from a log of the past: ``initial`` is its
    ``hosts.gate_state``. State is a few small variables a host; it needs ``with_state_store``.
    """
    rows = log.withWatermark("ts", late).select("host", "purpose", "status", "fetch_id", "robots_hash", "ts", F.col("ts").cast("double").alias("at"))
    start = None
    if initial is not None:
        start = initial.select("host", "gate", "state", "strikes", "requests", "robots_hash", *(F.col(c).cast("double").alias(c) for c in ("since", "limited_at"))).groupBy("host")
    return rows.groupBy("host").transformWithStateInPandas(HostGate(config), GATE_OUT, "Update", "EventTime", start)


def stream_retry(failures: DataFrame, late: str = "10 minutes", config: Config = CONFIG) -> DataFrame:
    """What becomes of failing URLs (url_hash, ts, finished): each failure is ``scheduled`` with its next attempt or ``terminal`` beyond the last one, each attempt is ``due`` when its time comes, URLs that ``finished`` leave, and those not done after the time to live are ``expired``.

    It needs ``with_state_store``.
    """
    rows = failures.withWatermark("ts", late).select("url_hash", "finished", "ts", F.col("ts").cast("double").alias("at"))
    return rows.groupBy("url_hash").transformWithStateInPandas(Retries(config), RETRY_OUT, "Append", "EventTime")
