"""Streaming jobs replayed from files in several batches against the batch operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import hosts, merges
from gleanery.streaming import jobs

LOG = "fetch_id long, host string, purpose string, status int, ts timestamp, robots_hash string"
START = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def replay(spark, tmp_path, rows, schema, batches=3):
    """A stream over files of the rows in order, one file a batch."""
    size = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(stream, tmp_path, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def log(n=60):
    status = [200, 403, 200, 429, 200, 200, 451]
    return [(k, f"h{k % 3}", "article", status[k * 7 % 61 % 7] if k % 3 else 200, START + k * HOUR, None) for k in range(n)]


@pytest.fixture
def stateful(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    kept = spark.conf.get(key)
    jobs.with_state_store(spark)
    yield spark
    spark.conf.set(key, kept)


def final(out):
    """The last row of each host: that with most requests, and of these the latest."""
    last = {}
    for r in out.collect():
        last[r.host] = max(last.get(r.host, (0, 0.0)), (r.requests, r["at"], r.gate, r.state, r.strikes), key=lambda x: x[:2])
    return {h: (r[2], r[3], r[4], r[0]) for h, r in last.items()}


def varied(seed, n):
    rng = random.Random(seed)
    return [(k, f"h{rng.randrange(12)}", rng.choice(["article", "article", "robots", "sitemap"]), rng.choice([200] * 14 + [403, 429, 451]), START + k * HOUR, rng.choice("x" * 12 + "y")) for k in range(n)]


def test_host_gate_equals_the_batch_job(stateful, tmp_path):
    rows = varied(3, 240)
    out = final(run(jobs.stream_host_gate(replay(stateful, tmp_path, rows, LOG, 6)), tmp_path, "gate", "update"))
    want = {r.host: (r.gate, r.state, r.strikes, r.requests) for r in hosts.host_gate_replay(stateful.createDataFrame(rows, LOG)).collect()}
    assert {v[0] for v in want.values()} >= {"K1", "K3", "K5", "K6"}
    over = lambda v: (v[0], None if v[1] in hosts.PASSING else v[1], *v[2:])
    assert {h: over(v) for h, v in out.items()} == {h: over(v) for h, v in want.items()}


def test_host_gate_goes_on_from_a_batch(stateful, tmp_path):
    rows = varied(4, 200)
    past = hosts.gate_state(stateful.createDataFrame(rows[:110], LOG))
    out = final(run(jobs.stream_host_gate(replay(stateful, tmp_path, rows[110:], LOG), initial=past), tmp_path, "onward", "update"))
    want = {r.host: (r.gate, r.strikes, r.requests) for r in hosts.host_gate_replay(stateful.createDataFrame(rows, LOG)).collect()}
    later = {r[1] for r in rows[110:]}
    assert {h: (v[0], *v[2:]) for h, v in out.items()} == {h: v for h, v in want.items() if h in later}


def test_waits_end_by_timers(stateful, tmp_path):
    hours = {"cool": [(0, 403), (30, 200)], "wait": [(1, 429), (30, 200)], "twice": [(2, 403), (20, 403)], "forgot": [(0, 429), (25, 429)], "clock": [(40, 200), (60, 200), (80, 200)]}
    rows = sorted(((h, at, s) for h, log in hours.items() for at, s in log), key=lambda r: r[1])
    rows = [(k, h, "article", s, START + at * HOUR, None) for k, (h, at, s) in enumerate(rows)]
    out = run(jobs.stream_host_gate(replay(stateful, tmp_path, rows, LOG, len(rows))), tmp_path, "timers", "update")
    seen = {}
    for r in sorted(out.collect(), key=lambda r: (r["at"], r.requests)):
        seen.setdefault(r.host, []).append((r.state, round((r["at"] - START.replace(tzinfo=dt.UTC).timestamp()) / 3600, 2)))
    assert ("cool_off", 0.0) in seen["cool"] and (None, 24.0) in seen["cool"]
    assert ("retry_after", 1.0) in seen["wait"] and (None, 1.02) in seen["wait"]
    assert seen["twice"] == [("cool_off", 2.0), ("permanent", 20.0)]
    assert ("retry_after", 25.0) in seen["forgot"] and "permanent" not in {x for x, _ in seen["forgot"]}


def test_budget_and_metrics(spark, tmp_path):
    rows = log(72)
    out = run(jobs.stream_host_budget(replay(spark, tmp_path, rows, LOG)), tmp_path, "budget", "update")
    got = {(r["host"], r["day"]): r["requests"] for r in out.groupBy("host", "day").agg(F.max("requests").alias("requests")).collect()}
    want = {(r["host"], r["day"]): r["requests"] for r in spark.createDataFrame(rows, LOG).groupBy("host", F.to_date("ts").alias("day")).agg(F.count("*").alias("requests")).collect()}
    assert got == want
    days = jobs.stream_host_metrics(spark.createDataFrame(rows, LOG).withColumn("outcome", F.lit("published")))
    assert {r["day"] for r in days.collect()} == {dt.date(2024, 1, d) for d in (1, 2, 3, 4)}


def test_ingest_merges_batches(spark, tmp_path):
    names = "id long, url string, source_name string, original_title string, original_excerpt string, author string, published_at timestamp, updated_at timestamp, status string"
    start = dt.datetime(2024, 1, 1)
    rows = [(k, f"http://a.b/{k % 12}?utm_source={k}", "s", f"t{k}", None, None, start, start + dt.timedelta(minutes=k), "pending") for k in range(30)]
    stream = jobs.stream_ingest(replay(spark, tmp_path, rows, names), "updated_at")
    body = jobs.merge_batches(str(tmp_path / "table"), merges.upsert_posts, ["url"])
    stream.writeStream.foreachBatch(body).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    want = {(f"http://a.b/{k}", f"t{k}") for k in range(12)}
    titles = lambda table: {(r["url"], r["original_title"]) for r in table.collect()}
    assert titles(jobs.snapshot(spark, str(tmp_path / "table"), 2)) == want
    assert jobs.snapshot(spark, str(tmp_path / "table"), -1) is None
    # a repeated batch changes nothing, and a later one rewrites the buckets of its own keys only
    for _ in range(2):
        body(spark.createDataFrame([(99, "http://a.b/new", "s", "t99", None, None, start, start, "pending")], names), 3)
        assert titles(jobs.snapshot(spark, str(tmp_path / "table"), 3)) == want | {("http://a.b/new", "t99")}
    assert titles(jobs.snapshot(spark, str(tmp_path / "table"), 2)) == want
    assert len(list((tmp_path / "table" / "data" / "000000003").glob("bucket=*"))) == 1


RETRY = "url_hash string, ts timestamp, finished boolean"


def outcomes(spark, tmp_path, rows, name):
    rows = [(u, START + at * HOUR, done) for u, at, done in sorted(rows, key=lambda r: r[1])]
    out = run(jobs.stream_retry(replay(spark, tmp_path, rows, RETRY, len(rows))), tmp_path, name, "append")
    zero = START.replace(tzinfo=dt.UTC).timestamp()
    return sorted((r.url_hash, round((r["at"] - zero) / 3600, 1), r.attempts, r.outcome) for r in out.collect() if r.url_hash != "clock")


def test_retries_fall_due_and_end(stateful, tmp_path):
    rows = [("clock", h, False) for h in range(5, 120, 12)]
    rows += [("a", 0, False), ("a", 2, False), ("a", 9, False), ("a", 40, False)]  # three attempts, then it is given up
    rows += [("b", 0, False)]  # never tried again
    rows += [("c", 1, False), ("c", 4, True), ("c", 30, False)]  # finished, and a new failure later
    got = outcomes(stateful, tmp_path, rows, "retries")
    assert got == [
        ("a", 0.0, 1, "scheduled"), ("a", 1.0, 1, "due"), ("a", 2.0, 2, "scheduled"), ("a", 8.0, 2, "due"), ("a", 9.0, 3, "scheduled"), ("a", 33.0, 3, "due"), ("a", 40.0, 3, "terminal"),
        ("b", 0.0, 1, "scheduled"), ("b", 1.0, 1, "due"), ("b", 72.0, 1, "expired"),
        ("c", 1.0, 1, "scheduled"), ("c", 2.0, 1, "due"), ("c", 4.0, 1, "finished"), ("c", 30.0, 1, "scheduled"), ("c", 31.0, 1, "due"), ("c", 102.0, 1, "expired"),
    ]


def test_retries_agree_with_the_batch_merge(stateful, tmp_path):
    """The next attempts of failures that all come in time are those of ``schedule_retries``."""
    rows = [("u", 0, False), ("u", 3, False), ("u", 20, False)]
    out = run(jobs.stream_retry(replay(stateful, tmp_path, [(u, START + at * HOUR, d) for u, at, d in rows], RETRY, 3)), tmp_path, "agree", "append")
    got = {r.attempts: r.next_at for r in out.where("outcome = 'scheduled'").collect()}
    queue = stateful.createDataFrame([], "url_hash string, url string, host string, lane string, reason string, attempts int, first_queued_at timestamp, next_attempt_at timestamp, expires_at timestamp")
    for k, (u, at, _) in enumerate(rows, 1):
        failed = stateful.createDataFrame([(u, "http://h/u", "h", "rss", "llm_transient")], "url_hash string, url string, host string, lane string, reason string")
        queue = merges.schedule_retries(queue, failed, F.lit(str(START + at * HOUR)).cast("timestamp")).drop("terminal")
        row = queue.first()
        assert row.attempts == k and row.next_attempt_at.replace(tzinfo=dt.UTC).timestamp() == got[k]
