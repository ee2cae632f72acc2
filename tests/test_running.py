"""Sums along an order against a plain window, on skewed groups, nulls, ties and empty tables."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.operators.running import numbered, running_sums


def rows(spark, n=3000):
    day = F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("d"), F.col("id") % 11))
    return spark.range(n).select("id", day.alias("day"), (F.col("id") * 7919 % 101).alias("k"), (F.col("id") % 5).alias("v"), F.lit("x").alias("_range"))


def test_equals_a_window(spark):
    df = rows(spark).repartition(5)
    w = Window.partitionBy("day").orderBy("k", F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("v").over(w).alias("upto"), F.count("*").over(w).alias("n"))
    got = running_sums(df, ["day"], ["k", F.desc("id")], {"upto": "v", "n": F.lit(1).cast("long")})
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_last_values_before_a_row(spark):
    df = rows(spark).repartition(5)
    seen = F.when(F.col("id") % 50 == 0, F.col("v"))
    w = Window.partitionBy("day").orderBy("k", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.lit(1).alias("n"), F.last(seen, ignorenulls=True).over(w).alias("seen"))
    got = running_sums(df, ["day"], ["k", "id"], {"n": F.lit(1).cast("long")}, lasts={"seen": seen})
    assert sorted((r.id, r.seen) for r in got.collect()) == sorted((r.id, r.seen) for r in want.collect())
    assert any(r.seen is not None for r in got.collect())


def test_hot_group_fills_many_ranges_and_no_window_covers_it(spark):
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = numbered(rows(spark), ["day"], ["id"])
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    assert {r.place for r in got.where("day = 'hot'").collect()} == set(range(1, 2001))
    assert "Window [sum(place" in plan.replace("_w0", "") and "[__range" in plan


@pytest.mark.parametrize("by", [[], ["day"]])
def test_whole_table_and_empty_table(spark, by):
    df = rows(spark)
    assert numbered(df.limit(0), by, ["id"]).count() == 0
    if not by:
        assert {(r.id, r.place) for r in numbered(df, [], [F.desc("id")]).collect()} == {(i, 3000 - i) for i in range(3000)}
