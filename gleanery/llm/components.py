"""Connected components of a link table by min-label contraction, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import Scratch


#: Links in one file of a round.
ROWS = 100_000


def _mark(edges: DataFrame) -> tuple:
    """Number and combined hash of the links: equal for equal tables."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``links``, a written table; component: the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
    Beyond"): the number of links never grows, and no node's links are gathered, only minima of them.
    Rows with a null end are left out; self links give a component of one node. Each round is written to
    the shared folder, and the one before it deleted. Rounds are many, so their joins broadcast nothing: that
    would fill the driver.
    """
    tables = Scratch(links.sparkSession)
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).dropna()
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    given = edges = tables.write(edges, "links")
    nodes = given.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    edges = edges.where("u != v")
    before, now = None, _mark(edges)
    while now[0] and now != before:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour is tied to the smallest of the neighbourhood
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: every node ties its smaller neighbours, and itself, to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        last, edges = edges, tables.write(small.coalesce(now[0] // ROWS + 1), "links")  # their number never grows
        tables.drop(last)
        before, now = now, _mark(edges)  # a round changes nothing exactly when every component is a star around its smallest node
    out = nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    out = Scratch(links.sparkSession).write(out, "components")
    tables.drop(given, edges)
    return out
