"""Connected components of a distributed edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import checkpointed


def _both(*pairs: tuple[str, str]) -> Column:
    """Rows (a, b) of each pair of columns, in one pass."""
    return F.inline(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs)))


def _unsettled(star: DataFrame) -> int:
    """How many nodes have several parents, or a parent and a child: none if every component is one star."""
    end = lambda c, up: F.struct(F.col(c).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    ends = star.select(F.inline(F.array(end("a", 1), end("b", 0))))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").count()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (columns a, b); root is the smallest node reachable.

    Every round links each node's larger neighbours to its smallest neighbour (large star), then
    its smaller ones (small star), until every component is one star around its smallest node. Minima are
    aggregated map-side first and joined back by equality, so that a hub is never gathered in one task. Each round
    ends in a checkpoint; only counts go to the driver. Nulls and self-loops are ignored; an empty table gives an
    empty result.
    """
    star = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    star = checkpointed(star)
    while _unsettled(star):
        both = star.select(_both(("a", "b"), ("b", "a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(_both(("b", "m"), ("a", "m"))).where("a <> b")
        star = checkpointed(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return star.select(F.col("a").alias("node"), F.col("b").alias("root")).union(star.select("b", "b").distinct())
