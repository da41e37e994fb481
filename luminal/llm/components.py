"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from luminal.llm.common import cut


def _turned(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select("b", "a"))


def _large(edges: DataFrame) -> DataFrame:
    """Every node points its larger neighbours to the least of its neighbours and itself."""
    both = _turned(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node points its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether edges (a > b) are stars that touch nowhere: no node points twice, and none that is pointed at points on."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (node, root): each node of an edge, but the roots themselves, with the least node that it
    reaches. The least neighbour is found by aggregation and joined back, so a hub is never gathered in one
    task; each half of a round is written to the shared folder, so a plan holds few exchanges, and edges that are
    stars already take no round. Self loops and repeats do no harm."""
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(now):
        now = cut(_small(cut(_large(now), "edges")), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
