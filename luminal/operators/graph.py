"""Graphs as two tables: nodes (id, ...) and edges (source, target, weight)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from luminal.functions.vectors import distance
from luminal.operators.common import cut, join_hot


def edges_of(df: DataFrame, id_col: str = "id", links: str = "links") -> DataFrame:
    """source, target, weight, type from a column of links (to, weight, type)."""
    return df.select(F.col(id_col).alias("source"), F.explode(links).alias("_l")).select("source", F.col("_l.to").alias("target"), F.coalesce("_l.weight", F.lit(1.0)).alias("weight"), F.col("_l.type").alias("type"))


def place_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends' positions, their middle and length; edges to no node are dropped."""
    end = lambda key, p: nodes.select(F.col("id").alias(key), *[F.col(a).alias(p + a) for a in "xyz"])
    d = edges.join(end("source", "s"), "source").join(end("target", "t"), "target")
    middle = {"m" + a: (F.col("s" + a) + F.col("t" + a)) / 2 for a in "xyz"}
    return d.withColumns(middle | {"length": distance([F.col("s" + a) for a in "xyz"], [F.col("t" + a) for a in "xyz"])})


def connections(df: DataFrame) -> DataFrame:
    """Explicit connections named either (from, to) or (source, target)."""
    have = set(df.columns)
    either = lambda a, b: F.coalesce(*[F.col(c) for c in (a, b) if c in have])
    return df.select(either("from", "source").alias("source"), either("to", "target").alias("target"))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, degree: edges that touch the node, a loop counting once; with nodes also those without edges."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id"))
    out = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return out if nodes is None else nodes.select("id").join(out, "id", "left").fillna(0, ["degree"])


def shared_degrees(left: DataFrame, right: DataFrame, key: str = "key") -> DataFrame:
    """left (id, key) with degree: the edges of each row in the graph that ties every row of left to all rows of right
    with its key. A key's rows of right are counted once, and no edge is made. A null key ties nothing."""
    n = right.groupBy(key).agg(F.count("*").alias("degree"))
    return join_hot(left, n.filter(F.col(key).isNotNull()), [key], "left").fillna(0, ["degree"]).select("id", key, "degree")


def degree_style(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, degree, size and emissive by the node's degree and how many nodes there are; without nodes those of edges."""
    d = degrees(edges, nodes)
    n = (d if nodes is None else nodes).agg(F.count("*").alias("_n"))
    d = d.join(F.broadcast(n), F.lit(True))
    return d.select("id", "degree", (0.5 + F.col("degree") / F.col("_n") * 1.5).alias("size"), (0.3 + F.col("degree") / 10).alias("emissive"))


def neighbours(edges: DataFrame, ids: list) -> DataFrame:
    """Distinct nodes one edge away from any of ids, in either direction."""
    both = edges.select("source", "target").union(edges.select("target", "source")).toDF("a", "b")
    return both.filter(F.col("a").isin(ids)).select(F.col("b").alias("id")).distinct()


def distances_from(edges: DataFrame, start, max_hops: int | None = None) -> DataFrame:
    """id, hops from start along edges in either direction: a breadth-first search, one join for each hop, until no
    node is left that can be reached; with max_hops only those within so many. The edges are read and joined with the
    frontier at each hop; edges and what has been seen are kept in the shared folder."""
    both = cut(edges.select("source", "target").union(edges.select("target", "source")).toDF("a", "b").distinct(), "bfs-edges")
    seen = both.sparkSession.createDataFrame([(start, 0)], f"id {both.schema['a'].dataType.simpleString()}, hops int")
    front = seen
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        front = cut(both.join(front.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(hop)), "bfs")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if hop % 16 == 0:  # a plan of few scans, however deep the search
            seen = cut(seen, "bfs-seen")
    return seen


def bipartite(df: DataFrame, left: str, lists: str, right_prefix: str) -> DataFrame:
    """Edges between records and the members of their lists."""
    e = df.select(F.col(left).cast("string").alias("source"), F.explode(lists).alias("_m"))
    return e.select("source", F.concat(F.lit(right_prefix), "_m").alias("target")).distinct()


def ecs_graph(entities: DataFrame, systems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of entities (id, components), their components, and systems (name, queries); a component
    has the count of its entities."""
    e = bipartite(entities.select(F.concat(F.lit("entity:"), F.col("id").cast("string")).alias("id"), "components"), "id", "components", "component:")
    s = bipartite(systems.select(F.concat(F.lit("system:"), F.col("name")).alias("id"), "queries"), "id", "queries", "component:")
    parts = e.groupBy(F.col("target").alias("id")).agg(F.count_distinct("source").alias("entities"))
    queried = s.select(F.col("target").alias("id")).distinct()
    nodes = e.select(F.col("source").alias("id")).distinct().withColumn("kind", F.lit("entity"))
    nodes = nodes.unionByName(s.select(F.col("source").alias("id")).distinct().withColumn("kind", F.lit("system")))
    comps = parts.join(queried, "id", "full_outer").fillna(0, ["entities"]).withColumn("kind", F.lit("component"))
    return nodes.unionByName(comps, allowMissingColumns=True), e.unionByName(s)


def neighbour_edges(df: DataFrame, id_col: str = "id", neighbours_col: str = "neighbors") -> DataFrame:
    """Edges to listed neighbours that are rows and whose id is not below the record's own."""
    e = df.select(F.col(id_col).alias("source"), F.explode(neighbours_col).alias("target"))
    return e.join(df.select(F.col(id_col).alias("target")).distinct(), "target", "left_semi").filter("target >= source").select("source", "target")
