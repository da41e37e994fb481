"""Groups, entropy, topology of a dataset, persistence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from luminal.operators.common import cut, ranked, with_totals


def group_records(df: DataFrame, key: str | Column, order: str) -> DataFrame:
    """key (as text, null being 'null'), n, records in order. A hot key makes one long array: for large groups take
    grouped_rows instead."""
    k = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit("null")).alias("key")
    rest = [c for c in df.columns if c != order]
    return df.groupBy(k).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(order, *rest))).alias("records"))


def grouped_rows(df: DataFrame, key: str | Column, *order: str) -> DataFrame:
    """df with key (as text, null being 'null'), n, the rows of the group, and place, from 0 in order, which must end with
    a unique column: what group_records gives, a row each, so that a group may be of any size."""
    k = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit("null"))
    return ranked(df.withColumn("key", k), ["key"], *order, name="place", count="n")


def entropy(df: DataFrame, category: str, by: list[str] = ()) -> DataFrame:
    """Shannon entropy (bits) of a category, and normalised by the count of records (0 for a single one)."""
    counts = df.groupBy(*by, F.coalesce(F.col(category).cast("string"), F.lit("unknown")).alias("_c")).agg(F.count("*").alias("_k"))
    # -sum p log p = log n - sum(k log k) / n, which needs no second pass
    out = counts.groupBy(*by).agg(F.sum("_k").alias("n"), F.sum(F.col("_k") * F.log2(F.col("_k").cast("double"))).alias("_s"))
    bits = F.log2(F.col("n").cast("double")) - F.col("_s") / F.col("n")
    return out.select(*by, "n", bits.alias("entropy"), F.coalesce(F.try_divide(bits, F.log2(F.col("n").cast("double"))), F.lit(0.0)).alias("normalized"))


def stats(df: DataFrame) -> dict:
    return {"records": df.count(), "fields": df.columns}


def topology_profile(packets: DataFrame) -> DataFrame:
    """One row of facts about packets (semantics, relations, context): a single pass."""
    have = lambda c: F.coalesce(c, F.lit(False))
    kind, structure = F.col("semantics.type"), F.col("semantics.structure")
    n_links = F.coalesce(F.when(F.col("relations.links").isNotNull(), F.size("relations.links")), F.lit(0))
    share = lambda c: F.avg(F.when(have(c), 1.0).otherwise(0.0))
    return packets.agg(
        F.count("*").alias("packets"),
        share(structure == "graph").alias("graph"), share(structure == "tree").alias("tree"), share(structure == "matrix").alias("matrix"), share(structure == "field").alias("field"),
        share(kind == "temporal").alias("temporal"), share(kind == "spatial").alias("spatial"), share(kind == "categorical").alias("categorical"),
        F.coalesce(F.bool_or(F.col("relations.parent").isNotNull()), F.lit(False)).alias("has_hierarchy"),
        F.coalesce(F.bool_or(n_links > 0), F.lit(False)).alias("has_links"), F.coalesce(F.avg(n_links), F.lit(0.0)).alias("mean_links"),
        F.coalesce(F.bool_or(F.col("semantics.embedding").isNotNull()), F.lit(False)).alias("has_embeddings"),
        F.coalesce(F.max("semantics.dimensions"), F.lit(0)).alias("dimensions"),
        F.min("context.timestamp").alias("first"), F.max("context.timestamp").alias("last"),
    )


def topology_rule(rule: str = "shares") -> Column:
    """The layout that a profile calls for, by structure shares or by links."""
    if rule == "shares":
        return (
            F.when(F.col("graph") > 0.5, "graph").when(F.col("tree") > 0, "tree").when((F.col("temporal") > 0) & (F.col("first") < F.col("last")), "timeline-spiral")
            .when((F.col("dimensions") > 3) | F.col("has_embeddings"), "scatter").when(F.col("spatial") > 0, "globe").when(F.col("categorical") > 0, "grid").otherwise("sphere")
        )
    return (
        F.when(F.col("has_links") | (F.col("mean_links") > 2), "graph").when(F.col("has_hierarchy") & (F.col("packets") < 20), "tree-radial").when(F.col("has_hierarchy"), "tree")
        .when(F.col("temporal") > 0.5, "timeline-spiral").when(F.col("has_embeddings") | (F.col("dimensions") > 3), "scatter").when(F.col("spatial") > 0, "globe")
        .when(F.col("categorical") > 0.7, "grid").when(F.col("matrix") > 0.5, "matrix").when(F.col("field") > 0.5, "field").otherwise("sphere")
    )


def detect_topology(packets: DataFrame, rule: str = "shares") -> DataFrame:
    return topology_profile(packets).withColumn("topology", topology_rule(rule))


def persistence_bars(pairs: DataFrame, threshold: float = 0.0, width: float = 20.0) -> DataFrame:
    """Bars of persistence pairs (dimension, birth, death): where they start, how long they are, their colour."""
    d = with_totals(pairs.withColumn("persistence", F.col("death") - F.col("birth")), _top=F.max("death"))
    at = lambda c: F.coalesce(F.try_divide(F.col(c) * width, F.col("_top")), F.lit(0.0))
    color = F.when(F.col("persistence") > 3, "#d62728").when(F.col("dimension") == 0, "#1f77b4").when(F.col("dimension") == 1, "#ff7f0e").when(F.col("dimension") == 2, "#2ca02c").otherwise("#999")
    bars = d.filter(F.col("persistence") >= threshold).withColumns({"width": at("persistence"), "start": at("birth"), "color": color, "emissive": F.when(F.col("persistence") > 2, 0.8).otherwise(0.3)})
    return bars.withColumn("x", F.col("start") + F.col("width") / 2).drop("_top")


def betti_curve(pairs: DataFrame, low: float, high: float, steps: int) -> DataFrame:
    """epsilon, betti_0..2 and the Euler characteristic: how many features of each dimension live at each of steps
    values. Every pair adds one at its birth and takes one at its death; running sums over the grid do the rest."""
    from pyspark.sql import Window as W

    size = (high - low) / (steps - 1)
    # the first grid value at or above the birth, and the first at or above the death
    at = lambda c: F.least(F.lit(steps), F.greatest(F.lit(0), F.ceil((F.col(c) - low) / size))).cast("int")
    turns = pairs.select("dimension", F.explode(F.array(F.struct(at("birth").alias("i"), F.lit(1).alias("d")), F.struct(at("death").alias("i"), F.lit(-1).alias("d")))).alias("t"))
    sums = turns.groupBy(F.col("t.i").alias("i")).agg(*[F.sum(F.when(F.col("dimension") == k, F.col("t.d")).otherwise(0)).alias(f"d{k}") for k in range(3)])
    grid = pairs.sparkSession.range(steps).select(F.col("id").cast("int").alias("i")).join(sums, "i", "left")
    w = W.orderBy("i")  # a row for each step
    b = [F.coalesce(F.sum(f"d{k}").over(w), F.lit(0)).alias(f"betti_{k}") for k in range(3)]
    out = grid.select("i", (low + F.col("i") * size).alias("epsilon"), *b)
    return out.withColumn("euler", F.col("betti_0") - F.col("betti_1") + F.col("betti_2")).drop("i")


def mapper_graph(points: DataFrame, lens: str, intervals: int, overlap: float, cluster: str) -> tuple[DataFrame, DataFrame]:
    """Clusters (interval, cluster, size, radius) of points within overlapping intervals of a lens, and edges between
    clusters of neighbouring intervals that share points. cluster is a column that separates points in an interval."""
    d = with_totals(points, _lo=F.min(lens), _hi=F.max(lens))
    width = (F.col("_hi") - F.col("_lo")) / intervals
    first = F.greatest(F.lit(0), F.ceil((F.col(lens) - F.col("_lo")) / width - 1 - overlap))
    last = F.least(F.lit(intervals - 1), F.floor((F.col(lens) - F.col("_lo")) / width + overlap))
    member = d.withColumn("interval", F.explode(F.sequence(F.least(first, last).cast("int"), last.cast("int")))).select("id", "interval", F.col(cluster).alias("cluster")).distinct()
    nodes = member.groupBy("interval", "cluster").agg(F.count("*").alias("size")).withColumn("radius", 0.2 + F.least(F.lit(0.8), F.col("size") / 20))
    a, b = member.toDF("id", "ai", "ac"), member.toDF("id", "bi", "bc")
    edges = a.join(b, "id").filter("ai < bi").groupBy("ai", "ac", "bi", "bc").agg(F.count("*").alias("shared"))
    return nodes, edges


def mapper_positions(nodes: DataFrame, edges: DataFrame, spacing: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """The clusters of mapper_graph with x, y, z (intervals along x, the clusters of one below another by name), and its
    edges with both ends, their middle and length, and strength, the share of the smaller cluster that is shared."""
    from luminal.operators.common import ranked
    from luminal.operators.graph import place_edges

    name = lambda i, c: F.concat_ws("/", F.col(i), F.col(c))
    placed = ranked(nodes, ["interval"], "cluster", name="_at").withColumn("id", name("interval", "cluster"))
    placed = placed.withColumns({"x": F.col("interval") * spacing, "y": F.col("_at") * -spacing, "z": F.lit(0.0)}).drop("_at")
    ends = edges.select(name("ai", "ac").alias("source"), name("bi", "bc").alias("target"), "shared")
    sizes = placed.select("id", "size")
    e = place_edges(ends, placed).join(sizes.toDF("source", "_s"), "source").join(sizes.toDF("target", "_t"), "target")
    return placed, e.withColumn("strength", F.col("shared") / F.least("_s", "_t")).drop("_s", "_t")


def terrain(points: DataFrame, size: int, cell: float, scale: float = 1.0, error: float = 1e-6) -> DataFrame:
    """gx, gz, height of every place of a grid of size by size cells: log(1 + sum of exp(-2 d)) over all points (x, z),
    wherever they lie; without points, 0. Points without a place, or with one that is not finite, are left out.

    What is far counts by cells, at their points' mean place. A point that counts so is at a distance at which it adds at
    most error, so the sum is off by at most error for each point, and in practice by far less."""
    from math import ceil, log

    from luminal.operators import multipole

    axes = ["x", "z"]
    sound = points.select(*[F.col(a).cast("double").alias(a) for a in axes]).filter(" and ".join(f"{a} is not null and not isnan({a}) and abs({a}) < double('Infinity')" for a in axes))
    # one row for each place: copies of a place are one point with a weight
    sound = cut(sound.groupBy(*axes).agg(F.count("*").cast("double").alias("n")), "terrain-points")
    grid = points.sparkSession.range(size * size).select(F.floor(F.col("id") / size).cast("int").alias("gx"), (F.col("id") % size).cast("int").alias("gz"))
    targets = grid.withColumns({"x": F.col("gx") * cell, "z": F.col("gz") * cell})
    ends = sound.agg(*[f(a).alias(f"{k}{a}") for a in axes for f, k in ((F.min, "low"), (F.max, "high"))]).first()
    if ends.lowx is None:
        return grid.withColumn("height", F.lit(0.0))
    low = [min(0.0, ends[f"low{a}"]) for a in axes]
    extent = max(max(size * cell, ends[f"high{a}"]) - o for a, o in zip(axes, low, strict=True))
    reach = log(1 / error) / 2
    levels = multipole.levels_for(extent, cell)
    m = [max(1, ceil(reach / (cell * 2**k))) for k in range(levels + 2)]
    near = multipole.near_pairs(targets, sound, axes, low, cell, m[0])
    d = lambda px, pz: F.sqrt((F.col("x") - px) * (F.col("x") - px) + (F.col("z") - pz) * (F.col("z") - pz))
    parts = [near.select("gx", "gz", (F.col("p_n") * F.exp(d(F.col("p_x"), F.col("p_z")) * -2)).alias("h"))]
    cells = multipole.pyramid(sound, axes, low, cell, levels, {"n": F.col("n"), "sx": F.col("n") * F.col("x"), "sz": F.col("n") * F.col("z")})
    for level, some in enumerate(cells):
        far = multipole.far_pairs(targets, some, axes, low, cell, level, m)
        parts.append(far.select("gx", "gz", (F.col("p_n") * F.exp(d(F.col("p_sx") / F.col("p_n"), F.col("p_sz") / F.col("p_n")) * -2)).alias("h")))
    sums = reduce(DataFrame.unionByName, parts).groupBy("gx", "gz").agg(F.sum("h").alias("h"))
    return grid.join(sums, ["gx", "gz"], "left").select("gx", "gz", (F.log1p(F.coalesce("h", F.lit(0.0))) * scale).alias("height"))


def kmeans(df: DataFrame, vector: str, k: int = 5, iterations: int = 20, seed: int = 42, dims: int = 3) -> DataFrame:
    """df with cluster (0 to k-1), by the first dims numbers of vector; -1 throughout if there are fewer rows than k."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if df.limit(k).count() < k:
        return df.withColumn("cluster", F.lit(-1))
    d = df.withColumn("_v", array_to_vector(F.transform(F.slice(vector, 1, dims), lambda x: x.cast("double"))))
    return KMeans(k=k, maxIter=iterations, seed=seed, featuresCol="_v", predictionCol="cluster").fit(d).transform(d).drop("_v")
