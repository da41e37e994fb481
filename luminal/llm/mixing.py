"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from luminal.llm.common import SPACE, cut

CELL_ROWS = 500  # a cell is what one window group ranks
PART_CELLS = 1000  # cells of a band whose offsets one window group adds up
SMALL = 100_000  # rows of a table of bands that may be broadcast


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE.replace("[", "[^", 1))), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """sources (skey, source_size) with target: share of all sizes dealt by weight, none above cap times its
    source's size, the excess reshared by weight. Water filling has a closed form: the sources that reach
    their cap are those with the least cap for their weight, and prefix sums in that order give the level.
    The table has one row per source; the windows over all of them are meant for sources by the thousand."""
    by_key, by_ratio = W.orderBy("skey"), W.orderBy("ratio", "skey")
    everything = W.partitionBy()
    s = sources.withColumn("k", (F.row_number().over(by_key) - 1) % len(weights))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("k") + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("w_left", F.sum("w").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
    # the level if this source and all later ones stay below their caps; the first such level holds for all of them
    s = s.withColumn("lambda", F.when(F.col("left") / F.col("w_left") <= F.col("ratio"), F.col("left") / F.col("w_left")))
    s = s.withColumn("level", F.first("lambda", ignorenulls=True).over(by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return s.select("skey", "source_size", F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap")).otherwise(F.col("level") * F.col("w")).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, cap: float = 3.0, seed: int = 0) -> DataFrame:
    """One row per row of df: id_col, size, source_size, target, taken, copies.

    Size is the number of words (null text: 0). Weights repeat over the sources in code point order, a null
    source last. Within a source documents are ordered by band of size (eight to a doubling), then by a hash of the id
    (of the text, where it is null), then by size; document i (from 1) at rate r = target / source_size is emitted once per integer in (u + (i-1) r, u + i r], u being one offset
    drawn from the seed and the source. So copies are floor(r) or ceil(r), never above cap, reruns agree, and
    because neighbours in the order have like sizes the words taken come near the target.
    A source without words has target 0 and takes nothing; repeated rows count separately; an empty table gives
    an empty result. cap must be at least share."""
    sized = df.select(
        F.col(id_col).alias("id"),
        F.when(F.col(source_col).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string"))).alias("skey"),
        word_count(F.col(text_col)).alias("size"),
        F.when(F.col(id_col).isNull(), F.md5(F.coalesce(F.col(text_col), F.lit("")))).otherwise(F.col(id_col).cast("string")).alias("mark"),
    )
    sized = cut(sized, "mix-sizes")
    md5 = lambda c: F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")
    # cells cut a source into pieces one task can rank: by size (an eighth of a doubling), and within it by hash,
    # since a third of all rows may be copies of one size
    more, doubling = F.col("size") + 1, F.length(F.bin(F.col("size") + 1)) - 1
    sized = sized.withColumn("band", (doubling * 8 + F.floor(more * 8 / F.pow(F.lit(2.0), doubling)) - 8).cast("int"))
    bands = cut(sized.groupBy("skey", "band").agg((1 + F.floor(F.count("*") / CELL_ROWS)).alias("salts")), "mix-bands")
    bands = F.broadcast(bands) if bands.count() <= SMALL else bands
    sized = sized.join(bands, ["skey", "band"]).withColumn("salt", md5(F.col("mark")) % F.col("salts")).drop("salts", "mark")
    cell = ["skey", "band", "salt"]
    cells = sized.groupBy(cell).agg(F.count("*").alias("n"), F.sum("size").alias("cell_size"))
    cells = cut(cells, "mix-cells")
    goal = targets(cells.groupBy("skey").agg(F.sum("cell_size").alias("source_size")), weights, share, cap)
    # offsets in two steps, so that no task adds up all cells of a source
    cells = cells.withColumn("part", F.floor(F.col("salt") / PART_CELLS))
    part = ["skey", "band", "part"]
    parts = cells.groupBy(part).agg(F.sum("n").alias("part_n"))
    parts = parts.withColumn("before", F.sum("part_n").over(W.partitionBy("skey").orderBy("band", "part")) - F.col("part_n")).drop("part_n")
    inside = F.sum("n").over(W.partitionBy(part).orderBy("salt")) - F.col("n")
    offset = cells.withColumn("inside", inside).join(parts, part).withColumn("offset", F.col("before") + F.col("inside")).select(*cell, "offset")
    plan = offset.join(goal, "skey").withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    ranked = sized.withColumn("rank", F.row_number().over(W.partitionBy(cell).orderBy("size", F.col("id").asc_nulls_first())))
    out = ranked.join(plan, cell)
    u = md5(F.concat(F.lit(f"{seed}/"), F.col("skey"))) / F.lit(float(1 << 32))
    crossed = lambda i: F.floor(i * F.col("rate") + u)
    i = F.col("offset") + F.col("rank")
    copies = (crossed(i) - crossed(i - 1)).cast("long")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))
