"""What operators share: the folder all executors see, ordinals, and columns of coordinates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CENTER = (0.0, 1.6, -3.0)
AXES = ("x", "y", "z")
HOT_SHARE, HOT_LEAST = 1000, 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the one set on the context. Only a local session, as in tests,
    gets a folder of its own: on a cluster each executor would write to its own disk."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        if chosen.isDefined():
            where = chosen.get()
        elif spark.sparkContext.master.startswith("local"):
            where = "file://" + tempfile.mkdtemp(prefix="luminal-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor loses nothing.
    Unlike checkpoint() it keeps statistics and column pruning."""
    path = f"{shared_dir(df.sparkSession)}/luminal/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, label: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """cut, and the sums of counts over the rows, taken while they are written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.sum(c.cast("long")).alias(k) for k, c in counts.items()]), label)
    return out, {k: v or 0 for k, v in seen.get.items()}


def ordinal(df: DataFrame, *order: Column | str, by: list[str] | None = None, name: str = "ord", count: str | None = None) -> DataFrame:
    """df with the place (from 0) of each row in order, which must end with a unique key; count: also of how many.

    With by, places are within groups, by a window. Over all rows no task sees them all: rows are range-partitioned
    and sorted, written once with their place in the partition, and the partitions' sizes are summed up."""
    if not order:
        raise ValueError("an order is needed: rows of a table have none of their own")
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    if by:
        w = W.partitionBy(*by)
        out = df.withColumn(name, (F.row_number().over(w.orderBy(*keys)) - 1).cast("long"))
        return out.withColumn(count, F.count("*").over(w)) if count else out
    rows = cut(df.orderBy(*keys).withColumn("_o_at", F.monotonically_increasing_id()), "ordinal")
    part = F.shiftright("_o_at", 33)
    sizes = rows.groupBy(part.alias("_o_part")).agg(F.count("*").alias("_o_n"))
    # a row for each partition
    sizes = sizes.withColumns({"_o_before": F.sum("_o_n").over(W.orderBy("_o_part")) - F.col("_o_n"), "_o_all": F.sum("_o_n").over(W.orderBy("_o_part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    out = rows.withColumn("_o_part", part).join(F.broadcast(sizes), "_o_part")
    out = out.withColumn(name, F.col("_o_before") + F.col("_o_at").bitwiseAND(F.lit((1 << 33) - 1)))
    if count:
        out = out.withColumn(count, F.col("_o_all"))
    return out.drop("_o_at", "_o_part", "_o_n", "_o_before", "_o_all")


def join_hot(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", n: int | None = None) -> DataFrame:
    """left joined (inner or left) to right, which has a row at most for each key. Keys that have more than one in HOT_SHARE
    of left's rows, of which there are fewer than that, meet right by a broadcast of their rows, so that no task gets
    them all; the others are shuffled. Below HOT_LEAST rows of left no key can fill a task, and the join is a plain one. n:
    the rows of left, if they are known."""
    n = left.count() if n is None else n
    if n < HOT_LEAST:
        return left.join(right, on, how)
    heavy = left.groupBy(*on).count().filter(F.col("count") * HOT_SHARE > n).select(*on)
    heavy = cut(heavy.withColumn("_hot", F.lit(True)), "hot-keys")
    met = cut(right.join(F.broadcast(heavy), on), "hot-rows").drop("_hot")
    split = left.join(F.broadcast(heavy), on, "left")
    hot = split.filter("_hot").drop("_hot").join(F.broadcast(met), on, how)
    return hot.unionByName(split.filter("_hot is null").drop("_hot").join(right, on, how))


def ranked(df: DataFrame, by: list[str], *order: Column | str, name: str = "rank", count: str | None = None) -> DataFrame:
    """df with the place (from 0) of each row among those of its group, and how many those are. One order over all rows
    and a group's first place in it: a group may hold most rows, and no task sees all of it. Groups by null too."""
    rows = ordinal(df, *by, *order, name="_r_at").withColumn("_r_key", F.struct(*by))
    firsts = rows.groupBy("_r_key").agg(F.min("_r_at").alias("_r_first"), F.count("*").alias("_r_n"))
    out = join_hot(rows, firsts, ["_r_key"]).withColumn(name, F.col("_r_at") - F.col("_r_first"))
    if count:
        out = out.withColumn(count, F.col("_r_n"))
    return out.select(*df.columns, *[c for c in (name, count) if c])


def total_range(df: DataFrame, **columns: Column) -> DataFrame:
    """One row of aggregates, to be joined to every row of df: what an automatic domain needs."""
    return df.agg(*[c.alias(k) for k, c in columns.items()])


def with_totals(df: DataFrame, **columns: Column) -> DataFrame:
    """df with aggregates over all of it as columns; the other side is a single row, so it is broadcast."""
    return df.join(F.broadcast(total_range(df, **columns)), F.lit(True))
