"""Ordered rows: last of a series, runs, islands, order books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_n(df: DataFrame, by: list[str], n: int, *order: str) -> DataFrame:
    """The n latest rows of each series, rank 1 being the latest. Spark keeps only n rows of a key before it shuffles."""
    w = W.partitionBy(*by).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def latest(df: DataFrame, by: list[str], *order: str) -> DataFrame:
    """The latest row of each series, by aggregation."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*by, "_r.*")


def runs(df: DataFrame, by: list[str], key: str, *order: str) -> DataFrame:
    """Runs of consecutive rows with equal key: by, run (from 1), key, n, first and last of the order."""
    w = W.partitionBy(*by).orderBy(*order)
    new = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    d = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    return d.groupBy(*by, "run", key).agg(F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def islands(df: DataFrame, by: list[str], number: str, least: int = 4) -> DataFrame:
    """Stretches of consecutive numbers with at least so many: by, first, last, n. A repeated number counts once. Rows are
    sorted once, which spills; only those with a neighbour in their stretch are aggregated where least is more than 1."""
    w = W.partitionBy(*by).orderBy(number)
    c = F.col(number)
    d = df.select(*by, number).filter(c.isNotNull())
    d = d.withColumns({"_island": c - F.dense_rank().over(w), "_before": c - F.lag(number).over(w), "_after": F.lead(number).over(w) - c})
    if least > 1:
        d = d.filter("_before <= 1 or _after <= 1")
    d = d.groupBy(*by, "_island").agg(F.min(number).alias("first"), F.max(number).alias("last"))
    return d.withColumn("n", (F.col("last") - F.col("first") + 1).cast("long")).filter(F.col("n") >= least).drop("_island")


def hold_at_least(df: DataFrame, by: list[str], time: str, holds: Column, seconds: float) -> DataFrame:
    """Stretches over which a condition holds, from its first to its last row, that last so long."""
    w = W.partitionBy(*by).orderBy(time)
    d = df.withColumn("_on", F.coalesce(holds, F.lit(False)))
    d = d.withColumn("_new", F.when(F.lag("_on").over(w).eqNullSafe(F.col("_on")), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w)).filter("_on")
    out = d.groupBy(*by, "_run").agg(F.min(time).alias("start"), F.max(time).alias("stop"), F.count("*").alias("n")).drop("_run")
    return out.filter((F.unix_micros("stop") - F.unix_micros("start")) / 1e6 >= seconds)


def edge_alerts(df: DataFrame, by: list[str], holds: Column, *order: str) -> DataFrame:
    """Rows at which a condition starts (trigger) or ends (clear); rows for which it is null are passed over."""
    w = W.partitionBy(*by).orderBy(*order)
    d = df.withColumn("_on", holds).filter("_on is not null")
    d = d.withColumn("_was", F.coalesce(F.lag("_on").over(w), F.lit(False)))
    return d.filter("_on <> _was").withColumn("event", F.when(F.col("_on"), "trigger").otherwise("clear")).drop("_on", "_was")


def book_levels(orders: DataFrame, depth: int = 10, by: list[str] = ("symbol",)) -> DataFrame:
    """Best levels of each side with the running size: bids from the highest price, asks from the lowest."""
    price = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    levels = orders.groupBy(*by, "side", "price").agg(F.sum("size").alias("size"))
    w = W.partitionBy(*by, "side").orderBy(price)
    d = levels.withColumns({"level": F.row_number().over(w) - 1, "cumulative": F.sum("size").over(w.rowsBetween(W.unboundedPreceding, 0))})
    return d.filter(F.col("level") < depth)


def book_summary(orders: DataFrame, by: list[str] = ("symbol",)) -> DataFrame:
    """Volume-weighted price (0 without volume), best bid and ask, mid price and spread (a side without orders is 0)."""
    best = lambda f, side: F.coalesce(f(F.when(F.col("side") == side, F.col("price"))), F.lit(0.0))
    d = orders.groupBy(*by).agg(F.sum(F.col("price") * F.col("size")).alias("_ps"), F.sum("size").alias("volume"), best(F.max, "bid").alias("bid"), best(F.min, "ask").alias("ask"))
    return d.select(*by, "volume", F.coalesce(F.try_divide("_ps", "volume"), F.lit(0.0)).alias("vwap"), "bid", "ask", ((F.col("bid") + F.col("ask")) / 2).alias("mid"), (F.col("ask") - F.col("bid")).alias("spread"))


def current_book(snapshots: DataFrame, by: list[str] = ("symbol",), time: str = "ts") -> DataFrame:
    """Each snapshot (side, levels) replaces its side: the orders of the latest one of each side."""
    return latest(snapshots, [*by, "side"], time).select(*by, "side", F.explode("levels").alias("_l")).select(*by, "side", "_l.price", "_l.size")


def random_walk_value(df: DataFrame, by: list[str], change: str, *order: str) -> DataFrame:
    """The running product of 1 + change, as value."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("value", F.exp(F.sum(F.log1p(F.col(change))).over(w)))
