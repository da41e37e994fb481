"""Snapshots and time: as-of lookup, interpolation, comparison, buckets, links and fixations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from luminal.functions.vectors import distance


def asof(probes: DataFrame, series: DataFrame, by: list[str], time: str = "ts", values: list[str] | None = None) -> DataFrame:
    """Each probe (by, time) with the last row of series at or before it (before_*) and the first at or after it
    (after_*); of several at that time the greatest before and the least after, by their values, which must have an
    order. Rows without a time are no neighbours, and a probe without one has none. Both sides meet in two sorted passes
    for each key, forwards and backwards, each of which only carries the last row seen; no pairs are made."""
    values = values or [c for c in series.columns if c not in (*by, time)]
    s = series.filter(F.col(time).isNotNull()).select(*by, time, F.struct(time, *values).alias("_row")).withColumn("_kind", F.lit(0))
    p = probes.withColumn("_probe", F.struct(*probes.columns)).select(*by, time, "_probe").withColumn("_kind", F.lit(1))
    both = s.unionByName(p, allowMissingColumns=True)
    seen = lambda *order: F.last("_row", ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    before, after = seen(time, "_kind", "_row"), seen(F.desc(time), "_kind", F.desc("_row"))
    out = both.withColumns({"_before": before, "_after": F.when(F.col(time).isNotNull(), after)}).filter("_kind = 1")
    names = [time, *values]
    return out.select("_probe.*", *[F.col(f"_before.{c}").alias(f"before_{c}") for c in names], *[F.col(f"_after.{c}").alias(f"after_{c}") for c in names])


def lerp_asof(probes: DataFrame, series: DataFrame, by: list[str], time: str = "ts", value: str = "value") -> DataFrame:
    """Probes with the value between their neighbours in time; before the first and after the last, the nearest one.
    time is a number, or a timestamp, counted in microseconds."""
    d = asof(probes, series, by, time, [value])
    num = lambda c: F.unix_micros(c).cast("double") if dict(series.dtypes)[time].startswith("timestamp") else F.col(c).cast("double")
    share = F.coalesce(F.try_divide(num(time) - num(f"before_{time}"), num(f"after_{time}") - num(f"before_{time}")), F.lit(0.0))
    a, b = F.col(f"before_{value}"), F.col(f"after_{value}")
    return d.select(*probes.columns, F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + (b - a) * share).alias(value))


def interpolate_states(a: DataFrame, b: DataFrame, t: float, id_col: str = "id") -> DataFrame:
    """id, x, y, z, opacity: nodes of both states part of the way, those of the first fading out, of the second in."""
    l = a.select(id_col, *[F.col(c).alias("a" + c) for c in "xyz"], F.lit(True).alias("_a"))
    r = b.select(id_col, *[F.col(c).alias("b" + c) for c in "xyz"], F.lit(True).alias("_b"))
    d = l.join(r, id_col, "full_outer")
    at = [F.when(F.col("_a").isNull(), F.col("b" + c)).when(F.col("_b").isNull(), F.col("a" + c)).otherwise(F.col("a" + c) + (F.col("b" + c) - F.col("a" + c)) * t).alias(c) for c in "xyz"]
    return d.select(id_col, *at, F.when(F.col("_b").isNull(), 1.0 - t).when(F.col("_a").isNull(), F.lit(t)).otherwise(1.0).alias("opacity"))


def compare_periods(a: DataFrame, b: DataFrame, id_col: str = "id", moved: float = 0.1) -> DataFrame:
    """id, change: added, removed, or changed (further than moved from where it was). One full outer join."""
    l = a.select(id_col, *[F.col(c).alias("a" + c) for c in "xyz"], F.lit(True).alias("_a"))
    r = b.select(id_col, *[F.col(c).alias("b" + c) for c in "xyz"], F.lit(True).alias("_b"))
    far = distance([F.col("a" + c) for c in "xyz"], [F.col("b" + c) for c in "xyz"]) > moved
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(far, "changed")
    return l.join(r, id_col, "full_outer").select(id_col, change.alias("change")).filter("change is not null")


def next_event(df: DataFrame, at, time: str = "ts", backwards: bool = False) -> DataFrame:
    """One row: the nearest time strictly after at, or before it."""
    own = F.col(time) < F.lit(at) if backwards else F.col(time) > F.lit(at)
    return df.filter(own).agg((F.max if backwards else F.min)(time).alias(time))


def time_buckets(df: DataFrame, width_ms: int, time_ms: str = "ts_ms", group: str = "wing_id") -> DataFrame:
    """bucket (its start), count, and by: how many of each group, as a map."""
    bucket = (F.floor(F.col(time_ms) / width_ms) * width_ms).alias("bucket")
    each = df.groupBy(bucket, F.coalesce(F.col(group).cast("string"), F.lit("unknown")).alias("g")).agg(F.count("*").alias("n"))
    return each.groupBy("bucket").agg(F.sum("n").alias("count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("g", "n")))).alias("by"))


def links(df: DataFrame, by: list[str], time: str = "ts", id_col: str = "id") -> DataFrame:
    """Each record with the ids before and after it in its series."""
    w = W.partitionBy(*by).orderBy(time, id_col)
    return df.withColumns({"before": F.lag(id_col).over(w), "after": F.lead(id_col).over(w)})


def replay(spark, series: DataFrame, start: float, stop: float, step: float, by: list[str], time: str = "ts", value: str = "value") -> DataFrame:
    """The series' interpolated values at even times from start to stop: as many rows as there are series times steps."""
    n = int((stop - start) // step) + 1
    probes = series.select(*by).distinct().crossJoin(F.broadcast(spark.range(n).select((F.lit(start) + F.col("id") * step).cast(dict(series.dtypes)[time]).alias(time))))
    return lerp_asof(probes, series, by, time, value)


def fixations(gaze: DataFrame, by: list[str], time_ms: str = "ts_ms", window_ms: int = 100, spread: float = 2.0) -> DataFrame:
    """Samples whose trailing window spans less than spread degrees in both angles, with the window's centre."""
    w = W.partitionBy(*by).orderBy(time_ms).rangeBetween(-window_ms, 0)
    span = F.greatest(F.max("yaw").over(w) - F.min("yaw").over(w), F.max("pitch").over(w) - F.min("pitch").over(w))
    return gaze.withColumns({"span": span, "center_yaw": F.avg("yaw").over(w), "center_pitch": F.avg("pitch").over(w)}).filter(F.col("span") < spread)


def uncertainty_field(series: DataFrame, by: list[str], center, window: float, samples: int = 10, seed: int = 42, time: str = "ts", value: str = "value") -> DataFrame:
    """by, sample, time, value, probability: the series at samples times within window (seconds, or units of a numeric
    time) of center, drawn evenly by the seed alone and alike for all series, each as likely as it is near to the center
    (1 - |offset| / window). All samples of all series are looked up in one as-of pass; between rows the value is the
    line's. A series without rows of that time has none; null times and values count for nothing."""
    spark = series.sparkSession
    kind = dict(series.dtypes)[time]
    draw = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), F.col("id"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    at = spark.range(samples).select((F.col("id") + 1).alias("sample"), ((draw - 0.5) * 2 * window).alias("_offset"))
    middle = F.lit(center).cast(kind)
    moved = F.timestamp_micros(F.unix_micros(middle.cast("timestamp")) + F.round(F.col("_offset") * 1e6).cast("long")).cast(kind) if kind.startswith("timestamp") else (middle + F.col("_offset")).cast(kind)
    at = at.select("sample", moved.alias(time), (1 - F.abs("_offset") / window).alias("probability"))
    sound = series.filter(F.col(value).isNotNull())
    probes = sound.select(*by).distinct().join(F.broadcast(at), F.lit(True))
    return lerp_asof(probes, sound.select(*by, time, value), by, time, value).select(*by, "sample", time, value, "probability").filter(F.col(value).isNotNull())


def expected_value(field: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """by, expected, spread: the mean of an uncertainty field by probability, and the deviation from it."""
    p, v = F.col("probability"), F.col(value).cast("double")
    sums = field.groupBy(*by).agg(F.sum(p).alias("_p"), F.sum(p * v).alias("_pv"), F.sum(p * v * v).alias("_pvv"))
    mean = F.try_divide("_pv", "_p")
    return sums.select(*by, mean.alias("expected"), F.sqrt(F.greatest(F.lit(0.0), F.try_divide("_pvv", "_p") - mean * mean)).alias("spread"))


def snapshot_stats(df: DataFrame, time: str = "ts", node: str = "id") -> DataFrame:
    return df.agg(F.count_distinct(time).alias("snapshots"), F.count_distinct(node).alias("nodes"), F.min(time).alias("first"), F.max(time).alias("last"))


def progress(x, start, end):
    return F.coalesce(F.try_divide(x - start, end - start), F.lit(0.0))
