"""Stored records that can be searched by place and by time.

Records are written in order of a space-filling curve through x, y, z and time, so that what is near in all four stands in
the same files. A search names the coarse cells of the curve that it touches, which are folders and prune the listing of
files, and bounds on the columns, which Parquet's statistics turn into row groups and pages that are not read."""

from __future__ import annotations

import json
import math
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from luminal.functions.vectors import distance
from luminal.operators.common import AXES, cut, ordinal

BITS = 15  # of each axis in the key; four axes make 60 bits
COARSE = 2  # of each axis in a folder's name: at most 256 folders, and one for rows without a place


def _micros(df: DataFrame, time: str) -> Column:
    """time as a double: microseconds of a timestamp, else the number itself."""
    kind = dict(df.dtypes)[time]
    c = F.col(time)
    return F.unix_micros(c.cast("timestamp")).cast("double") if kind in ("date", "timestamp", "timestamp_ntz") else c.cast("double")


def _sound(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == math.inf), None).otherwise(c)


def interleaved(df: DataFrame, steps: list[str], bits: int, name: str) -> DataFrame:
    """df with name, a Z-order key: a bit of each of the columns steps (whole numbers of bits bits) in turn, the highest
    first; null if one of them is. The bits of a step move apart by halves, each half a column of its own: bit by bit in
    one expression, the method that Spark generates is too long for the JVM to compile, and every row is interpreted."""
    n, width = len(steps), 1 << (bits - 1).bit_length()
    parts = {f"_part{i}": F.col(s).cast("long") for i, s in enumerate(steps)}
    out = df.withColumns(parts)
    while width > 1:
        width //= 2
        mask = F.lit(sum(1 << (b // width * width * n + b % width) for b in range(bits))).cast("long")
        out = out.withColumns({p: F.col(p).bitwiseOR(F.shiftleft(F.col(p), width * (n - 1))).bitwiseAND(mask) for p in parts})
    return out.withColumn(name, reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.col(p), n - 1 - i) for i, p in enumerate(parts)])).drop(*parts)


def store(df: DataFrame, path: str, time: str = "ts", id_col: str = "id", files: int | None = None) -> Archive:
    """Writes df (x, y, z, time and any other columns) to path for searches. files: how many, by default as many as
    there are shuffle partitions. Rows that lack a place or a time, or whose place is not finite, are kept apart; a
    search that does not ask for what they lack finds them too. The columns _cell, _key, _step* and _part* are the archive's own."""
    spark = df.sparkSession
    values = [_sound(F.col(a).cast("double")) for a in AXES] + [_micros(df, time)]
    bounds = df.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(values) for f, n in ((F.min, "low"), (F.max, "high"))])
    bounds = cut(bounds, "archive-bounds")
    row = bounds.first().asDict()
    steps = {}
    for i, v in enumerate(values):
        low, high = row[f"low{i}"], row[f"high{i}"]
        width = (high - low) / (1 << BITS) if low is not None and high > low else 1.0
        steps[f"_step{i}"] = F.when(v.isNotNull(), F.least(F.lit((1 << BITS) - 1), F.floor((v - F.lit(low or 0.0)) / width)))
    rows = interleaved(df.withColumns(steps), list(steps), BITS, "_key").drop(*steps).withColumn("_key", F.coalesce("_key", F.lit(-1).cast("long")))
    rows = rows.withColumn("_cell", F.shiftright("_key", 4 * (BITS - COARSE)).cast("int"))
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    # ties of the key are dealt by id, so that equal places fill several files
    rows.repartitionByRange(n, "_key", id_col).sortWithinPartitions("_cell", "_key").write.partitionBy("_cell").parquet(f"{path}/rows")
    bounds.withColumn("schema", F.lit(rows.schema.json())).write.parquet(f"{path}/bounds")
    return Archive(spark, path, time, id_col)


class Archive:
    """Searches over what store has written. Every search filters exactly; curve and bounds only save reading."""

    def __init__(self, spark: SparkSession, path: str, time: str = "ts", id_col: str = "id"):
        self.spark, self.time, self.id_col = spark, time, id_col
        row = spark.read.parquet(f"{path}/bounds").first().asDict()
        self.rows = spark.read.schema(StructType.fromJson(json.loads(row["schema"]))).parquet(f"{path}/rows")
        self.bounds = [(row[f"low{i}"], row[f"high{i}"]) for i in range(4)]
        self.number = _micros(self.rows, time)

    def _cells(self, box: list[tuple[float | None, float | None]]) -> list[int]:
        """The folders that a box in x, y, z and time touches; what has no place is in the one named -1."""
        sides = []
        for (low, high), (a, b) in zip(self.bounds, box, strict=True):
            width = (high - low) / (1 << BITS) if low is not None and high > low else 1.0
            step = lambda v: min((1 << BITS) - 1, max(0, math.floor((v - (low or 0.0)) / width))) >> (BITS - COARSE)  # noqa: B023, E731
            inside = low is None or (b is None or b >= low) and (a is None or a <= high)
            sides.append(range(0 if a is None else step(a), (1 << COARSE if b is None else step(b) + 1)) if inside else range(0))
        code = lambda at: sum(((c >> b) & 1) << (4 * b + 3 - i) for i, c in enumerate(at) for b in range(COARSE))
        return sorted(code(at) for at in product(*sides)) + [-1]

    def _within(self, box: list[tuple[float | None, float | None]]) -> DataFrame:
        rows = self.rows.filter(F.col("_cell").isin(self._cells(box)))
        for axis, (a, b) in zip(AXES, box[:3], strict=True):
            for edge, keep in ((a, lambda c, v: c >= v), (b, lambda c, v: c <= v)):
                if edge is not None:
                    rows = rows.filter(keep(F.col(axis), F.lit(float(edge))))
        return rows

    def _from_to(self, rows: DataFrame, start, stop) -> DataFrame:
        return rows.filter((F.col(self.time) >= F.lit(start).cast(self._kind)) & (F.col(self.time) <= F.lit(stop).cast(self._kind)))

    @property
    def _kind(self) -> str:
        return dict(self.rows.dtypes)[self.time]

    def _as_number(self, at) -> float:
        one = self.spark.range(1).select(F.lit(at).cast(self._kind).alias(self.time))
        return one.select(_micros(one, self.time).alias("v")).first().v

    def _out(self, rows: DataFrame) -> DataFrame:
        return rows.drop("_cell", "_key")

    def in_volume(self, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
        """Records in a box, its faces included."""
        return self._out(self._within([*zip(low, high, strict=True), (None, None)]))

    def near(self, at: tuple[float, float, float], radius: float) -> DataFrame:
        """Records at most radius from a place, with their distance."""
        d = distance([F.col(a) for a in AXES], [F.lit(float(v)) for v in at])
        rows = self._within([*((v - radius, v + radius) for v in at), (None, None)])
        return self._out(rows.withColumn("distance", d).filter(F.col("distance") <= radius))

    def in_time(self, start, stop) -> DataFrame:
        """Records from start to stop, both included."""
        box = [(None, None)] * 3 + [(self._as_number(start), self._as_number(stop))]
        return self._out(self._from_to(self._within(box), start, stop))

    def nearest_in_time(self, at) -> DataFrame:
        """The record nearest in time, one row (ties: the earlier, then the smallest id); no row if none has a time.
        Looks within a window about at that is doubled until something is in it."""
        center = self._as_number(at)
        low, high = self.bounds[3]
        span = max(high - low, abs(center - low), abs(center - high), 1.0) if low is not None else 1.0
        away = F.abs(self.number - F.lit(center))
        width = span / (1 << BITS)
        while True:
            rows = self._within([(None, None)] * 3 + [(center - width, center + width)])
            rows = self._in_numbers(rows, center - width, center + width)
            found = rows.withColumn("_away", away).filter(F.col("_away") <= width).orderBy("_away", self.time, self.id_col).limit(1)
            if width >= 2 * span or not found.isEmpty():
                return self._out(found.drop("_away"))
            width *= 2

    def _in_numbers(self, rows: DataFrame, start: float, stop: float) -> DataFrame:
        """rows with a bound on the time column itself, which statistics know; a microsecond or a unit more on each side."""
        if self._kind in ("date", "timestamp", "timestamp_ntz"):
            edge = lambda v: F.timestamp_micros(F.lit(int(min(max(v, -(2.0**62)), 2.0**62)))).cast(self._kind)
            day = 86_400_000_000 if self._kind == "date" else 1
            return rows.filter((F.col(self.time) >= edge(start - day)) & (F.col(self.time) <= edge(stop + day)))
        return rows.filter((F.col(self.time) >= start) & (F.col(self.time) <= stop))

    def trail(self, start, stop) -> DataFrame:
        """Records from start to stop in order of time, then id: their place from 0, the id after each, and the way to it."""
        rows = cut(ordinal(self.in_time(start, stop), self.time, self.id_col, name="place"), "trail")
        after = rows.select((F.col("place") - 1).alias("place"), F.col(self.id_col).alias("next_id"), *[F.col(a).alias(f"_{a}") for a in AXES])
        way = distance([F.col(a) for a in AXES], [F.col(f"_{a}") for a in AXES])
        return rows.join(after, "place", "left").withColumn("way", way).drop(*[f"_{a}" for a in AXES])

    def matching(self, text: str, *columns: str) -> DataFrame:
        """Records with text, whatever its case, in one of the columns."""
        found = reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c)), F.lit(text.lower())) for c in columns])
        return self._out(self.rows.filter(F.coalesce(found, F.lit(False))))

    def stats(self) -> DataFrame:
        """One row: how many records, from when to when."""
        return self.rows.agg(F.count("*").alias("records"), F.min(self.time).alias("first"), F.max(self.time).alias("last"))
