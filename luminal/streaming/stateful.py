"""Streams: messages, edge-triggered alerts, bounded buffers, change feeds and windows.

Rows of a key are taken in order of event time within a micro-batch; what comes later than the watermark is dropped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from luminal.functions.predicates import condition
from luminal.streaming.changelog import ChangeLog

MESSAGE = "type string, data struct<id:string,value:double,timestamp:string>"


def messages(df: DataFrame, raw: str = "value", schema: str = MESSAGE) -> DataFrame:
    """Messages from JSON; those that cannot be read are dropped."""
    m = F.from_json(F.col(raw).cast("string"), schema, {"mode": "PERMISSIVE"})
    return df.withColumn("_m", m).filter("_m.type is not null").select("_m.*")


def rules_hold(df: DataFrame, rules: list[dict]) -> DataFrame:
    """A row for each record and rule (id, field, operator '>', threshold, severity 'warning') whose field is there, with
    whether it holds."""
    each = [
        F.when(F.col(r["field"]).isNotNull(), F.struct(F.lit(r.get("id", r["field"])).alias("rule"), F.lit(r.get("severity", "warning")).alias("severity"), condition(F.col(r["field"]), r.get("operator", ">"), r["threshold"]).alias("holds")))
        for r in rules
    ]
    return df.withColumn("_r", F.explode(F.array_compact(F.array(*each)))).select(*df.columns, "_r.*")


def stream_alerts(df: DataFrame, rules: list[dict], key: str, time: str, delay: str = "10 minutes", idle: float = 30 * 86400.0) -> DataFrame:
    """key, rule, severity, ts, event: trigger when a rule starts to hold for a key, clear when it ends to. Rows later than
    the watermark are dropped. A key without rows for idle seconds of event time is forgotten, and starts anew after.
    A key's rows of one micro-batch are sorted in memory, so the source's rate limit bounds them."""
    held = rules_hold(df.select(F.col(key).cast("string").alias("key"), F.col(time).alias("ts"), *[F.col(f) for f in dict.fromkeys(r["field"] for r in rules)]), rules)
    held = held.select("key", "rule", "severity", "ts", "holds").withWatermark("ts", delay)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        on = state.get[0] if state.exists else False
        rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
        before = rows["holds"].shift(fill_value=on)
        out = rows[rows["holds"] != before]
        state.update((bool(rows["holds"].iat[-1]),))
        state.setTimeoutTimestamp(max(int(rows["ts"].iat[-1].value // 1_000_000), state.getCurrentWatermarkMs()) + int(idle * 1000) + 1)
        if len(out):
            yield pd.DataFrame({"key": out["key"], "rule": out["rule"], "severity": out["severity"], "ts": out["ts"], "event": out["holds"].map({True: "trigger", False: "clear"})})

    return held.groupBy("key", "rule").applyInPandasWithState(step, "key string, rule string, severity string, ts timestamp, event string", "on boolean", "append", GroupStateTimeout.EventTimeTimeout)


def stream_buffer(df: DataFrame, key: str, time: str, value: str, capacity: int = 1000) -> DataFrame:
    """After each micro-batch, for each key that got rows: the last capacity (ts, value) in order of arrival, the rows of
    one micro-batch being in order of time."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(time).alias("ts"), F.col(value).cast("double").alias("value"))

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, values = (list(x) for x in state.get) if state.exists else ([], [])
        new = None
        for p in parts:
            new = (p if new is None else pd.concat([new, p])).sort_values("ts", kind="stable").tail(capacity)
        times, values = (times + [int(t.value // 1000) for t in new["ts"]])[-capacity:], (values + new["value"].tolist())[-capacity:]
        state.update((times, values))
        yield pd.DataFrame({"key": k[0], "n": len(times), "ts": [times], "values": [values]})

    return rows.groupBy("key").applyInPandasWithState(step, "key string, n int, ts array<long>, values array<double>", "ts array<long>, values array<double>", "update", GroupStateTimeout.NoTimeout)


def tumbling(df: DataFrame, time: str, width: str, by: list[str], delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """n and total of value in windows; in a batch as in a stream."""
    d = df.withWatermark(time, delay) if df.isStreaming else df
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return d.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(df: DataFrame, time: str, gap: str, by: list[str], delay: str = "10 minutes") -> DataFrame:
    d = df.withWatermark(time, delay) if df.isStreaming else df
    return d.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def deduplicated(df: DataFrame, keys: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def joined(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, delay: str = "10 minutes") -> DataFrame:
    """Rows of two streams (or tables) with equal key and times at most within apart."""
    l, r = left.withWatermark(left_time, delay), right.withColumnRenamed(key, "_key").withWatermark(right_time, delay)
    near = F.expr(f"`{right_time}` BETWEEN `{left_time}` - INTERVAL {within} AND `{left_time}` + INTERVAL {within}")
    return l.join(r, (F.col(key) == F.col("_key")) & near).drop("_key")


def publish(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, per_second: float | None = None, mode: str = "update"):
    """Each micro-batch to sink; at most per_second of them; in mode append for what only adds rows, such as alerts. Without a rate all that is there is taken and the query
    ends. A restarted query goes on from its checkpoint."""
    w = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode)
    return (w.trigger(processingTime=f"{int(1000 / per_second)} milliseconds") if per_second else w.trigger(availableNow=True)).start()


def apply_feed(path: str, id_col: str = "id") -> Callable[[DataFrame, int], None]:
    """A sink that keeps the table of a change log at path current: each micro-batch of changes (id, op, seq, columns) is
    written as a delta, and a batch that is run again changes nothing. changelog.ChangeLog(spark, path).table() reads it."""

    def sink(batch: DataFrame, epoch: int) -> None:
        ChangeLog(batch.sparkSession, path, id_col).append(batch, source="feed", epoch=epoch)

    return sink


def rate_market(spark: SparkSession, rows_per_second: int = 10, symbols: int = 5, seed: int = 42) -> DataFrame:
    """A made-up feed of relative price changes, from the rate source."""
    d = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    u = F.pmod(F.xxhash64("value", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    return d.select(F.col("timestamp").alias("ts"), F.concat(F.lit("S"), (F.col("value") % symbols).cast("string")).alias("symbol"), ((u - 0.5) * 0.02).alias("change"))


def rate_sensors(spark: SparkSession, rows_per_second: int = 10, sensors: int = 8, threshold: float = 80.0, seed: int = 42) -> DataFrame:
    from luminal.operators.mapping import sensor_status

    d = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    u = F.pmod(F.xxhash64("value", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53) * 100
    return d.select(F.col("timestamp").alias("ts"), (F.col("value") % sensors).alias("sensor"), u.alias("value"), sensor_status(u, threshold).alias("status"))
