"""Streams over the event table, and windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from luminal.operators.common import shared_dir
from luminal.plans.book import ORACLE_SQL, QUERIES, query
from luminal.streaming import keyed, stateful

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@query("events", sql="SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(events):
    d = stateful.tumbling(events, "ts", "1 hour", ["event_type"])
    return d.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("events", sql="""
    SELECT strftime(w, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1""")
def sliding(events):
    return stateful.tumbling(events, "ts", "1 hour", [], slide="30 minutes").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("events", sql="""
    WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, g""")
def sessions(events):
    return stateful.sessions(events, "ts", "2 hours", ["user_id"]).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def _stream(spark, folder):
    """The event table as a stream of one file."""
    d = spark.readStream.schema(SCHEMA).format("parquet").option("pathGlobFilter", "events.parquet").load(folder)
    return d.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(spark, df, mode):
    out = f"{shared_dir(spark)}/luminal/stream-{uuid.uuid4().hex}"
    if mode == "update":
        q = df.writeStream.outputMode("update").option("checkpointLocation", out + "-log").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/b={i}")).trigger(availableNow=True).start()
    else:
        q = df.writeStream.outputMode(mode).option("checkpointLocation", out + "-log").format("parquet").option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def stream_alerts(spark, folder):
    """Edge-triggered alerts from a stream; the rows are those that alerts_edge gives from the table."""
    d = stateful.stream_alerts(_stream(spark, folder), [{"id": "high", "field": "value", "threshold": 60.0}], "user_id", "ts")
    return _run(spark, d, "append").select("key", "rule", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "event")


def stream_buffers(spark, folder):
    d = stateful.stream_buffer(_stream(spark, folder), "user_id", "ts", "value", 5)
    return _run(spark, d, "update").select("key", F.col("n").cast("long").alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


ORACLE_SQL["stream_alerts"] = """
    WITH e AS (SELECT user_id, ts, value > 60 AS o, coalesce(lag(value > 60) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS p FROM events WHERE value IS NOT NULL)
    SELECT user_id::VARCHAR AS key, 'high' AS rule, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN o THEN 'trigger' ELSE 'clear' END AS event FROM e WHERE o <> p"""
ORACLE_SQL["stream_buffers"] = """
    WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
    SELECT user_id::VARCHAR AS key, count(*) AS n, round(sum(value), 4) AS total FROM e WHERE r <= 5 GROUP BY user_id"""
QUERIES["stream_alerts"] = stream_alerts
QUERIES["stream_buffers"] = stream_buffers


def stream_fixations(spark, folder):
    """The samples of every user whose hour spans less than two degrees, from a stream."""
    # watermarks count milliseconds
    gaze = _stream(spark, folder).select("user_id", F.date_trunc("millisecond", "ts").alias("ts"), (F.col("value") % 4).alias("yaw"), (F.col("value") % 3).alias("pitch"))
    d = _run(spark, keyed.stream_fixations(gaze, "user_id", window_ms=3_600_000, delay="0 seconds"), "append")
    return d.select("key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.round("span", 5).alias("span"), (F.round("center_yaw", 5) + 0.0).alias("center_yaw"), (F.round("center_pitch", 5) + 0.0).alias("center_pitch"))


ORACLE_SQL["stream_fixations"] = """
    WITH g AS (SELECT user_id, ts, epoch_ms(ts) AS ms, value % 4 AS yaw, value % 3 AS pitch FROM events),
    w AS (SELECT *, greatest(max(yaw) OVER v - min(yaw) OVER v, max(pitch) OVER v - min(pitch) OVER v) AS span, avg(yaw) OVER v AS cy, avg(pitch) OVER v AS cp FROM g WINDOW v AS (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW))
    SELECT user_id::VARCHAR AS key, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(span, 5) AS span, round(cy, 5) + 0.0 AS center_yaw, round(cp, 5) + 0.0 AS center_pitch FROM w WHERE span < 2"""


def stream_buffer_answers(spark, folder):
    """The events of a user go into a buffer of 20, which is asked and cleared on the way."""
    e, k = _stream(spark, folder), F.col("event_id")
    none = lambda kind: F.lit(None).cast(kind)
    act = lambda i, op, start=None: F.struct((k * 4 + i).alias("at"), F.lit(op).alias("op"), (start if start is not None else none("timestamp")).alias("start"), (F.concat(F.lit(f"{op}-"), k.cast("string")) if op in ("range", "latest", "last") else none("string")).alias("ask"))
    acts = F.array_compact(F.array(act(0, "put"), F.when(k % 10 == 3, act(1, "range", F.col("ts") - F.expr("INTERVAL 3 DAY"))), F.when(k % 10 == 5, act(1, "latest")), F.when(k % 10 == 7, act(1, "last")), F.when(k % 40 == 1, act(2, "clear"))))
    rows = e.select(F.col("user_id").alias("key"), "ts", "value", F.explode(acts).alias("a")).select("key", "a.at", "a.op", "ts", "value", "a.start", F.col("ts").alias("stop"), F.lit(3.0).alias("count"), "a.ask")
    d = _run(spark, keyed.asked_buffer(rows, capacity=20), "append")
    return d.select("key", "ask", "n", F.round(F.aggregate("values", F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))), 4).alias("total"), F.array_max("ts").alias("newest"))


ORACLE_SQL["stream_buffer_answers"] = """
    WITH asks AS (SELECT user_id, event_id, event_id * 4 + 1 AS at, ts, CASE event_id % 10 WHEN 3 THEN 'range' WHEN 5 THEN 'latest' ELSE 'last' END AS op FROM events WHERE event_id % 10 IN (3, 5, 7)),
    since AS (SELECT a.*, coalesce((SELECT max(c.event_id * 4 + 2) FROM events c WHERE c.user_id = a.user_id AND c.event_id % 40 = 1 AND c.event_id * 4 + 2 < a.at), -1) AS start FROM asks a),
    points AS (SELECT s.*, p.ts AS pts, p.value, row_number() OVER (PARTITION BY s.event_id ORDER BY p.event_id DESC) AS r FROM since s JOIN events p ON p.user_id = s.user_id AND p.event_id * 4 > s.start AND p.event_id * 4 < s.at),
    found AS (SELECT * FROM points WHERE r <= CASE op WHEN 'latest' THEN 1 WHEN 'last' THEN 3 ELSE 20 END AND (op <> 'range' OR pts BETWEEN ts - INTERVAL 3 DAY AND ts))
    SELECT a.user_id::VARCHAR AS key, a.op || '-' || a.event_id AS ask, count(f.r) AS n, round(coalesce(sum(f.value), 0), 4) AS total, max(epoch_us(f.pts)) AS newest FROM asks a LEFT JOIN found f ON f.event_id = a.event_id GROUP BY ALL"""


def stream_order_book(spark, folder):
    """A book for each event type: events give bids, asks and trades in turn."""
    e, k, v = _stream(spark, folder), F.col("event_id"), F.coalesce("value", F.lit(0.0))
    levels = lambda sign: F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.struct((v + sign * i * 0.5).alias("price"), (k % 10 + i).cast("double").alias("size")))
    rows = e.select(F.col("event_type").alias("symbol"), "ts", k.alias("seq"), F.when(k % 3 == 0, levels(-1)).alias("bids"), F.when(k % 3 == 1, levels(1)).alias("asks"), F.when(k % 3 == 2, v).alias("price"), F.when(k % 3 == 2, k.cast("double")).alias("size"))
    d = _run(spark, keyed.stream_book(rows, depth=5, keep=30, show=20), "update")
    side = lambda name: F.transform(name, lambda x, i: F.struct(F.lit(name).alias("part"), i.alias("place"), x["price"].alias("price"), x["size"].alias("size")))
    return d.select("symbol", F.explode(F.concat(side("bids"), side("asks"), side("trades"))).alias("r")).select("symbol", "r.part", "r.place", "r.price", "r.size")


ORACLE_SQL["stream_order_book"] = """
    WITH e AS (SELECT event_type AS symbol, ts, event_id, coalesce(value, 0) AS v FROM events),
    last AS (SELECT symbol, event_id % 3 AS side, arg_max((v, event_id), (ts, event_id)) AS l FROM e WHERE event_id % 3 < 2 GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY symbol) AS n FROM e WHERE event_id % 3 = 2)
    SELECT symbol, CASE side WHEN 0 THEN 'bids' ELSE 'asks' END AS part, i::INT AS place, l[1] + CASE side WHEN 0 THEN -0.5 ELSE 0.5 END::DOUBLE * i AS price, (l[2] % 10 + i)::DOUBLE AS size FROM last, range(5) x(i)
    UNION ALL SELECT symbol, 'trades', (least(n, 20) - r)::INT, v, event_id::DOUBLE FROM t WHERE r <= 20"""


def stream_receiver(spark, folder):
    """Messages of the orders' changes, some lost, some damaged, some twice, in any order: what the receiver makes of them."""
    from luminal.operators.diff import delta_messages
    from luminal.plans.stored import feed
    from luminal.sources.records import load_tables

    (orders,) = load_tables(spark, folder, "orders")
    changes = [d.select("id", "op", (F.col("id") * 4 + i).alias("seq")) for i, d in enumerate(feed(orders))]
    sent = delta_messages(changes[0].union(changes[1]).union(changes[2]).union(changes[3]), 20).withColumn("timestamp", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("sequence")))
    s = F.col("sequence")
    copies = sent.filter(s % 7 != 0).withColumn("checksum", F.when(s % 11 == 3, "none").otherwise(F.col("checksum"))).select(F.lit("orders").alias("channel"), "*", F.explode(F.array_repeat(F.lit(0), F.when(s % 4 == 1, 2).otherwise(1))).alias("copy")).drop("copy", "n")
    path = f"{shared_dir(spark)}/luminal/sent-{uuid.uuid4().hex}"
    copies.repartition(4, F.xxhash64("sequence", F.lit(1))).write.parquet(path)
    d = keyed.receive(spark.readStream.schema(copies.schema).parquet(path), patience_ms=0)
    return _run(spark, d, "append").select("kind", "sequence", "upto", "type", F.sha2("payload", 256).alias("checksum"))


ORACLE_SQL["stream_receiver"] = """
    WITH c AS (SELECT o_orderkey AS id, 'add' AS op, o_orderkey * 4 AS seq FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'update', o_orderkey * 4 + 1 FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0
        UNION ALL SELECT o_orderkey, 'delete', o_orderkey * 4 + 2 FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'add', o_orderkey * 4 + 3 FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 35 = 0),
    t AS (SELECT *, CASE op WHEN 'add' THEN 0 WHEN 'update' THEN 1 ELSE 2 END AS o FROM c), g AS (SELECT *, (row_number() OVER (PARTITION BY o ORDER BY seq) - 1) // 20 AS k FROM t),
    m AS (SELECT row_number() OVER (ORDER BY o, k) AS s, ['batch', 'update', 'delete'][o + 1] AS type, sha256('[' || string_agg('{"id":' || id || ',"op":"' || op || '","seq":' || seq || '}', ',' ORDER BY seq) || ']') AS checksum FROM g GROUP BY o, k),
    sound AS (SELECT * FROM m WHERE s % 7 <> 0 AND s % 11 <> 3), b AS (SELECT s, coalesce(lag(s) OVER (ORDER BY s), 0) AS before FROM sound)
    SELECT 'apply' AS kind, s AS sequence, s AS upto, type, checksum FROM sound UNION ALL SELECT 'repeat', s, s, type, NULL FROM sound WHERE s % 4 = 1
    UNION ALL SELECT 'damaged', s, s, type, NULL FROM m, range(2) c(i) WHERE s % 7 <> 0 AND s % 11 = 3 AND i < CASE WHEN s % 4 = 1 THEN 2 ELSE 1 END
    UNION ALL SELECT 'gap', before + 1, s - 1, NULL, NULL FROM b WHERE s > before + 1"""
QUERIES |= {f.__name__: f for f in (stream_fixations, stream_buffer_answers, stream_order_book, stream_receiver)}
