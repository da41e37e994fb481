"""Searches over stored records, change logs, delta messages and state kept on disk."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from luminal.operators.common import shared_dir
from luminal.operators.diff import delta_messages
from luminal.plans.book import query, r6
from luminal.sources.archive import store
from luminal.streaming.changelog import ChangeLog

MEMORIES = "(SELECT o_orderkey AS id, o_totalprice / 1000 AS x, (o_custkey % 500)::DOUBLE AS y, (o_orderkey % 97)::DOUBLE AS z, o_orderdate::TIMESTAMP AS ts, o_orderstatus AS label FROM orders)"
STAMP = "strftime(ts, '%Y-%m-%d') AS day"


def folder(spark, label: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/luminal/{label}-{uuid.uuid4().hex}"


def memories(orders):
    return orders.select(
        F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("x"), (F.col("o_custkey") % 500).cast("double").alias("y"), (F.col("o_orderkey") % 97).cast("double").alias("z"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderstatus").alias("label")
    )


def archive(orders):
    return store(memories(orders), folder(orders.sparkSession, "archive"))


@query("orders", sql=f"SELECT id, x, y, z FROM {MEMORIES} WHERE x BETWEEN 50 AND 150 AND y BETWEEN 10 AND 200 AND z BETWEEN 0 AND 48")
def search_volume(orders):
    return archive(orders).in_volume((50.0, 10.0, 0.0), (150.0, 200.0, 48.0)).select("id", "x", "y", "z")


@query("orders", sql=f"SELECT id, round(d, 6) AS distance FROM (SELECT id, sqrt((x - 100) * (x - 100) + (y - 100) * (y - 100) + (z - 50) * (z - 50)) AS d FROM {MEMORIES}) WHERE d <= 60")
def search_near(orders):
    return archive(orders).near((100.0, 100.0, 50.0), 60.0).select("id", r6("distance").alias("distance"))


@query("orders", sql=f"SELECT id, {STAMP} FROM {MEMORIES} WHERE ts BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1996-02-29'")
def search_time_range(orders):
    return archive(orders).in_time("1995-03-01 00:00:00", "1996-02-29 00:00:00").select("id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("orders", sql=f"SELECT id, {STAMP} FROM {MEMORIES} ORDER BY abs(epoch_us(ts) - epoch_us(TIMESTAMP '1995-06-17 13:00:00')), ts, id LIMIT 1")
def search_nearest_time(orders):
    return archive(orders).nearest_in_time("1995-06-17 13:00:00").select("id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("orders", sql=f"""
    WITH r AS (SELECT *, row_number() OVER w - 1 AS place, lead(id) OVER w AS next_id, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM {MEMORIES} WHERE ts BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1995-05-31' WINDOW w AS (ORDER BY ts, id))
    SELECT id, place, next_id, round(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y) + (nz - z) * (nz - z)), 6) AS way FROM r""")
def search_trail(orders):
    return archive(orders).trail("1995-03-01 00:00:00", "1995-05-31 00:00:00").select("id", "place", "next_id", r6("way").alias("way"))


FEED = """c AS (SELECT 1 AS batch, o_orderkey AS id, 'add' AS op, o_orderstatus AS status, o_custkey % 1000 AS value FROM orders WHERE o_orderkey % 3 <> 0
    UNION ALL SELECT 2, o_orderkey, 'update', 'U', o_orderkey % 100 FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0
    UNION ALL SELECT 3, o_orderkey, 'delete', NULL, NULL FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 3 <> 0
    UNION ALL SELECT 4, o_orderkey, 'add', o_orderstatus, o_custkey % 1000 FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 35 = 0),
    s AS (SELECT *, row_number() OVER (ORDER BY batch, id) AS seq FROM c)"""


def feed(orders):
    """Four batches of changes of the orders."""
    k, row = F.col("o_orderkey"), lambda op, status, value: [F.col("o_orderkey").alias("id"), F.lit(op).alias("op"), status.cast("string").alias("status"), value.cast("int").alias("value")]
    own = (F.col("o_orderstatus"), F.col("o_custkey") % 1000)
    return [
        orders.filter(k % 3 != 0).select(*row("add", *own)),
        orders.filter((k % 5 == 0) & (k % 3 != 0)).select(*row("update", F.lit("U"), k % 100)),
        orders.filter((k % 7 == 0) & (k % 3 != 0)).select(*row("delete", F.lit(None), F.lit(None))),
        orders.filter((k % 3 == 0) | (k % 35 == 0)).select(*row("add", *own)),
    ]


def logged(orders, share=None):
    log = ChangeLog(orders.sparkSession, folder(orders.sparkSession, "log"), share=share)
    for epoch, changes in enumerate(feed(orders)):
        for _ in range(2):  # the second time it is passed over
            log.append(changes, source="orders", epoch=epoch)
    return log


@query("orders", sql=f"WITH {FEED} SELECT id, status, value::INT AS value FROM s QUALIFY seq = max(seq) OVER (PARTITION BY id) AND op <> 'delete'")
def change_log_table(orders):
    """The table that a base and deltas stand for, after two compactions on the way."""
    return logged(orders, 0.5).table()


@query("orders", sql=f"WITH {FEED} SELECT seq, id, op, status, value::INT AS value FROM s WHERE seq > 100")
def change_log_since(orders):
    return logged(orders).since(100).select("seq", "id", "op", "status", "value")


@query("orders", sql=f"""
    WITH {FEED}, t AS (SELECT *, CASE op WHEN 'add' THEN 'batch' WHEN 'update' THEN 'update' ELSE 'delete' END AS type, CASE op WHEN 'add' THEN 0 WHEN 'update' THEN 1 ELSE 2 END AS o FROM s),
    g AS (SELECT *, (row_number() OVER (PARTITION BY o ORDER BY seq) - 1) // 100 AS k FROM t),
    j AS (SELECT *, '{{"seq":' || seq || ',"id":' || id || ',"op":"' || op || '"' || coalesce(',"status":"' || status || '"', '') || coalesce(',"value":' || value, '') || '}}' AS row FROM g),
    m AS (SELECT row_number() OVER (ORDER BY o, k) AS sequence, type, count(*) AS n, '[' || string_agg(row, ',' ORDER BY seq) || ']' AS payload FROM j GROUP BY o, k, type)
    SELECT sequence, type, n, payload, sha256(payload) AS checksum FROM m""")
def delta_payloads(orders):
    """Every message in full: numbers without gaps, 100 changes each, by type."""
    return delta_messages(logged(orders).since(0).select("seq", "id", "op", "status", "value")).drop("timestamp")
