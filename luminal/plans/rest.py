"""Crystals, distance fields, orbits, mapper edges and engine state."""

from __future__ import annotations

from pyspark.sql import functions as F

from luminal.api import Engine
from luminal.functions import astro
from luminal.functions.dsl import compile_transform
from luminal.operators import aggregates, layouts, palace, spatial
from luminal.plans.book import query, r6
from luminal.plans.joins import D3, POINTS, points
from luminal.plans.stored import folder

NOW = 883_612_800_000  # 1998-01-01 in ms
WINGS = ["projects", "research", "conversations", "ideas", "tasks", "other"]
DRAWERS = f"""d AS (SELECT o_orderkey AS id, {WINGS}[o_orderkey % 6 + 1] AS wing, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS room, o_orderstatus AS content, epoch_ms(o_orderdate::TIMESTAMP) AS made,
    [(o_custkey % 21 - 10) / 10.0::DOUBLE, (o_orderkey % 19 - 9) / 9.0::DOUBLE, (o_orderkey % 7 - 3) / 3.0::DOUBLE] AS v FROM orders)"""


def drawers(orders):
    k = F.col("o_orderkey")
    part = lambda c, n, m: (c % n - m) / F.lit(float(m))
    return orders.select(
        k.alias("drawer_id"), F.get(F.array(*map(F.lit, WINGS)), (k % 6).cast("int")).alias("wing_id"), F.when(k % 4 > 0, F.col("o_orderpriority")).alias("room_id"), F.col("o_orderstatus").alias("content"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_at"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("modified_at"), F.array(part(F.col("o_custkey"), 21, 10), part(k, 19, 9), part(k, 7, 3)).alias("embedding"),
    )


@query("orders", sql=f"""
    WITH {DRAWERS} SELECT id AS drawer_id, CASE wing WHEN 'research' THEN 'dodecahedron' WHEN 'conversations' THEN 'icosahedron' WHEN 'ideas' THEN 'sphere' WHEN 'tasks' THEN 'box' ELSE 'octahedron' END AS geometry,
      wing || coalesce('/' || room, '') AS tags, content, made AS timestamp, round(v[1], 6) AS v1, {NOW} - made < 86400000 AS pulse,
      'rgb(' || floor((v[1] + 1) * 127.5)::INT || ', ' || floor((v[2] + 1) * 127.5)::INT || ', ' || floor((v[3] + 1) * 127.5)::INT || ')' AS color FROM d""")
def palace_crystals(orders):
    c = palace.crystals(drawers(orders), NOW)
    return c.select("drawer_id", "geometry", F.array_join("tags", "/").alias("tags"), "content", "timestamp", F.round(F.get("vector", 0), 6).alias("v1"), "pulse", "color")


@query("embeddings", sql=f"""
    WITH p AS (SELECT p.*, CASE WHEN id % 3 > 0 THEN embedding[1:8] END AS v FROM {POINTS} p JOIN embeddings e ON e.vec_id = p.id), a AS (SELECT * FROM p WHERE id = 1), d AS (SELECT b.id, {D3} AS d, a.v AS v1, b.v AS v2 FROM a, p b WHERE b.id <> 1),
    s AS (SELECT id, d, CASE WHEN v1 IS NOT NULL AND v2 IS NOT NULL THEN list_dot_product(v1::DOUBLE[], v2::DOUBLE[]) / (sqrt(list_dot_product(v1::DOUBLE[], v1::DOUBLE[])) * sqrt(list_dot_product(v2::DOUBLE[], v2::DOUBLE[]))) ELSE greatest(0, 1 - d / 0.5) END AS s FROM d WHERE d <= 0.5)
    SELECT id, round(d, 6) AS distance, round(s, 6) + 0.0 AS similarity, round(0.3 + s * 0.5, 6) AS opacity, round(0.02 + s * 0.08, 6) AS width FROM s ORDER BY s DESC, id LIMIT 50""")
def distance_field(embeddings):
    p = points(embeddings).join(embeddings.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 > 0, F.slice("embedding", 1, 8)).alias("embedding")), "id")
    return spatial.field_connections(p, 1, 0.5, 50).select("id", *[r6(c).alias(c) for c in ("distance", "similarity", "opacity", "width")])


PLANETS = ", ".join(f"('{n}', {a}::DOUBLE, {e}::DOUBLE, {p}::DOUBLE, {s}::DOUBLE)" for n, (a, e, p, s, _) in astro.PLANETS.items())


@query("supplier", sql=f"""
    WITH p AS (SELECT s_suppkey, planet, a, e, size, 2 * pi() * (s_suppkey / 7.0::DOUBLE) / period % (2 * pi()) AS m FROM supplier, (VALUES {PLANETS}) t(planet, a, e, period, size)),
    b AS (SELECT *, list_reduce([m, 0.0, 0.0, 0.0, 0.0, 0.0], lambda x, y: m + e * sin(x)) AS big FROM p)
    SELECT s_suppkey, planet, size, round(a * (1 - e * cos(big)), 5) AS distance, round(a * (1 - e * cos(big)) * cos(2 * atan2(sqrt(1 + e) * sin(big / 2), sqrt(1 - e) * cos(big / 2))), 5) + 0.0 AS x FROM b""")
def solar_system(supplier):
    d = supplier.select("s_suppkey", F.explode(astro.solar_system(F.col("s_suppkey") / 7.0)).alias("p"))
    return d.select("s_suppkey", "p.planet", "p.size", r6("p.distance", 5).alias("distance"), r6("p.x", 5).alias("x"))


@query("customer", sql="""
    WITH o AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 30 = 0 THEN 1.5 ELSE c_custkey % 30 / 10.0 END::DOUBLE AS a, ('0x' || substr(md5('42/' || c_custkey || '/0'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u, ('0x' || substr(md5('42/' || c_custkey || '/1'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS w FROM customer),
    d AS (SELECT k, a, 0.3 + u * 0.4 AS e, radians((w - 0.5) * 30) AS i, day::INT AS time, (day + k % 100) * (2 * pi()) / (pow(a, 1.5) * 365.25) % (2 * pi()) AS m FROM o, range(0, 365, 10) r(day)),
    b AS (SELECT *, list_reduce([m, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], lambda x, y: m + e * sin(x)) AS big FROM d)
    SELECT k AS c_custkey, time, round(a * (cos(big) - e), 4) + 0.0 AS x, round(a * sqrt(1 - e * e) * sin(big) * cos(i), 4) + 0.0 AS y, round(a * sqrt(1 - e * e) * sin(big) * sin(i), 4) + 0.0 AS z FROM b""")
def neo_trajectories(customer):
    k = F.col("c_custkey")
    d = astro.trajectories(customer.select("c_custkey"), (k % 30 / 10.0).cast("double"), k, (k % 100).cast("double"))
    return d.select("c_custkey", "time", *[r6(a, 4).alias(a) for a in "xyz"])


@query("embeddings", sql="""
    WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, label FROM embeddings), r AS (SELECT min(x) AS lo, max(x) AS hi FROM p),
    m AS (SELECT DISTINCT id, i AS interval, label AS cluster FROM p, r, range(4) g(i) WHERE x >= lo + (hi - lo) / 4 * (i - 0.25) AND x <= lo + (hi - lo) / 4 * (i + 1.25)),
    g AS (SELECT interval, cluster, count(*) AS size FROM m GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY interval ORDER BY cluster) - 1 AS k FROM g),
    e AS (SELECT a.interval AS ai, a.cluster AS ac, b.interval AS bi, b.cluster AS bc, count(*) AS shared FROM m a JOIN m b ON a.id = b.id AND a.interval < b.interval GROUP BY ALL)
    SELECT ai || '/' || ac AS source, bi || '/' || bc AS target, shared, ((ai + bi) * 2.0 / 2)::DOUBLE AS mx, (-(s.k + t.k) * 2.0 / 2)::DOUBLE AS my, round(sqrt(pow((bi - ai) * 2.0, 2) + pow((t.k - s.k) * 2.0, 2)), 6) AS length, round(shared / least(s.size, t.size), 6) AS strength
    FROM e JOIN n s ON s.interval = ai AND s.cluster = ac JOIN n t ON t.interval = bi AND t.cluster = bc""")
def mapper_edges(embeddings):
    p = points(embeddings).join(embeddings.select(F.col("vec_id").alias("id"), "label"), "id")
    _, e = aggregates.mapper_positions(*aggregates.mapper_graph(p, "x", 4, 0.25, "label"))
    return e.select("source", "target", "shared", "mx", r6("my").alias("my"), r6("length").alias("length"), r6("strength").alias("strength"))


@query("customer", sql="SELECT c_custkey, ((row_number() OVER (ORDER BY c_custkey) - 1) % 3 - 1) * 4.0::DOUBLE AS x, -((row_number() OVER (ORDER BY c_custkey) - 1) // 3) * 4.0::DOUBLE + 0.0 AS z FROM customer")
def layout_trading_floor(customer):
    return layouts.calculate(customer.select("c_custkey"), "trading-floor", ["c_custkey"]).select("c_custkey", "x", r6("z").alias("z"))


@query("orders", sql="SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus IN ('F', 'O') ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def table_query(orders):
    """The query form {table, where, order_by, limit} over an engine's datasets."""
    engine = Engine(orders.sparkSession)
    engine.datasets.load("query_orders", orders)
    return engine.query({"table": "query_orders", "where": {"o_totalprice": {"$gt": 100000}, "o_orderstatus": {"$in": ["F", "O"]}}, "order_by": ["-o_totalprice", "o_orderkey"], "limit": 20}).select("o_orderkey", "o_totalprice")


@query("customer", sql="SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 0 ELSE 180 END AS turn FROM customer")
def dsl_calculate(customer):
    turn = compile_transform({"$data": "c_acctbal", "$calculate": lambda v: F.when(v > 0, 0).otherwise(180)})
    return customer.select("c_custkey", turn.alias("turn"))


@query("customer", "nation", sql="SELECT c_custkey AS key, c_name AS name, 'customers' AS dataset FROM customer UNION ALL SELECT n_nationkey, n_name, 'nations' FROM nation")
def engine_state(customer, nation):
    """Two datasets exported and restored by another engine."""
    spark = customer.sparkSession
    one, path = Engine(spark), folder(spark, "state")
    one.datasets.load("state_customers", customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")))
    one.datasets.load("state_nations", nation.select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name")))
    one.export(path, layout="grid")
    two = Engine(spark)
    two.restore(path)
    return spark.table("state_customers").withColumn("dataset", F.lit("customers")).union(spark.table("state_nations").withColumn("dataset", F.lit("nations")))
