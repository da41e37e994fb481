"""Layouts, constraints, meshes, molecules, forces."""

from __future__ import annotations

from pyspark.sql import functions as F

from luminal.operators import domains, layouts
from luminal.plans.book import query, r6
from luminal.plans.joins import D3, POINTS, points

G = "(pi() * (3 - sqrt(5)))"
C = "SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n, c_acctbal FROM customer"


def placed(df, digits=5):
    return df.select("id", *[r6(a, digits).alias(a) for a in "xyz"])


def customers(customer):
    return customer.select(F.col("c_custkey").alias("id"), "c_acctbal", "c_mktsegment", "c_nationkey")


def xyz(x: str, y: str, z: str, source: str = C) -> str:
    return f"SELECT id, round(({x})::DOUBLE, 5) + 0.0 AS x, round(({y})::DOUBLE, 5) + 0.0 AS y, round(({z})::DOUBLE, 5) + 0.0 AS z FROM ({source})"


@query("customer", sql=xyz("(i % ceil(sqrt(n)) - (ceil(sqrt(n)) - 1) / 2) * 3", "(floor(i / ceil(sqrt(n))) - floor((n - 1) / ceil(sqrt(n))) / 2) * -3", "0.0"))
def layout_grid(customer):
    return placed(layouts.calculate(customers(customer), "grid", ["id"]))


@query("customer", sql=xyz("5 * cos(2 * pi() * i / n)", "0.0", "5 * sin(2 * pi() * i / n)"))
def layout_radial(customer):
    return placed(layouts.calculate(customers(customer), "radial", ["id"]))


@query("customer", sql=xyz("i * 2.0 - (n - 1) * 1.0", "0.0", "0.0"))
def layout_timeline(customer):
    return placed(layouts.calculate(customers(customer), "timeline", ["id"]))


@query("customer", sql=xyz("5 * (1 - 0.3 * i / n) * cos(4 * pi() * i / n)", "i * 0.5", "5 * (1 - 0.3 * i / n) * sin(4 * pi() * i / n)"))
def layout_spiral(customer):
    return placed(layouts.calculate(customers(customer), "spiral", ["id"]))


Y = "(1 - i / greatest(1, n - 1)::DOUBLE * 2)"


@query("customer", sql=xyz(f"5 * sqrt(greatest(0.0, 1 - {Y} * {Y})) * cos(i * {G})", f"1.6 + 5 * {Y}", f"-3 + 5 * sqrt(greatest(0.0, 1 - {Y} * {Y})) * sin(i * {G})"))
def layout_sphere(customer):
    return placed(layouts.calculate_positions(customers(customer), "none", ["id"]))


@query("customer", sql=xyz("(i % 10 - 5) * 0.75", "1.6 + (i // 10 - 5) * 0.375", "-3.0"))
def layout_matrix(customer):
    return placed(layouts.calculate(customers(customer), "matrix", ["id"]))


@query("customer", sql="""
    WITH c AS (SELECT c_custkey AS id, c_mktsegment AS cat, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_mktsegment) AS k, min(c_custkey) OVER (PARTITION BY c_mktsegment) AS f FROM customer),
    d AS (SELECT *, dense_rank() OVER (ORDER BY f) - 1 AS c, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS m FROM c)
    SELECT id, round((c - m / 2.0) * 2 + i % ceil(sqrt(k)), 5) + 0.0 AS x, 1.6::DOUBLE AS y, round(-3 + floor(i / ceil(sqrt(k))), 5) + 0.0 AS z FROM d""")
def layout_categorical(customer):
    return placed(layouts.calculate(customers(customer), "categorical-grid", ["id"], category="c_mktsegment"))


@query("customer", sql="""
    WITH c AS (SELECT c_custkey AS id, radians(90 - (c_nationkey * 7 - 80)) AS p, radians(c_nationkey * 14 - 170 + 180) AS t FROM customer)
    SELECT id, round(3 * sin(p) * cos(t), 5) + 0.0 AS x, round(1.6 + 3 * cos(p), 5) + 0.0 AS y, round(-3 + 3 * sin(p) * sin(t), 5) + 0.0 AS z FROM c""")
def layout_globe(customer):
    d = customers(customer).withColumns({"lat": (F.col("c_nationkey") * 7 - 80).cast("double"), "lng": (F.col("c_nationkey") * 14 - 170).cast("double")})
    return placed(layouts.calculate(d, "globe", ["id"]))


@query("events", sql=f"""
    WITH e AS (SELECT event_id AS id, (epoch_us(ts) // 1000) AS t, row_number() OVER (ORDER BY (epoch_us(ts) // 1000), event_id) - 1 AS i, min((epoch_us(ts) // 1000)) OVER () AS t0 FROM events)
    SELECT id, round((2 + i * 0.15) * cos(i * {G}), 4) + 0.0 AS x, round(1.6 + (t - t0) / 1e6, 6) + 0.0 AS y, round(-3 + (2 + i * 0.15) * sin(i * {G}), 4) + 0.0 AS z FROM e""")
def layout_spiral_timeline(events):
    d = events.select(F.col("event_id").alias("id"), F.unix_millis("ts").alias("timestamp"))
    return layouts.calculate_positions(d, "timeline-spiral", ["id"]).select("id", r6("x", 4).alias("x"), r6("y").alias("y"), r6("z", 4).alias("z"))


@query("events", sql="""
    WITH e AS (SELECT event_id AS id, (epoch_us(ts) // 1000) AS t, row_number() OVER (ORDER BY (epoch_us(ts) // 1000), event_id) - 1 AS i, min((epoch_us(ts) // 1000)) OVER () AS a, max((epoch_us(ts) // 1000)) OVER () AS b FROM events)
    SELECT id, round(((t - a) / (b - a)::DOUBLE - 0.5) * 10, 7) + 0.0 AS x, round(1.6 + sin(i * 0.5) * 0.5, 7) + 0.0 AS y FROM e""")
def layout_linear_timeline(events):
    d = events.select(F.col("event_id").alias("id"), F.unix_millis("ts").alias("timestamp"))
    return layouts.calculate(d, "linear-timeline", ["id"]).select("id", r6("x", 7).alias("x"), r6("y", 7).alias("y"))


@query("embeddings", sql="SELECT vec_id AS id, round(embedding[1]::DOUBLE * 5, 5) + 0.0 AS x, round(1.6 + embedding[2]::DOUBLE * 5, 5) + 0.0 AS y, round(-3 + embedding[3]::DOUBLE * 5, 5) + 0.0 AS z FROM embeddings")
def layout_embedding(embeddings):
    return placed(layouts.calculate(embeddings.withColumnRenamed("vec_id", "id"), "embedding", ["id"]))


@query("orders", sql="""
    WITH o AS (SELECT o_orderkey AS id, year(o_orderdate) AS y, count(*) OVER () AS n, min(year(o_orderdate)) OVER () AS a, max(year(o_orderdate)) OVER () AS b FROM orders), s AS (SELECT id, n, (y - a) / greatest(1, b - a)::DOUBLE AS t FROM o)
    SELECT id, round((5 + t * 0.5 * n) * cos(10 * pi() * t), 3) + 0.0 AS x, round(t * 2 * n, 3) + 0.0 AS y, round((5 + t * 0.5 * n) * sin(10 * pi() * t), 3) + 0.0 AS z FROM s""")
def layout_history(orders):
    return placed(layouts.calculate(orders.select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year")), "history-spiral", ["id"]), 3)


@query("customer", sql=f"""
    WITH d AS (SELECT c_custkey AS id, c_nationkey AS wing, c_mktsegment AS room, row_number() OVER (ORDER BY c_custkey) - 1 AS o FROM customer),
    e AS (SELECT *, min(o) OVER (PARTITION BY wing) AS wf, min(o) OVER (PARTITION BY wing, room) AS rf, row_number() OVER (PARTITION BY wing, room ORDER BY o) - 1 AS i, count(*) OVER (PARTITION BY wing, room) AS k FROM d),
    f AS (SELECT *, dense_rank() OVER (ORDER BY wf) - 1 AS w, (SELECT count(DISTINCT wing) FROM d) AS ws, dense_rank() OVER (PARTITION BY wing ORDER BY rf) - 1 AS r, count(DISTINCT room) OVER (PARTITION BY wing) AS rs FROM e),
    g AS (SELECT *, 1 - w / greatest(1, ws - 1)::DOUBLE * 2 AS y FROM f),
    h AS (SELECT *, sqrt(greatest(0.0, 1 - y * y)) AS flat, r / rs * 2 * pi() AS turn, i / k * 2 * pi() AS a, ceil(sqrt(k)) AS cols FROM g)
    SELECT id, round(cos(w * {G}) * flat * 10 + cos(turn) * 3 + CASE WHEN k <= 10 THEN cos(a) * 0.5 ELSE (i % cols - cols / 2) * 0.45 END, 5) + 0.0 AS x,
      round(y * 10 + CASE WHEN k <= 10 THEN sin(i / 3) * 0.2 ELSE sin(i * 0.1) * 0.3 END, 5) + 0.0 AS y,
      round(sin(w * {G}) * flat * 10 + sin(turn) * 3 + CASE WHEN k <= 10 THEN sin(a) * 0.5 ELSE (floor(i / cols) - ceil(k / cols) / 2) * 0.45 END, 5) + 0.0 AS z FROM h""")
def layout_palace(customer):
    return placed(layouts.calculate(customers(customer), "palace", ["id"], wing="c_nationkey", room="c_mktsegment"))


@query("customer")
def layout_scatter(customer):
    return placed(layouts.calculate(customers(customer), "scatter", ["id"]))


@query("customer", sql="""
    WITH c AS (SELECT c_custkey AS id, c_acctbal / 1000 AS x, c_custkey % 7 - 3.0 AS y FROM customer), a AS (SELECT id, CASE WHEN id IN (1,2,3) THEN x + (10 - x) * 0.05 ELSE x END AS x, CASE WHEN id IN (1,2,3) THEN y - y * 0.05 ELSE y END AS y FROM c)
    SELECT id, round(x, 5) + 0.0 AS x, round(CASE WHEN y < -1 THEN -1 ELSE y END::DOUBLE, 5) + 0.0 AS y, 0.0::DOUBLE AS z FROM a""")
def constraints(customer):
    d = customer.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("x"), (F.col("c_custkey") % 7 - 3.0).alias("y"), F.lit(0.0).alias("z"))
    return placed(layouts.apply_constraints(d, [{"type": "attract-to", "ids": [1, 2, 3], "target": (10, 0, 0), "strength": 0.5}, {"type": "plane", "normal": (0, 1, 0), "offset": -1}]))


@query("embeddings", sql=f"SELECT a.id, round(coalesce(sum((a.x - b.x) / {D3} * 0.01 / {D3}), 0), 3) + 0.0 AS fx FROM {POINTS} a LEFT JOIN {POINTS} b ON a.id <> b.id AND {D3} <= 0.08 AND {D3} > 0 GROUP BY a.id")
def repulsion(embeddings):
    return domains.pair_forces(points(embeddings), 0.08, 0.1, power=1.0).select("id", r6("fx", 3).alias("fx"))


@query("customer", "supplier", sql="""
    WITH e AS (SELECT 'c' || c_custkey AS s, 's' || s_suppkey AS t, s_acctbal - c_acctbal AS d FROM customer JOIN supplier ON c_custkey % 50 + 1 = s_suppkey),
    f AS (SELECT s AS id, (abs(d) - 3) * 0.01 * sign(d) AS f FROM e UNION ALL SELECT t, -(abs(d) - 3) * 0.01 * sign(d) FROM e) SELECT id, round(sum(f), 5) + 0.0 AS fx FROM f GROUP BY id""")
def springs(customer, supplier):
    nodes = customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_acctbal").alias("x")).union(supplier.select(F.concat(F.lit("s"), "s_suppkey"), "s_acctbal")).withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    edges = customer.select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("s"), F.col("c_custkey") % 50 + 1).alias("target"), F.lit(1.0).alias("weight"))
    return domains.spring_forces(edges, nodes, 3.0, 0.01).select("id", r6("fx", 5).alias("fx"))


#: A mesh of the customers: corners 30 to a row, moved by the balance, and a polygon between each four.
MESH = """v AS (SELECT c_custkey AS id, c_custkey % 30 + c_acctbal / 130000 AS x, c_custkey // 30 + (c_custkey * 7 % 10) / 40.0::DOUBLE AS z FROM customer),
    p AS (SELECT a.id, a.x AS x1, a.z AS z1, b.x AS x2, b.z AS z2, c.x AS x3, c.z AS z3, d.x AS x4, d.z AS z4 FROM v a JOIN v b ON b.id = a.id + 1 JOIN v c ON c.id = a.id + 31 JOIN v d ON d.id = a.id + 30 WHERE a.id % 30 < 29)"""


def mesh(customer):
    k = F.col("c_custkey")
    v = customer.select(k.alias("id"), (k % 30 + F.col("c_acctbal") / 130000).alias("x"), F.lit(0.0).alias("y"), (F.floor(k / 30) + F.col("c_custkey") * 7 % 10 / 40.0).alias("z"))
    i, other = F.col("id"), v.select((F.col("id") - 31).alias("id"))
    p = v.select("id").filter("id % 30 < 29").join(other, "id")
    return p.select(i.alias("poly_id"), F.array(i, i + 1, i + 31, i + 30).alias("vertex_ids")), v


@query("customer", sql=f"""
    WITH {MESH}, e AS (SELECT a.id AS a, b.id AS b, a.x2 AS vx, a.z2 AS vz, a.x3 AS wx, a.z3 AS wz FROM p a JOIN p b ON b.id = a.id + 1 AND b.id % 30 > 0 UNION ALL SELECT a.id, b.id, a.x4, a.z4, a.x3, a.z3 FROM p a JOIN p b ON b.id = a.id + 30)
    SELECT a, b, round((vx + wx) / 2 + 1e-8, 6) AS mx, round((vz + wz) / 2 + 1e-8, 6) AS mz, round(sqrt((vx - wx) * (vx - wx) + (vz - wz) * (vz - wz)) + 1e-8, 6) AS length FROM e""")
def navmesh_edges(customer):
    # so that no value ends in a half
    return domains.shared_edges(*mesh(customer)).select("a", "b", *[r6(F.col(c) + 1e-8).alias(c) for c in ("mx", "mz", "length")])


@query("customer", sql=f"""
    WITH {MESH} SELECT id AS poly_id, round((x1 + x2 + x3 + x4) / 4 + 1e-8, 6) AS cx, round((z1 + z2 + z3 + z4) / 4 + 1e-8, 6) AS cz, round(abs(x1 * z2 - x2 * z1 + x2 * z3 - x3 * z2 + x3 * z4 - x4 * z3 + x4 * z1 - x1 * z4) / 2, 5) AS area FROM p""")
def navmesh_areas(customer):
    return domains.polygon_facts(*mesh(customer)).select("poly_id", r6(F.col("cx") + 1e-8).alias("cx"), r6(F.col("cz") + 1e-8).alias("cz"), r6("area", 5).alias("area"))


@query("embeddings", sql=f"SELECT a.id, b.id AS id2 FROM (SELECT id, x * 40 AS x, y * 40 AS y, z * 40 AS z FROM {POINTS}) a JOIN (SELECT id, x * 40 AS x, y * 40 AS y, z * 40 AS z FROM {POINTS}) b ON a.id < b.id AND {D3} <= 1.8")
def inferred_bonds(embeddings):
    return domains.bonds(points(embeddings).select("id", *[(F.col(a) * 40).alias(a) for a in "xyz"])).select("id", "id2")


@query("customer")
def force_positions(customer):
    from luminal.operators.force import force_layout

    d = customers(customer)
    hub = d.groupBy("c_nationkey").agg(F.min("id").alias("source"))
    edges = d.join(hub, "c_nationkey").filter("id <> source").select("source", F.col("id").alias("target"), F.lit(1.0).alias("weight"))
    return placed(force_layout(d, edges, ["id"]))
