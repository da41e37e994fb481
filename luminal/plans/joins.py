"""Joins: dimensions, edges, ranges, as-of, differences, recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from luminal.operators import diff, graph, layouts, spatial, temporal, trees
from luminal.plans.book import query, r6

POINTS = "(SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
D3 = "sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))"


def points(embeddings):
    return embeddings.select(F.col("vec_id").alias("id"), *[F.get("embedding", i).cast("double").alias(a) for i, a in enumerate("xyz")])


@query("orders", "customer", "nation", "region", sql="""
    SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
    WHERE o_orderstatus <> 'P' ORDER BY r_name, n_name, c_name, o_totalprice DESC, o_orderkey LIMIT 1000""")
def palace_left_joins(orders, customer, nation, region):
    d = orders.filter("o_orderstatus <> 'P'").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return d.orderBy("r_name", "n_name", "c_name", F.desc("o_totalprice"), "o_orderkey").limit(1000).select("o_orderkey", "c_name", "n_name", "r_name")


@query("customer", "supplier", sql="""
    SELECT c_custkey AS source, s_suppkey AS target, round(abs(c_acctbal - s_acctbal), 4) AS length, round((c_acctbal + s_acctbal) / 2, 4) + 0.0 AS middle FROM customer JOIN supplier ON c_custkey % 50 + 1 = s_suppkey""")
def edge_join(customer, supplier):
    nodes = customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_acctbal").alias("x")).union(supplier.select(F.concat(F.lit("s"), "s_suppkey"), "s_acctbal")).withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    edges = customer.select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("s"), F.col("c_custkey") % 50 + 1).alias("target"), F.lit(1.0).alias("weight"))
    e = graph.place_edges(edges, nodes)
    key = lambda c: F.substring(F.col(c), F.lit(2), F.length(c)).cast("long").alias(c)
    return e.select(key("source"), key("target"), F.round("length", 4).alias("length"), r6("mx", 4).alias("middle"))


@query("nation", "region", sql="SELECT 'r' || n_regionkey AS parent_id, 'n' || n_nationkey AS child_id FROM nation JOIN region ON n_regionkey = r_regionkey")
def parent_child(nation, region):
    rows = region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent")).union(nation.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")))
    return trees.links(rows)


TREE = """WITH RECURSIVE t(id, parent) AS (SELECT 'r' || r_regionkey, 'world' FROM region UNION ALL SELECT 'world', NULL UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""


def tree_rows(region, nation, supplier):
    row = lambda df, a, k, b, p: df.select(F.concat(F.lit(a), F.col(k).cast("string")).alias("id"), F.concat(F.lit(b), F.col(p).cast("string")).alias("parent"))
    world = region.select(F.lit("world").alias("id"), F.lit(None).cast("string").alias("parent")).limit(1)
    return world.union(region.select(F.concat(F.lit("r"), "r_regionkey"), F.lit("world"))).union(row(nation, "n", "n_nationkey", "r", "n_regionkey")).union(row(supplier, "s", "s_suppkey", "n", "s_nationkey"))


@query("region", "nation", "supplier", sql=TREE + """, w(id, depth) AS (SELECT id, 0 FROM t WHERE parent IS NULL UNION ALL SELECT t.id, depth + 1 FROM t JOIN w ON t.parent = w.id) SELECT depth, count(*) AS n FROM w GROUP BY depth""")
def tree_depth(region, nation, supplier):
    return trees.depths(tree_rows(region, nation, supplier)).groupBy("depth").agg(F.count("*").alias("n"))


@query("region", "nation", "supplier", sql=TREE + """,
    k AS (SELECT id, parent, row_number() OVER (PARTITION BY parent ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY parent) AS n FROM t WHERE parent IS NOT NULL),
    w(id, x, y) AS (SELECT id, 0.0::DOUBLE, 0.0::DOUBLE FROM t WHERE parent IS NULL UNION ALL SELECT k.id, w.x + (i - (n - 1) / 2.0) * 4.0, w.y - 3.0 FROM k JOIN w ON k.parent = w.id)
    SELECT id, round(x, 6) + 0.0 AS x, y FROM w""")
def layout_tree(region, nation, supplier):
    return layouts.calculate(tree_rows(region, nation, supplier), "tree", ["id"]).select("id", r6("x").alias("x"), "y")


@query("region", "nation", "supplier", sql=TREE + """,
    k AS (SELECT id, parent, row_number() OVER (PARTITION BY parent ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY parent) AS n FROM t WHERE parent IS NOT NULL),
    w(id, d, a) AS (SELECT id, 0, 0.0::DOUBLE FROM t WHERE parent IS NULL UNION ALL SELECT k.id, d + 1, a - pi() / greatest(2, d) / 2 + pi() / greatest(2, d) * i / greatest(1, n - 1) FROM k JOIN w ON k.parent = w.id)
    SELECT id, round(d * 1.5 * cos(a), 5) + 0.0 AS x, round(-3.0 + d * 1.5 * sin(a), 5) + 0.0 AS z FROM w""")
def layout_polar_tree(region, nation, supplier):
    return layouts.calculate_positions(tree_rows(region, nation, supplier), "tree", ["id"]).select("id", r6("x", 5).alias("x"), r6("z", 5).alias("z"))


def _forest(name, children, of):
    """SQL of a level of the tidy tree: the children of each parent side by side, and what they look like from above."""
    shift = "list_max(list_transform(range(1, least(len(a.r), len(b.l)) + 1), lambda i: a.r[i] - b.l[i] + CASE WHEN i = 1 THEN 1.0 ELSE 2.0 END))"
    both = "list_concat(a.l, list_transform(b.l[len(a.l) + 1:], lambda v: v + s)) AS l, list_concat(list_transform(b.r, lambda v: v + s), a.r[len(b.r) + 1:]) AS r"
    merge = f"list_transform([{shift}], lambda s: struct_pack(l := {both.split(' AS l, ')[0]}, r := {both.split(' AS l, ')[1].removesuffix(' AS r')}, o := list_append(a.o, s)))[1]"
    return f"""
    {name}_all AS (SELECT parent, list(id ORDER BY id) AS ids, list_reduce(list(struct_pack(l := l, r := r, o := [0.0::DOUBLE]) ORDER BY id), lambda a, b: {merge}) AS f FROM {children} GROUP BY parent),
    {name}_at AS (SELECT parent, unnest(ids) AS id, unnest(f.o) - f.o[-1] / 2 AS x FROM {name}_all),
    {name} AS (SELECT t.id, t.parent, list_concat([0.0::DOUBLE], list_transform(coalesce(f.l, []), lambda v: v - f.o[-1] / 2)) AS l, list_concat([0.0::DOUBLE], list_transform(coalesce(f.r, []), lambda v: v - f.o[-1] / 2)) AS r
        FROM t LEFT JOIN {name}_all k ON k.parent = t.id WHERE t.id LIKE '{of}%'),"""


@query("region", "nation", "supplier", sql=TREE + ", s0 AS (SELECT id, parent, [0.0::DOUBLE] AS l, [0.0::DOUBLE] AS r FROM t WHERE id LIKE 's%')," + _forest("n1", "s0", "n") + _forest("r1", "n1", "r") + _forest("w1", "r1", "world") + """
    p AS (SELECT 'world' AS id, 0 AS depth, 0.0::DOUBLE AS x), q AS (SELECT w.id, 1 AS depth, p.x + w.x AS x FROM w1_at w JOIN p ON p.id = w.parent), u AS (SELECT w.id, 2 AS depth, q.x + w.x AS x FROM r1_at w JOIN q ON q.id = w.parent),
    v AS (SELECT w.id, 3 AS depth, u.x + w.x AS x FROM n1_at w JOIN u ON u.id = w.parent), a AS (FROM p UNION ALL FROM q UNION ALL FROM u UNION ALL FROM v), e AS (SELECT min(x) AS lo, max(x) AS hi, max(depth) AS deep FROM a)
    SELECT id, depth, round((x - lo + 0.5) * 10 / (hi - lo + 1), 6) + 0.0 AS x, depth * 2.0::DOUBLE AS y, round(depth * 10.0 / deep, 6) AS z FROM a, e""")
def layout_tidy_tree(region, nation, supplier):
    d = trees.tidy_tree(tree_rows(region, nation, supplier), level=2.0, size=(10.0, 10.0))
    return d.select("id", "depth", r6("x").alias("x"), "y", r6("z").alias("z"))


@query("embeddings", sql=f"SELECT a.id, b.id AS id2, round({D3}, 6) AS distance FROM {POINTS} a JOIN {POINTS} b ON a.id < b.id AND {D3} <= 0.05")
def rips_edges(embeddings):
    return spatial.close_pairs(points(embeddings), 0.05).select("id", "id2", F.round("distance", 6).alias("distance"))


@query("embeddings", sql=f"WITH e AS (SELECT a.id AS i, b.id AS j FROM {POINTS} a JOIN {POINTS} b ON a.id < b.id AND {D3} <= 0.05) SELECT x.i, x.j, y.j AS k FROM e x JOIN e y ON x.j = y.i JOIN e z ON z.i = x.i AND z.j = y.j")
def rips_triangles(embeddings):
    return spatial.rips_triangles(points(embeddings), 0.05)


@query("embeddings", sql=f"SELECT a.id, round((SELECT count(*) FROM {POINTS} b WHERE b.id <> a.id AND {D3} <= 0.1) / (SELECT count(*) FROM embeddings)::DOUBLE, 6) AS density FROM {POINTS} a")
def density(embeddings):
    return spatial.density(points(embeddings), 0.1).select("id", F.round("density", 6).alias("density"))


@query("embeddings", sql=f"""
    SELECT id, id2, round(1 - d / 0.1, 6) + 0.0 AS similarity, rank FROM (SELECT a.id, b.id AS id2, {D3} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {D3}, b.id) AS rank FROM {POINTS} a JOIN {POINTS} b ON a.id <> b.id AND {D3} <= 0.1) WHERE rank <= 3""")
def knn_topk(embeddings):
    return spatial.nearest(points(embeddings), 0.1, 3).select("id", "id2", r6("similarity").alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("embeddings", sql="SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a, embeddings b WHERE b.vec_id = 7 AND a.vec_id <> 7 ORDER BY similarity DESC, id LIMIT 10")
def similar_to_one(embeddings):
    return spatial.connections(embeddings.withColumnRenamed("vec_id", "id"), 7, -1.0, 10).select("id", F.round("similarity", 6).alias("similarity"))


@query("embeddings", sql=f"SELECT a.id, round({D3}, 6) AS distance FROM {POINTS} a, (SELECT 0.0 AS x, 0.0 AS y, 0.0 AS z) b WHERE {D3} <= 0.2")
def near_origin(embeddings):
    return spatial.near_point(points(embeddings), (0, 0, 0), 0.2).select("id", F.round("distance", 6).alias("distance"))


STATES = """a AS (SELECT c_custkey AS id, c_acctbal AS x FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 10 ELSE c_acctbal END AS x FROM customer WHERE c_custkey % 3 <> 1)"""


def states(customer):
    c = customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return c.filter("id % 3 <> 0"), c.filter("id % 3 <> 1").withColumn("x", F.when(F.col("id") % 5 == 0, F.col("x") + 10).otherwise(F.col("x")))


@query("customer", sql=f"WITH {STATES} SELECT coalesce(a.id, b.id) AS id, round(CASE WHEN a.id IS NULL THEN b.x WHEN b.id IS NULL THEN a.x ELSE a.x + (b.x - a.x) * 0.25 END, 6) + 0.0 AS x, CASE WHEN b.id IS NULL THEN 0.75 WHEN a.id IS NULL THEN 0.25 ELSE 1.0 END::DOUBLE AS opacity FROM a FULL JOIN b ON a.id = b.id")
def full_outer_interp(customer):
    return temporal.interpolate_states(*states(customer), 0.25).select("id", r6("x").alias("x"), "opacity")


@query("customer", sql=f"WITH {STATES} SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR abs(a.x - b.x) > 0.1")
def compare_periods(customer):
    return temporal.compare_periods(*states(customer))


CUTS = """a AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 4 <> 0), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 1 THEN 'X' ELSE o_orderstatus END AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 4 <> 1)"""


def cuts(orders):
    o = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    return o.filter("id % 4 <> 0"), o.filter("id % 4 <> 1").withColumn("status", F.when(F.col("id") % 6 == 1, "X").otherwise(F.col("status")))


@query("orders", sql=f"WITH {CUTS} SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'add' WHEN b.id IS NULL THEN 'remove' ELSE 'update' END AS op, b.status, b.price FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.status <> b.status OR a.price <> b.price")
def diff_ops(orders):
    return diff.diff(*cuts(orders))


@query("orders", sql=f"WITH {CUTS} SELECT status, count(*) AS n, round(sum(price), 2) AS price FROM b GROUP BY status")
def diff_apply(orders):
    a, b = cuts(orders)
    return diff.apply(a, diff.diff(a, b)).groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price"))


@query("events", sql="""
    WITH p AS (SELECT DISTINCT user_id, ts0 + INTERVAL (h) HOUR AS ts FROM (SELECT user_id, TIMESTAMP '2024-01-01' AS ts0 FROM events), range(0, 720, 6) r(h)),
    b AS (SELECT p.user_id, p.ts, e.ts AS t1, e.value AS v1 FROM p ASOF LEFT JOIN (SELECT user_id, ts, min(value) AS value FROM events GROUP BY ALL) e ON p.user_id = e.user_id AND p.ts >= e.ts),
    c AS (SELECT b.*, e.ts AS t2, e.value AS v2 FROM b ASOF LEFT JOIN (SELECT user_id, ts, min(value) AS value FROM events GROUP BY ALL) e ON b.user_id = e.user_id AND b.ts <= e.ts)
    SELECT user_id, strftime(ts, '%Y-%m-%d %H') AS at, round(CASE WHEN t1 IS NULL THEN v2 WHEN t2 IS NULL THEN v1 WHEN t1 = t2 THEN v1 ELSE v1 + (v2 - v1) * (epoch_us(ts) - epoch_us(t1)) / (epoch_us(t2) - epoch_us(t1))::DOUBLE END, 5) + 0.0 AS value FROM c""")
def asof_bracket(events):
    e = events.groupBy("user_id", "ts").agg(F.min("value").alias("value"))
    hours = F.explode(F.sequence(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-30 18:00:00").cast("timestamp"), F.expr("INTERVAL 6 HOURS")))
    p = e.select("user_id").distinct().select("user_id", hours.alias("ts"))
    return temporal.lerp_asof(p, e, ["user_id"]).select("user_id", F.date_format("ts", "yyyy-MM-dd HH").alias("at"), r6("value", 5).alias("value"))


@query("events", sql="SELECT strftime(min(ts) FILTER (WHERE ts > TIMESTAMP '2024-01-15'), '%Y-%m-%d %H:%M:%S') AS next, strftime(max(ts) FILTER (WHERE ts < TIMESTAMP '2024-01-15'), '%Y-%m-%d %H:%M:%S') AS previous FROM events")
def next_event(events):
    at = F.lit("2024-01-15 00:00:00").cast("timestamp")
    show = lambda d, name: d.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias(name))
    return show(events.filter(F.col("ts") > at).agg(F.min("ts").alias("ts")), "next").join(show(temporal.next_event(events, "2024-01-15 00:00:00", backwards=True), "previous"), F.lit(True))


@query("lineitem", sql="SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_partkey IN (1, 2, 3)")
def neighbors(lineitem):
    e = lineitem.select(F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"))
    return graph.neighbours(e, ["p1", "p2", "p3"]).select(F.substring("id", 2, 20).cast("long").alias("id"))


@query("customer", sql="""
    WITH RECURSIVE e(a, b) AS (SELECT c_custkey, c_custkey // 2 FROM customer UNION SELECT c_custkey // 2, c_custkey FROM customer),
    w(id, h) AS (SELECT 1::BIGINT, 0 UNION SELECT e.b, h + 1 FROM e JOIN w ON e.a = w.id WHERE h < 6) SELECT id, min(h) AS hops FROM w WHERE id > 0 GROUP BY id""")
def hops(customer):
    e = customer.select(F.col("c_custkey").alias("source"), F.floor(F.col("c_custkey") / 2).alias("target"))
    return graph.distances_from(e, 1, 6).filter("id > 0")


@query("customer", sql="SELECT c_custkey AS id, CASE WHEN c_custkey = 0 THEN 1 ELSE length(bin(c_custkey)) - 1 END AS hops FROM customer")
def hops_all(customer):
    """hops without a limit: a customer's key loses one binary digit each hop."""
    e = customer.select(F.col("c_custkey").alias("source"), F.floor(F.col("c_custkey") / 2).alias("target"))
    return graph.distances_from(e, 1)


@query("customer", "supplier", sql="SELECT n, count(*) AS customers FROM (SELECT c_custkey, (SELECT count(*) FROM supplier WHERE s_nationkey = c_nationkey) AS n FROM customer) GROUP BY n")
def linked_counts(customer, supplier):
    d = graph.shared_degrees(customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("key")), supplier.select(F.col("s_nationkey").alias("key")))
    return d.groupBy(F.col("degree").alias("n")).agg(F.count("*").alias("customers"))


@query("orders", "lineitem", sql="SELECT 'move' AS kind, o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'update', l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def union_moves(orders, lineitem):
    return orders.filter("o_orderstatus = 'O'").select(F.lit("move").alias("kind"), F.col("o_orderkey").alias("id")).unionByName(lineitem.filter("l_returnflag = 'R'").select(F.lit("update").alias("kind"), F.col("l_orderkey").alias("id")))


@query("customer", "orders", sql="SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def except_ids(customer, orders):
    return customer.select(F.col("c_custkey").alias("id")).join(orders.select(F.col("o_custkey").alias("id")), "id", "left_anti")


@query("supplier", "part", sql="SELECT 's' AS kind, s_suppkey AS id, s_acctbal AS balance, NULL::DOUBLE AS price FROM supplier UNION ALL SELECT 'p', p_partkey, NULL, p_retailprice FROM part")
def cross_domain_union(supplier, part):
    return supplier.select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")).unionByName(part.select(F.lit("p").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price")), allowMissingColumns=True)
