"""Groups, series, order books, topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from luminal.operators import aggregates, domains, series, temporal
from luminal.plans.book import query, r6
from luminal.plans.joins import points


@query("nation", sql="SELECT n_regionkey::VARCHAR AS key, count(*) AS n, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def group_collect(nation):
    g = aggregates.group_records(nation, "n_regionkey", "n_nationkey")
    return g.select("key", "n", F.array_join(F.transform("records", lambda r: r["n_name"]), ",").alias("names"))


@query("orders", sql="SELECT o_orderkey, o_orderstatus AS key, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) - 1 AS place, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders")
def grouped_rows(orders):
    """Three groups hold all orders."""
    return aggregates.grouped_rows(orders, "o_orderstatus", "o_totalprice", "o_orderkey").select("o_orderkey", "key", "place", "n")


@query("events", sql="""
    WITH e AS (SELECT floor(epoch_ms(ts) / 86400000)::BIGINT * 86400000 AS bucket, event_type AS g, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT bucket, sum(n)::BIGINT AS count, string_agg(g || '=' || n, ';' ORDER BY g) AS by_type FROM e GROUP BY bucket""")
def time_bucket(events):
    d = events.withColumn("ts_ms", F.unix_millis("ts"))
    b = temporal.time_buckets(d, 86_400_000, group="event_type")
    return b.select("bucket", "count", F.array_join(F.transform(F.array_sort(F.map_entries("by")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";").alias("by_type"))


@query("customer", sql="""
    WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS k FROM customer GROUP BY ALL), t AS (SELECT c_nationkey, sum(k) AS n FROM c GROUP BY ALL)
    SELECT c.c_nationkey, t.n::BIGINT AS n, round(-sum(k / t.n * log2(k / t.n)), 5) + 0.0 AS entropy, CASE WHEN t.n > 1 THEN round(-sum(k / t.n * log2(k / t.n)) / log2(t.n), 5) + 0.0 ELSE 0.0 END AS normalized FROM c JOIN t USING (c_nationkey) GROUP BY c.c_nationkey, t.n""")
def entropy(customer):
    return aggregates.entropy(customer, "c_mktsegment", ["c_nationkey"]).select("c_nationkey", "n", r6("entropy", 5).alias("entropy"), r6("normalized", 5).alias("normalized"))


@query("lineitem", sql="SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS open, count(*) FILTER (WHERE l_quantity > 25) AS large, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def conditional_counts(lineitem):
    return lineitem.groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "O").alias("open"), F.count_if(F.col("l_quantity") > 25).alias("large"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("lineitem", sql="""
    WITH e AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem), n AS (SELECT (SELECT count(DISTINCT p) FROM e) + (SELECT count(DISTINCT s) FROM e) AS n)
    SELECT s AS id, count(*) AS degree, round(0.5 + count(*) / any_value(n)::DOUBLE * 1.5, 6) AS size, round(0.3 + count(*) / 10.0, 6) AS emissive FROM e, n GROUP BY s""")
def degree(lineitem):
    from luminal.operators import graph

    e = lineitem.select(F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target")).distinct()
    d = graph.degree_style(e).filter(F.startswith("id", F.lit("s")))
    return d.select(F.substring("id", 2, 20).cast("long").alias("id"), "degree", F.round("size", 6).alias("size"), F.round("emissive", 6).alias("emissive"))


BOOK = "(SELECT l_suppkey % 20 AS symbol, CASE WHEN l_returnflag = 'R' THEN 'bid' ELSE 'ask' END AS side, round(l_extendedprice / l_quantity, 0) AS price, l_quantity AS size FROM lineitem)"


def orders_of(lineitem):
    return lineitem.select((F.col("l_suppkey") % 20).alias("symbol"), F.when(F.col("l_returnflag") == "R", "bid").otherwise("ask").alias("side"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), 0).alias("price"), F.col("l_quantity").alias("size"))


@query("lineitem", sql=f"""
    SELECT symbol, sum(size) AS volume, round(sum(price * size) / sum(size), 4) AS vwap, max(price) FILTER (WHERE side = 'bid') AS bid, min(price) FILTER (WHERE side = 'ask') AS ask,
      (max(price) FILTER (WHERE side = 'bid') + min(price) FILTER (WHERE side = 'ask')) / 2 AS mid, min(price) FILTER (WHERE side = 'ask') - max(price) FILTER (WHERE side = 'bid') AS spread FROM {BOOK} GROUP BY symbol""")
def vwap_mid_spread(lineitem):
    return series.book_summary(orders_of(lineitem)).withColumn("vwap", F.round("vwap", 4))


@query("lineitem", sql=f"""
    WITH l AS (SELECT symbol, side, price, sum(size) AS size FROM {BOOK} GROUP BY ALL),
    r AS (SELECT *, row_number() OVER w - 1 AS level, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS cumulative FROM l WINDOW w AS (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END))
    SELECT symbol, side, price, size, level, cumulative FROM r WHERE level < 10""")
def cum_depth(lineitem):
    return series.book_levels(orders_of(lineitem)).select("symbol", "side", "price", "size", F.col("level").cast("long").alias("level"), "cumulative")


@query("orders", sql="""
    WITH o AS (SELECT o_custkey, o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS g FROM orders)
    SELECT o_custkey, o_orderstatus, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM o GROUP BY o_custkey, o_orderstatus, g""")
def run_length(orders):
    return series.runs(orders, ["o_custkey"], "o_orderstatus", "o_orderkey").drop("run")


@query("lineitem", sql="""
    WITH d AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem), g AS (SELECT *, l_orderkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS i FROM d)
    SELECT l_suppkey, min(l_orderkey) AS first, max(l_orderkey) AS last, count(*) AS n FROM g GROUP BY l_suppkey, i HAVING count(*) >= 2""")
def islands(lineitem):
    return series.islands(lineitem, ["l_suppkey"], "l_orderkey", 2)


@query("events", sql="SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 5")
def last_n(events):
    return series.last_n(events, ["user_id"], 5, "ts", "event_id").select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


@query("events", sql="SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest(events):
    return series.latest(events, ["user_id"], "ts", "event_id").select("user_id", "event_id", "value")


@query("events", sql="SELECT event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def temporal_links(events):
    return temporal.links(events, ["user_id"], id_col="event_id").select("event_id", "before", "after")


@query("events", sql="""
    WITH e AS (SELECT user_id, event_id, ts, value > 60 AS o, coalesce(lag(value > 60) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS p FROM events WHERE value IS NOT NULL)
    SELECT user_id, event_id, CASE WHEN o THEN 'trigger' ELSE 'clear' END AS event FROM e WHERE o <> p""")
def alerts_edge(events):
    return series.edge_alerts(events, ["user_id"], F.col("value") > 60, "ts", "event_id").select("user_id", "event_id", "event")


@query("events", sql="""
    WITH e AS (SELECT user_id, ts, value > 40 AS o, row_number() OVER (PARTITION BY user_id ORDER BY ts) - row_number() OVER (PARTITION BY user_id, value > 40 ORDER BY ts) AS g FROM (SELECT user_id, ts, max(value) AS value FROM events GROUP BY ALL))
    SELECT user_id, count(*) AS n, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0) AS seconds FROM e WHERE o GROUP BY user_id, g HAVING (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 >= 7200""")
def alerts_duration(events):
    e = events.groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    d = series.hold_at_least(e, ["user_id"], "ts", F.col("value") > 40, 7200)
    return d.select("user_id", "n", F.round((F.unix_micros("stop") - F.unix_micros("start")) / 1e6, 0).alias("seconds"))


@query("documents", sql="""
    SELECT count(*) AS packets, round(avg(CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS graph, round(avg(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END), 6) AS mean_links, 'scatter' AS topology FROM documents""")
def topology_profile(documents):
    link = F.struct(F.lit("a").alias("to"), F.lit(1.0).alias("weight"))
    p = documents.select(
        F.struct(F.lit("categorical").alias("type"), F.when(F.col("doc_id") % 3 == 0, "graph").otherwise("point").alias("structure"), F.lit(5).alias("dimensions"), F.lit(None).cast("array<double>").alias("embedding")).alias("semantics"),
        F.struct(F.lit(None).cast("string").alias("parent"), F.when(F.col("doc_id") % 3 == 0, F.array(link, link)).alias("links")).alias("relations"),
        F.struct(F.col("doc_id").alias("timestamp")).alias("context"),
    )
    return aggregates.detect_topology(p).select("packets", F.round("graph", 6).alias("graph"), F.round("mean_links", 6).alias("mean_links"), "topology")


PAIRS = "(SELECT (l_linenumber - 1) % 3 AS dimension, l_discount * 50 AS birth, l_discount * 50 + l_tax * 50 AS death FROM lineitem)"


def pairs(lineitem):
    return lineitem.select(((F.col("l_linenumber") - 1) % 3).alias("dimension"), (F.col("l_discount") * 50).alias("birth"), (F.col("l_discount") * 50 + F.col("l_tax") * 50).alias("death"))


@query("lineitem", sql=f"""
    SELECT i * 0.25 AS epsilon, sum(CASE WHEN dimension = 0 THEN 1 ELSE 0 END)::BIGINT AS betti_0, sum(CASE WHEN dimension = 1 THEN 1 ELSE 0 END)::BIGINT AS betti_1, sum(CASE WHEN dimension = 2 THEN 1 ELSE 0 END)::BIGINT AS betti_2, sum(CASE WHEN dimension = 1 THEN -1 ELSE 1 END)::BIGINT AS euler
    FROM range(1, 40, 2) r(i), (SELECT dimension, round(birth, 6) AS birth, round(death, 6) AS death FROM {PAIRS}) WHERE birth <= i * 0.25 AND i * 0.25 < death GROUP BY i""")
def betti_curve(lineitem):
    p = pairs(lineitem).select("dimension", F.round("birth", 6).alias("birth"), F.round("death", 6).alias("death"))
    return aggregates.betti_curve(p, 0.25, 9.75, 20).filter("betti_0 + betti_1 + betti_2 > 0")


@query("lineitem", sql=f"""
    WITH p AS (SELECT *, death - birth AS persistence, max(death) OVER () AS top FROM {PAIRS})
    SELECT dimension, CASE WHEN persistence > 3 THEN '#d62728' WHEN dimension = 0 THEN '#1f77b4' WHEN dimension = 1 THEN '#ff7f0e' ELSE '#2ca02c' END AS color, count(*) AS n, round(sum(birth * 20 / top + persistence * 10 / top), 3) AS x FROM p WHERE persistence >= 0.75 GROUP BY ALL""")
def persistence_bars(lineitem):
    return aggregates.persistence_bars(pairs(lineitem), 0.75).groupBy("dimension", "color").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("x"))


@query("embeddings")
def kmeans_sizes(embeddings):
    return aggregates.kmeans(embeddings, "embedding").groupBy("cluster").agg(F.count("*").alias("n"))


@query("embeddings", sql="""
    WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, label FROM embeddings), r AS (SELECT min(x) AS lo, max(x) AS hi FROM p),
    m AS (SELECT DISTINCT id, i AS interval, label AS cluster FROM p, r, range(4) g(i) WHERE x >= lo + (hi - lo) / 4 * (i - 0.25) AND x <= lo + (hi - lo) / 4 * (i + 1.25))
    SELECT interval::INT AS interval, cluster, count(*) AS size, round(0.2 + least(0.8, count(*) / 20.0), 6) AS radius FROM m GROUP BY ALL""")
def mapper_clusters(embeddings):
    p = points(embeddings).join(embeddings.select(F.col("vec_id").alias("id"), "label"), "id")
    return aggregates.mapper_graph(p, "x", 4, 0.25, "label")[0].withColumn("radius", F.round("radius", 6))


@query("lineitem", sql="""
    SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(lineitem):
    d = lineitem.filter("l_shipdate <= timestamp'1998-09-02'")
    return d.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("orders", sql="SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(min(o_totalprice), 2) AS low, round(max(o_totalprice), 2) AS high FROM orders GROUP BY 1")
def monthly_extent(orders):
    return orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.min("o_totalprice"), 2).alias("low"), F.round(F.max("o_totalprice"), 2).alias("high"))


@query("events", sql="""
    WITH g AS (SELECT user_id, ts, epoch_ms(ts) AS ms, value % 4 AS yaw, value % 3 AS pitch FROM (SELECT user_id, ts, min(value) AS value FROM events GROUP BY ALL)),
    w AS (SELECT user_id, ms, greatest(max(yaw) OVER v - min(yaw) OVER v, max(pitch) OVER v - min(pitch) OVER v) AS span FROM g WINDOW v AS (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW))
    SELECT user_id, count(*) AS n FROM w WHERE span < 2 GROUP BY user_id""")
def fixations(events):
    g = events.groupBy("user_id", "ts").agg(F.min("value").alias("value")).select("user_id", F.unix_millis("ts").alias("ts_ms"), (F.col("value") % 4).alias("yaw"), (F.col("value") % 3).alias("pitch"))
    return temporal.fixations(g, ["user_id"], window_ms=3_600_000).groupBy("user_id").agg(F.count("*").alias("n"))


@query("customer", sql="""
    WITH p AS (SELECT c_custkey % 40 * 0.5 AS x, (c_acctbal + 1000) / 550 AS z FROM customer), g AS (SELECT a.i AS gx, b.i AS gz FROM range(20) a(i), range(20) b(i)),
    d AS (SELECT gx, gz, sqrt((x - gx) * (x - gx) + (z - gz) * (z - gz)) AS d FROM p, g)
    SELECT gx::INT AS gx, gz::INT AS gz, round(ln(sum(exp(d * -2)) + 1), 5) + 0.0 AS height FROM d GROUP BY ALL""")
def terrain(customer):
    p = customer.select((F.col("c_custkey") % 40 * 0.5).alias("x"), ((F.col("c_acctbal") + 1000) / 550).alias("z"))
    return aggregates.terrain(p, 20, 1.0, error=1e-12).select("gx", "gz", r6("height", 5).alias("height"))


@query("events", sql="""
    WITH e AS (SELECT user_id, ts, min(value) AS value FROM events WHERE value IS NOT NULL GROUP BY ALL),
    s AS (SELECT i + 1 AS sample, (('0x' || substr(md5('7/' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE - 0.5) * 2 * 432000.0::DOUBLE AS o FROM range(40) r(i)),
    p AS (SELECT u.user_id, sample, make_timestamp(epoch_us(TIMESTAMP '2024-01-15') + round(o * 1e6)::BIGINT) AS ts, 1 - abs(o) / 432000.0 AS probability FROM (SELECT DISTINCT user_id FROM e) u, s),
    b AS (SELECT p.*, e.ts AS t1, e.value AS v1 FROM p ASOF LEFT JOIN e ON p.user_id = e.user_id AND p.ts >= e.ts), c AS (SELECT b.*, e.ts AS t2, e.value AS v2 FROM b ASOF LEFT JOIN e ON b.user_id = e.user_id AND b.ts <= e.ts),
    v AS (SELECT user_id, probability AS p, CASE WHEN t1 IS NULL THEN v2 WHEN t2 IS NULL THEN v1 WHEN t1 = t2 THEN v1 ELSE v1 + (v2 - v1) * (epoch_us(ts) - epoch_us(t1)) / (epoch_us(t2) - epoch_us(t1))::DOUBLE END AS value FROM c)
    SELECT user_id, round(sum(p * value) / sum(p), 4) AS expected, round(sqrt(greatest(0, sum(p * value * value) / sum(p) - pow(sum(p * value) / sum(p), 2))), 3) AS spread FROM v GROUP BY user_id""")
def weighted_samples(events):
    """What the value of each user is about the middle of the month, by forty weighted samples of ten days."""
    e = events.filter("value is not null").groupBy("user_id", "ts").agg(F.min("value").alias("value"))
    field = temporal.uncertainty_field(e, ["user_id"], "2024-01-15 00:00:00", 432_000.0, samples=40, seed=7)
    return temporal.expected_value(field, ["user_id"]).select("user_id", F.round("expected", 4).alias("expected"), F.round("spread", 3).alias("spread"))


@query("supplier", sql="""
    WITH n AS (SELECT s_suppkey AS id, (s_suppkey % 10)::DOUBLE AS x, (s_nationkey)::DOUBLE AS y, s_acctbal / 1000 AS z FROM supplier),
    d AS (SELECT a.id, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) + 0.01 AS d FROM n a, n b)
    SELECT id, round(sum(dx * 0.1 * (d - 2) / d) / 10, 2) + 0.0 AS fx, round(sum(dy * 0.1 * (d - 2) / d) / 10, 2) + 0.0 AS fy, round(sum(dz * 0.1 * (d - 2) / d) / 10, 2) + 0.0 AS fz FROM d GROUP BY id""")
def spring_network(supplier):
    """Every supplier tied to every other; the table is small enough here that most cells are near."""
    nodes = supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 10).cast("double").alias("x"), F.col("s_nationkey").cast("double").alias("y"), (F.col("s_acctbal") / 1000).alias("z"))
    d = domains.spring_network(nodes, 2.0, 0.1)
    return d.select("id", *[r6(F.col(c) / 10, 2).alias(c) for c in ("fx", "fy", "fz")])
