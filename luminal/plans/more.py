"""Further layouts, forces, formats, styles and graphs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from luminal.functions import astro, color, hashing, scales, signals
from luminal.functions.predicates import condition
from luminal.operators import diff, domains, graph, layouts, mapping, spatial, temporal
from luminal.plans.book import query, r6
from luminal.plans.expressions import HEX
from luminal.plans.joins import D3, POINTS, points
from luminal.plans.placement import C, customers
from luminal.sources import formats


@query("customer", sql=f"""
    SELECT id, round((i - n / 2.0) * 2, 5) + 0.0 AS center_x, i * 2.0 AS stack_y, round((i - (n - 1) / 2.0) * 1.5, 5) + 0.0 AS bar_x, round(c_acctbal / 2, 5) + 0.0 AS bar_y,
      round(cos(i / n * 4 * pi() + i % 3 * 2 * pi() / 3) * i * 0.5, 4) + 0.0 AS galaxy_x FROM ({C})""")
def layouts_along(customer):
    """Centred timeline, stack, bars and galaxy."""
    d = customers(customer)
    at = lambda name, **columns: layouts.calculate(d, name, ["id"], **({"value": "c_acctbal"} if name == "bar-row" else {})).select("id", *[c.alias(k) for k, c in columns.items()])
    out = at("centered-timeline", center_x=r6("x", 5)).join(at("stack", stack_y=F.col("y")), "id").join(at("bar-row", bar_x=r6("x", 5), bar_y=r6("y", 5)), "id")
    return out.join(at("galaxy", galaxy_x=r6("x", 4)), "id")


@query("orders", sql="SELECT o_orderkey AS id, round(((year(o_orderdate) - min(year(o_orderdate)) OVER ()) / greatest(1, max(year(o_orderdate)) OVER () - min(year(o_orderdate)) OVER ())::DOUBLE - 0.5) * 20, 6) + 0.0 AS x FROM orders")
def layout_history_line(orders):
    d = orders.select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"))
    return layouts.calculate(d, "history-line", ["id"]).select("id", r6("x").alias("x"))


@query("embeddings", sql="SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) + 0.0 AS x, round(embedding[2]::DOUBLE, 6) + 0.0 AS y, round(embedding[3]::DOUBLE, 6) + 0.0 AS z FROM embeddings")
def layout_projection(embeddings):
    return layouts.calculate(embeddings.withColumnRenamed("vec_id", "id"), "projection", ["id"]).select("id", *[r6(a).alias(a) for a in "xyz"])


@query("customer", sql="""
    WITH p AS (SELECT c_custkey AS id, c_acctbal / 1000 AS x, c_custkey % 7 - 3.0::DOUBLE AS y, c_custkey % 5 - 2.0::DOUBLE AS z, c_custkey % 3 - 1.0::DOUBLE AS vy FROM customer),
    o AS (SELECT *, x - 1 AS ox, y - 2 AS oy, z - 3 AS oz FROM p), d AS (SELECT *, sqrt(ox * ox + oy * oy + oz * oz) AS d, sqrt(ox * ox + oz * oz) AS h FROM o)
    SELECT id, round(CASE WHEN d > 0 AND d < 4 THEN -ox / d * 5 / (d * d + 0.01) ELSE 0 END, 6) + 0.0 AS well, round(CASE WHEN d > 0 AND d < 4 THEN ox / d * 5 / (d * d + 1) ELSE 0 END, 6) + 0.0 AS blast,
      round(CASE WHEN d > 0 AND d < 4 AND h > 0 THEN oz / h * 2 * (1 - d / 4) ELSE 0 END, 6) + 0.0 AS whirl, round(CASE WHEN y < 0.5 THEN 1.2 * least(0.5 - y, 1.0) * 9.81 - vy * 0.1 ELSE 0 END, 6) + 0.0 AS lift,
      2.0::DOUBLE AS wind, round(-x * 0.04, 6) + 0.0 AS center,
      round(CASE WHEN d > 0 AND d < 4 THEN -oy / d * 5 / (d * d + 0.01) ELSE 0 END, 6) + 0.0 AS well_y, round(CASE WHEN d > 0 AND d < 4 THEN oy / d * 5 / (d * d + 1) ELSE 0 END, 6) + 0.0 AS blast_y, round(-y * 0.04, 6) + 0.0 AS center_y, round(CASE WHEN d > 0 AND d < 4 THEN -oz / d * 5 / (d * d + 0.01) ELSE 0 END, 6) + 0.0 AS well_z, round(CASE WHEN d > 0 AND d < 4 THEN oz / d * 5 / (d * d + 1) ELSE 0 END, 6) + 0.0 AS blast_z, round(-z * 0.04, 6) + 0.0 AS center_z,
      0.0::DOUBLE AS whirl_y, round(CASE WHEN d > 0 AND d < 4 AND h > 0 THEN -ox / h * 2 * (1 - d / 4) ELSE 0 END, 6) + 0.0 AS whirl_z, 0.0::DOUBLE AS wind_y FROM d""")
def force_fields(customer):
    """What wells, blasts, whirls, water, wind and the centre do to each point."""
    k = F.col("c_custkey")
    d = customer.select(k.alias("id"), (F.col("c_acctbal") / 1000).alias("x"), (k % 7 - 3).cast("double").alias("y"), (k % 5 - 2).cast("double").alias("z"), (k % 3 - 1).cast("double").alias("vy"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vz"))
    at = (1, 2, 3)
    forces = {
        "well": domains.gravity_well(at, 5.0, 4.0)["fx"], "blast": domains.explosion(at, 5.0, 4.0)["fx"], "whirl": domains.vortex(at, (0, 1, 0), 2.0, 4.0)["fx"],
        "lift": domains.buoyancy(0.5, 1.2)["fy"], "wind": domains.wind((1, 0, 0), 2.0)["fx"], "center": domains.center_gravity(0.4)["fx"],
    }
    for a in "yz":
        forces |= {f"well_{a}": domains.gravity_well(at, 5.0, 4.0)[f"f{a}"], f"blast_{a}": domains.explosion(at, 5.0, 4.0)[f"f{a}"], f"whirl_{a}": domains.vortex(at, (0, 1, 0), 2.0, 4.0)[f"f{a}"], f"center_{a}": domains.center_gravity(0.4)[f"f{a}"]}
    forces["wind_y"] = domains.wind((1, 0, 0), 2.0)["fy"]
    return d.select("id", *[r6(c).alias(name) for name, c in forces.items()])


@query("embeddings", sql=f"""
    WITH s AS (SELECT id, x, y, z, 0.02 + id % 3 * 0.01::DOUBLE AS r FROM {POINTS}) SELECT a.id, b.id AS id2 FROM s a JOIN s b ON a.id < b.id AND {D3} < a.r + b.r""")
def collisions(embeddings):
    p = points(embeddings).withColumn("radius", 0.02 + F.col("id") % 3 * 0.01)
    return domains.collisions(p, 0.08).select("id", "id2")


@query("customer", "supplier", sql="""
    SELECT c_custkey AS id, round(max(greatest(0.0, 100 - 10 * sqrt(pow(c_custkey % 40 - s_suppkey % 40, 2) + pow((c_acctbal - s_acctbal) / 100, 2))) * (s_suppkey % 3 + 1)), 5) + 0.0 AS heat FROM customer, supplier GROUP BY c_custkey""")
def heat_zones(customer, supplier):
    zones = customer.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 40).cast("double").alias("x"), (F.col("c_acctbal") / 100).alias("z"))
    spots = supplier.select((F.col("s_suppkey") % 40).cast("double").alias("x"), (F.col("s_acctbal") / 100).alias("z"), (F.col("s_suppkey") % 3 + 1).cast("double").alias("load"))
    return domains.heat_zones(zones, spots).select("id", r6("heat", 5).alias("heat"))


@query("embeddings", sql=f"""
    WITH s AS (SELECT id, x * 10 + 20 AS along, y * 10 AS y, z * 10 AS z FROM {POINTS}) SELECT id, round(along - sqrt(0.25 - (y * y + z * z)), 6) AS hit FROM s WHERE y * y + z * z <= 0.25 ORDER BY hit, id LIMIT 1""")
def first_hit(embeddings):
    s = points(embeddings).select("id", *[(F.col(a) * 10).alias(a) for a in "xyz"], F.lit(0.5).alias("radius"))
    return spatial.raycast(s, (-20, 0, 0), (1, 0, 0)).select("id", r6("hit").alias("hit"))


@query("customer", sql="""
    SELECT c_custkey % 100000 AS serial, 'CA' AS name, CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS chain, c_custkey % 1000 / 8.0::DOUBLE AS x, -(c_custkey % 97) / 4.0::DOUBLE AS y, CASE WHEN c_custkey % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS occupancy,
      CASE WHEN c_custkey % 3 = 0 THEN 'C' ELSE 'N' END AS element, c_custkey % 50 / 2.0::DOUBLE AS z, 'GLY' AS residue, (c_custkey % 1000)::INT AS res_seq, '' AS alt, 1.5::DOUBLE AS temperature, CASE WHEN c_custkey % 4 = 0 THEN '1+' ELSE '' END AS charge FROM customer""")
def pdb_lines(customer):
    k = F.col("c_custkey")
    line = F.format_string(
        "ATOM  %5d %-4s%1s%-3s %1s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s%2s",
        k % 100_000, F.lit(" CA"), F.lit(" "), F.lit("GLY"), F.when(k % 2 == 0, "A").otherwise("B"), k % 1000, k % 1000 / 8.0, -(k % 97) / 4.0, k % 50 / 2.0, F.when(k % 2 == 0, 0.0).otherwise(0.5), F.lit(1.5),
        F.when(k % 3 == 0, "  ").otherwise(" N"), F.when(k % 4 == 0, "1+").otherwise("  "),
    )
    lines = customer.select(line.alias("value")).union(customer.select(F.lit("REMARK none").alias("value")))
    return formats.pdb_atoms(lines).select(F.col("serial").cast("long").alias("serial"), "name", "chain", "x", "y", "occupancy", "element", "z", "residue", "res_seq", "alt", "temperature", "charge")


@query("customer", sql="SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer")
def pdb_bonds(customer):
    """Each bond is listed from both ends and counts once."""
    k = F.col("c_custkey")
    line = F.concat_ws(" ", F.lit("CONECT"), k.cast("string"), (k + 1).cast("string"), F.when(k > 1, (k - 1).cast("string")))
    b = domains.listed_bonds(formats.pdb_connections(customer.select(line.alias("value"))))
    return b.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))


@query("part", sql="""
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '#909090' WHEN 1 THEN '#3050F8' WHEN 2 THEN '#E06633' ELSE '#FF69B4' END AS color, CASE p_partkey % 4 WHEN 0 THEN 0.17 WHEN 1 THEN 0.155 WHEN 2 THEN 0.2 ELSE 0.17 END::DOUBLE AS radius FROM part""")
def atom_styles(part):
    e = F.element_at(F.array(F.lit("C"), F.lit("n"), F.lit("Fe"), F.lit("Xx")), (F.col("p_partkey") % 4 + 1).cast("int"))
    d = part.select("p_partkey", e.alias("element"), *[F.lit(0.0).alias(a) for a in "xyz"])
    return domains.atom_records(d).select("p_partkey", "color", r6("radius").alias("radius"))


@query("orders", sql="""
    WITH o AS (SELECT o_orderkey, o_orderkey % 200 / 1000.0::DOUBLE AS d, date_diff('second', TIMESTAMP '2020-01-01', date_trunc('minute', o_orderdate)) / 86400.0::DOUBLE AS t FROM orders)
    SELECT o_orderkey::VARCHAR AS des, round(d, 6) AS distance, CASE WHEN d < 0.05 THEN 'hazardous' WHEN d < 0.1 THEN 'close' ELSE 'safe' END AS hazard_class, round(d * 149597870.7, 1) AS distance_km,
      round(d * cos((t % 365) / 365 * 2 * pi()) * 5, 5) + 0.0 AS x, round(t / 365 * 2, 5) + 0.0 AS z FROM o""")
def near_earth_feed(orders):
    k = F.col("o_orderkey")
    d = orders.select(k.cast("string").alias("des"), F.date_format("o_orderdate", "yyyy-MMM-dd HH:mm").alias("cd"), (k % 200 / 1000.0).cast("string").alias("dist"), F.lit("12.5").alias("v_rel"), F.lit("20").alias("h"))
    return formats.near_earth(d).select("des", F.round("distance", 6).alias("distance"), "hazard_class", F.round("distance_km", 1).alias("distance_km"), r6("x", 5).alias("x"), r6("z", 5).alias("z"))


@query("customer", sql="""
    WITH c AS (SELECT *, greatest(0.0, least(1.0, (c_acctbal + 1000) / 11000.0)) AS t FROM customer)
    SELECT c_custkey, round(0.5 + t * 1.5, 6) + 0.0 AS scale, c_nationkey::DOUBLE AS turn, 1.0::DOUBLE AS px, 0.0::DOUBLE AS py, CASE WHEN c_acctbal >= 0 THEN '#00d4aa' ELSE '#ff3864' END AS color,
      round(0.2 + t * 0.8, 6) + 0.0 AS opacity, 0.7::DOUBLE AS metalness, c_name AS emissive, 0.2 + t * 0.8 < 1 AS transparent FROM c""")
def spec_styles(customer):
    """A transform and a material spec as columns."""
    over = {"$data": "c_acctbal", "$domain": [-1000, 10000]}
    t = mapping.transforms({"scale": over | {"$range": [0.5, 2]}, "rotation": {"y": {"$data": "c_nationkey"}}, "position": {"x": 1, "z": 2}, "color": {"$data": "c_acctbal", "$map": "diverging-rdgy"}})
    m = mapping.material({"properties": {"opacity": over | {"$range": [0.2, 1]}, "metalness": 0.7, "emissive": {"$data": "c_name"}}})
    return customer.select(
        "c_custkey", r6(t["scale"]).alias("scale"), t["rotation_y"].alias("turn"), t["position_x"].alias("px"), t["position_y"].alias("py"), t["color"].alias("color"),
        r6(m["opacity"]).alias("opacity"), m["metalness"].alias("metalness"), m["emissive"].alias("emissive"), m["transparent"].alias("transparent"),
    )


_S = "(c_custkey % 101) / 100.0::DOUBLE"


@query("customer", sql=f"""
    WITH c AS (SELECT c_custkey, {_S} AS s, ({_S} - 0.4) / 0.3 AS t, {_S} / 0.4 AS u FROM customer)
    SELECT c_custkey, CASE WHEN s > 0.7 THEN '#00ffff' WHEN s > 0.4 THEN {HEX.format(r='0 * t', g='(212 + 43 * t)', b='(170 + 85 * t)')} ELSE {HEX.format(r='(255 - 255 * u)', g='(56 + 156 * u)', b='(100 + 70 * u)')} END AS similar,
      CASE WHEN s < 0.3 THEN '#ff0000' WHEN s < 0.7 THEN '#ffff00' ELSE '#00ff00' END AS band, CASE WHEN c_custkey % 101 < 33 THEN '#00ff00' WHEN c_custkey % 101 < 66 THEN '#ffff00' ELSE '#ff0000' END AS heat,
      c_custkey % 4 <> 3 AS valid, CASE c_custkey % 4 WHEN 0 THEN 'icosahedron' WHEN 1 THEN 'octahedron' WHEN 2 THEN 'sphere' ELSE 'box' END AS lod, '#58636e' AS lighter FROM c""")
def colour_rules(customer):
    k = F.col("c_custkey")
    s = k % 101 / 100.0
    name = F.element_at(F.array(*[F.lit(c) for c in ("#Fa0", "rgb(1, 2, 3)", "Red", "#12")]), (k % 4 + 1).cast("int"))
    return customer.select(
        "c_custkey", color.similarity_color(s).alias("similar"), signals.similarity_band(s).alias("band"), color.heat_level(k % 101).alias("heat"), color.is_valid_color(name).alias("valid"),
        mapping.lod_geometry(k % 4).alias("lod"), color.lighten(F.lit("#102030"), 0.3).alias("lighter"),
    )


@query("customer", sql="""
    WITH c AS (SELECT c_custkey, floor((1 - (c_custkey % 10) / 10.0) * 5)::BIGINT + 1 AS n FROM customer), g AS (SELECT *, unnest(range(n)) AS ghost FROM c)
    SELECT c_custkey, ghost, round((ghost - n / 2) * 0.5, 6) + 0.0 AS x, round(0.2 / n, 6) AS opacity FROM g""")
def ghosts(customer):
    d = customer.select("c_custkey", ((F.col("c_custkey") % 10) / 10.0).alias("c"), *[F.lit(0.0).alias(a) for a in "xyz"])
    return mapping.ghosts(d, "c").select("c_custkey", F.col("ghost").cast("long").alias("ghost"), r6("x").alias("x"), F.round("opacity", 6).alias("opacity"))


@query("customer", "region", sql="""
    WITH e AS (SELECT c_custkey AS id, unnest([c_mktsegment, 'nation' || c_nationkey]) AS c FROM customer), n AS (SELECT c, count(DISTINCT id) AS n FROM e GROUP BY c),
    q AS (SELECT DISTINCT unnest(['BUILDING', 'nation' || r_regionkey, 'unused']) AS c FROM region)
    SELECT 'entity:' || c_custkey AS id, 'entity' AS kind, NULL::BIGINT AS entities FROM customer UNION ALL SELECT 'system:' || r_name, 'system', NULL FROM region
    UNION ALL SELECT 'component:' || coalesce(n.c, q.c), 'component', coalesce(n, 0) FROM n FULL JOIN q ON n.c = q.c""")
def component_graph(customer, region):
    """Entities, their components, and the systems that ask for them."""
    e = customer.select(F.col("c_custkey").alias("id"), F.array("c_mktsegment", F.concat(F.lit("nation"), "c_nationkey")).alias("components"))
    s = region.select(F.col("r_name").alias("name"), F.array(F.lit("BUILDING"), F.concat(F.lit("nation"), "r_regionkey"), F.lit("unused")).alias("queries"))
    return graph.ecs_graph(e, s)[0].select("id", "kind", "entities")


@query("customer", "region", sql="""
    SELECT DISTINCT 'entity:' || c_custkey AS source, 'component:' || unnest([c_mktsegment, 'nation' || c_nationkey]) AS target FROM customer
    UNION ALL SELECT 'system:' || r_name, 'component:' || unnest(['BUILDING', 'nation' || r_regionkey, 'unused']) FROM region""")
def component_edges(customer, region):
    e = customer.select(F.col("c_custkey").alias("id"), F.array("c_mktsegment", F.concat(F.lit("nation"), "c_nationkey")).alias("components"))
    s = region.select(F.col("r_name").alias("name"), F.array(F.lit("BUILDING"), F.concat(F.lit("nation"), "r_regionkey"), F.lit("unused")).alias("queries"))
    return graph.ecs_graph(e, s)[1]


@query("nation", sql="""
    SELECT n_nationkey AS source, t.k AS target FROM nation JOIN (SELECT n_nationkey AS k FROM nation) t ON t.k IN (n_nationkey // 2, n_nationkey + 5, n_nationkey + 100) AND t.k >= n_nationkey""")
def listed_neighbours(nation):
    k = F.col("n_nationkey").cast("long")
    d = nation.select(k.alias("id"), F.array_distinct(F.array(F.floor(k / 2), k + 5, k + 100)).alias("neighbors"))
    return graph.neighbour_edges(d)


@query("customer", sql="SELECT c_custkey AS source, c_nationkey::BIGINT AS target FROM customer")
def named_connections(customer):
    """Connections that are named either way."""
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    odd = k % 2 == 1
    d = customer.select(F.when(odd, k).alias("from"), F.when(odd, n).alias("to"), F.when(~odd, k).alias("source"), F.when(~odd, n).alias("target"))
    return graph.connections(d)


@query("orders", sql="""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'delete' ELSE 'update' END AS op FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01' OR o_orderstatus = 'F' AND o_orderdate + INTERVAL 100 DAY > TIMESTAMP '1997-01-01'""")
def changed_since(orders):
    d = orders.withColumn("modified_at", F.col("o_orderdate").cast("timestamp")).withColumn("deleted_at", F.when(F.col("o_orderstatus") == "F", F.col("modified_at") + F.expr("INTERVAL 100 DAY")))
    return diff.changed_since(d, "1997-01-01 00:00:00").select("o_orderkey", "op")


@query("orders", sql="""
    SELECT op, sum(n)::BIGINT AS changes, sum(n * n % 7)::BIGINT > 0 AS any, bool_and(n <= 50) AS small FROM (SELECT o_orderstatus AS op, 1 AS n FROM orders) GROUP BY op""")
def delta_messages(orders):
    """Messages of at most 50 changes hold every change once."""
    m = diff.encode_deltas(orders.select("o_orderkey", F.col("o_orderstatus").alias("op")), 50, "o_orderkey")
    whole = F.size(F.from_json("payload", "array<struct<o_orderkey:long>>")) == F.col("n")
    return m.groupBy("op").agg(F.sum("n").alias("changes"), (F.count("*") > 0).alias("any"), F.bool_and((F.col("n") <= 50) & whole).alias("small"))


@query("orders", sql="SELECT count(DISTINCT o_orderdate) AS snapshots, count(DISTINCT o_custkey) AS nodes, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders")
def snapshot_stats(orders):
    s = temporal.snapshot_stats(orders, "o_orderdate", "o_custkey")
    return s.select("snapshots", "nodes", F.date_format("first", "yyyy-MM-dd").alias("first"), F.date_format("last", "yyyy-MM-dd").alias("last"))


@query("customer", sql="""
    SELECT c_custkey, printf('%.2f', round(c_custkey % 1000 / 8.0::DOUBLE, 2)) AS amount, CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '-' END || printf('%.2f', round((c_custkey % 50 + 0.25)::DOUBLE, 2)) || '%' AS change,
      round(c_custkey % 10 * (1 - least(1.0, c_custkey % 7 / 5.0)) + 20 * least(1.0, c_custkey % 7 / 5.0), 6) + 0.0 AS settled, round((c_custkey - 10) / 40.0, 6) + 0.0 AS done,
      round(CASE WHEN c_custkey % 30 < 2 THEN c_custkey % 30 * 2 ELSE 4 + (c_custkey % 30 - 2) * 0.3 END::DOUBLE, 6) + 0.0 AS compressed, round(log10(c_custkey % 30 * 10 + 1) * 10, 6) + 0.0 AS logged FROM customer""")
def small_numbers(customer):
    """Labels of numbers, progress and display radii."""
    k = F.col("c_custkey")
    sign = F.when(k % 2 == 0, 1.0).otherwise(-1.0)
    radius = (k % 30).cast("double")
    return customer.select(
        "c_custkey", signals.fixed(k % 1000 / 8.0).alias("amount"), signals.signed_percent(sign * (k % 50 + 0.25)).alias("change"), r6(signals.converge((k % 10).cast("double"), F.lit(20.0), k % 7 / 5.0)).alias("settled"),
        r6(temporal.progress(k.cast("double"), F.lit(10.0), F.lit(50.0))).alias("done"), r6(astro.display_radius(radius, "compressed")).alias("compressed"), r6(astro.display_radius(radius, "log")).alias("logged"),
    )


@query("customer", sql="""
    SELECT c_custkey, abs(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: c + (((h * 32 + 2147483648) % 4294967296) + 4294967296) % 4294967296 - 2147483648 - h)) AS hash FROM customer""")
def material_hash(customer):
    return customer.select("c_custkey", hashing.hash_material(F.col("c_name")).alias("hash"))


@query("events", sql="""
    SELECT event_id, value > 50 AS above, value <= 20 AS below, false AS never, round(CASE WHEN value < 40 THEN least(1.0, value / 40.0) * 10 ELSE 10 + least(1.0, (value - 40) / 60.0) * 90 END, 6) + 0.0 AS bent FROM events WHERE value IS NOT NULL""")
def alert_conditions(events):
    v = F.col("value")
    d = events.filter("value is not null")
    return d.select("event_id", condition(v, ">", 50).alias("above"), condition(v, "<=", 20).alias("below"), condition(v, "~", 1).alias("never"), r6(scales.diverging("value", (0, 40, 100), (0, 10, 100))).alias("bent"))


@query("customer", sql="""
    WITH a AS (SELECT c_custkey AS id, c_acctbal AS x FROM customer) SELECT id, round(x + (CASE WHEN id % 3 = 0 THEN x ELSE x + 8 END - x) * 0.25, 6) + 0.0 AS x FROM a""")
def moved_positions(customer):
    """A quarter of the way; a third of the records have no target."""
    d = customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    target = d.filter("id % 3 <> 0").withColumn("x", F.col("x") + 8)
    return layouts.interpolate_positions(d, target, 0.25).select("id", r6("x").alias("x"))


@query("lineitem", sql="""
    SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity * 10 - 100 < 0 THEN (l_quantity * 10 - 100) / 800 * 0.9 WHEN l_quantity * 10 - 100 <= 200 THEN (l_quantity * 10 - 100) / 200 * 0.1 WHEN l_quantity * 10 - 100 <= 500 THEN 0.1 + (l_quantity * 10 - 100 - 200) / 300 * 0.4 END, 6) + 0.0 AS alpha
    FROM lineitem""")
def brain_alpha(lineitem):
    """Opacity of a scan's values by control points; below the first, the line from the first to the last goes on."""
    v = F.col("l_quantity") * 10 - 100
    return lineitem.select("l_orderkey", "l_linenumber", r6(domains.transfer(v, "mri-brain")["a"]).alias("alpha"))


@query("orders", sql="SELECT count(*) AS voxels, count(DISTINCT o_custkey) AS columns FROM orders WHERE month(o_orderdate) = 3")
def volume_slice(orders):
    d = orders.withColumn("z", F.month("o_orderdate"))
    return domains.slice_plane(d, "z", 3.7).agg(F.count("*").alias("voxels"), F.count_distinct("o_custkey").alias("columns"))
