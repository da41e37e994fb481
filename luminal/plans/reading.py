"""Records written and read again in the formats of the sources, and calls that go from records to a scene."""

from __future__ import annotations

from pyspark.sql import functions as F

from luminal import api
from luminal.functions import astro, color, scales
from luminal.functions.dsl import create_scale, parse_transform_expression, transform_fields, transform_records
from luminal.operators import domains, temporal
from luminal.plans.book import query, r6
from luminal.plans.placement import MESH, mesh
from luminal.plans.stored import folder
from luminal.sources import csv, records


@query("orders", sql="""
    SELECT o_orderkey AS key, CASE o_orderkey % 4 WHEN 0 THEN 'a, "b"' WHEN 1 THEN 'line' || chr(10) || 'two' WHEN 2 THEN NULL ELSE o_orderpriority END AS note, o_totalprice AS price, o_orderkey % 2 = 0 AS even, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def csv_round_trip(orders):
    """Quotes, commas, line breaks and nulls; the types are told from the cells."""
    k = F.col("o_orderkey")
    note = F.when(k % 4 == 0, 'a, "b"').when(k % 4 == 1, "line\ntwo").when(k % 4 == 3, F.col("o_orderpriority"))
    path = folder(orders.sparkSession, "csv")
    csv.write_csv(orders.select(k.alias("key"), note.alias("note"), F.col("o_totalprice").alias("price"), (k % 2 == 0).alias("even"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("day")), path)
    d = csv.read_csv(orders.sparkSession, path)
    return d.select(F.col("key").cast("long").alias("key"), "note", "price", "even", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("orders", sql="SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders")
def json_envelopes(orders):
    """Records in envelopes of a hundred, as JSON, one file read as many."""
    spark, path = orders.sparkSession, folder(orders.sparkSession, "json")
    row = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    orders.groupBy(F.floor(F.col("o_orderkey") / 100).alias("part")).agg(F.collect_list(row).alias("records")).write.json(path)
    return records.extract_records(spark.read.json(path)).select("id", "status", "price")


@query("customer", sql="SELECT c_custkey::VARCHAR AS des, c_name AS name, c_acctbal::VARCHAR AS h FROM customer")
def column_feed(customer):
    """A column-wise feed of rows of texts, by the names of its fields."""
    feed = customer.groupBy(F.floor(F.col("c_custkey") / 50)).agg(F.collect_list(F.array(F.col("c_custkey").cast("string"), "c_name", F.col("c_acctbal").cast("string"))).alias("data"))
    return records.field_table(feed, ["des", "name", "h"])


@query("nation", "region", sql="SELECT n_name AS name, r_name AS region, count(*) OVER () AS count, 'nations' AS title FROM nation JOIN region ON n_regionkey = r_regionkey")
def json_export(nation, region):
    """An export's records beside its facts."""
    spark, path = nation.sparkSession, folder(nation.sparkSession, "export")
    records.export(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("region")), path, title="nations")
    return spark.read.json(f"{path}/records").join(F.broadcast(spark.read.json(f"{path}/meta")), F.lit(True)).select("name", "region", "count", "title")


@query("customer", sql="""
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 0 ELSE 1 + c_custkey % 2 END AS pairs, CASE WHEN c_custkey % 3 = 2 THEN 0.0 ELSE c_custkey % 7 END::DOUBLE AS longest FROM customer""")
def pair_messages(customer):
    """Persistence pairs from JSON; a third of the messages cannot be read."""
    k = F.col("c_custkey")
    one = F.concat(F.lit('{"dimension":1,"birth":0,"death":'), (k % 7).cast("string"), F.lit(',"persistence":'), (k % 7).cast("string"), F.lit("}"))
    text = F.when(k % 3 == 2, "{broken").otherwise(F.concat(F.lit("["), F.concat_ws(",", one, F.when(k % 2 == 1, F.lit('{"dimension":0,"birth":0,"death":0,"persistence":0}'))), F.lit("]")))
    p = records.from_pairs_json(text)
    return customer.select(k, F.size(p).cast("long").alias("pairs"), F.coalesce(F.array_max(F.transform(p, lambda x: x["persistence"])), F.lit(0.0)).alias("longest"))


@query("customer", "nation", sql="SELECT 'nations' AS current, n_nationkey AS key FROM nation")
def registry_switch(customer, nation):
    """Datasets by name: the one that is switched to is the current one."""
    seen = []
    r = records.Registry(customer.sparkSession)
    r.on(lambda event, name: seen.append(event))
    r.load("registry_customers", customer)
    r.load("registry_nations", nation)
    r.switch("registry_customers")
    r.switch("registry_nations")
    assert seen == ["dataset-loaded"] * 2 + ["dataset-switched"] * 2
    return r.get().select(F.lit(r.current.removeprefix("registry_")).alias("current"), F.col("n_nationkey").alias("key"))


@query("customer", sql="""
    WITH r AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS ord, min(coalesce(v, 0)) OVER () AS lo, max(coalesce(v, 0)) OVER () AS hi FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS v, CASE WHEN c_custkey % 7 > 0 THEN c_name END AS name FROM customer))
    SELECT c_custkey AS key, coalesce(name, 'item-' || ord) AS id, coalesce(v, 0) AS value, coalesce(name, 'item-' || ord) AS label, round(0.5 + (coalesce(v, 0) - lo) / (hi - lo) * 1.5, 6) AS size FROM r""")
def quick_start_bars(customer):
    """From records, some without a value or a name, to placed and sized ones."""
    k = F.col("c_custkey")
    d = customer.select(k.alias("key"), F.when(k % 5 > 0, F.col("c_acctbal")).alias("value"), F.when(k % 7 > 0, F.col("c_name")).alias("id"))
    return api.quick_start(customer.sparkSession, d, type="bar", order=["key"]).select("key", "id", "value", "label", r6("size").alias("size"))


@query("customer", sql="""
    WITH t AS (SELECT c_custkey, least(1, greatest(0, (c_acctbal + 1000) / 11000)) AS t FROM customer)
    SELECT c_custkey, round(1 + t * 4, 6) AS size, round(10 - t * 10, 6) + 0.0 AS depth FROM t""")
def written_transforms(customer):
    """Transforms written as text, several fields at once, and a scale of one's own."""
    spec = parse_transform_expression("$data: c_acctbal; $domain: [-1000, 10000]; $range: [1, 5]")
    d = transform_fields(customer.select("c_custkey", "c_acctbal"), {"size": spec, "depth": {"$data": "c_acctbal", "$domain": [-1000, 10000], "$range": [10, 0]}})
    return d.select("c_custkey", r6("size").alias("size"), r6("depth").alias("depth"))


@query("customer", sql="SELECT round(1 + least(1, greatest(0, (c_acctbal + 1000) / 11000)) * 4, 6) AS value FROM customer")
def transformed_records(customer):
    return transform_records(customer, {"$data": "c_acctbal", "$domain": [-1000, 10000], "$range": [1, 5]}).select(r6("value").alias("value"))


@query("customer", sql="""
    SELECT c_custkey, round(CASE WHEN c_custkey % 90 < 2 THEN c_custkey % 90 * 2.0 ELSE 4 + (c_custkey % 90 - 2) * 0.3 END::DOUBLE, 6) AS compressed, round((c_custkey % 90 * 100)::DOUBLE, 6) AS actual, c_acctbal >= 0 AS up,
      round(100 + least(1, greatest(0, (c_acctbal + 1000) / 11000)) * -50, 6) AS own FROM customer""")
def radii_and_signs(customer):
    k = F.col("c_custkey") % 90
    own = create_scale((-1000, 10000), (100, 50))
    return customer.select(
        "c_custkey", r6(astro.display_radius(k.cast("double"), "compressed")).alias("compressed"), r6(astro.display_radius(k.cast("double"), "actual")).alias("actual"), (color.sign_color(F.col("c_acctbal")) == color.DEFAULT).alias("up"), r6(own(F.col("c_acctbal"))).alias("own")
    )


@query("customer", sql=f"""
    WITH {MESH}, f AS (SELECT id, (x1 + x2 + x3 + x4) / 4 AS cx, (z1 + z2 + z3 + z4) / 4 AS cz FROM p) SELECT min(id) AS poly_id FROM f WHERE sqrt((cx - 7.3) * (cx - 7.3) + (cz - 1.2) * (cz - 1.2)) < 2""")
def containing_polygon(customer):
    return domains.containing_polygon(domains.polygon_facts(*mesh(customer)), 7.3, 1.2)


@query("events", sql="""
    WITH e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, min(value) AS value FROM events WHERE value IS NOT NULL GROUP BY ALL), p AS (SELECT u.user_id, 1704067200.0::DOUBLE + i * 86400 AS t FROM (SELECT DISTINCT user_id FROM e) u, range(31) r(i)),
    b AS (SELECT p.*, e.t AS t1, e.value AS v1 FROM p ASOF LEFT JOIN e ON p.user_id = e.user_id AND p.t >= e.t), c AS (SELECT b.*, e.t AS t2, e.value AS v2 FROM b ASOF LEFT JOIN e ON b.user_id = e.user_id AND b.t <= e.t)
    SELECT user_id, t, round(CASE WHEN t1 IS NULL THEN v2 WHEN t2 IS NULL THEN v1 WHEN t1 = t2 THEN v1 ELSE v1 + (v2 - v1) * (t - t1) / (t2 - t1) END, 4) + 0.0 AS value FROM c""")
def replayed(events):
    """The values of every user at each midnight of a month."""
    e = events.filter("value is not null").groupBy("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")).agg(F.min("value").alias("value"))
    d = temporal.replay(events.sparkSession, e, 1704067200.0, 1704067200.0 + 30 * 86400, 86400.0, ["user_id"], "t")
    return d.select("user_id", "t", r6("value", 4).alias("value"))


@query("supplier", sql="""
    SELECT s_suppkey AS id, p AS particle, round(((s_suppkey % 10) + p * 0.7)::DOUBLE, 6) AS age FROM supplier, range(6) r(p) WHERE (s_suppkey % 10) + p * 0.7 < 8.05""")
def particles(supplier):
    """Six particles of each emitter; those beyond their life have gone."""
    d = supplier.select(F.col("s_suppkey").alias("id"))
    age = F.col("id") % 10 + F.col("particle") * 0.7
    return domains.emit_particles(d, 6, 8.05, age).select("id", F.col("particle").cast("long").alias("particle"), r6("age").alias("age"))


@query("customer", sql="SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal < 5000 THEN 'middle' ELSE 'high' END AS band, round(CASE WHEN c_acctbal <= 1000 THEN (c_acctbal + 1000) / 2000 * 0.5 ELSE 0.5 + (c_acctbal - 1000) / 9000 * 0.5 END + 1e-8, 6) + 0.0 AS share FROM customer")
def bands_and_lines(customer):
    b = F.col("c_acctbal")
    return customer.select("c_custkey", scales.threshold(b, [0, 5000], ["low", "middle", "high"]).alias("band"), r6(scales.piecewise(b, [(-1000, 0.0), (1000, 0.5), (10000, 1.0)]) + 1e-8).alias("share"))
