"""Transforms, scales, colours, predicates and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from luminal.functions import astro, color, hashing, scales, signals, vectors
from luminal.functions.dsl import compile_transform, label, parse_transform_expression, transform_fields
from luminal.functions.predicates import query as where
from luminal.operators import domains, mapping
from luminal.plans.book import query, r6
from luminal.sources import csv, formats, records

LINE = ("l_orderkey", "l_linenumber")
HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split({s}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (((h * 31 + c + 2147483648) % 4294967296) + 4294967296) % 4294967296 - 2147483648)"
HEX = "'#' || lpad(lower(to_hex(floor({r} + 0.5)::BIGINT)), 2, '0') || lpad(lower(to_hex(floor({g} + 0.5)::BIGINT)), 2, '0') || lpad(lower(to_hex(floor({b} + 0.5)::BIGINT)), 2, '0')"
UNIT = "greatest(0.0, least(1.0, ({v}) / {d}))"


@query("lineitem", sql=f"""
    SELECT l_orderkey, l_linenumber, floor((0.5 + {UNIT.format(v='l_extendedprice - 900', d='104050.0')} * 1.5) / 0.25 + 0.5) * 0.25 AS size FROM lineitem""")
def dsl_scale_step(lineitem):
    return lineitem.select(*LINE, compile_transform({"$data": "l_extendedprice", "$domain": [900, 104950], "$range": [0.5, 2], "$step": 0.25}).alias("size"))


@query("orders", sql="SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'green' WHEN 'O' THEN 'blue' ELSE o_orderstatus END AS color FROM orders")
def dsl_map_discrete(orders):
    return orders.select("o_orderkey", compile_transform({"$data": "o_orderstatus", "$map": {"from": ["F", "O"], "to": ["green", "blue"]}}).alias("color"))


@query("events", sql=f"""
    WITH e AS (SELECT event_id, {UNIT.format(v='value', d='300.0')} AS t FROM events)
    SELECT event_id, round(10 * CASE WHEN t < 0.5 THEN 4*t*t*t ELSE 1 - pow(-2*t+2, 3)/2 END, 9) + 0.0 AS both_ways, round(10*t*t, 9) + 0.0 AS ease_in, round(10*(1-(1-t)*(1-t)), 9) + 0.0 AS ease_out, round(10*t, 9) + 0.0 AS linear FROM e""")
def dsl_ease_family(events):
    spec = lambda name: r6(compile_transform({"$data": "value", "$domain": [0, 300], "$range": [0, 10], "$interpolate": name}), 9)
    return events.select("event_id", spec("ease").alias("both_ways"), spec("ease-in").alias("ease_in"), spec("ease-out").alias("ease_out"), spec("none").alias("linear"))


@query("lineitem", sql="""
    SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(1.0, l_discount / 0.1)), 6) + 0.0 AS l_discount, round(1 + greatest(0.0, least(1.0, (l_quantity - 1) / 49.0)) * 4, 6) + 0.0 AS height, 'bar' AS kind FROM lineitem""")
def dsl_multi_fields(lineitem):
    height = parse_transform_expression("$data: l_quantity; $domain: [1, 50]; $range: [1, 5]")
    out = transform_fields(lineitem.select(*LINE, "l_discount", "l_quantity"), {"l_discount": {"$data": "l_discount", "$domain": [0, 0.1]}, "height": height, "kind": "bar"})
    return out.select(*LINE, r6("l_discount").alias("l_discount"), r6("height").alias("height"), "kind")


@query("events", sql="SELECT event_id, user_id, event_type FROM events WHERE value > 40 AND value <= 90 AND event_type IN ('click', 'view', 'purchase') AND user_id <> 3 AND props IS NOT NULL")
def predicate_ops(events):
    return where(events, {"value": {"$gt": 40, "$lte": 90}, "event_type": {"$in": ["click", "view", "purchase"]}, "user_id": {"$ne": 3}, "props": {"$exists": True}}).select("event_id", "user_id", "event_type")


@query("events", sql="SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 50")
def json_path(events):
    return events.select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k")).filter("k >= 50")


@query("lineitem", sql="SELECT CASE WHEN l_discount < 0.05 THEN 'hazardous' WHEN l_discount < 0.1 THEN 'close' ELSE 'safe' END AS hazard_class, count(*) AS n, round(avg(l_quantity), 4) AS mean_quantity FROM lineitem GROUP BY 1")
def hazard_class_counts(lineitem):
    return lineitem.groupBy(astro.hazard_class(F.col("l_discount")).alias("hazard_class")).agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean_quantity"))


@query("events", sql="SELECT event_type, CASE WHEN value > 80 THEN 'critical' WHEN value > 72 THEN 'warning' ELSE 'normal' END AS status, count(*) AS n FROM events GROUP BY ALL")
def status_threshold(events):
    return events.groupBy("event_type", mapping.sensor_status(F.col("value"), 80.0).alias("status")).agg(F.count("*").alias("n"))


@query("customer", sql="""
    SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(0.1 + greatest(0.0, least(1.0, (log10(c_acctbal) - 1) / 3.0)) * 1.9, 6) ELSE 0.1 END AS size FROM customer""")
def log_size(customer):
    return customer.select("c_custkey", r6(scales.log_scale("c_acctbal", (10, 10000), (0.1, 2.0))).alias("size"))


@query("part", sql="SELECT ['low','mid','high','top'][CAST(least(3, greatest(0, floor((p_retailprice - 900) / 1200.0 * 4))) AS INT) + 1] AS bin, count(*) AS n FROM part GROUP BY 1")
def quantize_hist(part):
    return part.groupBy(scales.quantize("p_retailprice", (900, 2100), ["low", "mid", "high", "top"]).alias("bin")).agg(F.count("*").alias("n"))


_AT = "list_extract([{0}], CAST({1}(pos) AS INT) + 1)"
_P = "(" + _AT.format("{0}", "floor") + " + (" + _AT.format("{0}", "ceil") + " - " + _AT.format("{0}", "floor") + ") * (pos - floor(pos)))"


@query("events", sql=f"""
    WITH e AS (SELECT event_id, greatest(0.0, least(1.0, (value + 10) / 50.0)) * 3 AS pos FROM events)
    SELECT event_id, {HEX.format(r=_P.format('0,0,255,255'), g=_P.format('0,255,255,0'), b=_P.format('255,0,0,0'))} AS color FROM e""")
def heatmap_color(events):
    return events.select("event_id", color.domain_color(F.col("value"), "temperature", "continuous", None, F.col("event_id")).alias("color"))


@query("customer", sql=f"""
    SELECT c_custkey, abs({HASH.format(s='c_name')}) AS hash, ['#e41a1c','#377eb8','#4daf4a','#984ea3','#ff7f00','#ffff33'][CAST(abs({HASH.format(s='c_mktsegment')}) % 6 AS INT) + 1] AS color FROM customer""")
def hash_palette(customer):
    return customer.select("c_custkey", hashing.hash_string(F.col("c_name")).alias("hash"), color.domain_color(F.col("c_mktsegment"), None, "nominal", None, F.col("c_custkey")).alias("color"))


@query("supplier", sql=f"""
    WITH s AS (SELECT s_suppkey, (abs({HASH.format(s='s_name')}) % 360) / 360.0 AS h FROM supplier),
    c AS (SELECT s_suppkey, list_transform([h + 1/3.0, h, h - 1/3.0], lambda t: CASE WHEN t < 0 THEN t + 1 WHEN t > 1 THEN t - 1 ELSE t END) AS ts FROM s),
    v AS (SELECT s_suppkey, list_transform(ts, lambda t: 255 * CASE WHEN t < 1/6.0 THEN 0.15 + 0.7 * 6 * t WHEN t < 0.5 THEN 0.85 WHEN t < 2/3.0 THEN 0.15 + 0.7 * (2/3.0 - t) * 6 ELSE 0.15 END) AS c FROM c)
    SELECT s_suppkey, substr({HEX.format(r='c[1]', g='c[2]', b='c[3]')}, 1, 1) AS mark, round(c[1], 3) + 0.0 AS r FROM v""")
def hash_hue(supplier):
    c = color.hash_color(F.col("s_name"))
    h = (hashing.hash_string(F.col("s_name")) % 360) / 360.0 + 1 / 3
    t = F.when(h > 1, h - 1).otherwise(h)
    red = F.when(t < 1 / 6, 0.15 + 0.7 * 6 * t).when(t < 0.5, F.lit(0.85)).when(t < 2 / 3, 0.15 + 0.7 * (2 / 3 - t) * 6).otherwise(F.lit(0.15)) * 255
    return supplier.select("s_suppkey", F.substring(c, 1, 1).alias("mark"), r6(red, 3).alias("r"))


@query("customer", sql="""
    WITH c AS (SELECT c_custkey, greatest(0.0, least(1.0, (c_acctbal + 1000) / 11000.0)) AS w FROM customer)
    SELECT c_custkey, round((0.5 + w * 1.5) * (1 - w / 2), 6) + 0.0 AS size, round(greatest(0.3, (1 - w / 2) * (1 - w * 0.5)), 6) + 0.0 AS opacity, round(0.3 + coalesce(nullif(w, 0), 0.5) * 0.7, 6) + 0.0 AS glow, w > 0.8 AS animate FROM c""")
def opacity_scale(customer):
    w = scales.scale("c_acctbal", (-1000, 10000), (0, 1))
    d = customer.withColumn("w", w)
    return d.select("c_custkey", r6(mapping.size(F.col("w"), 1 - F.col("w") / 2)).alias("size"), r6(mapping.opacity(1 - F.col("w") / 2, F.col("w"))).alias("opacity"), r6(mapping.emissive_intensity(F.col("w"))).alias("glow"), (F.col("w") > 0.8).alias("animate"))


@query("nation", sql="""
    SELECT n_nationkey, n_name AS label, CASE WHEN n_regionkey = 0 THEN 'sphere' WHEN n_regionkey = 1 THEN 'cone' WHEN n_regionkey = 2 THEN 'dodecahedron' ELSE 'sphere' END AS geometry, n_name = 'CHINA' OR n_nationkey % 5 = 0 AS overridden FROM nation""")
def mapped_properties(nation):
    d = nation.withColumn("structure", scales.ordinal("n_regionkey", {0: "point", 1: "vector", 2: "graph"}, "other")).withColumn("mine", F.when((F.col("n_name") == "CHINA") | (F.col("n_nationkey") % 5 == 0), "#123456"))
    m = mapping.PropertyMapper()
    m.register("n_name", "label", lambda c: c)
    out = m.map(d, value="n_name", id_col="n_nationkey", scale="nominal", structure="structure", overrides={"color": F.col("mine")})
    return out.select("n_nationkey", "label", "geometry", (F.col("color") == "#123456").alias("overridden"))


@query("lineitem", sql="SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(1.0, (l_quantity - 40 + 200) / 400.0)), 6) + 0.0 AS h FROM lineitem")
def window_level(lineitem):
    return lineitem.select(*LINE, r6(mapping.window_level(F.col("l_quantity"), 40.0, 400.0)).alias("h"))


@query("events", sql="""
    WITH e AS (SELECT event_id, value * 10 - 1000 AS v FROM events),
    s AS (SELECT event_id, v, CASE WHEN v <= -600 THEN 1 WHEN v <= 40 THEN 2 WHEN v <= 200 THEN 3 WHEN v <= 1000 THEN 4 ELSE 5 END AS k FROM e)
    SELECT event_id,
      round(CASE k WHEN 1 THEN (v+1000)/400*0.8 WHEN 2 THEN 0.8+(v+600)/640*0.1 WHEN 3 THEN 0.9+(v-40)/160*0.1 WHEN 4 THEN 1.0 ELSE (v+1000)/2000 END, 9) + 0.0 AS r,
      round(CASE k WHEN 1 THEN (v+1000)/400*0.1 WHEN 2 THEN 0.1+(v+600)/640*0.1 WHEN 3 THEN 0.2+(v-40)/160*0.6 WHEN 4 THEN 0.8+(v-200)/800*0.2 ELSE (v+1000)/2000 END, 9) + 0.0 AS a FROM s""")
def transfer_function(events):
    c = domains.transfer(F.col("value") * 10 - 1000, "ct-bone")
    return events.select("event_id", r6(c["r"], 9).alias("r"), r6(c["a"], 9).alias("a"))


@query("customer", sql="""
    SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN '#00d4aa' ELSE '#ff3864' END AS sign, ['#1f77b4','#ff7f0e','#2ca02c','#d62728','#9467bd','#8c564b','#e377c2','#7f7f7f','#bcbd22','#17becf'][ascii(c_mktsegment) % 10 + 1] AS letter,
      'rgb(' || floor(t*50 + 0.5)::BIGINT || ', ' || floor(t*100 + 0.5)::BIGINT || ', ' || floor(150 + t*105 + 0.5)::BIGINT || ')' AS blues,
      'rgb(255,' || floor(100 + t*155)::BIGINT || ',' || floor(t*100)::BIGINT || ')' AS warm
    FROM (SELECT *, greatest(0.0, least(1.0, (c_acctbal + 1000) / 11000.0)) AS t FROM customer)""")
def color_ramps(customer):
    d = customer.withColumn("t", scales.scale("c_acctbal", (-1000, 10000), (0, 1)))
    return d.select("c_custkey", color.transform_color(F.col("c_acctbal"), "diverging-rdgy").alias("sign"), color.transform_color(F.col("c_mktsegment"), "category10").alias("letter"), color.transform_color(F.col("t"), "blues").alias("blues"), color.material_color(F.col("t"), "warm").alias("warm"))


@query("nation", sql="SELECT n_nationkey, 'Nation ' || n_name || ' in ' || CASE WHEN n_regionkey = 0 THEN '{n_regionkey}' ELSE n_regionkey::VARCHAR END || ' {missing}' AS label FROM nation")
def label_template(nation):
    return nation.select("n_nationkey", label("Nation {n_name} in {n_regionkey} {missing}", nation).alias("label"))


@query("embeddings", sql="SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS similarity FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def cosine_to_one(embeddings):
    one = embeddings.filter("vec_id = 0").select(F.col("embedding").alias("b"))
    return embeddings.join(F.broadcast(one), F.lit(True)).select("vec_id", r6(vectors.cosine(F.col("embedding"), F.col("b"))).alias("similarity"))


@query("embeddings", sql="""
    SELECT vec_id, 'rgb(' || greatest(0, least(255, floor((embedding[1]::DOUBLE + 1) * 127.5)))::BIGINT || ', ' || greatest(0, least(255, floor((embedding[2]::DOUBLE + 1) * 127.5)))::BIGINT || ', ' || greatest(0, least(255, floor((embedding[3]::DOUBLE + 1) * 127.5)))::BIGINT || ')' AS color FROM embeddings""")
def embedding_colors(embeddings):
    return embeddings.select("vec_id", color.embedding_color(F.col("embedding")).alias("color"))


@query("orders", sql="""
    WITH o AS (SELECT o_orderkey, (o_orderkey % 1000) / 10.0 AS m FROM orders), e0 AS (SELECT *, m AS e FROM o)
    SELECT o_orderkey, round(1.524 * (1 - 0.093 * cos(e5)), 6) + 0.0 AS distance FROM (
      SELECT o_orderkey, m2 + 0.093 * sin(m2 + 0.093 * sin(m2 + 0.093 * sin(m2 + 0.093 * sin(m2 + 0.093 * sin(m2))))) AS e5 FROM (SELECT o_orderkey, (2 * pi() * m / 1.881) % (2 * pi()) AS m2 FROM e0))""")
def kepler(orders):
    a, e, period, _, _ = astro.PLANETS["Mars"]
    p = astro.planet_position((F.col("o_orderkey") % 1000) / 10.0, F.lit(a), F.lit(e), period)
    return orders.select("o_orderkey", r6(p["distance"]).alias("distance"))


@query("region", sql="""
    WITH t AS (SELECT r_regionkey, i, 2 * pi() * i / 100.0 % (2 * pi()) AS m FROM region, range(101) s(i)),
    s AS (SELECT *, m + 0.3 * sin(m + 0.3 * sin(m + 0.3 * sin(m + 0.3 * sin(m + 0.3 * sin(m + 0.3 * sin(m + 0.3 * sin(m + 0.3 * sin(m + 0.3 * sin(m + 0.3 * sin(m)))))))))) AS e FROM t)
    SELECT r_regionkey, i, round((r_regionkey + 1) * (cos(e) - 0.3), 5) + 0.0 AS x, round((r_regionkey + 1) * sqrt(1 - 0.09) * sin(e) * cos(radians(10)), 5) + 0.0 AS y FROM s""")
def orbit_points(region):
    d = region.select("r_regionkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(100).cast("long"))).alias("i"))
    p = astro.inclined_position(F.col("i"), F.col("r_regionkey") + 1, F.lit(0.3), 100.0, F.lit(10.0))
    return d.select("r_regionkey", "i", r6(p["x"], 5).alias("x"), r6(p["y"], 5).alias("y"))


@query("orders", sql="""
    SELECT o_orderkey::VARCHAR AS id, 'ExecutionReport' AS msg_type, CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, round(o_totalprice, 2) AS price, CASE WHEN o_orderstatus = 'F' THEN 'FILLED' ELSE 'NEW' END AS status, 0.0 AS leaves_qty FROM orders""")
def fix_parse(orders):
    text = F.concat_ws("|", F.lit("8=FIX.4.4"), F.lit("35=8"), F.concat(F.lit("11="), F.lit("first")), F.concat(F.lit("11="), F.col("o_orderkey").cast("string")), F.when(F.col("o_orderkey") % 2 == 0, "54=1").otherwise("54=2"), F.concat(F.lit("44="), F.round("o_totalprice", 2).cast("decimal(20,2)").cast("string")), F.when(F.col("o_orderstatus") == "F", "39=2").otherwise("39=0"), F.lit("151=x=1"), F.lit("58="))
    return formats.fix_records(orders.select(text.alias("message"))).select("id", "msg_type", "side", "price", "status", "leaves_qty")


@query("orders", sql="""
    SELECT o_orderkey, round(date_diff('second', TIMESTAMP '2020-01-01', date_trunc('minute', o_orderdate)) / 86400.0, 6) + 0.0 AS days, round(CASE WHEN o_orderkey % 7 = 0 THEN 100.0 ELSE pow(10.0, (o_totalprice / 100000 - 15) / 2.5) * 140 END, 4) + 0.0 AS diameter FROM orders""")
def neo_dates(orders):
    d = orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MMM-dd HH:mm").alias("cd"), F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_totalprice") / 100000).cast("string")).alias("h"))
    return d.select("o_orderkey", r6(astro.days_since_2020(astro.parse_date(F.col("cd")))).alias("days"), r6(astro.diameter(F.col("h")), 4).alias("diameter"))


@query("customer", sql="""
    SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN (c_custkey % 8 = 0)::VARCHAR END AS flag, CASE WHEN c_custkey % 4 = 1 THEN c_custkey::DOUBLE WHEN c_custkey % 4 = 2 THEN 255.0 END AS number FROM customer""")
def csv_cells(customer):
    k = F.col("c_custkey")
    cell = F.when(k % 4 == 0, F.when(k % 8 == 0, "yes").otherwise("No")).when(k % 4 == 1, F.concat(F.lit(" "), k.cast("string"), F.lit(".0 "))).when(k % 4 == 2, "0xff").otherwise("a text")
    t = csv.typed(cell)
    return customer.select("c_custkey", t["boolean"].cast("string").alias("flag"), F.when(t["boolean"].isNull(), t["double"]).alias("number"))


@query("nation", "region", sql='''
    SELECT n_nationkey || ';' || n_name || ';' || '"a ""' || r_name || '"""' || ';' AS line FROM nation JOIN region ON n_regionkey = r_regionkey''')
def csv_lines(nation, region):
    d = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.concat(F.lit('a "'), "r_name", F.lit('"')).alias("q"), F.lit(None).cast("string").alias("none"))
    return d.select(csv.csv_line(d, ";").alias("line"))


@query("events", sql="SELECT event_id, CASE WHEN event_id % 3 < 2 THEN user_id END AS user, CASE WHEN event_id % 3 < 2 THEN round(value, 3) END AS v FROM events")
def message_formats(events):
    raw = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("user_id").alias("user"), F.round("value", 3).alias("v")))).when(F.col("event_id") % 3 == 1, F.concat_ws(",", F.col("user_id").cast("string"), F.round("value", 3).cast("string"))).otherwise("noise")
    m = records.parse_message(raw, "user bigint, v double")
    return events.select("event_id", m["user"].alias("user"), m["v"].alias("v"))


@query("customer", sql="""
    WITH c AS (SELECT c_custkey, (c_custkey % 10) / 10.0 AS c FROM customer)
    SELECT c_custkey, round((1 - c) * 0.5, 6) + 0.0 AS pulse_range, round(1000 + (1 - c) * 2000, 6) AS pulse_period, (floor((1 - c) * 5) + 1)::INT AS ghosts, round((1 - c) * 10, 6) + 0.0 AS flicker_rate FROM c""")
def uncertainty_style(customer):
    u = mapping.uncertainty((F.col("c_custkey") % 10) / 10.0)
    return customer.select("c_custkey", r6(u["pulse_range"]).alias("pulse_range"), r6(u["pulse_period"]).alias("pulse_period"), u["ghosts"].alias("ghosts"), r6(u["flicker_rate"]).alias("flicker_rate"))


@query("orders", sql="""
    SELECT o_orderkey, round(greatest(0.2, 1 - date_diff('day', o_orderdate::DATE, DATE '2002-01-01') / 365.0), 6) + 0.0 AS confidence, round(0.1 + 0.2 / (1 + 0.1 * date_diff('day', o_orderdate::DATE, DATE '2002-01-01')), 6) + 0.0 AS size FROM orders""")
def memory_age(orders):
    m = mapping.memory_age(F.col("o_orderdate"), F.lit("2002-01-01").cast("date"))
    return orders.select("o_orderkey", r6(m["confidence"]).alias("confidence"), r6(m["size"]).alias("size"))


@query("lineitem", sql="""
    SELECT l_orderkey, l_linenumber, round(greatest(0.5, ln(l_extendedprice) / 5), 6) + 0.0 AS height, CASE WHEN l_discount >= 0.05 THEN '#00d4aa' ELSE '#ff3864' END AS color, round(greatest(0.02, log10(l_quantity / 10 + 1) / 10), 6) + 0.0 AS size FROM lineitem""")
def market_columns(lineitem):
    return lineitem.select(*LINE, r6(signals.column_height(F.col("l_extendedprice"))).alias("height"), color.sign_color(F.col("l_discount") - 0.05).alias("color"), r6(signals.point_size(F.col("l_quantity"))).alias("size"))


@query("customer", sql="""
    SELECT c_custkey, round(sqrt(pow(c_acctbal, 2) + pow(c_custkey, 2)), 5) + 0.0 AS length, round(degrees(atan2(c_acctbal, c_custkey)), 5) + 0.0 AS bearing,
      round(1 / (1 + c_custkey % 50 * 0.1) * cos(radians(c_custkey % 60)) * least(c_custkey % 900 / 500.0, 1.0), 6) + 0.0 AS gaze FROM customer""")
def roads_and_gaze(customer):
    k = F.col("c_custkey")
    length, bearing = signals.road(F.lit(0.0), F.lit(0.0), F.col("c_acctbal"), k.cast("double"))
    return customer.select("c_custkey", r6(length, 5).alias("length"), r6(bearing, 5).alias("bearing"), r6(signals.gaze_confidence(k % 50, k % 60, k % 900)).alias("gaze"))


@query("orders", sql="SELECT o_orderkey, round(r[1] + t * (r[2] - r[1]), 6) + 0.0 AS x, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 250000 THEN 'mid' ELSE 'high' END AS band FROM (SELECT *, [0.0, 50.0] AS r, greatest(0.0, least(1.0, (epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1993-01-01')) / (epoch_us(TIMESTAMP '1997-01-01') - epoch_us(TIMESTAMP '1993-01-01'))::DOUBLE)) AS t FROM orders)")
def time_and_threshold(orders):
    at = lambda d: F.lit(d).cast("timestamp")
    x = scales.time_scale("o_orderdate", at("1993-01-01"), at("1997-01-01"), (0, 50))
    return orders.select("o_orderkey", r6(x).alias("x"), scales.threshold("o_totalprice", [100000, 250000], ["low", "mid", "high"]).alias("band"))
