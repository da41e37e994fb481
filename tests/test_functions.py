import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from luminal.functions import astro, color, dsl, hashing, predicates, scales
from luminal.operators import diff, graph, layouts, series, trees
from luminal.sources import csv, formats, records


@pytest.fixture(scope="module")
def record(spark):
    return spark.sql("select '1' id, 50000d revenue, 42d count, 'A' category, named_struct('value', 100, 'items', array(1, 2, 3)) nested")


@pytest.mark.parametrize("spec, want", [
    ({"$data": "revenue"}, 50000), ({"$data": "nested.value"}, 100), ({"$data": "nested.items.1"}, 2), ({"$data": "nested.items.9"}, None), (7, 7),
    ({"$data": "count", "$domain": [0, 100]}, 0.42), ({"$data": "revenue", "$domain": [0, 100]}, 1), ({"$data": "count", "$domain": [0, 100], "$range": [0, 10]}, 4.2),
    ({"$data": "category", "$map": {"from": ["A", "B"], "to": ["red", "blue"]}}, "red"), ({"$data": "category", "$map": {"from": ["A"], "to": []}}, "A"),
    ({"$data": "count", "$step": 5}, 40), ({"$data": "count", "$domain": [3, 3], "$range": [1, 2]}, 1),
])
def test_transforms(record, spec, want):
    got = record.select(dsl.compile_transform(spec)).first()[0]
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


def test_bad_domain():
    with pytest.raises(ValueError):
        dsl.compile_transform({"$data": "a", "$domain": [1]})


def test_expressions():
    assert dsl.parse_transform_expression("$data: count; $range: [0, 10]; noise; $step: 0.5; $name: 'x'") == {"$data": "count", "$range": [0, 10], "$step": 0.5, "$name": "x"}
    assert dsl.parse_transform_expression(3) == {}


def model(v, domain, rng, step):
    lo, hi = domain
    t = 0.0 if lo == hi else max(0.0, min(1.0, (v - lo) / (hi - lo)))
    out = rng[0] + t * (rng[1] - rng[0])
    import math

    return math.floor(out / step + 0.5) * step if step else out


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(v=st.integers(-500, 500), domain=st.tuples(st.integers(-50, 50), st.integers(-50, 50)), rng=st.tuples(st.integers(-9, 9), st.integers(-9, 9)), step=st.sampled_from([0, 0.5, 2]))
def test_compiler_is_the_model(spark, v, domain, rng, step):
    spec = {"$data": "v", "$domain": list(domain), "$range": list(rng), "$step": step}
    got = spark.range(1).select(F.lit(float(v)).alias("v")).select(dsl.compile_transform(spec)).first()[0]
    assert got == pytest.approx(model(v, domain, rng, step), abs=1e-9)


def test_colors(spark):
    row = spark.range(1).select(
        color.lerp(F.lit("#000000"), F.lit("#ffffff"), F.lit(0.5)).alias("mid"), color.lighten(F.lit("#000000"), 0.3).alias("light"), color.hsl_hex(F.lit(0.0), 0.7, 0.5).alias("red"),
        color.similarity_color(F.lit(0.9)).alias("high"), color.ramp(F.lit(0.75), "viridis").alias("ramp"), color.is_valid_color(F.lit("#12g")).alias("bad"), color.is_valid_color(F.lit("rgb(1, 2, 3)")).alias("good"),
        color.channels(F.lit("nonsense"))[0].alias("black"),
    ).first()
    assert tuple(row) == ("#808080", "#4d4d4d", "#d92626", "#00ffff", "rgb(118, 189, 122)", False, True, 0)


def js_hash(s):
    h = 0
    for c in s:
        h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
    return abs(h)


def test_hashes(spark):
    words = ["", "a", "hello world", "Zebra-12345", "x" * 60]
    rows = spark.createDataFrame([(w,) for w in words], "s string").select("s", hashing.hash_string(F.col("s")).alias("h")).collect()
    assert [r.h for r in rows] == [js_hash(r.s) for r in rows]


def test_predicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, s string")
    ids = lambda c: [r.id for r in predicates.query(df, c).orderBy("id").collect()]
    assert ids({"s": {"$nin": ["a"]}}) == [2, 3] and ids({"s": {"$exists": False}}) == [2] and ids({"id": 3}) == [3] and ids({"$or": [{"id": 1}, {"s": "b"}]}) == [1, 3]
    assert predicates.find_one(df, {"id": {"$gte": 2}}).count() == 1
    with pytest.raises(ValueError):
        ids({"id": {"$near": 1}})


@pytest.mark.parametrize("text, columns, first", [
    ("name,age,city\nJohn,30,NYC\nJane,25,LA", ["name", "age", "city"], ("John", 30.0, "NYC")),
    ('name,description\n"Smith, John","A person, who codes"', ["name", "description"], ("Smith, John", "A person, who codes")),
    ("name;age\nJohn;30\n\nJane;25", ["name", "age"], ("John", 30.0)),
    ('name,description\nx,"Line 1\nLine 2"', ["name", "description"], ("x", "Line 1\nLine 2")),
    ("a,b,c\n1,x", ["a", "b", "c"], (True, "x", None)),
])
def test_csv(spark, text, columns, first):
    df = csv.parse_csv(spark, text)
    assert df.columns == columns and tuple(df.first()) == first


def test_csv_files(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1.5, None), ('q"q', 2.0, "z")], "name string, n double, z string")
    csv.write_csv(df.coalesce(1), str(tmp_path / "out"))
    back = csv.read_csv(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    assert csv.detect_delimiter('"a,b,c";d\n') == ";" and csv.detect_delimiter("plain") == ","
    with pytest.raises(TypeError):
        csv.parse_csv(spark, 5)
    assert csv.parse_csv(spark, "  ").count() == 0


def test_formats(spark):
    fix = spark.createDataFrame([("8=FIX|35=D|11=1|11=2|54=1|38=x|44=2.5|58=a=b|40=2",)], "message string")
    r = formats.fix_records(fix).first()
    assert (r.id, r.msg_type, r.side, r.quantity, r.price, r.order_type) == ("2", "NewOrderSingle", "BUY", 0.0, 2.5, "LIMIT")
    assert fix.select(formats.fix_tags(F.col("message"))).first()[0] == {"8": "FIX", "35": "D", "11": "2", "54": "1", "38": "x", "44": "2.5", "58": "a", "40": "2"}
    lines = ["ATOM      1  CA  ALA A   1      11.104   6.134  -6.504  0.00 10.00           C", "HETATM    2  O   HOH B   2       1.000   2.000   3.000", "CONECT    1    2    x"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    atoms = formats.pdb_atoms(df).orderBy("serial").collect()
    assert (atoms[0].x, atoms[0].occupancy, atoms[0].element, atoms[1].element) == (11.104, 1.0, "C", "O")
    assert [tuple(r) for r in formats.pdb_connections(df).collect()] == [(1, [2])]
    mesh = spark.createDataFrame([([0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0], [0, 1, 2, 65535, 65535, 65535, 0, 1, 65535, 65535, 65535, 65535])], "verts array<double>, polys array<int>")
    v, p = formats.navmesh(mesh)
    assert v.count() == 3 and [tuple(r) for r in p.collect()] == [(0, [0, 1, 2])]


def test_records(spark):
    df = spark.sql("select named_struct('a', 1) x, array(named_struct('id', 1), named_struct('id', 2)) nodes")
    assert records.extract_records(df).count() == 2
    reg, heard = records.Registry(spark), []
    reg.on(lambda e, n: heard.append((e, n)))
    reg.load("one", [{"id": 1}])
    reg.load("two", [{"id": 2}])
    assert reg.get().first().id == 2 and reg.switch("one").first().id == 1 and heard[-1] == ("dataset-switched", "one")
    with pytest.raises(KeyError):
        reg.switch("none")
    with pytest.raises(ValueError, match="geometry.*;.*colour|id.*geometry"):
        records.validate_spec({"geometry": {"type": "blob"}, "material": {"properties": {"color": "#1"}}})
    assert {k: records.sample(spark, k, 13).count() for k in ("network", "timeline", "hierarchy", "random")} == dict.fromkeys(("network", "timeline", "hierarchy", "random"), 13)


def test_diff_round_trip(spark):
    old = spark.createDataFrame([(1, 100), (2, 200), (3, 300)], "id int, value int")
    new = spark.createDataFrame([(1, 150), (2, 200), (4, 400)], "id int, value int")
    d = diff.diff(old, new)
    assert sorted((r.id, r.op) for r in d.collect()) == [(1, "update"), (3, "remove"), (4, "add")]
    assert diff.diff(diff.apply(old, d), new).count() == 0


def test_layout_needs_order(spark):
    with pytest.raises(ValueError):
        layouts.calculate(spark.range(3), "grid", [])
    layouts.register("mine", lambda df, order: df.withColumn("x", F.lit(1.0)))
    assert layouts.calculate(spark.range(3), "mine", ["id"]).first().x == 1.0
    assert layouts.calculate(spark.range(0), "grid", ["id"]).count() == 0


def test_tree_cycle(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (8, 9), (9, 8)], "id int, parent int")
    assert sorted((r.id, r.depth) for r in trees.depths(df).collect()) == [(1, 0), (2, 1), (3, 2)]


def test_islands_and_runs(spark):
    df = spark.createDataFrame([("a", i) for i in (1, 2, 3, 4, 7, 9, 10, 11, 12)], "chain string, n int")
    assert sorted((r["first"], r["last"]) for r in series.islands(df, ["chain"], "n").collect()) == [(1, 4), (9, 12)]


def test_islands_sort_without_hashing_all_rows(spark):
    df = spark.createDataFrame([("a", n) for n in (5, 1, 2, 2, 3, 9, 9, 7, 8, 12)] + [("b", 4), ("b", None), (None, 1), (None, 2)], "chain string, n int")
    got = lambda least: sorted((r.chain or "", r["first"], r["last"], r.n) for r in series.islands(df, ["chain"], "n", least).collect())
    assert got(2) == [("", 1, 2, 2), ("a", 1, 3, 3), ("a", 7, 9, 3)]
    assert got(1) == sorted(got(2) + [("a", 5, 5, 1), ("a", 12, 12, 1), ("b", 4, 4, 1)])
    plan = series.islands(df, ["chain"], "n", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and plan.count("Filter") >= 2


def test_ecs(spark):
    e = spark.createDataFrame([(1, ["pos", "vel"]), (2, ["pos"])], "id int, components array<string>")
    s = spark.createDataFrame([("move", ["pos", "gone"])], "name string, queries array<string>")
    nodes, edges = graph.ecs_graph(e, s)
    assert edges.count() == 5 and {r.id: r.entities for r in nodes.filter("kind = 'component'").collect()} == {"component:pos": 2, "component:vel": 1, "component:gone": 0}


def test_kepler(spark):
    p = astro.planet_position(F.lit(0.0), F.lit(1.0), F.lit(0.017), 1.0)
    row = spark.range(1).select(p["x"].alias("x"), p["y"].alias("y")).first()
    assert row.x == pytest.approx(0.983) and row.y == pytest.approx(0)
    assert spark.range(1).select(scales.quantize(F.lit(99.0), (0, 10), ["a", "b"])).first()[0] == "b"


def test_validate_command(tmp_path, capsys):
    from luminal.__main__ import main

    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('{"nodes": [{"id": 1}]}')
    bad.write_text('[{"value": 1}, 3]')
    assert main(["validate", str(good)]) == 0 and main(["validate", str(bad)]) == 1 and main(["validate", str(tmp_path / "none")]) == 1 and main([]) == 2
    assert "record 1 is no object" in capsys.readouterr().out


def test_labels(spark):
    from luminal.functions import signals

    row = spark.range(1).select(signals.signed_percent(F.lit(2.345)), signals.signed_percent(F.lit(-0.5)), signals.fixed(F.lit(1234.5), 1), signals.similarity_band(F.lit(0.5))).first()
    assert tuple(row) == ("+2.35%", "-0.50%", "1234.5", "#ffff00")
