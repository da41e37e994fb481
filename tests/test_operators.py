import math
import random

import pytest
from pyspark.sql import functions as F

from luminal import api
from luminal.operators import aggregates, common, diff, domains, force, graph, layouts, mapping, series, spatial, temporal
from luminal.sources import formats, records
from luminal.streaming import stateful
from luminal.streaming.changelog import ChangeLog


@pytest.fixture(scope="module")
def cube(spark):
    """Points on a 4 x 4 x 4 grid."""
    i = F.col("id")
    return spark.range(64).select(i, (i % 4).cast("double").alias("x"), (F.floor(i / 4) % 4).cast("double").alias("y"), F.floor(i / 16).cast("double").alias("z"))


def test_cells_find_what_all_pairs_find(spark, cube):
    for r in (0.5, 1.0, 1.5):
        got = {(a.id, a.id2) for a in spatial.close_pairs(cube, r).collect()}
        p = [tuple(x) for x in cube.collect()]
        assert got == {(a[0], b[0]) for a in p for b in p if a[0] < b[0] and math.dist(a[1:], b[1:]) <= r}
    assert spatial.close_pairs(cube.limit(0), 1.0).count() == 0


def test_ordinal(spark):
    d = common.ordinal(spark.range(1000).withColumn("k", F.col("id") % 3), "k", F.desc("id"), count="n").orderBy("ord").collect()
    assert [r.ord for r in d] == list(range(1000)) and {r.n for r in d} == {1000}
    assert [(r.k, -r.id) for r in d] == sorted((r.k, -r.id) for r in d)


def test_molecules(spark):
    atoms = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.5, 0.0, 0.0), (3, 5.0, 0.0, 0.0)], "id int, x double, y double, z double")
    assert [(r.id, r.id2) for r in domains.bonds(atoms).collect()] == [(1, 2)]
    listed = spark.createDataFrame([(2, [1, 3]), (1, [2])], "serial int, bonded array<int>")
    assert sorted(tuple(r) for r in domains.listed_bonds(listed).collect()) == [(1, 2), (2, 3)]
    res = spark.createDataFrame([("A", i) for i in (1, 2, 3, 4)] + [("B", 5), ("B", 6)], "chain string, res_seq int")
    assert [(r.chain, r["first"], r["last"]) for r in domains.helices(res).collect()] == [("A", 1, 4)]
    r = domains.atom_records(atoms.withColumn("element", F.lit("cl"))).first()
    assert (r.color, r.radius) == ("#1FF01F", 0.175)


def test_paths(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 5), (0, 3), (3, 4), (4, 5), (7, 8)], "a int, b int")
    assert domains.polygon_path(e, 0, 5) == [0, 1, 2, 5] and domains.polygon_path(e, 0, 8) == []
    facts = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.5, 0.0)], "poly_id int, cx double, cz double")
    assert domains.containing_polygon(facts, 0.4, 0.0).first()[0] == 1 and domains.containing_polygon(facts, 9.0, 9.0).first()[0] is None


def test_volumes(spark):
    v = domains.sample_volume(spark, 16, 16, 2)
    assert v.count() == 512 and domains.slice_plane(v, "z", 1.7).count() == 256
    t = domains.transfer_table(spark, -1000, 1000).collect()
    assert len(t) == 256 and min(r.alpha for r in t) == 0.0 and max(r.alpha for r in t) == 1.0


def test_forces(spark, cube):
    one = cube.filter("id = 1")
    pull = one.select(*[c.alias(k) for k, c in domains.gravity_well((3, 0, 0), 2.0, 5.0).items()]).first()
    assert pull.fx == pytest.approx(2 / 4.01) and pull.fy == 0
    far = one.select(*[c.alias(k) for k, c in domains.explosion((9, 0, 0), 2.0, 5.0).items()]).first()
    assert far.fx == 0
    turn = one.select(*[c.alias(k) for k, c in domains.vortex((0, 0, 0), (0, 1, 0), 1.0, 4.0).items()]).first()
    assert turn.fz == pytest.approx(-0.75)
    up = spark.sql("select 0d y, 1d vx, 0d vy, 0d vz").select(*[c.alias(k) for k, c in domains.buoyancy(0.5, 2.0).items()]).first()
    assert up.fy == pytest.approx(9.81) and up.fx == pytest.approx(-0.1)
    pushed = domains.pair_forces(cube, 1.0, 1.0)
    assert pushed.count() == 64 and abs(pushed.agg(F.sum("fx")).first()[0]) < 1e-9
    charges = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0), (2, 0.5, 0.0, 0.0, -1.0)], "id int, x double, y double, z double, q double")
    assert {r.id: r.fx > 0 for r in domains.pair_forces(charges, 1.0, 1.0, charge="q").collect()} == {1: True, 2: False}
    balls = charges.withColumn("radius", F.lit(0.3))
    assert domains.collisions(balls, 0.6).count() == 1
    assert spatial.raycast(balls, (-5, 0, 0), (1, 0, 0)).first().hit == pytest.approx(4.7)
    cloud = domains.probability_cloud(charges.withColumn("u", F.lit(0.5)), "u")
    assert cloud.count() == 10 and cloud.filter("probability < 0 or probability > 1").count() == 0
    zones = spark.range(9).select("id", (F.col("id") % 3).cast("double").alias("x"), F.floor(F.col("id") / 3).cast("double").alias("z"))
    spots = spark.createDataFrame([(0.0, 0.0, 0.8), (2.0, 2.0, 0.6)], "x double, z double, load double")
    assert {r.id: r.heat for r in domains.heat_zones(zones, spots).collect()}[0] == pytest.approx(80)


def test_force_layout_brings_friends_together(spark):
    nodes = spark.range(8)
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in (0, 1, 2, 4, 5, 6)], "source long, target long, weight double")
    out = {r.id: (r.x, r.y, r.z) for r in force.force_layout(nodes, edges, ["id"], rounds=12).collect()}
    assert len(out) == 8 and all(math.isfinite(v) for p in out.values() for v in p)
    step = force.spring_step(nodes.select("id", *[F.col("id").cast("double").alias(a) for a in "xyz"], *[F.lit(0.0).alias("v" + a) for a in "xyz"]), edges)
    assert step.count() == 8


def test_force_layout_has_room_for_all_nodes(spark):
    nodes, none = spark.range(20_000), spark.createDataFrame([], "source long, target long, weight double")
    cells = force.force_layout(nodes, none, ["id"], rounds=0).groupBy(*[F.floor(a) for a in "xyz"]).count()
    held = [r["count"] for r in cells.collect()]  # a node meets those of its cell, however many nodes there are
    assert sum(held) == 20_000 and sum(n * n for n in held) / 20_000 < 3


def test_pushes_by_blocks_beside_pairs(spark, monkeypatch):
    monkeypatch.setattr(force, "PAIRS", 50)
    rng = random.Random(5)
    places = [(rng.gauss(0, 9), rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(600)] + [(1.0, 1.0, 1.0)] * 2 + [(-16.0, 16.0, 0.0), (-17.0, 16.0, 0.0), (1e6, 0.0, 0.0)]
    at = spark.createDataFrame([(f"n{i}", *p) for i, p in enumerate(places)], "id string, x double, y double, z double")
    want = {r.id: r for r in domains.pair_forces(at, 0.7, 0.7, power=1.0).collect()}
    got = {r.id: r for r in force._pushed(at, 0.7).collect()}
    assert got.keys() == want.keys() and all(got[k]["f" + a] == pytest.approx(want[k]["f" + a], rel=1e-6, abs=1e-6) for k in want for a in "xyz")


def test_time(spark):
    s = spark.createDataFrame([("a", 0.0, 0.0), ("a", 10.0, 100.0)], "k string, ts double, value double")
    assert [r.value for r in temporal.replay(spark, s, -5.0, 15.0, 5.0, ["k"]).orderBy("ts").collect()] == [0.0, 0.0, 50.0, 100.0, 100.0]
    assert temporal.snapshot_stats(s.withColumn("id", F.lit(1))).first().nodes == 1


def test_books(spark):
    snaps = spark.createDataFrame([("S", "bid", 1, [(10.0, 1.0)]), ("S", "bid", 2, [(11.0, 2.0), (9.0, 1.0)]), ("S", "ask", 1, [(12.0, 3.0)])], "symbol string, side string, ts int, levels array<struct<price:double,size:double>>")
    book = series.current_book(snaps)
    assert sorted(r.price for r in book.collect()) == [9.0, 11.0, 12.0]
    one = series.book_summary(book).first()
    assert (one.bid, one.ask, one.mid, one.spread) == (11.0, 12.0, 11.5, 1.0)
    none = series.book_summary(book.filter("side = 'ask' and size < 0")).collect()
    assert none == []
    walk = series.random_walk_value(spark.createDataFrame([("S", 1, 0.1), ("S", 2, -0.5)], "s string, t int, c double"), ["s"], "c", "t").orderBy("t").collect()
    assert walk[1].value == pytest.approx(0.55)


def test_changes(spark):
    rows = spark.createDataFrame([(1, 5, None), (2, 50, None), (3, 5, 60)], "id int, modified_at int, deleted_at int")
    assert sorted((r.id, r.op) for r in diff.changed_since(rows, 10).collect()) == [(2, "update"), (3, "delete")]
    m = diff.encode_deltas(spark.range(300).withColumn("op", F.lit("update")), 2)
    assert m.agg(F.sum("n")).first()[0] == 300 and m.agg(F.max("n")).first()[0] <= 2


def test_mapping(spark):
    df = spark.sql("select 1 id, 20d value, 0.9 importance, 0.5 confidence")
    m = mapping.PropertyMapper()
    m.register("value", "label", lambda c: c.cast("string"))
    r = m.map(df, kind="quantitative", domain="temperature", importance="importance", confidence="confidence").first()
    assert r.animate and r.label == "20.0" and r.opacity == 0.5 and r.emissive != r.color
    mat = df.select(*[c.alias(k) for k, c in mapping.material({"properties": {"opacity": 0.5, "color": {"$data": "value", "$map": "rdgy"}, "roughness": {"$data": "value", "$range": [0, 1], "$domain": [0, 40]}}}).items()]).first()
    assert mat.transparent and mat.color == "#00d4aa" and mat.roughness == 0.5
    t = df.select(*[c.alias(k) for k, c in mapping.transforms({"scale": {"$data": "value"}, "rotation": {"x": 1, "y": {"$data": "value"}}}).items()]).first()
    assert t.scale == pytest.approx(0.8) and (t.rotation_x, t.rotation_y, t.rotation_z) == (1.0, 20.0, 0.0) and t.position_x is None
    assert mapping.ghosts(df.withColumns({a: F.lit(0.0) for a in "xyz"}), "confidence").count() == 3


def test_topology(spark):
    schema = "semantics struct<type:string,structure:string,dimensions:int,embedding:array<double>>, relations struct<parent:string,links:array<struct<to:string,weight:double>>>, context struct<timestamp:long>"
    one = lambda kind, structure, parent=None: ((kind, structure, 1, None), (parent, None), (1,))
    detect = lambda rows, rule="shares": aggregates.detect_topology(spark.createDataFrame(rows, schema), rule).first().topology
    assert detect([one("x", "graph"), one("x", "graph"), one("x", "point")]) == "graph"
    assert detect([one("x", "tree"), one("x", "point")]) == "tree"
    assert detect([one("categorical", "point")]) == "grid" and detect([]) == "sphere"
    assert detect([one("x", "point", "p")], "links") == "tree-radial" and detect([one("temporal", "point")], "links") == "timeline-spiral"


def test_graphs(spark):
    n = spark.createDataFrame([("a", [("b", 2.0, "t")]), ("b", None), ("c", [("z", None, None)])], "id string, links array<struct<to:string,weight:double,type:string>>")
    e = graph.edges_of(n)
    assert sorted((r.source, r.target, r.weight) for r in e.collect()) == [("a", "b", 2.0), ("c", "z", 1.0)]
    at = n.select("id").withColumns({"x": F.ascii("id").cast("double"), "y": F.lit(0.0), "z": F.lit(0.0)})
    assert [r.length for r in api.connect(e, at, color="red").collect()] == [1.0]
    assert graph.connections(spark.createDataFrame([("a", "b", None, None), (None, None, "c", "d")], "`from` string, `to` string, source string, target string")).count() == 2
    near = spark.createDataFrame([(1, [2, 3]), (2, [1]), (3, [])], "id int, neighbors array<int>")
    assert sorted(tuple(r) for r in graph.neighbour_edges(near).collect()) == [(1, 2), (1, 3)]


def test_facade(spark, tmp_path):
    out = api.quick_start(spark, [5, 10, 20])
    assert out.count() == 3 and {"x", "y", "z", "size", "color", "label"} <= set(out.columns)
    assert sorted(r.size for r in out.collect())[-1] == 2.0
    assert api.preset(spark, "timeline", [{"id": "a", "value": 1.0}, {"id": "b", "value": None}]).count() == 2
    made = api.create({"id": "s", "transform": {"position": {"$layout": "radial"}, "scale": 2}}, spark.range(4), ["id"])
    assert made.first().t_scale == 2.0
    eng = api.Engine(spark)
    eng.datasets.load("d", spark.range(5).withColumn("value", F.col("id") * 1.0))
    assert eng.layout("grid", ["id"]).count() == 5 and eng.stats()["records"] == 5 and eng.select({"id": {"$lt": 2}}).filter("selected").count() == 2
    assert eng.map(kind="quantitative").count() == 5
    scene = api.Scene()
    scene.register("one", made)
    scene.set_layout("one", "spiral", ["id"])
    scene.export(str(tmp_path / "scene"))
    assert spark.read.parquet(str(tmp_path / "scene/one")).count() == 4
    for name in layouts.REGISTRY:
        if name not in ("palace", "mine"):
            d = spark.range(5).select("id", F.lit(1.0).alias("value"), F.lit("c").alias("category"), F.col("id").alias("timestamp"), F.lit(1.0).alias("lat"), F.lit(1.0).alias("lng"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), F.col("id").alias("year"))
            rows = layouts.calculate(d, name, ["id"]).collect()
            assert len(rows) == 5 and all(math.isfinite(r[a]) for r in rows for a in "xyz"), name


def test_dicom_and_feeds(spark, tmp_path):
    import struct

    el = lambda g, e, vr, v: struct.pack("<HH2sH", g, e, vr, len(v)) + v
    (tmp_path / "a.dcm").write_bytes(bytes(128) + b"DICM" + el(8, 0x60, b"CS", b"CT") + el(0x28, 0x10, b"US", struct.pack("<H", 64)) + struct.pack("<HH2sHI", 0x7FE0, 0x10, b"OW", 0, 4) + b"1234")
    assert {r.name: r.value for r in formats.read_dicom(spark, str(tmp_path / "*.dcm")).collect()} == {"modality": "CT", "rows": "64"}
    feed = spark.createDataFrame([(["des", "cd", "dist", "v_rel", "h"], [["x", "2024-Jan-01 02:47", "0.04", "10", "22"], ["y", "bad", "x", None, None]])], "fields array<string>, data array<array<string>>")
    rows = {r.des: r for r in formats.near_earth(records.field_table(feed, ["des", "cd", "dist", "v_rel", "h"])).collect()}
    assert rows["x"].hazard_class == "hazardous" and rows["x"].days == pytest.approx(1461.1159722) and rows["y"].hazard_class == "safe" and rows["y"].diameter == 100.0
    assert spark.sql("select 'no json' t").select(records.from_pairs_json(F.col("t"))).first()[0] == []


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    raw = ['{"type":"u","data":{"id":"a","value":1.5,"timestamp":"2024-01-01T00:00:00"}}', "broken", '{"type":"u","data":{"id":"b","value":2.5,"timestamp":"2024-01-01T00:01:00"}}']
    spark.createDataFrame([(r,) for r in raw], "value string").write.text(src)
    got = []
    q = stateful.publish(stateful.messages(spark.readStream.text(src)), lambda b, i: got.extend(b.collect()), str(tmp_path / "log"))
    q.awaitTermination()
    assert sorted(r.data.id for r in got) == ["a", "b"]
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    spark.createDataFrame([(1, "add", 1, 10), (2, "add", 1, 20), (1, "update", 2, 11)], "id int, op string, seq int, v int").coalesce(1).write.parquet(feed)
    q = stateful.publish(spark.readStream.schema("id int, op string, seq int, v int").parquet(feed), stateful.apply_feed(out), str(tmp_path / "log2"))
    q.awaitTermination()
    assert sorted(tuple(r) for r in ChangeLog(spark, out).table().select("id", "v").collect()) == [(1, 11), (2, 20)]
    held = stateful.rules_hold(spark.createDataFrame([(1, 5.0), (2, None)], "k int, v double"), [{"field": "v", "threshold": 3, "operator": ">"}, {"field": "v", "threshold": 3, "operator": "~"}])
    assert sorted((r.k, r.holds) for r in held.collect()) == [(1, False), (1, True)]
    a = spark.sql("select 1 k, timestamp'2024-01-01 00:00:00' t")
    b = spark.sql("select 1 k, timestamp'2024-01-01 00:05:00' u union all select 1, timestamp'2024-01-01 02:00:00'")
    assert stateful.joined(a, b, "k", "t", "u", "10 MINUTES").count() == 1 and stateful.deduplicated(a.union(a), ["k"], "t").count() == 1
    assert stateful.rate_market(spark).isStreaming and stateful.rate_sensors(spark).isStreaming


def test_search_goes_on_until_nothing_is_left(spark):
    from luminal.operators import graph

    way = spark.range(54).selectExpr("id source", "id + 1 target").coalesce(1)
    assert sorted((r.id, r.hops) for r in graph.distances_from(way, 0).collect()) == [(i, i) for i in range(55)]


def test_asof_is_linear_in_a_key(spark):
    """A million rows of one key; a window that looked ahead from each row would not end."""
    n = 1_000_000
    s = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 2).alias("ts"), F.col("id").cast("double").alias("value"))
    p = spark.range(1000).select(F.lit(1).alias("k"), (F.col("id") * 1999 + 1).alias("ts"))
    from luminal.operators import temporal

    d = temporal.asof(p, s, ["k"])
    bad = d.filter("before_ts <> ts - ts % 2 or after_ts <> ts + ts % 2")
    assert d.count() == 1000 and bad.count() == 0


def test_asof_ties_and_nulls(spark):
    from luminal.operators import temporal

    s = spark.createDataFrame([(1, 10, 1.0), (1, 10, 2.0), (1, None, 9.0), (2, 5, 3.0)], "k int, ts int, value double")
    p = spark.createDataFrame([(1, 10), (1, 11), (1, 9), (1, None), (3, 1)], "k int, ts int")
    got = {(r.k, r.ts): (r.before_value, r.after_value) for r in temporal.asof(p, s, ["k"]).collect()}
    assert got == {(1, 10): (2.0, 1.0), (1, 11): (2.0, None), (1, 9): (None, 1.0), (1, None): (None, None), (3, 1): (None, None)}


def test_every_topology_and_name_is_placed(spark):
    from luminal.operators import layouts

    link = "array(named_struct('to', id + 1, 'weight', 1.0D, 'type', 'x'))"
    df = spark.range(9).selectExpr("id", "if(id = 0, null, (id - 1) div 2) parent", f"{link} links", "id * 1000 timestamp", "array(0.1D, 0.2D, 0.3D) embedding", "'c' category", "1.0D lat", "2.0D lng")
    for topology in ("graph", "tree", "timeline-spiral", "timeline", "scatter", "globe", "grid", "matrix", "anything"):
        options = {"rounds": 2} if topology == "graph" else {}
        d = layouts.calculate_positions(df, topology, ["id"], **options)
        assert d.filter("x is not null and y is not null and z is not null").count() == 9, topology
    for name in ("force", "tree", "polar-tree"):
        assert layouts.calculate(df, name, ["id"], **({"rounds": 2} if name == "force" else {})).count() == 9
    apart = spark.createDataFrame([(1, None), (2, None), (3, 1)], "id int, parent int")
    assert {r.id: r.y for r in layouts.calculate(apart, "tree", ["id"]).collect()} == {1: 0.0, 2: None, 3: -3.0}


def test_late_rows_raise_no_alerts(spark, tmp_path):
    import os

    from luminal.streaming import stateful

    rows = [("2024-01-01 12:00:00", 90.0), ("2024-01-01 12:01:00", 90.0), ("2024-01-01 12:30:00", 90.0), ("2024-01-01 09:00:00", 10.0), ("2024-01-01 12:31:00", 90.0), ("2024-01-01 12:32:00", 10.0)]
    for i, r in enumerate(rows):
        with open(tmp_path / f"{i}.csv", "w") as f:
            f.write(f"a,{r[0]},{r[1]}\n")
        os.utime(tmp_path / f"{i}.csv", (1_700_000_000 + i * 10,) * 2)
    d = spark.readStream.schema("key string, ts timestamp, value double").option("maxFilesPerTrigger", 1).csv(str(tmp_path))
    out = stateful.stream_alerts(d, [{"field": "value", "threshold": 60.0}], "key", "ts")
    found = []
    stateful.publish(out, lambda b, i: found.extend(b.collect()), str(tmp_path / "log"), mode="append").awaitTermination()
    assert [(str(r.ts), r.event) for r in found] == [("2024-01-01 12:00:00", "trigger"), ("2024-01-01 12:32:00", "clear")]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from luminal.operators.common import shared_dir

    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://somewhere:7077"

            class _jsc:
                @staticmethod
                def sc():
                    return type("C", (), {"getCheckpointDir": lambda self: type("N", (), {"isDefined": lambda self: False})()})()

    with pytest.raises(ValueError):
        shared_dir(Cluster())


def _dense(spark):
    import random

    rng = random.Random(6)
    rows = [(rng.gauss(0, 0.1), rng.gauss(0, 0.1), rng.gauss(0, 0.1)) for _ in range(400)] + [(0.5, 0.5, 0.5)] * 30 + [(5.0, 5.0, 5.0), (None, 0.0, 0.0)]
    return spark.createDataFrame([(i, *p) for i, p in enumerate(rows)], "id int, x double, y double, z double")


def test_rips_triangles_are_those_of_the_edges_by_one_join(spark):
    p = _dense(spark)
    got = sorted(map(tuple, spatial.rips_triangles(p, 0.05).collect()))
    assert got and got == sorted(map(tuple, spatial.triangles(spatial.close_pairs(p, 0.05)).collect()))
    assert spatial.rips_triangles(p, 0.05)._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def _all_triangles(rows, radius):
    near = lambda a, b: math.sqrt(sum((x - y) * (x - y) for x, y in zip(a[1:], b[1:], strict=True))) <= radius
    later = {a[0]: [b for b in rows if a[0] < b[0] and near(a, b)] for a in rows}
    return sorted((i, b[0], c[0]) for i, bs in later.items() for b in bs for c in bs if b[0] < c[0] and near(b, c))


def test_rips_triangles_shuffle_points_and_no_pairs(spark):
    n, sc = 400, spark.sparkContext
    p = spark.range(n).select("id", *[(F.pmod(F.xxhash64("id", F.lit(a)), F.lit(100)) / 10000.0).alias(a) for a in "xyz"])
    sc.setJobGroup("rips", "rips")
    try:
        assert spatial.rips_triangles(p, 0.05).count() == math.comb(n, 3)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = {s for j in sc.statusTracker().getJobIdsForGroup("rips") for s in sc.statusTracker().getJobInfo(j).stageIds}
    rows = sum(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteRecords() for s in stages)
    assert 14 * n <= rows < 50 * n  # of 79,800 pairs


def test_rips_triangles_at_odd_places(spark):
    """On both sides of a cell's edge, too far out for numbers of cells, nowhere, in one place; and ids of text."""
    rows = [(0, -1e-20, 0.0, 0.0), (1, 0.05, 0.0, 0.0), (2, 0.02, 0.0, 0.0), (3, 3e38, 1.0, -3e38), (4, 3e38, 1.0, -3e38), (5, 3e38, 1.02, -3e38)]
    rows += [(6, 0.3, 0.1, 0.7), (7, 0.3, 0.1, 0.7), (8, 0.3, 0.1, 0.7), (9, 0.34, 0.1, 0.7), (10, 0.3, 0.13, 0.7)]
    nowhere = [(11, None, 0.0, 0.0), (12, float("nan"), 0.0, 0.0), (13, float("nan"), 0.0, 0.0), (14, float("inf"), 0.0, 0.0), (15, float("inf"), 0.0, 0.0), (None, 0.3, 0.1, 0.7)]
    p = spark.createDataFrame(rows + nowhere, "id long, x double, y double, z double")
    want = _all_triangles(rows, 0.05)
    assert {(0, 1, 2), (3, 4, 5), (6, 7, 8), (7, 8, 9)} <= set(want)
    assert sorted(map(tuple, spatial.rips_triangles(p, 0.05).collect())) == want
    text = p.withColumn("id", F.concat(F.lit("p"), "id"))
    as_text = _all_triangles([(f"p{r[0]}", *r[1:]) for r in rows], 0.05)
    assert sorted(map(tuple, spatial.rips_triangles(text, 0.05).collect())) == as_text
    assert sorted(map(tuple, spatial.rips_triangles(p, 0.0).collect())) == _all_triangles(rows, 0.0) == [(6, 7, 8)]
    assert spatial.rips_triangles(p, -1.0).count() == spatial.rips_triangles(p.limit(0), 0.05).count() == 0


def test_rips_triangles_in_small_pieces(spark, monkeypatch):
    """A cell's rows come in several batches, and its pairs in several blocks."""
    import pyarrow as pa

    monkeypatch.setattr(spatial, "CHUNK", 50)
    p = _dense(spark)
    want = _all_triangles([tuple(r) for r in p.collect() if r.x is not None], 0.05)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert sorted(map(tuple, spatial.rips_triangles(p, 0.05).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(spatial, "PAIRS", 40)
    rng = random.Random(8)
    rows = [(i, *(rng.random() * 0.06 for _ in range(3))) for i in range(60)]
    table = pa.table({"cx": [0] * 60, "cy": [0] * 60, "cz": [0] * 60, "slice": [0] * 60, **{c: list(v) for c, v in zip(("id", "x", "y", "z"), zip(*rows, strict=True), strict=True)}, "home": [True] * 60, "own": [True] * 60})
    batches = list(spatial._triangles_of(table, spatial._square(0.05)))
    got = sorted(tuple(sorted((r["a"], r["b"], c))) for b in batches for r in b.to_pylist() for c in r["c"])
    assert len(batches) > 100 and got == _all_triangles(rows, 0.05)


def test_nearest_as_all_pairs_and_without_them(spark):
    import math
    import time

    p = _dense(spark)
    rows = [r for r in p.collect() if r.x is not None]
    for radius, k in ((0.3, 3), (0.02, 1)):
        want = []
        for a in rows:
            near = sorted((math.dist((a.x, a.y, a.z), (b.x, b.y, b.z)), b.id) for b in rows if b.id != a.id)
            want += [(a.id, i, n + 1) for n, (d, i) in enumerate(near[:k]) if d <= radius]
        assert sorted((r.id, r.id2, r["rank"]) for r in spatial.nearest(p, radius, k).collect()) == sorted(want)
    start = time.time()
    copies = spark.range(60_000).selectExpr("id", "id % 3 * 0.01d as x", "0d as y", "0d as z")
    assert spatial.nearest(copies, 0.1, 3).groupBy("rank").count().collect() and time.time() - start < 60
