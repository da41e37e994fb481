"""Engine state, default specs, query forms, crystals, distance fields and orbits."""

import os

import pytest
from pyspark.sql import functions as F

from luminal import api
from luminal.functions import astro, vectors
from luminal.functions.dsl import compile_transform
from luminal.operators import layouts, palace, spatial
from luminal.sources import state


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_state_is_restored_whole_or_not_at_all(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    a, b = spark.createDataFrame([(1, "x", [1.0]), (None, None, None)], "id long, t string, v array<double>"), spark.createDataFrame([], "k int")
    with pytest.raises(ValueError):
        state.restore_state(spark, path)
    assert state.export_state(spark, path, {"a": a, "b": b}, {"layout": "grid", "selection": ["x", 1]}) == 0
    datasets, settings = state.restore_state(spark, path)
    assert rows(datasets["a"]) == rows(a) and datasets["b"].schema == b.schema and datasets["b"].count() == 0
    assert settings == {"version": "1", "packetCount": 2, "layout": "grid", "selection": ["x", 1]}
    assert state.export_state(spark, path, {"a": a.limit(1)}) == 1
    os.remove(tmp_path / "s/manifest/000000000001/_SUCCESS")  # as if it had broken off
    assert state.snapshots(spark, path) == [0] and rows(state.restore_state(spark, path)[0]["a"]) == rows(a)
    with pytest.raises(ValueError):
        state.restore_state(spark, path, 1)
    assert state.export_state(spark, path, {"a": a}) == 2
    folder = max((tmp_path / "s/data").iterdir(), key=lambda p: p.stat().st_mtime)
    for p in folder.glob("*.parquet"):
        p.unlink()
    with pytest.raises(ValueError, match="a is not what was written"):
        state.restore_state(spark, path)


def test_engine_export_restore_and_query(spark, tmp_path):
    one = api.Engine(spark)
    one.datasets.load("rest_a", [{"id": 1, "v": 5}, {"id": 2, "v": 7}])
    one.datasets.load("rest_b", [{"id": 9}])
    one.datasets.switch("rest_a")
    one.export(f"file://{tmp_path}/e", selection=["1"])
    two = api.Engine(spark)
    assert two.restore(f"file://{tmp_path}/e")["selection"] == ["1"] and two.datasets.current == "rest_a"
    assert [r.id for r in two.query({"table": "rest_a", "where": {"v": {"$gt": 4}}, "order_by": "-v", "limit": 1}).collect()] == [2]
    assert two.query({"table": "rest_a"}).count() == 2
    with pytest.raises(KeyError):
        two.query({"table": "none"})


def test_query_order_by_several_fields(spark):
    e = api.Engine(spark)
    e.datasets.load("rest_ties", [{"id": i, "v": i % 2} for i in (5, 3, 8, 1, 4, 7)])
    assert [r.id for r in e.query({"table": "rest_ties", "order_by": ["-v", "id"], "limit": 3}).collect()] == [1, 3, 5]
    assert [r.id for r in e.query({"table": "rest_ties", "order_by": ["v", "-id"], "limit": 3}).collect()] == [8, 4, 7]


def test_table_query_of_equal_prices(spark, tmp_path):
    from luminal.plans import QUERIES

    o = spark.range(400).select(F.col("id").alias("o_orderkey"), F.lit(200000.0).alias("o_totalprice"), F.lit("F").alias("o_orderstatus"))
    o.repartition(7, F.xxhash64("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    assert [r.o_orderkey for r in QUERIES["table_query"](spark, str(tmp_path)).collect()] == list(range(20))


def test_shared_degrees_make_no_edges(spark):
    from luminal.operators import graph

    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, key string")
    d = graph.shared_degrees(left, spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "key string"))
    assert rows(d.select("id", "degree")) == [(1, 2), (1, 2), (2, 1), (3, 0), (4, 0)]
    # two hundred thousand million edges
    big = graph.shared_degrees(spark.range(400_000).selectExpr("id", "1 as key"), spark.range(500_000).selectExpr("1 as key"))
    assert big.groupBy("degree").count().collect() == [(500_000, 400_000)]


def test_trajectories_are_those_of_each_body_dealt_to_all_tasks(spark):
    a, start = F.when(F.col("id") % 3 > 0, F.col("id") / 4.0), (F.col("id") * 1.0)
    d = astro.trajectories(spark.range(0, 9, 1, 1), a, F.col("id"), start)
    one = spark.range(9).select("id", F.explode(astro.trajectory(a, F.col("id"), start)).alias("p")).select("id", "p.*")
    assert rows(d) == rows(one) and d.rdd.getNumPartitions() == 8
    assert str(d._jdf.queryExecution().optimizedPlan()).count("md5") == 2


def test_default_spec_and_record(spark):
    assert api.load_spec() == api.load_spec("") == api.DEFAULT_SPEC and api.load_spec('{"id": "x"}') == {"id": "x"} and api.load_spec({"id": 1}) == {"id": 1}
    assert [r.asDict() for r in api.load_data(spark).collect()] == [{"value": 42, "label": "Default"}]
    assert [r.v for r in api.load_data(spark, '{"data": {"records": [{"v": 1}, {"v": 2}]}}').collect()] == [1, 2] and [r.v for r in api.load_data(spark, '[{"v": 3}]').collect()] == [3]
    for f in (lambda: api.load_spec("{"), lambda: api.load_data(spark, "{")):
        with pytest.raises(ValueError, match="Invalid JSON"):
            f()
    assert api.create(None, spark.range(2), ["id"]).count() == 2


def test_crystals_without_embedding_or_wing(spark):
    df = spark.createDataFrame([(1, None, None, "c", 5, None, None), (2, "ideas", "", "d", 5, 1_000, [0.0, 1.0, -1.0])], "drawer_id long, wing_id string, room_id string, content string, created_at long, modified_at long, embedding array<double>")
    a, b = palace.crystals(df, 86_400_999).orderBy("drawer_id").collect()
    assert (a.tags, a.geometry, a.pulse, len(a.vector)) == ([], "octahedron", False, 3) and all(-1 <= v < 1 for v in a.vector)
    assert (b.tags, b.geometry, b.pulse, b.color) == (["ideas"], "sphere", True, "rgb(127, 255, 0)")
    assert not palace.crystals(df, 86_401_000).orderBy("drawer_id").collect()[1].pulse


def test_distance_field_metrics(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 0.0, [1.0, 0.0]), (1, 1.0, 1.0, 0.0, [1.0, 1.0]), (2, 0.5, 0.0, 0.0, []), (3, 3.0, 0.0, 0.0, [1.0, 0.0]), (4, 0.5, 0.0, 0.0, None)], "id int, x double, y double, z double, embedding array<double>")
    near = spatial.field_connections(df, 0, 2.0, 9).collect()
    assert [(r.id, round(r.similarity, 4)) for r in near] == [(2, 0.75), (4, 0.75), (1, 0.7071)]
    assert [r.id for r in spatial.field_connections(df, 0, 1.9, 9, metric="manhattan").collect()] == [2, 4]
    one = spark.range(1).select(vectors.distance_by("cosine", [F.lit(1.0), F.lit(0.0)], [F.lit(0.0), F.lit(2.0)]).alias("c"), vectors.distance_by("manhattan", [F.lit(1.0)], [F.lit(-2.0)]).alias("m")).first()
    assert (one.c, one.m) == (1.0, 3.0)
    with pytest.raises(ValueError):
        vectors.distance_by("none", [], [])


def test_orbits_layouts_and_calculate(spark):
    way = spark.range(1).select(astro.trajectory(F.lit(None).cast("double"), F.col("id"), F.lit(None).cast("double")).alias("t")).first().t
    assert len(way) == 37 and [p.time for p in way][:3] == [0, 10, 20] and all(1.5 * 0.3 <= p.distance <= 1.5 * 1.7 for p in way)
    assert [p.planet for p in spark.range(1).select(astro.solar_system(F.lit(0.5)).alias("s")).first().s] == list(astro.PLANETS)
    none = layouts.calculate(spark.createDataFrame([(i, None) for i in range(8)], "id int, embedding array<double>"), "embedding", ["id"], center=(0.0, 0.0, 0.0)).collect()
    assert all(2 <= (r.x**2 + r.z**2) ** 0.5 <= 5 and abs(r.y) <= 2 for r in none)
    some = layouts.calculate(spark.createDataFrame([(1, [1.0, 0.5]), (2, None)], "id int, embedding array<double>"), "embedding", ["id"], center=(0.0, 0.0, 0.0)).filter("id = 1").first()
    assert (some.x, some.y, some.z) == (5.0, 2.5, 0.0)
    assert layouts.calculate(spark.createDataFrame([], "id int, embedding array<double>"), "embedding", ["id"]).count() == 0
    assert spark.range(2).select(compile_transform({"$data": "id", "$calculate": lambda v: v * 10}).alias("v")).agg(F.sum("v").alias("s")).first().s == 10
