"""Sums over all pairs, terrain and weighted samples beside plain double loops."""

import math
import random

from pyspark.sql import functions as F

from luminal.operators import aggregates, domains, multipole, temporal


def heights(places, size, cell, scale=1.0):
    return {(i, j): scale * math.log1p(sum(math.exp(-2 * math.hypot(x - i * cell, z - j * cell)) for x, z in places)) for i in range(size) for j in range(size)}


def test_terrain_counts_every_point(spark):
    rng = random.Random(1)
    places = [(rng.gauss(5, 4), rng.gauss(5, 4)) for _ in range(400)] + [(-40.0, 90.0), (300.0, 3.0)] + [(2.5, 2.5)] * 300
    odd = [(None, 1.0), (1.0, math.nan), (math.inf, 0.0)]
    df = spark.createDataFrame(places + odd, "x double, z double").withColumnRenamed("x", "x")
    want = heights(places, 12, 0.9)
    for error in (1e-3, 1e-9):
        got = {(r.gx, r.gz): r.height for r in aggregates.terrain(df, 12, 0.9, error=error).collect()}
        assert set(got) == set(want)
        assert all(abs(math.expm1(got[k]) - math.expm1(want[k])) <= error * len(places) for k in want)


def test_terrain_far_from_all_points_and_without_any(spark):
    far = aggregates.terrain(spark.createDataFrame([(50.0, 50.0)], "x double, z double"), 3, 1.0).collect()
    assert len(far) == 9 and all(0 <= r.height < 1e-6 for r in far)
    none = aggregates.terrain(spark.createDataFrame([], "x double, z double"), 3, 1.0).collect()
    assert len(none) == 9 and all(r.height == 0 for r in none)


def springs(nodes, rest, k):
    out = {}
    for i, *p in nodes:
        f = [0.0, 0.0, 0.0]
        for j, *q in nodes:
            d = math.dist(p, q) + 0.01
            for a in range(3):
                f[a] += k * (d - rest) * (q[a] - p[a]) / d
        out[i] = f
    return out


def test_spring_network_as_the_double_loop(spark):
    rng = random.Random(2)
    nodes = [(i, rng.gauss(0, 3), rng.gauss(0, 3), rng.uniform(-1, 1)) for i in range(440)] + [(1000 + i, 20.0 + rng.random(), 5.0, rng.random()) for i in range(40)] + [(2000 + i, 1.0, 1.0, 1.0) for i in range(20)]
    df = spark.createDataFrame(nodes + [(None, None, 1.0, 1.0)], "id long, x double, y double, z double")
    want = springs(nodes, 2.0, 0.1)
    near = {r.id: (r.fx, r.fy, r.fz) for r in domains.spring_network(df, 2.0, 0.1, leaf=500).collect()}
    assert set(near) == set(want) and all(abs(a - b) < 1e-6 for k in want for a, b in zip(near[k], want[k]))
    size = max(math.hypot(*f) for f in want.values())
    cells = {r.id: (r.fx, r.fy, r.fz) for r in domains.spring_network(df, 2.0, 0.1, leaf=4, m=2).collect()}
    assert all(math.dist(cells[k], want[k]) < 2e-3 * size for k in want)


def test_spring_network_of_one_place_and_of_none(spark):
    schema = "id long, x double, y double, z double"
    assert [tuple(r) for r in domains.spring_network(spark.createDataFrame([(1, 1.0, 1.0, 1.0)], schema), 1.0, 1.0).collect()] == [(1, 0.0, 0.0, 0.0)]
    assert domains.spring_network(spark.createDataFrame([], schema), 1.0, 1.0).count() == 0


def test_weighted_samples(spark):
    rows = [("a", float(t), float(t * t)) for t in range(0, 100, 5)] + [("b", 50.0, 3.0), ("c", None, 1.0), ("d", 5.0, None), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, ts double, value double")
    field = temporal.uncertainty_field(df, ["k"], 50.0, 20.0, samples=50).collect()
    assert {r.k for r in field} >= {"a", "b"} and "d" not in {r.k for r in field} and "c" not in {r.k for r in field}
    own = [r for r in field if r.k == "a"]
    assert len(own) == 50 and all(30 <= r.ts <= 70 and abs(r.probability - (1 - abs(r.ts - 50) / 20)) < 1e-9 for r in own)
    line = lambda t: (lambda a: a * a + ((a + 5) ** 2 - a * a) * (t - a) / 5)(t // 5 * 5)
    assert all(abs(r.value - line(r.ts)) < 1e-6 for r in own)
    got = {r.k: (r.expected, r.spread) for r in temporal.expected_value(spark.createDataFrame(field), ["k"]).collect()}
    mean = sum(r.probability * r.value for r in own) / sum(r.probability for r in own)
    assert abs(got["a"][0] - mean) < 1e-6 and got["b"] == (3.0, 0.0)


def test_heat_zones_as_the_double_loop(spark):
    rng = random.Random(4)
    zones = [(i, rng.uniform(-30, 30), rng.gauss(0, 8)) for i in range(300)] + [(300, None, 1.0), (301, math.nan, 0.0), (302, math.inf, 0.0), (303, 500.0, 0.0)]
    spots = [(rng.uniform(-30, 30), rng.gauss(0, 8), rng.choice([0.0, 0.5, 1.0, 7.0])) for _ in range(150)] + [(1.0, 1.0, 3.0)] * 40 + [(1.0, 1.0, 2.0), (None, 0.0, 9.0)]
    z, s = spark.createDataFrame(zones, "id int, x double, z double"), spark.createDataFrame(spots, "x double, z double, load double")
    sound = [p for p in spots if p[0] is not None]
    want = {i: max((max(0.0, 100 - 10 * math.hypot(x - a, y - b)) * load for a, b, load in sound), default=0.0) if x is not None and math.isfinite(x) else 0.0 for i, x, y in zones}
    for leaf in (1, 16):
        got = {r.id: r.heat for r in domains.heat_zones(z, s, leaf).collect()}
        assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_heat_zones_among_many_spots(spark):
    import time

    start = time.time()
    grid = spark.range(40_000).selectExpr("id", "id % 200 * 0.05d as x", "id div 200 * 0.05d as z", "1d as load")
    heat = domains.heat_zones(grid.selectExpr("id", "x + 0.01 as x", "z + 0.02 as z"), grid.select("x", "z", "load"))
    low, high, n = heat.selectExpr("min(heat)", "max(heat)", "count(*)").first()
    assert n == 40_000 and abs(low - (100 - 10 * math.hypot(0.01, 0.02))) < 1e-6 and abs(high - low) < 1e-6
    assert time.time() - start < 60


def test_sums_over_pairs_do_not_pass_the_driver(spark):
    axes, low = ["x", "y", "z"], [0.0, 0.0, 0.0]
    p = spark.range(50).selectExpr("id % 5 * 1d as x", "id % 3 * 1d as y", "id * 1d as z", "1d as n")
    cells = p.selectExpr("cast(x as long) as _k0", "cast(y as long) as _k1", "cast(z as long) as _k2", "n as p_n").repartition(2, F.col("_k2"))
    for pairs in (multipole.near_pairs(p.select(*axes), p, axes, low, 1.0, 3), multipole.far_pairs(p.select(*axes), cells, axes, low, 1.0, 0, [3] * 3)):
        assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
