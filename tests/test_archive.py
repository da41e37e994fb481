"""Searches over stored records beside plain filters, and what they leave unread."""

import math
import random
from datetime import datetime, timedelta

import pytest

from luminal.sources import archive

DAY = datetime(2024, 1, 1)
SCHEMA = "id long, x double, y double, z double, ts timestamp, note string, place int, radius double"


def records():
    rng = random.Random(5)
    rows = [(i, rng.gauss(0, 10), rng.uniform(-5, 5), float(rng.randrange(3)), DAY + timedelta(minutes=rng.randrange(5000)), f"Note {i % 7}", i, 0.5) for i in range(600)]
    rows += [(700 + i, 1.0, 1.0, 1.0, DAY + timedelta(minutes=60), "same", 0, 0.0) for i in range(30)]
    odd = [(800, None, 1.0, 1.0, DAY, "x", 1, 1.0), (801, 1.0, 1.0, 1.0, None, None, 1, 1.0), (802, math.nan, 0.0, 0.0, DAY + timedelta(minutes=1), "nan", 1, 1.0), (803, math.inf, 0.0, 0.0, DAY, "inf", 1, 1.0), (None, 2.0, 2.0, 2.0, DAY, "id", 1, 1.0)]
    return rows + odd


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    return archive.store(spark.createDataFrame(records(), SCHEMA), f"file://{tmp_path_factory.mktemp('archive')}/a", files=16)


def ids(df):
    return sorted(str(r.id) for r in df.collect())


def want(f):
    return sorted(str(r[0]) for r in records() if f(*r[1:5]))


def test_volume_and_near(kept):
    for low, high in [((-3, -1, 0), (4, 2, 1)), ((1, 1, 1), (1, 1, 1)), ((-1e9,) * 3, (1e9,) * 3), ((50, 50, 50), (60, 60, 60)), ((2, 0, 0), (1, 1, 1))]:
        found = want(lambda x, y, z, t: None not in (x, y, z) and not math.isnan(x) and all(a <= v <= b for a, v, b in zip(low, (x, y, z), high)))
        assert ids(kept.in_volume(low, high)) == found
    near = kept.near((0.0, 0.0, 1.0), 2.5).collect()
    assert sorted(str(r.id) for r in near) == want(lambda x, y, z, t: None not in (x, y, z) and math.dist((x, y, z), (0, 0, 1)) <= 2.5)
    assert all(abs(r.distance - math.dist((r.x, r.y, r.z), (0, 0, 1))) < 1e-9 for r in near)


def test_time_range_keeps_rows_without_a_place(kept):
    assert ids(kept.in_time(DAY, DAY + timedelta(minutes=90))) == want(lambda x, y, z, t: t is not None and DAY <= t <= DAY + timedelta(minutes=90))
    assert kept.in_time("2030-01-01 00:00:00", "2031-01-01 00:00:00").count() == 0


def test_nearest_in_time(kept):
    timed = [r for r in records() if r[4] is not None]
    for at in [DAY - timedelta(days=400), DAY + timedelta(minutes=60, seconds=1), DAY + timedelta(minutes=2500, seconds=29), DAY + timedelta(days=4000), DAY]:
        got = kept.nearest_in_time(at).collect()
        best = min(timed, key=lambda r: (abs(r[4] - at), r[4], r[0] if r[0] is not None else -1))
        assert [r.id for r in got] == [best[0]]


def test_trail(kept):
    rows = kept.trail(DAY + timedelta(minutes=30), DAY + timedelta(minutes=300)).orderBy("place").collect()
    path = sorted((r for r in records() if r[4] is not None and DAY + timedelta(minutes=30) <= r[4] <= DAY + timedelta(minutes=300)), key=lambda r: (r[4], r[0]))
    assert [r.id for r in rows] == [r[0] for r in path] and [r.next_id for r in rows] == [*[r[0] for r in path[1:]], None]
    assert all(abs(a.way - math.dist((a.x, a.y, a.z), (b.x, b.y, b.z))) < 1e-9 for a, b in zip(rows, rows[1:])) and rows[-1].way is None


def test_text_and_stats(kept):
    assert kept.matching("NOTE 3", "note").count() == sum(r[5] == "Note 3" for r in records())
    s = kept.stats().first()
    assert (s.records, s.first, s.last) == (len(records()), DAY, max(r[4] for r in records() if r[4]))


def read(df):
    """Files and rows that the scan of a plan without exchange takes in."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numFiles").value(), leaf.metrics().apply("numOutputRows").value()


def test_searches_skip_files(spark, tmp_path):
    n = 60_000
    at = lambda salt, to: f"pmod(xxhash64(id, {salt}), {to}) / 1000D"
    df = spark.range(n).selectExpr("id", f"{at(1, 100000)} x", f"{at(2, 100000)} y", f"{at(3, 100000)} z", f"{at(4, 100000)} ts", "repeat('x', 20) pad")
    kept = archive.store(df, f"file://{tmp_path}/a", files=64)
    files, rows = read(kept.rows)
    assert rows == n
    box = kept.in_volume((10.0, 10.0, 10.0), (20.0, 20.0, 20.0))
    small_files, small_rows = read(box)
    assert small_files * 10 < files and small_rows * 10 < n and 0 < box.count() < 200
    plan = box._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_cell" in plan and "GreaterThanOrEqual(x,10.0)" in plan
    time_files, time_rows = read(kept.in_time(40.0, 41.0))
    assert time_files * 3 < files and time_rows * 3 < n
    near = kept.nearest_in_time(33.3)
    assert abs(near.first().ts - 33.3) < 0.01


def test_an_empty_table_and_one_place(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    kept = archive.store(df, f"file://{tmp_path}/a")
    assert kept.in_volume((0, 0, 0), (1, 1, 1)).count() == kept.in_time(DAY, DAY).count() == kept.nearest_in_time(DAY).count() == kept.trail(DAY, DAY).count() == 0
    one = archive.store(spark.createDataFrame([(1, 1.0, 1.0, 1.0, DAY, "", 0, 0.0)], SCHEMA), f"file://{tmp_path}/b")
    assert ids(one.in_volume((1, 1, 1), (1, 1, 1))) == ids(one.nearest_in_time("1970-01-01 00:00:00")) == ["1"]


def test_the_key_is_compiled_and_as_bit_by_bit(spark, tmp_path, monkeypatch):
    """The JVM interprets methods of 8,000 bytes and more; the key's bits are those of the steps in turn."""
    seen = []
    kind = type(spark.range(1))
    dealt = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, *a: (seen.append(self), dealt(self, *a))[1])
    df = spark.createDataFrame(records(), SCHEMA)
    kept = archive.store(df, f"file://{tmp_path}/a", files=4)
    code = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$")
    parts = code.codegenStringSeq(seen[0]._jdf.queryExecution().executedPlan())
    sizes = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]
    assert sizes and max(sizes) < 8000, sizes
    low, high = zip(*kept.bounds, strict=True)
    for r in kept.rows.collect():
        at = [r.x, r.y, r.z, None if r.ts is None else (r.ts - datetime(1970, 1, 1)) / timedelta(microseconds=1)]
        key = -1
        if all(v is not None and math.isfinite(v) for v in at):
            steps = [min((1 << 15) - 1, math.floor((v - a) / ((b - a) / (1 << 15)))) for v, a, b in zip(at, low, high, strict=True)]
            key = sum(((s >> b) & 1) << (4 * b + 3 - i) for i, s in enumerate(steps) for b in range(15))
        assert (r["_key"], r["_cell"]) == (key, key >> 52)
