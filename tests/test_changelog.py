"""Change logs beside a dictionary, and delta messages."""

import json
import os
import random

import pytest

from luminal.operators.diff import delta_messages
from luminal.streaming.changelog import ChangeLog

SCHEMA = "id long, op string, v int, name string"


def plain(state, rows):
    for i, op, v, name in sorted(rows, key=lambda r: r[0]):
        if op in ("remove", "delete"):
            state.pop(i, None)
        else:
            state[i] = (v, name)
    return state


def table(log, at=None):
    return {r.id: (r.v, r.name) for r in log.table(at).collect()}


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


def test_many_batches_replays_and_states_on_the_way(spark, tmp_path):
    rng = random.Random(3)
    log, state, states, seen = ChangeLog(spark, f"file://{tmp_path}/log", share=None), {}, [], []
    for epoch in range(10):
        ids = rng.sample(range(40), 6)
        rows = [(i, rng.choice(["add", "update", "remove", "delete"]), rng.choice([None, i]), f"b{epoch}") for i in ids]
        batch = spark.createDataFrame(rows, SCHEMA)
        last = log.append(batch, source="a", epoch=epoch)
        assert log.append(batch, source="a", epoch=epoch) == last == 6 * (epoch + 1)
        seen += sorted(rows)
        states.append(dict(plain(state, rows)))
    assert table(log) == state
    assert [tuple(r) for r in log.since(0).orderBy("seq").select("id", "op", "v", "name").collect()] == seen
    assert [r.seq for r in log.since(25).orderBy("seq").collect()] == list(range(26, 61))
    assert table(log, 18) == states[2] and log.since(60).count() == 0
    assert [d[4] for d in log.state().deltas] == [1, 0, 0]  # eight were merged
    log.compact()
    assert table(log) == state
    with pytest.raises(ValueError):
        log.since(3)
    with pytest.raises(ValueError):
        log.table(3)
    assert log.append(spark.createDataFrame([(1, "add", 5, "z")], SCHEMA), source="a", epoch=9) == 60
    assert log.append(spark.createDataFrame([(1, "add", 5, "z")], SCHEMA), source="b", epoch=0) == 61
    before = table(log)
    assert log.vacuum() > 0 and table(log) == before and before[1] == (5, "z")


def test_writes_follow_the_changes(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/log")
    wide = spark.range(60_000).selectExpr("id", "'add' op", "cast(id as int) v", "concat(uuid(), uuid()) name")
    log.append(wide)
    whole = size(tmp_path / "log")
    for k in range(3):
        log.append(spark.createDataFrame([(k, "update", -1, "x")], SCHEMA))
    assert size(tmp_path / "log") - whole < whole / 20
    assert table(log)[2] == (-1, "x") and log.table().count() == 60_000


def test_a_write_that_broke_off_is_not_read(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/log", share=None)
    log.append(spark.createDataFrame([(1, "add", 1, "a")], SCHEMA))
    os.makedirs(tmp_path / "log/log/000000000001/_temporary/x")
    os.makedirs(tmp_path / "log/delta/half")
    (tmp_path / "log/delta/half/part-0.parquet").write_bytes(b"PAR1")
    assert table(log) == {1: (1, "a")} and log.state().number == 0
    log.append(spark.createDataFrame([(2, "add", 2, "b")], SCHEMA))
    assert table(log) == {1: (1, "a"), 2: (2, "b")} and log.state().number == 1


def test_own_order_null_ids_new_columns_and_nothing(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/log", share=None)
    with pytest.raises(ValueError):
        log.table()
    assert log.append(spark.createDataFrame([], SCHEMA)) == 0 and log.since(0).count() == 0
    rows = [(1, "add", 5, 1), (1, "update", 6, 3), (1, "remove", None, 2), (None, "add", 9, 4)]
    log.append(spark.createDataFrame(rows, "id long, op string, v int, seq long"))
    log.append(spark.createDataFrame([(2, "add", "new")], "id long, op string, note string"))
    assert sorted(((r.id, r.v, r.note) for r in log.table().collect()), key=repr) == [(1, 6, None), (2, None, "new"), (None, 9, None)]
    assert [r.seq for r in log.since(0).orderBy("seq").collect()] == [1, 2, 3, 4, 5]


def test_delta_messages(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["add", "update", "move", "remove", "delete", "other"]), f"n{i}") for i in rng.sample(range(1000), 700)]
    changes = spark.createDataFrame(rows, "seq long, op string, name string")
    got = delta_messages(changes, 50, first=5).orderBy("sequence").collect()
    want = []
    for kind, ops in (("batch", {"add"}), ("update", {"update", "move"}), ("delete", {"remove", "delete"})):
        own = sorted(r for r in rows if r[1] in ops)
        want += [(kind, own[k : k + 50]) for k in range(0, len(own), 50)]
    assert [r.sequence for r in got] == list(range(5, 5 + len(want)))
    assert [(r.type, [(d["seq"], d["op"], d["name"]) for d in json.loads(r.payload)]) for r in got] == want
    assert all(r.n == len(json.loads(r.payload)) for r in got)
    assert delta_messages(changes.limit(0)).count() == 0
