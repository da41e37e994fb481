"""Streams with state of their own, over several micro-batches, beside plain versions."""

import hashlib
import random
import uuid
from collections import deque
from datetime import datetime, timedelta

import pytest

from luminal.operators import temporal
from luminal.streaming import keyed

DAY = datetime(2024, 1, 1)


@pytest.fixture
def run(spark, tmp_path):
    """Runs a stream over files of rows, one file a micro-batch, and gives what came out."""

    def go(batches, schema, build, mode="append"):
        src, got = f"{tmp_path}/{uuid.uuid4().hex}", []
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{src}/b={k:03d}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(*[f"{src}/b=*"])
        q = build(stream).writeStream.outputMode(mode).option("checkpointLocation", src + "-log").foreachBatch(lambda b, i: got.extend(b.collect())).trigger(availableNow=True).start()
        q.awaitTermination()
        return got

    return go


def test_extent_beside_plain():
    rng, held, e = random.Random(1), [], keyed.Extent()
    for at in range(500):
        v = None if rng.random() < 0.1 else rng.randrange(10) / 2
        held.append((at, v))
        e.add(at, v)
        gone = [x for x in held if x[0] < at - 7]
        held = held[len(gone) :]
        e.drop(at - 7, [x[1] for x in gone])
        vs = [x[1] for x in held if x[1] is not None]
        assert e.span == (max(vs) - min(vs) if vs else None) and (e.mean is None) == (not vs) and (not vs or abs(e.mean - sum(vs) / len(vs)) < 1e-9)


def test_fixations_of_shuffled_samples(spark, run):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), DAY + timedelta(milliseconds=20 * i + rng.choice([0, 0, 20])), rng.choice([None, rng.random() * 3]), rng.random() * 2.5) for i in range(240)]
    late = [("a", DAY, 0.0, 0.0), ("b", DAY + timedelta(milliseconds=1), 0.0, 0.0)]
    schema, batches = "user string, ts timestamp, yaw double, pitch double", []
    for k in range(0, 240, 60):  # shuffled within a second, which the delay allows
        part = rows[k : k + 60]
        rng.shuffle(part)
        batches.append(part)
    got = run([*batches, [*late, (None, None, 1.0, 1.0)], [("a", DAY + timedelta(hours=1), 9.0, 9.0), ("b", DAY + timedelta(hours=1), 9.0, 9.0)]], schema, lambda d: keyed.stream_fixations(d, "user", window_ms=100, spread=2.0, delay="2 seconds"))
    table = spark.createDataFrame(rows, schema).selectExpr("user", "unix_millis(ts) ts_ms", "yaw", "pitch")
    want = sorted((r.user, r.ts_ms, round(r.span, 6), round(r.center_pitch, 6)) for r in temporal.fixations(table, ["user"]).collect())
    ms = lambda t: int((t - DAY).total_seconds() * 1000 + 0.5) + 1704067200000
    assert sorted((r.key, ms(r.ts), round(r.span, 6), round(r.center_pitch, 6)) for r in got if r.ts < DAY + timedelta(minutes=30)) == want and want


def test_fixations_ask_their_state_seldom():
    import pandas as pd

    calls = []

    class State:
        rows = None
        exists = lambda self: calls.append("exists") or self.rows is not None
        get = lambda self: calls.append("get") or (self.rows or [])

        def put(self, rows):
            calls.append("put")
            self.rows = rows

        update = put
        clear = lambda self: self.put(None)

    class Handle:
        getListState = getValueState = lambda self, *_: State()  # noqa: E731, N815
        registerTimer = lambda self, ms: calls.append(ms)  # noqa: E731, N815
        deleteTimer = registerTimer  # noqa: N815

    class Now:
        ms = 0
        getCurrentWatermarkInMs = lambda self: self.ms  # noqa: E731, N815

    fixations, now = keyed._Fixations(100, 2.0), Now()
    fixations.init(Handle())
    part = pd.DataFrame({"ts": [pd.Timestamp(30, unit="ms"), pd.Timestamp(20, unit="ms")], "yaw": [1.0, 2.0], "pitch": [0.0, None]})
    assert not list(fixations.handleInputRows(("a",), iter([part]), now)) and calls == ["get", "put", 20]
    now.ms = 40
    (out,) = fixations.handleExpiredTimer(("a",), now, None)
    assert out.ts.tolist() == [pd.Timestamp(20, unit="ms"), pd.Timestamp(30, unit="ms")] and out.span.tolist() == [0.0, 1.0]
    assert len(calls) <= 7


def message(n, good=True, minute=0):
    payload = f"[{n}]"
    return ("c", n, "batch", DAY + timedelta(minutes=minute), payload, hashlib.sha256(payload.encode()).hexdigest() if good else "bad")


def test_receiver_of_shuffled_repeated_damaged_and_lost_messages(run):
    batches = [
        [message(3), message(1), message(1)],
        [message(2), message(4, good=False), message(2)],
        [message(6, minute=1), message(4, minute=1), message(3, minute=1)],
        [message(9, minute=2), message(8, minute=2)],
        [message(10, minute=30)],
        [message(12, minute=31)],
        [message(5, minute=31), message(11, minute=31), message(7, minute=31)],
    ]
    schema = "channel string, sequence long, type string, timestamp timestamp, payload string, checksum string"
    got = [(r.kind, r.sequence, r.upto) for r in run(batches, schema, lambda d: keyed.receive(d, patience_ms=5 * 60_000))]
    assert [s for k, s, _ in got if k == "apply"] == [1, 2, 3, 4, 6, 8, 9, 10, 11, 12]
    assert sorted(x for x in got if x[0] == "repeat") == [("repeat", 1, 1), ("repeat", 2, 2), ("repeat", 3, 3), ("repeat", 5, 5), ("repeat", 7, 7)]
    assert [x for x in got if x[0] == "damaged"] == [("damaged", 4, 4)] and [x for x in got if x[0] == "gap"] == [("gap", 5, 5), ("gap", 7, 7)]


def test_receiver_asks_its_state_once_a_piece():
    import pandas as pd

    calls = []

    class State(dict):
        exists = lambda self: "v" in self
        get = lambda self: self["v"]
        update = lambda self, v: self.__setitem__("v", v)
        clear = dict.clear
        containsKey = lambda self, k: calls.append(k) or k in self  # noqa: E731, N815
        getValue = lambda self, k: calls.append(k) or self[k]  # noqa: E731, N815
        updateValue = lambda self, k, v: calls.append(k) or self.__setitem__(k, v)  # noqa: E731, N815
        removeKey = lambda self, k: calls.append(k) or self.pop(k)  # noqa: E731, N815
        iterator = lambda self: iter(list(self.items()))
        keys = lambda self: iter(list(dict.keys(self)))
        values = lambda self: iter(list(dict.values(self)))

    class Handle:
        getValueState = getMapState = lambda self, *_: State()  # noqa: E731, N815
        registerTimer = deleteTimer = lambda self, ms: None  # noqa: E731, N815

    class Now:
        getCurrentWatermarkInMs = lambda self: 1 << 42  # noqa: E731, N815

    sent = [message(n) for n in range(1, 12_001) if n % 3000 != 7]
    random.Random(8).shuffle(sent)
    parts = [pd.DataFrame(sent[k : k + 3000] + sent[:5], columns=["channel", "sequence", "type", "timestamp", "payload", "checksum"]) for k in range(0, len(sent), 3000)]
    receiver = keyed._Receiver(1, 0)
    receiver.init(Handle())
    got = pd.concat([*receiver.handleInputRows(("c",), iter(parts), Now()), *receiver.handleExpiredTimer(("c",), Now(), None)])
    assert got[got.kind == "apply"].sequence.tolist() == sorted(m[1] for m in sent) and (got.kind == "repeat").sum() == 20
    assert got[got.kind == "apply"].payload.tolist() == [f"[{n}]" for n in sorted(m[1] for m in sent)]
    assert got[got.kind == "gap"][["sequence", "upto"]].values.tolist() == [[n, n] for n in (7, 3007, 6007, 9007)]
    assert len(calls) < 1000 and not any(receiver._waiting())


def test_buffer_beside_a_plain_one(run):
    rng, rows = random.Random(4), []
    for at in range(200):
        op = rng.choice(["put"] * 6 + ["range", "latest", "last", "clear"])
        ts = DAY + timedelta(seconds=rng.randrange(100))
        rows.append((rng.choice(["x", "y"]), at, op, ts if rng.random() < 0.9 or op != "put" else None, rng.choice([None, float(at)]), DAY + timedelta(seconds=20), DAY + timedelta(seconds=70), rng.choice([None, 0, 3]), f"q{at}"))
    schema = "key string, at long, op string, ts timestamp, value double, start timestamp, stop timestamp, count int, ask string"
    got = {r.ask: (r.n, r["values"]) for r in run([rows[k : k + 50] for k in range(0, 200, 50)], schema, lambda d: keyed.asked_buffer(d, capacity=7))}
    held, want = {"x": deque(maxlen=7), "y": deque(maxlen=7)}, {}
    for key, _, op, ts, value, start, stop, count, ask in rows:
        own = held[key]
        if op == "put":
            own.append((ts, value))
        elif op == "clear":
            own.clear()
        else:
            found = {"latest": list(own)[-1:], "last": list(own)[-count:] if count else list(own), "range": [p for p in own if p[0] and start <= p[0] <= stop]}[op]
            want[ask] = (len(found), [p[1] for p in found])
    assert got == want and want


def test_book_over_micro_batches(run):
    level = lambda *ps: [(float(p), 1.0) for p in ps]
    at = lambda s: DAY + timedelta(seconds=s)
    rows = [("s", at(0), 0, level(1, 5, 3), level(8, 7), None, None), ("s", at(1), 1, None, None, 6.0, 2.0), ("s", at(3), 3, None, level(9), 6.5, 1.0), ("s", at(2), 2, level(4), None, 6.25, 1.0), ("t", at(0), 0, [], None, None, None)]
    schema = "symbol string, ts timestamp, seq long, bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>, price double, size double"
    got = run([rows[:2], rows[2:]], schema, lambda d: keyed.stream_book(d, depth=2, keep=3, show=2), "update")
    first, last = (r for r in got if r.symbol == "s")
    assert [x.price for x in first.bids] == [5.0, 3.0] and [x.price for x in first.asks] == [7.0, 8.0] and len(first.trades) == 1
    assert [x.price for x in last.bids] == [4.0] and [x.price for x in last.asks] == [9.0] and [x.price for x in last.trades] == [6.25, 6.5]
    assert [(r.bids, r.trades) for r in got if r.symbol == "t"] == [([], [])]


def test_order_book_holds_one_part_of_its_rows():
    import gc
    import weakref

    import pandas as pd

    class State(dict):
        exists = lambda self: True
        get = lambda self: self.setdefault("rows", [])
        put = lambda self, rows: self.update(rows=rows)
        updateValue = dict.__setitem__  # noqa: N815
        getValue = dict.__getitem__  # noqa: N815
        containsKey = dict.__contains__  # noqa: N815

    parts, most = [], []
    level = lambda v: [{"price": v, "size": 1.0}]

    def given():
        for k in (2, 0, 3, 1):  # in any order
            seq = [k * 100 + (i * 37) % 100 for i in range(100)]
            p = pd.DataFrame({"ts": pd.Timestamp("2024-01-01"), "seq": seq, "bids": [level(v) if v % 3 == 0 else None for v in seq], "asks": [level(v) if v % 3 == 1 else None for v in seq], "price": [float(v) if v % 3 == 2 else None for v in seq], "size": 1.0})
            parts.append(weakref.ref(p))
            yield p
            del p
            gc.collect()
            most.append(sum(r() is not None for r in parts))

    book = keyed._Book(depth=2, keep=3, show=2)
    book.sides, book.trades = State(), State()
    (out,) = list(book.handleInputRows(("s",), given(), None))
    assert out.bids[0] == level(399.0) and out.asks[0] == level(397.0)
    assert [t["price"] for t in out.trades[0]] == [395.0, 398.0] and [t[1] for t in book.trades["rows"]] == [392.0, 395.0, 398.0]
    assert max(most) <= 1
