"""Streams whose keys hold state of their own kind: ordered receivers, gaze windows, buffers that can be asked, books.

All run on transformWithState, which keeps state in RocksDB and its changes in the checkpoint; state_store() sets that up."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    """The state store that these streams need; streams that have begun with another keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _micros(values: pd.Series) -> list[int]:
    return values.to_numpy("datetime64[us]").astype(np.int64).tolist()


class _InOrder(StatefulProcessor):
    """Rows of a key wait until the watermark has passed them, then go to ready() in order of time. One timer is set,
    for the earliest that waits, so that the rows tell it. Each question to the state is a message to another process:
    there are few, and no frame is made of no rows, since keys are many."""

    fields = ""  # of a waiting row, besides its time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at long, {self.fields}")

    def ready(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        raise NotImplementedError

    def row(self, parts: pd.DataFrame) -> Iterator[tuple]:
        """(time in microseconds, fields) of input rows; those without a time are passed over."""
        raise NotImplementedError

    def _go(self, key: tuple, new: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        old = [tuple(r) for r in self.waiting.get()]
        due, rest = [], []
        for r in (*old, *new):
            (due if r[0] <= watermark_ms * 1000 else rest).append(r)
        if rest:
            self.waiting.put(rest)
        elif old:
            self.waiting.clear()
        # a timer goes off once the watermark is beyond it
        was, soon = (min((-(-r[0] // 1000) for r in rows), default=None) for rows in (old, rest))
        if was is not None and was != soon and was > watermark_ms:
            self.handle.deleteTimer(was)
        if soon is not None and soon != was:
            self.handle.registerTimer(soon)
        out = self.ready(key, sorted(due, key=lambda r: tuple((v is not None, v) for v in r))) if due else []
        if out:
            yield self.frame(out)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for p in rows for r in self.row(p)]
        yield from self._go(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._go(key, [], timerValues.getCurrentWatermarkInMs())

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame.from_records(rows, columns=self.columns)

    def close(self) -> None:
        pass


class Extent:
    """The extent of the values of a moving window, by a queue of falling and one of rising values; nulls count for
    nothing. Each value enters and leaves each queue once."""

    def __init__(self) -> None:
        self.high, self.low, self.sum, self.n = deque(), deque(), 0.0, 0

    def add(self, at: int, v: float | None) -> None:
        if v is None:
            return
        while self.high and self.high[-1][1] <= v:
            self.high.pop()
        while self.low and self.low[-1][1] >= v:
            self.low.pop()
        self.high.append((at, v))
        self.low.append((at, v))
        self.sum, self.n = self.sum + v, self.n + 1

    def drop(self, before: int, values: list[float | None]) -> None:
        """Forgets what is earlier than before; values are those that go."""
        for q in (self.high, self.low):
            while q and q[0][0] < before:
                q.popleft()
        gone = [v for v in values if v is not None]
        self.sum, self.n = self.sum - sum(gone), self.n - len(gone)

    @property
    def span(self) -> float | None:
        return self.high[0][1] - self.low[0][1] if self.n else None

    @property
    def mean(self) -> float | None:
        return self.sum / self.n if self.n else None


class _Fixations(_InOrder):
    fields = "yaw double, pitch double"
    columns = ["key", "ts", "yaw", "pitch", "span", "center_yaw", "center_pitch"]

    def __init__(self, window_ms: int, spread: float):
        self.window, self.spread = window_ms * 1000, spread

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent = handle.getListState("recent", "at long, yaw double, pitch double")

    def row(self, parts):
        parts = parts[parts["ts"].notna()]
        none = lambda s: [None if v != v else float(v) for v in s]
        return zip(_micros(parts["ts"]), none(parts["yaw"]), none(parts["pitch"]), strict=True)

    def ready(self, key, rows):
        held, yaw, pitch, out = deque(), Extent(), Extent(), []
        for at, y, p in self.recent.get():
            held.append((at, y, p))
            yaw.add(at, y)
            pitch.add(at, p)
        i = 0
        while i < len(rows):
            at, j = rows[i][0], i
            while j < len(rows) and rows[j][0] == at:  # samples of one time see one another
                held.append(rows[j])
                yaw.add(at, rows[j][1])
                pitch.add(at, rows[j][2])
                j += 1
            gone = []
            while held[0][0] < at - self.window:
                gone.append(held.popleft())
            yaw.drop(at - self.window, [g[1] for g in gone])
            pitch.drop(at - self.window, [g[2] for g in gone])
            spans = [s for s in (yaw.span, pitch.span) if s is not None]
            if spans and max(spans) < self.spread:
                out += [(key[0], pd.Timestamp(at, unit="us"), r[1], r[2], max(spans), yaw.mean, pitch.mean) for r in rows[i:j]]
            i = j
        self.recent.put(list(held))
        return out


def stream_fixations(gaze: DataFrame, by: str, time: str = "ts", window_ms: int = 100, spread: float = 2.0, delay: str = "1 second") -> DataFrame:
    """key, ts, yaw, pitch, span, center_yaw, center_pitch: the samples (by, time, yaw, pitch) of a stream whose
    trailing window spans less than spread in both angles, as temporal.fixations gives them for a table. Samples wait
    until the watermark, delay behind the latest, has passed them, so they may come in any order until then; later
    ones, and those without a time, are dropped."""
    state_store(gaze.sparkSession)
    rows = gaze.select(F.col(by).cast("string").alias("key"), F.col(time).alias("ts"), F.col("yaw").cast("double").alias("yaw"), F.col("pitch").cast("double").alias("pitch")).withWatermark("ts", delay)
    out = "key string, ts timestamp, yaw double, pitch double, span double, center_yaw double, center_pitch double"
    return rows.groupBy("key").transformWithStateInPandas(_Fixations(window_ms, spread), out, "append", "EventTime")


PIECE, SHOWN = 500, 5000  # messages that wait as one value of the state, and those given out at once


class _Receiver(StatefulProcessor):
    """Messages that wait are kept in pieces, each under its first sequence, so that the state is asked once a piece and
    not several times a message: numbers and times in one map, which is read whole, types and payloads in another."""

    columns = ["channel", "kind", "sequence", "upto", "type", "payload"]

    def __init__(self, first: int, patience_ms: int):
        self.first, self.patience = first, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "sequence long")
        self.numbers = handle.getMapState("numbers", "first long", "sequences array<bigint>, since array<bigint>")
        self.bodies = handle.getMapState("bodies", "first long", "types array<string>, payloads array<string>")
        self.timer = handle.getValueState("timer", "ms long")

    def _waiting(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return {k[0]: tuple(np.array(list(x), np.int64) for x in v) for k, v in self.numbers.iterator()}

    def _keep(self, pieces: dict, sequences: np.ndarray, since: np.ndarray, types: list, payloads: list) -> None:
        for a in range(0, len(sequences), PIECE):
            own, first = slice(a, a + PIECE), int(sequences[a])
            pieces[first] = (sequences[own], since[own])
            self.numbers.updateValue((first,), (sequences[own].tolist(), since[own].tolist()))
            self.bodies.updateValue((first,), (types[own], payloads[own]))

    def handleInputRows(self, key, rows, timerValues):
        expected, now = self.next.get()[0] if self.next.exists() else self.first, timerValues.getCurrentWatermarkInMs()
        pieces = self._waiting()
        held = np.sort(np.concatenate([np.zeros(0, np.int64), *[p[0] for p in pieces.values()]]))
        for part in rows:
            part = part.sort_values("sequence", kind="stable")
            sequence, types, payloads = part["sequence"].to_numpy(np.int64), part["type"].tolist(), part["payload"].tolist()
            sound = np.array([p is not None and c is not None and hashlib.sha256(p.encode()).hexdigest() == c for p, c in zip(payloads, part["checksum"], strict=True)], bool)
            fresh = np.flatnonzero(sound & (sequence >= expected) & ~np.isin(sequence, held, assume_unique=False))
            fresh = fresh[np.unique(sequence[fresh], return_index=True)[1]]
            other = np.ones(len(part), bool)
            other[fresh] = False
            other = np.flatnonzero(other).tolist()
            if other:
                yield self._frame([(key[0], "repeat" if sound[i] else "damaged", int(sequence[i]), int(sequence[i]), types[i], None) for i in other])
            since = np.array([now if pd.isna(t) else t.value // 1_000_000 for t in part["timestamp"].iloc[fresh]], np.int64)
            self._keep(pieces, sequence[fresh], since, [types[i] for i in fresh], [payloads[i] for i in fresh])
            held = np.sort(np.concatenate([held, sequence[fresh]]), kind="stable")
        yield from self._apply(key, pieces, held, expected, 0, now)

    def _apply(self, key, pieces, held, expected, least, now):
        """Gives out the first least of held, with the gaps before them, and all that follow them without a gap."""
        before = expected - 1 if least == 0 else int(held[least - 1])
        broken = held[least:] != before + 1 + np.arange(len(held) - least)
        n = least + (int(np.argmax(broken)) if broken.any() else len(broken))
        firsts, opened = sorted(pieces, reverse=True), []
        for a in range(0, n, SHOWN):
            last, rows, left = int(held[min(a + SHOWN, n) - 1]), [], []
            while firsts and firsts[-1] <= last:
                first = firsts.pop()
                types, payloads = self.bodies.getValue((first,))
                opened.append((*pieces.pop(first), list(types), list(payloads)))
                self.numbers.removeKey((first,))
                self.bodies.removeKey((first,))
            for sequences, since, types, payloads in opened:
                k = int(np.searchsorted(sequences, last, "right"))
                rows += zip(sequences[:k].tolist(), types[:k], payloads[:k], strict=True)
                if k < len(sequences):
                    left.append((sequences[k:], since[k:], types[k:], payloads[k:]))
            opened, out = left, []
            for sequence, kind, payload in sorted(rows, key=lambda r: r[0]):
                if sequence > expected:
                    out.append((key[0], "gap", expected, sequence - 1, None, None))
                out.append((key[0], "apply", sequence, sequence, kind, payload))
                expected = sequence + 1
            yield self._frame(out)
        for piece in opened:
            self._keep(pieces, *piece)
        self.next.update((expected,))
        self._wait(pieces, now)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame.from_records(rows, columns=self.columns)

    def _wait(self, pieces: dict, now: int) -> None:
        """A timer for when the message that has waited longest for an earlier one will have waited long enough."""
        soon = min((int(since.min()) + self.patience for _, since in pieces.values()), default=None)
        old = self.timer.get()[0] if self.timer.exists() else None
        if old is not None and old != soon and old > now:
            self.handle.deleteTimer(old)
        if soon is None:
            self.timer.clear()
        elif soon != old:
            self.handle.registerTimer(soon)
            self.timer.update((soon,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.clear()
        expected, now = self.next.get()[0] if self.next.exists() else self.first, timerValues.getCurrentWatermarkInMs()
        pieces = self._waiting()
        none = np.zeros(0, np.int64)
        held = np.sort(np.concatenate([none, *[p[0] for p in pieces.values()]]))
        # what stands before one that has waited long enough goes with it
        due = np.concatenate([none, *[p[0][p[1] + self.patience <= now] for p in pieces.values()]])
        yield from self._apply(key, pieces, held, expected, int(np.searchsorted(held, due.max(), "right")) if len(due) else 0, now)

    def close(self) -> None:
        pass


def receive(messages: DataFrame, channel: str = "channel", first: int = 1, delay: str = "0 seconds", patience_ms: int = 60_000) -> DataFrame:
    """channel, kind, sequence, upto, type, payload: what becomes of delta messages (channel, sequence, type, timestamp,
    payload, checksum) that may come shuffled, repeated, damaged or not at all. kind is apply, in order of sequence and
    once each; repeat, for one that has been taken; damaged, where the checksum does not fit (a sound one may follow);
    or gap, for the numbers from sequence to upto that have not come although later ones have waited patience_ms of
    event time: then the later ones are applied."""
    state_store(messages.sparkSession)
    rows = messages.select(F.col(channel).cast("string").alias("channel"), F.col("sequence").cast("long").alias("sequence"), "type", "timestamp", "payload", "checksum").filter("sequence is not null").withWatermark("timestamp", delay)
    return rows.groupBy("channel").transformWithStateInPandas(_Receiver(first, patience_ms), "channel string, kind string, sequence long, upto long, type string, payload string", "append", "EventTime")


class _Buffer(StatefulProcessor):
    columns = ["key", "ask", "n", "ts", "values"]

    def __init__(self, capacity: int, ttl_ms: int | None):
        self.capacity, self.ttl = capacity, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.points = handle.getListState("points", "ts long, value double", self.ttl)

    def handleInputRows(self, key, rows, timerValues):
        held = deque((tuple(p) for p in self.points.get()), maxlen=self.capacity)
        out, changed = [], False
        whole = pd.concat(list(rows)).sort_values("at", kind="stable")
        for r in whole.itertuples(index=False):
            if r.op == "put":
                held.append((None if pd.isna(r.ts) else int(r.ts.value // 1000), None if r.value != r.value else float(r.value)))
                changed = True
            elif r.op == "clear":
                held.clear()
                changed = True
            else:
                found = list(held)
                if r.op == "latest":
                    found = found[-1:]
                elif r.op == "last":
                    found = found[-int(r.count) :] if r.count == r.count and r.count > 0 else found
                elif r.op == "range":
                    a, b = (int(v.value // 1000) for v in (r.start, r.stop))
                    found = [p for p in found if p[0] is not None and a <= p[0] <= b]
                out.append((key[0], r.ask, len(found), [p[0] for p in found], [p[1] for p in found]))
        if changed:
            self.points.put(list(held)) if held else self.points.clear()
        yield pd.DataFrame.from_records(out, columns=self.columns)

    def close(self) -> None:
        pass


def asked_buffer(events: DataFrame, key: str = "key", capacity: int = 1000, ttl_ms: int | None = None) -> DataFrame:
    """key, ask, n, ts (microseconds), values: answers from the last capacity points of each series of a stream.

    events (key, at, op, ts, value, start, stop, count, ask) are taken in order of at within a micro-batch: put adds a
    point (ts, value), clear forgets the series, and the others answer under their name ask: latest the newest point, last
    the newest count of them (all without one), range those with ts from start to stop. Points are in order of arrival.
    ttl_ms: processing time after which a series that gets no points is forgotten."""
    state_store(events.sparkSession)
    rows = events.select(F.col(key).cast("string").alias("key"), "at", "op", "ts", F.col("value").cast("double").alias("value"), "start", "stop", F.col("count").cast("double").alias("count"), "ask")
    mode = "ProcessingTime" if ttl_ms else "None"
    return rows.groupBy("key").transformWithStateInPandas(_Buffer(capacity, ttl_ms), "key string, ask string, n long, ts array<long>, values array<double>", "append", mode)


LEVELS = "array<struct<price: double, size: double>>"


class _Book(StatefulProcessor):
    columns = ["symbol", "bids", "asks", "trades"]

    def __init__(self, depth: int, keep: int, show: int):
        self.depth, self.keep, self.show = depth, keep, show

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sides = handle.getMapState("sides", "side string", "prices array<double>, sizes array<double>")
        self.trades = handle.getListState("trades", "at long, price double, size double")

    @staticmethod
    def _order(r) -> tuple:
        """A row's place by ts and seq, those without one last."""
        return tuple((True, 0) if pd.isna(v) else (False, v) for v in (r["ts"], r["seq"]))

    def handleInputRows(self, key, rows, timerValues):
        # part by part: a symbol's rows of a micro-batch may not fit in memory
        last, trades = {}, []
        for part in rows:
            part = part.sort_values(["ts", "seq"], kind="stable")
            for side in ("bids", "asks"):
                has = part[part[side].notna()]
                if len(has):
                    r = has.iloc[-1]
                    if side not in last or self._order(r) >= last[side][0]:
                        last[side] = (self._order(r), r[side])
            has = part[part["price"].notna()].tail(self.keep)
            # equal places keep the order in which they came
            trades = sorted([*trades, *((self._order(r), (int(r.ts.value // 1000), float(r.price), float(r["size"]))) for _, r in has.iterrows())], key=lambda t: t[0])[-self.keep :]
        for side, (_, levels) in last.items():
            sign = -1 if side == "bids" else 1
            best = sorted(((v["price"], v["size"]) for v in levels), key=lambda v: (sign * v[0], v[1]))[: self.depth]
            self.sides.updateValue((side,), ([v[0] for v in best], [v[1] for v in best]))
        new = [t for _, t in trades]
        trades = [*(tuple(t) for t in self.trades.get()), *new][-self.keep :]
        if new:
            self.trades.put(trades)
        side = lambda name: [{"price": p, "size": s} for p, s in zip(*self.sides.getValue((name,)), strict=True)] if self.sides.containsKey((name,)) else []
        shown = [{"at": a, "price": p, "size": s} for a, p, s in trades[-self.show :]]
        yield pd.DataFrame({"symbol": [key[0]], "bids": [side("bids")], "asks": [side("asks")], "trades": [shown]})

    def close(self) -> None:
        pass


def stream_book(snapshots: DataFrame, symbol: str = "symbol", depth: int = 10, keep: int = 100, show: int = 20) -> DataFrame:
    """symbol, bids, asks, trades after each micro-batch, for the symbols that it names. Of snapshots (symbol, ts, seq,
    bids, asks, price, size), taken in order of ts and seq, each that has a side replaces that side by its depth best
    levels (bids from the highest price, asks from the lowest), and each with a price adds a trade. keep trades are kept,
    and the last show of them given, the latest last."""
    state_store(snapshots.sparkSession)
    rows = snapshots.select(F.col(symbol).cast("string").alias("symbol"), "ts", F.col("seq").cast("long").alias("seq"), F.col("bids").cast(LEVELS).alias("bids"), F.col("asks").cast(LEVELS).alias("asks"), F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"))
    return rows.groupBy("symbol").transformWithStateInPandas(_Book(depth, keep, show), f"symbol string, bids {LEVELS}, asks {LEVELS}, trades array<struct<at: long, price: double, size: double>>", "update", "None")
