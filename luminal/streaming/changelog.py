"""A table kept as a base and the changes since, with gapless sequence numbers.

Each batch of changes is written once, as a delta; nothing else moves. Deltas are merged eight by eight, as in a
log-structured tree, and a new base is written only when the changes amount to a share of it, so what is written follows
what is changed. A manifest, written last, names the folders that count; a write that breaks off leaves files that
no manifest names, and a batch that comes again is known by its epoch and passed over. There is one writer."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from luminal.operators.common import ordinal

FANOUT = 8  # deltas of a tier that are merged into one of the next
ENTRY = "kind string, folder string, first long, last long, n long, tier int, source string, epoch long"
REMOVED = ("remove", "delete")


def _names(spark: SparkSession, path: str) -> list[str]:
    """The entries of a folder, none if there is no folder."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def _drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@dataclass
class State:
    """What a manifest says: base (folder, last, n), deltas (folder, first, last, n, tier) in order, and epochs."""

    number: int = -1
    last: int = 0
    base: tuple[str, int, int] | None = None
    deltas: list[tuple[str, int, int, int, int]] = field(default_factory=list)
    epochs: dict[str, int] = field(default_factory=dict)


class ChangeLog:
    """A table at path by id_col. share: the part of the base's rows that changes may amount to before they are folded
    into a new base; None never does so."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "id", share: float | None = 0.25):
        self.spark, self.path, self.id_col, self.share = spark, path.rstrip("/"), id_col, share

    def state(self) -> State:
        whole = [n for n in _names(self.spark, f"{self.path}/log") if "_SUCCESS" in _names(self.spark, f"{self.path}/log/{n}")]
        if not whole:
            return State()
        out = State(number=int(whole[-1]))
        # a row for each live folder and each source
        for r in sorted(self.spark.read.schema(ENTRY).parquet(f"{self.path}/log/{whole[-1]}").collect(), key=lambda r: r.first or 0):
            if r.kind == "base":
                out.base = (r.folder, r.last, r.n)
            elif r.kind == "delta":
                out.deltas.append((r.folder, r.first, r.last, r.n, r.tier))
            elif r.kind == "epoch":
                out.epochs[r.source] = r.epoch
            else:
                out.last = r.last
        return out

    def _commit(self, s: State) -> State:
        rows = [("last", None, None, s.last, None, None, None, None)]
        rows += [("base", s.base[0], None, s.base[1], s.base[2], None, None, None)] if s.base else []
        rows += [("delta", *d, None, None) for d in s.deltas] + [("epoch", None, None, None, None, None, k, v) for k, v in s.epochs.items()]
        s.number += 1
        # what stands there under this number is of a writer that broke off
        self.spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/{s.number:012d}")
        return s

    def _write(self, df: DataFrame, kind: str) -> tuple[str, int]:
        seen, folder = Observation(), f"{kind}/{uuid.uuid4().hex}"
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/{folder}")
        return folder, seen.get["n"]

    def append(self, changes: DataFrame, order: list[str] | None = None, source: str = "", epoch: int | None = None) -> int:
        """Adds changes (id, op, columns; add and update carry whole rows) and gives the last sequence number. Within the
        batch they are numbered in order of order, by default of their own seq if they have one, then of the id; where
        that is the same, by all their values. A batch of a source whose epoch has been taken is passed over."""
        s = self.state()
        if epoch is not None and epoch <= s.epochs.get(source, -1):
            return s.last
        order = order or (["seq"] if "seq" in changes.columns else [])
        rest = [c for c in changes.columns if c not in (*order, self.id_col)]
        rows = ordinal(changes, *order, self.id_col, *rest, name="_seq").withColumn("_seq", F.col("_seq") + s.last + 1)
        folder, n = self._write(rows.drop("seq").withColumnRenamed("_seq", "seq"), "delta")
        if n:
            s.deltas.append((folder, s.last + 1, s.last + n, n, 0))
            s.last += n
        if epoch is not None:
            s.epochs[source] = epoch
        self._commit(self._merged(s))
        changed, base = sum(d[3] for d in s.deltas), s.base[2] if s.base else 0
        if self.share is not None and changed > self.share * base:
            self.compact()
        return s.last

    def _merged(self, s: State) -> State:
        while len(s.deltas) >= FANOUT and len({d[4] for d in s.deltas[-FANOUT:]}) == 1:
            some = s.deltas[-FANOUT:]
            # as many files as the rows fill, about 100,000 in each
            files = max(1, sum(d[3] for d in some) // 100_000)
            folder, n = self._write(self._rows(some).coalesce(files), "delta")
            s.deltas[-FANOUT:] = [(folder, some[0][1], some[-1][2], n, some[0][4] + 1)]
        return s

    def _rows(self, deltas: list) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{d[0]}" for d in deltas])

    def compact(self) -> None:
        """Folds the deltas into a new base; since() then goes back to it only."""
        s = self.state()
        if s.deltas:
            folder, n = self._write(self._table(s), "base")
            s.base, s.deltas = (folder, s.last, n), []
            self._commit(s)

    def _table(self, s: State, at: int | None = None) -> DataFrame | None:
        base = self.spark.read.parquet(f"{self.path}/{s.base[0]}") if s.base else None
        deltas = [d for d in s.deltas if at is None or d[1] <= at]
        if not deltas:
            return base
        rows = self._rows(deltas)
        rows = rows.filter(F.col("seq") <= at) if at is not None else rows
        values = [c for c in rows.columns if c not in (self.id_col, "op", "seq")]
        last = rows.groupBy(self.id_col).agg(F.max_by(F.struct("op", *values), "seq").alias("_c"))
        live = last.filter(~F.col("_c.op").isin(*REMOVED)).select(self.id_col, *[F.col(f"_c.{c}").alias(c) for c in values])
        if base is None:
            return live
        kept = base.join(last.select(F.col(self.id_col).alias("_id")), base[self.id_col].eqNullSafe(F.col("_id")), "left_anti")
        return kept.unionByName(live, allowMissingColumns=True)

    def table(self, at: int | None = None) -> DataFrame:
        """The table now, or after change number at, which must not be folded into the base."""
        s = self.state()
        if at is not None and s.base and at < s.base[1]:
            raise ValueError(f"changes up to {s.base[1]} are folded into the base")
        out = self._table(s, at)
        if out is None:
            raise ValueError("nothing has been written")
        return out

    def since(self, seq: int = 0) -> DataFrame:
        """The changes after number seq, with their seq. Those folded into the base are gone: ask for the table then."""
        s = self.state()
        if s.base and seq < s.base[1]:
            raise ValueError(f"changes up to {s.base[1]} are folded into the base")
        deltas = [d for d in s.deltas if d[2] > seq]
        if not deltas:
            return self._rows(s.deltas[-1:]).limit(0) if s.deltas else self.spark.createDataFrame([], f"{self.id_col} string, op string, seq long")
        return self._rows(deltas).filter(F.col("seq") > seq)

    def vacuum(self) -> int:
        """Deletes what the newest manifest does not name, and gives how many folders went. Readers of an older state fail."""
        s = self.state()
        live = {d[0] for d in s.deltas} | ({s.base[0]} if s.base else set())
        gone = [f"{k}/{n}" for k in ("base", "delta") for n in _names(self.spark, f"{self.path}/{k}") if f"{k}/{n}" not in live]
        gone += [f"log/{n}" for n in _names(self.spark, f"{self.path}/log") if int(n) != s.number]
        for g in gone:
            _drop(self.spark, f"{self.path}/{g}")
        return len(gone)

    def sink(self, source: str = "feed") -> Callable[[DataFrame, int], None]:
        """For publish: each micro-batch of changes is appended once, however often it runs."""
        return lambda batch, epoch: self.append(batch, source=source, epoch=epoch) and None
