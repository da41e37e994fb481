"""Snapshots of an engine's datasets and settings: written whole or not at all, and checked when they are read."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from luminal.streaming.changelog import _names

ENTRY = "kind string, name string, folder string, n long, digest string, schema string, value string"
VERSION = "1"


def _facts(df: DataFrame):
    """Rows of df, and a digest that does not depend on their order: two sums of hashes of whole rows."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])) if df.columns else F.lit("")
    halves = [F.sum(F.pmod(F.xxhash64(row, F.lit(salt)), F.lit(1 << 40)).cast("decimal(38,0)")) for salt in (1, 2)]
    return df.agg(F.count("*").alias("n"), F.concat_ws("-", *[F.coalesce(h, F.lit(0)).cast("string") for h in halves]).alias("digest"))


def export_state(spark: SparkSession, path: str, datasets: dict[str, DataFrame], settings: dict | None = None) -> int:
    """Writes the datasets and settings (what JSON holds) below path and gives the snapshot's number. Each dataset goes to a
    folder of its own; the manifest that names them, with their rows, digests and schemas, is written last, so a snapshot
    that breaks off is none."""
    have = [int(n) for n in _names(spark, f"{path}/manifest")]
    number, rows = max(have, default=-1) + 1, []
    for name, df in datasets.items():
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{path}/{folder}")
        kept = spark.read.schema(df.schema).parquet(f"{path}/{folder}")
        facts = _facts(kept).first()
        rows.append(("dataset", name, folder, facts.n, facts.digest, df.schema.json(), None))
    rows += [("setting", k, None, None, None, None, json.dumps(v)) for k, v in {"version": VERSION, "packetCount": len(datasets), **(settings or {})}.items()]
    spark.createDataFrame(rows, ENTRY).coalesce(1).write.parquet(f"{path}/manifest/{number:012d}")
    return number


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the snapshots that are whole."""
    return [int(n) for n in _names(spark, f"{path}/manifest") if "_SUCCESS" in _names(spark, f"{path}/manifest/{n}")]


def restore_state(spark: SparkSession, path: str, number: int | None = None, check: bool = True) -> tuple[dict[str, DataFrame], dict]:
    """The datasets and settings of a snapshot, by default the last whole one. With check, rows and digests are compared
    with the manifest, and what has changed since is an error."""
    whole = snapshots(spark, path)
    if not whole or number is not None and number not in whole:
        raise ValueError(f"no whole snapshot {'' if number is None else number} at {path}")
    number = whole[-1] if number is None else number
    datasets, settings = {}, {}
    for r in spark.read.schema(ENTRY).parquet(f"{path}/manifest/{number:012d}").collect():
        if r.kind == "setting":
            settings[r.name] = json.loads(r.value)
            continue
        df = spark.read.schema(StructType.fromJson(json.loads(r.schema))).parquet(f"{path}/{r.folder}")
        if check:
            facts = _facts(df).first()
            if (facts.n, facts.digest) != (r.n, r.digest):
                raise ValueError(f"{r.name} is not what was written: {facts.n} rows, {r.n} then")
        datasets[r.name] = df
    return datasets, settings
