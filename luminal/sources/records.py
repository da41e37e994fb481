"""JSON envelopes, messages, datasets by name, made-up samples and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of geometry, and what may trigger a behaviour.
TYPES = ("sphere", "box", "cone", "cylinder", "octahedron", "dodecahedron", "icosahedron", "tetrahedron", "torus", "plane", "ring", "text")
TRIGGERS = ("hover", "hover-leave", "click", "idle", "load", "update")


def load_tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    """Parquet tables of a folder. Times without a zone are read as timestamps, in UTC: as a schema rather than a cast,
    so that filters on them still reach the scan."""
    out = []
    for n in names:
        path = f"{folder}/{n}.parquet"
        df = spark.read.parquet(path)
        if any(t == "timestamp_ntz" for _, t in df.dtypes):
            kinds = ", ".join(f"`{c}` {'timestamp' if t == 'timestamp_ntz' else t}" for c, t in df.dtypes)
            df = spark.read.schema(kinds).parquet(path)
        out.append(df)
    return out


def extract_records(df: DataFrame) -> DataFrame:
    """The rows of an envelope: its records, nodes or data, the first that is not null; else the rows themselves."""
    arrays = [c for c in ("records", "nodes", "data") if dict(df.dtypes).get(c, "").startswith("array<struct")]
    return df.select(F.inline(F.coalesce(*[F.col(c) for c in arrays]))) if arrays else df


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return extract_records(spark.read.json(path, schema=schema, multiLine=True))


def load(spark: SparkSession, source) -> DataFrame:
    """A DataFrame as it is, a list of dicts, or a path by its ending."""
    from luminal.sources.csv import read_csv

    if isinstance(source, DataFrame):
        return source
    if isinstance(source, list):
        return spark.createDataFrame(source)
    if not isinstance(source, str):
        raise TypeError("a source is a DataFrame, a list of records or a path")
    if source.endswith((".csv", ".tsv")):
        return read_csv(spark, source)
    if source.endswith((".json", ".jsonl")):
        return read_json(spark, source)
    return spark.read.parquet(source)


def field_table(df: DataFrame, fields: list[str], data: str = "data") -> DataFrame:
    """Rows of a column-wise feed, {fields, data: [[...], ...]}, by the fields' names."""
    rows = df.select(F.explode(data).alias("_r"))
    return rows.select(*[F.get("_r", i).alias(f) for i, f in enumerate(fields)])


def parse_message(raw: Column, schema: str) -> Column:
    """A message as JSON, else as CSV if it has a comma; null if neither."""
    json = F.from_json(raw, schema)
    csv = F.from_csv(raw, schema)
    return F.when(F.trim(raw).startswith("{"), json).when(F.contains(raw, F.lit(",")), csv)


def from_pairs_json(text: Column) -> Column:
    """Persistence pairs from JSON; what cannot be read is an empty list."""
    return F.coalesce(F.from_json(text, "array<struct<dimension:int,birth:double,death:double,persistence:double>>"), F.array())


class Registry:
    """Datasets by name, as temporary views, with a current one and listeners."""

    def __init__(self, spark: SparkSession):
        self.spark, self.current, self.names, self.listeners = spark, None, set(), []

    def on(self, f: Callable[[str, str], None]) -> None:
        self.listeners.append(f)

    def load(self, name: str, df) -> DataFrame:
        df = load(self.spark, df)
        df.createOrReplaceTempView(name)
        self.names.add(name)
        self.current = name
        for f in self.listeners:
            f("dataset-loaded", name)
        return df

    def switch(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(f"no dataset {name}")
        self.current = name
        for f in self.listeners:
            f("dataset-switched", name)
        return self.spark.table(name)

    def get(self) -> DataFrame | None:
        return self.spark.table(self.current) if self.current else None


def validate_data(df: DataFrame) -> None:
    if not df.columns:
        raise ValueError("data has no columns")


def validate_spec(spec: dict) -> None:
    """All faults of a spec at once."""
    import re

    from luminal.functions.color import NAMED

    faults = []
    if not spec.get("id"):
        faults.append("id is missing")
    kind = (spec.get("geometry") or {}).get("type")
    if kind and kind not in TYPES:
        faults.append(f"unknown geometry {kind}")
    c = ((spec.get("material") or {}).get("properties") or {}).get("color")
    if isinstance(c, str) and not (re.fullmatch(r"#([0-9A-Fa-f]{6}|[0-9A-Fa-f]{3})", c) or re.fullmatch(r"rgb\(\s*\d+\s*,\s*\d+\s*,\s*\d+\s*\)", c) or c.lower() in NAMED):
        faults.append(f"no colour: {c}")
    for b in spec.get("behaviours") or []:
        if b.get("trigger") not in TRIGGERS:
            faults.append(f"unknown trigger {b.get('trigger')}")
        if not b.get("action"):
            faults.append("a behaviour has no action")
    if faults:
        raise ValueError("; ".join(faults))


def sample(spark: SparkSession, kind: str, count: int = 50, seed: int = 42) -> DataFrame:
    """Made-up records: network, timeline (one a day, backwards from 2024-12-31), hierarchy (three children each), or random."""
    i = F.col("id")
    u = F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    d = spark.range(count)
    name = F.concat(F.lit("item-"), i.cast("string")).alias("id")
    if kind == "network":
        return d.select(name, (u * 100).alias("value"), F.array(F.struct(F.concat(F.lit("item-"), F.pmod(F.xxhash64(i, F.lit(seed + 1)), F.lit(count)).cast("string")).alias("to"), F.lit(1.0).alias("weight"), F.lit("link").alias("type"))).alias("links"))
    if kind == "timeline":
        return d.select(name, (u * 100).alias("value"), F.date_sub(F.lit("2024-12-31").cast("date"), i.cast("int")).cast("timestamp").alias("timestamp"))
    if kind == "hierarchy":
        parent = F.when(i > 0, F.concat(F.lit("item-"), F.floor((i - 1) / 3).cast("string")))
        return d.select(name, (u * 100).alias("value"), parent.alias("parent"))
    return d.select(name, (u * 100).alias("value"))


def export(df: DataFrame, path: str, **meta) -> None:
    """Records as JSON lines beside a table of facts about them."""
    df.write.json(f"{path}/records")
    n = df.agg(F.count("*").alias("count")).withColumns({k: F.lit(str(v)) for k, v in meta.items()})
    n.coalesce(1).write.json(f"{path}/meta")
