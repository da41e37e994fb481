"""One call from records to placed, coloured and sized records."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luminal.functions import color
from luminal.operators import graph, layouts, mapping
from luminal.operators.common import ordinal, with_totals
from luminal.sources.records import Registry, load, validate_spec

SHORT = {"bar": "grid", "line": "timeline", "network": "force", "scatter": "scatter", "pie": "radial", "tree": "tree", "grid": "grid", "radial": "radial", "timeline": "timeline", "spiral": "spiral"}
PRESETS = {
    "bar_chart": {"type": "bar", "layout": "bar-row"},
    "network": {"type": "network", "layout": "force"},
    "timeline": {"type": "line", "layout": "timeline"},
    "scatter": {"type": "scatter", "layout": "scatter"},
}


def quick_start(spark: SparkSession, data, type: str = "bar", layout: str | None = None, order: list | None = None, colors: str | None = None, labels: bool = True, **options) -> DataFrame:
    """Records with id, value, label, x, y, z, size and color. Bare numbers become records; a missing value is 0 and a
    missing id item-<place>; the size is the value's place between the least and the greatest."""
    if isinstance(data, list) and data and not isinstance(data[0], dict):
        data = spark.createDataFrame([(i, float(v)) for i, v in enumerate(data)], "row long, value double")
        order = order or ["row"]
    df = load(spark, data)
    order = order or ["id"]
    d = ordinal(df, *order)
    have = set(df.columns)
    d = d.withColumn("value", F.coalesce(F.col("value").cast("double"), F.lit(0.0)) if "value" in have else F.lit(0.0))
    name = F.concat(F.lit("item-"), F.col("ord").cast("string"))
    d = d.withColumn("id", F.coalesce(F.col("id").cast("string"), name) if "id" in have else name)
    if labels:
        d = d.withColumn("label", F.coalesce(F.col("label"), F.col("id")) if "label" in have else F.col("id"))
    d = with_totals(d, _lo=F.min("value"), _hi=F.max("value"))
    d = d.withColumn("size", 0.5 + F.coalesce(F.try_divide(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * 1.5).drop("_lo", "_hi")
    d = d.withColumn("color", color.transform_color(F.col("value"), colors) if colors else F.lit(color.DEFAULT))
    return layouts.calculate(d.drop("ord"), layout or SHORT.get(type, "grid"), ["id"] if order == ["row"] else order, **options)


def preset(spark: SparkSession, name: str, data, **options) -> DataFrame:
    return quick_start(spark, data, **(PRESETS[name] | options))


#: What stands where there is neither a spec nor data.
DEFAULT_SPEC = {"id": "default", "geometry": {"type": "octahedron", "radius": 1}, "material": {"properties": {"color": "#00d4aa"}}}
DEFAULT_RECORD = {"value": 42, "label": "Default"}


def load_spec(spec: dict | str | None = None) -> dict:
    """A spec as it is or as JSON; the default one if there is none. JSON that cannot be read is an error."""
    if not spec:
        return DEFAULT_SPEC
    if isinstance(spec, dict):
        return spec
    try:
        return json.loads(spec)
    except ValueError as e:
        raise ValueError(f"Invalid JSON in spec: {e}") from None


def load_data(spark: SparkSession, data=None) -> DataFrame:
    """Records of what records.load reads, or of JSON with or without an envelope; one default record if there is none."""
    if data is None or data == "":
        return load(spark, [DEFAULT_RECORD])
    if isinstance(data, str) and data.lstrip()[:1] in ("{", "["):
        try:
            found = json.loads(data)
        except ValueError as e:
            raise ValueError(f"Invalid JSON in dataset: {e}") from None
        while isinstance(found, dict):
            inner = next((found[k] for k in ("records", "nodes", "data") if found.get(k) is not None), None)
            found = [found] if inner is None else inner
        return load(spark, found)
    return load(spark, data)


def create(spec: dict | str | None, df: DataFrame, order: list, layout: str | None = None, **options) -> DataFrame:
    """Records placed by the spec's layout, with its transforms and materials as columns."""
    spec = load_spec(spec)
    validate_spec(spec)
    t = spec.get("transform") or {}
    name = layout or ((t.get("position") or {}).get("$layout")) or "grid"
    placed = layouts.calculate(df, name, order, **options)
    props = {f"t_{k}": v for k, v in mapping.transforms(t).items()} | {f"m_{k}": v for k, v in mapping.material(spec.get("material")).items()}
    return placed.withColumns(props)


def connect(edges: DataFrame, nodes: DataFrame, **style) -> DataFrame:
    """Edges with both ends, middle, length and a style."""
    return graph.place_edges(edges, nodes).withColumns({k: F.lit(v) for k, v in style.items()})


class Engine:
    """Datasets by name, their layout and visual properties, and a selection."""

    def __init__(self, spark: SparkSession):
        self.datasets, self.mapper, self.selected = Registry(spark), mapping.PropertyMapper(), F.lit(False)

    def layout(self, name: str, order: list, **options) -> DataFrame:
        return layouts.calculate(self.datasets.get(), name, order, **options)

    def map(self, **columns) -> DataFrame:
        return self.mapper.map(self.datasets.get(), **columns)

    def select(self, criteria: dict) -> DataFrame:
        from luminal.functions.predicates import compile_query

        self.selected = F.coalesce(compile_query(criteria), F.lit(False))
        return self.datasets.get().withColumn("selected", self.selected)

    def query(self, form: dict) -> DataFrame:
        """{table, where, order_by, limit} over the datasets by name."""
        from luminal.functions.predicates import query_table

        return query_table(self.datasets, form)

    def export(self, path: str, **settings) -> int:
        """A snapshot of all datasets, the current one's name and settings; see sources.state."""
        from luminal.sources.state import export_state

        spark = self.datasets.spark
        return export_state(spark, path, {n: spark.table(n) for n in sorted(self.datasets.names)}, {"current": self.datasets.current, **settings})

    def restore(self, path: str, number: int | None = None) -> dict:
        """The datasets of a snapshot, the last one by default, become this engine's; gives the settings."""
        from luminal.sources.state import restore_state

        datasets, settings = restore_state(self.datasets.spark, path, number)
        for name, df in datasets.items():
            self.datasets.load(name, df)
        if settings.get("current"):
            self.datasets.switch(settings["current"])
        return settings

    def stats(self) -> dict:
        from luminal.operators.aggregates import stats

        return stats(self.datasets.get())


class Scene:
    """Named results that can be replaced, laid out anew and exported."""

    def __init__(self):
        self.parts: dict[str, DataFrame] = {}

    def register(self, name: str, df: DataFrame) -> None:
        self.parts[name] = df

    update = register

    def remove(self, name: str) -> None:
        del self.parts[name]

    def set_layout(self, name: str, layout: str, order: list, **options) -> DataFrame:
        self.parts[name] = layouts.calculate(self.parts[name].drop("x", "y", "z", "ord"), layout, order, **options)
        return self.parts[name]

    def export(self, path: str) -> None:
        for name, df in self.parts.items():
            df.write.parquet(f"{path}/{name}")
