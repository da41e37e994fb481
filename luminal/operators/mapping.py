"""Values to visual properties: geometry, colour, size, opacity, materials, uncertainty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from luminal.functions import color
from luminal.functions.dsl import field
from luminal.functions.scales import clamp, map_range

# What stands for each structure of data, and its size.
GEOMETRY = {"point": "sphere", "vector": "cone", "matrix": "box", "graph": "dodecahedron", "tree": "icosahedron", "grid": "octahedron", "field": "tetrahedron"}
PALACE_GEOMETRY = {"projects": "octahedron", "research": "dodecahedron", "conversations": "icosahedron", "ideas": "sphere", "tasks": "box"}
MATERIAL = {"shader": "standard", "color": color.DEFAULT, "emissive": "#000000", "emissiveIntensity": 0.0, "opacity": 1.0, "metalness": 0.5, "roughness": 0.5, "wireframe": False}


def lookup(value: Column, table: dict, default=None) -> Column:
    """A small dictionary as a map literal."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, value), F.lit(default)) if default is not None else F.try_element_at(pairs, value)


def geometry(structure: Column) -> Column:
    return lookup(structure, GEOMETRY, "sphere")


def size(importance: Column, confidence: Column) -> Column:
    return (0.5 + F.coalesce(importance, F.lit(0.5)) * 1.5) * F.coalesce(confidence, F.lit(1.0))


def opacity(confidence: Column, uncertainty: Column) -> Column:
    return F.greatest(F.lit(0.3), F.coalesce(confidence, F.lit(1.0)) * (1 - F.coalesce(uncertainty, F.lit(0.0)) * 0.5))


def emissive_intensity(importance: Column) -> Column:
    """An importance of 0 counts as none given."""
    return 0.3 + F.coalesce(F.nullif(importance, F.lit(0.0)), F.lit(0.5)) * 0.7


class PropertyMapper:
    """Maps records to visual properties by the semantics of their value, with overrides and mappings of one's own."""

    def __init__(self):
        self.custom: dict[tuple[str, str], Callable[[Column], Column]] = {}

    def register(self, data: str, visual: str, f: Callable[[Column], Column]) -> None:
        self.custom[data, visual] = f

    def apply_custom(self, data: str, visual: str) -> Column:
        f = self.custom.get((data, visual))
        return f(field(data)) if f else F.lit(None)

    def map(self, df: DataFrame, value: str = "value", id_col: str = "id", scale: str | None = None, kind: str | None = None, domain: str | None = None, structure: str | None = None, importance: str | None = None, confidence: str | None = None, uncertainty: str | None = None, overrides: dict[str, Column] | None = None) -> DataFrame:
        """df with geometry, color, emissive, emissive_intensity, size, opacity, metalness, roughness and animate.
        Names that are given are columns; overrides win where they are not null."""
        get = lambda c, default=None: F.col(c) if c else F.lit(default)
        weight = F.coalesce(get(importance).cast("double"), F.lit(0.5))
        c = color.domain_color(F.col(value), domain, scale, kind, F.col(id_col).cast("string"))
        props = {
            "geometry": geometry(get(structure).cast("string")), "color": c, "size": size(weight, get(confidence).cast("double")),
            "opacity": opacity(get(confidence).cast("double"), get(uncertainty).cast("double")), "emissive_intensity": emissive_intensity(weight),
            "metalness": F.lit(0.8), "roughness": F.lit(0.2), "animate": (weight > 0.8) | F.lit(kind == "temporal"),
        }
        out = df.withColumns(props)
        out = out.withColumn("emissive", F.when(weight > 0.8, color.lighten(F.col("color"), 0.3)).otherwise(F.col("color")))
        for k, v in (overrides or {}).items():
            out = out.withColumn(k, F.coalesce(v, F.col(k)) if k in out.columns else v)
        for (data, visual), f in self.custom.items():
            if data.split(".")[0] in df.columns:
                out = out.withColumn(visual, f(field(data)))
        return out


def material(spec: dict | None) -> dict[str, Column]:
    """Material properties: literals, or {$data, $map or $range, default}."""
    out = {k: F.lit(v) for k, v in MATERIAL.items()}
    for k, v in ((spec or {}).get("properties", spec) or {}).items():
        if not isinstance(v, dict):
            out[k] = F.lit(v)
        elif v.get("$data"):
            data = field(v["$data"])
            if k == "color" and v.get("$map"):
                out[k] = color.material_color(data, v["$map"])
            elif v.get("$range"):
                out[k] = map_range(data, v.get("$domain", (0, 100)), v["$range"])
            else:
                out[k] = F.coalesce(data, F.lit(v.get("default", MATERIAL.get(k))))
    out["transparent"] = out["opacity"].cast("double") < 1
    return out


def transforms(spec: dict) -> dict[str, Column]:
    """scale, rotation_x/y/z, position_x/y/z (null under a layout) and color of a transform spec."""
    out: dict[str, Column] = {}
    s = spec.get("scale")
    out["scale"] = map_range(field(s["$data"]), s.get("$domain", (0, 100)), s.get("$range", (0.5, 2))) if isinstance(s, dict) and s.get("$data") else F.lit(float(s or 1)) if not isinstance(s, dict) else F.lit(1.0)
    p, r = spec.get("position") or {}, spec.get("rotation") or {}
    for a in "xyz":
        out["position_" + a] = F.lit(None).cast("double") if not p or p.get("$layout") else F.lit(float(p.get(a) or 0))
        v = r.get(a)
        out["rotation_" + a] = F.coalesce(field(v["$data"]).cast("double"), F.lit(0.0)) if isinstance(v, dict) else F.lit(float(v or 0)) if r else F.lit(None).cast("double")
    c = spec.get("color")
    out["color"] = color.transform_color(field(c["$data"]), c.get("$map")) if isinstance(c, dict) and c.get("$data") else F.lit(c or color.DEFAULT)
    return out


def uncertainty(confidence: Column, intensity: float = 0.5) -> dict[str, Column]:
    """Pulse, flicker, ghosts and blur of a confidence from 0 to 1."""
    doubt = 1 - confidence
    return {
        "pulse_base": confidence, "pulse_range": doubt * intensity, "pulse_period": 1000 + doubt * 2000, "pulse_scale": confidence < 0.3,
        "flicker_rate": doubt * 10, "ghosts": (F.floor(doubt * 5) + 1).cast("int"), "blur_radius": F.lit(0.5 * (1 + intensity * 2)), "blur_opacity": F.lit(intensity * 0.3),
    }


def ghosts(df: DataFrame, confidence: str, intensity: float = 0.5) -> DataFrame:
    """A row for each ghost of each record, with its offset and opacity."""
    n = F.floor((1 - F.col(confidence)) * 5) + 1
    d = df.withColumn("_n", n).withColumn("ghost", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))))
    off = (F.col("ghost") - F.col("_n") / 2) * intensity
    return d.withColumns({"x": F.col("x") + off, "y": F.col("y") + off * 0.5, "z": F.col("z") + off, "opacity": 0.2 / F.col("_n")}).drop("_n")


def memory_age(created, now) -> dict[str, Column]:
    age = F.datediff(now, created)
    return {"size": 0.1 + 0.2 / (1 + 0.1 * age), "confidence": F.greatest(F.lit(0.2), 1 - age / 365)}


def window_level(value: Column, center: float, width: float) -> Column:
    """Scanner values to 0..1 by window and level."""
    return clamp((value - center + width / 2) / width)


def lod_geometry(level: Column) -> Column:
    return F.when(level <= 0, "icosahedron").when(level == 1, "octahedron").when(level == 2, "sphere").otherwise("box")


def sensor_status(value: Column, threshold: float) -> Column:
    return F.when(value > threshold, "critical").when(value > threshold * 0.9, "warning").otherwise("normal")
