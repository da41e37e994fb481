"""The transform language: {$data, $domain, $map, $range, $interpolate, $step, $if, $format} compiled to columns."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from luminal.functions.scales import clamp, ease, normalise, scale, step


def field(path: str) -> Column:
    """A dotted path; a segment of digits is an index into an array (null beyond its end)."""
    first, *rest = path.split(".")
    out = F.col(f"`{first}`")
    for part in rest:
        out = F.get(out, F.lit(int(part))) if part.isdigit() else out.getField(part)
    return out


def compile_transform(spec: Any) -> Column:
    """A spec that is no dict is a constant. Without $data the value is the whole record. Order: $data, $domain
    (normalised and clamped), $map (kept if nothing matches), $range (overwrites; eased), $step. A $domain that is
    not two numbers is an error; one of one point gives the range's start. Null stays null."""
    if not isinstance(spec, dict):
        return F.lit(spec)
    value = field(spec["$data"]) if spec.get("$data") else F.struct("*")
    domain, range_, mapping = spec.get("$domain"), spec.get("$range"), spec.get("$map")
    if domain is not None and (not isinstance(domain, (list, tuple)) or len(domain) != 2):
        raise ValueError("$domain must be two numbers")
    t = normalise(value.cast("double"), domain) if domain is not None else None
    if isinstance(mapping, dict) and "from" in mapping and len(mapping["from"]) == len(mapping.get("to", [])):
        mapped = value.cast("string") if all(isinstance(x, str) for x in mapping["to"]) else value
        for a, b in reversed(list(zip(mapping["from"], mapping["to"], strict=True))):
            mapped = F.when(value == F.lit(a), F.lit(b)).otherwise(mapped)
        value = mapped
    elif domain is not None and range_ is None:
        value = t
    if range_ is not None:
        t = t if t is not None else clamp(value.cast("double"))
        low, high = map(float, range_)
        value = low + ease(t, spec.get("$interpolate")) * (high - low)
    if spec.get("$step"):
        value = step(value.cast("double"), float(spec["$step"]))
    if "$if" in spec:
        value = F.when(value.cast("boolean"), F.lit(spec["$if"][0])).otherwise(F.lit(spec["$if"][1]))
    if "$calculate" in spec:  # a function of a column that gives a column
        value = spec["$calculate"](value)
    if "$format" in spec:
        value = F.format_string(spec["$format"], value)
    return value


def transform_records(df: DataFrame, spec: Any, out: str = "value") -> DataFrame:
    return df.select(compile_transform(spec).alias(out))


def transform_fields(df: DataFrame, specs: dict[str, Any]) -> DataFrame:
    """Adds or overwrites fields, each worked out from the record as it was."""
    return df.withColumns({k: compile_transform(v) for k, v in specs.items()})


def create_scale(domain, range_, interpolate: str | None = None):
    return lambda x: scale(x, domain, range_, interpolate)


def parse_value(text: str) -> Any:
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        try:
            return json.loads(text)
        except ValueError:
            return [parse_value(x) for x in text[1:-1].split(",")]
    if text.startswith("{"):
        try:
            return json.loads(text)
        except ValueError:
            return text
    if re.fullmatch(r"-?\d+(\.\d+)?", text):
        return float(text) if "." in text else int(text)
    if text in ("true", "false"):
        return text == "true"
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def parse_transform_expression(text: Any) -> dict[str, Any]:
    """'$data: x; $range: [1, 5]' to a spec; parts of another form are passed over."""
    if not isinstance(text, str):
        return {}
    found = (re.fullmatch(r"\s*(\$\w+)\s*:\s*(.+?)\s*", part, re.S) for part in text.split(";"))
    return {m[1]: parse_value(m[2]) for m in found if m}


def label(template: str, df: DataFrame) -> Column:
    """A template with {field} parts; a field that is missing, null, empty, 0 or false keeps its braces."""
    parts = re.split(r"(\{[\w.]+\})", template)
    names = set(df.columns)

    def piece(p: str) -> Column:
        if not re.fullmatch(r"\{[\w.]+\}", p) or p[1:-1].split(".")[0] not in names:
            return F.lit(p)
        v = field(p[1:-1])
        text = v.cast("string")
        return F.when(text.isNull() | text.isin("", "0", "0.0", "false"), F.lit(p)).otherwise(text)

    return F.concat(*[piece(p) for p in parts if p])
