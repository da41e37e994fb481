"""Colours as strings: hexadecimal, rgb(), ramps and palettes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from luminal.functions.hashing import hash_material, hash_string
from luminal.functions.scales import as_column, clamp, js_round

# Palettes and defaults.
DEFAULT = "#00d4aa"
NEGATIVE = "#ff3864"
HEATMAP = ["#0000ff", "#00ff00", "#ffff00", "#ff0000"]
DIVERGING = ["#d73027", "#fee08b", "#1a9850"]
CATEGORICAL = ["#e41a1c", "#377eb8", "#4daf4a", "#984ea3", "#ff7f00", "#ffff33"]
MONOCHROME = ["#f7fbff", "#c6dbef", "#6baed6", "#2171b5", "#08306b"]
CATEGORY10 = ["#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf"]
DOMAIN_COLORS = {
    "temperature": HEATMAP,
    "sales": DIVERGING,
    "risk": ["#fee08b", "#f46d43", "#d73027"],
    "health": ["#f0f9e8", "#7bccc4", "#2b8cbe"],
}
DOMAIN_RANGES = {"temperature": (-10, 40), "sales": (0, 1000000), "percentage": (0, 100), "risk": (0, 1)}
DEFAULT_RANGE = (0, 100)
NAMED = ["red", "green", "blue", "yellow", "orange", "purple", "cyan", "magenta", "white", "black", "gray", "grey", "pink", "brown"]

# Each channel of a ramp as (at 0, slope below the bend, bend, added slope above it).
ROUNDED_RAMPS = {
    "viridis": [(68, 200, 0.5, -400), (1, 250, 1, 0), (234, -150, 1, 0)],
    "plasma": [(61, 240, 1, 0), None, (150, 105, 1, 0)],
    "blues": [(0, 50, 1, 0), (0, 100, 1, 0), (150, 105, 1, 0)],
    "reds": [(200, 55, 1, 0), (0, 80, 1, 0), (0, 80, 1, 0)],
    "greens": [(0, 80, 1, 0), (150, 105, 1, 0), (0, 80, 1, 0)],
    "warm": [(255, 0, 1, 0), (0, 200, 1, 0), (0, 50, 1, 0)],
    "cool": [(0, 50, 1, 0), (0, 200, 1, 0), (255, 0, 1, 0)],
}
CLAMPED_RAMPS = ("viridis", "plasma")
# Channels (at 0, slope) of the material ramps, which are floored.
MATERIAL_RAMPS = {
    "viridis": [(68, 220), (1, 180), (164, -80)],
    "plasma": [(63, 250), (1, 200), (250, -100)],
    "warm": [(255, 0), (100, 155), (0, 100)],
    "cool": [(0, 100), (150, 105), (255, 0)],
}


def pick(palette: Sequence[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in palette]), (index + 1).cast("int"))


def channels(hex_: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue; black for what is no hexadecimal colour."""
    valid = hex_.rlike("^#?[0-9A-Fa-f]{6}$")
    part = lambda i: F.when(valid, F.conv(F.substring(F.regexp_replace(hex_, "^#", ""), 2 * i + 1, 2), 16, 10).cast("int")).otherwise(0)
    return part(0), part(1), part(2)


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(js_round(c).cast("long")), 2, "0")) for c in (r, g, b)])


def rgb(r: Column, g: Column, b: Column, gap: str = ", ") -> Column:
    return F.concat(F.lit("rgb("), F.concat_ws(gap, *[c.cast("long").cast("string") for c in (r, g, b)]), F.lit(")"))


def lerp(a: Column, b: Column, t: Column) -> Column:
    """Each channel on its own, rounded."""
    return to_hex(*[x + (y - x) * t for x, y in zip(channels(a), channels(b), strict=True)])


def lighten(color: Column, share: float) -> Column:
    return to_hex(*[F.least(F.lit(255.0), c + (255 - c) * share) for c in channels(color)])


def hsl_hex(h: Column, s: float, l: float) -> Column:
    if not s:
        return to_hex(*[F.lit(l * 255.0)] * 3)
    q = l * (1 + s) if l < 0.5 else l + s - l * s
    p = 2 * l - q

    def channel(t: Column) -> Column:
        t = F.when(t < 0, t + 1).when(t > 1, t - 1).otherwise(t)
        return F.when(t < 1 / 6, p + (q - p) * 6 * t).when(t < 1 / 2, F.lit(q)).when(t < 2 / 3, p + (q - p) * (2 / 3 - t) * 6).otherwise(F.lit(p))

    return to_hex(*[channel(h + d) * 255 for d in (1 / 3, 0.0, -1 / 3)])


def hash_color(s: Column) -> Column:
    """A hue from the text's hash, at saturation 0.7 and lightness 0.5."""
    return hsl_hex((hash_string(s) % 360) / 360.0, 0.7, 0.5)


def ramp(t: Column, name: str) -> Column:
    """Ramp colour with rounded channels; t is not clamped."""

    def channel(spec) -> Column:
        if spec is None:  # plasma's green falls back after the middle
            c = F.when(t < 0.5, t * 200).otherwise(100 + (1 - t) * 100)
        else:
            base, slope, bend, more = spec
            c = base + t * slope + (F.when(t > bend, (t - bend) * more).otherwise(0) if more else 0)
        return js_round(clamp(c, 0.0, 255.0) if name in CLAMPED_RAMPS else c)

    return rgb(*[channel(c) for c in ROUNDED_RAMPS[name]])


def material_ramp(t: Column, name: str) -> Column:
    t = clamp(t)
    return rgb(*[F.floor(F.lit(float(a)) + t * b) for a, b in MATERIAL_RAMPS[name]], gap=",")


def category10(value: Column, numeric: bool = False) -> Column:
    """Material palette: a number by its remainder, a string by its hash, null the first colour."""
    i = F.pmod(value.cast("long"), F.lit(10)) if numeric else hash_material(value) % 10
    return F.coalesce(pick(CATEGORY10, i), F.lit(CATEGORY10[0]))


def first_letter_color(value: Column) -> Column:
    return pick(CATEGORY10, F.coalesce(F.ascii(value.cast("string")), F.lit(0)) % 10)


def sign_color(value: Column) -> Column:
    return F.when(value >= 0, F.lit(DEFAULT)).otherwise(F.lit(NEGATIVE))


def heatmap(value: Column, low: float, high: float, palette: Sequence[str] = tuple(HEATMAP)) -> Column:
    """Between neighbouring colours of the palette, clamped."""
    at = clamp((value.cast("double") - low) / (high - low)) * (len(palette) - 1)

    def channel(i: int, at: Column) -> Column:
        levels = F.array(*[F.lit(int(c[1 + 2 * i : 3 + 2 * i], 16)) for c in palette])
        below = F.element_at(levels, (F.floor(at) + 1).cast("int"))
        return below + (F.element_at(levels, (F.ceil(at) + 1).cast("int")) - below) * (at - F.floor(at))

    # an array of one, so that the place is worked out once
    return F.transform(F.array(at), lambda x: to_hex(*[channel(i, x) for i in range(3)]))[0]


def domain_color(value: Column, domain: str | None, scale: str | None, kind: str | None, id_: Column) -> Column:
    """By scale and kind of data: a palette by hash, a heat map, steps, or a hue from the id."""
    if scale == "nominal" or kind == "categorical":
        palette = DOMAIN_COLORS.get(domain, CATEGORICAL)
        return pick(palette, hash_string(value.cast("string")) % len(palette))
    if scale == "continuous" or kind == "quantitative":
        return heatmap(value, *DOMAIN_RANGES.get(domain, DEFAULT_RANGE), DOMAIN_COLORS.get(domain, HEATMAP))
    if scale == "ordinal":
        palette = DOMAIN_COLORS.get(domain, DIVERGING)
        i = F.least(value.cast("long"), F.lit(len(palette) - 1))
        return F.coalesce(F.when(i >= 0, pick(palette, i)), F.lit(palette[0]))
    return hash_color(id_)


def transform_color(value: Column, name: str | None) -> Column:
    """The colour of a $data spec with $map name."""
    if name in ROUNDED_RAMPS:
        return ramp(value.cast("double"), name)
    if name == "category10":
        return first_letter_color(value)
    if name and ("diverging" in name or "rdgy" in name):
        return sign_color(value)
    return F.lit(DEFAULT)


def material_color(value: Column, name: str) -> Column:
    if name in MATERIAL_RAMPS:
        return material_ramp(value.cast("double"), name)
    if name == "category10":
        return category10(value)
    if name in ("rdgy", "diverging-rdgy"):
        return sign_color(value)
    return F.coalesce(value.cast("string"), F.lit(DEFAULT))


def embedding_color(emb: Column) -> Column:
    """The first three numbers, from -1 to 1, as red, green and blue."""
    part = lambda i: clamp(F.floor((F.get(emb, i).cast("double") + 1) * 127.5), 0, 255)
    return F.when(F.size(emb) >= 3, rgb(part(0), part(1), part(2))).otherwise(F.lit(DEFAULT))


def similarity_color(s: Column, base: str = "#00d4aa", high: str = "#00ffff", low: str = "#ff3864") -> Column:
    return F.when(s > 0.7, F.lit(high)).when(s > 0.4, lerp(F.lit(base), F.lit(high), (s - 0.4) / 0.3)).otherwise(lerp(F.lit(low), F.lit(base), s / 0.4))


def heat_level(x) -> Column:
    v = as_column(x)
    return F.when(v < 33, F.lit("#00ff00")).when(v < 66, F.lit("#ffff00")).otherwise(F.lit("#ff0000"))


def is_valid_color(c: Column) -> Column:
    """#rgb, #rrggbb, rgb(r, g, b) or one of the known names."""
    return F.coalesce(c.rlike(r"^#([0-9A-Fa-f]{6}|[0-9A-Fa-f]{3})$") | c.rlike(r"^rgb\(\s*\d+\s*,\s*\d+\s*,\s*\d+\s*\)$") | F.lower(c).isin(*NAMED), F.lit(False))
