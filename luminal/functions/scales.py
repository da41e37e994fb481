"""Scales from data to visual ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """NaN stays NaN and null stays null."""
    return F.when(F.isnan(x.cast("double")) | x.isNull(), x).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def js_round(x: Column) -> Column:
    """Half towards positive infinity."""
    return F.floor(x + 0.5)


EASINGS = {
    "ease": lambda t: F.when(t < 0.5, 4 * t * t * t).otherwise(1 - F.pow(-2 * t + 2, F.lit(3.0)) / 2),
    "ease-in": lambda t: t * t,
    "ease-out": lambda t: 1 - (1 - t) * (1 - t),
}


def ease(t: Column, name: str | None) -> Column:
    """t itself for any other name."""
    return EASINGS[name](t) if name in EASINGS else t


def normalise(x: Column, domain: Sequence[float], clamped: bool = True) -> Column:
    """Position of x in domain; 0 throughout a domain of one point."""
    low, high = map(float, domain)
    t = F.lit(0.0) + F.when(x.isNotNull(), 0.0) if low == high else (x - low) / (high - low)
    return clamp(t) if clamped else t


def scale(x, domain: Sequence[float], range_: Sequence[float], interpolate: str | None = None) -> Column:
    """x carried from domain to range, clamped; null stays null."""
    low, high = map(float, range_)
    return low + ease(normalise(as_column(x).cast("double"), domain), interpolate) * (high - low)


def map_range(x, domain: Sequence[float], range_: Sequence[float]) -> Column:
    """As scale, but null gives the range's start."""
    return F.coalesce(scale(x, domain, range_), F.lit(float(range_[0])))


def step(x: Column, size: float) -> Column:
    """To the nearest multiple of size; size 0 changes nothing."""
    return js_round(x / size) * size if size else x


def log_scale(x, domain: Sequence[float], range_: Sequence[float]) -> Column:
    """By decimal logarithm; null and what is not above 0 give the range's start."""
    import math

    low, high = (math.log10(d) for d in domain)
    a, b = map(float, range_)
    v = as_column(x).cast("double")
    return F.when(v > 0, a + clamp((F.log10(v) - low) / (high - low)) * (b - a)).otherwise(F.lit(a))


def quantize(x, domain: Sequence[float], bins: Sequence) -> Column:
    """Bins of equal width; values outside the domain fall in the end bins."""
    n = len(bins)
    i = F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(normalise(as_column(x).cast("double"), domain, clamped=False) * n)))
    return F.element_at(F.array(*[F.lit(b) for b in bins]), (i + 1).cast("int"))


def threshold(x, cuts: Sequence[float], values: Sequence) -> Column:
    """values[i] for x below cuts[i]; the last of values from the last cut on."""
    v, out = as_column(x), F.lit(values[-1])
    for cut, value in reversed(list(zip(cuts, values, strict=False))):
        out = F.when(v < cut, F.lit(value)).otherwise(out)
    return F.when(v.isNotNull(), out)


def ordinal(x, mapping: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in reversed(mapping.items()):
        out = F.when(as_column(x) == F.lit(k), F.lit(v)).otherwise(out)
    return out


def time_scale(ts, start, end, range_: Sequence[float]) -> Column:
    """A timestamp carried from [start, end] to range; start and end are columns or literals."""
    us = lambda c: F.unix_micros(as_column(c).cast("timestamp")).cast("double")
    a, b = map(float, range_)
    t = F.coalesce(F.try_divide(us(ts) - us(start), us(end) - us(start)), F.lit(0.0))
    return a + clamp(t) * (b - a)


def diverging(x, domain: Sequence[float], values: Sequence[float]) -> Column:
    """Piecewise linear over three points of domain and range."""
    (a, b, c), (p, q, r) = domain, values
    v = as_column(x).cast("double")
    return F.when(v < b, scale(v, (a, b), (p, q))).otherwise(scale(v, (b, c), (q, r)))


def piecewise(x, points: Sequence[tuple[float, float]]) -> Column:
    """Linear between control points (value, result); beyond them the line between the first and the last goes on."""
    v = as_column(x).cast("double")
    line = lambda p, q: p[1] + (v - p[0]) / float((q[0] - p[0]) or 1) * (q[1] - p[1])
    out = line(points[0], points[-1])
    for p, q in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when((v >= p[0]) & (v <= q[0]), line(p, q)).otherwise(out)
    return out
