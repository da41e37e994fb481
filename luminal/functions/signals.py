"""Small measures of points, markets, roads and gaze, and labels of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from luminal.functions.scales import clamp


def point_size(diameter: Column) -> Column:
    return F.greatest(F.lit(0.02), F.log10(diameter / 10 + 1) / 10)


def column_height(volume: Column) -> Column:
    """At least one half, also for a volume that has no logarithm."""
    return F.greatest(F.lit(0.5), F.coalesce(F.ln(volume) / 5, F.lit(0.5)))


def road(x1: Column, z1: Column, x2: Column, z2: Column) -> tuple[Column, Column]:
    """Length, and bearing in degrees."""
    dx, dz = x2 - x1, z2 - z1
    return F.sqrt(dx * dx + dz * dz), F.degrees(F.atan2(dx, dz))


def gaze_confidence(distance: Column, degrees: Column, dwell_ms: Column) -> Column:
    """Near, straight and long looks count more; a dwell of half a second counts in full."""
    return 1 / (1 + distance * 0.1) * F.cos(F.radians(degrees)) * F.least(dwell_ms / 500, F.lit(1.0))


def converge(a: Column, b: Column, done: Column) -> Column:
    """From a sample of a cloud to where it settles."""
    return a + (b - a) * clamp(done)


def fixed(x: Column, digits: int = 2) -> Column:
    """With so many decimals and no grouping, halves away from zero."""
    return F.round(x, digits).cast(f"decimal(38,{digits})").cast("string")


def signed_percent(x: Column) -> Column:
    return F.concat(F.when(x >= 0, "+").otherwise(""), fixed(x), F.lit("%"))


def similarity_band(s: Column) -> Column:
    """Red below 0.3, yellow below 0.7, green from there on."""
    return F.when(s < 0.3, "#ff0000").when(s < 0.7, "#ffff00").otherwise("#00ff00")
