"""Orbits, near-earth objects and their dates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Semi-major axis (AU), eccentricity, period (years), size, colour.
PLANETS = {
    "Mercury": (0.387, 0.206, 0.241, 0.38, "#8C8C8C"),
    "Venus": (0.723, 0.007, 0.615, 0.95, "#E6E6B8"),
    "Earth": (1.000, 0.017, 1.000, 1.00, "#6B93D6"),
    "Mars": (1.524, 0.093, 1.881, 0.53, "#C1440E"),
    "Jupiter": (5.203, 0.048, 11.86, 11.2, "#D8CA9D"),
    "Saturn": (9.537, 0.054, 29.45, 9.45, "#EAD6B8"),
    "Uranus": (19.19, 0.047, 84.02, 4.00, "#D1E7E7"),
    "Neptune": (30.07, 0.009, 164.8, 3.88, "#5B5DDF"),
}


def mean_anomaly(t: Column, period) -> Column:
    return (t * (2 * math.pi) / period) % (2 * math.pi)


def eccentric_anomaly(m: Column, e, steps: int) -> Column:
    """steps fixed-point steps of Kepler's equation; one array fold, so that the expression stays small."""
    return F.aggregate(F.array_repeat(F.lit(0), steps), m.cast("double"), lambda x, _: m + e * F.sin(x))


def planet_position(t: Column, a, e, period, steps: int = 5) -> dict[str, Column]:
    """In the orbital plane, at t in the unit of period."""
    big = eccentric_anomaly(mean_anomaly(t, period), e, steps)
    nu = 2 * F.atan2(F.sqrt(1 + e) * F.sin(big / 2), F.sqrt(1 - e) * F.cos(big / 2))
    r = a * (1 - e * F.cos(big))
    return {"x": r * F.cos(nu), "y": r * F.sin(nu), "z": F.lit(0.0), "distance": r, "true_anomaly": nu}


def solar_system(t: Column) -> Column:
    """All planets at t years, as an array of (planet, x, y, z, distance, size, color) in their order from the sun."""
    each = []
    for name, (a, e, period, size, color) in PLANETS.items():
        p = planet_position(t, F.lit(a), F.lit(e), F.lit(period))
        each.append(F.struct(F.lit(name).alias("planet"), *[p[k].alias(k) for k in ("x", "y", "z", "distance")], F.lit(float(size)).alias("size"), F.lit(color).alias("color")))
    return F.array(*each)


def _orbit(a: Column, key: Column, start_days: Column, seed: int) -> dict[str, Column]:
    axis = F.when(F.coalesce(a, F.lit(0.0)) != 0, a).otherwise(1.5).cast("double")
    draw = lambda k: F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), key, F.lit(k))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return {"axis": axis, "e": 0.3 + draw(0) * 0.4, "period": F.pow(axis, F.lit(1.5)) * 365.25, "inclination": (draw(1) - 0.5) * 30, "start": F.coalesce(start_days, F.lit(0.0))}


def trajectory(a: Column, key: Column, start_days: Column, seed: int = 42, days: int = 365, every: int = 10) -> Column:
    """The way of a body along an orbit of semi-major axis a (1.5 if null or 0) as an array of (time, x, y, z, distance),
    every so many days from start_days: 37 points over a year. Eccentricity (0.3 to 0.7) and inclination (15 degrees
    either way) are drawn by key and seed; the period is by Kepler's third law."""

    def point(day: Column, o: Column) -> Column:
        def at(big: Column) -> Column:
            p = _inclined(big, o["axis"], o["e"], o["inclination"])
            return F.struct(day.alias("time"), *[p[k].alias(k) for k in ("x", "y", "z", "distance")])

        return _once(eccentric_anomaly(mean_anomaly(day + o["start"], o["period"]), o["e"], 10), at)

    orbit = F.struct(*[c.alias(k) for k, c in _orbit(a, key, start_days, seed).items()])
    return _once(orbit, lambda o: F.transform(F.sequence(F.lit(0), F.lit(days - 1), F.lit(every)), lambda day: point(day, o)))


def trajectories(df: DataFrame, a: Column, key: Column, start_days: Column, seed: int = 42, days: int = 365, every: int = 10) -> DataFrame:
    """A row for each of trajectory's points: df's columns, time, x, y, z and distance. The work of a row is long for its
    size, so rows are dealt over all shuffle partitions; an orbit is drawn once a row, and points are plain columns."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    d = df.withColumns({f"_{k}": c for k, c in _orbit(a, key, start_days, seed).items()})
    d = d.repartition(n, F.xxhash64(key)).withColumn("time", F.explode(F.sequence(F.lit(0), F.lit(days - 1), F.lit(every))))
    d = d.withColumn("_m", mean_anomaly(F.col("time") + F.col("_start"), F.col("_period")))
    big = F.col("_m")
    for _ in range(10):
        big = F.col("_m") + F.col("_e") * F.sin(big)
    d = d.withColumn("_big", big)
    p = _inclined(F.col("_big"), F.col("_axis"), F.col("_e"), F.col("_inclination"))
    return d.select(*df.columns, "time", *[p[k].alias(k) for k in ("x", "y", "z", "distance")])


def _once(value: Column, f) -> Column:
    """f of value, which is worked out once: within the functions of arrays Spark shares no common parts of an expression,
    so that a fold would work it out at each of its steps."""
    return F.get(F.transform(F.array(value), f), 0)


def inclined_position(days: Column, a, e, period, inclination, steps: int = 10) -> dict[str, Column]:
    """With the plane tilted about the x axis by inclination (degrees)."""
    return _inclined(eccentric_anomaly(mean_anomaly(days, period), e, steps), a, e, inclination)


def _inclined(big: Column, a, e, inclination) -> dict[str, Column]:
    x, y = a * (F.cos(big) - e), a * F.sqrt(1 - e * e) * F.sin(big)
    i = F.radians(inclination)
    return {"x": x, "y": y * F.cos(i), "z": y * F.sin(i), "distance": a * (1 - e * F.cos(big))}


def display_radius(r: Column, mode: str) -> Column:
    """log, actual or compressed (inner planets wide apart, outer ones near)."""
    if mode == "log":
        return F.log10(r * 10 + 1) * 10
    if mode == "actual":
        return r * 100.0
    return F.when(r < 2, r * 2).otherwise(4 + (r - 2) * 0.3)


def parse_date(s: Column) -> Column:
    """'2024-Jan-01 02:47', in the session's time zone; null if it has another form."""
    return F.try_to_timestamp(s, F.lit("yyyy-MMM-dd HH:mm"))


def days_since_2020(ts: Column) -> Column:
    return (F.unix_micros(ts) - 1_577_836_800_000_000) / 86_400_000_000.0


def diameter(h: Column) -> Column:
    """Metres, from the absolute magnitude as text; 100 if there is none."""
    v = h.try_cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(100.0)).otherwise(F.pow(F.lit(10.0), (v - 15) / 2.5) * 140)


def hazard_class(distance: Column) -> Column:
    return F.when(distance < 0.05, "hazardous").when(distance < 0.1, "close").otherwise("safe")


def approach_position(days: Column, distance: Column) -> dict[str, Column]:
    angle = (days % 365) / 365 * (2 * math.pi)
    return {"x": distance * F.cos(angle) * 5, "y": distance * F.sin(angle) * 5, "z": days / 365 * 2}
