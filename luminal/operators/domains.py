"""Domain kernels: molecules, navigation meshes, volumes, forces."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from luminal.functions.scales import piecewise
from luminal.functions.vectors import cross, distance, unit
from luminal.operators import multipole
from luminal.operators.common import cut, cut_counted
from luminal.operators.mapping import lookup
from luminal.operators.spatial import close_pairs

# Element colours and van der Waals radii (angstroms).
CPK = {
    "H": "#FFFFFF", "C": "#909090", "N": "#3050F8", "O": "#FF0D0D", "S": "#FFFF30", "P": "#FF8000", "F": "#90E050", "CL": "#1FF01F", "BR": "#A62929",
    "I": "#940094", "FE": "#E06633", "ZN": "#7FA8D3", "CA": "#3DFF00", "MG": "#8AFF00", "NA": "#AB5CF2", "K": "#8F40D4", "AU": "#FFD123",
}
VDW = {"H": 1.2, "C": 1.7, "N": 1.55, "O": 1.52, "S": 1.8, "P": 1.8, "F": 1.47, "CL": 1.75, "BR": 1.85, "I": 1.98, "FE": 2.0, "ZN": 2.0}
# Transfer functions as (value, red, green, blue, alpha).
TRANSFER = {
    "ct-bone": [(-1000, 0, 0, 0, 0), (-600, 0.8, 0.2, 0.2, 0.1), (40, 0.9, 0.6, 0.6, 0.2), (200, 1, 1, 0.9, 0.8), (1000, 1, 1, 1, 1)],
    "ct-soft": [(-1000, 0, 0, 0, 0), (-100, 0.1, 0.1, 0.3, 0.0), (0, 0.8, 0.2, 0.2, 0.1), (40, 0.9, 0.5, 0.4, 0.6), (80, 0.8, 0.3, 0.3, 0.8), (200, 0.9, 0.9, 0.9, 0.9)],
    "mri-brain": [(0, 0, 0, 0, 0), (200, 0.1, 0.1, 0.4, 0.1), (500, 0.9, 0.9, 0.9, 0.5), (800, 1, 1, 1, 0.9)],
}


def bonds(atoms: DataFrame, reach: float = 1.8) -> DataFrame:
    """id, id2, distance of atoms (id, x, y, z) near enough to be bound."""
    return close_pairs(atoms, reach)


def listed_bonds(connections: DataFrame) -> DataFrame:
    """Bonds of records (serial, bonded list), each pair once in the direction that is listed first by serial."""
    e = connections.select("serial", F.posexplode("bonded").alias("_i", "other"))
    key = [F.least("serial", "other").alias("_a"), F.greatest("serial", "other").alias("_b")]
    return e.groupBy(*key).agg(F.min_by(F.struct("serial", "other"), F.struct("serial", "_i")).alias("_e")).select(F.col("_e.serial").alias("a"), F.col("_e.other").alias("b"))


def atom_records(atoms: DataFrame) -> DataFrame:
    """Positions and radii in tenths, with the element's colour."""
    e = F.upper(F.col("element"))
    return atoms.withColumns({"x": F.col("x") / 10, "y": F.col("y") / 10, "z": F.col("z") / 10, "radius": lookup(e, VDW, 1.7) / 10, "color": lookup(e, CPK, "#FF69B4")})


def helices(residues: DataFrame, by: list[str] = ("chain",), least: int = 4) -> DataFrame:
    """Runs of consecutive residues, also one that reaches the last; chains are kept apart."""
    from luminal.operators.series import islands

    return islands(residues, list(by), "res_seq", least)


def polygon_facts(polygons: DataFrame, vertices: DataFrame) -> DataFrame:
    """poly_id, cx, cy, cz (mean of the vertices) and area (shoelace on x and z) of polygons (poly_id, vertex_ids)."""
    corner = polygons.select("poly_id", F.posexplode("vertex_ids").alias("i", "id")).join(vertices, "id")
    w = W.partitionBy("poly_id").orderBy("i")
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w))
    d = corner.withColumn("_a", F.col("x") * nxt("z") - nxt("x") * F.col("z"))
    return d.groupBy("poly_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"), (F.abs(F.sum("_a")) / 2).alias("area"))


def shared_edges(polygons: DataFrame, vertices: DataFrame) -> DataFrame:
    """a, b (a < b), middle and length of the edge of polygons that have exactly two vertices in common."""
    m = polygons.select("poly_id", F.explode("vertex_ids").alias("id")).distinct()
    pairs = m.toDF("a", "id").join(m.toDF("b", "id"), "id").filter("a < b")
    two = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("id").alias("v"), F.max("id").alias("w")).filter("n = 2")
    end = lambda key, p: vertices.select(F.col("id").alias(key), *[F.col(c).alias(p + c) for c in "xyz"])
    d = two.join(end("v", "v"), "v").join(end("w", "w"), "w")
    middle = {"m" + c: (F.col("v" + c) + F.col("w" + c)) / 2 for c in "xyz"}
    return d.withColumns(middle | {"length": distance([F.col("v" + c) for c in "xyz"], [F.col("w" + c) for c in "xyz"])}).select("a", "b", "mx", "my", "mz", "length")


def containing_polygon(facts: DataFrame, x: float, z: float, reach: float = 2.0) -> DataFrame:
    """The first polygon by id whose centre is near."""
    d = F.sqrt((F.col("cx") - x) * (F.col("cx") - x) + (F.col("cz") - z) * (F.col("cz") - z))
    return facts.filter(d < reach).agg(F.min("poly_id").alias("poly_id"))


def polygon_path(edges: DataFrame, start, goal, max_hops: int | None = None) -> list:
    """Polygons from start to goal over the fewest shared edges (of equally short ways the one by least ids);
    empty if there is none (with max_hops, none of so many). Only the way itself comes to the driver."""
    from luminal.operators.graph import distances_from

    e = edges.select(F.col("a").alias("source"), F.col("b").alias("target"))
    hops = cut(distances_from(e, start, max_hops), "hops")
    both = e.union(e.select("target", "source")).toDF("id", "other")
    found = hops.filter(F.col("id") == F.lit(goal)).first()
    way = [goal] if found else []
    for h in range(found.hops - 1 if found else -1, -1, -1):
        way.append(both.filter(F.col("id") == F.lit(way[-1])).join(hops.filter(F.col("hops") == h).select(F.col("id").alias("other")), "other").agg(F.min("other")).first()[0])
    return way[::-1]


def slice_plane(volume: DataFrame, axis: str, at: float) -> DataFrame:
    return volume.filter(F.col(axis) == int(math.floor(at)))


def transfer(value: Column, preset: str = "ct-bone") -> dict[str, Column]:
    """Red, green, blue and alpha, linear between control points."""
    points = TRANSFER.get(preset, TRANSFER["ct-bone"])
    return {name: piecewise(value, [(float(p[0]), float(p[i])) for p in points]) for i, name in enumerate(("r", "g", "b", "a"), 1)}


def transfer_table(spark: SparkSession, low: float, high: float, preset: str = "ct-bone", steps: int = 256) -> DataFrame:
    from luminal.functions.color import to_hex

    d = spark.range(steps).select(F.col("id").alias("i"), (low + F.col("id") / (steps - 1) * (high - low)).alias("value"))
    c = transfer(F.col("value"), preset)
    return d.withColumn("color", to_hex(c["r"] * 255, c["g"] * 255, c["b"] * 255)).withColumn("alpha", c["a"])


def sample_volume(spark: SparkSession, w: int = 64, h: int = 64, d: int = 32, seed: int = 42) -> DataFrame:
    """A made-up scan: bone about the middle, soft tissue about it, lungs below, air elsewhere; x, y, z, value."""
    i = F.col("id")
    v = spark.range(w * h * d).select((i % w).alias("x"), (F.floor(i / w) % h).alias("y"), F.floor(i / (w * h)).alias("z"))
    r = F.sqrt((F.col("x") - w / 2) * (F.col("x") - w / 2) + (F.col("y") - h / 2) * (F.col("y") - h / 2))
    noise = F.pmod(F.xxhash64("x", "y", "z", F.lit(seed)), F.lit(1000)) / 1000.0
    return v.withColumn("value", F.when(r < 15, 400 + noise * 200).when(r < 25, 40 + noise * 20).when(F.col("y") < h / 4, -700 + noise * 100).otherwise(F.lit(-1000.0)))


# Forces: each gives columns to be added to velocities; positions are x, y, z.


def gravity_well(at: tuple, strength: float, radius: float) -> dict[str, Column]:
    o = [F.lit(float(q)) - F.col(a) for a, q in zip("xyz", at, strict=True)]
    d2 = sum((c * c for c in o), F.lit(0.0))
    f = F.when(F.sqrt(d2) < radius, strength / (d2 + 0.01)).otherwise(0.0)
    return {"f" + a: u * f for a, u in zip("xyz", unit(o), strict=True)}


def explosion(at: tuple, force: float, radius: float) -> dict[str, Column]:
    o = [F.col(a) - float(q) for a, q in zip("xyz", at, strict=True)]
    d2 = sum((c * c for c in o), F.lit(0.0))
    f = F.when(F.sqrt(d2) < radius, force / (d2 + 1)).otherwise(0.0)
    return {"f" + a: u * f for a, u in zip("xyz", unit(o), strict=True)}


def wind(direction: tuple, strength: float, turbulence: float = 0.0, seed: int = 42, key: str = "id") -> dict[str, Column]:
    noise = lambda k: (F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(k)), F.lit(1 << 53)) / float(1 << 53) - 0.5) * turbulence
    return {"f" + a: F.lit(float(q) * strength) + noise(i) for i, (a, q) in enumerate(zip("xyz", direction, strict=True))}


def buoyancy(level: float, density: float, drag: float = 0.1) -> dict[str, Column]:
    deep = F.lit(float(level)) - F.col("y")
    under = deep > 0
    up = F.when(under, density * F.least(deep, F.lit(1.0)) * 9.81).otherwise(0.0)
    slow = lambda v: F.when(under, -F.col(v) * drag).otherwise(0.0)
    return {"fx": slow("vx"), "fy": up + slow("vy"), "fz": slow("vz")}


def vortex(at: tuple, axis: tuple, strength: float, radius: float) -> dict[str, Column]:
    o = [F.col(a) - float(q) for a, q in zip("xyz", at, strict=True)]
    d = F.sqrt(sum((c * c for c in o), F.lit(0.0)))
    turn = unit(cross([F.lit(float(v)) for v in axis], o))
    f = F.when((d < radius) & (d > 0), strength * (1 - d / radius)).otherwise(0.0)
    return {"f" + a: u * f for a, u in zip("xyz", turn, strict=True)}


def center_gravity(g: float) -> dict[str, Column]:
    return {"f" + a: -F.col(a) * g * 0.1 for a in "xyz"}


def pair_forces(points: DataFrame, radius: float, strength: float, power: float = 2.0, charge: str | None = None) -> DataFrame:
    """id, fx, fy, fz: each point is pushed by those within radius with strength^2 / distance^power; with charge, unlike
    signs pull. The radius keeps pairs local; points in one place do not push one another."""
    from luminal.operators.spatial import within

    side = ["x", "y", "z", *([charge] if charge else [])]
    near = within(points.select("id", *side), points.select(F.col("id").alias("id2"), *[F.col(a).alias(a + "2") for a in "xyz"]), radius, F.col("id") != F.col("id2"))
    if charge:
        near = near.join(points.select(F.col("id").alias("id2"), F.col(charge).alias("_c2")), "id2")
    sign = F.signum(F.col(charge) * F.col("_c2")) if charge else F.lit(1.0)
    f = F.coalesce(F.try_divide(sign * strength * strength, F.pow("distance", F.lit(power + 1))), F.lit(0.0))
    sums = near.groupBy("id").agg(*[F.sum((F.col(a) - F.col(a + "2")) * f).alias("f" + a) for a in "xyz"])
    return points.select("id").join(sums, "id", "left").fillna(0.0, ["fx", "fy", "fz"])


def spring_forces(edges: DataFrame, nodes: DataFrame, length: float, strength: float) -> DataFrame:
    """id, fx, fy, fz: Hooke's law along edges (source, target, weight)."""
    from luminal.operators.graph import place_edges

    e = place_edges(edges, nodes)
    pull = F.coalesce(F.try_divide((F.col("length") - length) * strength * F.col("weight"), F.col("length")), F.lit(0.0))
    one = e.select(F.col("source").alias("id"), *[((F.col("t" + a) - F.col("s" + a)) * pull).alias("f" + a) for a in "xyz"])
    two = e.select(F.col("target").alias("id"), *[((F.col("s" + a) - F.col("t" + a)) * pull).alias("f" + a) for a in "xyz"])
    return one.unionByName(two).groupBy("id").agg(*[F.sum("f" + a).alias("f" + a) for a in "xyz"])


def spring_network(nodes: DataFrame, rest: float, stiffness: float, leaf: int = 64, m: int = 3, soft: float = 0.01) -> DataFrame:
    """id, fx, fy, fz: every node (id, x, y, z) is tied to every other by a spring of length rest: stiffness * (d - rest)
    along the line between them, d being their distance plus soft.

    No pairs are made of what is far. The pull of springs without length is a sum over all nodes, exactly; what rest takes
    off it is a sum of directions, which are added one by one between near nodes (within m cells), and beyond by cells:
    from their mean place, and from the spread about it to the second order, so that what is left is of the third order of
    cell size over distance, at most about (0.87 / m)^3 of a direction. Cells are halved until none holds more than leaf
    places. Nodes in one place do not push one another. Nodes without a finite place are left out."""
    axes = ["x", "y", "z"]
    sound = nodes.select("id", *[F.col(a).cast("double").alias(a) for a in axes]).filter(" and ".join(f"{a} is not null and not isnan({a}) and abs({a}) < double('Infinity')" for a in axes))
    sound = cut(sound, "springs")
    places = cut(sound.groupBy(*axes).agg(F.count("*").cast("double").alias("n")), "spring-places")
    row = places.agg(F.sum("n").alias("n"), *[f(a).alias(f"{k}{a}") for a in axes for f, k in ((F.min, "low"), (F.max, "high"))], *[F.sum(F.col(a) * F.col("n")).alias(f"sum{a}") for a in axes]).first()
    none = sound.select("id", *[F.lit(0.0).alias(f"f{a}") for a in axes])
    if row.n is None:
        return none
    low = [row[f"low{a}"] for a in axes]
    extent = max(row[f"high{a}"] - o for a, o in zip(axes, low, strict=True)) or 1.0
    depth = 0
    while depth < 40:  # a place is one point, so cells that are small enough hold few
        side = extent / 2**depth
        if places.groupBy(*[F.floor((F.col(a) - o) / side).alias(a) for a, o in zip(axes, low, strict=True)]).count().agg(F.max("count").alias("c")).first().c <= leaf:
            break
        depth += 1
    side, levels = extent / 2**depth, depth + 1
    targets = places.select(*axes)
    ms = [m] * (levels + 2)

    def directions(pairs: DataFrame, center: list[Column], n: Column, spread: dict | None = None) -> DataFrame:
        u = [c - F.col(a) for a, c in zip(axes, center, strict=True)]
        pairs = pairs.withColumns({f"_u{i}": c for i, c in enumerate(u)})
        u = [F.col(f"_u{i}") for i in range(3)]
        pairs = pairs.withColumn("_r", F.sqrt(u[0] * u[0] + u[1] * u[1] + u[2] * u[2]))
        r = F.col("_r")
        g = 1 / (r + soft)
        out = [c * g * n for c in u]
        if spread:  # g1 and g2 are the derivatives of 1 / (r + soft)
            g1, g2 = -g * g, 2 * g * g * g
            mu = [sum((spread[min(i, j), max(i, j)] * u[j] for j in range(3)), F.lit(0.0)) for i in range(3)]
            umu, trace = sum((a * b for a, b in zip(u, mu, strict=True)), F.lit(0.0)), spread[0, 0] + spread[1, 1] + spread[2, 2]
            out = [o + 0.5 * (2 * g1 / r * v + c * ((g2 / (r * r) - g1 / (r * r * r)) * umu + g1 / r * trace)) for o, v, c in zip(out, mu, u, strict=True)]
        return pairs.select(*axes, *[o.alias(f"d{a}") for o, a in zip(out, axes, strict=True)])

    near = multipole.near_pairs(targets, places, axes, low, side, m)
    parts = [directions(near, [F.col(f"p_{a}") for a in axes], F.col("p_n"))]
    n = F.col("n")
    sums = {"n": n} | {f"s{a}": n * F.col(a) for a in axes} | {f"m{i}{j}": n * (F.col(axes[i]) - low[i]) * (F.col(axes[j]) - low[j]) for i in range(3) for j in range(i, 3)}
    for level, some in enumerate(multipole.pyramid(places, axes, low, side, levels, sums)):
        center = [F.col(f"p_s{a}") / F.col("p_n") for a in axes]
        spread = {(i, j): F.col(f"p_m{i}{j}") - F.col("p_n") * (center[i] - low[i]) * (center[j] - low[j]) for i in range(3) for j in range(i, 3)}
        parts.append(directions(multipole.far_pairs(targets, some, axes, low, side, level, ms), center, F.col("p_n"), spread))
    total = reduce(DataFrame.unionByName, parts).groupBy(*axes).agg(*[F.sum(f"d{a}").alias(f"d{a}") for a in axes])
    pull = [(stiffness * (F.lit(row[f"sum{a}"]) - row.n * F.col(a)) - stiffness * rest * F.col(f"d{a}")).alias(f"f{a}") for a in axes]
    return sound.join(total, axes).select("id", *pull)


def collisions(points: DataFrame, reach: float) -> DataFrame:
    """Pairs id < id2 of points (id, x, y, z, radius) that overlap; reach is the largest sum of two radii."""
    r = points.select("id", "radius")
    d = close_pairs(points, reach).join(r, "id").join(r.toDF("id2", "radius2"), "id2")
    return d.filter(F.col("distance") < F.col("radius") + F.col("radius2")).select("id", "id2", "distance")


def emit_particles(emitters: DataFrame, per: int, life: float, age: Column) -> DataFrame:
    """per particles for each emitter; those older than life have gone."""
    d = emitters.withColumn("particle", F.explode(F.sequence(F.lit(0), F.lit(per - 1)))).withColumn("age", age)
    return d.filter(F.col("age") < life)


def probability_cloud(df: DataFrame, uncertainty: str, samples: int = 5, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Samples within the uncertainty about each point, with their probability; they depend on the seed alone."""
    d = df.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    u = lambda k: F.pmod(F.xxhash64(F.col(id_col), F.col("sample"), F.lit(seed), F.lit(k)), F.lit(1 << 53)) / float(1 << 53)
    r, phi, theta = u(0) * F.col(uncertainty), F.acos(2 * u(1) - 1), u(2) * (2 * math.pi)
    at = {"x": F.col("x") + r * F.sin(phi) * F.cos(theta), "y": F.col("y") + r * F.sin(phi) * F.sin(theta), "z": F.col("z") + r * F.cos(phi)}
    return d.withColumns(at | {"probability": F.coalesce(1 - F.try_divide(r, F.col(uncertainty)), F.lit(1.0))})


def heat_zones(zones: DataFrame, spots: DataFrame, leaf: int = 16) -> DataFrame:
    """Zones (id, x, z) with the most heat of the spots (x, z, load of 0 or more): max(0, 100 - 10 d) times the load.
    Beyond a distance of 10 a spot gives none.

    Zones and spots in one place count once. Cells of zones meet cells of spots, those of 10 first, and both are halved
    while a cell of spots holds more than leaf. Of a zone cell's pairs only those go on that may give more than another
    gives at least, so a zone meets few spots however many are near, and the result is exact."""
    x, z, reach = F.col("x"), F.col("z"), 10.0
    sound = "x is not null and z is not null and not isnan(x) and not isnan(z) and abs(x) < double('Infinity') and abs(z) < double('Infinity')"
    s = cut(spots.filter(sound).filter("load > 0").groupBy("x", "z").agg(F.max("load").alias("load")), "heat-spots")
    places = cut(zones.select("x", "z").filter(sound).distinct(), "heat-places")
    cell = lambda c, level: F.floor(c / (reach / 2**level)).cast("long")
    zone_cells = lambda level: places.select(cell(x, level).alias("cx"), cell(z, level).alias("cz")).distinct()
    spot_cells = lambda level: s.groupBy(cell(x, level).alias("px"), cell(z, level).alias("pz")).agg(F.max("load").alias("load"), F.count("*").alias("n"))
    up = lambda df, *names: df.withColumns({f"{n}_up": F.floor(F.col(n) / 2).cast("long") for n in names})
    near = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    pairs = zone_cells(0).withColumn("px", near("cx")).withColumn("pz", near("cz")).join(spot_cells(0), ["px", "pz"])
    for level in range(40):  # a place is one point, so cells that are small enough hold few
        side = reach / 2**level
        apart = [F.abs(F.col(a) - F.col(b)) for a, b in (("cx", "px"), ("cz", "pz"))]
        far, close = ([(d + 1) * side for d in apart], [F.greatest(d - 1, F.lit(0)) * side for d in apart])
        heat = lambda v: F.col("load") * (100 - F.sqrt(v[0] * v[0] + v[1] * v[1]) * 10)
        sure = F.greatest(F.lit(0.0), F.max(heat(far)).over(W.partitionBy("cx", "cz")))
        # a little less, for what is rounded off
        kept = pairs.withColumn("_sure", sure).filter(heat(close) >= F.col("_sure") * (1 - 1e-9) - 1e-9).drop("_sure")
        pairs, seen = cut_counted(kept, "heat-pairs", full=(F.col("n") > leaf))
        if not seen["full"]:
            break
        old = pairs.select(*[F.col(c).alias(f"{c}_up") for c in ("cx", "cz", "px", "pz")])
        pairs = old.join(up(zone_cells(level + 1), "cx", "cz"), ["cx_up", "cz_up"]).join(up(spot_cells(level + 1), "px", "pz"), ["px_up", "pz_up"]).select("cx", "cz", "px", "pz", "load", "n")
    at = places.withColumns({"cx": cell(x, level), "cz": cell(z, level)}).join(pairs.select("cx", "cz", "px", "pz"), ["cx", "cz"])
    met = at.join(s.select(F.col("x").alias("x2"), F.col("z").alias("z2"), "load", cell(x, level).alias("px"), cell(z, level).alias("pz")), ["px", "pz"])
    d = F.sqrt((x - F.col("x2")) * (x - F.col("x2")) + (z - F.col("z2")) * (z - F.col("z2")))
    heat = met.withColumn("_d", d).filter(F.col("_d") <= reach).groupBy("x", "z").agg(F.max((100 - F.col("_d") * 10) * F.col("load")).alias("heat"))
    return zones.select("id", "x", "z").join(heat, ["x", "z"], "left").select("id", "heat").fillna(0.0, ["heat"])
