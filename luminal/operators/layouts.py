"""Layouts: records to positions x, y, z. Each works on an explicit order, never on the order rows happen to have."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from luminal.operators.common import CENTER, join_hot, ordinal, ranked, with_totals

GOLDEN = math.pi * (3 - math.sqrt(5))
REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def layout(name: str):
    def add(f):
        REGISTRY[name] = f
        return f

    return add


def register(name: str, f: Callable[..., DataFrame]) -> None:
    """A layout of one's own: (df, order, **options) to df with x, y, z."""
    REGISTRY[name] = f


def calculate(df: DataFrame, name: str, order: list, **options) -> DataFrame:
    """An unknown name gives the scatter layout."""
    return REGISTRY.get(name, REGISTRY["scatter"])(df, order, **options)


def calculate_positions(df: DataFrame, topology: str, order: list, **options) -> DataFrame:
    """The topology's layout; any other topology gives the sphere."""
    names = {"graph": "force", "tree": "polar-tree", "timeline-spiral": "spiral-timeline", "timeline": "linear-timeline", "scatter": "embedding", "globe": "globe", "grid": "categorical-grid", "matrix": "matrix"}
    return REGISTRY[names.get(topology, "sphere")](df, order, **options)


def _beside(df: DataFrame, placed: DataFrame, id_col: str) -> DataFrame:
    """df with the positions that placed has for its ids; others have none."""
    at = placed.select(F.col(id_col).alias("_id"), "x", "y", "z")
    return df.drop("x", "y", "z").join(at, F.col(id_col) == F.col("_id"), "left").drop("_id")


@layout("force")
def force(df, order, edges: DataFrame | None = None, id_col: str = "id", **options):
    """edges (source, target, weight), or the records' own column links (to, weight, type); without either nodes only
    push one another apart."""
    from luminal.operators.force import force_layout
    from luminal.operators.graph import edges_of

    if edges is None:
        loops = df.select(F.col(id_col).alias("source"), F.col(id_col).alias("target"), F.lit(1.0).alias("weight"))
        edges = edges_of(df, id_col) if "links" in df.columns else loops.limit(0)
    return force_layout(df.drop("x", "y", "z"), edges, order, id_col=id_col, **options)


@layout("tree")
def tree(df, order=(), id_col: str = "id", parent_col: str = "parent", **options):
    """Rows that are not under the first root have no position. A table without a parent column is laid out as a grid."""
    from luminal.operators.trees import tree_layout

    return _beside(df, tree_layout(df, id_col, parent_col, **options), id_col) if parent_col in df.columns else grid(df, order)


@layout("polar-tree")
def polar(df, order=(), id_col: str = "id", parent_col: str = "parent", **options):
    """Rows that are not under the first root have no position. A table without a parent column is laid out on a sphere."""
    from luminal.operators.trees import polar_tree

    return _beside(df, polar_tree(df, id_col, parent_col, **options), id_col) if parent_col in df.columns else sphere(df, order)


def _place(df: DataFrame, x: Column, y: Column, z: Column, drop: tuple = ()) -> DataFrame:
    return df.withColumns({"x": x.cast("double"), "y": y.cast("double"), "z": z.cast("double")}).drop(*drop)


@layout("grid")
def grid(df, order, spacing: float = 3.0):
    d = ordinal(df, *order, count="_n")
    cols = F.ceil(F.sqrt("_n"))
    col, row = F.col("ord") % cols, F.floor(F.col("ord") / cols)
    return _place(d, (col - (cols - 1) / 2) * spacing, (row - F.floor((F.col("_n") - 1) / cols) / 2) * -spacing, F.lit(0.0), ("_n",))


@layout("radial")
def radial(df, order, radius: float = 5.0, start: float = 0.0):
    d = ordinal(df, *order, count="_n")
    a = F.col("ord") / F.col("_n") * (2 * math.pi) + start
    return _place(d, F.cos(a) * radius, F.lit(0.0), F.sin(a) * radius, ("_n",))


@layout("timeline")
def timeline(df, order, spacing: float = 2.0):
    d = ordinal(df, *order, count="_n")
    return _place(d, F.col("ord") * spacing - (F.col("_n") - 1) * spacing / 2, F.lit(0.0), F.lit(0.0), ("_n",))


@layout("spiral")
def spiral(df, order, radius: float = 5.0, rotations: float = 2.0, rise: float = 0.5, shrink: float = 0.3):
    d = ordinal(df, *order, count="_n")
    t = F.col("ord") / F.col("_n")
    r = radius * (1 - shrink * t)
    return _place(d, F.cos(t * (2 * math.pi * rotations)) * r, F.col("ord") * rise, F.sin(t * (2 * math.pi * rotations)) * r, ("_n",))


@layout("stack")
def stack(df, order, spacing: float = 2.0):
    return _place(ordinal(df, *order), F.lit(0.0), F.col("ord") * spacing, F.lit(0.0))


@layout("centered-timeline")
def centered_timeline(df, order, spacing: float = 2.0):
    """Centred on half the count, not on the middle record."""
    d = ordinal(df, *order, count="_n")
    return _place(d, (F.col("ord") - F.col("_n") / 2) * spacing, F.lit(0.0), F.lit(0.0), ("_n",))


@layout("scatter")
def scatter(df, order, width: float = 10.0, height: float = 5.0, depth: float = 10.0, seed: int = 42):
    """A box of positions that look random; they depend on the seed and the order alone."""
    d = ordinal(df, *order)
    unit = lambda k: F.pmod(F.xxhash64(F.col("ord"), F.lit(seed), F.lit(k)), F.lit(1 << 53)) / float(1 << 53)
    return _place(d, (unit(0) - 0.5) * width, (unit(1) - 0.5) * height, (unit(2) - 0.5) * depth)


@layout("random")
def random(df, order, radius: float = 5.0, center=CENTER, seed: int = 42):
    d = scatter(df, order, 2 * radius, 2 * radius, 2 * radius, seed)
    return _place(d, F.col("x") + center[0], F.col("y") + center[1], F.col("z") + center[2])


@layout("sphere")
def sphere(df, order, radius: float = 5.0, center=CENTER):
    d = ordinal(df, *order, count="_n")
    y = 1 - F.col("ord") / F.greatest(F.lit(1), F.col("_n") - 1) * 2
    flat = F.sqrt(F.greatest(F.lit(0.0), 1 - y * y))
    return _place(d, center[0] + radius * flat * F.cos(F.col("ord") * GOLDEN), center[1] + radius * y, center[2] + radius * flat * F.sin(F.col("ord") * GOLDEN), ("_n",))


@layout("matrix")
def matrix(df, order, spacing: float = 0.5, columns: int = 10, center=CENTER):
    d = ordinal(df, *order)
    row, col = F.floor(F.col("ord") / columns), F.col("ord") % columns
    return _place(d, center[0] + (col - 5) * spacing * 1.5, center[1] + (row - 5) * spacing * 0.75, F.lit(center[2]))


@layout("categorical-grid")
def categorical_grid(df, order, category: str = "category", spacing: float = 0.5, center=CENTER):
    """A square of records for each category, categories in the order in which they first appear."""
    d = ordinal(df, *order).withColumn("_cat", F.coalesce(F.col(category).cast("string"), F.lit("default")))
    cats = ordinal(d.groupBy("_cat").agg(F.min("ord").alias("_first"), F.count("*").alias("_size")), "_first", name="_c", count="_cats")
    # a few categories may hold all records
    within = join_hot(ranked(d, ["_cat"], "ord", name="_i"), cats, ["_cat"])
    wide, gap = F.ceil(F.sqrt("_size")), spacing * 2
    x = center[0] + (F.col("_c") - F.col("_cats") / 2) * gap * 2 + F.col("_i") % wide * gap
    return _place(within, x, F.lit(center[1]), center[2] + F.floor(F.col("_i") / wide) * gap, ("_cat", "_first", "_size", "_c", "_cats", "_i"))


@layout("spiral-timeline")
def spiral_timeline(df, order, time: str = "timestamp", center=CENTER):
    """time in milliseconds; null counts as 0 in the order."""
    d = ordinal(df, F.coalesce(F.col(time), F.lit(0)), *order)
    d = with_totals(d, _t0=F.min(F.coalesce(F.col(time), F.lit(0))))
    r, a = 2 + F.col("ord") * 0.15, F.col("ord") * GOLDEN
    return _place(d, center[0] + r * F.cos(a), center[1] + (F.coalesce(F.col(time), F.lit(0)) - F.col("_t0")) / 1_000_000, center[2] + r * F.sin(a), ("_t0",))


def time_share(df: DataFrame, time: str, name: str = "t") -> DataFrame:
    """Where each time is between the first and the last; 0 if they are the same."""
    d = with_totals(df, _lo=F.min(time), _hi=F.max(time))
    span = F.col("_hi") - F.col("_lo")
    return d.withColumn(name, (F.coalesce(F.col(time), F.col("_lo")) - F.col("_lo")) / F.when(span == 0, 1).otherwise(span)).drop("_lo", "_hi")


@layout("linear-timeline")
def linear_timeline(df, order, time: str = "timestamp", length: float = 10.0, center=CENTER, seed: int = 42):
    d = time_share(ordinal(df, F.coalesce(F.col(time), F.lit(0)), *order), time, "_share")
    jitter = F.pmod(F.xxhash64(F.col("ord"), F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    return _place(d, center[0] + (F.col("_share") - 0.5) * length, center[1] + F.sin(F.col("ord") * 0.5) * 0.5, center[2] + (jitter - 0.5) * 2, ("_share",))


@layout("globe")
def globe(df, order=(), lat: str = "lat", lng: str = "lng", radius: float = 3.0, center=CENTER):
    phi, theta = F.radians(90 - F.coalesce(F.col(lat), F.lit(0.0))), F.radians(F.coalesce(F.col(lng), F.lit(0.0)) + 180)
    return _place(df, center[0] + radius * F.sin(phi) * F.cos(theta), center[1] + radius * F.cos(phi), center[2] + radius * F.sin(phi) * F.sin(theta))


@layout("embedding")
def embedding(df, order, vector: str = "embedding", radius: float = 5.0, center=CENTER, seed: int = 42):
    """The first three numbers of the vector; records without one are scattered about the centre. If no record has a
    vector, all stand on a ring by their order, 2 to 5 from the centre and up to 2 above or below it, by the seed."""
    d = ordinal(df, *order, count="_n").join(F.broadcast(df.agg(F.coalesce(F.bool_or(F.col(vector).isNotNull()), F.lit(False)).alias("_any"))), F.lit(True))
    unit = lambda k: F.pmod(F.xxhash64(F.col("ord"), F.lit(seed), F.lit(k)), F.lit(1 << 53)) / float(1 << 53)
    at = lambda k: F.when(F.col(vector).isNotNull(), F.coalesce(F.get(F.col(vector), k).cast("double"), F.lit(0.0)) * radius).otherwise((unit(k) - 0.5) * 2 * radius)
    turn, far = F.col("ord") / F.col("_n") * (2 * math.pi), 2 + unit(3) * 3
    ring = (far * F.cos(turn), (unit(4) - 0.5) * 4, far * F.sin(turn))
    return _place(d, *[c + F.when(F.col("_any"), at(k)).otherwise(r) for k, (c, r) in enumerate(zip(center, ring, strict=True))], ("_n", "_any"))


@layout("projection")
def projection(df, order=(), vector: str = "embedding"):
    """Two numbers lie flat (x, 0, z), three are a point, of more the first three are."""
    v, n = F.col(vector), F.size(vector)
    part = lambda k: F.coalesce(F.get(v, k).cast("double"), F.lit(0.0))
    return _place(df, part(0), F.when(n == 2, 0.0).otherwise(part(1)), F.when(n == 2, part(1)).otherwise(part(2)))


@layout("history-spiral")
def history_spiral(df, order, year: str = "year", turns: float = 5.0, radius: float = 5.0, rise: float = 2.0):
    d = time_share(ordinal(df, year, *order, count="_n"), year, "_share")
    a, r = F.col("_share") * (2 * math.pi * turns), radius + F.col("_share") * 0.5 * F.col("_n")
    return _place(d, F.cos(a) * r, F.col("_share") * rise * F.col("_n"), F.sin(a) * r, ("_share", "_n"))


@layout("history-line")
def history_line(df, order, year: str = "year", axis: str = "x", length: float = 20.0):
    d = time_share(df, year, "_share")
    at = (F.col("_share") - 0.5) * length
    return _place(d, *[at if axis == a else F.lit(0.0) for a in "xyz"], ("_share",))


@layout("bar-row")
def bar_row(df, order, value: str = "value", spacing: float = 1.5, scale: float = 1.0):
    """Bars side by side about the middle, each standing on the ground."""
    d = ordinal(df, *order, count="_n")
    return _place(d, (F.col("ord") - (F.col("_n") - 1) / 2) * spacing, F.col(value) * scale / 2, F.lit(0.0), ("_n",))


@layout("trading-floor")
def trading_floor(df, order, columns: int = 3, spacing: float = 4.0):
    """Rows of columns places each on the ground, the columns about the middle, each row further back."""
    d = ordinal(df, *order)
    col, row = F.col("ord") % columns, F.floor(F.col("ord") / columns)
    return _place(d, (col - (columns - 1) / 2) * spacing, F.lit(0.0), row * -spacing)


@layout("galaxy")
def galaxy(df, order, arms: int = 3, spread: float = 0.5, turns: float = 2.0):
    d = ordinal(df, *order, count="_n")
    t = F.col("ord") / F.col("_n")
    a = t * (2 * math.pi * turns) + F.col("ord") % arms * (2 * math.pi / arms)
    r = t * F.col("_n") * spread
    return _place(d, F.cos(a) * r, F.lit(0.0), F.sin(a) * r, ("_n",))


@layout("palace")
def palace(df, order, wing: str = "wing_id", room: str = "room_id", size: float = 0.15, center=(0.0, 0.0, 0.0)):
    """Wings on a sphere of radius 10, rooms on a ring about their wing, items on a circle about their room (on a
    grid if there are more than ten). Wings and rooms go by their first item."""
    d = ordinal(df, *order)
    wings = ordinal(d.groupBy(wing).agg(F.min("ord").alias("_wf")), "_wf", name="_w", count="_ws").drop("_wf")
    rooms = ranked(d.groupBy(wing, room).agg(F.min("ord").alias("_rf"), F.count("*").alias("_k")), [wing], "_rf", name="_r", count="_rs").drop("_rf")
    d = join_hot(join_hot(ranked(d, [wing, room], "ord", name="_i"), rooms, [wing, room]), wings, [wing])
    y = 1 - F.col("_w") / F.greatest(F.lit(1), F.col("_ws") - 1) * 2
    flat, turn = F.sqrt(F.greatest(F.lit(0.0), 1 - y * y)), F.col("_r") / F.col("_rs") * (2 * math.pi)
    rx = center[0] + F.cos(F.col("_w") * GOLDEN) * flat * 10 + F.cos(turn) * 3
    rz = center[2] + F.sin(F.col("_w") * GOLDEN) * flat * 10 + F.sin(turn) * 3
    i, k, a = F.col("_i"), F.col("_k"), F.col("_i") / F.col("_k") * (2 * math.pi)
    cols, few, gap = F.ceil(F.sqrt("_k")), F.col("_k") <= 10, size * 3
    x = F.when(few, F.cos(a) * 0.5).otherwise((i % cols - cols / 2) * gap)
    z = F.when(few, F.sin(a) * 0.5).otherwise((F.floor(i / cols) - F.ceil(k / cols) / 2) * gap)
    up = F.when(few, F.sin(i / 3) * 0.2).otherwise(F.sin(i * 0.1) * 0.3)
    return _place(d, rx + x, center[1] + y * 10 + up, rz + z, ("_w", "_ws", "_r", "_rs", "_i", "_k"))


def attract(df: DataFrame, ids: list, target: tuple, strength: float, id_col: str = "id") -> DataFrame:
    near = F.col(id_col).isin(ids)
    return df.withColumns({a: F.when(near, F.col(a) + (q - F.col(a)) * strength * 0.1).otherwise(F.col(a)) for a, q in zip("xyz", target, strict=True)})


def repel(df: DataFrame, ids: list, target: tuple, strength: float, id_col: str = "id") -> DataFrame:
    d = F.sqrt(sum(((F.col(a) - q) * (F.col(a) - q) for a, q in zip("xyz", target, strict=True)), F.lit(0.0)))
    near = F.col(id_col).isin(ids) & (d < strength * 2) & (d > 0)
    return df.withColumns({a: F.when(near, F.col(a) + F.try_divide(F.col(a) - q, d) * strength).otherwise(F.col(a)) for a, q in zip("xyz", target, strict=True)})


def above_plane(df: DataFrame, normal: tuple, offset: float) -> DataFrame:
    """Points below the plane are moved onto it."""
    side = sum((F.col(a) * n for a, n in zip("xyz", normal, strict=True)), F.lit(0.0))
    return df.withColumns({a: F.when(side < offset, F.col(a) + n * (offset - side)).otherwise(F.col(a)) for a, n in zip("xyz", normal, strict=True)})


def apply_constraints(df: DataFrame, constraints: list[dict], id_col: str = "id") -> DataFrame:
    """In turn; kinds that are not known change nothing."""
    for c in constraints:
        if c["type"] == "attract-to":
            df = attract(df, c["ids"], c["target"], c.get("strength", 1.0), id_col)
        elif c["type"] == "repel-from":
            df = repel(df, c["ids"], c["target"], c.get("strength", 1.0), id_col)
        elif c["type"] == "plane":
            df = above_plane(df, c["normal"], c.get("offset", 0.0))
    return df


def interpolate_positions(now: DataFrame, target: DataFrame, t: float, id_col: str = "id") -> DataFrame:
    """Positions part of the way to their targets; a record without one stays where it is."""
    to = target.select(id_col, *[F.col(a).alias("_" + a) for a in "xyz"])
    d = now.join(to, id_col, "left")
    return d.withColumns({a: F.col(a) + (F.coalesce("_" + a, a) - F.col(a)) * t for a in "xyz"}).drop("_x", "_y", "_z")
