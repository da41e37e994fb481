"""Trees from parent keys. What a row takes from the path above it (depth, root, positions) is a sum along that path, got
by pointer doubling: in each round every row adds what its ancestor has and moves on to that one's ancestor, so a tree
of d levels takes log2(d) rounds. A tidy drawing goes up from the leaves, a level a round."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from luminal.operators.common import CENTER, cut, cut_counted, join_hot, ranked

BLOCK = 256  # siblings that are packed in one go


def roots(df: DataFrame, id_col: str = "id", parent_col: str = "parent") -> DataFrame:
    """Rows whose parent is null or is no row."""
    ids = df.select(F.col(id_col).alias("_p")).distinct()
    return df.join(ids, F.col(parent_col) == F.col("_p"), "left_anti")


def links(df: DataFrame, id_col: str = "id", parent_col: str = "parent") -> DataFrame:
    """parent_id, child_id for every row whose parent is a row."""
    p = df.select(F.col(id_col).alias("parent_id")).distinct()
    return df.select(F.col(id_col).alias("child_id"), F.col(parent_col).alias("parent_id")).join(p, "parent_id").select("parent_id", "child_id")


def path_sums(rows: DataFrame) -> DataFrame:
    """_id, _parent, and any numeric columns of rows: _id, _root and the sums of the columns from the root to the row,
    the root's own included. A parent that is null or no row makes a root. Rows on a cycle, or below one, have no root
    and are left out. Of rows that share an id, those below it follow the one with the smallest parent."""
    values = [c for c in rows.columns if c not in ("_id", "_parent")]
    ids = rows.select(F.col("_id").alias("_parent")).filter("_parent is not null").distinct()
    up = join_hot(rows, ids.withColumn("_is", F.lit(True)), ["_parent"], "left")
    state = up.select("_id", F.when(F.col("_is"), F.col("_parent")).alias("_up"), F.when(F.col("_is"), F.col("_parent")).otherwise(F.col("_id")).alias("_root"), *values)
    done, left = None, -1
    while True:
        state, seen = cut_counted(state, "path", open=F.col("_up").isNotNull())
        ended = state.filter("_up is null").drop("_up")
        done = ended if done is None else done.unionByName(ended)
        if seen["open"] in (0, left):  # no row is deeper than before: what is left hangs from a cycle
            return done
        left, open_ = seen["open"], state.filter("_up is not null")
        above = open_.unionByName(done.withColumn("_up", F.lit(None).cast(open_.schema["_up"].dataType)))
        above = above.groupBy(F.col("_id").alias("_up")).agg(F.min_by(F.struct(F.col("_up").alias("next"), F.col("_root").alias("root"), *values), F.struct(F.col("_up").isNotNull(), "_up")).alias("_a"))
        met = join_hot(open_, above, ["_up"], n=left)
        state = met.select("_id", F.col("_a.next").alias("_up"), F.col("_a.root").alias("_root"), *[(F.col(c) + F.col(f"_a.{c}")).alias(c) for c in values])


def _rows(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("_id"), F.col(parent_col).alias("_parent"))


def depths(df: DataFrame, id_col: str = "id", parent_col: str = "parent") -> DataFrame:
    """id, depth and root of every row below a root."""
    out = path_sums(_rows(df, id_col, parent_col).withColumn("depth", F.lit(1)))
    return out.select(F.col("_id").alias(id_col), (F.col("depth") - 1).alias("depth"), F.col("_root").alias("root"))


def _placed(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """_id, _parent, _rank and _of among the siblings by id, for rows with a parent; roots have neither rank nor of."""
    rows = _rows(df, id_col, parent_col)
    below = ranked(rows.filter("_parent is not null"), ["_parent"], "_id", name="_rank", count="_of")
    return below.unionByName(rows.filter("_parent is null").withColumns({"_rank": F.lit(None).cast("long"), "_of": F.lit(None).cast("long")}))


def _first_tree(sums: DataFrame) -> DataFrame:
    """Rows of sums below the first root by id."""
    first = sums.agg(F.min("_root").alias("_first"))
    return sums.join(F.broadcast(first), F.col("_root") == F.col("_first")).drop("_first")


def tree_layout(df: DataFrame, id_col: str = "id", parent_col: str = "parent", width: float = 4.0, height: float = 3.0) -> DataFrame:
    """id, depth, x, y, z below the first root by id: each level lower by height, siblings width apart about their
    parent. Rows that are not under it are not placed."""
    rows = _placed(df, id_col, parent_col)
    moved = F.coalesce((F.col("_rank") - (F.col("_of") - 1) / 2) * width, F.lit(0.0))
    sums = _first_tree(path_sums(rows.select("_id", "_parent", F.lit(1).alias("depth"), moved.alias("x"))))
    # a root may have a parent that is no row, and a rank below it that moves nothing
    own = sums.filter("_id = _root").agg(F.min("x").alias("_x0"))
    return sums.join(F.broadcast(own), F.lit(True)).select(F.col("_id").alias(id_col), (F.col("depth") - 1).alias("depth"), (F.col("x") - F.col("_x0")).alias("x"), (-height * (F.col("depth") - 1)).alias("y"), F.lit(0.0).alias("z"))


def polar_tree(df: DataFrame, id_col: str = "id", parent_col: str = "parent", center=CENTER) -> DataFrame:
    """id, depth, x, y, z: children on an arc about their parent's angle, 1.5 further out at each level. An only
    child stands at the start of the arc."""
    rows = _placed(df, id_col, parent_col)
    deep = depths(df, id_col, parent_col).select(F.col(id_col).alias("_id"), "depth").dropDuplicates(["_id"])
    arc = math.pi / F.greatest(F.lit(2), F.col("depth") - 1)
    angle = F.when(F.col("depth") == 0, 0.0).otherwise(-arc / 2 + arc * F.col("_rank") / F.greatest(F.lit(1), F.col("_of") - 1))
    sums = path_sums(rows.join(deep, "_id").select("_id", "_parent", angle.alias("angle"), F.lit(1).alias("depth")))
    sums, r = _first_tree(sums).withColumn("depth", F.col("depth") - 1), F.col("depth") * 1.5
    return sums.select(F.col("_id").alias(id_col), "depth", (center[0] + r * F.cos("angle")).alias("x"), F.lit(center[1]).alias("y"), (center[2] + r * F.sin("angle")).alias("z"))


def _side_by_side(gap: float, apart: float) -> Column:
    """Of subtrees s (struct at, key, left, right, span; left and right: the least and greatest x of each level, from
    that of the first root; span: x of the last root) in order: left, right, span and offsets of all, each set as near
    to those before it as their levels allow."""

    def join(a: Column, s: Column) -> Column:
        shared = F.least(F.size(a["right"]), F.size(s["left"]))
        between = F.zip_with(F.slice(a["right"], F.lit(1), shared), F.slice(s["left"], F.lit(1), shared), lambda x, y: x - y)
        shift = F.when(F.size(a["right"]) == 0, 0.0).otherwise(F.array_max(F.transform(between, lambda d, i: d + F.when(i == 0, gap).otherwise(apart))))
        # an array of one, so that the shift is worked out once
        return F.transform(F.array(shift), lambda x: F.struct(
            F.concat(a["left"], F.transform(F.slice(s["left"], F.size(a["left"]) + 1, F.greatest(F.lit(0), F.size(s["left"]) - F.size(a["left"]))), lambda v: v + x)).alias("left"),
            F.concat(F.transform(s["right"], lambda v: v + x), F.slice(a["right"], F.size(s["right"]) + 1, F.greatest(F.lit(0), F.size(a["right"]) - F.size(s["right"])))).alias("right"),
            (x + s["span"]).alias("span"),
            F.concat(a["offsets"], F.array(x)).alias("offsets"),
        ))[0]

    none = F.array().cast("array<double>")
    return F.aggregate("s", F.struct(none.alias("left"), none.alias("right"), F.lit(0.0).alias("span"), none.alias("offsets")), join)


def tidy_tree(df: DataFrame, id_col: str = "id", parent_col: str = "parent", gap: float = 1.0, apart: float = 2.0, level: float = 1.0, size: tuple[float, float] | None = None, order: str | None = None) -> DataFrame:
    """id, depth, x, y, z of a tidy drawing: parents stand over the middle of their first and last child, subtrees
    as near to those before them as the distances allow (gap between siblings, apart between other nodes of a level),
    and equal subtrees are drawn alike. Several trees stand side by side by id, as children of one that is not drawn;
    rows below no root are not placed.

    Siblings are in order of the column order, then id. They are packed from the left in blocks of BLOCK, the blocks
    likewise as one piece each, and so on, so that no task sees all children of a row. A subtree is known by its least
    and greatest x on each level, so the work is the number of rows times the levels below them, in one round a level.
    y is depth times level. With size (width, height), x runs from 0 to width, half a gap being left on both sides, and
    z from 0 to height by depth; without, the middle of the roots is at x = 0 and z is 0."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(parent_col).alias("_parent"), (F.col(order) if order else F.lit(0)).alias("_order"))
    deep = depths(df, id_col, parent_col).select(F.col(id_col).alias("_id"), "depth").filter("_id is not null").dropDuplicates(["_id"])
    rows = rows.dropDuplicates(["_id"]).join(deep, "_id").withColumn("_parent", F.when(F.col("depth") > 0, F.col("_parent")))
    rows = cut(ranked(rows, ["depth", "_parent"], "_order", "_id", name="_rank"), "tidy")
    most = rows.agg(F.max("depth").alias("depth"), F.max("_rank").alias("rank")).first()
    if most.depth is None:
        return df.select(id_col).limit(0).select(id_col, *[F.lit(0 if c == "depth" else 0.0).alias(c) for c in ("depth", "x", "y", "z")])
    rounds = 1
    while most["rank"] >= BLOCK**rounds:
        rounds += 1
    leaf = F.array(F.lit(0.0))
    moves, under = None, None
    for depth in range(most.depth, -1, -1):
        here = rows.filter(F.col("depth") == depth)
        items = here.join(under, "_id", "left") if under is not None else here.withColumns({"left": leaf, "right": leaf})
        items = items.select("_parent", F.col("_rank").alias("at"), F.col("_id").alias("key"), F.coalesce("left", leaf).alias("left"), F.coalesce("right", leaf).alias("right"), F.lit(0.0).alias("span"))
        offsets = None
        for k in range(rounds):
            s = F.array_sort(F.collect_list(F.struct("at", "left", "right", "span", *(["key"] if k == 0 else []))))
            packed = items.groupBy("_parent", F.floor(F.col("at") / BLOCK).alias("block")).agg(s.alias("s")).withColumn("all", _side_by_side(gap, apart))
            packed = cut(packed.select("_parent", "block", "all.left", "all.right", "all.span", F.zip_with(F.col("s"), F.col("all.offsets"), lambda a, o: F.struct(a["at"].alias("at"), (a["key"] if k == 0 else F.lit(None)).alias("key"), o.alias("offset"))).alias("each")), "tidy-level")
            each = packed.select("_parent", "block", F.explode("each").alias("e"))
            if k == 0:
                offsets = each.select("_parent", F.col("e.key").alias("_id"), F.col("block").alias("at"), F.col("e.offset").alias("x"))
            else:
                moved = each.select("_parent", F.col("e.at").alias("at"), F.col("block").alias("next"), F.col("e.offset").alias("o"))
                met = offsets.join(moved, (offsets["at"] == moved["at"]) & offsets["_parent"].eqNullSafe(moved["_parent"]))
                offsets = met.select(offsets["_parent"], "_id", F.col("next").alias("at"), (F.col("x") + F.col("o")).alias("x"))
            items = packed.select("_parent", F.col("block").alias("at"), "left", "right", "span")
        middle = items.select(F.col("_parent"), (F.col("span") / 2).alias("middle"), "left", "right")
        at = join_hot(offsets.withColumn("_key", F.struct("_parent")), middle.select(F.struct("_parent").alias("_key"), "middle"), ["_key"])
        move = cut(at.select("_id", F.col("_parent"), (F.col("x") - F.col("middle")).alias("x")), "tidy-moves")
        moves = move if moves is None else moves.unionByName(move)
        under = middle.select(F.col("_parent").alias("_id"), *[F.concat(leaf, F.transform(c, lambda v: v - F.col("middle"))).alias(c) for c in ("left", "right")])
    placed = path_sums(moves.withColumn("depth", F.lit(1))).withColumn("depth", F.col("depth") - 1)
    x, z = F.col("x"), F.lit(0.0)
    if size:
        placed = cut(placed, "tidy-placed")
        ends = placed.agg(F.min("x").alias("_least"), F.max("x").alias("_most"))
        placed = placed.join(F.broadcast(ends), F.lit(True))
        x = (F.col("x") - F.col("_least") + gap / 2) * size[0] / (F.col("_most") - F.col("_least") + gap)
        z = F.col("depth") * (size[1] / max(1, most.depth))
    return placed.select(F.col("_id").alias(id_col), "depth", x.alias("x"), (F.col("depth") * level).alias("y"), z.alias("z"))
