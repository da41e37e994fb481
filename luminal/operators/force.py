"""Force layouts, as rounds of Spark jobs: repulsion within a radius through cells, springs along edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from luminal.operators.common import cut
from luminal.operators.domains import pair_forces, spring_forces
from luminal.operators.layouts import random


BLOCK = 16  # cells of one spacing in a block's side; a node at a block's edge is sent to the blocks beside it too
PAIRS = 1 << 20  # that are measured at once


def _sums(cells: np.ndarray, at: np.ndarray, own: np.ndarray, spacing: float) -> np.ndarray:
    """For each place of own (numbers of rows of at) the sum of spacing^2 / distance towards it from those at most one
    spacing away. cells: each place's cell in its block, from -1 to BLOCK."""
    side = BLOCK + 4
    key = ((cells[:, 0] + 2) * side + cells[:, 1] + 2) * side + cells[:, 2] + 2
    order = np.lexsort((at[:, 2], at[:, 1], at[:, 0], key))
    sorted_at, starts = at[order], np.concatenate([[0], np.cumsum(np.bincount(key, minlength=side**3))])
    out = np.zeros((len(own), 3))
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            near = key[own] + dx * side * side + dy * side  # three cells in a row stand together
            first, n = starts[near - 1], starts[near + 2] - starts[near - 1]
            ends = np.cumsum(n)
            a = 0
            while a < len(own):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] - n[a] + PAIRS, "right")))
                left = np.repeat(np.arange(a, b), n[a:b])
                right = np.arange(len(left)) - np.repeat(ends[a:b] - n[a:b] - (ends[a] - n[a]), n[a:b]) + np.repeat(first[a:b], n[a:b])
                d = at[own[left]] - sorted_at[right]
                square = (d * d).sum(axis=1)
                keep = (square > 0) & (np.sqrt(square) <= spacing)  # those in one place do not push one another
                push = d[keep] * (spacing * spacing / square[keep])[:, None]
                for i in range(3):
                    out[a:b, i] += np.bincount(left[keep] - a, push[:, i], b - a)
                a = b
    return out


def _pushed(at: DataFrame, spacing: float) -> DataFrame:
    """at (id, x, y, z) with fx, fy, fz: what pair_forces(at, spacing, spacing, power=1.0) gives, by blocks of cells."""
    cells = at.select("*", *[F.floor(F.col(a) / spacing).cast("long").alias("c" + a) for a in "xyz"])
    for a in "xyz":  # of each axis one block, or two
        blocks = F.array_distinct(F.array(*[F.floor((F.col("c" + a) + d) / BLOCK).cast("long") for d in (-1, 1)]))
        cells = cells.withColumn("b" + a, F.explode(blocks))

    def run(table: pa.Table) -> pa.Table:
        column = lambda names: np.stack([table[c].to_numpy() for c in names], axis=1)
        inside, places = column(["cx", "cy", "cz"]) - column(["bx", "by", "bz"]) * BLOCK, column(["x", "y", "z"])
        own = np.flatnonzero(((inside >= 0) & (inside < BLOCK)).all(axis=1))
        forces = _sums(inside, places, own, spacing)
        rows = table.select(["id", "x", "y", "z"]).take(pa.array(own))
        for i, a in enumerate("xyz"):
            rows = rows.append_column("f" + a, pa.array(forces[:, i]))
        return rows

    kind = at.schema["id"].dataType.simpleString()
    return cells.groupBy("bx", "by", "bz").applyInArrow(run, f"id {kind}, x double, y double, z double, fx double, fy double, fz double")


def force_layout(nodes: DataFrame, edges: DataFrame, order: list, rounds: int = 30, spacing: float = 1.0, seed: int = 42, cooling: float = 0.95, id_col: str = "id") -> DataFrame:
    """nodes with x, y, z. They start at seeded places in a cube of side 10, or of one spacing^3 a node if that is more, so
    that nodes get near ones and not ever more of them; each round every node is pushed by those nearer than spacing and
    pulled along its edges, moving by the cooled sum, at most one spacing. A round is a pass over blocks of the space, two
    joins along edges and an aggregation, written to the shared folder, so that the graph may be of any size; reruns agree
    up to the order of sums."""
    radius = max(5.0, spacing * nodes.count() ** (1 / 3) / 2)
    at = cut(random(nodes.withColumnRenamed(id_col, "id"), order, radius=radius, seed=seed).select("id", "x", "y", "z"), "force")
    edges = cut(edges.select("source", "target", "weight"), "force-edges")
    heat = 0.5
    for _ in range(rounds):
        pull = spring_forces(edges, at, 0.0, 0.05 / spacing).toDF("_id", *["p" + a for a in "xyz"])
        both = _pushed(at, spacing).join(pull, F.col("id") == F.col("_id"), "left")
        total = both.select("id", *"xyz", *[(F.col("f" + a) + F.coalesce("p" + a, F.lit(0.0))).alias("f" + a) for a in "xyz"])
        long = F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy") + F.col("fz") * F.col("fz"))
        held = F.coalesce(F.least(F.lit(1.0), F.try_divide(F.lit(spacing), long * heat)), F.lit(1.0)) * heat
        at = cut(total.select("id", *[(F.col(a) + F.col("f" + a) * held).alias(a) for a in "xyz"]), "force")
        heat *= cooling
    return nodes.join(at.withColumnRenamed("id", id_col), id_col)


def spring_step(nodes: DataFrame, edges: DataFrame, charge: float = 1.0, reach: float = 10.0, length: float = 3.0, strength: float = 1.0, gravity: float = 0.1, friction: float = 0.9) -> DataFrame:
    """One step of nodes (id, x, y, z, vx, vy, vz): repulsion charge^2 / d within reach, springs, a pull to the middle
    and friction."""
    push = pair_forces(nodes, reach, charge * 0.1, power=1.0)
    pull = spring_forces(edges, nodes, length, strength * 0.01)
    total = push.unionByName(pull).groupBy("id").agg(*[F.sum("f" + a).alias("f" + a) for a in "xyz"])
    d = nodes.join(total, "id", "left").fillna(0.0, ["fx", "fy", "fz"])
    v = {"v" + a: (F.col("v" + a) + F.col("f" + a) - F.col(a) * gravity * 0.01) * friction for a in "xyz"}
    d = d.withColumns(v)
    return d.withColumns({a: F.col(a) + F.col("v" + a) for a in "xyz"}).select(*nodes.columns)
