"""Sums over all pairs without the pairs: what is near is added one by one, what is far by cells that double in size.

Space is cut into cells, those of level k having twice the side of those of level k - 1. A target and a cell of level k are
near where their cells are at most m[k] apart on every axis. A target takes a cell of level k whole if that is not
near it but the cell's parent is; it takes the single points of the cells that are near on level 0. So each point counts
once for each target, and a target meets a bounded number of cells on each level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from luminal.operators.common import cut


def _cell(axes: list[str], names: list[str], low: list[float], side: float) -> dict[str, Column]:
    return {n: F.floor((F.col(a) - o) / side).cast("long") for a, n, o in zip(axes, names, low, strict=True)}


def _names(axes: list[str], prefix: str) -> list[str]:
    return [f"{prefix}{i}" for i in range(len(axes))]


def _apart(left: list[str], right: list[str]) -> Column:
    return reduce(F.greatest, [F.abs(F.col(a) - F.col(b)) for a, b in zip(left, right, strict=True)]) if len(left) > 1 else F.abs(F.col(left[0]) - F.col(right[0]))


def _around(df: DataFrame, names: list[str], m: int, out: list[str]) -> DataFrame:
    """A row for each cell at most m from the row's cell, as out."""
    for n, o in zip(names, out, strict=True):
        df = df.withColumn(o, F.explode(F.sequence(F.col(n) - m, F.col(n) + m)))
    return df


def levels_for(extent: float, side: float) -> int:
    """Levels until one cell is as wide as extent."""
    k = 0
    while side * 2**k < extent:
        k += 1
    return k


def near_pairs(targets: DataFrame, points: DataFrame, axes: list[str], low: list[float], side: float, m: int) -> DataFrame:
    """Rows of targets (axes and others) with those of points (columns prefixed p_) in cells at most m apart."""
    mine, theirs = _names(axes, "_c"), _names(axes, "_q")
    p = points.select(*[F.col(c).alias(f"p_{c}") for c in points.columns])
    p = p.withColumns(_cell([f"p_{a}" for a in axes], theirs, low, side))
    t = _around(targets.withColumns(_cell(axes, mine, low, side)), mine, m, theirs)
    # rows are multiplied before they meet, which Spark's sizes do not know: a broadcast would take them all to the driver
    return t.hint("merge").join(p, theirs).drop(*mine, *theirs)


def far_pairs(targets: DataFrame, cells: DataFrame, axes: list[str], low: list[float], side: float, level: int, m: list[int]) -> DataFrame:
    """Rows of targets with the cells of a level (their numbers as _k0, _k1, ... and columns prefixed p_) that they take whole."""
    own, up, cell = _names(axes, "_c"), _names(axes, "_u"), _names(axes, "_k")
    t = targets.withColumns(_cell(axes, own, low, side * 2**level))
    t = t.withColumns({u: F.floor(F.col(o) / 2).cast("long") for u, o in zip(up, own, strict=True)})
    c = cells.withColumns({f"_p{i}": F.floor(F.col(k) / 2).cast("long") for i, k in enumerate(cell)})
    met = t.hint("merge").join(_around(c, _names(axes, "_p"), m[level + 1], up).drop(*_names(axes, "_p")), up)
    return met.filter(_apart(own, cell) > m[level]).drop(*own, *up, *cell)


def pyramid(points: DataFrame, axes: list[str], low: list[float], side: float, levels: int, sums: dict[str, Column]) -> list[DataFrame]:
    """For each level from 0: the cells that hold points (_k0, _k1, ...) with sums of columns (p_<name>). Each level is
    summed up from the one below."""
    cell = _names(axes, "_k")
    rows = points.select(*[c.alias(f"p_{k}") for k, c in sums.items()], *[c.alias(n) for n, c in _cell(axes, cell, low, side).items()])
    out = []
    for level in range(levels + 1):
        if level:
            rows = rows.withColumns({k: F.floor(F.col(k) / 2).cast("long") for k in cell})
        rows = cut(rows.groupBy(*cell).agg(*[F.sum(f"p_{k}").alias(f"p_{k}") for k in sums]), "pyramid")
        out.append(rows)
    return out
