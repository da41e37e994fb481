"""Predicates given as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from luminal.functions.dsl import field

OPERATORS = {
    "$eq": lambda c, v: c.eqNullSafe(F.lit(v)),
    "$ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
    "$in": lambda c, v: c.isin(*v) if v else F.lit(False),
    "$nin": lambda c, v: F.coalesce(~c.isin(*v), F.lit(True)) if v else F.lit(True),
    "$exists": lambda c, v: c.isNotNull() if v else c.isNull(),
}
CONDITIONS = {
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
}


def compile_query(criteria: dict) -> Column:
    """{field: value or {$op: value, ...}, $and/$or: [criteria, ...]}; all parts hold. As a filter, what is null is
    false; nothing is wrapped about the comparisons, so that they reach the scan."""
    out = F.lit(True)
    for name, want in criteria.items():
        if name in ("$and", "$or"):
            one = F.lit(name == "$and")
            for c in want:
                one = one & compile_query(c) if name == "$and" else one | compile_query(c)
            out = out & one
        elif isinstance(want, dict):
            for op, v in want.items():
                if op not in OPERATORS:
                    raise ValueError(f"unknown operator {op}")
                out = out & OPERATORS[op](field(name), v)
        else:
            out = out & OPERATORS["$eq"](field(name), want)
    return out


def query(df: DataFrame, criteria: dict) -> DataFrame:
    return df.filter(compile_query(criteria))


def query_table(registry, form: dict) -> DataFrame:
    """{table, where, order_by, limit}: rows of a dataset of registry (records.Registry) by its name; all but table may
    be left out. order_by is a field, with a minus in front for the greatest first, or a list of them; ties are left open
    unless the last one is unique."""
    if form.get("table") not in registry.names:
        raise KeyError(f"no dataset {form.get('table')}")
    df = query(registry.spark.table(form["table"]), form.get("where") or {})
    if by := form.get("order_by"):
        df = df.orderBy(*[F.desc(b[1:]) if b.startswith("-") else F.asc(b) for b in ([by] if isinstance(by, str) else by)])
    return df.limit(form["limit"]) if form.get("limit") is not None else df


def find_one(df: DataFrame, criteria: dict) -> DataFrame:
    return query(df, criteria).limit(1)


def condition(value: Column, operator: str, threshold) -> Column:
    """An alert's condition; any other operator is never true."""
    return F.coalesce(CONDITIONS[operator](value, F.lit(threshold)), F.lit(False)) if operator in CONDITIONS else F.lit(False)
