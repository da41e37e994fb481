"""The 32-bit string hash that palettes are picked by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap32(x: Column) -> Column:
    """A long as a signed 32-bit integer."""
    return F.pmod(x + (1 << 31), F.lit(1 << 32)) - (1 << 31)


def _codes(s: Column) -> Column:
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def hash_signed(s: Column) -> Column:
    """h = 31 h + code in 32 bits, over the characters' code points."""
    return F.aggregate(_codes(s), F.lit(0).cast("long"), lambda h, c: wrap32(h * 31 + c))


def hash_string(s: Column) -> Column:
    return F.abs(hash_signed(s))


def hash_material(s: Column) -> Column:
    """The variant in which only the shift wraps: h = code + (32 h in 32 bits) - h."""
    return F.abs(F.aggregate(_codes(s), F.lit(0).cast("long"), lambda h, c: c + wrap32(h * 32) - h))


def pseudo_embedding(s: Column, dims: int = 4) -> Column:
    """dims numbers from -0.995 to 0.995 that depend on the text and the dimension."""
    one = lambda i: (hash_signed(F.concat(s, F.lit(str(i)))) % 200 - F.when(hash_signed(F.concat(s, F.lit(str(i)))) >= 0, 100).otherwise(0)) / F.lit(100.0)
    return F.array(*[one(i) for i in range(dims)])
