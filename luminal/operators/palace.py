"""Drawers of a memory palace as crystals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from luminal.functions.color import embedding_color
from luminal.functions.hashing import hash_string
from luminal.operators.mapping import lookup

# The shapes of the wings.
SHAPES = {"projects": "octahedron", "research": "dodecahedron", "conversations": "icosahedron", "ideas": "sphere", "tasks": "box"}
DAY_MS = 86_400_000


def is_recent(modified_ms: Column, now_ms: Column | int) -> Column:
    """Less than a day before now; what has no time is not recent."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    return F.coalesce(now - modified_ms < DAY_MS, F.lit(False))


def sample_embedding(wing: Column, room: Column) -> Column:
    """Three numbers from -1 to 1 that stand for a drawer without an embedding, by its wing and room."""
    w, r = (F.abs(hash_string(F.coalesce(c.cast("string"), F.lit("")))).cast("long") for c in (wing, room))
    part = lambda x: (x % 200 - 100) / 100
    return F.array(part(w), part(r), part((w % 1_000_003) * (r % 1_000_003)))


def crystals(drawers: DataFrame, now_ms: int) -> DataFrame:
    """drawer_id, wing_id, room_id, content, tags, timestamp, vector, geometry, color, emissive, metalness, roughness and
    pulse of drawers (drawer_id, wing_id, room_id, content, created_at, modified_at in ms, embedding). Tags are the wing
    and the room that are there; an unknown wing is an octahedron; a drawer changed less than a day before now pulses."""
    vector = F.coalesce(F.transform("embedding", lambda v: v.cast("double")), sample_embedding(F.col("wing_id"), F.col("room_id")))
    tags = F.filter(F.array(F.col("wing_id").cast("string"), F.col("room_id").cast("string")), lambda t: t.isNotNull() & (t != ""))
    rows = drawers.withColumn("vector", vector)
    return rows.select(
        "drawer_id", "wing_id", "room_id", "content", tags.alias("tags"), F.col("created_at").alias("timestamp"), "vector", lookup(F.col("wing_id").cast("string"), SHAPES, "octahedron").alias("geometry"),
        embedding_color(F.col("vector")).alias("color"), embedding_color(F.col("vector")).alias("emissive"), F.lit(0.8).alias("metalness"), F.lit(0.2).alias("roughness"), is_recent(F.col("modified_at"), now_ms).alias("pulse"),
    )
