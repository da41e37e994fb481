"""Change sets: what turns one table into another, and applying it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from luminal.operators.common import cut, ordinal


def diff(old: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """id, op (add, update, remove) and the new row's columns. Rows are compared column by column, null-safe."""
    cols = [c for c in new.columns if c != id_col]
    a = old.select(id_col, F.struct(*[F.col(c) if c in old.columns else F.lit(None).alias(c) for c in cols]).alias("_old"))
    b = new.select(id_col, F.struct(*cols).alias("_new"))
    d = a.join(b, id_col, "full_outer")
    op = F.when(F.col("_old").isNull(), "add").when(F.col("_new").isNull(), "remove").when(~F.col("_old").eqNullSafe(F.col("_new")), "update")
    return d.withColumn("op", op).filter("op is not null").select(id_col, "op", *[F.col(f"_new.{c}").alias(c) for c in cols])


def apply(base: DataFrame, changes: DataFrame, id_col: str = "id") -> DataFrame:
    """base after changes (id, op, columns). If several name one id the last by seq counts (or, without seq, any).
    An update's null columns stand for null: changes carry whole rows."""
    if "seq" in changes.columns:
        changes = changes.groupBy(id_col).agg(F.max_by(F.struct(*[c for c in changes.columns if c != id_col]), "seq").alias("_c")).select(id_col, "_c.*")
    kept = base.join(changes.select(id_col), id_col, "left_anti")
    return kept.unionByName(changes.filter("op <> 'remove' and op <> 'delete'").select(*base.columns))


def changed_since(df: DataFrame, mark, modified: str = "modified_at", deleted: str = "deleted_at") -> DataFrame:
    """Rows touched after a high-water mark, with their op."""
    after = lambda c: F.coalesce(F.col(c) > F.lit(mark), F.lit(False))
    return df.filter(after(modified) | after(deleted)).withColumn("op", F.when(F.col(deleted).isNotNull(), "delete").otherwise("update"))


def encode_deltas(changes: DataFrame, size: int = 100, order: str = "id") -> DataFrame:
    """Messages of up to size changes of one op: op, batch, n, payload (JSON), checksum."""
    w = W.partitionBy("op", "_shard").orderBy(order)
    shard = F.pmod(F.xxhash64(order), F.lit(64))  # so that one op is not numbered in one task
    d = changes.withColumn("_shard", shard).withColumn("_batch", F.floor((F.row_number().over(w) - 1) / size))
    rows = F.array_sort(F.collect_list(F.struct(order, F.to_json(F.struct(*changes.columns)).alias("_j"))))
    out = d.groupBy("op", "_shard", "_batch").agg(F.count("*").alias("n"), rows.alias("_rows"))
    payload = F.concat(F.lit("["), F.array_join(F.transform("_rows", lambda r: r["_j"]), ","), F.lit("]"))
    return out.select("op", F.concat_ws("-", "_shard", "_batch").alias("batch"), "n", payload.alias("payload"), F.sha2(payload, 256).alias("checksum"))


#: What the operations are called in messages, in the order in which they are sent; fixed values.
MESSAGE_TYPES = {"add": "batch", "move": "update", "update": "update", "remove": "delete", "delete": "delete"}


def delta_messages(changes: DataFrame, size: int = 100, seq: str = "seq", first: int = 1, at=None) -> DataFrame:
    """Messages of up to size changes of one type: sequence (gapless from first), type, timestamp (at), n, payload (a
    JSON array of the changes in order of seq) and checksum (SHA-256 of the payload). Additions come first, then updates
    and moves, then removals, each in order of seq, which no two changes share. Changes of other operations are left out."""
    kinds = F.create_map(*[F.lit(v) for kv in MESSAGE_TYPES.items() for v in kv])
    order = F.create_map(*[F.lit(v) for i, k in enumerate(dict.fromkeys(MESSAGE_TYPES.values())) for v in (k, i)])
    rows = changes.withColumn("_type", kinds[F.col("op")]).filter("_type is not null").withColumn("_order", order[F.col("_type")])
    rows = cut(ordinal(rows, "_order", seq, name="_place"), "delta-messages")
    # three rows: where each type starts among the changes and among the messages
    w = W.orderBy("_order")
    starts = rows.groupBy("_order").agg(F.min("_place").alias("_from"), F.ceil(F.count("*") / size).alias("_m"))
    starts = starts.select("_order", "_from", (F.coalesce(F.sum("_m").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + first).alias("_first"))
    rows = rows.join(F.broadcast(starts), "_order")
    rows = rows.withColumn("sequence", (F.col("_first") + F.floor((F.col("_place") - F.col("_from")) / size)).cast("long"))
    each = F.array_sort(F.collect_list(F.struct(seq, F.to_json(F.struct(*changes.columns)).alias("_j"))))
    out = rows.groupBy("sequence", F.col("_type").alias("type")).agg(F.count("*").alias("n"), each.alias("_rows"))
    payload = F.concat(F.lit("["), F.array_join(F.transform("_rows", lambda r: r["_j"]), ","), F.lit("]"))
    return out.select("sequence", "type", F.lit(at).cast("timestamp").alias("timestamp"), "n", payload.alias("payload"), F.sha2(payload, 256).alias("checksum"))
