"""Exact dedup by a Golomb-coded fingerprint exchange.

Documents are dealt into blocks. Each block sends every owner (a range of the hash space) the sorted distinct
hashes of that range as one Golomb-coded message; an owner answers each block with a bitmap of the hashes that
another block holds as well. Only rows whose hash is marked (suspects) move with their texts, and the texts
themselves decide which of them are equal."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from luminal.llm import golomb
from luminal.llm.common import cut

MESSAGE_HASHES = 500  # mean hashes in one message from a block to an owner


def owner_of(hashes: np.ndarray, owners: int) -> np.ndarray:
    """Owners hold equal ranges of the unsigned hash space."""
    return ((hashes >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def _by_owner(signed: pd.Series, owners: int):
    values = np.unique(signed.to_numpy(np.int64).view(np.uint64))
    cuts = np.searchsorted(owner_of(values, owners), np.arange(owners + 1))
    return values, cuts


def suspects(keyed: DataFrame, blocks: int) -> DataFrame:
    """keyed (id, h, sha, block) with suspect: whether another row, in this block or another, has the same h."""

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        values, cuts = _by_owner(pdf["h"], blocks)
        rows = [(o, int(pdf["block"].iat[0]), golomb.encode(values[cuts[o] : cuts[o + 1]])) for o in range(blocks) if cuts[o] < cuts[o + 1]]
        return pd.DataFrame(rows, columns=["owner", "block", "message"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = [golomb.decode(m) for m in pdf["message"]]
        seen, counts = np.unique(np.concatenate(runs), return_counts=True)
        shared = seen[counts > 1]
        bitmaps = [np.packbits(np.isin(r, shared, assume_unique=True)).tobytes() for r in runs]
        return pd.DataFrame({"block": pdf["block"], "owner": pdf["owner"], "bitmap": bitmaps})

    def mark(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"id": [], "h": [], "sha": [], "suspect": []})
        values, cuts = _by_owner(rows["h"], blocks)
        marked = np.zeros(len(values), bool)
        for o, bitmap in zip(answers["owner"], answers["bitmap"], strict=True):
            n = cuts[o + 1] - cuts[o]
            marked[cuts[o] : cuts[o + 1]] = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=n).astype(bool)
        h = rows["h"].to_numpy(np.int64).view(np.uint64)
        at = np.searchsorted(values, h)
        marked |= np.bincount(at, minlength=len(values)) > 1
        return pd.DataFrame({"id": rows["id"], "h": rows["h"], "sha": rows["sha"], "suspect": marked[at]})

    messages = keyed.groupBy("block").applyInPandas(send, "owner int, block int, message binary")
    answers = messages.groupBy("owner").applyInPandas(answer, "block int, owner int, bitmap binary")
    kind = keyed.schema["id"].dataType.simpleString()
    return keyed.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(mark, f"id {kind}, h long, sha string, suspect boolean")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id_col, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts equal one another. Of equal texts the row with the largest id
    stays; rows that tie on it (a repeated row) all stay, and a null id loses to any other. An empty table
    gives an empty result. Only id_col and text_col are read, so other columns may have any name."""
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    keyed = cut(docs.select("id", "h", F.sha2("t", 256).alias("sha")), "exact-keys")
    blocks = max(12, math.ceil(math.sqrt(keyed.count() / MESSAGE_HASHES)))
    # equal texts fall in different blocks, so a hot text is spread like any other
    blocked = keyed.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
    marked = cut(suspects(blocked, blocks), "exact-marked")
    # verification by bytes: partial aggregation folds copies before the texts of suspects are shuffled
    moved = docs.join(marked.filter("suspect").select(F.col("id").alias("sid"), F.col("h").alias("sh")), F.col("id").eqNullSafe(F.col("sid")) & (F.col("h") == F.col("sh")), "left_semi")
    classes = moved.groupBy("h", "t").agg(F.max("id").alias("keep_id"), F.count("*").alias("n")).select(F.col("h").alias("ch"), F.sha2("t", 256).alias("csha"), "keep_id", "n")
    out = marked.join(classes, F.col("suspect") & (F.col("h") == F.col("ch")) & (F.col("sha") == F.col("csha")), "left")
    alone = F.col("n").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
