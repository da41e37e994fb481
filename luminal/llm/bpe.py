"""Byte-level BPE encoding and decoding over the global distinct-word exchange."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from luminal.llm.pretoken import exchange, pretokens, spans


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", as_array: bool = False) -> DataFrame:
    """One row per row of df: id_col, n_tokens, ids.

    ids are little-endian unsigned 32-bit integers in a binary column, or array<int> with as_array. Each match
    of pattern is encoded separately, without special tokens. Null texts count as empty and give no ids; rows
    that repeat are encoded each; null ids pass through; an empty table gives an empty result."""
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))  # a vocabulary: fixed, about a megabyte

    def answer():
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        known: dict[bytes, bytes] = {}

        def work(words: list[bytes]) -> bytes:
            for w in words:
                if w not in known:
                    known[w] = np.array(encoding._encode_single_piece(w), "<u4").tobytes()
            ids = [known[w] for w in words]
            lens = np.fromiter(map(len, ids), np.uint32, len(ids)) >> np.uint32(2)
            return zstandard.compress(np.uint32(len(ids)).tobytes() + lens.tobytes() + b"".join(ids), 3)

        return work

    def finish(ids, sizes, counts, labels, answers):
        lens, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for raw in map(zstandard.decompress, answers):
            n = int(np.frombuffer(raw, np.uint32, 1)[0])
            lens.append(np.frombuffer(raw, np.uint32, n, 4).astype(np.int64))
            flat.append(np.frombuffer(raw, np.uint32, offset=4 + 4 * n))
        lens, flat = np.concatenate(lens), np.concatenate(flat)
        tokens = flat[spans(lens, labels)]
        ends = np.cumsum(np.concatenate([[0], lens[labels]]))[np.concatenate([[0], np.cumsum(counts)])]
        n_tokens, kind = np.diff(ends), schema_types["id"]
        if as_array:
            packed = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens.astype(np.int32)))
        else:
            packed = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(tokens))])
        return pa.table({"id": pa.array(ids, kind), "n_tokens": pa.array(n_tokens, pa.int64()), "ids": packed})

    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("size"), pretokens(text, pattern).alias("words"))
    schema_types = {"id": docs.select("id").limit(0).toArrow().schema.field("id").type}
    out = exchange(docs, answer, finish, f"id {docs.schema['id'].dataType.simpleString()}, n_tokens long, ids {'array<int>' if as_array else 'binary'}")
    return out.withColumnRenamed("id", id_col)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with out_col, the bytes of the packed ids in ids_col (null stays null).

    The token-byte table is joined on the map side: it is a vocabulary of fixed size. An id outside it is an
    error. Bytes need not be valid UTF-8, since ids may end inside a character. A column of df named out_col is
    replaced."""
    spark = df.sparkSession
    table = spark.sparkContext.broadcast(load_ranks(ranks_path))
    base = df.drop(out_col)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in base.schema)}, `{out_col}` binary"

    def run(batches):
        tokens = sorted((rank, token) for token, rank in table.value.items())
        lens = np.zeros(tokens[-1][0] + 1, np.int64)
        for rank, token in tokens:
            lens[rank] = len(token)
        flat = np.frombuffer(b"".join(t for _, t in tokens), np.uint8)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                packed = [np.frombuffer(x.as_py(), "<u4").astype(np.int64) if x.is_valid else None for x in part[ids_col]]
                decoded = [None if p is None else flat[spans(lens, p)].tobytes() for p in packed]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], names=[*part.schema.names, out_col])

    return base.mapInArrow(run, schema)
