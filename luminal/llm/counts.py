"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from luminal.llm.pretoken import by_document, exchange, pretokens


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes
    stand for themselves, and the others for the characters from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


def load_merges(path: str) -> tuple[list[int], dict[int, tuple[int, int]], list[str]]:
    """The symbol of each byte; rank and new symbol of each pair (left << 20 | right); special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    pairs = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        pairs[vocab[left] << 20 | vocab[right]] = (rank, vocab[left + right])
    alphabet = byte_alphabet()
    return [vocab[alphabet[b]] for b in range(256)], pairs, [t["content"] for t in spec["added_tokens"]]


def count_word(word: bytes, symbols: list[int], pairs: dict[int, tuple[int, int]]) -> int:
    """Initial symbols minus merges. The heap holds adjacent pairs by rank, then by place; symbols hang in a
    doubly linked list, and a pair whose symbols have changed since it was pushed is passed over."""
    own = [symbols[b] for b in word]
    n = len(own)
    heap = []
    for i in range(n - 1):
        pair = own[i] << 20 | own[i + 1]
        if pair in pairs:
            heap.append((pairs[pair][0], i, pair))
    if not heap:
        return n
    heapify(heap)
    after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
    while heap:
        _, i, pair = heappop(heap)
        j = after[i]
        if own[i] < 0 or j >= n or own[i] << 20 | own[j] != pair:
            continue
        own[i], own[j] = pairs[pair][1], -1
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            pair = own[i] << 20 | own[k]
            if pair in pairs:
                heappush(heap, (pairs[pair][0], i, pair))
        h = before[i]
        if h >= 0:
            pair = own[h] << 20 | own[i]
            if pair in pairs:
                heappush(heap, (pairs[pair][0], h, pair))
    return left


def token_counts(df: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per row of df: id_col, n_bytes, n_tokens, over_limit.

    Counts what a byte-level BPE tokenizer file gives for the whole text, without begin or end tokens; its
    special strings inside a text count as one token each. Each distinct word is merged once, at its owner, and
    no identifiers are made. Null texts count as empty (0 tokens, not over the limit); repeated rows and null ids
    pass through; an empty table gives an empty result."""
    symbols, pairs, specials = load_merges(tokenizer_path)
    if len(specials) > 1:
        raise ValueError("more than one special string")
    spark = df.sparkSession
    rules = spark.sparkContext.broadcast((symbols, pairs))  # a vocabulary: fixed, a few megabytes
    special = specials[0] if specials else None

    def answer():
        own, ranked = rules.value
        known: dict[bytes, int] = {special.encode(): 1} if special else {}

        def work(words: list[bytes]) -> bytes:
            for w in words:
                if w not in known:
                    known[w] = count_word(w, own, ranked)
            return np.fromiter((known[w] for w in words), np.uint32, len(words)).tobytes()

        return work

    def finish(ids, sizes, counts, labels, answers):
        tokens = np.frombuffer(b"".join(answers), np.uint32).astype(np.int64)
        n = by_document(tokens[labels], counts)
        return pa.table({"id": pa.array(ids, kind), "n_bytes": pa.array(sizes), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("size"), pretokens(text, pattern, special).alias("words"))
    kind = docs.select("id").limit(0).toArrow().schema.field("id").type
    out = exchange(docs, answer, finish, f"id {docs.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
