"""The global distinct-word exchange behind byte-level BPE encoding and token counting.

Texts are split into pre-tokens on the JVM. A block of documents keeps its words once, as labels, with the
label at each position. Every distinct word of a block goes to the owner of the word's hash; an owner works each
distinct word out once, however many blocks ask, and answers each block; blocks then reassemble by position."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from luminal.llm.common import tasks

BLOCK_WORDS = 1 << 21  # a block is at most so many pre-tokens, or one document

#: Unicode White_Space, as a Java character class; fixed values.
WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def java_pattern(pattern: str) -> str:
    """pattern with \\s and \\S as Unicode white space, which Java's own mean only for ASCII."""
    return pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")


def pretokens(text: Column, pattern: str, special: str | None = None) -> Column:
    """The matches of pattern in text. A special string splits the text first and then counts as one match;
    those come after the others."""
    find = lambda c: F.regexp_extract_all(c, F.lit(java_pattern(pattern)), F.lit(0))
    if not special:
        return find(text)
    parts = F.split(text, r"\Q" + special + r"\E")
    apart = F.concat(F.flatten(F.transform(parts, find)), F.array_repeat(F.lit(special), F.size(parts) - 1))
    return F.when(F.contains(text, F.lit(special)), apart).otherwise(find(text))


def pack_words(items: list[bytes]) -> bytes:
    lens = np.fromiter(map(len, items), np.uint32, len(items))
    return zstandard.compress(np.uint32(len(items)).tobytes() + lens.tobytes() + b"".join(items), 3)


def unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = (np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends[:-1]], ends, strict=True)] if n else []


def pack_labels(labels: np.ndarray) -> bytes:
    """Three byte planes (four if need be): the higher ones hardly vary, so they nearly vanish."""
    planes = 3 if not len(labels) or labels.max() < 1 << 24 else 4
    by_byte = labels.astype("<u4").view(np.uint8).reshape(-1, 4)
    return bytes([planes]) + zstandard.compress(b"".join(by_byte[:, k].tobytes() for k in range(planes)), 3)


def unpack_labels(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros(raw.shape[1], np.int64)
    for k in range(data[0]):
        out |= raw[k].astype(np.int64) << (8 * k)
    return out


def _blocks(ids: pa.Array, sizes: pa.Array, lists: pa.ListArray, owners: int) -> Iterator[tuple]:
    """Rows of one block: its documents, then a message for each owner."""
    offsets = lists.offsets.to_numpy()
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    distinct = coded.dictionary
    # labels run by owner, and by word within an owner, so that a message needs no labels of its own
    by_word = pa.compute.array_sort_indices(distinct).to_numpy()
    owner = (pd.util.hash_array(np.asarray(distinct.to_pylist(), object), categorize=False) % np.uint64(owners)).astype(np.int64) if len(distinct) else np.zeros(0, np.int64)
    order = by_word[np.argsort(owner[by_word], kind="stable")]
    label = np.empty(len(order), np.int64)
    label[order] = np.arange(len(order))
    labels = label[coded.indices.to_numpy(zero_copy_only=False)]
    data, lens = pack_labels(labels), np.diff(offsets).astype("<u4").tobytes()
    digest = xxhash.xxh64(data + lens)
    digest.update(repr((ids[0], ids[-1])))  # the same rows give the same block whenever a lost task runs again
    block = np.uint64(digest.intdigest()).astype(np.int64).item()
    yield block, None, ids.to_pylist(), sizes.to_pylist(), lens, data
    words = [w.encode() for w in distinct.take(pa.array(order)).to_pylist()]
    cuts = np.searchsorted(owner[order], np.arange(owners + 1))
    for o in range(owners):
        if cuts[o] < cuts[o + 1]:
            yield block, o, None, None, None, pack_words(words[cuts[o] : cuts[o + 1]])


def exchange(docs: DataFrame, answer: Callable[[], Callable[[list[bytes]], bytes]], finish: Callable, out_schema: str) -> DataFrame:
    """docs: (id, size, words). answer() is called once in a task that owns words and gives a function from the
    words of a message to the answer, remembering what it has worked out. finish(ids, sizes, counts, labels,
    answers) makes the columns of out_schema for a block, answers being in order of labels."""
    spark = docs.sparkSession
    owners = 2 * tasks(spark)
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"block long, owner int, ids array<{kind}>, sizes array<long>, lens binary, data binary"
    arrow = docs.sparkSession.createDataFrame([], schema).toArrow().schema

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.diff(batch["words"].offsets.to_numpy())
            start, held = 0, 0
            for i, n in enumerate([*counts.tolist(), None]):
                if n is None or held and held + n > BLOCK_WORDS:
                    if i > start:
                        part = batch.slice(start, i - start)
                        rows = list(_blocks(part["id"], part["size"], part["words"], owners))
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                    start, held = i, 0
                held += n or 0

    def messages(batches):
        for b in batches:
            yield b.filter(pa.compute.is_valid(b["owner"]))

    def own(batches):
        work = answer()
        for b in batches:
            answers = [work(unpack_words(m.as_py())) for m in b["data"]]
            yield pa.RecordBatch.from_arrays([b["block"], b["owner"], pa.array(answers, pa.binary())], names=["block", "owner", "answer"])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        by_owner = dict(zip(right["owner"].to_pylist(), right["answer"].to_pylist(), strict=True))
        answers = [by_owner[o] for o in sorted(by_owner)]
        tables = []
        for row in left.filter(pa.compute.is_null(left["owner"])).to_pylist():
            tables.append(finish(row["ids"], np.array(row["sizes"], np.int64), np.frombuffer(row["lens"], "<u4").astype(np.int64), unpack_labels(row["data"]), answers))
        return pa.concat_tables(tables) if tables else out_arrow.empty_table()

    out_arrow = docs.sparkSession.createDataFrame([], out_schema).toArrow().schema
    # both sides read this one exchange, and the documents' side of the cogroup has no other; messages are told
    # apart in Python so that no filter moves below it
    sent = docs.mapInArrow(split, schema).repartition(tasks(spark), "block")
    asked = sent.mapInArrow(messages, schema).repartition(tasks(spark), "owner")
    answered = asked.mapInArrow(own, "block long, owner int, answer binary")
    return sent.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(join, out_schema)


def spans(lens: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Where the items of each label stand in a flat array in order of labels, one label after the other."""
    starts = np.cumsum(lens) - lens
    n = lens[labels]
    ends = np.cumsum(n)
    return np.repeat(starts[labels] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def by_document(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of values over each document's positions."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
