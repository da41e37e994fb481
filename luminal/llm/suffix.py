"""Suffix-array dedup: repeated byte strings by a common-prefix-aware distributed merge sort.

A string of `length` bytes repeats if an equal one starts earlier. Every such string (a window) is filed under one
anchor, the least hash of a k-gram within it, which depends on its bytes alone. So it is enough to sort the
suffixes at anchors, each with the bytes before it that its windows need; anchors whose k-gram is nowhere else
drop out first. Blocks send sorted, front-coded runs by ranges of suffixes, and ranges merge them with a loser
tree that keeps common prefixes and compares no byte twice. Neighbours then show which windows are equal."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from luminal.llm import golomb
from luminal.llm.common import cut, tasks

BLOCK_BYTES = 4 << 20  # mean text of a block
RANGE_BYTES = 32 << 20  # text that an owner or a range stands for at most, however few the shuffle partitions
MOST_SAMPLE = 1 << 20  # suffixes that the driver chooses splitters from at most
CHUNK = 1 << 17  # windows worked on at once
FEW = 16  # suffixes of one k-gram that are compared pair by pair
HOT = 2000  # anchors of one k-gram beyond which their windows are dealt out by hash instead
SAMPLE = 64  # suffixes a range that splitters are chosen from; fewer a range where there are over MOST_SAMPLE in all
LEAST_SAMPLE = 4
RARE = 1024  # one k-gram of so many may be in the sample, by hash
PRIME = 0x9E3779B97F4A7C15
NO_ID = (1 << 63) - 1


class Block:
    """The texts of some documents end to end, in order of id."""

    def __init__(self, table: pa.Table):
        ids, texts = table["id"].to_pylist(), [(t or "").encode() for t in table["t"].to_pylist()]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids = [ids[i] for i in self.order]
        self.texts = [texts[i] for i in self.order]
        self.bytes = np.frombuffer(b"".join(self.texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in self.texts]) if ids else np.zeros(0, np.int64)
        self.starts = self.ends - np.array([len(t) for t in self.texts], np.int64)

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and place in its text of each byte."""
        doc = np.searchsorted(self.ends, at, "right")
        return np.array([NO_ID if i is None else i for i in self.ids], np.int64)[doc], at - self.starts[doc]


def anchors(block: Block, length: int, k: int) -> tuple[np.ndarray, ...]:
    """For each anchor: its k-gram's hash, its place, and the least and most bytes before it at which a window of
    its starts. Windows lie within documents and each has one anchor."""
    width = length - k + 1
    text, n = block.bytes, len(block.bytes)
    valid = np.zeros(n + 1, np.int32)
    last = block.ends - length
    own = last >= block.starts
    np.add.at(valid, block.starts[own], 1)
    np.add.at(valid, last[own] + 1, -1)
    valid = np.cumsum(valid)[:n] > 0
    out = []
    for s in range(0, max(0, n - length + 1), CHUNK):
        windows = min(CHUNK, n - length + 1 - s)
        p = np.flatnonzero(valid[s : s + windows])
        if not len(p):
            continue
        h = text[s : s + windows + length - 1].astype(np.uint64) + np.uint64(1)
        have, power = 1, PRIME
        while have < k:  # k is a power of two: hashes of twice the length from two of the length
            h = h[:-have] * np.uint64(power) + h[have:]
            power = power * power & (1 << 64) - 1
            have *= 2
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        low = np.uint64((1 << 18) - 1)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < width:
            key = np.minimum(key[: windows], key[width - span : width - span + windows])
        at = (key[p] & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(p) != 1)]))
        end = np.concatenate([first[1:], [len(p)]]) - 1
        a = at[first]
        out.append((h[a], s + a, a - p[end], a - p[first]))
    if not out:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def keys_of(block: Block, at: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, k: int) -> np.ndarray:
    """Sort keys: the suffix as far as windows need it, how far windows reach, and the bytes before, backwards."""
    left = length - k
    out = np.zeros((len(at), length + 2 + left), np.uint8)
    text = np.concatenate([np.zeros(left, np.uint8), block.bytes, np.zeros(length, np.uint8)])
    right = text[(at + left)[:, None] + np.arange(length)]
    out[:, :length] = np.where(np.arange(length) < (length - low)[:, None], right, 0)
    out[:, length], out[:, length + 1] = low, high
    before = text[(at + left)[:, None] - 1 - np.arange(left)]
    out[:, length + 2 :] = np.where(np.arange(left) < high[:, None], before, 0)
    return out


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(a, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays), 1)


def unpack(data: bytes, many: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(many, 8, -1)
    return [np.ascontiguousarray(a.T).view(np.int64).ravel() for a in raw]


def front_code(keys: list[bytes], size: int) -> bytes:
    """Sorted keys of one size: the length of the prefix shared with the one before, and what follows it."""
    m = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, size)
    same = np.zeros(len(m), np.int64)
    if len(m) > 1:
        differ = m[1:] != m[:-1]
        same[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
    rest = m[np.arange(size) >= same[:, None]]
    return zstandard.compress(np.uint32(len(m)).tobytes() + same.astype(np.uint8).tobytes() + rest.tobytes(), 3)


def front_decode(data: bytes, size: int) -> Iterator[tuple[int, bytes]]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    at, key = 4 + n, b""
    for same in raw[4 : 4 + n]:
        to = at + size - same
        key = key[:same] + raw[at:to]
        at = to
        yield same, key


def merge(runs: list[Iterator[tuple[int, bytes]]], size: int) -> Iterator[tuple[int, int, bytes]]:
    """Of sorted runs of (prefix shared with the one before, key): (run, prefix shared with the last one out, key) in
    order. A loser tree: each run at a node remembers the prefix that it shares with the run that beat it there.
    Of two runs the one that shares more with the last key out is less; only if they share as much are their bytes
    compared, from there on."""
    many = 1
    while many < len(runs):
        many *= 2
    heads, shared = [None] * many, [0] * many

    def advance(r: int) -> None:
        shared[r], heads[r] = next(runs[r], (-1, None)) if r < len(runs) else (-1, None)

    def beats(a: int, b: int) -> bool:
        """Whether a goes before b; the prefix of the loser is brought up to date."""
        x, y = shared[a], shared[b]
        if x != y:
            return x > y
        if x < 0:
            return True
        ka, kb = heads[a], heads[b]
        differ = int.from_bytes(ka[x:], "big") ^ int.from_bytes(kb[x:], "big")
        same = size - (differ.bit_length() + 7) // 8
        if ka <= kb:
            shared[b] = same
            return True
        shared[a] = same
        return False

    for r in range(many):
        advance(r)
    losers = [0] * many

    def build(node: int) -> int:
        if node >= many:
            return node - many
        a, b = build(2 * node), build(2 * node + 1)
        winner, losers[node] = (a, b) if beats(a, b) else (b, a)
        return winner

    winner = build(1)
    while heads[winner] is not None:
        yield winner, shared[winner], heads[winner]
        advance(winner)
        node = (winner + many) >> 1
        while node:
            other = losers[node]
            x, y = shared[winner], shared[other]
            if x < y or x == y and not beats(winner, other):
                losers[node], winner = winner, other
            node >>= 1


def _later(ids: np.ndarray, places: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether i is later than j, and j than i."""
    return (ids[i] > ids[j]) | (ids[i] == ids[j]) & (places[i] > places[j]), (ids[j] > ids[i]) | (ids[i] == ids[j]) & (places[j] > places[i])


def _firsts(group: np.ndarray, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For sorted groups: the index of the earliest of its group, for each row."""
    order = np.lexsort((places, ids, group))
    heads = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    first = order[np.maximum.accumulate(np.where(heads, np.arange(len(order)), 0))]
    out = np.empty(len(group), np.int64)
    out[order] = first
    return out


def windows_of(keys: np.ndarray, rows: np.ndarray, low, high, ids, places, at, blocks, length: int) -> list[np.ndarray]:
    """Every window of some anchors: hash (two halves), id, place in its text, block, place in its block."""
    n = (high - low + 1)[rows]
    each = np.repeat(rows, n)
    delta = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[each]
    hashes = []
    for r in rows.tolist():
        key, l, h = keys[r].tobytes(), int(low[r]), int(high[r])
        whole = key[length + 2 : length + 2 + h][::-1] + key[:length]
        hashes += [xxhash.xxh3_128_digest(whole[h - d : h - d + length]) for d in range(l, h + 1)]
    halves = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
    return [halves[:, 0].copy(), halves[:, 1].copy(), ids[each], places[each] - delta, blocks[each], at[each] - delta]


def settle(windows: list[np.ndarray]) -> tuple[pa.Table, list[np.ndarray]]:
    """Of equal windows all but the earliest repeat: their marks; and the others."""
    one, two, ids, places, blocks, at = windows
    order = np.lexsort((two, one))
    new = np.concatenate([[True], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new)
    mine = np.arange(len(group))
    later = _later(ids, places, mine, _firsts(group, ids, places))[0]
    return _marks(blocks[later], at[later], at[later]), [w[~later] for w in windows]


SENT = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("run", pa.binary()), ("data", pa.binary()), ("marks", pa.binary()), ("windows", pa.binary())])
OUT = "block long, part int, run binary, data binary, marks binary, windows binary"


def _rows(**columns) -> pa.Table:
    n = max(len(c) for c in columns.values())
    return pa.table([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in SENT], schema=SENT)


def _marks(block, low, high) -> pa.Table:
    """Rows of packed (first, last) window starts, one for each block."""
    if not len(block):
        return _rows(block=[])
    order = np.argsort(block, kind="stable")
    names, cuts = np.unique(block[order], return_index=True)
    parts = np.split(order, cuts[1:])
    return _rows(block=names, marks=[pack(low[p], high[p]) for p in parts])


def _blocked(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    total = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    return docs.withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks))), blocks


def repeated_windows(docs: DataFrame, blocks: int, length: int, k: int) -> DataFrame:
    """docs (id, t, block) to (block, marks): windows (first, last start in the block) that also start earlier."""
    spark = docs.sparkSession
    least = math.ceil(blocks * BLOCK_BYTES / RANGE_BYTES)
    owners = max(1, least, min(blocks, tasks(spark)))
    hashed = ranges = max(tasks(spark), min(least, MOST_SAMPLE // LEAST_SAMPLE))
    size = 2 * length - k + 2
    owner_of = lambda h: ((h >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)

    def ask(table: pa.Table) -> pa.Table:
        """Distinct k-gram hashes for each owner, with how often each is here; and a sample of suffixes."""
        block, name = Block(table), table["block"][0].as_py()
        hashes, at, _, _ = anchors(block, length, k)
        values, first, counts = np.unique(hashes, return_index=True, return_counts=True)
        cuts = np.searchsorted(owner_of(values), np.arange(owners + 1))
        rows = []
        for o in np.flatnonzero(np.diff(cuts)).tolist():
            s = slice(cuts[o], cuts[o + 1])
            grams = [block.bytes[a : a + k].tobytes() for a in at[first[s]][values[s] % np.uint64(RARE) == 0].tolist()]
            rows.append((name, o, golomb.encode(values[s]), zstandard.compress(np.minimum(counts[s], 65535).astype("<u2").tobytes(), 1), grams))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary())), strict=True)], names=["block", "owner", "message", "counts", "grams"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each block's message two bitmaps: k-grams that other blocks have too, and hot ones."""
        runs = [golomb.decode(m) for m in pdf["message"]]
        counts = [np.frombuffer(zstandard.decompress(c), "<u2").astype(np.int64) for c in pdf["counts"]]
        values, at = np.unique(np.concatenate(runs), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts)).astype(np.int64)
        many = np.bincount(at) > 1
        ends = np.cumsum([len(r) for r in runs])
        split = lambda flags: [np.packbits(x).tobytes() for x in np.split(flags[at], ends[:-1])]
        return pd.DataFrame({"block": pdf["block"], "owner": pdf["owner"], "shared": split(many), "hot": split(total > HOT)})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block's anchors that may repeat: sorted runs by range, windows of hot ones, and what repeats here."""
        if not left.num_rows:
            return _rows(block=[])
        block, name = Block(left), left["block"][0].as_py()
        hashes, at, low, high = anchors(block, length, k)
        values, where, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        cuts = np.searchsorted(owner_of(values), np.arange(owners + 1))
        shared, hot = np.zeros(len(values), bool), np.zeros(len(values), bool)
        for o, a, b in zip(right["owner"].to_pylist(), right["shared"].to_pylist(), right["hot"].to_pylist(), strict=True):
            s = slice(cuts[o], cuts[o + 1])
            shared[s] = np.unpackbits(np.frombuffer(a, np.uint8), count=cuts[o + 1] - cuts[o]).astype(bool)
            hot[s] = np.unpackbits(np.frombuffer(b, np.uint8), count=cuts[o + 1] - cuts[o]).astype(bool)
        keep = np.flatnonzero((shared | (counts > 1))[where])
        if not len(keep):
            return _rows(block=[])
        at, low, high, hot = at[keep], low[keep], high[keep], hot[where[keep]]
        ids, places = block.place(at)
        keys = keys_of(block, at, low, high, length, k)
        flat = [r.tobytes() for r in keys]
        order = np.array(sorted(range(len(flat)), key=flat.__getitem__))
        # equal keys here: all but the earliest repeat, whatever other blocks hold
        same = np.cumsum(np.concatenate([[True], (keys[order][1:] != keys[order][:-1]).any(axis=1)]))
        first = order[_firsts(same, ids[order], places[order])]
        repeats = _later(ids, places, order, first)[0]
        out = [_marks(np.full(repeats.sum(), name), (at - high)[order[repeats]], (at - low)[order[repeats]])]
        order = order[~repeats]  # with rows that repeat with their id, which are not later than one another
        sent = order[~hot[order]]
        if len(sent):
            begins = [0, *[bisect.bisect_left(sent, s, key=flat.__getitem__) for s in splitters.value], len(sent)]
            parts = [(r, sent[b:e]) for r, (b, e) in enumerate(zip(begins, begins[1:], strict=False)) if b < e]
            out.append(_rows(block=[name] * len(parts), part=[r for r, _ in parts], run=[front_code([flat[i] for i in p.tolist()], size) for _, p in parts], data=[pack(ids[p], places[p], at[p]) for _, p in parts]))
        if hot[order].any():
            repeats, windows = settle(windows_of(keys, order[hot[order]], low, high, ids, places, at, np.full(len(at), name), length))
            owner = windows[0].view(np.uint64) % np.uint64(hashed)
            by = [(o, np.flatnonzero(owner == o)) for o in np.unique(owner)]
            out += [repeats, _rows(block=[name] * len(by), part=[o for o, _ in by], windows=[pack(*[w[i] for w in windows]) for _, i in by])]
        return pa.concat_tables(out)

    def meet(table: pa.Table) -> pa.Table:
        """Windows of hot anchors that one hash range has from all blocks, each block having sent one of each."""
        pieces = [unpack(w, 6) for w in table["windows"].to_pylist()]
        return settle([np.concatenate(x) for x in zip(*pieces, strict=True)])[0]

    def combine(table: pa.Table) -> pa.Table:
        """Merge the runs of a range, and compare the suffixes of each k-gram."""
        pieces = table.to_pylist()
        data = [unpack(p["data"], 3) for p in pieces]
        out = list(merge([front_decode(p["run"], size) for p in pieces], size))
        source = np.array([r for r, _, _ in out])
        shared = np.array([s for _, s, _ in out])
        keys = np.frombuffer(b"".join([key for _, _, key in out]), np.uint8).reshape(-1, size)
        del out
        nth = np.empty(len(source), np.int64)
        by_run = np.argsort(source, kind="stable")
        nth[by_run] = np.concatenate([np.arange(len(d[0])) for d in data])
        begin = np.cumsum([0, *[len(d[0]) for d in data]])[:-1]
        ids, places, at = (np.concatenate([d[i] for d in data])[begin[source] + nth] for i in range(3))
        blocks = np.array([p["block"] for p in pieces], np.int64)[source]
        low, high = keys[:, length].astype(np.int64), keys[:, length + 1].astype(np.int64)
        mine = np.arange(len(keys))
        equal = np.cumsum(np.concatenate([[1], shared[1:] < size]))
        first = _firsts(equal, ids, places)
        late = _later(ids, places, mine, first)[0]
        marked = [(blocks[late], (at - high)[late], (at - low)[late])]
        gram = np.cumsum(np.concatenate([[1], shared[1:] < k]))
        rest = mine[~late]  # one of each key, still in order
        many = np.bincount(gram[rest])[gram[rest]]
        small, large = rest[(many > 1) & (many <= FEW)], rest[many > FEW]
        for step in range(1, FEW):
            i, j = small[:-step], small[step:]
            own = gram[i] == gram[j]
            if not own.any():
                break
            for s in range(0, own.sum(), 1 << 16):
                a, b = i[own][s : s + (1 << 16)], j[own][s : s + (1 << 16)]
                ahead = (keys[a, :length] != keys[b, :length])
                right = np.where(ahead.any(axis=1), ahead.argmax(axis=1), length)
                behind = keys[a, length + 2 :] != keys[b, length + 2 :]
                left = np.where(behind.any(axis=1), behind.argmax(axis=1), length - k)
                d_low = np.maximum(length - right, np.maximum(low[a], low[b]))
                d_high = np.minimum(left, np.minimum(high[a], high[b]))
                a_late, b_late = _later(ids, places, a, b)
                for rows, late in ((a, a_late & (d_low <= d_high)), (b, b_late & (d_low <= d_high))):
                    marked.append((blocks[rows[late]], at[rows[late]] - d_high[late], at[rows[late]] - d_low[late]))
        tables = [_marks(*[np.concatenate(x) for x in zip(*marked, strict=True)])]
        if len(large):  # all suffixes of a k-gram that is not hot are here, so its windows are settled here
            tables.append(settle(windows_of(keys, large, low, high, ids, places, at, blocks, length))[0])
        return pa.concat_tables(tables)

    asked = cut(docs.groupBy("block").applyInArrow(ask, "block long, owner int, message binary, counts binary, grams array<binary>"), "suffix-asked")
    # splitters of the ranges: a bounded sample, the least by hash
    grams = asked.select(F.explode("grams").alias("g")).distinct().orderBy(F.xxhash64("g"), "g").limit(max(ranges, min(SAMPLE * ranges, MOST_SAMPLE)))
    sample = sorted(bytes(r.g) for r in grams.collect())
    ranges = min(ranges, len(sample) + 1)
    splitters = spark.sparkContext.broadcast([sample[i * len(sample) // ranges] for i in range(1, ranges)])
    answered = asked.select("block", "owner", "message", "counts").groupBy("owner").applyInPandas(answer, "block long, owner int, shared binary, hot binary")
    runs = cut(docs.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(run, OUT), "suffix-runs")
    merged = runs.filter("run is not null").groupBy("part").applyInArrow(combine, OUT)
    met = runs.filter("windows is not null").groupBy("part").applyInArrow(meet, OUT)
    return runs.unionByName(merged).filter("marks is not null").unionByName(met.filter("marks is not null")).select("block", "marks")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, k: int = 32) -> DataFrame:
    """One row per row of df: id_col, n_bytes, n_removed, spans (array of start, stop: the removed bytes), kept (binary).

    A byte is removed if a string of length bytes over it also starts earlier: in a document with a smaller id, or
    earlier in the same one. k, a power of two, is the part of it that anchors hash. Texts count as UTF-8 bytes, a
    null text as empty; what is kept need not be valid UTF-8. ids are integers, a null one being later than all;
    rows that share an id are compared by where strings start, so that a repeated row loses nothing to itself.
    An empty table gives an empty result."""
    if length <= k or k & (k - 1) or length + length - k + 2 > 255:
        raise ValueError("k must be a power of two below length, and 2 length - k at most 253")
    docs, blocks = _blocked(df, id_col, text_col)
    marks = repeated_windows(docs, blocks, length, k)
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left) if left.num_rows else None
        rows = []
        if block:
            turn = np.zeros(len(block.bytes) + 1, np.int32)
            for data in right["marks"].to_pylist():
                low, high = unpack(data, 2)
                np.add.at(turn, low, 1)
                np.add.at(turn, high + length, -1)
            gone = np.cumsum(turn)[:-1] > 0
            for i, text, s, e in zip(block.ids, block.texts, block.starts.tolist(), block.ends.tolist(), strict=True):
                own = gone[s:e]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                spans = [{"start": a, "stop": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
                kept = np.frombuffer(text, np.uint8)[~own].tobytes() if spans else text
                rows.append((i, len(text), len(text) - len(kept), spans, kept))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), span, pa.binary()), strict=True)], names=["id", "n_bytes", "n_removed", "spans", "kept"])

    out = docs.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(apply, "id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)
