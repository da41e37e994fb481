"""SimHash near-dedup by the generalised pigeonhole principle.

Bits that go together are put in one partition. If the radii t_i of the partitions sum to t - m + 1, fingerprints
within t bits agree to within t_i bits in some partition i. The radii are allotted to each fingerprint by dynamic
programming on the candidates it would meet, so a partition where its value is common gets a small radius or none.
Probes and indexed values meet in buckets, where links are verified by popcount and reduced to star edges; no
list of all pairs is ever made."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from luminal.llm.common import cut, tasks
from luminal.llm.components import components

SEED = 42
ROW_COST = 500  # what sending a row costs, in verifications
MOST_RADIUS = 3
HEAVY = 4096  # indexed values of a bucket that one task compares with as many probes
ESTIMATE_BITS = 16


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """h for lane 0, and for others a hash of it."""
    if not lane:
        return h
    x = h ^ np.uint64((lane * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (n, lanes) have each bit; 255 at a time, so that bytes can be added as bytes."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(len(hashes), -1), axis=1)
    full = len(bits) // 255 * 255
    return bits[:full].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[full:].sum(axis=0, dtype=np.int64)


def simhash_of(*hashes: np.ndarray, lanes: int = 1) -> bytes:
    """lanes 64-bit SimHashes, big-endian, of shingle hashes that are given in parts; zero if there are none."""
    n, counts = sum(map(len, hashes)), np.zeros(64 * lanes, np.int64)
    for part in hashes:
        for k in range(0, len(part), 1 << 16):
            h = part[k : k + (1 << 16)]
            counts += _bit_counts(np.stack([_mixed(h, lane) for lane in range(lanes)], axis=1))
    return np.packbits(2 * counts > n).tobytes()


def fingerprint(text: str | None, width: int, lanes: int) -> bytes:
    """lanes 64-bit SimHashes, big-endian, of the shingles of width words (all words if fewer; zero if none)."""
    found = (text or "").encode().lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not found:
        return bytes(8 * lanes)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in found), np.int64, len(found)))
    n = max(1, len(found) - width + 1)
    starts, stops = [0, *ends[: n - 1].tolist()], (ends[-n:] - 1).tolist()
    hashes = []
    for k in range(0, n, 1 << 16):
        raw = b"".join([xxhash.xxh64_digest(joined[a:b], SEED) for a, b in zip(starts[k : k + (1 << 16)], stops[k : k + (1 << 16)], strict=True)])
        hashes.append(np.frombuffer(raw, ">u8").astype(np.uint64))
    return simhash_of(*hashes, lanes=lanes)


def _rows(column: pa.Array, size: int) -> np.ndarray:
    """A binary column of equal lengths as a byte matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)


@lru_cache
def _masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.int64)


def _ball(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1))


def choose_partitions(n: int, bits: int, most: int) -> int:
    """How many partitions make probing n fingerprints cheapest if their bits were even."""

    def cost(m: int) -> float:
        width = bits // m
        steps, spare = (most + 1) // m, (most + 1) % m  # units of radius + 1
        if steps > MOST_RADIUS + 1 or steps == MOST_RADIUS + 1 and spare or m > most + 1:
            return float("inf")
        balls = (m - spare) * (_ball(width, steps - 1) if steps else 0) + spare * _ball(width, steps)
        return ROW_COST * (m + balls) + balls * n / 2.0**width

    return min((m for m in range(1, bits // 8 + 1) if bits // m <= 22), key=cost)


def group_bits(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Partitions of nearly equal width, the most correlated bits in one: each starts with the bit that goes
    most with others, and takes in turn the bit that goes most with those it has."""
    ones = np.diag(together) / max(1, n)
    spread = np.sqrt(np.maximum(ones * (1 - ones), 1e-12))
    phi = np.abs((together / max(1, n) - np.outer(ones, ones)) / np.outer(spread, spread))
    free, out, bits = list(range(len(ones))), [], len(ones)
    for i in range(m):
        size = (bits * (i + 1)) // m - (bits * i) // m
        part = [max(free, key=lambda b: phi[b, free].sum())]
        free.remove(part[0])
        while len(part) < size:
            part.append(max(free, key=lambda b: phi[b, part].sum()))
            free.remove(part[-1])
        out.append(sorted(part))
    return out


def _values(matrix: np.ndarray, parts: list[list[int]]) -> list[np.ndarray]:
    bits = np.unpackbits(matrix, axis=1)
    return [bits[:, p].astype(np.int64) @ (1 << np.arange(len(p), dtype=np.int64)) for p in parts]


def near_counts(counts: np.ndarray, width: int) -> list[np.ndarray]:
    """For each value, the indexed values at exactly 0, 1, ... bits from it."""
    at = np.arange(1 << width)
    rings = [counts.astype(np.float64)]
    for r in range(MOST_RADIUS):
        stepped = sum(rings[r][at ^ (1 << b)] for b in range(width))
        rings.append((stepped - (width - r + 1) * (rings[r - 1] if r else 0)) / (r + 1))
    return rings


def allot(costs: list[np.ndarray], units: int) -> np.ndarray:
    """costs[i][u]: per fingerprint, the cost of u units (radius u - 1; none for 0) in partition i. The cheapest
    units per partition that sum to units, by dynamic programming: (fingerprints, partitions)."""
    n = costs[0].shape[1]
    best = np.full((units + 1, n), np.inf)
    best[0] = 0
    chosen = []
    for cost in costs:
        new, take = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
        for u in range(len(cost)):
            with_u = best[: units + 1 - u] + cost[u]
            better = with_u < new[u:]
            new[u:][better] = with_u[better]
            take[u:][better] = u
        best = new
        chosen.append(take)
    left, out = np.full(n, units), np.zeros((n, len(costs)), np.int64)
    for i in reversed(range(len(costs))):
        out[:, i] = chosen[i][left, np.arange(n)]
        left = left - out[:, i]
    return out


def stars(pairs_a: np.ndarray, pairs_b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes reaches over the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[pairs_a], label[pairs_b])
        new = label.copy()
        np.minimum.at(new, label[pairs_a], low)
        np.minimum.at(new, label[pairs_b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links_in(indexed: np.ndarray, probing: np.ndarray, most: int):
    """Star edges (two byte matrices) that join what the links of most bits between indexed and probing join."""
    size = indexed.shape[1]
    nodes, at = np.unique(np.concatenate([indexed, probing]), axis=0, return_inverse=True)
    if len(nodes) < 2:
        return nodes[:0], nodes[:0]
    at = at.ravel()
    word = lambda m: np.ascontiguousarray(m).view(np.uint64).reshape(len(m), size // 8)
    a, b, found_a, found_b = word(indexed), word(probing), [], []
    step = max(1, (1 << 18) // max(1, len(b)))
    label = np.arange(len(nodes))
    for k in range(0, len(a), step):
        far = sum(np.bitwise_count(a[k : k + step, None, w] ^ b[None, :, w]).astype(np.int16) for w in range(size // 8))
        i, j = np.nonzero(far <= most)
        found_a.append(at[k + i])
        found_b.append(at[len(a) + j])
        if sum(map(len, found_a)) > 1 << 18:  # fold what there is, so that a dense bucket stays small
            label = stars(np.concatenate([*found_a, np.arange(len(nodes))]), np.concatenate([*found_b, label]), len(nodes))
            found_a, found_b = [], []
    label = stars(np.concatenate([*found_a, np.arange(len(nodes))]), np.concatenate([*found_b, label]), len(nodes))
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _entries(fps: DataFrame, parts: list[list[int]], counts, most: int, size: int) -> DataFrame:
    """(key, probe, fp): each fingerprint once per partition as indexed, and once per probe."""
    shift = max(map(len, parts))
    schema = pa.schema([("key", pa.int32()), ("probe", pa.bool_()), ("fp", pa.binary())])

    def run(batches):
        rings = [near_counts(c, min(len(p), ESTIMATE_BITS)) for c, p in zip(counts.value, parts, strict=True)] if counts else None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _values(_rows(batch["fp"], size), parts)
            keys, rows = [], []
            for i, v in enumerate(values):
                keys.append(v | i << shift)
                rows.append(np.arange(len(v)))
            probes = [np.zeros(sum(map(len, keys)), bool)]
            if rings:
                costs = []
                for v, p, ring in zip(values, parts, rings, strict=True):
                    extra = max(0, len(p) - ESTIMATE_BITS)
                    met, steps = np.zeros(len(v)), [np.zeros(len(v))]
                    for r in range(min(MOST_RADIUS, len(p)) + 1):
                        met = met + ring[r][v >> extra] / (1 << extra) * (_ball(len(p), r) / _ball(len(p) - extra, r) if extra else 1)
                        steps.append(met + ROW_COST * _ball(len(p), r))
                    costs.append(np.array(steps))
                units = allot(costs, most + 1)
                for i, (v, p) in enumerate(zip(values, parts, strict=True)):
                    for u in range(1, MOST_RADIUS + 2):
                        own = np.flatnonzero(units[:, i] == u)
                        if len(own):
                            masks = _masks(len(p), u - 1)
                            keys.append((v[own][:, None] ^ masks[None, :]).ravel() | i << shift)
                            rows.append(np.repeat(own, len(masks)))
                probes.append(np.ones(sum(map(len, keys)) - len(probes[0]), bool))
            keys, rows, probes = np.concatenate(keys), np.concatenate(rows), np.concatenate(probes)
            for k in range(0, len(keys), 1 << 17):
                s = slice(k, k + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(keys[s].astype(np.int32)), pa.array(probes[s]), batch["fp"].take(pa.array(rows[s]))], schema=schema)

    return fps.mapInArrow(run, "key int, probe boolean, fp binary")


def hamming_links(fps: DataFrame, most: int, size: int, parts_wanted: int | None = None) -> DataFrame:
    """fps (fp: distinct, size bytes) to star edges (a, b) that connect whatever fingerprints within most bits
    connect. Exact at every size: a bucket with many indexed values is compared in square blocks of HEAVY, each a
    task of its own."""
    spark = fps.sparkSession
    n, bits = fps.count(), 8 * size
    parts = parts_wanted or choose_partitions(n, bits, most)

    def count_pairs(batches):
        total = np.zeros((bits, bits), np.int64)
        for batch in batches:
            x = np.unpackbits(_rows(batch["fp"], size), axis=1).astype(np.float32)
            total += (x.T @ x).astype(np.int64)
        i = np.arange(bits * bits)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(total.ravel())], names=["i", "n"])

    together = np.zeros(bits * bits, np.int64)
    for row in fps.mapInArrow(count_pairs, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # bits squared rows
        together[row.i] = row.n
    groups = group_bits(together.reshape(bits, bits), n, parts)
    shift = max(map(len, groups))
    # how often each value (its first bits, if it has more) is indexed: at most 2^16 counts a partition
    indexed = _entries(fps, groups, None, most, size)
    extra = [max(0, len(p) - ESTIMATE_BITS) for p in groups]
    part = F.shiftright("key", shift)
    shorter = F.element_at(F.array(*[F.lit(1 << x) for x in extra]), part + 1)
    value = F.floor(F.col("key").bitwiseAND(F.lit((1 << shift) - 1)) / shorter).cast("int")
    seen = indexed.groupBy(part.alias("part"), value.alias("v")).count().collect()
    counts = [np.zeros(1 << min(len(p), ESTIMATE_BITS)) for p in groups]
    for row in seen:
        counts[row.part][row.v] = row["count"]
    entries = _entries(fps, groups, spark.sparkContext.broadcast(counts), most, size)
    heavy = cut(indexed.groupBy("key").count().filter(F.col("count") > HEAVY).select("key", F.ceil(F.col("count") / HEAVY).cast("int").alias("blocks")), "heavy")
    if heavy.isEmpty():
        dealt = entries.withColumns({"i": F.lit(0), "j": F.lit(0)})
    else:
        own = (F.pmod(F.xxhash64("fp"), F.col("blocks"))).cast("int")
        each = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = entries.join(heavy, "key", "left").withColumns({"own": F.coalesce(own, F.lit(0)), "other": each})
        dealt = dealt.select("key", "probe", "fp", F.when(F.col("probe"), F.col("other")).otherwise(F.col("own")).alias("i"), F.when(F.col("probe"), F.col("own")).otherwise(F.col("other")).alias("j"))
    dealt = dealt.repartition(4 * tasks(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j", "probe")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def verify(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            yield from settle(table, last=False)
            held = rest[0]
        if held is not None:
            yield from settle(held, last=True)

    rest = [None]

    def settle(table, last):
        """Edges of the groups in a sorted table; what may go on in the next batch is left in rest."""
        key = np.stack([table[c].to_numpy().astype(np.int64) for c in ("key", "i", "j")])
        starts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [table.num_rows]])
        done = len(starts) - (1 if last else 2)
        rest[0] = None if last else table.slice(starts[-2])
        if done <= 0:
            return
        fp = _rows(table["fp"].slice(0, starts[done]), size)
        probe = table["probe"].slice(0, starts[done]).to_numpy()
        first_probe = np.concatenate([[0], np.cumsum(~probe)])
        out_a, out_b = [], []
        for s, e in zip(starts[:done].tolist(), starts[1 : done + 1].tolist(), strict=True):
            m = s + int(first_probe[e] - first_probe[s])
            if s < m < e:
                a, b = links_in(fp[s:m], fp[m:e], most)
                out_a.append(a)
                out_b.append(b)
        if out_a and sum(map(len, out_a)):
            yield pa.RecordBatch.from_arrays([pa.array(map(bytes, np.concatenate(x)), pa.binary()) for x in (out_a, out_b)], schema=schema)

    return dealt.mapInArrow(verify, "a binary, b binary")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, lanes: int = 1, most: int = 4) -> DataFrame:
    """One row per row of df: id_col, fingerprint (hexadecimal), component_id (the smallest id reachable over
    fingerprints that differ in most bits or fewer; its own included).

    Equal fingerprints always link. A null text counts as empty; texts without words have fingerprint zero and
    link like any other. Null ids take part but are never the smallest, unless a whole component has none;
    repeated rows are kept; an empty table gives an empty result."""
    size = 8 * lanes
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    ids = base.select("id").limit(0).toArrow().schema.field("id").type
    schema = f"id {base.schema['id'].dataType.simpleString()}, fp binary"

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py(), width, lanes) for t in batch["t"]]
            yield pa.RecordBatch.from_arrays([batch["id"].cast(ids), pa.array(fps, pa.binary())], names=["id", "fp"])

    docs = cut(base.mapInArrow(run, schema), "simhash")
    fps = cut(docs.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = components(hamming_links(fps.select("fp"), most, size))
    found = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    found = cut(found, "simhash-roots")
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = found.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    out = docs.join(by_fp, F.col("fp") == F.col("_fp"), "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
