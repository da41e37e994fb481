"""Near-dedup of texts by SimHash candidates, made whole by an exact join of shingle sets.

Links found by SimHash (64 bits, generalised pigeonhole) are kept if the shingle sets themselves resemble each other
by 0.8. SimHash cannot find all such pairs within any radius that can be probed, so the rest is found by prefixes: in
any one order of shingles, sets of a resemblance of 0.8 or more share one of their first n // 5 + 1. The order is rare
shingles first, by exact counts over the whole corpus, which blocks and owners of hash ranges exchange as Golomb-coded
runs. Shingles that stand in one text alone come first and need no partner, so only texts with four fifths of shared
shingles have anything left to look up.

Texts that share such a shingle are held against the one of them with the fewest shingles of its own, and against a few
drawn by hash, in a few rounds: members of a large group of copies come together without meeting each other. What is
still apart then is compared pair by pair, so that no link is lost."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from luminal.llm import golomb
from luminal.llm.common import cut, tasks
from luminal.llm.components import components
from luminal.llm.exact import owner_of
from luminal.llm.simhash import hamming_links, simhash_of

SEED = 42
BLOCK_SHINGLES = 1 << 20  # a block's mean
MESSAGE_HASHES = 500  # mean hashes in one message from a block to an owner
SPARE_BITS = 12  # of a hash beyond those that number all shingles; fewer only blur the order
CELL = 4  # texts of a shingle that meet by chance in a round
SLICE = 256  # texts of a shingle that one task holds against the best of them
ROUNDS = 2  # before what is still apart is compared pair by pair: they decide the cost, never the links


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted different hashes of the shingles of width words (all words if fewer; none if there are none)."""
    found = (text or "").encode().lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in found), np.int64, len(found)))
    n = max(1, len(found) - width + 1)
    starts, stops = [0, *ends[: n - 1].tolist()], (ends[-n:] - 1).tolist()
    raw = b"".join([xxhash.xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)])
    return np.unique(np.frombuffer(raw, ">u8").astype(np.uint64))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets share four fifths or more of all that is in them; empty ones are alike."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * shared >= 4 * (len(a) + len(b) - shared)


def prefix(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The first n // 5 + 1 of a set, by class of frequency and then by hash, that other texts may have (class > 0)."""
    first = np.lexsort((hashes, classes))[: len(hashes) // 5 + 1]
    return hashes[first[classes[first] > 0]]


def _node(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes(), SEED)


def _digests(base: DataFrame, width: int) -> DataFrame:
    """base (id, t) to (id, node, fp, n): what stands for the set, its SimHash and its size."""
    ids = base.select("id").limit(0).toArrow().schema.field("id").type

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), width) for t in batch["t"]]
            columns = [batch["id"].cast(ids), pa.array(map(_node, sets), pa.binary()), pa.array(map(simhash_of, sets), pa.binary()), pa.array(map(len, sets), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "node", "fp", "n"])

    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, node binary, fp binary, n long")


def shared_prefixes(texts: DataFrame, shingles: int, width: int) -> DataFrame:
    """texts (t: distinct), with about so many shingles in all, to (node, n, m, keys, t): a row for each text of which
    others may have a shingle of the prefix; m: how many of its n shingles others have."""
    blocks, owners = max(1, math.ceil(shingles / BLOCK_SHINGLES)), max(1, math.ceil(math.sqrt(shingles / MESSAGE_HASHES)))
    shift = np.uint64(max(0, 64 - SPARE_BITS - max(1, shingles).bit_length()))
    docs = texts.withColumn("block", F.pmod(F.xxhash64("t", F.lit(7)), F.lit(blocks))).repartition(tasks(texts.sparkSession), "block")

    def dealt(table: pa.Table):
        """The block's sets, the distinct hashes of all of them, cut short, with counts, and each owner's slice."""
        sets = [shingle_set(t, width) for t in table["t"].to_pylist()]
        values, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]) >> shift, return_counts=True)
        owner = owner_of(values << shift, owners)
        cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(values) else np.zeros(0, np.int64)
        return sets, values, counts, [(int(owner[a]), slice(a, b)) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(values)], strict=True)]

    def ask(table: pa.Table) -> pa.Table:
        _, values, counts, slices = dealt(table)
        messages = [golomb.encode(values[s]) for _, s in slices]
        often = [zstandard.compress(np.minimum(counts[s], 255).astype(np.uint8).tobytes(), 1) for _, s in slices]
        block = pa.array([table["block"][0].as_py()] * len(slices), pa.int64())
        return pa.table({"block": block, "owner": pa.array([o for o, _ in slices], pa.int64()), "message": pa.array(messages, pa.binary()), "counts": pa.array(often, pa.binary())})

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each hash of each message its class of frequency over all blocks; 0 if it stands in one text alone."""
        runs = [golomb.decode(m) for m in pdf["message"]]
        counts = [np.frombuffer(zstandard.decompress(c), np.uint8) for c in pdf["counts"]]
        _, at = np.unique(np.concatenate(runs), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts))
        classes = np.where(total > 1, 1 + np.floor(4 * np.log2(np.maximum(total, 1))), 0).clip(0, 255).astype(np.uint8)
        parts = np.split(classes[at], np.cumsum([len(r) for r in runs])[:-1])
        return pd.DataFrame({"block": pdf["block"], "owner": pdf["owner"], "classes": [zstandard.compress(p.tobytes(), 3) for p in parts]})

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            sets, values, _, slices = dealt(left)
            told = dict(zip(right["owner"].to_pylist(), right["classes"].to_pylist(), strict=True))
            classes = np.zeros(len(values), np.uint8)
            for o, s in slices:
                classes[s] = np.frombuffer(zstandard.decompress(told[o]), np.uint8)
            for own, t in zip(sets, left["t"].to_pylist(), strict=True):
                c = classes[np.searchsorted(values, own >> shift)]
                first = prefix(own, c)
                if len(first):
                    rows.append((_node(own), len(own), int((c > 0).sum()), first.view(np.int64), t))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.string())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["node", "n", "m", "keys", "t"])

    asked = docs.groupBy("block").applyInArrow(ask, "block long, owner long, message binary, counts binary")
    answered = asked.groupBy("owner").applyInPandas(answer, "block long, owner long, classes binary")
    return docs.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(keep, "node binary, n int, m int, keys array<bigint>, t string")


def _may(a: str, b: str) -> Column:
    """Whether two texts may share enough: from the shared shingle on (i: its place), of what others have at all (m),
    and by their sizes. For the first shingle that they share this holds whenever they are alike."""
    most = F.least(*[F.col(f"{x}.n") - F.col(f"{x}.i") for x in (a, b)], F.col(f"{a}.m"), F.col(f"{b}.m"))
    return 9 * most >= 4 * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    ends = [f(f"{a}.node", f"{b}.node").alias(name) for f, name in ((F.greatest, "a"), (F.least, "b"))]
    return rows.filter((F.col(f"{a}.node") != F.col(f"{b}.node")) & _may(a, b)).select(*ends)


def _linked(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Those of pairs (a, b) whose texts are alike."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")

    def run(batches):
        known = lru_cache(64)(lambda t: shingle_set(t, width))
        for batch in batches:
            keep = [alike(known(a.as_py()), known(b.as_py())) for a, b in zip(batch["ta"], batch["tb"], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def _by_simhash(nodes: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp) that SimHash proposes."""
    of_fp = cut(nodes.groupBy("fp").agg(F.min("node").alias("first")), "near-fps")
    equal = nodes.join(of_fp, "fp").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = hamming_links(of_fp.select("fp"), most, 8)
    name = lambda c: of_fp.select(F.col("fp").alias(c), F.col("first").alias(f"node_{c}"))
    near = near.join(name("a"), "a").join(name("b"), "b").select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b"))
    return equal.union(near)


def _apart(entries: DataFrame, roots: DataFrame | None) -> DataFrame:
    """entries (key, one) with their root, of the keys whose texts are not all joined yet."""
    if roots is None:
        placed = entries.withColumn("root", F.col("one.node"))
    else:
        roots = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        placed = entries.join(roots, F.col("one.node") == F.col("_node"), "left").select("key", "one", F.coalesce("_root", "one.node").alias("root"))
    open_ = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("k")).filter("low <> high")
    return cut(placed.join(open_.select("key", "k"), "key"), "near-apart")


def _met(placed: DataFrame, round_: int) -> DataFrame:
    """Pairs (a, b) of a round: each text with the best of its key's texts (the one with the least of its own), those of
    the best one's component with the best beyond it, and each with the best of a few drawn by hash. A shingle's texts are
    joined to their best in slices, and what is told of a shingle goes to each of its slices. Texts beside their best are
    written once: three parts read them, and each would hold their exchanges again in a plan that the driver keeps."""
    slices = F.ceil(F.col("k") / SLICE)
    placed = placed.withColumn("slice", F.pmod(F.xxhash64("one.node", F.lit("slice")), slices))
    to_slices = lambda of_key: of_key.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1))).drop("k")
    best = placed.groupBy("key", "k").agg(F.max(F.struct("one", "root")).alias("best"))
    beside = cut(placed.join(to_slices(best), ["key", "slice"]), "near-beside")
    second = to_slices(beside.filter("root <> best.root").groupBy("key", "k").agg(F.max("one").alias("two")))
    cell = F.pmod(F.xxhash64("one.node", F.lit(round_)), F.ceil(F.col("k") / CELL))
    dealt = placed.withColumn("cell", cell)
    drawn = dealt.groupBy("key", "cell").agg(F.max(F.struct("one", "root")).alias("best"))
    near = lambda rows: _pairs(rows.filter("root <> best.root").withColumn("two", F.col("best.one")), "one", "two")
    return near(beside).union(_pairs(beside.filter("root = best.root").join(second, ["key", "slice"]), "one", "two")).union(near(dealt.join(drawn, ["key", "cell"]))).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, most: int = 6) -> DataFrame:
    """One row per row of df: id_col and component_id, the smallest id reachable over texts of which each two have a
    resemblance (shared shingles of width words over all their shingles) of 0.8 or more; its own included. most is the
    radius of the SimHash candidates, which decides how many are found early and never which links there are.

    A null text counts as empty, and texts without words are alike. Null ids take part but are never the smallest,
    unless a whole component has none; repeated rows are kept; an empty table gives an empty result."""
    base = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    docs = cut(_digests(base, width), "near-docs")
    nodes = cut(docs.groupBy("node").agg(F.min("id").alias("least"), F.min("fp").alias("fp"), F.min("n").alias("n")), "near-nodes")
    shingles = nodes.agg(F.sum("n")).first()[0] or 0
    texts = cut(shared_prefixes(base.select("t").distinct(), shingles, width).dropDuplicates(["node"]), "near-texts")
    place = F.struct((F.col("m") / F.col("n")).alias("share"), "node", "n", "m", (F.col("n") - F.col("m") + F.col("p")).alias("i"))
    entries = cut(texts.select("node", "n", "m", F.posexplode("keys").alias("p", "key")).select("key", place.alias("one")), "near-keys")
    links, roots, tried = None, None, None
    for round_ in range(ROUNDS):
        pairs = _met(_apart(entries, roots), round_)
        pairs = cut(pairs.union(cut(_by_simhash(nodes, most), "near-simhash")).distinct() if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "near-pairs")
        tried = pairs if tried is None else tried.union(pairs)
        found = _linked(pairs, texts, width)
        links = found if links is None else links.union(found)
        roots = components(links)
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    # texts that share a shingle and are still apart
    placed = _apart(entries, roots)
    other = placed.select("key", F.col("one").alias("two"), F.col("root").alias("root2"))
    rest = _pairs(placed.join(other, "key").filter("root < root2"), "one", "two").distinct().join(tried, ["a", "b"], "left_anti")
    roots = components(links.union(_linked(cut(rest, "near-rest"), texts, width))).toDF("_node", "root")
    placed = cut(nodes.join(roots, F.col("node") == F.col("_node"), "left").select("node", "least", F.coalesce("root", "node").alias("root")), "near-roots")
    by_node = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(F.col("node").alias("_node"), "component_id")
    return docs.join(by_node, F.col("node") == F.col("_node"), "left").select(F.col("id").alias(id_col), "component_id")
