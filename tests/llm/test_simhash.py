import random

import numpy as np
import pytest
import xxhash

from luminal.llm import simhash


def brute_fp(text, width):
    words = (text or "").translate({c: chr(c + 32) for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    parts = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    bits = [sum(xxhash.xxh64_intdigest(p.encode(), 42) >> b & 1 for p in parts) * 2 > len(parts) for b in range(64)]
    return sum(1 << i for i, b in enumerate(bits) if b) if parts else 0


def brute_components(fps, most):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(fps)
    for a in ids:
        for b in ids:
            if bin(fps[a] ^ fps[b]).count("1") <= most:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def corpus():
    rng = random.Random(5)
    out = []
    for i in range(30):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 90))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = "Edit"
            out.append(" ".join(copy))
    return out + [None, "", " \t ", "one", "ONE", "é É ab", "x " * 20_000]


@pytest.mark.parametrize("heavy", [4096, 3])
def test_against_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    data = list(enumerate(corpus()))
    df = spark.createDataFrame([(*r, "q") for r in data], "doc_id long, text string, fp string").repartition(5)
    fps = {i: brute_fp(t, 4) for i, t in data}
    want = brute_components(fps, 4)
    got = simhash.near_duplicates(df).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize(("lanes", "most", "parts"), [(1, 4, 3), (1, 4, 4), (1, 7, 4), (1, 12, 8), (2, 25, 16)])
def test_no_link_is_lost(spark, lanes, most, parts):
    """Random fingerprints around a few centres, many at just the allowed distance."""
    rng = np.random.default_rng(1)
    bits, rows = 64 * lanes, []
    for _ in range(12):
        centre = rng.integers(0, 2, bits)
        for _ in range(15):
            x = centre.copy()
            x[rng.choice(bits, rng.integers(0, most + 1), replace=False)] ^= 1
            rows.append(np.packbits(x.astype(np.uint8)).tobytes())
    fps = {int.from_bytes(r, "big"): int.from_bytes(r, "big") for r in rows}
    want = brute_components(fps, most)
    df = spark.createDataFrame([(bytearray(i.to_bytes(bits // 8, "big")),) for i in fps], "fp binary")
    roots = simhash.components(simhash.hamming_links(df, most, bits // 8, parts)).collect()
    got = {i: i for i in fps} | {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in roots}
    assert got == want


def test_allot_is_cheapest():
    rng = np.random.default_rng(0)
    costs = [np.cumsum(rng.random((4, 20)), axis=0) for _ in range(3)]
    units = simhash.allot(costs, 5)
    for k in range(20):
        options = [(a, b, 5 - a - b) for a in range(4) for b in range(4) if 0 <= 5 - a - b < 4]
        best = min(sum(costs[i][u, k] for i, u in enumerate(o)) for o in options)
        assert units[k].sum() == 5 and sum(costs[i][u, k] for i, u in enumerate(units[k])) == pytest.approx(best)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, "zz yy xx ww vv")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(df).collect()) == [("1", "1"), ("1", "1"), ("None", "1"), ("None", "None")]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
