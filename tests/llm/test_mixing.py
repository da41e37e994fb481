import math

import pytest

from luminal.llm import mixing


def fill(sizes, weights, cap=3.0):
    """Round by round: deal what is left by weight among those below their caps."""
    got, left, free = dict.fromkeys(sizes, 0.0), float(sum(sizes.values())), set(sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes))}
    while free and left > 1e-9:
        share, moved = sum(w[s] for s in free), 0.0
        for s in list(free):
            add = min(left * w[s] / share, cap * sizes[s] - got[s])
            got[s] += add
            moved += add
            if cap * sizes[s] - got[s] < 1e-9:
                free.discard(s)
        left -= moved
    return got


def test_targets_and_copies(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 50)
    rows = [(i, " ".join(["w"] * (i % 37 + 1)), "abcdefgh"[int(math.sqrt(i % 50))]) for i in range(3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    out = mixing.mix(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, source = fill(sizes, (5, 2, 1)), {i: s for i, _, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r.copies in (math.floor(r.target / r.source_size - 1e-9), math.ceil(r.target / r.source_size + 1e-9), round(r.target / r.source_size))
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 37 * 6
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(df.repartition(5)).collect()))


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "x y", None), (3, "x y", None), (None, "z", "a"), (4, "\tq q ", "b")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r.size for r in out) == [0, 0, 1, 1, 2, 2]
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_offsets_in_parts_and_long_texts(spark, monkeypatch):
    """Offsets are the same however many cells a part has; null ids are told apart by their texts."""
    rows = [(i if i % 3 else None, f"t{i} " * (i % 5 + 1), "ab"[i % 2]) for i in range(900)] + [(5000, "w " * 400_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "CELL_ROWS", 5)
    whole = sorted(map(tuple, mixing.mix(df).collect()), key=repr)
    monkeypatch.setattr(mixing, "PART_CELLS", 2)
    assert sorted(map(tuple, mixing.mix(df).collect()), key=repr) == whole
    monkeypatch.setattr(mixing, "SMALL", 0)
    assert sorted(map(tuple, mixing.mix(df).collect()), key=repr) == whole
    assert [r[1] for r in whole if r[0] == 5000] == [400_000]
