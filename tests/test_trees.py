"""Trees beside plain walks over them."""

import random

import pytest

from luminal.operators import common, trees


def plain_tidy(rows, block, gap=1.0, apart=2.0):
    """Positions of (id, parent) rows: recursive, the same blocks of siblings."""
    ids = {i for i, _ in rows}
    kids = {}
    for i, p in rows:
        kids.setdefault(p if p in ids else None, []).append(i)

    def pack(parts):
        """parts: (left, right, span). Offsets, and the parts as one."""
        left, right, span, offsets = [], [], 0.0, []
        for l, r, s in parts:
            shift = max((a - b + (apart if d else gap) for d, (a, b) in enumerate(zip(right, l))), default=0.0)
            left += [v + shift for v in l[len(left) :]]
            right = [v + shift for v in r] + right[len(r) :]
            span = shift + s
            offsets.append(shift)
        return offsets, (left, right, span)

    out = {}

    def children(node):
        own = sorted(kids.get(node, []))
        moved = [0.0] * len(own)
        parts, groups = [shape(k) for k in own], [[k] for k in range(len(own))]
        while True:
            packed, joined = [], []
            for k in range(0, len(parts), block):
                offsets, whole = pack(parts[k : k + block])
                for o, g in zip(offsets, groups[k : k + block]):
                    for j in g:
                        moved[j] += o
                packed.append(whole)
                joined.append([j for g in groups[k : k + block] for j in g])
            parts, groups = packed, joined
            if len(parts) <= 1:
                break
        left, right, span = parts[0] if parts else ([], [], 0.0)
        for k, i in enumerate(own):
            out[i] = moved[k] - span / 2
        return [v - span / 2 for v in left], [v - span / 2 for v in right]

    def shape(node):
        left, right = children(node)
        return [0.0, *left], [0.0, *right], 0.0

    children(None)
    placed = {}

    def place(node, x, depth):
        for k in kids.get(node, []):
            placed[k] = (depth, x + out[k])
            place(k, x + out[k], depth + 1)

    place(None, 0.0, 0)
    return placed


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, parent long")


def near_enough(got, want):
    assert set(got) == set(want)
    for k in want:
        assert got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6, (k, got[k], want[k])


def no_overlap(placed, gap):
    levels = {}
    for depth, x in placed.values():
        levels.setdefault(depth, []).append(x)
    for xs in levels.values():
        xs.sort()
        assert all(b - a >= gap - 1e-6 for a, b in zip(xs, xs[1:]))


@pytest.mark.parametrize("block", [5])
def test_tidy_as_plain(spark, monkeypatch, block):
    monkeypatch.setattr(trees, "BLOCK", block)
    rng = random.Random(block)
    rows = [(0, None), (500, None), (501, 9999)] + [(i, rng.choice([0, rng.randrange(i), max(0, i - 2)])) for i in range(1, 120)] + [(600, 601), (601, 600), (602, 600)]
    want = plain_tidy([r for r in rows if r[0] < 600], block)
    got = {r.id: (r.depth, r.x) for r in trees.tidy_tree(frame(spark, rows + [(7, dict(rows)[7])])).collect()}
    near_enough(got, want)
    no_overlap(got, 1.0)


def test_tidy_of_many_rows_and_one_hot_parent(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 1000)
    n = 100_000
    rows = [(0, None)] + [(i, 0 if i % 3 == 0 or i < 3 else i // 5) for i in range(1, n)]
    got = {r.id: (r.depth, r.x) for r in trees.tidy_tree(frame(spark, rows)).collect()}
    assert len(got) == n
    no_overlap(got, 1.0)
    near_enough(got, plain_tidy(rows, trees.BLOCK))


def test_tidy_order_size_and_odd_rows(spark):
    rows = [(1, None, 0, "a"), (2, 1, 9, "b"), (3, 1, None, "c"), (4, 1, 5, "d"), (None, 1, 1, "e")]
    out = {r.id: r for r in trees.tidy_tree(spark.createDataFrame(rows, "id long, parent long, place int, x string"), order="place", size=(12.0, 6.0), level=0.5).collect()}
    assert [k for k in sorted((k for k in out if k != 1), key=lambda k: out[k].x)] == [3, 4, 2]
    assert [round(out[k].x, 6) for k in (3, 4, 2, 1)] == [2.0, 6.0, 10.0, 6.0] and out[2].y == 0.5 and out[2].z == 6.0 and out[1].z == 0.0
    assert trees.tidy_tree(frame(spark, []), size=(1.0, 1.0)).count() == 0
    one = trees.tidy_tree(frame(spark, [(5, None)]), size=(10.0, 10.0)).collect()
    assert [(r.id, r.depth, r.x, r.z) for r in one] == [(5, 0, 5.0, 0.0)]


def test_path_sums_of_deep_trees_cycles_and_repeats(spark):
    n = 3000
    rows = [(0, None, 1)] + [(i, i - 1, 1) for i in range(1, n)] + [(-1, -2, 1), (-2, -3, 1), (-3, -1, 1), (-4, -1, 1), (n, n - 1, 5), (n, n - 1, 5), (None, 3, 1)]
    out = trees.path_sums(spark.createDataFrame(rows, "_id long, _parent long, v long")).collect()
    by_id = sorted((r._id, r._root, r.v) for r in out if r._id is not None)
    assert by_id == [(i, 0, i + 1) for i in range(n)] + [(n, 0, n + 5)] * 2
    assert [(r._root, r.v) for r in out if r._id is None] == [(0, 5)]


def test_ranked_and_join_hot(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 1)
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    rows = [(1 if i % 3 else i, i) for i in range(300)] + [(None, 900), (None, 901)]
    df = spark.createDataFrame(rows, "g long, v long")
    got = sorted(tuple(r) for r in common.ranked(df, ["g"], "v", count="of").select("v", "rank", "of").collect())
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    assert got == sorted((v, k, len(vs)) for vs in groups.values() for k, v in enumerate(sorted(vs)))
    right = spark.createDataFrame([(1, "one"), (3, "three")], "g long, name string")
    for how in ("inner", "left"):
        assert sorted(map(tuple, common.join_hot(df, right, ["g"], how).collect()), key=repr) == sorted(map(tuple, df.join(right, "g", how).collect()), key=repr)
