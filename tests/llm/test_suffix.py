import random

import numpy as np

from luminal.llm import suffix


def brute(rows, length):
    first = {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    texts = [(t or "").encode() for _, t in rows]
    place = lambda i, p: (rows[i][0] is None, rows[i][0] or 0, p)
    for i in order:
        for p in range(len(texts[i]) - length + 1):
            s = texts[i][p : p + length]
            first[s] = min(first.get(s, place(i, p)), place(i, p))
    out = []
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < place(i, p):
                gone[p : p + length] = True
        spans = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        out.append((rows[i][0], len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return sorted(out, key=repr)


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh é") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    common, line = text(40), text(12)
    rows = []
    for i in range(120):
        kind, t = i % 6, text(r.randint(0, 90))
        if kind == 1:
            t = t + common + text(5)
        elif kind == 2:
            t = text(3) + line + text(r.randint(1, 30)) + line
        elif kind == 3 and rows:
            t = (r.choice(rows)[1] or "") + text(2)
        elif kind == 4:
            t = "ab " * r.randint(1, 120)
        rows.append((i * 3, t))
    rows += [(1000, None), (1001, ""), (None, common), (5, rows[7][1]), (rows[9][0], rows[9][1]), (-4, common)]
    return rows


def check(spark, rows, length, k):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, block string").repartition(5)
    got = suffix.remove_repeats(df, length=length, k=k).collect()
    return sorted([(g.doc_id, g.n_bytes, g.n_removed, len(g.spans), bytes(g.kept)) for g in got], key=repr)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 3000)
    rows = corpus()
    assert check(spark, rows, 100, 32) == brute(rows, 100)


def test_large_groups_by_hash(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(suffix, "HOT", 20)
    monkeypatch.setattr(suffix, "FEW", 3)
    monkeypatch.setattr(suffix, "CHUNK", 64)
    rows = corpus(4)
    assert check(spark, rows, 24, 8) == brute(rows, 24)


def test_more_ranges_than_partitions(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(suffix, "RANGE_BYTES", 700)
    monkeypatch.setattr(suffix, "MOST_SAMPLE", 200)
    monkeypatch.setattr(suffix, "RARE", 8)
    rows = corpus(6)
    assert check(spark, rows, 24, 8) == brute(rows, 24)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.remove_repeats(df).collect() == []
    assert suffix.remove_repeats(df.union(spark.sql("select 1L, 'short'"))).count() == 1


def test_merge_keeps_prefixes():
    r = random.Random(1)
    for many in (0, 1, 2, 3, 7):
        runs = [sorted(bytes(r.choice(b"ab") for _ in range(10)) for _ in range(r.randint(0, 40))) for _ in range(many)]
        coded = [suffix.front_decode(suffix.front_code(x, 10), 10) for x in runs if x]
        out = list(suffix.merge(coded, 10))
        assert [k for _, _, k in out] == sorted(sum(runs, []))
        for (_, s, b), (_, _, a) in zip(out[1:], out, strict=False):
            assert s == next((i for i in range(10) if a[i] != b[i]), 10)
