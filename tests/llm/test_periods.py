"""Periodic runs beside every stretch of equal words q apart."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from luminal.llm import periods
from luminal.llm.periods import digests, periodic_runs, planted, runs_of, z_function


def brute(ws, least=6, times=4):
    best = {}
    for q in range(1, len(ws) // times + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and j > i:
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b, q) for (a, b), q in best.items())


def by_text(texts):
    flat = np.array([w for t in texts for w in t], np.int64)
    ends = np.cumsum([len(t) for t in texts])
    rows = runs_of(flat, ends).tolist()
    starts = [0, *ends[:-1].tolist()]
    return [[(a - s, b - s, q) for a, b, q in rows if s <= a < e] for s, e in zip(starts, ends.tolist(), strict=False)]


def same(texts):
    assert by_text(texts) == [sorted(brute(t)) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=5))
def test_random_words(texts):
    same(texts)


def test_z_function():
    rng = random.Random(1)
    for _ in range(50):
        v = [rng.randrange(2) for _ in range(rng.randrange(40))]
        assert z_function(v)[1:] == [next((k for k in range(len(v) - i) if v[k] != v[i + k]), len(v) - i) for i in range(1, len(v))]


def test_long_periods_nested_runs_and_fibonacci(monkeypatch):
    rng = random.Random(2)
    a, b = [0], [0, 1]
    while len(b) < 700:
        a, b = b, b + a
    inner = [7] * 9 + list(range(20, 60)) + [1, 2, 3] * 5
    texts = [b, [5] * 500, inner * 7 + inner[:11], [x for k in range(2, 25) for x in [0] * k + [1]], ([0] * 90 + [1]) * 6, [rng.randrange(3) for _ in range(800)]]
    stretch = [rng.randrange(1000) for _ in range(37)]
    texts += [[1, 2, *(stretch * 9)[:300], 4, 4, 4, 4, 4, 4], [], [1] * 5, [1] * 6, [1, 2] * 3, [1, 2] * 4, [1, 1, 1, 1, 1]]
    same(texts)
    monkeypatch.setattr(periods, "FEW", 0)
    monkeypatch.setattr(periods, "OPEN", 2)
    same(texts)


def test_a_long_text_of_one_word_takes_no_square_of_its_length():
    n = 1 << 20
    assert runs_of(np.zeros(n, np.int64), np.array([n])).tolist() == [[0, n, 1]]


def test_fewer_periods_are_refused():
    with pytest.raises(ValueError):
        runs_of(np.zeros(9, np.int64), np.array([9]), times=3)


def test_operator(spark, monkeypatch):
    monkeypatch.setattr(periods, "BATCH_WORDS", 50)
    texts = ["", None, "a a a a a a b", " \t x\x1cy  x\x1cy x\x1cy x\x1cy\nx\x1cy x\x1cy ", "no runs here", "p q p q p q p q p z z z z z z z", "solo", "ü é " * 40]
    rows = [(i, t, 1, "c") for i, t in enumerate(texts)] + [(None, "k k k k k k", 1, "c")] * 2 + [(3, "k", 1, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, words string")
    out = periodic_runs(df).collect()
    want = []
    for i, t, *_ in rows:
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
        found = brute(ws)
        gone = {k for a, b, q in found for k in range(a + q, b)}
        want.append((str(i), len(ws), sorted((a, b - a, q) for a, b, q in found), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    key = lambda x: (x[0], x[3])
    assert sorted(((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out), key=key) == sorted(want, key=key)
    told = {r.doc_id: r for r in digests(periodic_runs(df)).filter("doc_id is not null and doc_id <> 3").collect()}
    assert told[5].n_runs == 2 and (told[5].start, told[5].length, told[5].period, told[5].exponent_milli) == (0, 9, 2, 4500)
    assert told[0].start is None and told[0].exponent_milli is None and told[0].runs_sha256 == hashlib.sha256(b"").hexdigest() and told[1].n_runs == 0
    assert periodic_runs(df.limit(0)).count() == 0


def test_planted_words(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 40))) for i in range(200)] + [(None, "a b")]
    for r in spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text").withColumn("ws", planted(F.col("text"), F.col("doc_id"))).collect():
        own = (r.text or "").split()
        n, h = len(own), zlib.crc32(str(r.doc_id).encode())
        if r.doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            own = [own[a + (i - a) % p] if i >= a else own[i] for i in range(n)]
        assert r.ws == own
