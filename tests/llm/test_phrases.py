"""Phrases beside a plain count in Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from luminal.llm import phrases
from luminal.llm.phrases import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, most=3, least=10, keep=2000, share=50):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            counts[lang].update(tuple(ws[i : i + k]) for k in range(1, most + 1) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in counts.items():
        good = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in good.items():
            for sub in {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)} - {p}:
                inside[sub] = max(inside[sub], a)
        found = []
        for p, a in good.items():
            if p in inside and 100 * inside[p] >= share * a:
                continue
            score, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:keep])]
    return sorted(out)


def got(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def texts():
    rng = random.Random(11)
    words = ["the", "The", "of", "a b", "É", "é", "x\x1cy", "quick", "Brown", "fox", "new", "york", "city"]
    rows = [(rng.choice(["en", "de", None, "", "und"]), "".join(rng.choice(words) + rng.choice(" \t  ,.;:!?\n\r\x0b   ") for _ in range(rng.randrange(60)))) for _ in range(300)]
    return rows + rows[:40] + [("en", None), (None, None), ("en", ""), ("en", " \t "), ("en", "new york city " * 400), ("fr", "seul")]


SCHEMA = "lang string, text string, word string, n int, block long, phrase string"


@pytest.mark.parametrize("most", [3, 4])
def test_same_as_brute_force(spark, most):
    rows = texts()
    df = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)
    assert got(collocations(df, most=most)) == brute(rows, most)


def test_small_blocks_cut_long_pieces(spark, monkeypatch):
    rows = texts()
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 7)
    monkeypatch.setattr(phrases, "HOME_PHRASES", 2)
    assert got(collocations(spark.createDataFrame(rows, "lang string, text string"))) == brute(rows)


def test_one_common_piece_and_ties(spark):
    rows = [("en", "all alike")] * 3000 + [("en", f"t{i % 30} u{i % 30}") for i in range(600)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert got(collocations(df, keep=20)) == brute(rows, keep=20)


def test_products_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**13 - 1, 10**13 + 7, 10**13 + 11)], "n long, l1 long, r1 long").select(phrases._score(2).alias("best")).first().best
    assert row.score == 10**6 * (10**13 - 1) ** 2 // ((10**13 + 7) * (10**13 + 11))


def test_empty_tables(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations(spark.createDataFrame([(None, None)], "lang string, text string")).count() == 0
