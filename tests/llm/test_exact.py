import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from luminal.llm import golomb
from luminal.llm.exact import exact_duplicates


@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=60))
def test_golomb_round_trip(values):
    a = np.array(sorted(values), np.uint64)
    assert (golomb.decode(golomb.encode(a)) == a).all()


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return sorted((str(i), str(best[t or ""]), len(groups[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def test_against_brute_force(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"text {i % 40}") for i in range(200)]
    rows += [(900, None), (901, ""), (902, "é" * 50_000), (903, "é" * 50_000), (904, "Copy"), (None, "copy"), (None, "lone"), (905, "twice"), (905, "twice")]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, h long, keep_id string")
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_duplicates(df).collect())
    assert got == brute(rows)


def test_empty(spark):
    assert exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
