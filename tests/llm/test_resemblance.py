"""The near stage of the pipeline beside brute force."""

import random

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k=5):
    w = text.split()
    return frozenset(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def resemblance(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, words, kind, share):
    """A copy with a share of its words cut off, appended, replaced in one block or replaced here and there."""
    n, k = len(words), round(len(words) * share)
    if kind == "cut":
        return words[: n - k]
    if kind == "appended":
        return words + prose(rng, k)
    at = rng.randrange(n - k)
    if kind == "block":
        return words[:at] + prose(rng, k // 2) + words[at + k // 2 :]
    spoilt = set(rng.sample(range(n), max(1, k // 8)))
    return [f"e{rng.randrange(5000)}" if i in spoilt else w for i, w in enumerate(words)]


def kept(spark, texts):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    return {r.doc_id for r in corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), "").collect()}


def wanted(texts):
    """The least of each component of links of 0.8 or more."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i for i in range(len(texts)) if find(i) == i}


def test_no_copy_is_lost_by_kind_of_edit(spark):
    rng, texts = random.Random(3), []
    for kind in ("cut", "appended", "block", "scattered"):
        for _ in range(40):
            words = prose(rng, rng.randrange(60, 400))
            texts += [" ".join(words), " ".join(edited(rng, words, kind, rng.uniform(0.08, 0.19)))]
    near = [i for i in range(1, len(texts), 2) if resemblance(texts[i - 1], texts[i]) >= 0.8]
    assert len(near) > 100
    assert not kept(spark, texts) & set(near)


@pytest.mark.parametrize("share", [0.0, 0.5])
def test_components_as_by_brute_force(spark, share):
    """Chains of edits, where ends are unlike though each step is not, with a passage that many texts have."""
    rng, texts = random.Random(7), []
    passage = prose(rng, 30)
    for _ in range(30):
        words = prose(rng, rng.randrange(5, 120)) + (passage if rng.random() < share else [])
        for _ in range(rng.randrange(1, 7)):
            texts.append(" ".join(words))
            words = edited(rng, words, rng.choice(["cut", "appended", "block", "scattered"]), rng.uniform(0.02, 0.2)) if len(words) > 8 else [*words, "x"]
    rng.shuffle(texts)
    assert kept(spark, texts) == wanted(texts)
