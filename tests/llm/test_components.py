"""Components beside brute force, and how large the plans of the near stage are that the driver holds."""

import random

import pytest
from luminal.llm import components, resemblance

SF = "/root/testdata/sf0.001"


def roots(edges):
    """Node to the least node that it reaches."""
    least = {n: n for e in edges for n in e}
    while True:
        was = dict(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if was == least:
            return {n: r for n, r in least.items() if n != r}


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture
def written(monkeypatch):
    """(label, shuffles in the plan) of all that components and resemblance write."""
    seen = []
    for module in (components, resemblance):
        monkeypatch.setattr(module, "cut", lambda df, label, put=module.cut: (seen.append((label, shuffles(df))), put(df, label))[1])
    return seen


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (7, 7)], [(5, 1), (5, 2), (6, 2), (1, 5), (5, 1)], [(i, (i * 7) % 60) for i in range(1, 60)], [tuple(random.Random(i).sample(range(150), 2)) for i in range(90)], [(3, 3)]])
def test_as_by_brute_force(spark, edges):
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == roots(edges) and len(got) == len(roots(edges))


def test_stars_take_no_round(spark, written):
    stars = spark.createDataFrame([(3, 1), (2, 1), (9, 7), (7, 8), (1, 3)], "a long, b long").filter("b <> 8")
    assert {(r.node, r.root) for r in components.components(stars).collect()} == {(3, 1), (2, 1), (9, 7)}
    assert len(written) == 1


def test_plans_of_the_near_stage_are_small(spark, written):
    """Spark keeps a thread for a minute for each exchange and broadcast, and the driver's memory follows the largest plan."""
    resemblance.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).count()
    assert {"near-simhash", "near-beside", "edges"} <= {label for label, _ in written}
    assert max(n for _, n in written) <= 14 and sum(n for _, n in written) <= 90, sorted(written, key=lambda x: -x[1])
