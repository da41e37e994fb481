"""Every query beside its SQL, and those without SQL by their invariants."""

import pytest

from luminal import plans
from tests.oracle import FOLDER, differences, rows_of


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert differences(spark, plans.QUERIES[name], plans.ORACLE_SQL[name]) == ""


def test_stream_alerts_are_the_tables(spark):
    _, stream = rows_of(plans.QUERIES["stream_alerts"](spark, FOLDER).select("key", "event"))
    _, table = rows_of(plans.QUERIES["alerts_edge"](spark, FOLDER).selectExpr("cast(user_id as string) key", "event"))
    assert stream == table


def test_stream_buffers_hold_the_last(spark):
    rows = plans.QUERIES["stream_buffers"](spark, FOLDER).collect()
    assert rows and all(r.n <= 5 for r in rows)


def test_kmeans_covers_all(spark):
    rows = plans.QUERIES["kmeans_sizes"](spark, FOLDER).collect()
    assert len(rows) == 5 and sum(r.n for r in rows) == spark.read.parquet(f"{FOLDER}/embeddings.parquet").count()


@pytest.mark.parametrize("name", ["layout_scatter", "layout_palace", "force_positions"])
def test_seeded_layouts_agree(spark, name):
    a, b = (rows_of(plans.QUERIES[name](spark, FOLDER)) for _ in range(2))
    assert a[0] == ["id", "x", "y", "z"] and len(a[1]) == len(b[1])
    assert all(x[0] == y[0] and abs(x[1] - y[1]) < 1e-3 for x, y in zip(a[1], b[1], strict=True))


def test_force_positions_places_every_customer(spark):
    rows = plans.QUERIES["force_positions"](spark, FOLDER).collect()
    assert sorted(r.id for r in rows) == sorted(r.c_custkey for r in spark.read.parquet(f"{FOLDER}/customer.parquet").select("c_custkey").collect())
