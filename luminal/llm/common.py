"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from luminal.operators.common import cut, shared_dir  # noqa: F401

#: ASCII white space; words are what stands between it.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, null counting as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def tasks(spark: SparkSession) -> int:
    """Partitions to deal work out to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
