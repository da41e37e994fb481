"""A training corpus from raw documents: five stages, each written as Parquet and read back as the next one's input."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luminal.llm.bpe import decode, encode
from luminal.llm.common import shared_dir, table
from luminal.llm.exact import exact_duplicates
from luminal.llm.mixing import mix
from luminal.llm.quality import fit, score
from luminal.llm.resemblance import near_duplicates


def _packed(docs: DataFrame) -> DataFrame:
    """docs as (row, key): whatever the columns are called, none clashes with the stages' own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("key"))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs but those whose id is in dropped (id); null ids match one another."""
    return _packed(docs).join(dropped.select("id").distinct(), F.col("key").eqNullSafe(F.col("id")), "left_anti").select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores one half or more. It is fitted on labelled rows of this stage's
    own input. Null, empty and very long texts are scored too, repeated rows alike; without labels nothing is dropped."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    rows = score(_packed(docs).withColumn("text", F.col("row").getField("text")), model, score_col="score")
    # exploded rather than filtered: a filter would move below the projection and work every statistic out again
    return rows.select(F.explode(F.when(F.col("score") >= 0.5, F.array("row"))).alias("row")).select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id. Empty and null texts equal one another; texts of any length
    are compared whole. A row that repeats with its doc_id is the same document and stays as it is."""
    return _without(docs, exact_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("id")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles of similarity 0.8 or more link, directly or through others, the one with
    the smallest doc_id: SimHash proposes links, an exact join adds those that it cannot see, and the shingles of whole
    texts decide each. Documents without words link to one another; rows that share the smallest doc_id all stay."""
    return _without(docs, near_duplicates(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("id")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as systematic sampling to the target weights of the sources emits it, which may be
    never. Rows that share a doc_id are emitted as often as the one that is emitted least."""
    copies = mix(docs).groupBy(F.col("doc_id").alias("id")).agg(F.min("copies").cast("int").alias("copies"))
    rows = _packed(docs).join(copies.filter("copies > 0"), F.col("key").eqNullSafe(F.col("id")))
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded_sha256, of the bytes that the ids decode to: a
    row for each row of docs, repeated ones too. Null and empty texts have no ids; long ones are encoded whole."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = decode(encode(docs, path, public_tokenizers.PATTERN), path)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("near dedup", near_stage), ("mixing", mixing_stage), ("tokens", tokens_stage)]

#: SQL cannot express the fitted classifier, the near stage or the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/luminal/pipeline-{uuid.uuid4().hex}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
