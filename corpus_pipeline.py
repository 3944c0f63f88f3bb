"""A corpus through five stages; each is written as Parquet and read again by the next.

Stages: documents that the toxicity machine rejects go; one document of each group of near
copies stays, the one with the smallest id; documents into which a benchmark item leaks go;
secrets are masked in place; the rest is encoded to piece ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import decontaminate, jaccard, pieces, secrets, toxicity
from tidemark.llm.storage import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = "_" * (1 + max(len(c) for c in docs.columns))  # a name that no column has
    return toxicity.score(docs, toxicity.fit(source, labels), docs.columns, name).filter(F.col(name) < 0.5).drop(name)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies by five-word shingles at a similarity of 0.8."""
    groups = jaccard.similar_join(docs, n=5, j=0.8).filter("component_id <> doc_id").select("doc_id")
    return docs.join(groups, "doc_id", "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bad = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, keep=["doc_id"])


STAGES = [("toxicity", drop_toxic), ("jaccard join", one_of_each), ("decontamination", drop_leaks), ("secrets", mask_secrets), ("pieces", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
