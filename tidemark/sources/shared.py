"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, kind: str) -> str:
    """A new folder's name under spark.checkpoint.dir, or under the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """Df as a Parquet table in the shared folder, read back, so that later steps do not compute it again."""
    path = folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
