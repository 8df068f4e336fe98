"""Tables in the folder that driver and executors share; they cut lineage and outlive executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; without one there is nothing safe to write to."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


def work_folder(spark: SparkSession) -> str:
    """A new folder in the shared folder."""
    return f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder: read by column, and of known size to the planner."""
    at = work_folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
