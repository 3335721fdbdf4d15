"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A new name in the folder that driver and executors share; a temporary folder only where none is set (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.gettempdir() + "/muster-shared"
    return f"{where}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """The frame written as Parquet to spark.checkpoint.dir and read again.

    For results that several later steps use: each row is computed once, later steps read only their columns,
    a lost executor costs no recomputation, and filters aren't pushed into (and copied with) long expressions.
    """
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
