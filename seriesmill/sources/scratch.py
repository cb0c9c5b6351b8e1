"""Where queries put tables they write and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder the cluster names.

    Where none is named, the warehouse folder serves: executors reach that as well.
    """
    root = spark.conf.get(SETTING, None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/seriesmill-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, so no later step works them out again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
