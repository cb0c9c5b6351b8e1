"""The stored metric table: one Parquet dataset, one partition per asset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmill.functions.expressions import c
from seriesmill.operators.layout import KEYS, TIME


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = KEYS, name: str | None = None
) -> None:
    """Replace the partitions that ``df`` holds; other assets stay as they are.

    Rows are rebalanced by asset: small assets are written by one task and not by all, and
    adaptive execution splits a hot asset over as many tasks as its size asks for. With a
    ``name`` the table is listed in the session catalog.
    """
    (
        df.hint("rebalance", *map(c, partition_by))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )
    if name is not None:
        spark = df.sparkSession
        if not spark.catalog.tableExists(name):
            spark.catalog.createTable(name, path=path, source="parquet")
        spark.catalog.recoverPartitions(name)


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """The stored table. Give the schema when asset names could be taken for numbers."""
    source = spark.read.schema(schema) if schema is not None else spark.read
    return source.parquet(path)


def stored_series(table: DataFrame, keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """What is stored: rows and date range per asset."""
    return table.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
    )


def list_tables(spark: SparkSession) -> list[str]:
    """Names of the tables and views of the session catalog."""
    return sorted(t.name for t in spark.catalog.listTables())


def preview(df: DataFrame, n: int = 10, time: str = TIME) -> DataFrame:
    """The first n rows by time. Each task keeps n rows, so nothing is sorted whole."""
    return df.orderBy(time).limit(n)


def preview_each(
    df: DataFrame, n: int = 10, keys: Sequence[str] = KEYS, time: str = TIME
) -> DataFrame:
    """The first n rows of every series; tasks keep n rows per series before the shuffle."""
    first = Window.partitionBy(*keys).orderBy(c(time))
    return df.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= n).drop("_rank")
