"""A stored metric table whose assets are replaced as one version.

``data/write=<id>/asset=<name>/`` holds the rows of one write and is never changed afterwards.
``ledger/`` holds a row per asset and version: which write has the asset's rows, how many, or why
the asset keeps its old ones. A write first puts its data down and then adds its ledger rows as a
single file. That file appears at once when its job commits, so it is the switch from the old
version to the new: readers see one or the other. A write that dies before leaves a folder that no
ledger row names. One writer at a time; readers need no lock.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmill.functions.expressions import c, join_on
from seriesmill.operators.layout import TIME

ASSET = "asset"
LEDGER = (
    "version long, asset string, status string, detail string, write string, n_rows long, "
    "first_time string, last_time string, schema string"
)


def history(spark: SparkSession, path: str) -> DataFrame:
    """All ledger rows; none where nothing is stored yet."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{path}/ledger")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, loaded, kept, n_rows), a row per version."""
    loaded = F.col("status") == "loaded"
    return history(spark, path).groupBy("version").agg(
        F.count_if(loaded).alias("loaded"), F.count_if(~loaded).alias("kept"),
        F.coalesce(F.sum(F.when(loaded, F.col("n_rows"))), F.lit(0)).alias("n_rows"),
    )


def replace(
    df: DataFrame, path: str, status: DataFrame | None = None, time: str = TIME
) -> int:
    """Store ``df`` as the next version and give its number.

    The assets in ``df`` are replaced, others keep their rows. ``status`` (asset, status, detail)
    may name more assets: those that are "ok" but have no rows become empty, any other status
    keeps the stored rows and goes to the ledger with its detail; rows of such assets in ``df``
    are an error.
    """
    spark = df.sparkSession
    latest = history(spark, path).agg(F.max("version")).first()[0] or 0
    write, version = uuid.uuid4().hex, latest + 1
    data = f"{path}/data/write={write}"
    df.hint("rebalance", c(ASSET)).write.partitionBy(ASSET).parquet(data)
    landed = spark.read.schema(df.schema).parquet(data).groupBy(ASSET).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(c(time)).cast("string").alias("first_time"),
        F.max(c(time)).cast("string").alias("last_time"),
    )
    if status is None:
        status = landed.select(ASSET, F.lit("ok").alias("status"), F.lit("").alias("detail"))
    # several files may make up an asset; it is replaced only if all of them are sound
    status = status.groupBy(ASSET).agg(F.max_by("detail", F.struct(F.col("status") != "ok", "detail")).alias("detail"), F.bool_and(F.col("status") == "ok").alias("ok"))
    named = landed.withColumn("_landed", F.lit(True))
    rows = join_on(status.withColumn("_named", F.lit(True)), named, [ASSET], "left")
    extra = join_on(landed.select(ASSET), status, [ASSET], "left_anti")
    if not extra.isEmpty() or not rows.where("_landed and not ok").isEmpty():
        raise ValueError("there are rows of assets that are not ok by their status")
    ok = F.col("ok")
    rows = rows.select(
        F.lit(version).cast("long").alias("version"), ASSET,
        F.when(ok, "loaded").otherwise("kept").alias("status"), "detail",
        F.when(ok, F.lit(write)).alias("write"), F.when(ok, F.coalesce("n_rows", F.lit(0))).alias("n_rows"),
        "first_time", "last_time", F.when(ok, F.lit(df.schema.json())).alias("schema"),
    )
    rows.repartition(1).write.mode("append").parquet(f"{path}/ledger")
    return version


def current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The ledger row that holds for each asset, now or as of a version."""
    rows = history(spark, path).where("status = 'loaded'")
    if version is not None:
        rows = rows.where(F.col("version") <= version)
    newest = Window.partitionBy(ASSET).orderBy(F.desc("version"))
    return rows.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def _merged(schemas: Iterable[str]) -> T.StructType:
    fields: dict[str, T.StructField] = {}
    for text in schemas:
        for field in T.StructType.fromJson(json.loads(text)).fields:
            known = fields.setdefault(field.name, field)
            if known.dataType != field.dataType:
                raise ValueError(f"column {field.name} is {known.dataType} in one version and {field.dataType} in another")
    return T.StructType(list(fields.values()))


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as it is now, or as it was after ``version``.

    Only folders of writes that still hold are listed in the scan's filter; an asset that a write
    lacks a column for has NULL there.
    """
    live = current(spark, path, version).where("n_rows > 0")
    used = live.select("write", "schema", "version").distinct().orderBy("version").collect()
    if not used:
        raise ValueError(f"no stored version under {path}")
    schema = _merged(dict.fromkeys(r["schema"] for r in used))
    data = spark.read.schema(T.StructType([*schema.fields, T.StructField("write", T.StringType())])).parquet(f"{path}/data")
    data = data.where(F.col("write").isin([r["write"] for r in used]))
    kept = join_on(data, live.select("write", ASSET), ["write", ASSET], "left_semi")
    return kept.select(*[c(n) for n in schema.names])
