"""Feature results as partitioned files: written once per run, read back with a schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.config import Settings
from seriesmill.functions.expressions import c
from seriesmill.operators.layout import KEYS, TIME
from seriesmill.operators.reshape import melt
from seriesmill.sources.scratch import written
from seriesmill.operators.windows import (
    Feature,
    average_of,
    compute_features,
    delta_of,
    volatility_of,
)

# The kinds of result and the label each is listed under.
KINDS = {
    "moving_averages": "Moving Averages",
    "lag_volatility": "Lag & Volatility",
    "rolling_deltas": "Rolling Deltas",
}


def result_columns(kind: str, settings: Settings = Settings()) -> tuple[str, ...]:
    """Value columns of a kind in its long form."""
    if kind == "moving_averages":
        return ("value", *(f"ma{k}" for k in settings.average_windows))
    if kind == "lag_volatility":
        return ("value", "return", "return_mean", "lag", "volatility")
    if kind == "rolling_deltas":
        return ("delta", "pct_change")
    raise ValueError(f"unknown kind: {kind}")


def result_schema(kind: str, settings: Settings = Settings(), time_type: str = "date") -> str:
    values = ", ".join(f"`{n}` double" for n in result_columns(kind, settings))
    return f"time {time_type}, {values}, asset string, metric string"


def kind_features(kind: str, settings: Settings) -> tuple[tuple[str, ...], list[Feature], bool]:
    """Metrics of a kind, their features, and whether the value itself is a column."""
    if kind == "moving_averages":
        names = settings.aggregate_metrics
        return names, [average_of(m, settings.average_windows) for m in names], True
    if kind == "lag_volatility":
        names = settings.lag_metrics
        made = [volatility_of(m, settings.lag, settings.volatility_window) for m in names]
        return names, made, True
    if kind == "rolling_deltas":
        names = settings.delta_metrics
        return names, [delta_of(m, settings.delta_window) for m in names], False
    raise ValueError(f"unknown kind: {kind}")


def long_results(
    wide: DataFrame,
    kind: str,
    settings: Settings = Settings(),
    *,
    keys: Sequence[str] = KEYS,
    time: str = TIME,
) -> DataFrame:
    """Long form of one kind from wide rows that hold its features."""
    metrics, features, with_value = kind_features(kind, settings)
    names = result_columns(kind, settings)
    outputs = {
        m: dict(zip(names, (*([m] if with_value else []), *f.outputs)))
        for m, f in zip(metrics, features)
    }
    long = melt(wide, [*keys, time], outputs)
    return long.na.drop("any", subset=list(names)) if kind == "lag_volatility" else long


def feature_results(
    df: DataFrame,
    kind: str,
    settings: Settings = Settings(),
    *,
    keys: Sequence[str] = KEYS,
    time: str = TIME,
    **opts,
) -> DataFrame:
    """(asset, time, metric, values...) of one kind for all its metrics.

    Windows run over the wide rows, so a row is shuffled once for all metrics; the long
    form is made afterwards, in place.
    """
    _, features, _ = kind_features(kind, settings)
    wide = compute_features(df, features, keys=keys, time=time, **opts)
    return long_results(wide, kind, settings, keys=keys, time=time)


def write_results(
    results: DataFrame,
    path: str,
    kind: str,
    format: str = "parquet",
    partition_by: Sequence[str] = ("metric",),
    **options,
) -> None:
    """Write one kind below ``path/kind``, replacing the partitions it holds.

    Rows are rebalanced by partition, so the number of files follows the size of the data. Columns
    stand in the order of ``result_schema``, since CSV has no other way to bind them.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind}")
    ends = [n for n in ("asset", "metric") if n in results.columns]
    values = [n for n in results.columns if n not in (TIME, *ends)]
    writer = (
        results.select(*map(c, [TIME, *values, *ends])).hint("rebalance", *map(c, partition_by))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
    )
    if format == "csv":
        writer = writer.option("header", True)
    writer.options(**options).format(format).save(f"{path}/{kind}")


def read_results(
    spark: SparkSession,
    path: str,
    kind: str,
    format: str = "parquet",
    settings: Settings = Settings(),
    time_type: str = "date",
) -> DataFrame:
    """Read one kind back; a file that cannot be read fails the job."""
    reader = spark.read.schema(result_schema(kind, settings, time_type))
    if format == "csv":
        reader = reader.option("header", True).option("mode", "FAILFAST")
    return reader.format(format).load(f"{path}/{kind}")


def read_results_or_skip(
    spark: SparkSession,
    path: str,
    kind: str,
    settings: Settings = Settings(),
    time_type: str = "date",
) -> tuple[DataFrame, DataFrame]:
    """Rows of the Parquet files of a kind that can be read, and (path, status, detail, rows) of all.

    Every file is first read alone, to its end; rows then come from whole files only.
    """

    def tried(batches):
        from io import BytesIO

        import pandas as pd
        from pyarrow import parquet

        for batch in batches:
            out = []
            for file, content in zip(batch["path"], batch["content"]):
                try:
                    out.append((file, "ok", "", parquet.read_table(BytesIO(content)).num_rows))
                except Exception as error:
                    out.append((file, "skipped", str(error)[:200], 0))
            yield pd.DataFrame(out, columns=["path", "status", "detail", "rows"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option(
        "recursiveFileLookup", "true"
    ).load(f"{path}/{kind}").select("path", "content")
    schema = "path string, status string, detail string, rows long"
    status = written(files.mapInPandas(tried, schema), "results-status")
    rows = (
        spark.read.schema(result_schema(kind, settings, time_type))
        .option("ignoreCorruptFiles", True).parquet(f"{path}/{kind}")
        .withColumn("_file", F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")))
    )
    good = status.where("status = 'ok'").select(
        F.url_decode(F.regexp_replace("path", r"\+", "%2B")).alias("_file")
    )
    plain = lambda name: F.regexp_replace(name, "^([a-z0-9]+:)/+", "$1/")
    same = plain(F.col("_file")) == plain(F.col("_good"))
    whole = rows.join(good.withColumnRenamed("_file", "_good"), same, "left_semi")
    return whole.drop("_file"), status


def kind_label(name: Column) -> Column:
    """Label of a result by the kind its file name contains; first match wins."""
    label = None
    for kind, text in KINDS.items():
        test = name.contains(kind)
        label = F.when(test, text) if label is None else label.when(test, text)
    return label


def categorize(df: DataFrame, name: str = "file_name") -> DataFrame:
    """Add the category of each result file; names of no kind are left out."""
    return df.withColumn("category", kind_label(c(name))).where(F.col("category").isNotNull())


def result_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, category) of the result files below ``path``, from the listing alone."""
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    )
    return categorize(listing.select(F.col("path").alias("file_name")))
