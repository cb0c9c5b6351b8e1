"""Features of rows that are appended to series, from the new rows and a stored tail.

A row's features reach a fixed number of rows back (``before``) and forth (``after``). The tail of
a series is its last ``before + after`` rows; with them the features of new rows come out as from
the whole series. Features that look ahead are not final for the last ``after`` rows of a series:
when more rows come, these rows are given again.

A store holds batches: ``rows`` of features, the ``tail`` after each batch, and a ``ledger`` with a
row per batch, added last as one file. An append reads the newest tail and nothing else that is
stored; one that dies midway leaves folders that no ledger row names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesmill.functions.expressions import c, join_on
from seriesmill.operators.layout import KEYS, TIME, frame_of, series_order
from seriesmill.operators.windows import Feature, compute_features
from seriesmill.sources.scratch import written

NEW, REVISED, FROM_END = "_new", "revised", "_from_end"
LEDGER = "batch long, n_rows long"


def reach_of(features: Sequence[Feature]) -> tuple[int, int]:
    """How many rows the features look back and ahead."""
    return max(f.before for f in features), max(f.after for f in features)


def tail_of(
    df: DataFrame, rows: int, *, keys: Sequence[str] = KEYS, time: str = TIME, seq: str | None = None
) -> DataFrame:
    """The last rows of every series, with ``_from_end`` (0 for the last).

    Tasks keep no more than these rows of a series before the shuffle.
    """
    newest = Window.partitionBy(*keys).orderBy(*[x.desc() for x in series_order(time, seq)])
    return df.withColumn(FROM_END, F.row_number().over(newest) - 1).where(F.col(FROM_END) < max(rows, 1))


def append_features(
    new: DataFrame,
    tail: DataFrame,
    features: Sequence[Feature],
    *,
    keys: Sequence[str] = KEYS,
    time: str = TIME,
    seq: str | None = None,
    keep: Sequence[str] | None = None,
    **opts,
) -> tuple[DataFrame, DataFrame]:
    """(features, tail): of all new rows, and again of stored rows that look ahead to them.

    ``revised`` marks the rows that were given before. Every new row must come after the stored
    rows of its series.
    """
    before, after = reach_of(features)
    keys = list(keys)
    order = F.struct(*series_order(time, seq))
    last = tail.groupBy(*keys).agg(F.max(order).alias("_stored"))
    first = new.groupBy(*keys).agg(F.min(order).alias("_first"))
    late = join_on(first, last, keys).where(F.col("_first") <= F.col("_stored"))
    if not late.isEmpty():
        raise ValueError(f"new rows do not come after the stored ones: {late.first().asDict()}")
    metrics = list(dict.fromkeys(m for f in features for m in f.metrics))
    carried = list(dict.fromkeys([*keys, time, *metrics, *([seq] if seq else []), *(keep or [])]))
    both = new.select(*map(c, carried), F.lit(True).alias(NEW), F.lit(-1).alias(FROM_END)).unionByName(
        tail.select(*map(c, carried), F.lit(False).alias(NEW), FROM_END)
    )
    kept = [*(metrics if keep is None else keep), *([seq] if seq else []), NEW, FROM_END]
    made = frame_of(compute_features(both, features, keys=keys, time=time, seq=seq, keep=kept, **opts))
    # a stored series without new rows has nothing to give again
    moved = join_on(made, first.select(*keys), keys, "left_semi")
    given = moved.where(F.col(NEW) | (F.col(FROM_END) < after))
    given = given.withColumn(REVISED, ~F.col(NEW)).drop(NEW, FROM_END)
    return given, tail_of(both.drop(FROM_END, NEW), before + after, keys=keys, time=time, seq=seq)


def _batches(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(f"{path}/ledger")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def append(
    new: DataFrame,
    path: str,
    features: Sequence[Feature],
    *,
    keys: Sequence[str] = KEYS,
    time: str = TIME,
    seq: str | None = None,
    keep: Sequence[str] | None = None,
    **opts,
) -> int:
    """Add rows to a store of features and give the batch's number (from 1).

    All appends to a store are made with the same features. Rows that are given again replace
    those of earlier batches when the store is read.
    """
    spark = new.sparkSession
    how = {"keys": list(keys), "time": time, "seq": seq}
    new = written(new, "appended")
    stored = _batches(spark, path).agg(F.max("batch")).first()[0]
    tail = new.where("false").withColumn(FROM_END, F.lit(0))
    if stored is not None:
        tail = spark.read.parquet(f"{path}/tail").where(F.col("batch") == stored).drop("batch")
    found, tail = append_features(new, tail, features, keep=keep, **how, **opts)
    batch = (stored or 0) + 1
    # a folder that a lost append has left under this number is written over
    found.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
    tail.write.mode("overwrite").parquet(f"{path}/tail/batch={batch}")
    done = new.agg(F.lit(batch).cast("long").alias("batch"), F.count(F.lit(1)).alias("n_rows"))
    done.write.mode("append").parquet(f"{path}/ledger")
    return batch


def read_features(
    spark: SparkSession, path: str, *, keys: Sequence[str] = KEYS, time: str = TIME, seq: str | None = None
) -> DataFrame:
    """All stored features; of rows given several times, the last."""
    batches = [r["batch"] for r in _batches(spark, path).select("batch").distinct().collect()]
    rows = spark.read.parquet(f"{path}/rows").where(F.col("batch").isin(batches))
    if rows.where(REVISED).isEmpty():
        return rows.drop("batch", REVISED)
    # Only rows that were revised, or whose place was, can stand twice: those are few, so they are
    # found by a join with the places of the revised ones and not by a sort of all rows.
    place = [*keys, *([time] if seq is None else [time, seq])]
    revised = written(rows.where(REVISED).groupBy(*map(c, place)).agg(F.max("batch").alias("_newest")), "revised")
    marked = join_on(rows, revised, place, "left")
    return marked.where(F.col("_newest").isNull() | (F.col("_newest") == F.col("batch"))).drop("batch", REVISED, "_newest")
