"""Runs of equal labels over an ordered series."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions.expressions import c, elapsed_days, is_date, require_columns
from seriesmill.operators.layout import (
    CHUNK,
    KEYS,
    POS,
    SUMMARY_CHUNK_ROWS,
    TIME,
    Ordered,
    choose_layout,
    ordered,
    series_order,
    with_position,
)

_RUN = "_run"

# (end time and position of the previous piece, start time and position of this one)
Linked = Callable[[Column, Column, Column, Column], Column]


def _number_runs(pieces: DataFrame, part: Sequence[str], linked: Linked) -> DataFrame:
    """Number the runs of linked neighbours within ``part``, in time order."""
    w = Window.partitionBy(*part).orderBy("start", "first_pos")
    joins = linked(
        F.lag("end").over(w), F.lag("last_pos").over(w), F.col("start"), F.col("first_pos")
    )
    fresh = F.when(joins, 0).otherwise(1)
    return pieces.withColumn("_fresh", fresh).withColumn(
        _RUN, F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )


def _collapse(numbered: DataFrame, part: Sequence[str], *extra: Column) -> DataFrame:
    return numbered.groupBy(*part, _RUN).agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min("first_pos").alias("first_pos"),
        F.max("last_pos").alias("last_pos"),
        F.sum("n_rows").alias("n_rows"),
        *extra,
    )


def label_runs(
    df: DataFrame,
    label: str,
    linked: Linked,
    *,
    keys: Sequence[str] = KEYS,
    time: str = TIME,
    seq: str | None = None,
    layout: str = "auto",
    chunk_rows: int = SUMMARY_CHUNK_ROWS,
) -> DataFrame:
    """Maximal runs of linked rows with the same label: (keys, label, start, end, n_rows).

    Two rows are compared only if they are neighbours among the rows of their label.
    In chunks, runs are built per (key, label, chunk) first; only the first and last run of
    each can continue elsewhere, so only those are linked again across chunks.
    """
    keys = list(keys)
    whole = choose_layout(layout) == "whole" and not isinstance(df, Ordered)
    tie = [c(seq).alias("_seq")] if seq else []
    rows = df.select(*keys, time, c(label).alias("label"), *tie)
    seq = "_seq" if seq else None
    if whole:
        order = Window.partitionBy(*keys).orderBy(*series_order(time, seq))
        rows = rows.withColumn(POS, F.row_number().over(order).cast("bigint") - F.lit(1))
    else:
        rows = with_position(rows, chunk_rows, keys=keys, time=time, seq=seq)
    pieces = rows.where(c("label").isNotNull()).select(
        *keys, "label", *([] if whole else [CHUNK]),
        c(time).alias("start"), c(time).alias("end"),
        F.col(POS).alias("first_pos"), F.col(POS).alias("last_pos"),
        F.lit(1).cast("bigint").alias("n_rows"),
    )
    part = [*keys, "label"]
    if whole:
        runs = _collapse(_number_runs(pieces, part, linked), part)
    else:
        local = [*part, CHUNK]
        numbered = _number_runs(pieces, local, linked)
        last_run = F.max(_RUN).over(Window.partitionBy(*local))
        numbered = numbered.withColumn("_last_run", last_run)
        partial = _collapse(numbered, local, F.max("_last_run").alias("_last_run"))
        # All edges of a label meet (two per chunk at most); other runs stay with their
        # chunk, where no two of them are linked.
        edge = (F.col(_RUN) == 1) | (F.col(_RUN) == F.col("_last_run"))
        spread = partial.withColumn(
            "_group", F.when(edge, F.lit(-1).cast("bigint")).otherwise(F.col(CHUNK))
        ).drop(_RUN)
        merge = [*part, "_group"]
        runs = _collapse(_number_runs(spread, merge, linked), merge)
    return runs.select(*keys, "label", "start", "end", "n_rows")


def regime_segments(df: DataFrame, label: str = "regime", **opts) -> DataFrame:
    """Runs of equal label over adjacent rows, whatever time lies between them.

    Rows without a label break a run and are not reported; single rows are.
    """
    return label_runs(df, label, lambda _end, last, _start, first: first - last == 1, **opts)


def flat_spans(
    df: DataFrame,
    metrics: Sequence[str],
    k: int = 7,
    *,
    keys: Sequence[str] = KEYS,
    time: str = TIME,
    seq: str | None = None,
    **opts,
) -> DataFrame:
    """Runs of k + 1 or more equal values: (keys, metric, value, start, end, n_rows), a row per run.

    However long a run is, it is one row: runs of a chunk are joined to those of its neighbours by
    their edges. All metrics go by the positions of one sort. A missing value ends a run.
    """
    require_columns(df, list(metrics))
    wanted = [*keys, time, *metrics, *([seq] if seq else [])]
    rows = df.select(*[c(n) for n in wanted])
    if choose_layout(opts.get("layout", "auto")) != "whole" and not isinstance(rows, Ordered):
        rows = ordered(rows, keys=keys, time=time, seq=seq)
    how = {"keys": keys, "time": time, "seq": seq, **opts}
    found = [
        regime_segments(rows, m, **how).where(F.col("n_rows") > k).select(
            *keys, F.lit(m).alias("metric"), F.col("label").cast("double").alias("value"), "start", "end", "n_rows"
        )
        for m in metrics
    ]
    return reduce(DataFrame.unionByName, found)


def zone_spans(
    df: DataFrame, label: str = "zone", max_days: int = 1, time: str = TIME, **opts
) -> DataFrame:
    """Rows of one zone linked while at most ``max_days`` whole days apart.

    Rows of other zones in between do not matter; isolated rows give no span.
    """
    dates = is_date(df, time)

    def close(end: Column, _last: Column, start: Column, _first: Column) -> Column:
        return F.floor(elapsed_days(end, start, dates)) <= max_days

    return label_runs(df, label, close, time=time, **opts).where(F.col("n_rows") >= 2)
