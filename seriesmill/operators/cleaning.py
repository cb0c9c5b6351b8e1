"""Cleaning: lookback, non-finite values, positional interpolation, duplicate times."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from datetime import date, datetime, time as clock, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions.expressions import c, finite, is_date, join_on, numeric_columns
from seriesmill.operators.layout import (
    CHUNK,
    KEYS,
    POS,
    SUMMARY_CHUNK_ROWS,
    LAST,
    TIME,
    Ordered,
    over_series,
    with_position,
)


def lookback(
    df: DataFrame, as_of: date | datetime, days: int | None, time: str = TIME
) -> DataFrame:
    """Rows no older than ``days`` before ``as_of``; all rows when ``days`` is 0 or None.

    The bound is a literal of the column's own type, so it reaches the scan.
    """
    if not days:
        return df
    cutoff = as_of - timedelta(days=days)
    if is_date(df, time):
        if isinstance(cutoff, datetime):
            whole_day = cutoff.time() == clock.min
            cutoff = cutoff.date() if whole_day else cutoff.date() + timedelta(days=1)
        bound = F.lit(cutoff)
    else:
        if not isinstance(cutoff, datetime):
            cutoff = datetime.combine(cutoff, clock.min)
        bound = F.lit(cutoff.isoformat(sep=" ")).cast(df.schema[time].dataType)
    return df.where(c(time) >= bound)


def _metrics(df: DataFrame, columns: Sequence[str] | None, skip: Sequence[str]) -> list[str]:
    if columns is not None:
        return list(columns)
    return numeric_columns(df, tuple(skip))


def clean_nonfinite(
    df: DataFrame, columns: Sequence[str] | None = None, seq: str | None = None
) -> DataFrame:
    """NaN and infinities become NULL in every numeric column."""
    names = _metrics(df, columns, [seq] if seq else [])
    return df.withColumns({n: finite(c(n).cast("double")) for n in names})


def interpolate_linear(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    keys: Sequence[str] = KEYS,
    time: str = TIME,
    seq: str | None = None,
    chunk_rows: int = SUMMARY_CHUNK_ROWS,
    **opts,
) -> DataFrame:
    """Fill NULLs linearly by row position; edges take the nearest value.

    Copies of a time count as positions. A gap may be longer than any halo, so each
    chunk is filled from its own rows plus the nearest valid point on either side, which
    comes from a summary of one row per chunk.
    """
    keys = list(keys)
    names = _metrics(df, columns, [*keys, time] + ([seq] if seq else []))
    rows = with_position(df, chunk_rows, keys=keys, time=time, seq=seq, **opts)

    def point(name: str):
        return F.when(c(name).isNotNull(), F.struct(F.col(POS).alias("p"), c(name).alias("v")))

    points = {n: f"_at_{i}" for i, n in enumerate(names)}
    heads = {n: f"_head_{i}" for i, n in enumerate(names)}
    tails = {n: f"_tail_{i}" for i, n in enumerate(names)}

    edges = rows.groupBy(*keys, CHUNK).agg(
        *[F.min(point(n)).alias(heads[n]) for n in names],
        *[F.max(point(n)).alias(tails[n]) for n in names],
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    later = (
        Window.partitionBy(*keys).orderBy(F.desc(CHUNK))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = edges.select(
        *keys,
        CHUNK,
        *[F.last(tails[n], ignorenulls=True).over(earlier).alias(tails[n]) for n in names],
        *[F.last(heads[n], ignorenulls=True).over(later).alias(heads[n]) for n in names],
    )

    # Frames run from the near end of each order: a frame that reaches forward to the end
    # would be re-read for every row.
    in_chunk = Window.partitionBy(*keys, CHUNK)
    up_to = in_chunk.orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    down_to = in_chunk.orderBy(F.desc(POS)).rowsBetween(Window.unboundedPreceding, 0)
    located = rows.withColumns({points[n]: point(n) for n in names})
    located = located.withColumns(
        {f"{points[n]}_l": F.last(points[n], ignorenulls=True).over(up_to) for n in names}
    ).withColumns(
        {f"{points[n]}_r": F.last(points[n], ignorenulls=True).over(down_to) for n in names}
    )
    joined = join_on(located, carried, [*keys, CHUNK])

    filled = {}
    for n in names:
        left = F.coalesce(F.col(f"{points[n]}_l"), F.col(tails[n]))
        right = F.coalesce(F.col(f"{points[n]}_r"), F.col(heads[n]))
        share = F.try_divide(
            (F.col(POS) - left["p"]).cast("double"), (right["p"] - left["p"]).cast("double")
        )
        filled[n] = F.coalesce(
            c(n), left["v"] + (right["v"] - left["v"]) * share, left["v"], right["v"]
        )
    names = [filled[n].alias(n) if n in filled else c(n) for n in df.columns]
    if isinstance(df, Ordered):
        return replace(df, rows=joined.select(*names, POS, LAST))
    return joined.select(*names)


def dedup_keep_last(
    df: DataFrame, *, keys: Sequence[str] = KEYS, time: str = TIME, seq: str
) -> DataFrame:
    """One row per time, the one with the highest ``seq``.

    Spark limits each time to one row before the shuffle as well, so copies never meet.
    """
    if isinstance(df, Ordered):  # copies are neighbours, the newest last
        after = over_series(
            df, lambda rows, w: rows.withColumns({"_next": F.lead(c(time), 1).over(w), "_end": F.col(POS) == F.col(LAST)}),
            after=1, keys=keys, time=time,
        )
        found = after.keep(F.col("_end") | ~c(time).eqNullSafe(F.col("_next")))
        return found.select(*df.columns)
    newest = Window.partitionBy(*keys, time).orderBy(c(seq).desc())
    return df.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def clean(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    keys: Sequence[str] = KEYS,
    time: str = TIME,
    seq: str,
    chunk_rows: int = SUMMARY_CHUNK_ROWS,
    **opts,
) -> DataFrame:
    """Non-finite to NULL, interpolate by (time, seq) position, then drop duplicate times.

    Rows ordered by (time, seq) come out ordered, for the features that follow.
    """
    names = _metrics(df, columns, [*keys, time, seq])
    finite_rows = clean_nonfinite(df, names)
    filled = interpolate_linear(
        finite_rows, names, keys=keys, time=time, seq=seq, chunk_rows=chunk_rows, **opts
    )
    newest = dedup_keep_last(filled, keys=keys, time=time, seq=seq)
    return newest.select(*[c(n) for n in df.columns if n != seq])
