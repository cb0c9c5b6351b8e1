"""How an ordered series is spread over tasks.

Row frames need neighbours, so a series must be sorted somewhere. Two layouts:

``chunked`` (the default)
    For series of any length. Rows are sorted once by (keys, time, tie-break) into Spark's
    range partitions, whose bounds it samples from the rows themselves: a hot key, a crowded
    hour, even one crowded second is cut wherever its rows fill a partition. The sorted table is
    written to the shared folder, numbered as it is written. A small table (one row per key and
    partition that holds it, at most keys + partitions rows) turns the numbers into positions
    within each series. A chunk is a stretch of ``chunk_rows`` positions; exactly the rows that
    frames of a neighbouring chunk reach are copied into it. Windows run per (key, chunk); the
    copies are dropped afterwards.

    A chain of operators sorts only once: ``ordered`` gives a handle on the sorted, numbered rows,
    operators take it in place of a frame and give one back, and its rows go from chunk to chunk
    by their positions.

``whole``
    One window partition per key, one shuffle, nothing written. Only for series that the
    calendar bounds, such as one row per day after ``clean``; the caller says so.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmill.functions.expressions import c, join_on
from seriesmill.sources.scratch import written

KEYS = ("asset",)
TIME = "time"

POS = "_pos"
LAST = "_last"
CHUNK = "_chunk"
OWNED = "_owned"

# Rows per chunk for frames with a halo: at least this many, and at least 16 halos, so
# that copies stay a small share of the rows.
MIN_CHUNK_ROWS = 16_384
HALO_RATIO = 16
# Rows per chunk where only a summary of each chunk is exchanged.
SUMMARY_CHUNK_ROWS = 65_536

_PART, _ROW, _TIE = "_part", "_row", "_tie"


@dataclass(frozen=True)
class Ordered:
    """Rows that know their place in their series: every row has ``_pos`` and ``_last``.

    Operators treat it like a frame of the other columns.
    """

    rows: DataFrame
    keys: tuple[str, ...]
    time: str

    @property
    def schema(self) -> T.StructType:
        return T.StructType([f for f in self.rows.schema.fields if f.name not in (POS, LAST)])

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    @property
    def frame(self) -> DataFrame:
        """The rows as a plain frame."""
        return self.rows.drop(POS, LAST)

    def select(self, *columns: str | Column) -> Ordered:
        return replace(self, rows=self.rows.select(*[c(x) if isinstance(x, str) else x for x in columns], POS, LAST))

    def withColumns(self, columns: Mapping[str, Column]) -> Ordered:  # noqa: N802
        return replace(self, rows=self.rows.withColumns(dict(columns)))

    def keep(self, condition: Column) -> Ordered:
        """The rows that meet a condition, numbered anew: each chunk on its own, after a table of
        one row per chunk; nothing is sorted by range again."""
        keys = list(self.keys)
        chunk = F.expr(f"{POS} div {SUMMARY_CHUNK_ROWS}")
        kept = written(self.rows.where(condition).withColumn(CHUNK, chunk), "kept")
        earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        counts = kept.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n")).select(
            *keys, CHUNK, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
            (F.sum("_n").over(Window.partitionBy(*keys)) - 1).alias("_highest"),
        )
        place = F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(POS)) - 1
        placed = join_on(kept.withColumn("_place", place), written(counts, "kept-counts"), [*keys, CHUNK])
        names = [c(n) for n in self.columns]
        return replace(self, rows=placed.select(*names, (F.col("_before") + F.col("_place")).alias(POS), F.col("_highest").alias(LAST)))


def ordered(df: DataFrame, *, keys: Sequence[str] = KEYS, time: str = TIME, seq: str | None = None) -> Ordered:
    """Sort the rows once, for a chain of operators."""
    return Ordered(_positions(df, list(keys), time, seq), tuple(keys), time)


def frame_of(df: DataFrame | Ordered) -> DataFrame:
    return df.frame if isinstance(df, Ordered) else df


def choose_layout(layout: str) -> str:
    if layout == "auto":
        return "chunked"
    if layout not in ("whole", "chunked"):
        raise ValueError(f"unknown layout: {layout}")
    return layout


def series_order(time: str, seq: str | None) -> list[Column]:
    return [c(time)] if seq is None else [c(time), c(seq)]


def _positions(
    df: DataFrame, keys: list[str], time: str, seq: str | None
) -> DataFrame:
    """Rows with ``_pos``, the 0-based row number in their series, and ``_last``, its highest.

    Without a tie-break, equal times stay in the order in which they were read.
    """
    tie = F.monotonically_increasing_id() if seq is None else c(seq)
    order = [*map(c, keys), c(time), F.col(_TIE)]
    in_order = df.withColumn(_TIE, tie).repartitionByRange(*order).sortWithinPartitions(*order)
    # Numbers grow from partition to partition and by one from row to row.
    numbered = in_order.drop(_TIE).withColumns(
        {_PART: F.spark_partition_id(), _ROW: F.monotonically_increasing_id()}
    )
    rows = written(numbered, "ordered")
    series = Window.partitionBy(*keys)
    earlier = series.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    shifts = rows.groupBy(*keys, _PART).agg(
        F.count(F.lit(1)).alias("_n"), F.min(_ROW).alias("_first")
    ).select(
        *keys, _PART,
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        (F.sum("_n").over(series) - 1).alias(LAST),
    )
    placed = join_on(rows, written(shifts, "shifts"), [*keys, _PART])
    kept = [c(n) for n in df.columns]
    return placed.select(*kept, (F.col(_ROW) + F.col("_shift")).alias(POS), LAST)


def in_chunks(
    df: DataFrame | Ordered,
    rows_per_chunk: int,
    *,
    before: int = 0,
    after: int = 0,
    keys: Sequence[str] = KEYS,
    time: str = TIME,
    seq: str | None = None,
) -> DataFrame:
    """Add ``_pos``, ``_chunk`` and ``_owned`` to rows and their halo copies.

    A chunk owns ``rows_per_chunk`` successive rows. With a halo, they are preceded (followed) by
    the ``before`` (``after``) rows of the series next to them. ``seq`` orders equal times. Rows
    without a key are a series of their own; rows without a time stand first in theirs.
    """
    if isinstance(df, Ordered) and (tuple(keys), time) != (df.keys, df.time):
        raise ValueError(f"rows are ordered by {df.keys} and {df.time}")
    rows = df.rows if isinstance(df, Ordered) else _positions(df, list(keys), time, seq)
    unused = [] if isinstance(df, Ordered) else [LAST]
    size = int(rows_per_chunk)
    own = F.expr(f"{POS} div {size}")
    if not (before or after):
        return rows.withColumns({CHUNK: own, OWNED: F.lit(True)}).drop(*unused)
    first = F.expr(f"greatest({POS} - {int(after)}, 0) div {size}")
    last = F.expr(f"least({POS} + {int(before)}, {LAST}) div {size}")
    copies = rows.withColumn(CHUNK, F.explode(F.sequence(first, last)))
    return copies.withColumn(OWNED, F.col(CHUNK) == own).drop(*unused)


def with_position(df: DataFrame | Ordered, rows_per_chunk: int, **opts) -> DataFrame:
    """Add ``_pos``, the 0-based row number in the series, and ``_chunk``."""
    return in_chunks(df, rows_per_chunk, **opts).drop(OWNED)


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach a table of one row per key to rows, whatever share one key has.

    The table is written first, so Spark knows its size: a small one is broadcast and the rows
    stay where they are; otherwise both sides are read and shuffled, and adaptive execution
    splits the rows of a hot key.
    """
    return join_on(rows, written(per_key, "per-key"), list(keys))


def over_series(
    df: DataFrame | Ordered,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    *,
    before: int = 0,
    after: int = 0,
    keys: Sequence[str] = KEYS,
    time: str = TIME,
    seq: str | None = None,
    layout: str = "auto",
    chunk_rows: int | None = None,
) -> DataFrame | Ordered:
    """Run ``build(rows, window)`` with every row seeing ``before``/``after`` neighbours.

    ``window`` is partitioned and ordered by time, then ``seq``; ``build`` adds row frames
    within those bounds. The same ``build`` serves both layouts. Ordered rows stay ordered.
    """
    keys = list(keys)
    if choose_layout(layout) == "whole" and not isinstance(df, Ordered):
        return build(df, Window.partitionBy(*keys).orderBy(*series_order(time, seq)))
    size = chunk_rows or max(MIN_CHUNK_ROWS, HALO_RATIO * max(before, after))
    rows = in_chunks(df, size, before=before, after=after, keys=keys, time=time, seq=seq)
    built = build(rows, Window.partitionBy(*keys, CHUNK).orderBy(POS))
    built = built.where(F.col(OWNED)).drop(CHUNK, OWNED)
    return replace(df, rows=built) if isinstance(df, Ordered) else built.drop(POS)
