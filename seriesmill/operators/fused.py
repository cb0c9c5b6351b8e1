"""Many results of one pass: the aggregates of all of them in one scan, cut apart afterwards."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from seriesmill.functions.expressions import c
from seriesmill.sources.scratch import written


@dataclass(frozen=True)
class Figures:
    """What a result needs of the rows of each key, and how it is cut from a row per key.

    ``cut`` takes a frame of the keys and ``columns`` by their names.
    """

    columns: Mapping[str, Column]
    cut: Callable[[DataFrame], DataFrame]


def apart(df: DataFrame, figures: Figures, keys: Sequence[str]) -> DataFrame:
    """One result by its own aggregate."""
    return figures.cut(df.groupBy(*[c(k) for k in keys]).agg(*[x.alias(n) for n, x in figures.columns.items()]))


def totals_of(df: DataFrame, wanted: Mapping[str, Figures], keys: Sequence[str]) -> DataFrame:
    """(keys, _0_..., _1_...): the aggregates of all results, one row per key."""
    columns = [
        x.alias(f"_{i}_{name}") for i, figures in enumerate(wanted.values()) for name, x in figures.columns.items()
    ]
    return df.groupBy(*[c(k) for k in keys]).agg(*columns)


def together(df: DataFrame, wanted: Mapping[str, Figures], keys: Sequence[str]) -> dict[str, DataFrame]:
    """Name -> result, all from one scan of df and one shuffle of a partial row per task and key.

    The aggregates run at once and are written, a row per key; every result reads this small table,
    however many are used. Without wanted results nothing runs.
    """
    if not wanted:
        return {}
    totals = written(totals_of(df, wanted, keys), "figures")
    return {
        result: figures.cut(totals.select(*[c(k) for k in keys], *[c(f"_{i}_{n}").alias(n) for n in figures.columns]))
        for i, (result, figures) in enumerate(wanted.items())
    }
