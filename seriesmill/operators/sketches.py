"""Quantiles of any span of days from stored sketches, without reading the rows again.

A sketch per series and day holds about ``k`` values, whatever the number of rows. Sketches merge,
so the quantiles of a year come from 365 small rows a series. The rank of what is given is off by
no more than ``rank_error(k)`` of the rows, with a confidence of 99 %. ``stats.percentiles`` gives
exact ones and reads all rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.config import PERCENTS
from seriesmill.functions.expressions import c, require_columns
from seriesmill.operators.layout import KEYS, TIME
from seriesmill.operators.stats import percentile_name

SKETCH_SIZE = 800


def rank_error(k: int = SKETCH_SIZE) -> float:
    """Share of the rows by which a rank may be off (published bound of the KLL sketch)."""
    return 2.296 / k**0.9723


def day_sketches(
    df: DataFrame, metrics: Sequence[str], *, keys: Sequence[str] = KEYS, time: str = TIME, k: int = SKETCH_SIZE
) -> DataFrame:
    """(keys, day, metric, n, sketch): to be stored. Missing values are left out.

    Tasks sketch what they read; only sketches are shuffled. Rows of new days are added to a store
    by writing their sketches next to the others.
    """
    require_columns(df, metrics)
    day = c(time).cast("date")
    sketched = df.groupBy(*[c(n) for n in keys], day.alias("day")).agg(
        *[F.count(c(m)).alias(f"_n{i}") for i, m in enumerate(metrics)],
        *[F.kll_sketch_agg_double(c(m).cast("double"), F.lit(k)).alias(f"_s{i}") for i, m in enumerate(metrics)],
    )
    entries = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(f"_n{i}").alias("n"), F.col(f"_s{i}").alias("sketch")) for i, m in enumerate(metrics)]
    )
    return sketched.select(*[c(n) for n in keys], "day", F.inline(entries)).where("n > 0")


def range_quantiles(
    sketches: DataFrame,
    probs: Sequence[float] = PERCENTS,
    start: date | None = None,
    end: date | None = None,
    *,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """(keys, metric, n, q...) of the days from ``start`` to ``end``, both included."""
    rows = sketches
    if start is not None:
        rows = rows.where(F.col("day") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("day") <= F.lit(end))
    merged = rows.groupBy(*[c(n) for n in keys], "metric").agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("_sketch")
    )
    found = F.kll_sketch_get_quantile_double("_sketch", F.array(*[F.lit(float(p)) for p in probs]))
    return merged.withColumn("_q", found).select(
        *[c(n) for n in keys], "metric", "n", *[F.col("_q")[i].alias(percentile_name(p)) for i, p in enumerate(probs)]
    )
