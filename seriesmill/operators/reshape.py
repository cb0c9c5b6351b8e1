"""Wide and long forms, metric joins, holder tiers, year-over-year layout."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.config import TIERS
from seriesmill.functions.expressions import c, floor_at_zero, join_on, ratio, require_columns
from seriesmill.operators.fused import Figures, apart
from seriesmill.operators.layout import KEYS, TIME


def melt(
    df: DataFrame,
    ids: Sequence[str],
    outputs: Mapping[str, Mapping[str, str]],
    name: str = "metric",
) -> DataFrame:
    """One row per entry of ``outputs`` (label -> {output column: source column}).

    Runs inside the task that holds the wide row; nothing is shuffled.
    """
    entries = F.array(
        *[
            F.struct(F.lit(label).alias(name), *[c(src).alias(out) for out, src in cols.items()])
            for label, cols in outputs.items()
        ]
    )
    return df.select(*[c(i) for i in ids], F.inline(entries))


def to_long(
    df: DataFrame, metrics: Sequence[str], *, keys: Sequence[str] = KEYS, time: str = TIME
) -> DataFrame:
    """(keys, time, metric, value)."""
    require_columns(df, metrics)
    return melt(df, [*keys, time], {m: {"value": m} for m in metrics})


def to_wide(
    long: DataFrame,
    metrics: Sequence[str],
    *,
    keys: Sequence[str] = KEYS,
    time: str = TIME,
    complete: bool = False,
) -> DataFrame:
    """One column per metric. With ``complete`` only times at which every metric has a row."""
    value = {m: F.max(F.when(c("metric") == m, c("value"))).alias(m) for m in metrics}
    seen = {m: F.count_if(c("metric") == m).alias(f"_seen_{i}") for i, m in enumerate(metrics)}
    wide = (
        long.where(c("metric").isin(list(metrics)))
        .groupBy(*keys, time)
        .agg(*value.values(), *(seen.values() if complete else ()))
    )
    if complete:
        for i in range(len(metrics)):
            wide = wide.where(F.col(f"_seen_{i}") > 0).drop(f"_seen_{i}")
    return wide


def join_metrics(
    frames: Sequence[DataFrame], *, keys: Sequence[str] = KEYS, time: str = TIME
) -> DataFrame:
    """Inner join of frames on (keys, time); all joins share one partitioning."""
    return reduce(lambda a, b: join_on(a, b, [*keys, time]), frames)


def tier_columns() -> dict[str, Column]:
    """Holders per tier as differences of the cumulative counts, never below zero."""
    total, over_10k = c("AdrBalCnt"), c("AdrBalUSD10KCnt")
    over_100k, over_1m = c("AdrBalUSD100KCnt"), c("AdrBalUSD1MCnt")
    tiers = (total - over_10k, over_10k - over_100k, over_100k - over_1m, over_1m)
    return {name: floor_at_zero(tier) for name, tier in zip(TIERS, tiers)}


def holder_tiers(
    df: DataFrame, *, keys: Sequence[str] = KEYS, time: str = TIME
) -> DataFrame:
    return df.select(*keys, time, *[tier.alias(n) for n, tier in tier_columns().items()])


def tier_distribution(
    tiers: DataFrame, *, keys: Sequence[str] = KEYS, time: str = TIME
) -> DataFrame:
    """Share of each non-empty tier in the newest row, in percent."""
    return apart(tiers, tier_figures({n: c(n) for n in TIERS}, keys=keys, time=time), keys)


def tier_figures(
    tiers: Mapping[str, Column], *, keys: Sequence[str] = KEYS, time: str = TIME
) -> Figures:
    """The distribution of tiers that are columns of the rows, or are put together from them."""
    newest = F.max_by(F.struct(c(time), *[tier.alias(n) for n, tier in tiers.items()]), c(time))

    def cut(totals: DataFrame) -> DataFrame:
        held = [F.when(c(n) > 0, c(n)).otherwise(F.lit(0.0)) for n in tiers]
        rows = totals.select(*[c(k) for k in keys], "_newest.*").withColumn("_total", reduce(lambda a, b: a + b, held))
        long = melt(rows, [*keys, time, "_total"], {n: {"holders": n} for n in tiers}, name="tier")
        return long.where(c("holders") > 0).select(
            *keys, time, "tier", "holders",
            (ratio(c("holders"), c("_total")) * 100).alias("share_pct"),
        )

    return Figures({"_newest": newest}, cut)


def yoy(df: DataFrame, metric: str, *, keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """Value by year and day of year."""
    return df.select(
        *keys,
        F.year(c(time)).alias("year"),
        F.dayofyear(c(time)).alias("day_of_year"),
        c(metric),
    )


def yoy_pivot(
    df: DataFrame,
    metric: str,
    years: Sequence[int] | None = None,
    *,
    keys: Sequence[str] = KEYS,
    time: str = TIME,
) -> DataFrame:
    """One row per day of year, one column per year (``y1998``...).

    Without ``years`` they are read off the first and last time: one row, by aggregate.
    """
    if years is None:
        low, high = df.agg(F.min(F.year(c(time))), F.max(F.year(c(time)))).first()
        years = [] if low is None else range(low, high + 1)
    by_day = yoy(df, metric, keys=keys, time=time)
    return by_day.groupBy(*keys, "day_of_year").agg(
        *[F.max(F.when(c("year") == y, c(metric))).alias(f"y{y}") for y in years]
    )
