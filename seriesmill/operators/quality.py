"""Data-quality checks over wide metric frames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seriesmill.functions.expressions import c, elapsed_days, is_date, present_columns, require_columns
from seriesmill.operators.fused import Figures, apart
from seriesmill.operators.layout import KEYS, TIME, choose_layout, frame_of, ordered, over_series
from seriesmill.operators.reshape import melt
from seriesmill.operators.spans import flat_spans


def gaps(
    df: DataFrame,
    max_days: float = 1.0,
    *,
    keys: Sequence[str] = KEYS,
    time: str = TIME,
    seq: str | None = None,
    **opts,
) -> DataFrame:
    """Steps longer than ``max_days`` between successive rows."""
    dates = is_date(df, time)

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.withColumn("gap_start", F.lag(c(time), 1).over(w))

    rows = over_series(
        df.select(*keys, time, *([seq] if seq else [])),
        build, before=1, keys=keys, time=time, seq=seq, **opts,
    )
    days = elapsed_days(F.col("gap_start"), c(time), dates)
    return frame_of(rows).select(
        *keys, "gap_start", c(time).alias("gap_end"), days.alias("days_gap")
    ).where(F.col("days_gap") > max_days)


def _zero_or_null(name: str) -> Column:
    return F.count_if(c(name).isNull() | (c(name) == 0))


def zero_null_stats(
    df: DataFrame, metrics: Sequence[str], *, keys: Sequence[str] = KEYS, time: str = TIME
) -> DataFrame:
    """Row count, zero-or-NULL count and date range per key and metric, in one aggregate."""
    require_columns(df, metrics)
    return apart(df, zero_null_figures(metrics, keys=keys, time=time), keys)


def zero_null_figures(metrics: Sequence[str], *, keys: Sequence[str] = KEYS, time: str = TIME) -> Figures:
    zero = {m: f"_zero_{i}" for i, m in enumerate(metrics)}
    span = {"total_records": F.count(F.lit(1)), "earliest": F.min(c(time)), "latest": F.max(c(time))}
    each = {m: {"zero_count": zero[m]} for m in metrics}
    return Figures(
        {**span, **{zero[m]: _zero_or_null(m) for m in metrics}}, lambda totals: melt(totals, [*keys, *span], each)
    )


def _flat_layers(
    metrics: Sequence[str], k: int
) -> tuple[dict[str, str], Callable[[DataFrame, WindowSpec], DataFrame]]:
    """Per metric, how many rows in a row repeat the one before them, up to k.

    The row of the last change is carried along in a frame that grows, which costs one step per
    row and metric. A chunk sees k rows before its own, and its first row counts as a change: that
    is k rows back at least, so a longer run still comes to k.
    """
    names = {m: f"_same_{i}" for i, m in enumerate(metrics)}

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        at = F.row_number().over(w).cast("bigint")
        same = {n: c(m) == F.lag(c(m), 1).over(w) for m, n in names.items()}
        rows = rows.withColumns({"_at": at, **same})
        changed = {
            n: F.when(F.col(n), F.lit(None).cast("bigint")).otherwise(F.col("_at"))
            for n in names.values()
        }
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns(
            {n: F.last(x, ignorenulls=True).over(so_far) for n, x in changed.items()}
        )
        return rows.withColumns(
            {n: F.least(F.col("_at") - F.col(n), F.lit(k)) for n in names.values()}
        )

    return names, build


def flat_runs(
    df: DataFrame,
    metrics: Sequence[str],
    k: int = 7,
    *,
    keys: Sequence[str] = KEYS,
    time: str = TIME,
    seq: str | None = None,
    **opts,
) -> DataFrame:
    """Rows ending k unchanged steps, that is k+1 equal values in a row."""
    require_columns(df, metrics)
    names, build = _flat_layers(metrics, k)
    rows = over_series(
        df.select(*keys, time, *[c(m) for m in metrics], *([seq] if seq else [])),
        build, before=k, keys=keys, time=time, seq=seq, **opts,
    )
    long = melt(
        frame_of(rows), [*keys, time], {m: {"value": m, "unchanged_count": names[m]} for m in metrics}
    )
    return long.where(F.col("unchanged_count") == k)


def quality_report(
    df: DataFrame,
    metrics: Sequence[str],
    k: int = 7,
    max_days: float = 1.0,
    *,
    keys: Sequence[str] = KEYS,
    time: str = TIME,
    seq: str | None = None,
    layout: str = "auto",
    details: bool = False,
    **opts,
) -> DataFrame:
    """One row per key and metric: records, date range, gaps, zeros and repeated values.

    All metrics go through one window pass in wide form, so a row is shuffled once and not
    once per metric. ``details`` adds the gaps and repeats themselves as arrays; only for
    DATE series, where the calendar bounds them. ``gaps`` and ``flat_runs`` give the same
    as rows for any series, ``largest_issues`` a bounded list.
    """
    require_columns(df, metrics)
    dates = is_date(df, time)
    if details and not dates:
        raise ValueError("details=True needs a DATE series; use gaps(), flat_runs() or largest_issues()")
    names, flat = _flat_layers(metrics, k)

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return flat(rows.withColumn("_previous", F.lag(c(time), 1).over(w)), w)

    rows = over_series(
        df.select(*keys, time, *[c(m) for m in metrics], *([seq] if seq else [])),
        build, before=k, keys=keys, time=time, seq=seq, layout=layout, **opts,
    )
    rows = frame_of(rows).withColumn("_step", elapsed_days(F.col("_previous"), c(time), dates))
    gap = F.col("_step") > max_days
    zero = {m: f"_zero_{i}" for i, m in enumerate(metrics)}
    flats = {m: f"_flat_{i}" for i, m in enumerate(metrics)}
    lists = {m: f"_list_{i}" for i, m in enumerate(metrics)}
    extra = []
    if details:
        step = F.struct(F.col("_step").alias("days_gap"), c(time).alias("gap_end"))
        extra.append(F.sort_array(F.collect_list(F.when(gap, step)), asc=False).alias("gaps"))
        extra += [
            F.sort_array(
                F.collect_list(
                    F.when(
                        F.col(names[m]) == k,
                        F.struct(
                            c(time).alias("time"), c(m).alias("value"),
                            F.col(names[m]).alias("unchanged_count"),
                        ),
                    )
                )
            ).alias(lists[m])
            for m in metrics
        ]
    totals = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.struct(F.min(time).alias("start"), F.max(time).alias("end")).alias("date_range"),
        F.count_if(gap).alias("gap_count"),
        *[_zero_or_null(m).alias(zero[m]) for m in metrics],
        *[F.count_if(F.col(names[m]) == k).alias(flats[m]) for m in metrics],
        *extra,
    )
    shared = [*keys, "total_records", "date_range", "gap_count"] + (["gaps"] if details else [])
    outputs = {m: {"zero_count": zero[m], "repeated_values_count": flats[m]} for m in metrics}
    if details:
        for m in metrics:
            outputs[m]["details"] = lists[m]
    return melt(totals, shared, outputs, name="feature")


def largest_issues(
    df: DataFrame,
    metrics: Sequence[str],
    k: int = 7,
    max_days: float = 1.0,
    most: int = 10,
    *,
    keys: Sequence[str] = KEYS,
    time: str = TIME,
    seq: str | None = None,
    **opts,
) -> DataFrame:
    """The details of a report of any series: its longest gaps, and per metric its longest flat runs.

    (keys, feature, issue, rank, start, end, size): ``size`` is days for a gap, rows for a run; at
    most ``most`` of each, so the list of a series is bounded whatever its length. Gaps have no
    feature. Tasks keep no more of a series before the shuffle. One sort serves gaps and all metrics.
    """
    require_columns(df, metrics)
    wanted = [*keys, time, *metrics, *([seq] if seq else [])]
    rows = df.select(*[c(n) for n in wanted])
    if choose_layout(opts.get("layout", "auto")) != "whole":
        rows = ordered(rows, keys=keys, time=time, seq=seq)
    how = {"keys": keys, "time": time, "seq": seq, **opts}
    missing = gaps(rows, max_days, **how).select(
        *keys, F.lit(None).cast("string").alias("feature"), F.lit("gap").alias("issue"), F.col("gap_start").alias("start"),
        F.col("gap_end").alias("end"), F.col("days_gap").alias("size"),
    )
    flat = flat_spans(rows, metrics, k, **how).select(
        *keys, F.col("metric").alias("feature"), F.lit("flat").alias("issue"), "start", "end", F.col("n_rows").cast("double").alias("size")
    )
    longest = Window.partitionBy(*keys, "feature", "issue").orderBy(F.desc("size"), "start", "end")
    ranked = missing.unionByName(flat).withColumn("rank", F.row_number().over(longest))
    return ranked.where(F.col("rank") <= most)


@dataclass(frozen=True)
class Rule:
    """A cross-metric condition that should never hold."""

    name: str
    broken: Column
    severity: str


def holder_rules() -> list[Rule]:
    return [
        Rule(
            "over_100k_exceeds_total",
            c("AdrBalUSD100KCnt") > c("AdrBalCnt"),
            "warning",
        ),
        Rule(
            "over_1m_exceeds_over_100k",
            c("AdrBalUSD1MCnt") > c("AdrBalUSD100KCnt"),
            "error",
        ),
    ]


def consistency(
    df: DataFrame,
    rules: Sequence[Rule] | None = None,
    *,
    keys: Sequence[str] = KEYS,
    time: str = TIME,
) -> DataFrame:
    """Per key and rule: rows that break it, and whether the latest row does."""
    return apart(df, consistency_figures(rules, keys=keys, time=time), keys)


def consistency_figures(
    rules: Sequence[Rule] | None = None, *, keys: Sequence[str] = KEYS, time: str = TIME
) -> Figures:
    rules = holder_rules() if rules is None else list(rules)
    count = {r.name: f"_count_{i}" for i, r in enumerate(rules)}
    latest = {r.name: f"_latest_{i}" for i, r in enumerate(rules)}
    severity = {r.name: f"_severity_{i}" for i, r in enumerate(rules)}
    columns = {count[r.name]: F.count_if(r.broken) for r in rules}
    columns |= {latest[r.name]: F.max_by(F.coalesce(r.broken, F.lit(False)), c(time)) for r in rules}
    outputs = {
        r.name: {
            "severity": severity[r.name],
            "violations": count[r.name],
            "latest_violates": latest[r.name],
        }
        for r in rules
    }

    def cut(totals: DataFrame) -> DataFrame:
        totals = totals.withColumns({severity[r.name]: F.lit(r.severity) for r in rules})
        return melt(totals, list(keys), outputs, name="rule")

    return Figures(columns, cut)


def null_counts(
    df: DataFrame, columns: Sequence[str], *, keys: Sequence[str] = KEYS
) -> DataFrame:
    return apart(df, null_figures(columns, keys=keys), keys)


def null_figures(columns: Sequence[str], *, keys: Sequence[str] = KEYS) -> Figures:
    return _count_each(columns, keys, lambda n: c(n).isNull(), "null_count")


def nonpositive_counts(
    df: DataFrame, columns: Sequence[str], *, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Values at or below zero; columns that are absent are skipped."""
    return apart(df, nonpositive_figures(present_columns(df, columns), keys=keys), keys)


def nonpositive_figures(columns: Sequence[str], *, keys: Sequence[str] = KEYS) -> Figures:
    return _count_each(columns, keys, lambda n: c(n) <= 0, "nonpositive_count")


def _count_each(
    columns: Sequence[str], keys: Sequence[str], test: Callable[[str], Column], output: str
) -> Figures:
    names = {n: f"_count_{i}" for i, n in enumerate(columns)}
    return Figures(
        {names[n]: F.count_if(test(n)) for n in columns},
        lambda totals: melt(totals, list(keys), {n: {output: names[n]} for n in columns}),
    )


def latest_summary(
    df: DataFrame, columns: Sequence[str], *, keys: Sequence[str] = KEYS, time: str = TIME
) -> DataFrame:
    """The newest row of each series."""
    return apart(df, latest_figures(columns, keys=keys, time=time), keys)


def latest_figures(columns: Sequence[str], *, keys: Sequence[str] = KEYS, time: str = TIME) -> Figures:
    newest = F.max_by(F.struct(c(time), *[c(n) for n in columns]), c(time))
    return Figures({"_newest": newest}, lambda totals: totals.select(*[c(k) for k in keys], "_newest.*"))
