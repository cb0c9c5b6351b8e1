"""Rolling and lagged features.

A feature is a few layers of columns over one ordered window; layers exist because window
functions cannot nest. ``compute_features`` runs any number of features over one shuffle
and one sort: features of the same depth share a window operator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seriesmill.functions.expressions import c, ratio, require_columns, sign_class
from seriesmill.operators.layout import (
    CHUNK,
    KEYS,
    TIME,
    Ordered,
    choose_layout,
    join_per_key,
    over_series,
    series_order,
)

Layer = Callable[[WindowSpec], dict[str, Column]]

# Frames of more rows than this are put together from block sums; shorter ones are added up.
LONG_FRAME = 128
_PLACE = "_place"


@dataclass(frozen=True)
class OverBlocks:
    """A layer that also needs the names of the columns that windows are partitioned by."""

    build: Callable[[WindowSpec, list[str]], dict[str, Column]]


@dataclass(frozen=True)
class Feature:
    """Named window columns and the rows they look at around the current one."""

    metrics: tuple[str, ...]
    outputs: tuple[str, ...]
    layers: tuple[Layer | OverBlocks, ...]
    before: int = 0
    after: int = 0


def compute_features(
    df: DataFrame,
    features: Iterable[Feature],
    *,
    keys: Sequence[str] = KEYS,
    time: str = TIME,
    seq: str | None = None,
    keep: Sequence[str] | None = None,
    **opts,
) -> DataFrame:
    """Add the columns of all features; ``keep`` names the input columns carried along.

    ``seq`` orders rows of equal time. Other options (``layout``, ``chunk_rows``) go to
    ``over_series``.
    """
    features = list(features)
    needed = list(dict.fromkeys(m for f in features for m in f.metrics))
    require_columns(df, needed)
    kept = list(dict.fromkeys([*keys, time, *(needed if keep is None else keep)]))
    wanted = list(dict.fromkeys([*kept, *needed, *([seq] if seq else [])]))
    depth = max(len(f.layers) for f in features)
    whole = choose_layout(opts.get("layout", "auto")) == "whole" and not isinstance(df, Ordered)
    parts = [*keys] if whole else [*keys, CHUNK]

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        for level in range(depth):
            columns: dict[str, Column] = {}
            for f in features:
                if level < len(f.layers):
                    layer = f.layers[level]
                    columns.update(layer.build(w, parts) if isinstance(layer, OverBlocks) else layer(w))
            rows = rows.withColumns(columns)
        return rows

    built = over_series(
        df.select(*[c(n) for n in wanted]),
        build,
        before=max(f.before for f in features),
        after=max(f.after for f in features),
        keys=keys,
        time=time,
        seq=seq,
        **opts,
    )
    outputs = list(dict.fromkeys(o for f in features for o in f.outputs))
    return built.select(*[c(n) for n in kept], *[c(n) for n in outputs if n not in kept])


def _last(w: WindowSpec, rows: int) -> WindowSpec:
    return w.rowsBetween(-(rows - 1), 0)


def long_frame(value: str, k: int, mean: str, count: str | None = None) -> tuple[Layer | OverBlocks, ...]:
    """Layers for the mean of the last k rows at a cost per row that does not depend on k.

    Rows are cut into blocks of k. A frame is the end of one block and the beginning of the next:
    sums from each row to the end of its block, and from the beginning of the block to the row,
    are running sums, and two of them make a frame. Nothing is ever subtracted.
    """
    name = {x: f"_{mean}_{x}" for x in ("block", "head", "head_n", "tail", "tail_n")}

    def sums(_w: WindowSpec, parts: list[str]) -> dict[str, Column]:
        block = Window.partitionBy(*parts, F.expr(f"{_PLACE} div {k}"))
        ways = {"head": block.orderBy(_PLACE), "tail": block.orderBy(F.desc(_PLACE))}
        found = {}
        for way, w in ways.items():
            so_far = w.rowsBetween(Window.unboundedPreceding, 0)
            found[name[way]] = F.sum(c(value)).over(so_far)
            found[name[f"{way}_n"]] = F.count(c(value)).over(so_far)
        return found

    def frame(w: WindowSpec) -> dict[str, Column]:
        whole = F.col(_PLACE) % k == k - 1  # the frame is the block

        def added(x: str) -> Column:
            tail = F.when(~whole, F.lag(c(name[f"tail{x}"]), k - 1).over(w))
            return F.coalesce(c(name[f"head{x}"]), F.lit(0)) + F.coalesce(tail, F.lit(0))

        return {mean: ratio(added(""), added("_n")), **({count: added("_n")} if count else {})}

    place = lambda w: {_PLACE: F.row_number().over(w).cast("bigint") - 1}
    return place, OverBlocks(sums), frame


# --- feature definitions -----------------------------------------------------


def average_of(metric: str, windows: Sequence[int] = (7, 30, 90)) -> Feature:
    """Mean of the last k rows; partial at the start of a series, NULLs skipped.

    A sliding frame is added up again for every row. A window that is a few times a
    shorter one is put together from the shorter one's sums instead, and a long one from
    the sums of blocks; only additions are used, so no digits cancel.
    """
    names = {k: f"{metric}_MA{k}days" for k in windows}
    before = max(windows) - 1
    long_windows = [k for k in windows if k > LONG_FRAME]
    if long_windows:
        short_windows = [k for k in windows if k <= LONG_FRAME]
        short_layers = average_of(metric, short_windows).layers if short_windows else ()
        layers = [short_layers, *[long_frame(metric, k, names[k]) for k in long_windows]]
        return Feature((metric,), tuple(names.values()), _side_by_side(layers), before=before)
    parts = {k: _divisor(k, windows) for k in windows}
    shared = {p for p in parts.values() if p}

    def total(k: int) -> str:
        return f"_{metric}_sum{k}"

    def count(k: int) -> str:
        return f"_{metric}_count{k}"

    def short(w: WindowSpec) -> dict[str, Column]:
        columns = {}
        for k, name in names.items():
            if k in shared:
                columns[total(k)] = F.sum(c(metric)).over(_last(w, k))
                columns[count(k)] = F.count(c(metric)).over(_last(w, k))
            elif not parts[k]:
                columns[name] = F.avg(c(metric)).over(_last(w, k))
        return columns

    def long(w: WindowSpec) -> dict[str, Column]:
        columns = {names[k]: ratio(c(total(k)), c(count(k))) for k in shared}
        for k, part in parts.items():
            if part:
                columns[names[k]] = ratio(
                    _sum_of_lags(total(part), part, k, w), _sum_of_lags(count(part), part, k, w)
                )
        return columns

    return Feature(
        (metric,),
        tuple(names.values()),
        (short, long) if shared else (short,),
        before=before,
    )


def _side_by_side(columns: Sequence[Sequence[Layer | OverBlocks]]) -> tuple[OverBlocks, ...]:
    """Layers of several lists at the same depth as one."""

    def at(depth: int) -> OverBlocks:
        def build(w: WindowSpec, parts: list[str]) -> dict[str, Column]:
            found: dict[str, Column] = {}
            for layers in columns:
                if depth < len(layers):
                    layer = layers[depth]
                    found.update(layer.build(w, parts) if isinstance(layer, OverBlocks) else layer(w))
            return found

        return OverBlocks(build)

    return tuple(at(depth) for depth in range(max(map(len, columns))))


def _divisor(k: int, windows: Sequence[int]) -> int | None:
    """The longest shorter window that fits into k a whole number of times, at most 8."""
    fits = [p for p in windows if 1 < p < k and k % p == 0 and k // p <= 8]
    direct = [p for p in fits if not any(1 < q < p and p % q == 0 for q in windows)]
    return max(direct, default=None)


def _sum_of_lags(name: str, part: int, k: int, w: WindowSpec) -> Column:
    blocks = [F.coalesce(c(name), F.lit(0))]
    blocks += [F.coalesce(F.lag(c(name), step).over(w), F.lit(0)) for step in range(part, k, part)]
    return reduce(lambda a, b: a + b, blocks)


def lag_of(metric: str, n: int) -> Feature:
    name = f"{metric}_lag{n}"
    return Feature((metric,), (name,), (lambda w: {name: F.lag(c(metric), n).over(w)},), before=n)


def return_of(metric: str, n: int) -> Feature:
    """Simple return over n rows; NULL where the base is missing or zero."""
    name = f"{metric}_return{n}"
    return Feature(
        (metric,),
        (name,),
        (lambda w: {name: ratio(c(metric), F.lag(c(metric), n).over(w)) - 1},),
        before=n,
    )


def volatility_of(metric: str, lag: int = 7, window: int = 30) -> Feature:
    """Return, its rolling mean, the lag, and rolling volatility.

    Each squared deviation is taken from the rolling mean of its own row, so this is not
    the standard deviation of the frame.
    """
    ret = f"{metric}_return{lag}"
    mean = f"{metric}_return{lag}_mean{window}"
    lagged = f"{metric}_lag{lag}"
    vol = f"{metric}_RV{window}_return{lag}"

    def squared_deviation() -> Column:
        return (c(ret) - c(mean)) * (c(ret) - c(mean))

    def returns(w: WindowSpec) -> dict[str, Column]:
        return {
            ret: ratio(c(metric), F.lag(c(metric), lag).over(w)) - 1,
            lagged: F.lag(c(metric), lag).over(w),
        }

    if window > LONG_FRAME:
        squared = f"_{vol}_squared"
        layers = (
            returns, *long_frame(ret, window, mean), lambda w: {squared: squared_deviation()},
            *long_frame(squared, window, vol), lambda w: {vol: F.sqrt(c(vol))},
        )
    else:
        layers = (
            returns,
            lambda w: {mean: F.avg(c(ret)).over(_last(w, window))},
            lambda w: {vol: F.sqrt(F.avg(squared_deviation()).over(_last(w, window)))},
        )
    return Feature((metric,), (ret, mean, lagged, vol), layers, before=2 * (window - 1) + lag)


def delta_of(metric: str, n: int = 30) -> Feature:
    """Absolute and percent change over n rows."""
    delta, pct = f"{metric}_delta_{n}d", f"{metric}_pct_change_{n}d"

    def change(w: WindowSpec) -> dict[str, Column]:
        base = F.lag(c(metric), n).over(w)
        return {delta: c(metric) - base, pct: ratio(c(metric) - base, base) * 100}

    return Feature((metric,), (delta, pct), (change,), before=n)


def difference_of(metric: str, name: str | None = None) -> Feature:
    name = name or f"{metric}_diff"
    return Feature(
        (metric,), (name,), (lambda w: {name: c(metric) - F.lag(c(metric), 1).over(w)},), before=1
    )


def change_rate_of(metric: str, n: int = 1, name: str | None = None) -> Feature:
    """(x - x_lag) / x_lag."""
    name = name or f"{metric}_change_rate{n}"

    def rate(w: WindowSpec) -> dict[str, Column]:
        base = F.lag(c(metric), n).over(w)
        return {name: ratio(c(metric) - base, base)}

    return Feature((metric,), (name,), (rate,), before=n)


# --- operators ---------------------------------------------------------------


def moving_average(
    df: DataFrame, metric: str, windows: Sequence[int] = (7, 30, 90), **opts
) -> DataFrame:
    """``metric`` and its k-row means side by side, from one window operator (no joins)."""
    return compute_features(df, [average_of(metric, windows)], **opts)


def lag_feature(df: DataFrame, metric: str, n: int = 1, **opts) -> DataFrame:
    return compute_features(df, [lag_of(metric, n)], **opts)


def lag_return(df: DataFrame, metric: str, n: int = 1, **opts) -> DataFrame:
    return compute_features(df, [return_of(metric, n)], **opts)


def return_and_volatility(
    df: DataFrame, metric: str, lag: int = 7, window: int = 30, **opts
) -> DataFrame:
    """Rows with all of value, return, mean, lag and volatility; incomplete rows are left out."""
    feature = volatility_of(metric, lag, window)
    out = compute_features(df, [feature], **opts)
    if isinstance(out, Ordered):
        complete = reduce(lambda a, b: a & b, [c(n).isNotNull() for n in (metric, *feature.outputs)])
        return out.keep(complete)
    return out.na.drop("any", subset=[metric, *feature.outputs])


def rolling_delta(df: DataFrame, metric: str, window: int = 30, **opts) -> DataFrame:
    return compute_features(df, [delta_of(metric, window)], keep=(), **opts)


def first_difference(df: DataFrame, metric: str, **opts) -> DataFrame:
    return compute_features(df, [difference_of(metric)], **opts)


def change_rate(df: DataFrame, metric: str, n: int = 1, **opts) -> DataFrame:
    return compute_features(df, [change_rate_of(metric, n)], **opts)


def delta_sign(df: DataFrame, metric: str, window: int = 30, **opts) -> DataFrame:
    """Rolling delta with its sign class, and the tie-break where there is one."""
    tie = [opts["seq"]] if opts.get("seq") else []
    out = compute_features(df, [delta_of(metric, window)], keep=tie, **opts)
    delta = f"{metric}_delta_{window}d"
    keys = list(opts.get("keys", KEYS))
    return out.select(
        *keys, opts.get("time", TIME), *map(c, tie), c(delta),
        sign_class(c(delta)).alias("delta_class"),
    )


def strict_mean_of(metric: str, k: int, name: str, direction: str, source: Feature) -> Feature:
    """Mean of k rows of a feature's first output, NULL unless all k are present."""
    if direction not in ("leading", "trailing"):
        raise ValueError(f"unknown direction: {direction}")
    value = source.outputs[0]

    def strict(w: WindowSpec) -> dict[str, Column]:
        frame = w.rowsBetween(0, k - 1) if direction == "leading" else _last(w, k)
        full = F.count(c(value)).over(frame) == k
        return {name: F.when(full, F.avg(c(value)).over(frame))}

    def strict_long(w: WindowSpec) -> dict[str, Column]:
        mean, count = c(f"_{name}_mean"), c(f"_{name}_count")
        if direction == "leading":
            mean, count = F.lead(mean, k - 1).over(w), F.lead(count, k - 1).over(w)
        return {name: F.when(count == k, mean)}

    reach = k - 1
    last = (strict,)
    if k > LONG_FRAME:
        last = (*long_frame(value, k, f"_{name}_mean", f"_{name}_count"), strict_long)
    return Feature(
        source.metrics,
        (*source.outputs, name),
        (*source.layers, *last),
        # of a long leading frame, the trailing one at its end is moved back
        before=source.before + (0 if direction == "leading" and k <= LONG_FRAME else reach),
        after=source.after + (reach if direction == "leading" else 0),
    )


def delta_strict_mean(
    df: DataFrame,
    metric: str,
    window: int = 30,
    k: int = 7,
    direction: str = "leading",
    **opts,
) -> DataFrame:
    """k-row mean of the rolling delta.

    ``leading`` averages the current row and the k-1 newer ones, which is what a rolling
    mean over newest-first rows gives; ``trailing`` looks back.
    """
    name = f"{metric}_delta_{window}d_mean{k}"
    feature = strict_mean_of(metric, k, name, direction, delta_of(metric, window))
    out = compute_features(df, [feature], keep=(), **opts)
    return out.drop(f"{metric}_pct_change_{window}d")


def growth_from_base(
    df: DataFrame,
    columns: Sequence[str],
    *,
    keys: Sequence[str] = KEYS,
    time: str = TIME,
    seq: str | None = None,
    layout: str = "auto",
) -> DataFrame:
    """Percent growth since the first row of the series; NULL on a zero or missing base."""
    require_columns(df, columns)
    keys = list(keys)
    tie = [seq] if seq and seq not in columns else []
    rows = df.select(*keys, time, *[c(n) for n in (*columns, *tie)])
    bases = [f"_base_{i}" for i in range(len(columns))]
    if choose_layout(layout) == "whole":
        in_order = Window.partitionBy(*keys).orderBy(*series_order(time, seq))
        from_start = in_order.rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns(
            {b: F.first(c(n)).over(from_start) for b, n in zip(bases, columns)}
        )
    else:
        first = rows.groupBy(*keys).agg(
            F.min_by(
                F.struct(*[c(n).alias(b) for b, n in zip(bases, columns)]),
                F.struct(*series_order(time, seq)),
            ).alias("_first")
        )
        rows = join_per_key(rows, first.select(*keys, "_first.*"), keys)
    return rows.select(
        *keys,
        time,
        *[
            ((ratio(c(n), F.col(b)) - 1) * 100).alias(f"{n}_growth_pct")
            for n, b in zip(columns, bases)
        ],
    )
