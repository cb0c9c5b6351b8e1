"""Statistics per series: percentiles, densities, extremes, fits, correlations."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.config import PERCENTS
from seriesmill.functions.expressions import c, join_on, ratio, require_columns, volatility_band
from seriesmill.operators.fused import Figures, apart
from seriesmill.operators.layout import KEYS, TIME, choose_layout, join_per_key
from seriesmill.operators.moments import pair_correlations
from seriesmill.operators.reshape import melt


def percentile_name(p: float) -> str:
    return f"q{round(p * 100):02d}"


def percentiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float] = PERCENTS,
    *,
    keys: Sequence[str] = KEYS,
    time: str = TIME,
    layout: str = "auto",
) -> DataFrame:
    """Exact percentiles with linear interpolation, one column per probability.

    The built-in exact percentile keeps every distinct value of a key in one buffer. That
    is fine for a DATE series; otherwise ranks are selected in a distributed way.
    """
    require_columns(df, [value])
    if choose_layout(layout) == "whole":
        return _buffered_percentiles(df, value, probs, list(keys))
    return ranked_percentiles(df, value, probs, keys=keys)


def _buffered_percentiles(
    df: DataFrame, value: str, probs: Sequence[float], keys: list[str]
) -> DataFrame:
    found = df.groupBy(*keys).agg(F.percentile(c(value), list(probs)).alias("_q"))
    return found.select(
        *keys, *[F.col("_q")[i].alias(percentile_name(p)) for i, p in enumerate(probs)]
    )


# Half-width, in rank share, of the band sorted around each wanted rank, and the accuracy
# of the sketch that places it. They steer how much is sorted, never the result.
_BAND = 0.0005
_SKETCH_ACCURACY = 10_000


def ranked_percentiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float] = PERCENTS,
    *,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Exact percentiles of one column without gathering a key."""
    return ranked_percentiles_of(df, [value], probs, keys=keys).drop("metric")


def ranked_percentiles_of(
    df: DataFrame,
    metrics: Sequence[str],
    probs: Sequence[float] = PERCENTS,
    *,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """(keys, metric, q...): exact percentiles of many columns, all selected by rank in the same scans.

    1. Approximate quantiles a little below and above each wanted rank cut each metric's values.
    2. The values up to each cut are counted, for all metrics in one aggregate of the wide rows.
    3. Only values between cuts that hold a wanted rank leave their row; they are shuffled as counts
       per value and sorted.
    Any cuts give the same result, good ones only make the sorted part small. Rows are never
    multiplied by metrics.
    """
    keys, probs, count = list(keys), list(probs), len(metrics)
    values = [f"_v{i}" for i in range(count)]
    rows = df.select(*[c(k) for k in keys], *[c(m).cast("double").alias(v) for m, v in zip(metrics, values)])
    around = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-_BAND, _BAND)})
    cuts = rows.groupBy(*keys).agg(
        *[F.percentile_approx(v, around, _SKETCH_ACCURACY).alias(f"_cuts{i}") for i, v in enumerate(values)]
    )
    upto = join_per_key(rows, cuts, keys).groupBy(*keys).agg(
        *[F.count(v).alias(f"_total{i}") for i, v in enumerate(values)],
        *[F.first(f"_cuts{i}").alias(f"_cuts{i}") for i in range(count)],
        *[
            F.count_if(F.col(v) <= F.col(f"_cuts{i}")[j]).alias(f"_upto{i}_{j}")
            for i, v in enumerate(values) for j in range(len(around))
        ],
    )

    def ranks(total: Column) -> list[Column]:
        places = [(total - 1) * F.lit(float(p)) for p in probs]
        return [f(place).cast("long") for place in places for f in (F.floor, F.ceil)]

    def wanted(i: int) -> Column:
        """The stretches of metric i, from one cut to the next, in which the ranks lie."""
        counts = F.array(*[F.col(f"_upto{i}_{j}") for j in range(len(around))])
        marks, total = F.col(f"_cuts{i}"), F.col(f"_total{i}")

        def stretch(rank: Column) -> Column:
            at = F.size(F.filter(counts, lambda n: n <= rank))
            return F.struct(
                F.when(at > 0, F.try_element_at(marks, F.greatest(at, F.lit(1)))).alias("low"),
                F.try_element_at(marks, at + 1).alias("high"),
                F.when(at > 0, F.try_element_at(counts, F.greatest(at, F.lit(1)))).otherwise(F.lit(0).cast("long")).alias("start"),
                total.alias("total"),
            )

        return F.when(total > 0, F.array_distinct(F.array(*map(stretch, ranks(total)))))

    places = upto.select(*keys, *[wanted(i).alias(f"_wanted{i}") for i in range(count)])

    def held(i: int, metric: str) -> Column:
        v = F.col(values[i])
        found = F.filter(f"_wanted{i}", lambda w: (w["low"].isNull() | (v > w["low"])) & (w["high"].isNull() | (v <= w["high"])))
        found = F.try_element_at(found, F.lit(1))
        return F.struct(F.lit(metric).alias("metric"), v.alias("_v"), found["start"].alias("_start"), found["total"].alias("_total"))

    entries = F.filter(F.array(*[held(i, m) for i, m in enumerate(metrics)]), lambda x: x["_start"].isNotNull() & x["_v"].isNotNull())
    single = join_per_key(rows, places, keys).select(*keys, F.inline(entries))
    counted = single.groupBy(*keys, "metric", "_start", "_total", "_v").agg(F.count(F.lit(1)).alias("_n"))
    so_far = Window.partitionBy(*keys, "metric", "_start").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_first", F.col("_start") + F.sum("_n").over(so_far) - F.col("_n"))

    def pick(rank: Column) -> Column:
        inside = (rank >= F.col("_first")) & (rank < F.col("_first") + F.col("_n"))
        return F.max(F.when(inside, F.col("_v")))

    picked = ranked.groupBy(*keys, "metric").agg(
        F.first("_total").alias("_total"),
        *[pick(rank).alias(f"_at_{i}") for i, rank in enumerate(ranks(F.col("_total")))],
    )

    def between(i: int, p: float) -> Column:
        low, high = F.col(f"_at_{2 * i}"), F.col(f"_at_{2 * i + 1}")
        place = (F.col("_total") - 1) * F.lit(float(p))
        return low + (high - low) * (place - F.floor(place))

    return picked.select(*keys, "metric", *[between(i, p).alias(percentile_name(p)) for i, p in enumerate(probs)])


def volatility_regime(
    df: DataFrame,
    value: str,
    *,
    keys: Sequence[str] = KEYS,
    time: str = TIME,
    layout: str = "auto",
) -> DataFrame:
    """Band of each value among the percentiles of its own series."""
    cuts = percentiles(df, value, keys=keys, time=time, layout=layout)
    names = [percentile_name(p) for p in PERCENTS]
    rows = df.select(*keys, time, c(value))
    if choose_layout(layout) == "whole":
        rows = join_on(rows, cuts, list(keys))
    else:
        rows = join_per_key(rows, cuts, keys)
    return rows.select(
        *keys, time, c(value), volatility_band(c(value), [c(n) for n in names]).alias("band")
    )


def _attach(df: DataFrame, value: str, per_key: DataFrame, keys: list[str], whole: bool) -> DataFrame:
    """(keys, _v, figures) per present value; a whole series is small enough for a plain join."""
    rows = df.where(c(value).isNotNull()).select(*keys, c(value).cast("double").alias("_v"))
    return join_on(rows, per_key, keys) if whole else join_per_key(rows, per_key, keys)


def histogram_density(
    df: DataFrame,
    value: str,
    bins: int = 50,
    *,
    keys: Sequence[str] = KEYS,
    time: str = TIME,
    layout: str = "auto",
) -> DataFrame:
    """Equal-width density histogram; the last bin is closed on the right.

    All bins are returned. A constant series gets a unit-wide range around its value.
    """
    keys = list(keys)
    whole = choose_layout(layout) == "whole"
    x = c(value).cast("double")
    range_ = df.where(c(value).isNotNull()).groupBy(*keys).agg(
        F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count(x).alias("_total")
    )
    pad = F.when(F.col("_lo") == F.col("_hi"), F.lit(0.5)).otherwise(F.lit(0.0))
    range_ = range_.select(
        *keys, "_total", (F.col("_lo") - pad).alias("_lo"), (F.col("_hi") + pad).alias("_hi")
    )
    slot = F.least(
        F.width_bucket(F.col("_v"), F.col("_lo"), F.col("_hi"), F.lit(bins)), F.lit(bins)
    )
    counts = (
        _attach(df, value, range_, keys, whole)
        .groupBy(*keys, slot.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    every_bin = F.sequence(F.lit(1), F.lit(bins)).cast("array<bigint>")
    filled = join_on(range_.withColumn("bin", F.explode(every_bin)), counts, [*keys, "bin"], "left")
    count = F.coalesce(F.col("n"), F.lit(0))
    return filled.select(
        *keys,
        "bin",
        (F.col("_lo") + width * (F.col("bin") - 1)).alias("bin_start"),
        count.alias("n"),
        (count / (F.col("_total") * width)).alias("density"),
    )


# Boxes of values per bandwidth, and terms kept of the expansion around a box's middle.
_BOXES = 8
_TERMS = 24
# Farther from a value, in bandwidths, its kernel is zero in double precision.
_REACH = 40.0


def kde_grid(
    df: DataFrame,
    value: str,
    points: int = 100,
    *,
    keys: Sequence[str] = KEYS,
    time: str = TIME,
    layout: str = "auto",
) -> DataFrame:
    """Gaussian kernel density at evenly spaced points from minimum to maximum.

    Scott bandwidth n^(-1/5) * sample deviation. Series without spread give no rows.

    A row is added to the moments of its box, an eighth of a bandwidth wide; what it costs does not
    depend on ``points``. With u the way from the box's middle to a value and z that to a grid point,
    in bandwidths, the kernel is exp(-z^2/2) exp(-u^2/2) exp(zu), and exp(zu) is 24 terms of its
    series in zu, so a box's values enter as the sums of exp(-u^2/2) u^m. Here |u| <= 1/16 and
    |z| < 40, beyond which kernels are zero, so a kernel's relative error stays below 2e-12 at the
    farthest points that count and below 1e-15 within 20 bandwidths. Boxes, at most one per value,
    are then added to the grid.
    """
    keys = list(keys)
    whole = choose_layout(layout) == "whole"
    x = c(value).cast("double")
    shape = df.where(c(value).isNotNull()).groupBy(*keys).agg(
        F.min(x).alias("_lo"),
        F.max(x).alias("_hi"),
        F.count(x).alias("_total"),
        F.stddev_samp(x).alias("_sd"),
    ).where(F.col("_sd") > 0)
    shape = shape.select(
        *keys,
        "_lo",
        "_total",
        ((F.col("_hi") - F.col("_lo")) / F.lit(float(points - 1))).alias("_step"),
        (F.pow(F.col("_total").cast("double"), F.lit(-0.2)) * F.col("_sd")).alias("_h"),
    )
    figures = ("_lo", "_step", "_h", "_total")
    rows = _attach(df, value, shape, keys, whole).withColumn("_r", (F.col("_v") - F.col("_lo")) / F.col("_h"))
    rows = rows.withColumn("_box", F.floor(F.col("_r") * _BOXES))

    def middle() -> Column:
        return (F.col("_box") + F.lit(0.5)) / F.lit(float(_BOXES))

    rows = rows.withColumn("_u", F.col("_r") - middle())
    terms = [F.exp(F.lit(-0.5) * F.col("_u") * F.col("_u"))]
    for _ in range(_TERMS - 1):
        terms.append(terms[-1] * F.col("_u"))
    boxes = rows.groupBy(*keys, "_box").agg(
        *[F.first(n).alias(n) for n in figures],
        *[(F.sum(term) / F.lit(float(math.factorial(m)))).alias(f"_m{m}") for m, term in enumerate(terms)],
    )
    spread = boxes.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    spread = spread.withColumn("_z", F.col("_step") * F.col("point") / F.col("_h") - middle())
    series = F.col(f"_m{_TERMS - 1}")
    for m in reversed(range(_TERMS - 1)):
        series = series * F.col("_z") + F.col(f"_m{m}")
    kernels = F.when(F.abs("_z") < _REACH, F.exp(F.lit(-0.5) * F.col("_z") * F.col("_z")) * series)
    sums = spread.groupBy(*keys, "point").agg(
        *[F.first(n).alias(n) for n in figures], F.coalesce(F.sum(kernels), F.lit(0.0)).alias("_sum")
    )
    scale = F.col("_total") * F.col("_h") * F.lit(math.sqrt(2 * math.pi))
    return sums.select(
        *keys, "point", (F.col("_lo") + F.col("_step") * F.col("point")).alias("x"), (F.col("_sum") / scale).alias("density")
    )


def mean_median(
    df: DataFrame,
    value: str,
    *,
    keys: Sequence[str] = KEYS,
    time: str = TIME,
    layout: str = "auto",
) -> DataFrame:
    keys = list(keys)
    if choose_layout(layout) == "whole":
        return df.groupBy(*keys).agg(
            F.avg(c(value)).alias("mean"), F.median(c(value)).alias("median")
        )
    mean = df.groupBy(*keys).agg(F.avg(c(value)).alias("mean"))
    middle = ranked_percentiles(df, value, [0.5], keys=keys)
    return join_on(mean, middle.withColumnRenamed(percentile_name(0.5), "median"), keys, "left")


def peak_trough(
    df: DataFrame, value: str, *, keys: Sequence[str] = KEYS, time: str = TIME
) -> DataFrame:
    """Highest and lowest value and the first time each was reached; no row without a value."""
    return apart(df, extreme_figures(value, keys=keys, time=time), keys)


def extreme_figures(value: str, *, keys: Sequence[str] = KEYS, time: str = TIME) -> Figures:
    v, t = c(value), c(time)
    # Least (distance from the extreme, time) first: negating the value lets one minimum
    # pick the highest value at its earliest time.
    high = F.when(v.isNotNull(), F.struct((-v).alias("k"), t.alias("t"), v.alias("v")))
    low = F.when(v.isNotNull(), F.struct(v.alias("v"), t.alias("t")))

    def cut(best: DataFrame) -> DataFrame:
        return best.where(F.col("_peak").isNotNull()).select(
            *keys,
            F.col("_peak.t").alias("peak_time"),
            F.col("_peak.v").alias("peak_value"),
            F.col("_trough.t").alias("trough_time"),
            F.col("_trough.v").alias("trough_value"),
        )

    return Figures({"_peak": F.min(high), "_trough": F.min(low)}, cut)


def ols_fit(df: DataFrame, x: str, y: str, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Least-squares line of y on x."""
    return apart(df, line_figures(x, y), keys)


def line_figures(x: str, y: str) -> Figures:
    fit = {"slope": F.regr_slope, "intercept": F.regr_intercept, "r2": F.regr_r2, "n": F.regr_count}
    return Figures({name: f(c(y), c(x)) for name, f in fit.items()}, lambda totals: totals)


# Up to this many metrics all pairs are built-in aggregates of one pass; more are matrix products.
_FEW_METRICS = 10


def _pair_correlations(
    df: DataFrame, metrics: Sequence[str], keys: Sequence[str], diagonal: bool = False
) -> DataFrame:
    """(pair, a, b, corr) over rows where both are present, for all pairs of the metrics.

    Rows are never laid out as pairs: the moments of all pairs are combined in one aggregate, in
    the tasks that read the rows. A metric that is constant over the shared rows has no correlation.
    """
    require_columns(df, metrics)
    if len(metrics) > _FEW_METRICS:
        found = pair_correlations(df, metrics, keys)
        found = found if diagonal else found.where("i < j")
        names = F.array(*map(F.lit, metrics))
        return found.select(*keys, _pair_number(len(metrics), diagonal).alias("pair"), names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), "corr")
    return apart(df, correlation_figures(metrics, keys=keys, diagonal=diagonal), keys)


def correlation_figures(
    metrics: Sequence[str], *, keys: Sequence[str] = KEYS, diagonal: bool = False
) -> Figures:
    """The matrix of a few metrics as aggregates: one for each pair."""
    choose = combinations_with_replacement if diagonal else combinations
    pairs = list(choose(range(len(metrics)), 2))
    columns = [c(m).cast("double") for m in metrics]

    def moment(i: int, j: int) -> Column:
        both = columns[i].isNotNull() & columns[j].isNotNull()
        x, y = F.when(both, columns[i]), F.when(both, columns[j])
        # merged partial deviations of a constant are not exactly zero
        varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        return F.when(varies, ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))

    entries = F.array(
        *[
            F.struct(F.lit(n).alias("pair"), F.lit(metrics[i]).alias("a"), F.lit(metrics[j]).alias("b"), F.col(f"_r{n}").alias("corr"))
            for n, (i, j) in enumerate(pairs)
        ]
    )
    return Figures(
        {f"_r{n}": moment(*pair) for n, pair in enumerate(pairs)}, lambda found: found.select(*keys, F.inline(entries))
    )


def _pair_number(count: int, diagonal: bool) -> Column:
    """The place of (i, j) among all pairs in order."""
    i, j = F.col("i"), F.col("j")
    if diagonal:
        return (i * count - F.expr("i * (i - 1) div 2") + j - i).cast("int")
    return (i * (count - 1) - F.expr("i * (i - 1) div 2") + j - i - 1).cast("int")


def correlation_matrix(
    df: DataFrame, metrics: Sequence[str], *, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Upper triangle of the pairwise-complete Pearson matrix as (pair, a, b, corr) rows."""
    if len(metrics) < 2:
        raise ValueError("a correlation needs at least two metrics")
    return _pair_correlations(df, list(metrics), keys)


def correlation_full(
    df: DataFrame, metrics: Sequence[str], *, keys: Sequence[str] = KEYS
) -> DataFrame:
    """The whole square matrix as (a, b, corr) rows, diagonal included."""
    upper = _pair_correlations(df, list(metrics), keys, diagonal=True)
    same = c("a") == c("b")
    # A metric against itself is exactly 1, whatever rounding made of it.
    r = F.when(same & c("corr").isNotNull(), F.lit(1.0)).otherwise(c("corr"))
    there = F.struct(c("a").alias("a"), c("b").alias("b"), r.alias("corr"))
    back = F.struct(c("b").alias("a"), c("a").alias("b"), r.alias("corr"))
    both = F.when(same, F.array(there)).otherwise(F.array(there, back))
    return upper.select(*keys, F.inline(both))


def correlation_distance(
    df: DataFrame, metrics: Sequence[str], *, keys: Sequence[str] = KEYS
) -> DataFrame:
    """1 - |r| per pair, the input of a clustering of metrics."""
    pairs = correlation_matrix(df, metrics, keys=keys)
    return pairs.select(*keys, "a", "b", (F.lit(1.0) - F.abs(c("corr"))).alias("distance"))


def top_correlations(
    df: DataFrame, metrics: Sequence[str], k: int = 5, *, keys: Sequence[str] = KEYS
) -> DataFrame:
    """The k highest and k lowest pairs; ties go to the earlier pair."""
    return top_pairs(correlation_matrix(df, metrics, keys=keys), k, keys=keys)


def top_pairs(pairs: DataFrame, k: int = 5, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """The same from a matrix that is there."""
    pairs = pairs.where(c("corr").isNotNull())
    by_key = Window.partitionBy(*keys)
    sides = {"highest": c("corr").desc(), "lowest": c("corr").asc()}
    ranked = pairs.withColumns(
        {side: F.row_number().over(by_key.orderBy(o, c("pair"))) for side, o in sides.items()}
    )
    long = melt(ranked, [*keys, "a", "b", "corr"], {s: {"rank": s} for s in sides}, name="side")
    return long.where(c("rank") <= k)


def describe(
    df: DataFrame,
    metrics: Sequence[str],
    *,
    keys: Sequence[str] = KEYS,
    time: str = TIME,
    layout: str = "auto",
) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per metric."""
    require_columns(df, metrics)
    probs = [0.25, 0.5, 0.75]
    whole = choose_layout(layout) == "whole"
    figures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    if whole:
        figures["_q"] = lambda x: F.percentile(x, probs)
    totals = df.groupBy(*keys).agg(
        *[f(c(m)).alias(f"_{n}_{i}") for i, m in enumerate(metrics) for n, f in figures.items()]
    )
    out = melt(totals, list(keys), {m: {n: f"_{n}_{i}" for n in figures} for i, m in enumerate(metrics)})
    quartiles = {percentile_name(p): f"p{round(p * 100)}" for p in probs}
    if whole:
        out = out.withColumns({n: F.col("_q")[i] for i, n in enumerate(quartiles.values())})
    else:
        ranks = ranked_percentiles_of(df, metrics, probs, keys=keys).withColumnsRenamed(quartiles)
        out = join_on(out, ranks, [*keys, "metric"], "left")
    return out.select(*keys, "metric", "count", "mean", "std", "min", *quartiles.values(), "max")


def dataset_info(
    df: DataFrame, *, keys: Sequence[str] = KEYS, time: str = TIME
) -> DataFrame:
    """Rows, columns, date range and missing values of each series."""
    return apart(df, dataset_figures(df.columns, keys=keys, time=time), keys)


def dataset_figures(
    columns: Sequence[str], *, keys: Sequence[str] = KEYS, time: str = TIME
) -> Figures:
    others = [n for n in columns if n not in keys]
    missing = F.lit(0)
    for n in others:
        missing = missing + c(n).isNull().cast("int")
    return Figures(
        {
            "n_rows": F.count(F.lit(1)),
            "n_columns": F.max(F.lit(len(others)).cast("bigint")),
            "first_time": F.min(c(time)),
            "last_time": F.max(c(time)),
            "missing_values": F.sum(missing),
        },
        lambda totals: totals,
    )
