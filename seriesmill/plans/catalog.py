"""Every operator as a named query over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmill import fixtures
from seriesmill.config import CORRELATION_METRICS, INDICATORS, PERCENTS, TIERS, Settings
from seriesmill.functions.expressions import c, chart_columns, columns_with_values, mvrv_zone, numeric_columns
from seriesmill.operators import append, cleaning, fused, indicators, quality, reshape, sketches, spans, stats, windows
from seriesmill.operators.layout import frame_of, join_per_key, ordered
from seriesmill.operators.reshape import melt
from seriesmill.sources import csv, results, tables, versions
from seriesmill.sources.scratch import scratch_path, written

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

HOLDERS = ("AdrBalCnt", "AdrBalUSD10KCnt", "AdrBalUSD100KCnt", "AdrBalUSD1MCnt")
ZERO_PRONE = ("AdrActCnt", "AdrBalUSD10KCnt", "AdrBalUSD100KCnt", "AdrBalUSD1MCnt")
SUPPLY = (*indicators.SUPPLY_METRICS, indicators.WHALE_METRIC)
QUALITY_METRICS = ("PriceUSD", "TxCnt", "AdrActCnt", "AdrBal1in10KCnt", *HOLDERS[1:])
DESCRIBED = ("PriceUSD", "TxCnt", "CapMVRVCur")
ALL_METRICS = (*fixtures.BASE_METRICS, *fixtures.PRICE_METRICS)
LOOKBACK_AS_OF = date(2001, 8, 1)
HALF_HOUR = 1 / 48
# One row per asset and day: the calendar bounds a window partition.
WHOLE = {"layout": "whole"}
# Several chunks per series even on small data.
CHUNKED = {"layout": "chunked", "chunk_rows": 500}


def present(df: DataFrame) -> DataFrame:
    """Comparable output: single-precision values, text times, 64-bit integers.

    Engines add in different orders, so doubles agree to about 15 digits; they are shown with
    the 24 bits of a float, whatever their size. Adding zero turns a negative zero into a
    plain one.
    """

    def shown(field: T.StructField):
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = c(field.name).cast("float").cast("double") + F.lit(0.0)
        elif isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            value = c(field.name).cast("string")
        elif isinstance(field.dataType, T.IntegralType):
            value = c(field.name).cast("bigint")
        else:
            value = c(field.name)
        return value.alias(field.name)

    return df.select(*[shown(f) for f in df.schema.fields])


def query(name: str) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(run(spark, sf_dir))

        QUERIES[name] = shown
        return run

    return register


def daily(spark: SparkSession, sf_dir: str, *metrics: str) -> DataFrame:
    return fixtures.daily_metrics(spark, sf_dir, metrics)


# --- sources and sinks ---------------------------------------------------------


@query("src_csv")
def src_csv(spark, sf_dir):
    """CSVs per asset in two column orders, written and read back by name."""
    rows = daily(spark, sf_dir, "PriceUSD", "TxCnt")
    path = scratch_path(spark, "csv")
    later = F.col("asset") >= "3"
    for part, names in ((~later, ("time", "PriceUSD", "TxCnt")), (later, ("TxCnt", "time", "PriceUSD"))):
        rows.where(part).select("asset", *names).write.mode("append").partitionBy("asset").option(
            "header", True
        ).csv(path)
    read = csv.read_metric_csvs(spark, path, asset_pattern=csv.FOLDER_NAME)
    return read.drop("seq")


@query("lookback_filter")
def lookback_filter(spark, sf_dir):
    return cleaning.lookback(daily(spark, sf_dir, "PriceUSD"), LOOKBACK_AS_OF, 730)


@query("sink_table")
def sink_table(spark, sf_dir):
    """Write all assets, replace some with corrected rows, read the table back."""
    rows = daily(spark, sf_dir, "PriceUSD", "TxCnt")
    path = scratch_path(spark, "table")
    tables.write_table(rows, path)
    urgent = rows.where(F.col("asset") == "1-URGENT").withColumn("TxCnt", F.col("TxCnt") + 1)
    tables.write_table(urgent, path)
    return tables.read_table(spark, path, rows.schema)


@query("csv_line_breaks")
def csv_line_breaks(spark, sf_dir):
    """Files with a text column whose quoted cells hold line breaks, quotes and blank lines."""
    rows = daily(spark, sf_dir, "PriceUSD")
    day = F.date_format("time", "yyyy-MM-dd")
    note = F.concat(F.col("asset"), F.lit('\n\n"'), day, F.lit('", noted'))
    rows = rows.withColumn("Note", F.when(F.dayofmonth("time") % 3 > 0, note))
    path = scratch_path(spark, "csv")
    rows.repartition("asset").write.partitionBy("asset").option("header", True).option("escape", '"').csv(path)
    return csv.read_metric_csvs(spark, path, asset_pattern=csv.FOLDER_NAME, text_columns=("Note",)).drop("seq")


def _two_versions(spark, sf_dir):
    """All assets, then one corrected and one that failed to load."""
    rows = daily(spark, sf_dir, "TxCnt")
    path = scratch_path(spark, "versions")
    versions.replace(rows, path)
    urgent = rows.where(F.col("asset") == "1-URGENT").withColumn("TxCnt", F.col("TxCnt") + 1)
    status = spark.createDataFrame([("1-URGENT", "ok", ""), ("2-HIGH", "skipped", "no such number")], "asset string, status string, detail string")
    versions.replace(urgent, path, status)
    return path


@query("table_versions")
def table_versions(spark, sf_dir):
    path = _two_versions(spark, sf_dir)
    now, before = versions.read_version(spark, path), versions.read_version(spark, path, 1)
    return now.withColumn("version", F.lit(2)).unionByName(before.withColumn("version", F.lit(1)))


@query("load_status")
def load_status(spark, sf_dir):
    """What each version did with each asset."""
    rows = versions.history(spark, _two_versions(spark, sf_dir))
    return rows.select("version", "asset", "status", "detail", "n_rows", "first_time", "last_time")


@query("sink_csv")
def sink_csv(spark, sf_dir):
    settings = Settings(delta_metrics=("PriceUSD", "AdrActCnt"))
    rows = daily(spark, sf_dir, *settings.delta_metrics)
    path = scratch_path(spark, "results")
    made = results.feature_results(rows, "rolling_deltas", settings, **WHOLE)
    results.write_results(made, path, "rolling_deltas", "csv")
    return results.read_results(spark, path, "rolling_deltas", "csv", settings)


@query("src_results")
def src_results(spark, sf_dir):
    settings = Settings(aggregate_metrics=ALL_METRICS)
    path = scratch_path(spark, "results")
    rows = daily(spark, sf_dir, *ALL_METRICS)
    made = results.feature_results(rows, "moving_averages", settings, **WHOLE)
    results.write_results(made, path, "moving_averages")
    return results.read_results(spark, path, "moving_averages", settings=settings)


@query("feature_lag_volatility")
def feature_lag_volatility(spark, sf_dir):
    settings = Settings()
    rows = daily(spark, sf_dir, *settings.lag_metrics)
    return results.feature_results(rows, "lag_volatility", settings, **WHOLE)


@query("feature_rolling_deltas")
def feature_rolling_deltas(spark, sf_dir):
    settings = Settings()
    rows = daily(spark, sf_dir, *settings.delta_metrics)
    return results.feature_results(rows, "rolling_deltas", settings, **WHOLE)


@query("categorize")
def categorize(spark, sf_dir):
    """Result names as a run would give them, per asset, metric and kind."""
    rows = daily(spark, sf_dir, "PriceUSD", "AdrActCnt")
    long = reshape.to_long(rows, ["PriceUSD", "AdrActCnt"]).groupBy("asset", "metric").agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    kinds = F.array(*[F.lit(k) for k in (*results.KINDS, "notes")])
    names = long.withColumn("kind", F.explode(kinds)).select(
        F.concat_ws("_", "asset", "metric", "kind").alias("file_name"), "n_rows"
    )
    return results.categorize(names)


@query("list_tables")
def list_tables(spark, sf_dir):
    """Write a table under a name, find it in the list, and say what it holds."""
    path = scratch_path(spark, "listed")
    name = path.rpartition("/")[2].replace("-", "_")
    tables.write_table(daily(spark, sf_dir, "PriceUSD"), path, name=name)
    stored = [spark.table(n) for n in tables.list_tables(spark) if n == name]
    return tables.stored_series(stored[0])


@query("preview")
def preview(spark, sf_dir):
    return tables.preview_each(daily(spark, sf_dir, "PriceUSD", "TxCnt"), 10)


@query("ordered_by_time")
def ordered_by_time(spark, sf_dir):
    """Every row with its place in its series."""
    return ordered(daily(spark, sf_dir, "PriceUSD")).rows.withColumnRenamed("_pos", "position").drop("_last")


@query("numeric_values")
def numeric_values(spark, sf_dir):
    """Values per numeric column, found by type among columns of several types."""
    rows = daily(spark, sf_dir, "PriceUSD", "TxCnt", "ROI1yr").withColumns({"note": F.lit("x"), "small": F.lit(1).cast("tinyint")})
    names = numeric_columns(rows)
    counts = rows.groupBy("asset").agg(*[F.count(c(n)).alias(n) for n in names])
    return melt(counts, ["asset"], {n: {"n_values": n} for n in names})


@query("metrics_with_values")
def metrics_with_values(spark, sf_dir):
    """Of the wanted metrics one is absent and one has no values: the others are kept."""
    rows = daily(spark, sf_dir, "PriceUSD", "TxCnt").withColumn("AdrActCnt", F.lit(None).cast("double"))
    rows = written(rows, "metrics")
    return rows.select("asset", "time", *map(c, columns_with_values(rows, ("PriceUSD", "AdrActCnt", "CapMVRVCur", "TxCnt"))))


@query("chart_columns")
def chart_columns_query(spark, sf_dir):
    """The columns a chart of changes would show, out of those of two features."""
    features = [windows.average_of("PriceUSD", (7,)), windows.delta_of("PriceUSD")]
    made = windows.compute_features(daily(spark, sf_dir, "PriceUSD", "TxCnt"), features, keep=("PriceUSD", "TxCnt"), **WHOLE)
    return made.select("asset", "time", *map(c, chart_columns(made, ("DELTA", "pct"))))


# --- cleaning ------------------------------------------------------------------


@query("clean_nonfinite")
def clean_nonfinite(spark, sf_dir):
    return cleaning.clean_nonfinite(fixtures.daily_metrics_dirty(spark, sf_dir), ["v"])


@query("interpolate_linear")
def interpolate_linear(spark, sf_dir):
    rows = cleaning.clean_nonfinite(fixtures.daily_metrics_dirty(spark, sf_dir), ["v"])
    return cleaning.interpolate_linear(rows, ["v"], seq="seq")


@query("dedup_keep_last")
def dedup_keep_last(spark, sf_dir):
    rows = cleaning.clean_nonfinite(fixtures.daily_metrics_dirty(spark, sf_dir), ["v"])
    return cleaning.dedup_keep_last(rows, seq="seq")


@query("clean_series")
def clean_series(spark, sf_dir):
    return cleaning.clean(fixtures.daily_metrics_dirty(spark, sf_dir), ["v"], seq="seq")


# --- windows -------------------------------------------------------------------


@query("moving_average")
def moving_average(spark, sf_dir):
    return windows.moving_average(daily(spark, sf_dir, "PriceUSD"), "PriceUSD", [7], **WHOLE)


@query("moving_average_multi")
def moving_average_multi(spark, sf_dir):
    return windows.moving_average(daily(spark, sf_dir, "PriceUSD"), "PriceUSD", **WHOLE)


@query("lag_feature")
def lag_feature(spark, sf_dir):
    return windows.lag_feature(daily(spark, sf_dir, "PriceUSD"), "PriceUSD", 7, **WHOLE)


@query("lag_return")
def lag_return(spark, sf_dir):
    return windows.lag_return(
        daily(spark, sf_dir, "AdrBalUSD1MCnt"), "AdrBalUSD1MCnt", 7, **WHOLE
    )


@query("return_mean")
def return_mean(spark, sf_dir):
    moved = windows.compute_features(
        daily(spark, sf_dir, "PriceUSD"), [windows.volatility_of("PriceUSD", 7, 30)], **WHOLE
    )
    return moved.select("asset", "time", "PriceUSD_return7", "PriceUSD_return7_mean30")


@query("rolling_volatility")
def rolling_volatility(spark, sf_dir):
    return windows.return_and_volatility(
        daily(spark, sf_dir, "PriceUSD"), "PriceUSD", 7, 30, **WHOLE
    )


@query("rolling_delta")
def rolling_delta(spark, sf_dir):
    return windows.rolling_delta(
        daily(spark, sf_dir, "AdrBalUSD1MCnt"), "AdrBalUSD1MCnt", **WHOLE
    )


@query("first_difference")
def first_difference(spark, sf_dir):
    return windows.first_difference(daily(spark, sf_dir, "AdrActCnt"), "AdrActCnt", **WHOLE)


@query("delta_ma_strict")
def delta_ma_strict(spark, sf_dir):
    return windows.delta_strict_mean(daily(spark, sf_dir, "AdrActCnt"), "AdrActCnt", **WHOLE)


@query("growth_from_base")
def growth_from_base(spark, sf_dir):
    rows = daily(spark, sf_dir, *HOLDERS).withColumns(reshape.tier_columns())
    return windows.growth_from_base(rows, ["AdrBalCnt", *TIERS], **WHOLE)


@query("change_rate")
def change_rate(spark, sf_dir):
    return windows.change_rate(
        daily(spark, sf_dir, "AdrBal1in10KCnt"), "AdrBal1in10KCnt", 1, **WHOLE
    )


@query("delta_sign")
def delta_sign(spark, sf_dir):
    return windows.delta_sign(daily(spark, sf_dir, "AdrActCnt"), "AdrActCnt", **WHOLE)


# --- quality -------------------------------------------------------------------


@query("dq_gaps")
def dq_gaps(spark, sf_dir):
    return quality.gaps(daily(spark, sf_dir, "PriceUSD"), **WHOLE)


@query("dq_zero_null")
def dq_zero_null(spark, sf_dir):
    return quality.zero_null_stats(daily(spark, sf_dir, *QUALITY_METRICS), QUALITY_METRICS)


@query("dq_flat_runs")
def dq_flat_runs(spark, sf_dir):
    return quality.flat_runs(
        daily(spark, sf_dir, *QUALITY_METRICS), QUALITY_METRICS, **WHOLE
    )


@query("dq_report")
def dq_report(spark, sf_dir):
    metrics = Settings().quality_metrics
    report = quality.quality_report(daily(spark, sf_dir, *metrics), metrics, **WHOLE)
    return report.select(
        "asset", "feature", "total_records",
        F.col("date_range.start").alias("earliest"), F.col("date_range.end").alias("latest"),
        "gap_count", "zero_count", "repeated_values_count",
    )


@query("dq_report_dirty")
def dq_report_dirty(spark, sf_dir):
    """The report over raw rows, copies of times included, before interpolation hides nulls."""
    raw = cleaning.clean_nonfinite(fixtures.daily_metrics_dirty(spark, sf_dir), ["v"])
    report = quality.quality_report(raw, ["v"], seq="seq")
    return report.select(
        "asset", "feature", "total_records", "gap_count", "zero_count", "repeated_values_count"
    )


@query("dq_consistency")
def dq_consistency(spark, sf_dir):
    return quality.consistency(daily(spark, sf_dir, *HOLDERS))


@query("dq_null_counts")
def dq_null_counts(spark, sf_dir):
    return quality.null_counts(daily(spark, sf_dir, *ALL_METRICS), ALL_METRICS)


@query("dq_nonpositive")
def dq_nonpositive(spark, sf_dir):
    return quality.nonpositive_counts(daily(spark, sf_dir, *ZERO_PRONE), ZERO_PRONE)


@query("latest_summary")
def latest_summary(spark, sf_dir):
    names = ("AdrBalCnt", "AdrBalUSD100KCnt", "AdrBalUSD1MCnt")
    return quality.latest_summary(daily(spark, sf_dir, *names), names)


# --- joins and reshaping ---------------------------------------------------------


@query("join_metrics")
def join_metrics(spark, sf_dir):
    """Five single-metric frames joined on time."""
    rows = written(daily(spark, sf_dir, "AdrActCnt", *HOLDERS), "metrics")
    return reshape.join_metrics(
        [rows.select("asset", "time", n) for n in ("AdrActCnt", *HOLDERS)]
    )


@query("long_to_wide")
def long_to_wide(spark, sf_dir):
    """Wide -> long -> wide with only complete times kept."""
    names = ("PriceUSD", "TxCnt", "CapMVRVCur")
    long = reshape.to_long(daily(spark, sf_dir, *names), names)
    return reshape.to_wide(long, names, complete=True)


@query("holder_tiers")
def holder_tiers(spark, sf_dir):
    return reshape.holder_tiers(daily(spark, sf_dir, *HOLDERS))


@query("tier_distribution")
def tier_distribution(spark, sf_dir):
    return reshape.tier_distribution(reshape.holder_tiers(daily(spark, sf_dir, *HOLDERS)))


@query("yoy_by_day")
def yoy_by_day(spark, sf_dir):
    return reshape.yoy(daily(spark, sf_dir, "AdrActCnt"), "AdrActCnt")


@query("yoy_pivot")
def yoy_pivot(spark, sf_dir):
    """The pivot, laid out in rows again: its columns are the years the data has."""
    pivot = reshape.yoy_pivot(written(daily(spark, sf_dir, "AdrActCnt"), "metrics"), "AdrActCnt")
    years = [n for n in pivot.columns if n not in ("asset", "day_of_year")]
    long = melt(pivot, ["asset", "day_of_year"], {y: {"value": y} for y in years}, name="year")
    return long.where(F.col("value").isNotNull())


# --- statistics ------------------------------------------------------------------


def _activity_volatility(spark, sf_dir):
    rows = daily(spark, sf_dir, "AdrActCnt")
    return windows.return_and_volatility(rows, "AdrActCnt", 1, 30, **WHOLE)


@query("percentiles")
def percentiles(spark, sf_dir):
    return stats.percentiles(
        _activity_volatility(spark, sf_dir), "AdrActCnt_RV30_return1", **WHOLE
    )


@query("volatility_regime")
def volatility_regime(spark, sf_dir):
    return stats.volatility_regime(
        _activity_volatility(spark, sf_dir), "AdrActCnt_RV30_return1", **WHOLE
    )


@query("histogram_density")
def histogram_density(spark, sf_dir):
    return stats.histogram_density(daily(spark, sf_dir, "AdrActCnt"), "AdrActCnt", **WHOLE)


@query("kde_grid")
def kde_grid(spark, sf_dir):
    return stats.kde_grid(daily(spark, sf_dir, "AdrActCnt"), "AdrActCnt", **WHOLE)


@query("mean_median")
def mean_median(spark, sf_dir):
    return stats.mean_median(daily(spark, sf_dir, "AdrActCnt"), "AdrActCnt", **WHOLE)


@query("peak_trough")
def peak_trough(spark, sf_dir):
    return stats.peak_trough(daily(spark, sf_dir, "AdrActCnt"), "AdrActCnt")


@query("ols_fit")
def ols_fit(spark, sf_dir):
    rows = daily(spark, sf_dir, "CapMrktCurUSD", "ROI1yr")
    return stats.ols_fit(rows, "CapMrktCurUSD", "ROI1yr")


@query("correlation_matrix")
def correlation_matrix(spark, sf_dir):
    rows = daily(spark, sf_dir, *CORRELATION_METRICS)
    return stats.correlation_full(rows, CORRELATION_METRICS)


@query("correlation_many")
def correlation_many(spark, sf_dir):
    """All metrics with all: too many pairs for an aggregate each."""
    return stats.correlation_matrix(daily(spark, sf_dir, *ALL_METRICS), ALL_METRICS).drop("pair")


@query("correlation_distance")
def correlation_distance(spark, sf_dir):
    rows = daily(spark, sf_dir, *CORRELATION_METRICS)
    # a difference from one: a distance of zero is exact to about 15 decimals
    found = stats.correlation_distance(rows, CORRELATION_METRICS)
    return found.withColumn("distance", F.round("distance", 12))


@query("top_correlations")
def top_correlations(spark, sf_dir):
    rows = daily(spark, sf_dir, *CORRELATION_METRICS)
    return stats.top_correlations(rows, CORRELATION_METRICS)


@query("describe")
def describe(spark, sf_dir):
    return stats.describe(daily(spark, sf_dir, *DESCRIBED), DESCRIBED, **WHOLE)


@query("single_pass_figures")
def single_pass_figures(spark, sf_dir):
    """Eleven results from one scan, laid out as (asset, result, item, figure, value)."""
    latest = (HOLDERS[0], *HOLDERS[2:])
    insights = ("lowest_decentralization", "all_growth_pct", "peak_cap", "latest_mvrv", "activity_change_pct")
    wanted = {
        "fit": (stats.line_figures("CapMrktCurUSD", "ROI1yr"), "''", ("slope", "intercept", "r2", "n")),
        "extremes": (stats.extreme_figures("AdrActCnt"), "''", ("peak_value", "trough_value")),
        "dataset": (stats.dataset_figures(("asset", "time", *ALL_METRICS)), "''", ("n_rows", "n_columns", "missing_values")),
        "zeros": (quality.zero_null_figures(QUALITY_METRICS), "metric", ("total_records", "zero_count")),
        "nulls": (quality.null_figures(ALL_METRICS), "metric", ("null_count",)),
        "nonpositive": (quality.nonpositive_figures(ZERO_PRONE), "metric", ("nonpositive_count",)),
        "rules": (quality.consistency_figures(), "rule", ("violations",)),
        "latest": (quality.latest_figures(latest), "''", latest),
        "tiers": (reshape.tier_figures(reshape.tier_columns()), "tier", ("holders", "share_pct")),
        "insights": (indicators.insight_figures(), "''", insights),
        "correlations": (stats.correlation_figures(CORRELATION_METRICS), "concat(a, ' ', b)", ("corr",)),
    }
    found = fused.together(daily(spark, sf_dir, *ALL_METRICS), {n: figures for n, (figures, _, _) in wanted.items()}, ("asset",))
    parts = []
    for name, (_, item, figures) in wanted.items():
        shown = found[name].select("asset", F.expr(item).alias("item"), *[c(n).cast("double").alias(n) for n in figures])
        long = melt(shown, ["asset", "item"], {n: {"value": n} for n in figures}, name="figure")
        parts.append(long.withColumn("result", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


@query("dataset_info")
def dataset_info(spark, sf_dir):
    return stats.dataset_info(daily(spark, sf_dir, *ALL_METRICS))


@query("return_vs_vol")
def return_vs_vol(spark, sf_dir):
    rows = daily(spark, sf_dir, "PriceUSD")
    moved = windows.return_and_volatility(rows, "PriceUSD", 1, 30, **WHOLE)
    return moved.select("asset", "time", "PriceUSD_return1_mean30", "PriceUSD_RV30_return1")


# --- indicators --------------------------------------------------------------------


def _derived(spark, sf_dir):
    return indicators.derived_indicators(daily(spark, sf_dir, *SUPPLY), **WHOLE)


@query("decentralization")
def decentralization(spark, sf_dir):
    return _derived(spark, sf_dir).select(
        "asset", "time", "decentralization_index", "whale_dominance"
    )


@query("dormancy")
def dormancy(spark, sf_dir):
    return _derived(spark, sf_dir).select(
        "asset", "time", "dormant_180d_pct", "dormant_1yr_pct", "dormant_2yr_pct"
    )


@query("whale_activity")
def whale_activity(spark, sf_dir):
    return _derived(spark, sf_dir).select("asset", "time", "whale_activity_change_rate")


@query("dormancy_flow")
def dormancy_flow(spark, sf_dir):
    return _derived(spark, sf_dir).select("asset", "time", "dormancy_flow")


@query("regime_label")
def regime_label(spark, sf_dir):
    return indicators.regime_label(_derived(spark, sf_dir))


@query("regime_segments")
def regime_segments(spark, sf_dir):
    return spans.regime_segments(indicators.regime_label(_derived(spark, sf_dir)), **WHOLE)


@query("indicator_correlation")
def indicator_correlation(spark, sf_dir):
    return stats.correlation_matrix(_derived(spark, sf_dir), INDICATORS).drop("pair")


@query("mvrv_zone")
def mvrv_zone_query(spark, sf_dir):
    return indicators.price_zones(daily(spark, sf_dir, "PriceUSD", "CapMVRVCur"))


@query("mvrv_spans")
def mvrv_spans(spark, sf_dir):
    return spans.zone_spans(
        indicators.price_zones(daily(spark, sf_dir, "PriceUSD", "CapMVRVCur")), **WHOLE
    )


@query("insight_summary")
def insight_summary(spark, sf_dir):
    names = ("AdrActCnt", "CapMrktCurUSD", "PriceUSD", "CapMVRVCur", "SplyCur", "SplyAdrTop1Pct")
    return indicators.insight_summary(daily(spark, sf_dir, *HOLDERS, *names))


# --- the same operators over raw events: timestamps, series of any length --------------


def events(spark, sf_dir):
    return fixtures.event_series(spark, sf_dir)


def sparse(spark, sf_dir):
    return events(spark, sf_dir).withColumn("Val", F.when(F.col("Val") >= 20, F.col("Val")))


def sign_segments(spark, sf_dir, **opts):
    """Both steps go by the positions of one sort."""
    signs = windows.delta_sign(ordered(events(spark, sf_dir), **TIE), "Val", 1, **TIE, **opts)
    return spans.regime_segments(signs, "delta_class", **TIE, **opts)


# Equal times stand in order of event number.
TIE = {"seq": "event_id"}


@query("events_moving_average")
def events_moving_average(spark, sf_dir):
    return windows.moving_average(events(spark, sf_dir), "Val", **TIE)


@query("events_rolling_volatility")
def events_rolling_volatility(spark, sf_dir):
    return windows.return_and_volatility(events(spark, sf_dir), "Val", 1, 30, **TIE)


@query("events_rolling_delta")
def events_rolling_delta(spark, sf_dir):
    return windows.rolling_delta(events(spark, sf_dir), "Val", **TIE)


@query("events_delta_ma_strict")
def events_delta_ma_strict(spark, sf_dir):
    return windows.delta_strict_mean(events(spark, sf_dir), "Val", **TIE)


@query("events_growth_from_base")
def events_growth_from_base(spark, sf_dir):
    return windows.growth_from_base(events(spark, sf_dir), ["Val"], **TIE)


@query("events_interpolate")
def events_interpolate(spark, sf_dir):
    """Small values taken as missing and filled."""
    return cleaning.interpolate_linear(sparse(spark, sf_dir), ["Val"], **TIE).drop("event_id")


@query("events_gaps")
def events_gaps(spark, sf_dir):
    return quality.gaps(events(spark, sf_dir), HALF_HOUR, **TIE)


@query("hours_gaps")
def hours_gaps(spark, sf_dir):
    return quality.gaps(fixtures.event_metrics(spark, sf_dir), 1 / 24 + 1e-9)


@query("hours_flat_runs")
def hours_flat_runs(spark, sf_dir):
    return quality.flat_runs(fixtures.event_metrics(spark, sf_dir), ["EvtCnt", "Users"], 2)


@query("hours_report")
def hours_report(spark, sf_dir):
    report = quality.quality_report(
        fixtures.event_metrics(spark, sf_dir), ["EvtCnt", "Users", "Val"], 2, 1 / 24 + 1e-9
    )
    return report.select(
        "asset", "feature", "total_records", "gap_count", "zero_count", "repeated_values_count"
    )


@query("hours_flat_spans")
def hours_flat_spans(spark, sf_dir):
    return spans.flat_spans(fixtures.event_metrics(spark, sf_dir), ["EvtCnt", "Users"], 1)


@query("hours_largest_issues")
def hours_largest_issues(spark, sf_dir):
    return quality.largest_issues(fixtures.event_metrics(spark, sf_dir), ["EvtCnt", "Users", "Val"], 1, 1 / 24 + 1e-9, 5)


@query("sketched_percentiles")
def sketched_percentiles(spark, sf_dir):
    """Quantiles of a span of days from stored sketches, each with whether its rank is within the bound."""
    rows = written(events(spark, sf_dir), "events")
    stored = written(sketches.day_sketches(rows, ["Val"]), "sketches")
    days = [r[0] for r in stored.select("day").distinct().orderBy("day").collect()]
    start, end = days[len(days) // 4], days[len(days) // 4 * 3]
    found = sketches.range_quantiles(stored, start=start, end=end)
    inside = rows.where(F.col("time").cast("date").between(F.lit(start), F.lit(end))).select("asset", "Val")
    names = [n for n in found.columns if n.startswith("q")]
    compared = join_per_key(inside, found.drop("n"), ["asset"])
    counts = compared.groupBy("asset").agg(
        F.count("Val").alias("n"), *[F.count_if(c("Val") < c(n)).alias(f"_below_{n}") for n in names],
        *[F.count_if(c("Val") <= c(n)).alias(f"_upto_{n}") for n in names],
    )
    off = sketches.rank_error()
    held = [
        ((F.col(f"_below_{n}") <= (p + off) * F.col("n") + 1) & (F.col(f"_upto_{n}") >= (p - off) * F.col("n") - 1)).alias(f"{n}_held")
        for n, p in zip(names, PERCENTS, strict=True)
    ]
    return counts.select("asset", "n", *held)


@query("events_percentiles")
def events_percentiles(spark, sf_dir):
    return stats.percentiles(events(spark, sf_dir), "Val")


@query("events_value_band")
def events_value_band(spark, sf_dir):
    return stats.volatility_regime(events(spark, sf_dir), "Val")


@query("events_mean_median")
def events_mean_median(spark, sf_dir):
    return stats.mean_median(events(spark, sf_dir), "Val")


@query("events_describe")
def events_describe(spark, sf_dir):
    return stats.describe(events(spark, sf_dir), ["Val"])


@query("events_histogram")
def events_histogram(spark, sf_dir):
    return stats.histogram_density(events(spark, sf_dir), "Val")


@query("events_kde_grid")
def events_kde_grid(spark, sf_dir):
    return stats.kde_grid(events(spark, sf_dir), "Val")


@query("events_peak_trough")
def events_peak_trough(spark, sf_dir):
    return stats.peak_trough(events(spark, sf_dir), "Val")


@query("events_sign_segments")
def events_sign_segments(spark, sf_dir):
    return sign_segments(spark, sf_dir)


@query("events_zone_spans")
def events_zone_spans(spark, sf_dir):
    zoned = events(spark, sf_dir).withColumn("zone", mvrv_zone(F.col("Val") / 30))
    return spans.zone_spans(zoned, **TIE)


@query("appended_features")
def appended_features(spark, sf_dir):
    """Averages and a mean that looks ahead, over events stored in three parts of time."""
    rows = written(events(spark, sf_dir), "events")
    low, high = rows.agg(F.min("time"), F.max("time")).first()
    cuts = [low + (high - low) / 3, low + (high - low) / 2]
    at = [F.lit(x.isoformat(sep=" ")).cast(rows.schema["time"].dataType) for x in cuts]
    features = [
        windows.average_of("Val", (7, 30)),
        windows.strict_mean_of("Val", 7, "Val_delta_30d_mean7", "leading", windows.delta_of("Val")),
    ]
    path = scratch_path(spark, "appended")
    for part in (F.col("time") < at[0], (F.col("time") >= at[0]) & (F.col("time") < at[1]), F.col("time") >= at[1]):
        append.append(rows.where(part), path, features, **TIE)
    return append.read_features(spark, path, **TIE).drop("Val_pct_change_30d", "event_id")


@query("events_long_average")
def events_long_average(spark, sf_dir):
    """A short frame beside one of a thousand rows."""
    return windows.moving_average(events(spark, sf_dir), "Val", (30, 1000), **TIE)


@query("events_long_volatility")
def events_long_volatility(spark, sf_dir):
    return windows.return_and_volatility(events(spark, sf_dir), "Val", 1, 500, **TIE)


@query("chained_clean_average")
def chained_clean_average(spark, sf_dir):
    """Cleaning and the averages of the cleaned series from one sort."""
    rows = ordered(fixtures.daily_metrics_dirty(spark, sf_dir), seq="seq")
    return frame_of(windows.moving_average(cleaning.clean(rows, ["v"], seq="seq"), "v", (7, 30)))


@query("chained_volatility_band")
def chained_volatility_band(spark, sf_dir):
    """Volatility, incomplete rows dropped, and runs of its zones from one sort."""
    moved = windows.return_and_volatility(ordered(events(spark, sf_dir), **TIE), "Val", 1, 30, **TIE)
    zoned = moved.withColumns({"zone": mvrv_zone(F.col("Val") / 30)})
    return spans.regime_segments(zoned, "zone")


# --- the same results from series cut into many chunks ----------------------------------


@query("chunked_moving_average")
def chunked_moving_average(spark, sf_dir):
    return windows.moving_average(events(spark, sf_dir), "Val", **TIE, **CHUNKED)


@query("chunked_rolling_volatility")
def chunked_rolling_volatility(spark, sf_dir):
    return windows.return_and_volatility(events(spark, sf_dir), "Val", 1, 30, **TIE, **CHUNKED)


@query("chunked_rolling_delta")
def chunked_rolling_delta(spark, sf_dir):
    return windows.rolling_delta(events(spark, sf_dir), "Val", **TIE, **CHUNKED)


@query("chunked_delta_ma_strict")
def chunked_delta_ma_strict(spark, sf_dir):
    return windows.delta_strict_mean(events(spark, sf_dir), "Val", **TIE, **CHUNKED)


@query("chunked_gaps")
def chunked_gaps(spark, sf_dir):
    return quality.gaps(events(spark, sf_dir), HALF_HOUR, **TIE, **CHUNKED)


@query("chunked_flat_runs")
def chunked_flat_runs(spark, sf_dir):
    rows = fixtures.event_metrics(spark, sf_dir)
    return quality.flat_runs(rows, ["EvtCnt", "Users"], 2, layout="chunked", chunk_rows=100)


@query("chunked_interpolate")
def chunked_interpolate(spark, sf_dir):
    filled = cleaning.interpolate_linear(sparse(spark, sf_dir), ["Val"], chunk_rows=500, **TIE)
    return filled.drop("event_id")


@query("chunked_sign_segments")
def chunked_sign_segments(spark, sf_dir):
    return sign_segments(spark, sf_dir, **CHUNKED)
