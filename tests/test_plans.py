"""What the plans may contain: exchanges, scans, and no single-partition work."""

import re

import pytest
from frames import days, ticks
from pyspark.sql import functions as F

from seriesmill.operators import cleaning, indicators, quality, spans, stats, windows
from seriesmill.sources import tables
from seriesmill.sources.results import feature_results
from seriesmill.config import Settings


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "stored")
    days(spark, [float(i) for i in range(100)]).withColumns(
        {"u": F.col("v") + 1, "unused": F.lit("x")}
    ).write.parquet(path)
    return spark.read.parquet(path)


def exchanges(df):
    return re.findall(r"Exchange (\w+)", plan(df))


def test_one_exchange_and_sort_for_many_features(stored):
    settings = Settings(aggregate_metrics=("v", "u"), lag_metrics=("v", "u"))
    whole = {"layout": "whole"}
    for frame in (
        windows.moving_average(stored, "v", **whole),
        windows.return_and_volatility(stored, "v", **whole),
        windows.delta_strict_mean(stored, "v", **whole),
        feature_results(stored, "moving_averages", settings, **whole),
        feature_results(stored, "lag_volatility", settings, **whole),
        quality.flat_runs(stored, ["v", "u"], **whole),
        quality.quality_report(stored, ["v", "u"], **whole),
        windows.growth_from_base(stored, ["v"], **whole),
    ):
        assert exchanges(frame) == ["hashpartitioning"]
        assert plan(frame).count("Sort [") == 1


def test_scan_reads_only_what_is_used_and_takes_the_filter(stored):
    recent = cleaning.lookback(stored, __import__("datetime").date(2020, 3, 1), 10)
    text = plan(windows.moving_average(recent, "v", layout="whole"))
    assert re.search(r"ReadSchema: struct<asset:string,time:date,v:double>", text)
    assert "GreaterThanOrEqual(time," in text


def test_segments_need_one_exchange_on_days(stored):
    labelled = stored.withColumn("regime", F.when(F.col("v") > 3, "x"))
    assert exchanges(spans.regime_segments(labelled, layout="whole")) == ["hashpartitioning"]
    assert exchanges(spans.zone_spans(labelled, "regime", layout="whole")) == ["hashpartitioning"]


def test_timestamp_series_never_run_in_a_window_per_asset(spark):
    """Row-level windows are keyed by chunk or calendar slot, not by asset alone."""
    df = ticks(spark, 1)
    labelled = df.withColumn("regime", F.when(F.col("v") > 3, "x"))
    for frame in (
        windows.moving_average(df, "v"),
        quality.gaps(df),
        quality.quality_report(df, ["v"]),
        cleaning.interpolate_linear(df, ["v"]),
        spans.regime_segments(labelled),
    ):
        text = plan(frame)
        assert "SinglePartition" not in text
        for functions in re.findall(r"^.*\bWindow \[(.*)$", text, re.M):
            if "row_number()" in functions or "avg(" in functions or "lag(v" in functions:
                assert "_chunk" in functions


def test_rows_stay_where_they_are_for_small_per_key_figures(spark):
    """One read of the rows and a broadcast of the table whose size is known; no shuffle by value."""
    df = ticks(spark, 1)
    for frame, exchanges_of_rows in (
        (stats.volatility_regime(df, "v"), 0),
        (windows.growth_from_base(df, ["v"]), 0),
        (stats.histogram_density(df, "v"), 3),
        (stats.kde_grid(df, "v"), 1),
    ):
        text = plan(frame)
        assert "BroadcastHashJoin" in text
        shuffles = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", text)
        assert not any("_v" in keys for keys in shuffles)
        assert text.count("Exchange hashpartitioning(") <= exchanges_of_rows + 1


def test_copies_are_limited_before_the_shuffle(spark):
    df = ticks(spark, 1).withColumn("seq", F.lit(1))
    for frame in (cleaning.dedup_keep_last(df, seq="seq"), tables.preview_each(df, 3)):
        assert plan(frame).count("WindowGroupLimit") == 2


def test_aggregates_combine_before_the_shuffle(spark, stored):
    for frame in (
        stats.correlation_matrix(stored, ["v", "u"]),
        stats.kde_grid(stored, "v", layout="whole"),
        quality.zero_null_stats(stored, ["v", "u"]),
        stats.peak_trough(stored, "v"),
    ):
        assert "partial_" in plan(frame)


def test_no_python_in_any_plan(spark, sf_dir):
    import __spark_entry__ as contract

    for name in ("insight_summary", "clean_series", "kde_grid", "events_percentiles", "regime_segments"):
        text = plan(contract.queries()[name](spark, sf_dir))
        assert "Python" not in text and "CartesianProduct" not in text
        assert "BroadcastNestedLoopJoin" not in text


def test_insights_need_no_window(stored):
    names = [
        "AdrBalCnt", "AdrBalUSD10KCnt", "AdrBalUSD100KCnt", "AdrBalUSD1MCnt", "AdrActCnt",
        "CapMrktCurUSD", "PriceUSD", "CapMVRVCur", "SplyCur", "SplyAdrTop1Pct",
    ]
    wide = stored.select("asset", "time", *[F.col("v").alias(n) for n in names])
    text = plan(indicators.insight_summary(wide))
    assert "Window" not in text
