"""Results cut from one aggregate against each result by its own aggregate."""

import re

from frames import days, listed
from pyspark.sql import functions as F

from seriesmill.config import CORRELATION_METRICS
from seriesmill.operators import fused, indicators, quality, reshape, stats
from seriesmill.plans import stages

METRICS = sorted(stages.ANALYSED)


def wide(spark):
    """Three series, one without a key: nulls, zeros, ties; metrics that are functions of one value."""
    rows = days(spark, [3.0, 0.0, None, 9.0, 9.0, 1.5]).union(days(spark, [2.0, 5.0], "b")).union(days(spark, [7.0, None, -1.0], None))
    shown = [(F.col("v") * ((i % 4) + 1) + F.dayofmonth("time") % (i + 2)).alias(n) for i, n in enumerate(METRICS)]
    return rows.select("asset", "time", *shown)


def alone(df, correlated):
    latest = [n for n in ("AdrBalCnt", "AdrBalUSD100KCnt", "AdrBalUSD1MCnt")]
    return {
        "dataset": stats.dataset_info(df),
        "latest": quality.latest_summary(df, latest),
        "cap_vs_roi": stats.ols_fit(df, "CapMrktCurUSD", "ROI1yr"),
        "correlations": stats.correlation_matrix(df, correlated),
        "activity_extremes": stats.peak_trough(df, "AdrActCnt"),
        "consistency": quality.consistency(df),
        "tier_distribution": reshape.tier_distribution(reshape.holder_tiers(df)),
        "insights": indicators.insight_summary(df),
    }


def test_results_of_one_pass_equal_their_own(spark):
    df = wide(spark)
    found = stages.analyse(df)
    checked = [n for n in stages.Settings().quality_metrics if n in df.columns]
    expected = alone(df, [n for n in CORRELATION_METRICS])
    expected |= {
        "zeros": quality.zero_null_stats(df, checked), "missing_values": quality.null_counts(df, checked),
        "nonpositive_values": quality.nonpositive_counts(df, checked), "top_correlations": stats.top_correlations(df, CORRELATION_METRICS),
    }
    for name, frame in expected.items():
        assert found[name].columns == frame.columns, name
        assert listed(found[name]) == listed(frame), name


def test_one_scan_and_one_shuffle_for_all(spark, tmp_path):
    wide(spark).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    wanted = stages.single_pass(table, set(METRICS))
    assert len(wanted) == 11
    plan = fused.totals_of(table, wanted, ["asset"])._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan", plan)) == 1 and len(re.findall(r"Exchange hashpartitioning\(asset", plan)) == 1
    # every result reads the written row per series, none the table
    for name, frame in fused.together(table, wanted, ["asset"]).items():
        read = frame.inputFiles()
        assert read and all("figures" in path for path in read), name


def test_nothing_wanted_runs_nothing(spark):
    assert fused.together(days(spark, [1.0]), {}, ["asset"]) == {}


def test_series_without_rows_or_values(spark):
    figures = {"extremes": stats.extreme_figures("v"), "fit": stats.line_figures("v", "v")}
    nothing = fused.together(days(spark, [1.0]).limit(0), figures, ["asset"])
    assert all(frame.collect() == [] for frame in nothing.values())
    empty = fused.together(days(spark, [None, None]), figures, ["asset"])
    assert empty["extremes"].collect() == [] and empty["fit"].first()["n"] == 0
