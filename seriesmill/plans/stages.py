"""The three stages, each from one stored dataset to the next."""

from __future__ import annotations

import logging
from dataclasses import replace
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.config import CORRELATION_METRICS, INDICATORS, Settings
from seriesmill.functions.expressions import columns_with_values, present_columns, require_values
from seriesmill.operators import indicators, quality, reshape, spans, stats, windows
from seriesmill.operators.cleaning import clean, lookback
from seriesmill.operators.fused import Figures, together
from seriesmill.operators.layout import KEYS
from seriesmill.sources import results, versions
from seriesmill.sources.csv import land_csvs, sound_rows
from seriesmill.sources.scratch import written
from seriesmill.sources.tables import write_table


#: The metrics that the analyses read.
ANALYSED = tuple(
    dict.fromkeys(
        [
            "PriceUSD", "CapMrktCurUSD", "ROI1yr", "CapMVRVCur", *CORRELATION_METRICS, "AdrActCnt", "AdrBalCnt", "AdrBalUSD10KCnt",
            "AdrBalUSD100KCnt", "AdrBalUSD1MCnt", *indicators.SUPPLY_METRICS, indicators.WHALE_METRIC,
        ]
    )
)


def ingest(
    spark: SparkSession,
    csv_path: str,
    table_path: str,
    as_of: date | datetime,
    settings: Settings = Settings(),
    on_error: str = "raise",
) -> DataFrame:
    """Files -> lookback -> cleaning -> stored table; gives the status of every file.

    A file that cannot be read whole fails the run, or with ``on_error="skip"`` is left out; the
    status then says so.
    """
    parsed, status = land_csvs(spark, csv_path)
    recent = lookback(sound_rows(parsed, status, on_error), as_of, settings.lookback_days)
    write_table(clean(recent, seq="seq"), table_path)
    return status.drop("file_number", "line")


def ingest_version(
    spark: SparkSession,
    csv_path: str,
    table_path: str,
    as_of: date | datetime,
    settings: Settings = Settings(),
) -> DataFrame:
    """Files -> lookback -> cleaning -> the next version of the stored table; gives its ledger.

    All assets switch at once. An asset with a file that cannot be read whole keeps its stored
    rows, and the ledger says why.
    """
    parsed, status = land_csvs(spark, csv_path)
    sound = sound_rows(parsed, status, "skip")
    broken = status.where("status <> 'ok' and asset <> ''").select("asset")
    rows = clean(lookback(sound.join(broken, "asset", "left_anti"), as_of, settings.lookback_days), seq="seq")
    version = versions.replace(rows, table_path, status.where("asset <> ''").select("asset", "status", "detail"))
    return versions.history(spark, table_path).where(F.col("version") == version)


def build_features(
    table: DataFrame,
    path: str,
    settings: Settings = Settings(),
    format: str = "parquet",
    layout: str = "whole",
) -> None:
    """All feature kinds of all metrics from one window pass over the table.

    The stored table has one row per asset and time after ``clean``, and DATE times; for
    timestamps give ``layout="chunked"``.
    """
    available = replace(
        settings,
        **{
            field: tuple(present_columns(table, getattr(settings, field)))
            for field in ("aggregate_metrics", "lag_metrics", "delta_metrics")
        },
    )
    features = [f for kind in results.KINDS for f in results.kind_features(kind, available)[1]]
    wide = written(windows.compute_features(table, features, layout=layout), "features")
    for kind in results.KINDS:
        long = results.long_results(wide, kind, available)
        results.write_results(long, path, kind, format)


def check_quality(
    table: DataFrame, settings: Settings = Settings(), layout: str = "whole"
) -> DataFrame:
    metrics = present_columns(table, settings.quality_metrics)
    return quality.quality_report(table, metrics, settings.flat_window, layout=layout)


HOLDERS = ("AdrBalCnt", "AdrBalUSD10KCnt", "AdrBalUSD100KCnt", "AdrBalUSD1MCnt")


def single_pass(table: DataFrame, have: set[str], settings: Settings = Settings()) -> dict[str, Figures]:
    """The results that are one aggregate per series, as far as their metrics are there."""
    correlated = [n for n in CORRELATION_METRICS if n in have]
    checked = present_columns(table, settings.quality_metrics)
    shown = [n for n in (HOLDERS[0], *HOLDERS[2:]) if n in have]
    of = {
        "dataset": lambda: stats.dataset_figures(table.columns),
        "zeros": lambda: quality.zero_null_figures(checked),
        "missing_values": lambda: quality.null_figures(checked),
        "nonpositive_values": lambda: quality.nonpositive_figures(checked),
        "latest": lambda: quality.latest_figures(shown),
        "cap_vs_roi": lambda: stats.line_figures("CapMrktCurUSD", "ROI1yr"),
        "correlations": lambda: stats.correlation_figures(correlated),
        "activity_extremes": lambda: stats.extreme_figures("AdrActCnt"),
        "consistency": quality.consistency_figures,
        "tier_distribution": lambda: reshape.tier_figures(reshape.tier_columns()),
        "insights": indicators.insight_figures,
    }
    holders = set(HOLDERS) <= have
    wanted = {
        "latest": bool(shown),
        "cap_vs_roi": {"CapMrktCurUSD", "ROI1yr"} <= have,
        "correlations": len(correlated) >= 2,
        "activity_extremes": "AdrActCnt" in have,
        "consistency": holders,
        "tier_distribution": holders,
        "insights": holders and {"AdrActCnt", "CapMrktCurUSD", "PriceUSD", "CapMVRVCur", "SplyCur", "SplyAdrTop1Pct"} <= have,
    }
    # what describes the table comes along with the analyses, not in place of them
    some = any(wanted.values())
    wanted |= {"dataset": some} | dict.fromkeys(("zeros", "missing_values", "nonpositive_values"), some and bool(checked))
    return {name: make() for name, make in of.items() if wanted[name]}


def analyse(
    table: DataFrame, settings: Settings = Settings(), layout: str = "whole", on_missing: str = "skip"
) -> dict[str, DataFrame]:
    """Every analysis as a frame; an analysis whose metrics are absent or without values is left
    out, with a warning. With ``on_missing="raise"`` the call fails instead.

    Results of one aggregate per series are found at once, in one scan of the table, and written
    (a row per series); the other frames are lazy.
    """
    if on_missing not in ("raise", "skip"):
        raise ValueError(f"unknown on_missing: {on_missing}")
    how = {"layout": layout}
    if on_missing == "raise":
        require_values(table, ANALYSED)
    have = set(columns_with_values(table, ANALYSED))
    missing = [n for n in ANALYSED if n not in have]
    if missing:
        logging.getLogger(__name__).warning("analyses of these metrics are left out, they have no values: %s", ", ".join(missing))
    found = together(table, single_pass(table, have, settings), KEYS)
    lag, window = settings.lag, settings.volatility_window

    if "PriceUSD" in have:
        moved = windows.return_and_volatility(table, "PriceUSD", lag, window, **how)
        found["return_vs_volatility"] = moved.select(
            "asset", "time",
            f"PriceUSD_return{lag}_mean{window}", f"PriceUSD_RV{window}_return{lag}",
        )
    if {"PriceUSD", "CapMVRVCur"} <= have:
        zones = indicators.price_zones(table)
        found["price_zones"] = zones
        found["zone_spans"] = spans.zone_spans(zones, **how)
    if "correlations" in found:
        found["top_correlations"] = stats.top_pairs(found["correlations"])
    if "AdrActCnt" in have:
        moved = windows.return_and_volatility(table, "AdrActCnt", lag, window, **how)
        found["activity_averages"] = windows.moving_average(
            table, "AdrActCnt", settings.average_windows, **how
        )
        found["activity_regimes"] = stats.volatility_regime(
            moved, f"AdrActCnt_RV{window}_return{lag}", **how
        )
        found["activity_delta"] = windows.delta_strict_mean(
            table, "AdrActCnt", settings.delta_window, **how
        )
        found["activity_histogram"] = stats.histogram_density(table, "AdrActCnt", **how)
        found["activity_density"] = stats.kde_grid(table, "AdrActCnt", **how)
        found["activity_by_year"] = reshape.yoy(table, "AdrActCnt")
    if set(HOLDERS) <= have:
        found["tiers"] = reshape.holder_tiers(table)
        found["tier_growth"] = windows.growth_from_base(
            table.withColumns(reshape.tier_columns()), ["AdrBalCnt", *reshape.TIERS], **how
        )
    if {*indicators.SUPPLY_METRICS, indicators.WHALE_METRIC} <= have:
        derived = indicators.derived_indicators(table, lag, **how)
        found["indicators"] = derived
        found["indicator_correlations"] = stats.correlation_matrix(derived, INDICATORS)
        found["regime_segments"] = spans.regime_segments(indicators.regime_label(derived), **how)
    return found
