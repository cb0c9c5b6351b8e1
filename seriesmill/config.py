"""Parameters of the analytics stages."""

from __future__ import annotations

from dataclasses import dataclass

# Metric names as they appear in the input files, and the default
# window lengths. Results are only comparable when these agree.
AGGREGATE_METRICS = (
    "PriceUSD",
    "TxCnt",
    "AdrActCnt",
    "CapMrktCurUSD",
    "ROI1yr",
    "ROI30d",
    "AdrBal1in100KCnt",
    "AdrBal1in10KCnt",
    "AdrBalUSD10KCnt",
    "AdrBalUSD100KCnt",
    "AdrBalUSD1MCnt",
    "AdrBalCnt",
    "SplyAdrTop1Pct",
    "SplyCur",
    "SplyAct180d",
    "SplyAct1yr",
    "SplyAct2yr",
    "CapMVRVCur",
    "NVTAdj90",
)
CHANGE_METRICS = (
    "PriceUSD",
    "AdrActCnt",
    "AdrBalUSD10KCnt",
    "AdrBalUSD100KCnt",
    "VtyDayRet30d",
    "CapMVRVCur",
    "AdrBal1in10KCnt",
)
CORRELATION_METRICS = (
    "PriceUSD",
    "TxCnt",
    "AdrActCnt",
    "CapMrktCurUSD",
    "ROI1yr",
    "ROI30d",
)
INDICATORS = (
    "decentralization_index",
    "whale_dominance",
    "dormant_180d_pct",
    "dormant_1yr_pct",
    "dormant_2yr_pct",
    "whale_activity_change_rate",
    "dormancy_flow",
)
TIERS = ("small", "medium", "large", "whale")
PERCENTS = (0.10, 0.25, 0.50, 0.75, 0.90)


@dataclass(frozen=True)
class Settings:
    """One immutable bundle of parameters; every stage takes it explicitly."""

    lookback_days: int = 730
    aggregate_metrics: tuple[str, ...] = AGGREGATE_METRICS
    lag_metrics: tuple[str, ...] = CHANGE_METRICS
    delta_metrics: tuple[str, ...] = CHANGE_METRICS
    correlation_metrics: tuple[str, ...] = CORRELATION_METRICS
    average_windows: tuple[int, ...] = (7, 30, 90)
    volatility_window: int = 30
    lag: int = 1
    flat_window: int = 7
    delta_window: int = 30

    @property
    def quality_metrics(self) -> tuple[str, ...]:
        """Every configured metric once, in order of first mention."""
        named = self.aggregate_metrics + self.lag_metrics + self.delta_metrics
        return tuple(dict.fromkeys(named))
