"""Concentration, dormancy, regime and valuation indicators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from seriesmill.config import INDICATORS, TIERS
from seriesmill.functions.expressions import c, mvrv_zone, ratio, regime, require_columns
from seriesmill.operators.fused import Figures, apart
from seriesmill.operators.layout import KEYS, TIME, over_series
from seriesmill.operators.reshape import tier_columns

SUPPLY_METRICS = ("SplyAdrTop1Pct", "SplyCur", "SplyAct180d", "SplyAct1yr", "SplyAct2yr")
WHALE_METRIC = "AdrBal1in10KCnt"


def derived_indicators(
    df: DataFrame,
    lag: int = 1,
    *,
    keys: Sequence[str] = KEYS,
    time: str = TIME,
    **opts,
) -> DataFrame:
    """The seven supply indicators of each row.

    The whale change rate is aligned with the other indicators by time.
    """
    require_columns(df, [*SUPPLY_METRICS, WHALE_METRIC])
    supply = c("SplyCur")

    def dormant(name: str):
        return F.lit(1.0) - ratio(c(name), supply)

    rows = df.select(
        *keys,
        time,
        ratio(c("SplyAdrTop1Pct"), supply).alias("whale_dominance"),
        dormant("SplyAct180d").alias("dormant_180d_pct"),
        dormant("SplyAct1yr").alias("dormant_1yr_pct"),
        dormant("SplyAct2yr").alias("dormant_2yr_pct"),
        c(WHALE_METRIC).alias("_whales"),
    ).withColumn("decentralization_index", F.lit(1.0) - c("whale_dominance"))

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        base = F.lag(c("_whales"), lag).over(w)
        return rows.withColumns(
            {
                "whale_activity_change_rate": ratio(c("_whales") - base, base),
                "dormancy_flow": c("dormant_1yr_pct") - F.lag(c("dormant_1yr_pct"), 1).over(w),
            }
        )

    built = over_series(rows, build, before=max(lag, 1), keys=keys, time=time, **opts)
    return built.select(*keys, time, *[c(n) for n in INDICATORS])


def regime_label(
    indicators: DataFrame, *, keys: Sequence[str] = KEYS, time: str = TIME
) -> DataFrame:
    whale, flow = c("whale_activity_change_rate"), c("dormancy_flow")
    return indicators.select(*keys, time, whale, flow, regime(whale, flow).alias("regime"))


def price_zones(df: DataFrame, *, keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """Price, market-to-realised value and its zone, for rows that have both."""
    require_columns(df, ["PriceUSD", "CapMVRVCur"])
    rows = df.select(*keys, time, c("PriceUSD"), c("CapMVRVCur")).na.drop("any")
    return rows.withColumn("zone", mvrv_zone(c("CapMVRVCur")))


def insight_summary(
    df: DataFrame, *, keys: Sequence[str] = KEYS, time: str = TIME
) -> DataFrame:
    """One row per series: when it was most concentrated, which holders grew, peak market
    value, current valuation zone, and how activity changed.

    Everything is a first, last, lowest or highest row, so one aggregate with partial
    results per task does it; no window and no sort of the series.
    """
    return apart(df, insight_figures(keys=keys, time=time), keys)


def insight_figures(*, keys: Sequence[str] = KEYS, time: str = TIME) -> Figures:
    decentralization = F.lit(1.0) - ratio(c("SplyAdrTop1Pct"), c("SplyCur"))
    tiers = [tier.alias(n) for n, tier in tier_columns().items()]
    ends = F.struct(c("AdrBalCnt"), *tiers, c("AdrActCnt"))
    t = c(time)
    low = F.min(
        F.when(
            decentralization.isNotNull(),
            F.struct(decentralization.alias("v"), t.alias("t")),
        )
    )
    high = F.min(
        F.when(
            c("CapMrktCurUSD").isNotNull(),
            F.struct((-c("CapMrktCurUSD")).alias("k"), t.alias("t")),
        )
    )
    zoned = c("PriceUSD").isNotNull() & c("CapMVRVCur").isNotNull()
    valued = F.max(F.when(zoned, F.struct(t.alias("t"), c("CapMVRVCur").alias("v"))))
    columns = {
        "_low": low,
        "_high": high,
        "_valued": valued,
        "_first": F.min_by(ends, t),
        "_last": F.max_by(ends, t),
        "as_of": F.max(t),
    }

    def change(name: str):
        return (ratio(c("_last")[name], c("_first")[name]) - 1) * 100

    shown = [
        *keys,
        "as_of",
        F.col("_low.t").alias("most_centralized_time"),
        F.col("_low.v").alias("lowest_decentralization"),
        change("AdrBalCnt").alias("all_growth_pct"),
        *[change(n).alias(f"{n}_growth_pct") for n in TIERS],
        F.col("_high.t").alias("peak_cap_time"),
        (-F.col("_high.k")).alias("peak_cap"),
        F.col("_valued.v").alias("latest_mvrv"),
        mvrv_zone(F.col("_valued.v")).alias("latest_zone"),
        change("AdrActCnt").alias("activity_change_pct"),
    ]
    return Figures(columns, lambda found: found.select(*shown))
