from datetime import timedelta

import pytest
from frames import NOON, START, days, listed, ticks
from pyspark.sql import functions as F

from seriesmill.functions.expressions import mvrv_zone, regime
from seriesmill.operators import indicators, reshape, spans


def labelled(spark, labels):
    rows = [("a", START + timedelta(days=3 * i), x) for i, x in enumerate(labels)]
    return spark.createDataFrame(rows, "asset string, time date, regime string")


def test_segments_ignore_time_gaps_and_break_on_none(spark):
    df = labelled(spark, [None, "x", "x", None, "x", "y", "y", "y", None])
    got = spans.regime_segments(df).orderBy("start").collect()
    assert [(r["label"], r["n_rows"]) for r in got] == [("x", 2), ("x", 1), ("y", 3)]
    assert got[1]["start"] == got[1]["end"]


def test_spans_link_rows_of_one_zone(spark):
    df = days(spark, [1.5, 1.2, 2.2, 1.1, 9.0, 9.0, 1.7]).withColumn("zone", mvrv_zone(F.col("v")))
    got = spans.zone_spans(df).orderBy("start").collect()
    # 1.1 is two days after 1.2: not linked, though no other fair row lies between.
    assert [(r["label"], r["n_rows"], r["start"].day) for r in got] == [
        ("fair", 2, 1), ("overvalued", 2, 5),
    ]


def test_spans_floor_fractional_days(spark):
    steps = [0, 47, 48, 100]
    rows = [("a", NOON + timedelta(hours=sum(steps[: i + 1])), "z") for i in range(len(steps))]
    df = spark.createDataFrame(rows, "asset string, time timestamp_ntz, zone string")
    got = spans.zone_spans(df).collect()
    assert [(r["n_rows"], r["start"]) for r in got] == [(2, NOON)]


def brute_segments(rows):
    """Runs over (asset, time, label) rows, one row at a time."""
    found, current = [], None
    for asset, time, label in sorted(rows, key=lambda r: (r[0], r[1])):
        if current and current[0] == asset and current[1] == label and label is not None:
            current[3], current[4] = time, current[4] + 1
        else:
            current = [asset, label, time, time, 1]
            if label is not None:
                found.append(current)
    return sorted(tuple(f) for f in found)


@pytest.mark.parametrize("chunk_rows", [1, 2, 5, 1000])
def test_chunked_runs_equal_row_by_row_ones(spark, chunk_rows):
    df = ticks(spark, 41).withColumn(
        "regime", F.when(F.col("v") > 5, "high").when(F.col("v") == 5, "same").when(F.col("v") < 0, "low")
    )
    expected = brute_segments([tuple(r) for r in df.select("asset", "time", "regime").collect()])
    for opts in ({"layout": "chunked", "chunk_rows": chunk_rows}, {"layout": "whole"}):
        got = spans.regime_segments(df, **opts)
        assert sorted(tuple(r) for r in got.collect()) == expected
    linked = spans.zone_spans(df, "regime", layout="chunked", chunk_rows=chunk_rows)
    assert listed(linked) == listed(spans.zone_spans(df, "regime", layout="whole"))


def test_segments_of_an_asset_do_not_overlap(spark, sf_dir):
    from seriesmill.fixtures import daily_metrics

    derived = indicators.derived_indicators(
        daily_metrics(spark, sf_dir, [*indicators.SUPPLY_METRICS, indicators.WHALE_METRIC])
    )
    rows = spans.regime_segments(indicators.regime_label(derived)).orderBy("asset", "start").collect()
    for a, b in zip(rows, rows[1:]):
        assert a["asset"] != b["asset"] or a["end"] < b["start"]
    sums = derived.where(
        F.abs(F.col("decentralization_index") + F.col("whale_dominance") - 1) > 1e-12
    )
    assert sums.count() == 0


def test_regime_signs(spark):
    rows = [(1.0, -1.0), (1.0, 1.0), (-1.0, 1.0), (-1.0, -1.0), (0.0, 1.0), (None, 1.0), (1.0, None)]
    df = spark.createDataFrame(rows, "w double, d double")
    got = [r[0] for r in df.select(regime(F.col("w"), F.col("d"))).collect()]
    assert got == ["distribution", "reshuffling", "accumulation", "cashout", None, None, None]


def test_zone_bounds_are_inclusive_above(spark):
    df = spark.createDataFrame([(v,) for v in (3.1, 3.0, 2.5, 2.0, 1.0, 0.0, -1.0)], "v double")
    got = [r[0] for r in df.select(mvrv_zone(F.col("v"))).collect()]
    assert got == ["overvalued", "caution", "warming up", "fair", "undervalued", None, None]


def holders(spark, *rows):
    names = "AdrBalCnt double, AdrBalUSD10KCnt double, AdrBalUSD100KCnt double, AdrBalUSD1MCnt double"
    made = [("a", START + timedelta(days=i), *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(made, f"asset string, time date, {names}")


def test_tiers_clip_and_keep_nulls(spark):
    got = reshape.holder_tiers(holders(spark, (10.0, 12.0, 5.0, None), (10.0, 6.0, 3.0, 1.0)))
    first, second = got.orderBy("time").collect()
    assert list(first)[2:] == [0.0, 7.0, None, None]
    assert list(second)[2:] == [4.0, 3.0, 2.0, 1.0]
    assert sum(list(second)[2:]) == 10.0


def test_distribution_uses_last_row_and_drops_empty_tiers(spark):
    tiers = reshape.holder_tiers(holders(spark, (9.0, 6.0, 3.0, 1.0), (10.0, 5.0, 5.0, 0.0)))
    got = {r["tier"]: r["share_pct"] for r in reshape.tier_distribution(tiers).collect()}
    assert got == {"small": 50.0, "large": 50.0}


def test_wide_long_wide(spark):
    df = days(spark, [1.0, None, 3.0]).withColumn("u", F.col("v") * 2)
    long = reshape.to_long(df, ["v", "u"])
    assert long.count() == 6
    assert listed(reshape.to_wide(long, ["v", "u"], complete=True)) == listed(df)
    partial = long.where("metric = 'v' or value is null or value <> 2.0")
    assert reshape.to_wide(partial, ["v", "u"], complete=True).count() == 2
    assert reshape.to_wide(partial, ["v", "u"]).count() == 3


def test_years_are_read_off_the_series(spark):
    df = days(spark, [float(i) for i in range(400)])
    wide = reshape.yoy_pivot(df, "v")
    assert wide.columns == ["asset", "day_of_year", "y2020", "y2021"]
    row = wide.where("day_of_year = 1").first()
    assert (row["y2020"], row["y2021"]) == (0.0, 366.0)
