import math
from datetime import date

import pandas as pd
import pytest
from frames import column, days, listed, ticks
from pyspark.sql import functions as F

from seriesmill.operators import layout, quality, spans
from seriesmill.operators import windows as w
from seriesmill.operators.layout import POS, in_chunks, with_position


def test_partial_average_skips_nulls(spark):
    out = w.moving_average(days(spark, [1.0, None, 3.0, 5.0]), "v", [2])
    assert column(out, "v_MA2days") == [1.0, 1.0, 3.0, 4.0]


def test_composed_window_equals_direct_one(spark):
    df = ticks(spark, 3)
    both = w.moving_average(df, "v", [3, 9, 18], chunk_rows=50)
    for k in (9, 18):
        alone = w.moving_average(df, "v", [k], layout="whole")
        name = f"v_MA{k}days"
        assert listed(both.select("asset", "time", name)) == listed(
            alone.select("asset", "time", name)
        )


def test_window_longer_than_series(spark):
    out = w.moving_average(days(spark, [2.0, 4.0]), "v", [90])
    assert column(out, "v_MA90days") == [2.0, 3.0]
    assert w.return_and_volatility(days(spark, [2.0]), "v", 1, 30).count() == 0


def test_empty_input(spark):
    empty = days(spark, [])
    assert w.moving_average(empty, "v").count() == 0
    assert w.moving_average(empty, "v", layout="chunked").count() == 0


def test_return_on_zero_or_missing_base(spark):
    out = w.lag_return(days(spark, [0.0, 2.0, None, 3.0, 6.0]), "v", 1)
    assert column(out, "v_return1") == [None, None, None, None, 1.0]


def test_volatility_uses_each_rows_own_mean(spark):
    values = [1.0, 2.0, 1.5, 3.0, 2.5, 2.75]
    out = w.return_and_volatility(days(spark, values), "v", 1, 3)
    returns = [None] + [b / a - 1 for a, b in zip(values, values[1:])]
    means, expected = [], []
    for i in range(len(values)):
        frame = [r for r in returns[max(0, i - 2): i + 1] if r is not None]
        means.append(sum(frame) / len(frame) if frame else None)
    for i in range(1, len(values)):
        span = range(max(0, i - 2), i + 1)
        squares = [(returns[j] - means[j]) ** 2 for j in span if returns[j] is not None]
        expected.append(math.sqrt(sum(squares) / len(squares)))
    assert column(out, "v_RV3_return1") == pytest.approx(expected)
    frame_deviation = pd.Series(returns, dtype=float).rolling(3, min_periods=1).std(ddof=0)
    assert column(out, "v_RV3_return1")[-1] != pytest.approx(frame_deviation.iloc[-1])


def test_percent_change_keeps_rows_without_base(spark):
    out = w.rolling_delta(days(spark, [0.0, 2.0, 3.0]), "v", 1)
    assert column(out, "v_delta_1d") == [None, 2.0, 1.0]
    assert column(out, "v_pct_change_1d") == [None, None, 50.0]


def test_strict_mean_equals_rolling_over_newest_first(spark):
    values = [float(i * i % 17) for i in range(50)]
    out = w.delta_strict_mean(days(spark, values), "v", 5, 7)
    newest_first = pd.Series(values).diff(5)[::-1].rolling(7).mean()[::-1]
    got = pd.Series(column(out, "v_delta_5d_mean7"), dtype=float)
    pd.testing.assert_series_equal(got, newest_first, check_names=False)
    back = w.delta_strict_mean(days(spark, values), "v", 5, 7, direction="trailing")
    trailing = pd.Series(values).diff(5).rolling(7).mean()
    got = pd.Series(column(back, "v_delta_5d_mean7"), dtype=float)
    pd.testing.assert_series_equal(got, trailing, check_names=False)


def test_sign_of_zero_and_missing_is_negative(spark):
    out = w.delta_sign(days(spark, [1.0, 1.0, 2.0]), "v", 1)
    assert column(out, "delta_class") == ["negative", "negative", "positive"]


def test_growth_from_zero_base_is_null(spark):
    assert column(w.growth_from_base(days(spark, [0.0, 3.0]), ["v"]), "v_growth_pct") == [None] * 2
    assert column(w.growth_from_base(days(spark, [2.0, 3.0]), ["v"]), "v_growth_pct") == [0.0, 50.0]


def test_missing_metric_is_refused(spark):
    with pytest.raises(ValueError, match="missing required columns"):
        w.moving_average(days(spark, [1.0]), "nope")


def test_metric_names_are_not_sql(spark):
    odd = days(spark, [1.0, 3.0], name="`a.b c`")
    rows = w.moving_average(odd, "a.b c", [2]).orderBy("time").collect()
    assert [r["a.b c_MA2days"] for r in rows] == [1.0, 2.0]


@pytest.mark.parametrize("chunk_rows", [1, 7, 64, 10_000])
def test_chunks_give_the_same_rows_as_one_window(spark, chunk_rows):
    df = ticks(spark, 5)
    features = [
        w.average_of("v", [3, 9]), w.lag_of("v", 2), w.volatility_of("v", 2, 4), w.delta_of("v", 3),
        w.strict_mean_of("v", 3, "strict", "leading", w.delta_of("v", 3)),
    ]
    whole = w.compute_features(df, features, layout="whole")
    chunked = w.compute_features(df, features, layout="chunked", chunk_rows=chunk_rows)
    assert listed(chunked) == listed(whole)
    assert listed(w.growth_from_base(df, ["v"], layout="chunked")) == listed(
        w.growth_from_base(df, ["v"], layout="whole")
    )


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_positions_count_copies_of_a_time_in_seq_order(spark, size):
    rows = [("a", day, seq) for day in ("2020-01-01", "2020-01-03") for seq in range(0, 200_000, 40_000)]
    df = spark.createDataFrame(rows, "asset string, day string, seq long").selectExpr(
        "asset", "cast(day as date) as time", "seq"
    )
    for series in (df, df.withColumn("time", df.time.cast("timestamp_ntz"))):
        placed = with_position(series.repartition(3), size, seq="seq").orderBy("time", "seq")
        assert [r[POS] for r in placed.collect()] == list(range(len(rows)))


def crowded(spark, kind):
    """Rows of one series: an hour of 20,000, a second of 50,000, or equal times with seq."""
    n = {"hour": 20_000, "second": 50_000, "equal": 50_000}[kind]
    micros = {"hour": "id * 180000", "second": "id * 20", "equal": "0"}[kind]
    rows = spark.range(n).selectExpr(
        "'a' as asset", f"timestamp_micros(1700000000000000 + {micros}) as time",
        f"({n} - id) * 7 as seq", "cast(id % 1000 as double) as v",
    )
    return rows.repartition(5)


@pytest.mark.parametrize("kind", ["hour", "second", "equal"])
def test_crowded_times_are_cut_by_rows(spark, kind):
    df = crowded(spark, kind)
    size = 4096
    placed = in_chunks(df, size, before=89, seq="seq")
    chunks = placed.groupBy("_chunk").count().collect()
    n = df.count()
    assert sum(r["count"] for r in chunks) <= 1.15 * n
    assert max(r["count"] for r in chunks) <= 2 * size and len(chunks) == -(-n // size)
    opts = {"seq": "seq", "keep": ("v", "seq")}
    some = w.compute_features(df, [w.average_of("v", [90]), w.lag_of("v", 3)], chunk_rows=size, **opts)
    whole = w.compute_features(df, [w.average_of("v", [90]), w.lag_of("v", 3)], layout="whole", **opts)
    assert some.exceptAll(whole).isEmpty() and whole.exceptAll(some).isEmpty()


def test_position_table_is_small(spark, monkeypatch):
    seen = {}
    real = layout.written
    monkeypatch.setattr(layout, "written", lambda df, name: seen.setdefault(name, real(df, name)))
    with_position(crowded(spark, "second"), 4096, seq="seq").count()
    assert seen["shifts"].count() <= 50


def test_equal_times_give_the_same_rows_however_read(spark):
    rows = [("a", 10 * (i // 20), i * 37 % 101, float(i * i % 13)) for i in range(100)]
    df = spark.createDataFrame(rows, "asset string, s long, seq long, v double").selectExpr(
        "asset", "timestamp_seconds(s) as time", "seq", "v"
    )
    checks = (
        lambda d, **o: w.compute_features(d, [w.lag_of("v", 1), w.volatility_of("v", 1, 3)], seq="seq", **o),
        lambda d, **o: quality.flat_runs(d, ["v"], 1, seq="seq", **o),
        lambda d, **o: quality.quality_report(d, ["v"], 1, seq="seq", **o).drop("date_range"),
        lambda d, **o: spans.regime_segments(d.withColumn("regime", d.v > 6), seq="seq", **o),
        lambda d, **o: quality.gaps(d, 1e-9, seq="seq", **o),
    )
    for check in checks:
        expected = listed(check(df, layout="whole"))
        for parts in (1, 7):
            assert listed(check(df.repartition(parts), chunk_rows=8)) == expected
    for parts in (1, 7):
        assert listed(w.growth_from_base(df.repartition(parts), ["v"], seq="seq")) == listed(
            w.growth_from_base(df, ["v"], seq="seq", layout="whole")
        )


def test_times_before_1970(spark):
    old = days(spark, [float(i) for i in range(30)], start=date(1969, 12, 20))
    series = old.withColumn("time", F.col("time").cast("timestamp_ntz"))
    out = w.moving_average(series, "v", [3], chunk_rows=4)
    assert listed(out) == listed(w.moving_average(series, "v", [3], layout="whole"))


def test_row_order_and_partitions_do_not_matter(spark):
    df = ticks(spark, 8)
    expected = listed(w.moving_average(df, "v", [4], chunk_rows=16))
    assert listed(w.moving_average(df.orderBy("v").repartition(7), "v", [4], chunk_rows=16)) == expected
