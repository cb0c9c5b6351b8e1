"""One sort for a chain of operators, and long frames from block sums."""

import random
import time

import numpy as np
import pytest
from frames import listed, ticks
from pyspark.sql import functions as F

from seriesmill.operators import cleaning, layout, quality, spans, windows
from seriesmill.operators.layout import frame_of, ordered
from seriesmill.sources import scratch


@pytest.fixture(scope="module")
def rows(spark):
    df = ticks(spark, 4, 500).withColumn("seq", F.monotonically_increasing_id())
    spoiled = df.withColumn("asset", F.when(F.col("asset") != "z", F.col("asset")))
    copies = spoiled.where("seq % 7 = 0").withColumns({"seq": F.col("seq") + 1_000_000, "v": F.col("v") + 1})
    both = spoiled.unionByName(copies)
    return spark.createDataFrame(both.collect(), both.schema).repartition(5)


@pytest.fixture
def sorts(monkeypatch):
    """How often rows were sorted by range into a written table."""
    found = []
    for module in (layout, scratch):
        plain = module.written
        monkeypatch.setattr(module, "written", lambda df, name, plain=plain: found.append(df._jdf.queryExecution().executedPlan().toString().count("rangepartitioning")) or plain(df, name))
    return found


def test_sign_segments_sort_once(rows, sorts):
    chain = lambda df: spans.regime_segments(windows.delta_sign(df, "v", 1, seq="seq"), "delta_class", seq="seq", chunk_rows=40)
    apart = listed(chain(rows))
    assert sum(sorts) == 2
    sorts.clear()
    together = chain(ordered(rows, seq="seq"))
    assert "rangepartitioning" not in together._jdf.queryExecution().executedPlan().toString() and sum(sorts) == 1
    assert listed(together) == apart


def test_clean_features_and_checks_sort_once(rows, sorts):
    def chain(df):
        cleaned = cleaning.clean(df, ["v"], seq="seq", chunk_rows=50)
        moved = windows.return_and_volatility(cleaned, "v", 1, 4, chunk_rows=50)
        averaged = windows.moving_average(moved, "v", (3, 6), chunk_rows=50)
        labelled = averaged.withColumns({"zone": F.when(c("v_MA3days") > 4, "x")})
        return [
            frame_of(cleaned), frame_of(moved), frame_of(averaged), quality.gaps(cleaned, 0.01), quality.flat_runs(cleaned, ["v"], 2),
            quality.quality_report(cleaned, ["v"], 2), spans.zone_spans(labelled), spans.regime_segments(labelled, "zone"),
        ]

    c = F.col
    apart = [listed(df, 6) for df in chain(rows)]
    sorts.clear()
    together = [listed(df, 6) for df in chain(ordered(rows, seq="seq"))]
    assert sum(sorts) == 1 and together == apart
    assert all(apart)


def test_kept_rows_are_numbered_anew(rows, monkeypatch):
    monkeypatch.setattr(layout, "SUMMARY_CHUNK_ROWS", 30)
    kept = ordered(rows, seq="seq").keep(F.col("seq") % 3 > 0)
    found = kept.rows.collect()
    per = {}
    for r in sorted(found, key=lambda r: r["_pos"]):
        per.setdefault(r["asset"], []).append(r)
    for series in per.values():
        assert [r["_pos"] for r in series] == list(range(len(series))) and {r["_last"] for r in series} == {len(series) - 1}
        assert [(r["time"], r["seq"]) for r in series] == sorted((r["time"], r["seq"]) for r in series)
    assert len(found) == rows.where("seq % 3 > 0").count()


def test_other_keys_are_refused(rows):
    with pytest.raises(ValueError, match="ordered by"):
        frame_of(windows.moving_average(ordered(rows, seq="seq"), "v", keys=("asset", "seq"))).count()


@pytest.mark.parametrize("k", [2, 5, 64])
@pytest.mark.parametrize("how", [{"layout": "whole"}, {"chunk_rows": 70}, {"chunk_rows": 200}])
def test_long_frames_equal_short_ones(rows, monkeypatch, k, how):
    run = {
        "average": lambda: windows.moving_average(rows, "v", (3, k, 9), seq="seq", keep=("seq", "v"), **how),
        "volatility": lambda: windows.return_and_volatility(rows, "v", 2, k, seq="seq", **how),
        "leading": lambda: windows.delta_strict_mean(rows, "v", 3, k, "leading", seq="seq", **how),
        "trailing": lambda: windows.delta_strict_mean(rows, "v", 3, k, "trailing", seq="seq", **how),
    }
    short = {name: listed(f(), 7) for name, f in run.items()}
    monkeypatch.setattr(windows, "LONG_FRAME", 1)
    assert {name: listed(f(), 7) for name, f in run.items()} == short


def test_long_frames_keep_small_digits(spark):
    """A huge value leaves the frame without a trace: nothing is subtracted."""
    values = [1e17] + [0.001 * i for i in range(600)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "asset string, time long, v double")
    found = {r["time"]: r["v_MA200days"] for r in windows.moving_average(df, "v", (200,), layout="whole").collect()}
    assert all(abs(found[t] - np.mean(values[t - 199 : t + 1])) < 1e-12 for t in range(200, 601))


def test_cost_does_not_grow_with_the_frame(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([("a", i, rng.random()) for i in range(60_000)], "asset string, time long, v double").repartition(2).cache()
    df.count()

    def seconds(k):
        frame = windows.moving_average(df, "v", (k,), layout="whole")
        start = time.perf_counter()
        frame.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds(200)
    assert min(seconds(5000) for _ in range(3)) < 2.5 * min(seconds(200) for _ in range(3))
    df.unpersist()
