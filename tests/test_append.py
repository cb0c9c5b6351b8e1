"""Features of appended rows equal those of one run over all rows."""

import random
import re

import pytest
from frames import days, listed, ticks
from pyspark.sql import functions as F

from seriesmill.operators import append, windows

FEATURES = {
    "averages": [windows.average_of("v", (3, 6, 90))],
    "volatility": [windows.volatility_of("v", 2, 5)],
    "delta": [windows.delta_of("v", 4)],
    "lags": [windows.lag_of("v", 3), windows.difference_of("v"), windows.change_rate_of("v", 2)],
    "leading": [windows.strict_mean_of("v", 4, "ahead", "leading", windows.delta_of("v", 3)), windows.average_of("v", (5,))],
    "long": [windows.average_of("v", (150,)), windows.strict_mean_of("v", 140, "m", "leading", windows.difference_of("v"))],
}
HOW = {"seq": "seq", "keep": ("v",)}


@pytest.fixture(scope="module")
def rows(spark):
    df = ticks(spark, 6, 500).withColumn("seq", F.monotonically_increasing_id())
    return sorted(df.collect(), key=lambda r: (r["time"], r["seq"])), df.schema


@pytest.mark.parametrize("name", FEATURES)
@pytest.mark.parametrize("layout", [{"layout": "whole"}, {"chunk_rows": 60}])
def test_parts_equal_the_whole(spark, rows, tmp_path, name, layout):
    data, schema = rows
    rng = random.Random(name)
    cuts = sorted(rng.sample(range(1, len(data)), 3))
    path = str(tmp_path / "store")
    for batch, (low, high) in enumerate(zip([0, *cuts], [*cuts, len(data)], strict=True), 1):
        part = spark.createDataFrame(data[low:high], schema).repartition(3)
        assert append.append(part, path, FEATURES[name], **HOW, **layout) == batch
    whole = windows.compute_features(spark.createDataFrame(data, schema), FEATURES[name], seq="seq", keep=("v", "seq"), layout="whole")
    found = append.read_features(spark, path, seq="seq")
    assert listed(found.select(*whole.columns), 6) == listed(whole, 6)


def test_only_the_newest_tail_is_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    plans = []
    plain = append.append_features
    monkeypatch.setattr(append, "append_features", lambda new, tail, *a, **k: plans.append((tail._jdf.queryExecution().executedPlan().toString(), tail.count())) or plain(new, tail, *a, **k))
    for start in range(0, 400, 100):
        part = days(spark, [float(i) for i in range(100)], start=__import__("datetime").date(2020 + start // 100, 1, 1))
        append.append(part, path, [windows.volatility_of("v", 7, 30)])
    for text, count in plans[1:]:
        assert re.search(r"PartitionFilters: \[[^\]]*batch#\d+ = \d", text) and count == 2 * 29 + 7
    assert append.read_features(spark, path).count() == 400


def test_late_rows_are_refused(spark, tmp_path):
    path = str(tmp_path / "store")
    append.append(days(spark, [1.0, 2.0]), path, FEATURES["delta"])
    with pytest.raises(ValueError, match="do not come after"):
        append.append(days(spark, [5.0]), path, FEATURES["delta"])
    assert append.append(days(spark, [5.0], "other"), path, FEATURES["delta"]) == 2
    assert append.read_features(spark, path).count() == 3


def test_a_lost_append_leaves_the_store(spark, tmp_path):
    path = str(tmp_path / "store")
    append.append(days(spark, [1.0, 2.0]), path, FEATURES["delta"])
    days(spark, [9.0], "half").write.parquet(f"{path}/rows/batch=2")
    assert append.read_features(spark, path).count() == 2
    assert append.append(days(spark, [3.0], "b"), path, FEATURES["delta"]) == 2
    assert append.read_features(spark, path).select("asset").distinct().count() == 2


def test_series_without_a_key_and_no_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    df = days(spark, [1.0, 2.0, 4.0]).withColumn("asset", F.lit(None).cast("string"))
    append.append(df.where("v < 4"), path, FEATURES["delta"])
    append.append(df.where("v < 0"), path, FEATURES["delta"])
    append.append(df.where("v = 4"), path, [windows.delta_of("v", 4)])
    assert append.read_features(spark, path).count() == 3
