"""Sketches keep their rank error over any span of days; flat runs are one row each."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from frames import days, listed, ticks
from pyspark.sql import functions as F

from seriesmill.operators import quality, sketches, spans
from seriesmill.operators.layout import ordered


@pytest.mark.parametrize("shape", ["even", "skewed", "repeated"])
def test_ranks_are_within_the_bound(spark, shape):
    rng = random.Random(shape)
    draw = {"even": rng.random, "skewed": lambda: rng.expovariate(1) ** 6, "repeated": lambda: float(rng.randrange(5))}[shape]
    rows = [("a" if rng.random() < 0.8 else None, date(2024, 1, 1) + timedelta(days=rng.randrange(60)), draw() if rng.random() < 0.95 else None) for _ in range(60_000)]
    df = spark.createDataFrame(rows, "asset string, time date, v double").repartition(6)
    stored = sketches.day_sketches(df, ["v"])
    probs = [0.0, 0.01, 0.1, 0.5, 0.9, 0.99, 1.0]
    for low, high in ((0, 59), (10, 12), (40, 40)):
        start, end = (date(2024, 1, 1) + timedelta(days=x) for x in (low, high))
        for r in sketches.range_quantiles(stored, probs, start, end).collect():
            values = np.array([v for a, t, v in rows if a == r["asset"] and start <= t <= end and v is not None])
            assert r["n"] == len(values)
            for p, q in zip(probs, r[3:], strict=True):
                below, upto = (values < q).mean(), (values <= q).mean()
                off = 1.5 * sketches.rank_error() + 1 / len(values)
                assert below - off <= p <= upto + off


def test_days_are_added_without_the_old_rows(spark):
    old, new = days(spark, [1.0, 2.0, 3.0]), days(spark, [10.0, 20.0], start=date(2021, 1, 1))
    stored = sketches.day_sketches(old, ["v"]).unionByName(sketches.day_sketches(new, ["v"]))
    whole = sketches.day_sketches(old.unionByName(new), ["v"])
    assert listed(sketches.range_quantiles(stored)) == listed(sketches.range_quantiles(whole))
    assert sketches.range_quantiles(stored, start=date(2022, 1, 1)).count() == 0
    assert sketches.day_sketches(days(spark, [None, None]).withColumn("v", F.lit(None).cast("double")), ["v"]).count() == 0


@pytest.mark.parametrize("how", [{"layout": "whole"}, {"chunk_rows": 3}, {"chunk_rows": 1000}])
def test_flat_runs_are_one_row_each(spark, how):
    df = days(spark, [5.0, 5.0, 5.0, 5.0, 5.0, 1.0, None, None, 2.0, 2.0, None, 2.0, 2.0, 2.0])
    found = listed(spans.flat_spans(df, ["v"], 1, **how).select("metric", "value", F.dayofyear("start").alias("s"), F.dayofyear("end").alias("e"), "n_rows"))
    assert found == [("v", 2.0, 9, 10, 2), ("v", 2.0, 12, 14, 3), ("v", 5.0, 1, 5, 5)]
    assert spans.flat_spans(df, ["v"], 3, **how).count() == 1


def test_spans_hold_the_rows_that_flat_runs_end(spark):
    """A run of n rows ends k unchanged steps n - k times."""
    df = ticks(spark, 2, 300).withColumn("seq", F.monotonically_increasing_id())
    df = spark.createDataFrame(df.collect(), df.schema)
    for k in (1, 2):
        ends = quality.flat_runs(df, ["v"], k, seq="seq").groupBy("asset").count().collect()
        held = spans.flat_spans(ordered(df, seq="seq"), ["v"], k, chunk_rows=40).groupBy("asset").agg(F.sum(F.col("n_rows") - k).alias("count")).collect()
        assert sorted(map(tuple, ends)) == sorted(map(tuple, held))


def test_issues_are_bounded(spark):
    df = ticks(spark, 9, 400).withColumn("seq", F.monotonically_increasing_id())
    df = spark.createDataFrame(df.collect(), df.schema)
    found = quality.largest_issues(df, ["v"], 1, 0.01, most=3, seq="seq").collect()
    gaps = {}
    for r in quality.gaps(df, 0.01, seq="seq").collect():
        gaps.setdefault(r["asset"], []).append(r["days_gap"])
    for asset, sizes in gaps.items():
        assert [r["size"] for r in sorted(found, key=lambda r: r["rank"]) if r["asset"] == asset and r["issue"] == "gap"] == sorted(sizes, reverse=True)[:3]
    assert max(r["rank"] for r in found) == 3 and {r["feature"] for r in found if r["issue"] == "flat"} == {"v"}
