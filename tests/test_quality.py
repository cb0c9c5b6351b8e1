import pytest
from frames import START, days, listed, ticks
from pyspark.sql import functions as F

from seriesmill.operators import quality


def test_gaps_in_days(spark):
    df = days(spark, [1.0, 2.0, 3.0, 4.0, 5.0]).where("v not in (2.0, 4.0)")
    assert [r["days_gap"] for r in quality.gaps(df).collect()] == [2.0, 2.0]
    assert quality.gaps(days(spark, [1.0, 2.0])).count() == 0


def test_gaps_are_fractional_for_timestamps(spark):
    df = spark.sql(
        """SELECT 'a' AS asset, ts AS time FROM VALUES
           (TIMESTAMP_NTZ'2020-01-01 00:00:00'), (TIMESTAMP_NTZ'2020-01-02 00:00:00'),
           (TIMESTAMP_NTZ'2020-01-03 12:00:00') AS t(ts)"""
    )
    assert [r["days_gap"] for r in quality.gaps(df).collect()] == [1.5]


def test_zero_and_null_count_and_empty(spark):
    row = quality.zero_null_stats(days(spark, [0.0, None, 1.0]), ["v"]).first()
    assert (row["total_records"], row["zero_count"], row["earliest"]) == (3, 2, START)
    assert quality.zero_null_stats(days(spark, []), ["v"]).count() == 0


def test_flat_run_needs_k_repeats_and_null_breaks_it(spark):
    assert quality.flat_runs(days(spark, [5.0] * 3), ["v"], 3).count() == 0
    assert quality.flat_runs(days(spark, [5.0] * 5), ["v"], 3).count() == 2
    assert quality.flat_runs(days(spark, [5.0, 5.0, None, 5.0, 5.0]), ["v"], 2).count() == 0


def test_report_agrees_with_its_parts_and_lists(spark):
    values = [1.0, 1.0, 1.0, 1.0, 0.0, None, 7.0, 7.0, 7.0, 8.0]
    df = days(spark, values).where("time != date'2020-01-08'").withColumn("u", F.lit(2.0))
    report = {r["feature"]: r for r in quality.quality_report(df, ["v", "u"], 2, details=True).collect()}
    flat = quality.flat_runs(df, ["v", "u"], 2)
    for name, row in report.items():
        found = flat.where(flat.metric == name).orderBy("time").collect()
        assert row["repeated_values_count"] == len(found) == len(row["details"])
        assert [d["time"] for d in row["details"]] == [f["time"] for f in found]
        assert row["gap_count"] == 1 and [g["days_gap"] for g in row["gaps"]] == [2.0]
        assert row["date_range"]["start"] == START
    assert report["v"]["zero_count"] == 2


def test_chunked_checks_equal_whole_ones(spark):
    df = ticks(spark, 21).withColumn("u", F.lit(1.0))
    for check in (
        lambda **o: quality.gaps(df, 0.5, **o),
        lambda **o: quality.flat_runs(df, ["v", "u"], 2, **o),
        lambda **o: quality.quality_report(df, ["v", "u"], 2, 0.5, **o).drop("date_range"),
    ):
        assert listed(check(layout="chunked", chunk_rows=8)) == listed(check(layout="whole"))


def test_lists_are_refused_for_unbounded_series(spark):
    with pytest.raises(ValueError, match="DATE"):
        quality.quality_report(ticks(spark), ["v"], details=True)


def test_consistency_rules(spark):
    rows = [("a", "2020-01-01", 10.0, 20.0, 30.0), ("a", "2020-01-02", 10.0, 5.0, None)]
    df = spark.createDataFrame(
        rows, "asset string, time string, AdrBalCnt double, AdrBalUSD100KCnt double, AdrBalUSD1MCnt double"
    )
    found = {r["rule"]: r for r in quality.consistency(df).collect()}
    total, large = found["over_100k_exceeds_total"], found["over_1m_exceeds_over_100k"]
    assert (total["violations"], total["latest_violates"], total["severity"]) == (1, False, "warning")
    assert (large["violations"], large["latest_violates"], large["severity"]) == (1, False, "error")


def test_null_and_nonpositive_counts(spark):
    df = days(spark, [None, 0.0, -1.0, 2.0])
    assert quality.null_counts(df, ["v"]).first()["null_count"] == 1
    found = quality.nonpositive_counts(df, ["v", "absent"]).collect()
    assert [(r["metric"], r["nonpositive_count"]) for r in found] == [("v", 2)]
