"""One version at a time: old or new, never half; failed assets keep their rows."""

import re
from datetime import date

import pytest
from frames import days, listed
from pyspark.sql import functions as F

from seriesmill.config import Settings
from seriesmill.plans import stages
from seriesmill.sources import versions


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def both(spark):
    return days(spark, [1.0, 2.0], "a").unionByName(days(spark, [3.0], "b")).unionByName(days(spark, [4.0], "01"))


def values(df):
    return sorted((str(r["asset"]), r["v"]) for r in df.collect())


def test_versions_replace_whole_assets(spark, path):
    assert versions.replace(both(spark), path) == 1
    assert versions.replace(days(spark, [9.0], "a"), path) == 2
    assert values(versions.read_version(spark, path)) == [("01", 4.0), ("a", 9.0), ("b", 3.0)]
    assert values(versions.read_version(spark, path, 1)) == [("01", 4.0), ("a", 1.0), ("a", 2.0), ("b", 3.0)]
    assert listed(versions.versions(spark, path).select("version", "loaded", "kept", "n_rows")) == [(1, 3, 0, 4), (2, 1, 0, 1)]


def test_a_write_killed_midway_leaves_the_old_version(spark, path):
    versions.replace(both(spark), path)
    half = days(spark, [float(i) for i in range(50)], "a").repartition(8)
    broken = half.withColumn("v", F.when(F.col("v") == 30, F.raise_error(F.lit("executor lost")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="executor lost"):
        versions.replace(broken, path)
    # what a lost driver leaves: some files of some assets
    half.limit(20).drop("asset").write.parquet(f"{path}/data/write=dead/asset=a")
    assert values(versions.read_version(spark, path)) == values(both(spark))
    assert versions.replace(days(spark, [7.0], "b"), path) == 2
    assert values(versions.read_version(spark, path)) == [("01", 4.0), ("a", 1.0), ("a", 2.0), ("b", 7.0)]


def test_data_without_a_ledger_row_is_unseen(spark, path, monkeypatch):
    """A writer that dies between its data and its ledger."""
    versions.replace(both(spark), path)
    with monkeypatch.context() as at:
        at.setattr(versions, "join_on", lambda *_: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            versions.replace(days(spark, [7.0], "b"), path)
    assert values(versions.read_version(spark, path)) == values(both(spark))


def test_failed_and_empty_assets(spark, path):
    versions.replace(both(spark), path)
    status = spark.createDataFrame([("a", "ok", ""), ("b", "skipped", "no such time"), ("01", "ok", ""), ("c", "skipped", "gone")], "asset string, status string, detail string")
    versions.replace(days(spark, [5.0], "a"), path, status)
    assert values(versions.read_version(spark, path)) == [("a", 5.0), ("b", 3.0)]
    rows = {r["asset"]: (r["status"], r["detail"], r["n_rows"]) for r in versions.history(spark, path).where("version = 2").collect()}
    assert rows == {"a": ("loaded", "", 1), "01": ("loaded", "", 0), "b": ("kept", "no such time", None), "c": ("kept", "gone", None)}
    with pytest.raises(ValueError, match="not ok"):
        versions.replace(days(spark, [5.0], "b"), path, status)
    assert values(versions.read_version(spark, path)) == [("a", 5.0), ("b", 3.0)]


def test_new_columns_and_missing_keys(spark, path):
    versions.replace(days(spark, [1.0], "a"), path)
    more = days(spark, [2.0], "b").withColumns({"w": F.lit(3.0), "asset": F.lit(None).cast("string")})
    versions.replace(more, path)
    assert sorted((str(r["asset"]), r["v"], r["w"] or 0) for r in versions.read_version(spark, path).collect()) == [("None", 2.0, 3.0), ("a", 1.0, 0)]
    versions.replace(days(spark, [1.0], "c").withColumn("v", F.lit("text")), path)
    with pytest.raises(ValueError, match="column v"):
        versions.read_version(spark, path)


def test_only_folders_that_hold_are_read(spark, path):
    for value in (1.0, 2.0, 3.0):
        versions.replace(days(spark, [value], "a"), path)
    read = versions.read_version(spark, path)
    read.collect()
    assert len(read.inputFiles()) >= 1
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*write#", plan) and values(read) == [("a", 3.0)]


def test_nothing_stored(spark, path):
    assert versions.history(spark, path).count() == 0
    with pytest.raises(ValueError, match="no stored version"):
        versions.read_version(spark, path)


def test_files_to_versions(spark, path, tmp_path):
    files = tmp_path / "csv"
    files.mkdir()
    (files / "one.csv").write_text("time,v\n2024-01-01,1\n2024-01-02,\n2024-01-03,3\n")
    (files / "two.csv").write_text("time,v\n2024-01-01,5\n")
    how = (date(2024, 2, 1), Settings(lookback_days=0))
    stages.ingest_version(spark, str(files), path, *how)
    (files / "one.csv").write_text("time,v\n2024-01-01,oops\n")
    (files / "two.csv").write_text("time,v\n2024-01-01,6\n")
    ledger = {r["asset"]: (r["status"], r["detail"]) for r in stages.ingest_version(spark, str(files), path, *how).collect()}
    assert ledger == {"one": ("kept", "no such number, lines: 1"), "two": ("loaded", "")}
    assert values(versions.read_version(spark, path)) == [("one", 1.0), ("one", 2.0), ("one", 3.0), ("two", 6.0)]
