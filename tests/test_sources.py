from datetime import date

import pytest
from frames import days, listed
from pyspark.sql import functions as F

from seriesmill.config import Settings
from seriesmill.functions.expressions import chart_columns, numeric_columns, require_values
from seriesmill.plans import stages
from seriesmill.sources import csv, results, tables
from seriesmill.sources.scratch import scratch_path


@pytest.fixture
def landed(tmp_path):
    (tmp_path / "btc.csv").write_text(
        "time,PriceUSD,TxCnt\n2024-01-01,10.5,1\n2024-01-02,,2\n2024-01-02,12.5,3\n2024-01-04,inf,4\n"
    )
    (tmp_path / "a+b 2.csv").write_text("TxCnt,time,Extra\n7,2024-01-01,9\n8,2024-01-02,1\n")
    return tmp_path


def test_columns_are_bound_by_name(spark, landed):
    rows = csv.read_metric_csvs(spark, str(landed))
    got = {(r["asset"], str(r["time"]), r["TxCnt"]): r for r in rows.collect()}
    assert set(got) == {
        ("btc", "2024-01-01", 1.0), ("btc", "2024-01-02", 2.0), ("btc", "2024-01-02", 3.0),
        ("btc", "2024-01-04", 4.0), ("a+b 2", "2024-01-01", 7.0), ("a+b 2", "2024-01-02", 8.0),
    }
    assert got["btc", "2024-01-01", 1.0]["PriceUSD"] == 10.5
    assert got["a+b 2", "2024-01-01", 7.0]["PriceUSD"] is None
    assert got["a+b 2", "2024-01-01", 7.0]["Extra"] == 9.0
    copies = rows.where("asset = 'btc' and time = date'2024-01-02'").orderBy("seq").collect()
    assert [r["TxCnt"] for r in copies] == [2.0, 3.0]


def test_unreadable_files_raise_or_are_reported(spark, landed):
    (landed / "broken.csv").write_text("no,header\n1,2\n")
    (landed / "empty.csv").write_text("\n")
    with pytest.raises(ValueError, match="broken.csv"):
        csv.read_metric_csvs(spark, str(landed))
    kept = csv.read_metric_csvs(spark, str(landed), on_error="skip")
    assert {r["asset"] for r in kept.select("asset").distinct().collect()} == {"btc", "a+b 2"}
    status = {r["asset"]: (r["status"], r["detail"]) for r in csv.file_status(spark, str(landed)).collect()}
    assert status["btc"] == ("ok", "")
    assert status["broken"] == ("skipped", "no time column")
    assert set(status) == {"btc", "a+b 2", "broken"}  # a file of blank lines holds nothing


@pytest.mark.parametrize("line, why", [
    ("2024-01-05,oops,1", "no such number, lines: 1"), ("2024-01-05,1,2,3", "wrong number of fields, lines: 1"),
    ("2024-01-05,1", "wrong number of fields, lines: 1"), ("someday,1,2", "no such time, lines: 1"),
])
def test_bad_lines_raise_or_leave_the_file_out(spark, landed, line, why):
    (landed / "bad.csv").write_text(f"time,PriceUSD,TxCnt\n2024-01-01,5,6\n{line}\n2024-01-06,7,8\n")
    with pytest.raises(Exception, match="bad.csv"):
        csv.read_metric_csvs(spark, str(landed)).collect()
    kept = csv.read_metric_csvs(spark, str(landed), on_error="skip")
    assert {r["asset"] for r in kept.collect()} == {"btc", "a+b 2"}
    status = {r["asset"]: r for r in csv.file_status(spark, str(landed)).collect()}
    assert (status["bad"]["status"], status["bad"]["detail"]) == ("skipped", why)
    assert (status["btc"]["status"], status["btc"]["rows"]) == ("ok", 4)


def test_sequence_numbers_are_unique_over_header_groups(spark, tmp_path):
    for i in range(200):
        names = ["time", "a", "b"] if i % 2 else ["b", "time"]
        folder = tmp_path / f"part{i}"
        folder.mkdir()
        lines = [",".join({"time": "2020-01-01", "a": "1", "b": str(i)}[n] for n in names)] * 3
        (folder / "one.csv").write_text("\n".join([",".join(names), *lines]) + "\n")
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    rows = csv.read_metric_csvs(spark, str(tmp_path)).collect()
    assert len(set(tracker.getJobIdsForGroup(None)) - before) < 20
    assert len(rows) == 600 == len({r["seq"] for r in rows})
    in_order = sorted(rows, key=lambda r: r["seq"])
    assert [r["b"] for r in in_order] == [float(i) for i in sorted(range(200), key=lambda i: f"part{i}/") for _ in range(3)]


def test_damaged_results_raise_or_are_listed(spark, tmp_path):
    settings = Settings(aggregate_metrics=("v",), lag_metrics=("v",), delta_metrics=("v",))
    df = days(spark, [float(i) for i in range(400)])
    made = results.feature_results(df, "moving_averages", settings)
    folder = tmp_path / "moving_averages"
    made.repartition(4).write.parquet(str(folder))
    files = sorted(folder.glob("*.parquet"))
    data = bytearray(files[0].read_bytes())
    data[4:200] = bytes(196)
    files[0].write_bytes(data)
    for crc in folder.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception):
        results.read_results(spark, str(tmp_path), "moving_averages", settings=settings).collect()
    rows, status = results.read_results_or_skip(spark, str(tmp_path), "moving_averages", settings)
    assert status.where("status = 'skipped'").count() == 1 and status.count() == 4
    assert rows.count() == status.agg(F.sum("rows")).first()[0] < 400


def test_only_written_assets_are_replaced(spark, tmp_path):
    path = str(tmp_path / "table")
    both = days(spark, [1.0], "a").unionByName(days(spark, [2.0], "b"))
    tables.write_table(both, path)
    tables.write_table(days(spark, [9.0, 9.5], "b"), path)
    table = tables.read_table(spark, path, both.schema)
    assert sorted((r["asset"], r["v"]) for r in table.collect()) == [("a", 1.0), ("b", 9.0), ("b", 9.5)]
    stored = {r["asset"]: r["n_rows"] for r in tables.stored_series(table).collect()}
    assert stored == {"a": 1, "b": 2}


def test_preview_is_ordered(spark):
    df = days(spark, [3.0, 1.0, 2.0]).orderBy(F.desc("time"))
    assert [r["v"] for r in tables.preview(df, 2).collect()] == [3.0, 1.0]


def test_list_tables(spark):
    path = scratch_path(spark, "table")
    for values in ([1.0], [2.0, 3.0]):
        tables.write_table(days(spark, values), path, name="metrics_listed")
    assert "metrics_listed" in tables.list_tables(spark)
    assert spark.table("metrics_listed").count() == 2
    spark.sql("DROP TABLE metrics_listed")


@pytest.mark.parametrize("format", ["csv", "parquet"])
@pytest.mark.parametrize("kind", list(results.KINDS))
def test_results_round_trip(spark, tmp_path, kind, format):
    one = ("v", "u")
    settings = Settings(aggregate_metrics=one, lag_metrics=one, delta_metrics=one)
    df = days(spark, [float(i % 7 + 1) for i in range(60)]).withColumn("u", F.col("v") * 3)
    made = results.feature_results(df, kind, settings)
    results.write_results(made, str(tmp_path), kind, format)
    back = results.read_results(spark, str(tmp_path), kind, format, settings)
    assert listed(back.select(*made.columns)) == listed(made)
    files = results.result_files(spark, str(tmp_path))
    assert {r["category"] for r in files.collect()} == {results.KINDS[kind]}


def test_unknown_kind_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown kind"):
        results.write_results(days(spark, [1.0]), str(tmp_path), "notes")


def test_scratch_folders_are_shared_and_new(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first.startswith(root) and first != second


def test_chart_columns(spark):
    df = spark.sql("SELECT 'a' AS asset, 1.0D AS v, 2 AS v_lag1, 3.0D AS v_delta, 4.0D AS w, 's' AS s")
    assert numeric_columns(df) == ["v", "v_lag1", "v_delta", "w"]
    assert chart_columns(df) == ["v", "v_lag1", "v_delta"]
    assert chart_columns(df, ("lag", "volatility")) == ["v_lag1"]
    assert chart_columns(df, ("DELTA",)) == ["v_delta"]


def test_required_inputs_have_values(spark):
    df = spark.sql("SELECT 'a' AS asset, 1.0D AS v, CAST(NULL AS DOUBLE) AS w")
    require_values(df, ["v"])
    with pytest.raises(ValueError, match="without values: .'w'"):
        require_values(df, ["v", "w"])
    with pytest.raises(ValueError, match="missing"):
        require_values(df, ["x"])


def test_analyses_of_metrics_without_values_are_left_out(spark, caplog):
    names = list(stages.ANALYSED)
    df = days(spark, [1.0, 2.0, 4.0, 3.0]).select("asset", "time", *[(F.col("v") + i).alias(n) for i, n in enumerate(names)])
    empty = df.withColumn("AdrActCnt", F.lit(None).cast("double")).drop("ROI1yr")
    found = stages.analyse(empty)
    assert not {"activity_delta", "cap_vs_roi"} & set(found) and {"tiers", "correlations", "indicators"} <= set(found)
    assert "AdrActCnt" in caplog.text and "ROI1yr" in caplog.text
    with pytest.raises(ValueError, match="ROI1yr"):
        stages.analyse(empty, on_missing="raise")
    with pytest.raises(ValueError, match="without values: .'AdrActCnt'"):
        stages.analyse(empty.withColumn("ROI1yr", F.lit(1.0)), on_missing="raise")
    assert len(stages.analyse(df, on_missing="raise")) > len(found)


def test_stages_from_files_to_results(spark, tmp_path):
    files = tmp_path / "csv"
    files.mkdir()
    names = list(Settings().quality_metrics)
    for asset, shift in (("one", 1.0), ("two", 5.0)):
        lines = [",".join(["time", *names])]
        for d in range(120):
            day = date.fromordinal(date(2024, 1, 1).toordinal() + d)
            cells = [str(round(shift + i + (d * (i + 3)) % 11, 3)) for i in range(len(names))]
            if d % 10 == 3:
                cells[0] = ""
            lines.append(",".join([str(day), *cells]))
        (files / f"{asset}.csv").write_text("\n".join(lines) + "\n")
    table_path, result_path = str(tmp_path / "table"), str(tmp_path / "results")
    status = stages.ingest(spark, str(files), table_path, date(2024, 5, 1), Settings(lookback_days=100))
    assert sorted((r["asset"], r["status"]) for r in status.collect()) == [("one", "ok"), ("two", "ok")]
    table = tables.read_table(spark, table_path)
    assert table.groupBy("asset").count().where("count between 99 and 101").count() == 2
    assert table.where("PriceUSD is null").count() == 0
    stages.build_features(table, result_path)
    for kind in results.KINDS:
        assert results.read_results(spark, result_path, kind).count() > 0
    assert stages.check_quality(table).count() == 2 * len(names)
    found = stages.analyse(table)
    assert {"correlations", "regime_segments", "tier_growth", "price_zones"} <= set(found)
    for frame in found.values():
        frame.write.format("noop").mode("overwrite").save()
    assert set(stages.analyse(table.select("asset", "time", "TxCnt"))) == set()
