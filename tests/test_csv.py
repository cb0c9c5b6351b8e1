"""Quoted line breaks, many headers, and checks that no query can leave out."""

import io
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesmill.sources import csv


@pytest.fixture
def small_blocks(spark):
    """Files are cut into blocks of a few hundred bytes, several of them in a task."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    yield
    for name in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{name}")


def cells(rng):
    word = lambda: rng.choice(["plain", "two words", 'say ""so""', "a,b", "", "é"])
    inner = "\n".join(word() for _ in range(rng.choice([1, 1, 1, 2, 3, 9])))
    return f'"{inner}"' if rng.random() < 0.6 or re.search('[,\n"]', inner) else inner


@pytest.mark.parametrize("seed", range(3))
def test_quoted_line_breaks_over_blocks(spark, tmp_path, small_blocks, seed):
    rng = random.Random(seed)
    expected = {}
    for asset in ("a", "b", "c"):
        names = ["time", "v", "Note", "More"] if asset != "b" else ["Note", "More", "time", "v"]
        lines = [",".join(names)]
        for i in range(rng.choice([3, 120])):
            row = {"time": f"2024-01-{i % 28 + 1:02d}", "v": rng.choice(["", "1.5", '"2"', "NA", str(i)]), "Note": cells(rng), "More": cells(rng) if asset == "c" else "x"}
            lines.append(",".join(row[n] for n in names))
            if rng.random() < 0.1:
                lines.append("")
        text = "\n".join(lines) + "\n"
        (tmp_path / f"{asset}.csv").write_text(text)
        expected[asset] = pd.read_csv(io.StringIO(text), dtype={"Note": str, "More": str})
    read = csv.read_metric_csvs(spark, str(tmp_path), text_columns=("Note", "More"))
    for asset, frame in expected.items():
        ours = [tuple(r) for r in read.where(F.col("asset") == asset).orderBy("seq").select(F.col("time").cast("string"), "v", "Note", "More").collect()]
        theirs = [tuple(None if pd.isna(x) else x for x in r) for r in frame[["time", "v", "Note", "More"]].itertuples(index=False)]
        assert ours == theirs
    assert read.where("Note like '%\n%\n%'").count() > 0


def test_names_may_hold_line_breaks_and_quotes(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text('﻿time,"price\nin ""USD"""," n "\n2024-01-01,1,2\n')
    (tmp_path / "b.csv").write_text("\n \nn,time\n5,2024-01-02\n")
    rows = csv.read_metric_csvs(spark, str(tmp_path)).orderBy("seq")
    assert set(rows.columns) == {"asset", "time", "seq", 'price\nin "USD"', "n"}
    assert [(r["asset"], r["n"], r['price\nin "USD"']) for r in rows.collect()] == [("a", 2.0, 1.0), ("b", 5.0, None)]


def test_cells(spark):
    rows = {
        "": [""], ",": ["", ""], "a,,b,": ["a", "", "b", ""], '"",x': ["", "x"], '"a,b","c ""d"""': ["a,b", 'c "d"'],
        '""""': ['"'], '"""a"': ['"a'], 'it\'s 5" wide,b': ['it\'s 5" wide', "b"], '"l1\nl2",3': ["l1\nl2", "3"], '"a"b,c': ["ab", "c"],
    }
    frame = spark.createDataFrame([(x,) for x in rows], "record string")
    found = {r[0]: r[1] for r in frame.select("record", csv.fields_of(F.col("record"))).collect()}
    assert found == rows


def test_many_headers_are_one_expression(spark, tmp_path):
    def plan_size(count, at):
        folder = tmp_path / f"n{count}"
        folder.mkdir()
        rng = random.Random(count)
        metrics = [f"m{i}" for i in range(8)]
        wanted = []
        for i in range(count):
            names = ["time", *metrics]
            rng.shuffle(names)
            (folder / f"f{i:04d}.csv").write_text(",".join(names) + "\n" + ",".join("2024-01-01" if n == "time" else f"{i}.{n[1:]}" for n in names) + "\n")
            wanted.append((f"f{i:04d}", *[float(f"{i}.{k}") for k in range(8)]))
        spark.sparkContext.setJobDescription(f"headers {count}")
        plans = []
        plain = csv.written
        at.setattr(csv, "written", lambda df, name: plans.append((name, len(df._jdf.queryExecution().analyzed().toString()))) or plain(df, name))
        rows = csv.read_metric_csvs(spark, str(folder))
        assert sorted(tuple(r) for r in rows.select("asset", *metrics).collect()) == sorted(wanted)
        return dict(plans)["csv-parsed"]

    with pytest.MonkeyPatch.context() as at:
        few = plan_size(20, at)
    with pytest.MonkeyPatch.context() as at:
        many = plan_size(2000, at)
    assert abs(many - few) < 0.05 * few


@pytest.mark.parametrize("line", ["2024-01-05,oops,1", "2024-01-05,1", "2024-01-05,1,2,3", "someday,1,2"])
def test_no_query_leaves_the_check_out(spark, tmp_path, line):
    (tmp_path / "bad.csv").write_text(f"time,v,w\n2024-01-01,5,6\n{line}\n")
    for look in (lambda r: r.select("asset", "w").collect(), lambda r: r.count()):
        with pytest.raises(ValueError, match="bad.csv"):
            look(csv.read_metric_csvs(spark, str(tmp_path)))


def test_quotes_that_never_end(spark, tmp_path, monkeypatch):
    (tmp_path / "good.csv").write_text("time,v\n2024-01-01,1\n")
    (tmp_path / "open.csv").write_text('time,v\n2024-01-01,"1\n2024-01-02,2\n')
    (tmp_path / "far.csv").write_text('time,v\n2024-01-01,"1\n' + "2024-01-02,2\n" * 30 + '2024-01-01,"1\n')
    monkeypatch.setattr(csv, "MOST_LINES", 20)
    status = {r["asset"]: (r["status"], r["detail"]) for r in csv.file_status(spark, str(tmp_path)).collect()}
    assert status == {"good": ("ok", ""), "open": ("skipped", "a quote is never closed"), "far": ("skipped", "a quote is never closed, lines: 1")}
    kept = csv.read_metric_csvs(spark, str(tmp_path), on_error="skip")
    assert [r["asset"] for r in kept.collect()] == ["good"]


def test_a_line_like_the_header_is_a_record(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,Note\n2024-01-01,x\ntime,Note\n")
    with pytest.raises(ValueError, match="no such time"):
        csv.read_metric_csvs(spark, str(tmp_path), text_columns=("Note",))
    (tmp_path / "a.csv").write_text("time,time\n2024-01-01,2024-01-01\n")
    assert csv.file_status(spark, str(tmp_path)).first()["detail"] == "a column name is repeated"


def test_text_is_parsed_once(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("time,v\n2024-01-01,1\n")
    scans = {}
    plain = csv.written
    monkeypatch.setattr(csv, "written", lambda df, name: scans.update({name: df._jdf.queryExecution().executedPlan().toString().count("Scan text")}) or plain(df, name))
    rows = csv.read_metric_csvs(spark, str(tmp_path))
    assert scans == {"csv-blocks": 1, "csv-files": 0, "csv-parsed": 1, "csv-status": 0}
    assert "Scan text" not in rows._jdf.queryExecution().executedPlan().toString()
