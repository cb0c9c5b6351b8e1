import numpy as np
import pandas as pd
import pytest
from frames import column, days, listed, ticks
from pyspark.sql import functions as F

from seriesmill.operators import stats, windows

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def sample(n, seed=0):
    rng = np.random.default_rng(seed)
    return [float(v) for v in np.where(rng.random(n) < 0.4, 3.0, np.exp(rng.normal(0, 3, n)))]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1001])
def test_percentiles_are_exact_in_both_layouts(spark, n):
    values = sample(n)
    expected = np.percentile(values, [p * 100 for p in PROBS])
    df = days(spark, [*values, None])
    for layout in ("whole", "chunked"):
        row = stats.percentiles(df, "v", PROBS, layout=layout).first()
        assert list(row)[1:] == pytest.approx(list(expected))


def test_ranked_percentiles_on_uneven_keys(spark):
    df = ticks(spark, 31, 900).where("v is not null")
    got = {r["asset"]: list(r)[1:] for r in stats.ranked_percentiles(df, "v").collect()}
    for asset, rows in df.toPandas().groupby("asset"):
        assert got[asset] == pytest.approx(list(np.percentile(rows["v"], [10, 25, 50, 75, 90])))


def test_bands_use_lower_bound_inclusive(spark):
    df = days(spark, [float(i) for i in range(11)])
    got = column(stats.volatility_regime(df, "v"), "band")
    assert got == (
        ["very_low"] + ["low"] * 2 + ["normal"] * 2 + ["elevated"] * 3 + ["high"] + ["extreme"] * 2
    )


def test_histogram_equals_numpy(spark):
    values = sample(500, 3)
    counts, edges = np.histogram(values, bins=50)
    density, _ = np.histogram(values, bins=50, density=True)
    out = stats.histogram_density(days(spark, values), "v")
    assert column(out, "n", "bin") == list(counts)
    assert column(out, "density", "bin") == pytest.approx(list(density))
    assert column(out, "bin_start", "bin") == pytest.approx(list(edges[:-1]))


def test_histogram_of_a_constant(spark):
    counts, _ = np.histogram([4.0, 4.0], bins=50)
    assert column(stats.histogram_density(days(spark, [4.0, 4.0]), "v"), "n", "bin") == list(counts)


def test_density_formula(spark):
    values = np.array(sample(200, 5))
    grid = np.linspace(values.min(), values.max(), 100)
    h = len(values) ** (-1 / 5) * values.std(ddof=1)
    z = (grid[:, None] - values[None, :]) / h
    expected = np.exp(-0.5 * z**2).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi))
    out = stats.kde_grid(days(spark, [*map(float, values), None]), "v")
    assert column(out, "density", "point") == pytest.approx(list(expected))
    assert stats.kde_grid(days(spark, [1.0, 1.0]), "v").count() == 0
    assert stats.kde_grid(days(spark, [1.0]), "v").count() == 0


def test_density_is_exact_far_from_all_values(spark):
    """Gaps of many bandwidths, values on box edges, a large offset, an uneven second series."""
    rng = np.random.default_rng(8)
    cases = {
        "gaps": np.concatenate([rng.normal(0, 1, 2000), [25.0, 25.0, 60.0]]),
        "offset": 1e6 + np.arange(500) / 8.0,
        "skew": np.exp(rng.normal(0, 2, 1500)),
    }
    df = days(spark, map(float, cases["gaps"]), "gaps").union(days(spark, map(float, cases["offset"]), "offset"))
    df = df.union(days(spark, map(float, cases["skew"]), "skew")).union(days(spark, map(float, cases["skew"]), None))
    for points in (2, 100, 333):
        out = stats.kde_grid(df, "v", points).toPandas().sort_values("point")
        for name, values in [*cases.items(), (None, cases["skew"])]:
            got = out[out["asset"].isna() if name is None else out["asset"] == name]["density"].to_numpy()
            grid = np.linspace(values.min(), values.max(), points)
            h = len(values) ** (-1 / 5) * values.std(ddof=1)
            z = (grid[:, None] - values[None, :]) / h
            expected = np.exp(-0.5 * z**2).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi))
            normal = expected > 1e-290
            assert len(got) == points
            assert np.abs(got[normal] / expected[normal] - 1).max() < 1e-10
            assert np.abs(got[~normal] - expected[~normal]).max(initial=0.0) < 1e-290


def test_density_adds_a_row_to_one_box(spark):
    """Rows reach the grid only as boxes: what is laid out by points is an aggregate by box."""
    plan = stats.kde_grid(days(spark, [1.0, 2.0, 4.0]), "v", 50)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    laid_out = next(i for i, line in enumerate(plan) if "Generate explode" in line)
    by_box = next(i for i, line in enumerate(plan) if "Aggregate [" in line and "_box" in line.split("],")[0])
    assert laid_out < by_box and not any("Generate" in line for line in plan[by_box:])


def test_first_of_equal_extremes_wins(spark):
    row = stats.peak_trough(days(spark, [1.0, 9.0, 9.0, 0.5, 0.5, None]), "v").first()
    assert (row["peak_time"].day, row["trough_time"].day) == (2, 4)
    assert (row["peak_value"], row["trough_value"]) == (9.0, 0.5)


def test_correlation_is_pairwise_complete_and_null_for_constants(spark):
    frame = pd.DataFrame(
        {
            "x": [1.0, 2.0, 3.0, None, 7.0], "y": [2.0, None, 1.0, 4.0, 9.0],
            "z": [5.0] * 5, "w": [1.0, 5.0, 1.0, 2.0, None],
        }
    )
    rows = [("a", *(None if pd.isna(v) else v for v in r)) for r in frame.itertuples(index=False)]
    df = spark.createDataFrame(rows, "asset string, x double, y double, z double, w double")
    matrix = frame.corr()
    for r in stats.correlation_full(df, ["x", "y", "z", "w"]).collect():
        expected = matrix.loc[r["a"], r["b"]]
        assert r["corr"] is None if pd.isna(expected) else r["corr"] == pytest.approx(expected)
    with pytest.raises(ValueError, match="at least two"):
        stats.correlation_matrix(df, ["x"])


def test_top_pairs_and_distance(spark):
    df = days(spark, [1.0, 2.0, 3.0, 5.0]).withColumns(
        {"u": F.col("v") * 2, "d": -F.col("v"), "e": F.pow("v", F.lit(2))}
    )
    names = ["v", "u", "d", "e"]
    top = {(r["side"], r["rank"]): (r["a"], r["b"]) for r in stats.top_correlations(df, names, 2).collect()}
    assert top["highest", 1] == ("v", "u")
    assert top["lowest", 1] == ("v", "d") and top["lowest", 2] == ("u", "d")
    for r in stats.correlation_distance(df, ["v", "d"]).collect():
        assert r["distance"] == pytest.approx(0.0)


def test_fit_of_constant_x_is_null(spark):
    df = days(spark, [1.0, 2.0, 4.0]).withColumn("x", F.lit(3.0))
    assert stats.ols_fit(df, "x", "v").first()["slope"] is None
    line = df.withColumn("x", F.col("v") * 2 + 1)
    row = stats.ols_fit(line, "v", "x").first()
    assert (row["slope"], row["intercept"], row["n"]) == (pytest.approx(2.0), pytest.approx(1.0), 3)


@pytest.mark.parametrize("layout", ["whole", "chunked"])
def test_describe_equals_pandas(spark, layout):
    values = [*sample(101, 9), None]
    row = stats.describe(days(spark, values), ["v"], layout=layout).first()
    expected = pd.Series(values, dtype=float).describe()
    assert [row[n] for n in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")] == pytest.approx(
        list(expected)
    )
    middle = stats.mean_median(days(spark, values), "v", layout=layout).first()
    assert middle["median"] == pytest.approx(pd.Series(values, dtype=float).median())


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_layouts_give_the_same_results(spark, threshold):
    """With per-key figures joined by shuffle and by broadcast."""
    df = ticks(spark, 51, 500)
    checks = (
        lambda layout: stats.percentiles(df, "v", layout=layout),
        lambda layout: stats.volatility_regime(df, "v", layout=layout),
        lambda layout: stats.histogram_density(df, "v", layout=layout),
        lambda layout: stats.kde_grid(df, "v", layout=layout),
        lambda layout: windows.growth_from_base(df, ["v"], layout=layout),
    )
    expected = [listed(check("whole"), 8) for check in checks]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        assert [listed(check("chunked"), 8) for check in checks] == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("points", [2, 10, 25])
def test_grid_has_as_many_points_as_asked(spark, points):
    out = stats.kde_grid(days(spark, [1.0, 2.0, 4.0]), "v", points)
    assert column(out, "point", "point") == list(range(points))
    assert column(out, "x", "point")[-1] == pytest.approx(4.0)


def test_dataset_info(spark):
    row = stats.dataset_info(days(spark, [None, 1.0])).first()
    assert (row["n_rows"], row["n_columns"], row["missing_values"]) == (2, 2, 1)


def test_all_missing_series(spark):
    df = days(spark, [None, None])
    assert stats.kde_grid(df, "v").count() == 0
    assert stats.histogram_density(df, "v").count() == 0
    assert stats.peak_trough(df, "v").count() == 0
    assert listed(stats.mean_median(df, "v", layout="chunked")) == [("a", None, None)]
