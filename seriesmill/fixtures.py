"""Metric series derived from the test tables, in the shape of the operators' input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesmill.functions.expressions import c, ratio
from seriesmill.operators.windows import compute_features, volatility_of
from seriesmill.sources.scratch import written

BASE_METRICS = (
    "PriceUSD", "TxCnt", "AdrActCnt", "CapMrktCurUSD", "AdrBalCnt", "AdrBalUSD10KCnt",
    "AdrBalUSD100KCnt", "AdrBalUSD1MCnt", "AdrBal1in10KCnt", "AdrBal1in100KCnt", "SplyCur",
    "SplyAdrTop1Pct", "SplyAct180d", "SplyAct1yr", "SplyAct2yr", "CapMVRVCur",
)
PRICE_METRICS = ("ROI30d", "ROI1yr", "VtyDayRet30d", "NVTAdj90")

_SLABS = 1_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _top_customers(per_day: DataFrame) -> DataFrame:
    """The 1 % of customers with the highest totals, without one global sort.

    Approximate quantiles of the totals cut them into `_SLABS` slabs of about equal size, however
    many customers there are; a total is in the slab that its rank falls in. Slabs are counted;
    only those that reach into the top are ranked, each on its own, and there are about
    `_SLABS` / 100 of them. The totals are worked out once and written.
    """
    totals = written(per_day.groupBy("o_custkey").agg(F.sum("cap").alias("total")), "totals")
    # The top hundredth, in steps of a slab; everything below is one slab of no interest.
    shares = [1 - i / _SLABS for i in range(_SLABS // 50, 0, -1)]
    found = totals.agg(
        F.percentile_approx("total", shares, 10 * _SLABS).alias("cuts"), F.count("*").alias("n")
    ).first()
    cuts = sorted(set(found["cuts"] or []))
    slab = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut <= F.col("total")))
    slabbed = totals.withColumn("slab", slab if cuts else F.lit(0))
    counts = {r["slab"]: r["count"] for r in slabbed.groupBy("slab").count().collect()}
    above = {k: sum(n for other, n in counts.items() if other > k) for k in counts}
    reached = {k: n for k, n in above.items() if (n + 1) * 100 <= found["n"]}
    if not reached:
        return totals.where("false").select("o_custkey", F.lit(True).alias("is_top"))
    starts = F.create_map(*[F.lit(x) for pair in reached.items() for x in pair])
    in_slab = Window.partitionBy("slab").orderBy(F.desc("total"), "o_custkey")
    return (
        slabbed.where(F.col("slab").isin(list(reached)))
        .withColumn("place", starts[F.col("slab")] + F.row_number().over(in_slab))
        .where(F.col("place") * 100 <= found["n"])
        .select("o_custkey", F.lit(True).alias("is_top"))
    )


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("asset"),
        F.col("o_orderdate").cast("date").alias("time"),
        "o_custkey",
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
    )


# Orders at or above these totals, in cents.
_TIER_BOUNDS = {"t1": 10_000_000, "t2": 25_000_000, "t3": 40_000_000}


def _days(spark: SparkSession, sf_dir: str, metrics: Sequence[str]) -> DataFrame:
    """Totals per (asset, day), summed in the tasks that read the orders.

    Only metrics about customers need a first step per (asset, day, customer); it also
    stands in for a distinct count, so a hot customer is one row per day.
    """
    with_top = "SplyAdrTop1Pct" in metrics
    sums = ("tx", "cap", *_TIER_BOUNDS)
    totals = [
        F.count(F.lit(1)).alias("tx"),
        F.sum("cents").alias("cap"),
        *[F.count_if(F.col("cents") >= b).alias(n) for n, b in _TIER_BOUNDS.items()],
    ]
    orders = _orders(spark, sf_dir)
    if not with_top and "AdrActCnt" not in metrics:
        return orders.groupBy("asset", "time").agg(*totals)
    rows = orders.groupBy("asset", "time", "o_custkey").agg(*totals)
    extra = [F.count(F.lit(1)).alias("act")]
    if with_top:
        rows = rows.join(_top_customers(rows), "o_custkey", "left")
        extra.append(F.sum(F.when(F.col("is_top"), F.col("cap")).otherwise(0)).alias("topc"))
    return rows.groupBy("asset", "time").agg(*[F.sum(n).alias(n) for n in sums], *extra)


def _running(name: str, rows: int | None = None) -> Column:
    by_day = Window.partitionBy("asset").orderBy("time")
    start = Window.unboundedPreceding if rows is None else 1 - rows
    return F.sum(name).over(by_day.rowsBetween(start, 0))


def _trailing_days(days: int) -> Column:
    """Supply moved in the last ``days`` days, as a difference of running totals.

    A frame that grows from the start is updated row by row, a sliding one is re-added
    for every row; in whole cents both give the same sum.
    """
    by_number = Window.partitionBy("asset").orderBy("dn")
    before = F.last("supply").over(by_number.rangeBetween(Window.unboundedPreceding, -days))
    return F.col("supply") - F.coalesce(before, F.lit(0))


def _real(value: str | Column) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("double")


_COLUMNS = {
    "PriceUSD": lambda: _real("cap") / F.col("tx") / 100,
    "TxCnt": lambda: _real("tx"),
    "AdrActCnt": lambda: _real("act"),
    "CapMrktCurUSD": lambda: _real("cap") / 100,
    "AdrBalCnt": lambda: _real(_running("tx")),
    "AdrBalUSD10KCnt": lambda: _real(_running("t1")),
    "AdrBalUSD100KCnt": lambda: _real(_running("t2")),
    "AdrBalUSD1MCnt": lambda: _real(_running("t3")),
    "AdrBal1in10KCnt": lambda: _real(_running("t3", 30)),
    "AdrBal1in100KCnt": lambda: _real(_running("t1", 30)),
    "SplyCur": lambda: _real(_running("cap")),
    "SplyAdrTop1Pct": lambda: _real(_running("topc")),
    "SplyAct180d": lambda: _real(_trailing_days(180)),
    "SplyAct1yr": lambda: _real(_trailing_days(365)),
    "SplyAct2yr": lambda: _real(_trailing_days(730)),
    "CapMVRVCur": lambda: F.lit(2.0)
    * (_real("cap") / F.col("tx"))
    / (_real(_running("cap")) / _running("tx")),
}


def daily_metrics(
    spark: SparkSession, sf_dir: str, metrics: Sequence[str] = BASE_METRICS
) -> DataFrame:
    """(asset, time DATE, metrics...) with one row per order priority and day.

    After the aggregate a series holds one row per day, which bounds the windows by the
    calendar. Only what the wanted metrics need is computed.
    """
    base = [m for m in metrics if m in _COLUMNS]
    extra = [m for m in metrics if m in PRICE_METRICS]
    sources = ["PriceUSD", "CapMrktCurUSD", "TxCnt"] if extra else []
    carried = list(dict.fromkeys([*base, *sources]))
    rows = _days(spark, sf_dir, metrics)
    if any(m.startswith("SplyAct") for m in metrics):
        number = F.datediff("time", F.lit("1995-01-01").cast("date")).cast("bigint")
        rows = rows.withColumns({"dn": number, "supply": _running("cap")})
    rows = rows.select("asset", "time", *[_COLUMNS[m]().alias(m) for m in carried])
    if extra:
        rows = _price_metrics(rows, extra, carried)
    return rows.select("asset", "time", *[c(m) for m in metrics])


def _price_metrics(rows: DataFrame, wanted: Sequence[str], carried: Sequence[str]) -> DataFrame:
    by_day = Window.partitionBy("asset").orderBy("time")

    def gain(days: int) -> Column:
        return (ratio(c("PriceUSD"), F.lag("PriceUSD", days).over(by_day)) - 1) * 100

    made = {
        "ROI30d": lambda: gain(30),
        "ROI1yr": lambda: gain(365),
        "NVTAdj90": lambda: ratio(
            c("CapMrktCurUSD"), F.avg("TxCnt").over(by_day.rowsBetween(-89, 0))
        ),
        "VtyDayRet30d": lambda: c("PriceUSD_RV30_return1"),
    }
    if "VtyDayRet30d" in wanted:
        rows = compute_features(
            rows, [volatility_of("PriceUSD", 1, 30)], keep=carried, layout="whole"
        )
    return rows.withColumns({m: made[m]() for m in wanted})


def daily_metrics_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, time, seq, v): nulls, zeros, infinities, flat stretches and copies of times."""
    m = daily_metrics(spark, sf_dir, ["PriceUSD"])
    day = F.dayofyear("time")
    spoiled = (
        F.when(day % 17 < 2, F.lit(None).cast("double"))
        .when(day % 23 == 0, F.lit(0.0))
        .when(day % 29 == 0, F.lit(float("inf")))
        .when(day % 31 < 10, F.lit(7.0))
        .otherwise(F.col("PriceUSD"))
    )
    first = m.select("asset", "time", F.lit(0).alias("seq"), spoiled.alias("v"))
    copies = m.where(day % 37 == 0).select(
        "asset", "time", F.lit(1).alias("seq"), (F.col("PriceUSD") * 2).alias("v")
    )
    return first.unionByName(copies)


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, time, event_id, Val): every event as a row of its type's series."""
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("asset"), F.col("ts").alias("time"), "event_id",
        F.col("value").alias("Val"),
    )


def event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, time, EvtCnt, Val, Users): hourly totals per event type."""
    by_user = read(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("asset"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"),
        "user_id",
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"), F.count("value").alias("nv"))
    return by_user.groupBy("asset", "time").agg(
        F.sum("n").cast("double").alias("EvtCnt"),
        ratio(F.sum("v"), F.sum("nv")).alias("Val"),
        F.count("user_id").cast("double").alias("Users"),
    )
