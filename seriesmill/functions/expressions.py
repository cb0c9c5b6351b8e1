"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def c(name: str) -> Column:
    """Column by exact name; metric names are data and may hold dots."""
    return F.col(f"`{name.replace('`', '``')}`")


def ratio(numerator: Column, denominator: Column) -> Column:
    """True division that is NULL on a zero or missing base (ANSI `/` would fail the job)."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def finite(value: Column) -> Column:
    """NaN and both infinities become NULL."""
    unbounded = value.isin(float("inf"), float("-inf")) | F.isnan(value)
    return F.when(~unbounded, value)


def floor_at_zero(value: Column) -> Column:
    """Clip below zero; NULL stays NULL (``greatest`` would turn it into 0)."""
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where NULL is a key like any other; the keys come out once."""
    other = {k: f"_right_{i}" for i, k in enumerate(keys)}
    renamed = right.select(*[c(n).alias(other.get(n, n)) for n in right.columns])
    same = reduce(lambda a, b: a & b, [c(k).eqNullSafe(F.col(o)) for k, o in other.items()])
    joined = left.join(renamed, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*other.values())


def is_date(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.DateType)


def elapsed_days(start: Column, end: Column, dates: bool) -> Column:
    """Days from start to end, fractional for timestamps."""
    if dates:
        return F.datediff(end, start).cast("double")
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(86_400_000_000.0)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Names of numeric columns, key columns left out."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def require_columns(df: DataFrame, names: list[str] | tuple[str, ...]) -> None:
    """Fail before any job starts when an input metric is absent."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def columns_with_values(df: DataFrame, names: list[str] | tuple[str, ...]) -> list[str]:
    """The wanted columns that exist and have a value in any row; one aggregate over the rows."""
    there = present_columns(df, names)
    if not there:
        return []
    counts = df.agg(*[F.count(c(n)).alias(f"_{i}") for i, n in enumerate(there)]).first()
    return [n for n, count in zip(there, counts) if count]


def require_values(df: DataFrame, names: list[str] | tuple[str, ...]) -> None:
    """Fail when an input metric is absent or has no value at all."""
    require_columns(df, names)
    filled = columns_with_values(df, names)
    empty = [n for n in names if n not in filled]
    if empty:
        raise ValueError(f"required columns without values: {empty}")


def present_columns(df: DataFrame, names: list[str] | tuple[str, ...]) -> list[str]:
    """The wanted columns that exist, in the wanted order (absent ones are skipped)."""
    return [n for n in names if n in df.columns]


def chart_columns(
    df: DataFrame,
    contains: tuple[str, ...] = (),
    limit: int | None = 3,
    exclude: tuple[str, ...] = ("asset", "time"),
) -> list[str]:
    """Columns picked for a chart: by name fragment, or else the first numeric ones."""
    if contains:
        names = [
            n for n in df.columns
            if n not in exclude and any(part.lower() in n.lower() for part in contains)
        ]
    else:
        names = numeric_columns(df, exclude)
    return names if limit is None else names[:limit]


# --- labels (fixed values: names and bounds) ---------------------------------

# Valuation zones as (lower bound exclusive, label); the upper bound of a zone is
# the lower bound of the one before it, inclusive. At or below the last: no zone.
MVRV_ZONES = (
    (3.0, "overvalued"),
    (2.5, "caution"),
    (2.0, "warming up"),
    (1.0, "fair"),
    (0.0, "undervalued"),
)
VOLATILITY_BANDS = ("very_low", "low", "normal", "elevated", "high", "extreme")


def mvrv_zone(value: Column) -> Column:
    (bound, label), *rest = MVRV_ZONES
    zone = F.when(value > bound, label)
    for bound, label in rest:
        zone = zone.when(value > bound, label)
    return zone


def regime(whale: Column, flow: Column) -> Column:
    """Holder regime from the signs of whale activity and dormancy flow."""
    return (
        F.when((whale > 0) & (flow < 0), "distribution")
        .when((whale > 0) & (flow > 0), "reshuffling")
        .when((whale < 0) & (flow > 0), "accumulation")
        .when((whale < 0) & (flow < 0), "cashout")
    )


def sign_class(delta: Column) -> Column:
    """Zero and missing count as negative."""
    return F.when(delta > 0, "positive").otherwise("negative")


def volatility_band(value: Column, cuts: list[Column]) -> Column:
    """Band of a value among ascending cut points (lower bound inclusive)."""
    band = F.when(value.isNull(), F.lit(None).cast("string"))
    for cut, label in zip(cuts, VOLATILITY_BANDS):
        band = band.when(value < cut, label)
    return band.otherwise(VOLATILITY_BANDS[-1])
