"""Small frames and comparisons for the tests."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

START = date(2020, 1, 1)
NOON = datetime(2020, 1, 1, 12)


def days(spark, values, asset="a", name="v", start=START):
    """One DATE series with a row per value."""
    rows = [(asset, start + timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"asset string, time date, {name} double")


def ticks(spark, seed=1, n=400, hot=0.6):
    """Timestamp series of uneven length; one asset holds most rows. Nulls, zeros, repeats."""
    rng = random.Random(seed)
    rows, moment = [], {}
    for _ in range(n):
        asset = "hot" if rng.random() < hot else rng.choice("xyz")
        at = moment.get(asset, NOON) + timedelta(seconds=rng.choice([1, 60, 1800, 7200, 200_000]))
        moment[asset] = at
        value = rng.choice([None, 0.0, 5.0, 5.0, 5.0, rng.uniform(-10, 100)])
        rows.append((asset, at, value))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "asset string, time timestamp_ntz, v double")


def listed(df, digits=9):
    """Sorted rows as tuples of comparable values."""

    def shown(v):
        return round(v, digits) + 0.0 if isinstance(v, float) else v

    rows = [tuple(shown(v) for v in r) for r in df.collect()]
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)), v or 0) if not isinstance(v, str) else (True, "s", v) for v in r))


def column(df, name, order="time"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]
