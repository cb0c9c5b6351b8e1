"""Pairwise-complete correlations of many metrics from blocks of moments.

A task turns each batch of rows into matrix products: for all pairs of metrics at once the number
of rows that have both, and each one's mean, spread and common moment over these rows. Batches are
merged in the task; what leaves it is one row per key and metric with the moments towards the
metrics after it. So a row is never multiplied by its pairs, and work per row is one pass of
multiply-adds over k * k numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.expressions import c

# A task gives out what it has gathered when it holds this many numbers.
HELD_NUMBERS = 16_000_000
FIELDS = ("n", "mean_x", "mean_y", "xx", "yy", "xy", "low_x", "high_x", "low_y", "high_y")


class Moments:
    """Moments of every pair (i, j): of metric i over the rows that have j as well, and in common."""

    def __init__(self, n, mean, square, cross, low, high):
        self.n, self.mean, self.square, self.cross, self.low, self.high = n, mean, square, cross, low, high

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        """Rows of one key; NaN is missing. Values are shifted by the first of their metric, so a
        metric that is constant has no spread at all."""
        there = ~np.isnan(x)
        mask = there.astype(float)
        shift = np.where(there.any(axis=0), x[there.argmax(axis=0), np.arange(x.shape[1])], 0.0)
        moved = np.where(there, x - shift, 0.0)
        n = mask.T @ mask
        total, square, cross = moved.T @ mask, (moved * moved).T @ mask, moved.T @ moved
        share = np.divide(total, n, out=np.zeros_like(n), where=n > 0)
        low, high = np.full_like(n, np.inf), np.full_like(n, -np.inf)
        patterns, kind = np.unique(there, axis=1, return_inverse=True)
        for number, rows in enumerate(patterns.T):
            if rows.any():
                some = x[rows]
                gaps = np.isnan(some)
                at = np.flatnonzero(kind.ravel() == number)
                low[:, at] = np.where(gaps, np.inf, some).min(axis=0)[:, None]
                high[:, at] = np.where(gaps, -np.inf, some).max(axis=0)[:, None]
        square = np.where(low == high, 0.0, np.maximum(square - total * share, 0.0))
        return cls(n, shift[:, None] + share, square, cross - total * share.T, low, high)

    def add(self, other: Moments) -> Moments:
        n = self.n + other.n
        with np.errstate(invalid="ignore"):
            apart = np.where((self.n > 0) & (other.n > 0), other.mean - self.mean, 0.0)
        share = np.divide(other.n, n, out=np.zeros_like(n), where=n > 0)
        mean = np.where(self.n > 0, self.mean + apart * share, other.mean)
        square = self.square + other.square + apart * apart * self.n * share
        cross = self.cross + other.cross + apart * apart.T * self.n * share
        return Moments(n, mean, square, cross, np.minimum(self.low, other.low), np.maximum(self.high, other.high))

    def rows(self) -> Iterator[dict]:
        """Per metric i its moments towards i and all metrics after it."""
        for i in range(len(self.n)):
            of = slice(i, None)
            yield {
                "i": i, "n": self.n[i, of], "mean_x": self.mean[i, of], "mean_y": self.mean[of, i],
                "xx": self.square[i, of], "yy": self.square[of, i], "xy": self.cross[i, of],
                "low_x": self.low[i, of], "high_x": self.high[i, of], "low_y": self.low[of, i], "high_y": self.high[of, i],
            }


def merged(a: dict, b: dict) -> dict:
    """Two moment rows of one metric, of different tasks, as one."""
    n = a["n"] + b["n"]
    share = np.divide(b["n"], n, out=np.zeros_like(n), where=n > 0)
    both = (a["n"] > 0) & (b["n"] > 0)
    out = {"n": n}
    apart = {}
    for axis in "xy":
        mean_a, mean_b = a[f"mean_{axis}"], b[f"mean_{axis}"]
        apart[axis] = np.where(both, mean_b - mean_a, 0.0)
        out[f"mean_{axis}"] = np.where(a["n"] > 0, mean_a + apart[axis] * share, mean_b)
        out[f"low_{axis}"] = np.minimum(a[f"low_{axis}"], b[f"low_{axis}"])
        out[f"high_{axis}"] = np.maximum(a[f"high_{axis}"], b[f"high_{axis}"])
    for field, one, other in (("xx", "x", "x"), ("yy", "y", "y"), ("xy", "x", "y")):
        out[field] = a[field] + b[field] + apart[one] * apart[other] * a["n"] * share
    return out


def correlation(moments: dict) -> np.ndarray:
    """NaN where fewer than one row has both, or one of them is constant over these rows."""
    spread = np.sqrt(moments["xx"]) * np.sqrt(moments["yy"])
    varies = (moments["low_x"] < moments["high_x"]) & (moments["low_y"] < moments["high_y"])
    out = np.full(len(spread), np.nan)
    return np.divide(moments["xy"], spread, out=out, where=varies & (spread > 0))


def pair_correlations(df: DataFrame, metrics: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, i, j, corr) for all metric numbers i <= j."""
    keys, count = list(keys), len(metrics)
    names = [f"_key_{i}" for i in range(len(keys))]
    key_types = ", ".join(f"{n} {df.schema[k].dataType.simpleString()}" for n, k in zip(names, keys, strict=True))
    arrays = ", ".join(f"{field} array<double>" for field in FIELDS)
    rows = df.select(*[c(k).alias(n) for n, k in zip(names, keys, strict=True)], *[c(m).cast("double").alias(f"_m{i}") for i, m in enumerate(metrics)])
    values = [f"_m{i}" for i in range(count)]

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[pd.DataFrame, Moments]] = {}

        def given():
            for first, moments in held.values():
                found = pd.DataFrame(list(moments.rows()))
                for name in names:
                    found[name] = [first[name].iloc[0]] * len(found)
                yield found[[*names, "i", *FIELDS]]
            held.clear()

        for batch in batches:
            for key, some in batch.groupby(names, dropna=False, sort=False):
                known = tuple(None if pd.isna(x) else x for x in key)
                moments = Moments.of(some[values].to_numpy(float))
                held[known] = (held[known][0], held[known][1].add(moments)) if known in held else (some.iloc[:1], moments)
            if len(held) * count * count * 6 > HELD_NUMBERS:
                yield from given()
        yield from given()

    def joined(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("n", key=lambda x: x.map(sum), kind="stable")
        total = None
        for row in parts[list(FIELDS)].itertuples(index=False):
            part = {field: np.asarray(value, float) for field, value in zip(FIELDS, row, strict=True)}
            total = part if total is None else merged(total, part)
        found = correlation(total)
        i = int(parts["i"].iloc[0])
        out = pd.DataFrame({"i": i, "j": np.arange(i, i + len(found)), "corr": found})
        for name in names:
            out[name] = [parts[name].iloc[0]] * len(out)
        return out[[*names, "i", "j", "corr"]]

    parts = rows.mapInPandas(gathered, f"{key_types}, i int, {arrays}")
    found = parts.groupBy(*names, "i").applyInPandas(joined, f"{key_types}, i int, j int, corr double")
    return found.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "i", "j", F.when(~F.isnan("corr"), F.col("corr")).alias("corr"))
