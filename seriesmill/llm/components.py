"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import written

MOST_ROUNDS = 60


class Forest:
    """Sets of connected nodes; `unite` says whether a link connects two of them."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, node: int) -> int:
        above = self.above
        top = node
        while top in above:
            top = above[top]
        while node != top:
            above[node], node = top, above[node]
        return top

    def unite(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.above[max(a, b)] = min(a, b)
        return a != b


def forest(links: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
    """Frames (a, b) of those links that connect what earlier ones have not."""
    joined = Forest()
    for a, b in links:
        kept = [x for x in zip(a.tolist(), b.tolist(), strict=True) if joined.unite(*x)]
        yield pd.DataFrame(kept, columns=["a", "b"], dtype=np.int64)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, label: the smallest node of its component, for every node of the edges (a, b).

    In each round every node points to its smallest neighbour, if that is smaller. Pointers are
    followed to their ends by doubling, the ends take the place of all nodes, and what links are
    left between them go on to the next round: at most half of the nodes, and each pair of ends
    once. Joins are between written tables, where adaptive execution splits the rows of a node with
    many; minima are combined before each shuffle.
    """
    edges = written(_between(edges.select("a", "b")), f"{name}-edges")
    labels = None
    for step in range(MOST_ROUNDS):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
        ends = _ends(smallest.select("node", F.least("node", "b").alias("end")), f"{name}-{step}")
        if labels is None:
            labels = ends.select("node", F.col("end").alias("label"))
        else:
            next_label = ends.select(F.col("node").alias("label"), "end")
            labels = labels.join(next_label, "label", "left").select("node", F.coalesce("end", "label").alias("label"))
        labels = written(labels, f"{name}-labels-{step}")
        at_a = ends.select(F.col("node").alias("a"), F.col("end").alias("end_a"))
        at_b = ends.select(F.col("node").alias("b"), F.col("end").alias("end_b"))
        met = edges.join(at_a, "a").join(at_b, "b").select(F.col("end_a").alias("a"), F.col("end_b").alias("b"))
        edges = written(_between(met), f"{name}-edges-{step}")
        if edges.isEmpty():
            return labels
    raise RuntimeError(f"components are not found in {MOST_ROUNDS} rounds")


def _between(edges: DataFrame) -> DataFrame:
    """Each link between two different nodes once, the smaller node first."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _ends(pointers: DataFrame, name: str) -> DataFrame:
    """node, end: where pointers (node, end) lead in the end; every end is a node."""
    pointers = written(pointers, name)
    for _ in range(MOST_ROUNDS):
        further = pointers.select(F.col("node").alias("end"), F.col("end").alias("further"))
        jumped = pointers.join(further, "end").select("node", F.col("further").alias("end"), (F.col("further") != F.col("end")).alias("moved"))
        jumped = written(jumped, name)
        if jumped.where("moved").isEmpty():
            return jumped.select("node", "end")
        pointers = jumped.select("node", "end")
    raise RuntimeError(f"pointers do not end in {MOST_ROUNDS} doublings")
