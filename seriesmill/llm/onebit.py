"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Index: every vector is turned by `ROTATIONS` random rotations; its code is the sign of each
coordinate of each (packed bits), with a correction scalar per rotation, the inner product of the
unit vector with the unit vector of its signs, and its length.

Search: a turned query is cut into `PLANES` bits per coordinate. Inner products with the signs are
counts of common bits of packed words; over the correction scalars, averaged over the rotations,
they estimate the inner product with the vector. The error falls with the square root of the
dimension and of the rotations; `EPSILON` times its scale, the query's rounding included, bounds it
with high probability. The candidates with the highest estimates are scored first, exactly and in
double precision; their k-th score is a floor. A candidate is reranked if its upper bound reaches
the floor; all others are left alone.

Scale: the index is one written table, cut at random into blocks of about `BLOCK_ROWS` rows, so
equal vectors are spread. The stated query set is cut the same way, and every pair of a query
block and a candidate block is one bounded task: a row is copied to as many tasks as the other
side has blocks, so work grows with queries times candidates, one word of bits at a time. Each
task gives at most k rows per query. Memory per task is bounded by the block sizes.

Defined results: a row without id, and a vector that is null, empty, zero or holds a null or non-finite component, take
no part; vectors meet those of equal length only; rows with equal ids are separate candidates, and
a query leaves out its own row only; ties go to the smaller id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import named, written

BLOCK_ROWS = 16_384
QUERY_ROWS = 4_096
ROTATIONS = 8
PLANES = 4
EPSILON = 3.5
FIRST = 4  # times k: how many candidates are scored before the floor is set
QUERIES_AT_ONCE = 128
SEED = 20240501
FOUND = "query_id long, query_row long, vec_id long, row_id long, score double"


def rotation(dim: int, number: int = 0, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, number]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """Bits along the last axis as bytes, filled up to whole words."""
    found = np.packbits(bits, axis=-1)
    short = -found.shape[-1] % 8
    return np.pad(found, [(0, 0)] * (found.ndim - 1) + [(0, short)])


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of all rotations, lengths, and inner products of unit vectors with their signs."""
    dim = vectors.shape[1]
    length = np.linalg.norm(vectors, axis=1)
    turned = np.stack([(vectors / length[:, None]) @ rotation(dim, r) for r in range(ROTATIONS)], axis=1)
    return packed(turned > 0).reshape(len(vectors), -1), length, np.abs(turned).sum(axis=2) / np.sqrt(dim)


def bounds(codes, lengths, fits, queries: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (query, candidate) and the bound on their error."""
    n, dim = len(codes), queries.shape[1]
    # (rotation, word, candidate)
    words = np.ascontiguousarray(np.ascontiguousarray(codes).view(np.uint64).reshape(n, ROTATIONS, -1).transpose(1, 2, 0))
    scale = (lengths[:, None] / fits / np.sqrt(dim) / ROTATIONS).T
    # inner product with signs = 2 * (with bits) - (sum of the query)
    ones = 2 * np.bitwise_count(words).sum(axis=1, dtype=np.int64) * scale
    spread = (lengths[:, None] ** 2 * np.maximum(1 - fits**2, 0) / fits**2 / max(dim - 1, 1)).sum(axis=1) / ROTATIONS**2
    estimate, error = np.zeros((len(queries), n), np.float32), np.zeros((len(queries), n), np.float32)
    turned = np.stack([queries @ rotation(dim, r) for r in range(ROTATIONS)], axis=1)
    low = turned.min(axis=2)
    step = (turned.max(axis=2) - low) / (2**PLANES - 1)
    step[step == 0] = 1
    levels = np.rint((turned - low[:, :, None]) / step[:, :, None]).astype(np.uint8)
    planes = np.stack([packed((levels >> j) & 1) for j in range(PLANES)], axis=2).view(np.uint64)
    sums = low * dim + step * levels.sum(axis=2)
    for q in range(len(queries)):
        rounding = np.zeros(n)
        for r in range(ROTATIONS):
            common = np.zeros(n, np.int32)
            for j in range(PLANES):
                for w, word in enumerate(planes[q, r, j]):
                    common += np.bitwise_count(words[r, w] & word).astype(np.int32) << j
            estimate[q] += low[q, r] * ones[r] + scale[r] * (2 * step[q, r] * common - sums[q, r])
            rounding += (step[q, r] * scale[r]) ** 2
        error[q] = epsilon * np.sqrt((queries[q] @ queries[q]) * spread + rounding * dim / 12)
    return estimate, error


def inner_products(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Of rows with rows; added up component after component, so equal vectors have equal products everywhere."""
    total = np.zeros(len(vectors))
    for d in range(vectors.shape[1]):
        total = total + vectors[:, d] * queries[:, d]
    return total


def best_in_block(codes, lengths, fits, vectors, queries, own, k: int, epsilon: float) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """For each query its k nearest candidates (by place) and their scores; and how many were reranked.

    `own` (query, candidate) marks a query's own row. Candidates of equal score stay in order.
    """
    estimate, error = bounds(codes, lengths, fits, queries, epsilon)
    estimate[own] = -np.inf
    few = min(FIRST * k, len(vectors))
    first = np.argpartition(estimate, len(vectors) - few, axis=1)[:, len(vectors) - few :]
    asked = np.repeat(np.arange(len(queries)), few)
    scores = inner_products(vectors[first.ravel()], queries[asked]).reshape(first.shape)
    scores[np.take_along_axis(own, first, axis=1)] = -np.inf
    floor = np.sort(scores, axis=1)[:, max(few - k, 0)]
    near = estimate + error >= floor[:, None]
    np.put_along_axis(near, first, True, axis=1)
    near &= ~own
    at, candidate = np.nonzero(near)
    exact = inner_products(vectors[candidate], queries[at])
    ends = np.searchsorted(at, np.arange(len(queries) + 1))
    places, found = [], []
    for start, end in zip(ends[:-1], ends[1:], strict=True):
        best = np.argsort(-exact[start:end], kind="stable")[:k]
        places.append(candidate[start:end][best])
        found.append(exact[start:end][best])
    return places, found, len(at)


def index(table: DataFrame, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """The written index: row_id, vec_id, dim, vector, code, length, fits."""
    vector = named(vector_col).cast("array<double>")
    rows = table.select(named(id_col).alias("vec_id"), vector.alias("vector"))
    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & usable & F.exists("vector", lambda x: x != 0))
    rows = rows.withColumn("row_id", F.monotonically_increasing_id()).withColumn("dim", F.size("vector"))

    def coded(batches):
        for batch in batches:
            for _, same in batch.groupby("dim"):
                codes, lengths, fits = encode(np.stack(same["vector"].to_numpy()))
                yield same.assign(code=[x.tobytes() for x in codes], length=lengths, fits=list(fits))

    schema = "row_id long, vec_id long, dim int, vector array<double>, code binary, length double, fits array<double>"
    rows = rows.select("row_id", "vec_id", "dim", "vector")
    return written(rows.mapInPandas(coded, schema), "onebit-index")


def search(coded: DataFrame, queries: DataFrame, k: int = 20, epsilon: float = EPSILON, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query among all rows but its own.

    `queries` are rows of the index.
    """
    many = lambda df, rows: max(1, -(-df.count() // rows))
    n_blocks, n_query_blocks = many(coded, block_rows), many(queries, query_rows)
    side = lambda df, n: F.pmod(F.xxhash64("row_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("dim", side(queries, n_query_blocks).alias("query_block"), "row_id", "vec_id", "vector")
    left = left.withColumn("block", every(n_blocks))
    right = coded.select("dim", side(coded, n_blocks).alias("block"), "row_id", "vec_id", "vector", "code", "length", "fits")
    right = right.withColumn("query_block", every(n_query_blocks))
    keys = ["dim", "block", "query_block"]

    def nearest(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(rows):
            rows = rows.sort_values(["vec_id", "row_id"]).reset_index(drop=True)
            vectors = np.stack(rows["vector"].to_numpy())
            codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
            ids, row_ids = rows["vec_id"].to_numpy(), rows["row_id"].to_numpy()
            lengths, fits = rows["length"].to_numpy(), np.stack(rows["fits"].to_numpy())
            for start in range(0, len(asked), QUERIES_AT_ONCE):
                some = asked.iloc[start : start + QUERIES_AT_ONCE]
                wanted = np.stack(some["vector"].to_numpy())
                own = some["row_id"].to_numpy()[:, None] == row_ids[None, :]
                places, scores, _ = best_in_block(codes, lengths, fits, vectors, wanted, own, k, epsilon)
                for query_id, query_row, best, score in zip(some["vec_id"], some["row_id"], places, scores, strict=True):
                    out.append(pd.DataFrame({"query_id": query_id, "query_row": query_row, "vec_id": ids[best], "row_id": row_ids[best], "score": score}))
        columns = [x.split()[0] for x in FOUND.split(", ")]
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, FOUND)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "row_id"))), 1, k)
    lists = found.groupBy("query_row", "query_id").agg(best.alias("best"))
    ranked = lists.select("query_id", F.posexplode("best").alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score"))


def neighbours(table: DataFrame, every: int = 20, k: int = 20, **options) -> DataFrame:
    """Indexes all rows and searches the k nearest of those whose id is divisible by `every`."""
    coded = index(table)
    return search(coded, coded.where(F.col("vec_id") % every == 0), k, **options)
