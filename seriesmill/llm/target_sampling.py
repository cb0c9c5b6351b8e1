"""Importance resampling towards a target distribution, ranked by parallel sorting by regular sampling.

Weigh. Words are counted into hashed buckets over all documents and over all target texts; a
bucket's gain is the scaled log ratio of its two smoothed shares. The gains are one array of
`BUCKETS` numbers, so a document is weighed by looking its buckets up in the array. Its score adds
Gumbel noise from a seeded hash of its id, and the documents with the highest scores are drawn.

Rank. Exact places come from sorting by regular sampling:
1. Runs. Each task sorts the documents that it has weighed; the runs are written.
2. Samples. Every stride-th row of each run, from a seeded offset, is a sample. The sorted samples
   at regular distances are the splitters.
3. Exchange. Splitters cut the runs into segments, and segments of the same range meet in one task.
4. Merge. The task merges its segments and numbers its rows.
5. Prefix counts. The rows in all ranges before give a range's first rank.
Rows are compared by score (highest first), id (smallest first, null last), features, run and place
in the run, so a splitter may fall between equal documents: a third of all rows with one id and
one score is cut into ranges like any other rows.

Scale: texts are read twice (counting, weighing) and never shuffled. Tasks combine their counts to
`BUCKETS` sums before the shuffle. Only rows of numbers are sorted, exchanged once. A range has
about `SEGMENT_ROWS` rows (or fewer, where there are fewer documents than tasks can share); samples
are `SAMPLES` for each range, and only the splitters, one per range, come to the driver.

Defined results: words are cut at ASCII marks and white space, A-Z lower-cased; null and empty
texts have no words, weight 0 and no rank; a null id is hashed as an empty string and loses ties;
rows with equal ids are separate documents; with an empty target all gains are those of its
smoothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesmill.llm.common import named, written

BUCKETS = 10_000
LONGEST = 1
PERCENT = 10
MIN_WORDS = 20
SEED = "2024"
SEGMENT_ROWS = 1_000_000
SAMPLES = 64
MEMO_WORDS = 200_000

#: Bytes of words stay (A-Z in lower case), all others become spaces. Bytes from 128 on belong to words.
WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


class Buckets(dict):
    """Feature -> bucket, with a bounded memory of features met."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        bucket = self[feature] = zlib.crc32(feature) % self.buckets
        return bucket


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(WORD_BYTES).split()


def features_of(words: list[bytes], longest: int) -> Iterator[bytes]:
    """All runs of 1 to `longest` words."""
    yield from words
    for n in range(2, longest + 1):
        for at in range(len(words) - n + 1):
            yield b" ".join(words[at : at + n])


def feature_buckets(words: list[bytes], longest: int, buckets: Buckets) -> np.ndarray:
    return np.fromiter(map(buckets.__getitem__, features_of(words, longest)), np.int64)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features per bucket over all rows (text)."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, sums = Buckets(buckets), np.zeros(buckets, np.int64)
        for rows in batches:
            for text in rows["text"]:
                sums += np.bincount(feature_buckets(words_of(text), longest, memo), minlength=buckets)
        yield pd.DataFrame({"bucket": np.arange(buckets), "n": sums})[sums > 0]

    found = texts.mapInPandas(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(buckets, np.int64)
    counts[found["bucket"]] = found["n"]
    return counts


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, floored."""
    n, raw_sum, target_sum = len(raw), float(raw.sum()), float(target.sum())
    ratios = ((t + 1.0) * (raw_sum + n) / ((s + 1.0) * (target_sum + n)) for s, t in zip(raw.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], np.int64)


def noise(doc_id: int | None, seed: str) -> int:
    """Thousandths of a Gumbel number from a seeded hash of the id, floored."""
    name = "" if doc_id is None else doc_id
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST, seed: str = SEED) -> DataFrame:
    """Rows (doc_id, text) to doc_id, n_words, n_features, weight, score."""

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Buckets(len(gains))
        for rows in batches:
            ids = [None if pd.isna(x) else int(x) for x in rows["doc_id"]]
            out = []
            for doc_id, text in zip(ids, rows["text"], strict=True):
                words = words_of(text)
                found = feature_buckets(words, longest, memo)
                weight = int(gains[found].sum()) // len(found) if len(found) else 0
                out.append((len(words), len(found), weight, weight + noise(doc_id, seed)))
            numbers = pd.DataFrame(out, columns=["n_words", "n_features", "weight", "score"], dtype=np.int64)
            numbers.insert(0, "doc_id", pd.array(ids, "Int64"))
            yield numbers

    # ids are cast in the JVM: a null would turn the others into floats
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(weigh, "doc_id long, n_words long, n_features long, weight long, score long")


def sorted_places(batches: Iterator[pd.DataFrame], run: str, place: str) -> Iterator[pd.DataFrame]:
    """Adds the partition's number and each row's place in it."""
    from pyspark import TaskContext

    number, start = TaskContext.get().partitionId(), 0
    for rows in batches:
        yield rows.assign(**{run: number, place: np.arange(start, start + len(rows))})
        start += len(rows)


def ranked(rows: DataFrame, keys: list[str], segment_rows: int = SEGMENT_ROWS, samples: int = SAMPLES) -> DataFrame:
    """The rows with `rank` (from 1) in ascending order of whole-number keys; none of them null.

    Rows with equal keys get different ranks.
    """
    spark = rows.sparkSession
    columns, schema = rows.columns, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = rows.sortWithinPartitions(*keys).mapInPandas(
        lambda batches: sorted_places(batches, "run", "place"), f"{schema}, run long, place long"
    )
    runs = written(placed, "sampling-runs")
    total = runs.count()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // segment_rows))
    stride = max(1, total // (ranges * samples))
    order = [*keys, "run", "place"]
    sampled = runs.where(F.pmod(F.col("place") + F.xxhash64("run"), F.lit(stride)) == 0).select(*order)
    # `samples` rows per range, whatever the number of documents in one
    numbered = sampled.withColumn("number", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    n_samples = sampled.count()
    every = max(1, n_samples // ranges)
    splitters = [tuple(r) for r in numbered.where(F.col("number") % every == 0).orderBy("number").select(*order).limit(ranges - 1).collect()]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The range of each row: the number of splitters below it."""
        first = np.array([x[0] for x in splitters], np.int64)
        for batch in batches:
            values = batch[order[0]].to_numpy()
            low, high = np.searchsorted(first, values, "left"), np.searchsorted(first, values, "right")
            open_rows = np.flatnonzero(low < high)
            tied = batch[order].iloc[open_rows].itertuples(index=False, name=None)
            low[open_rows] = [bisect_left(splitters, row, a, b) for row, a, b in zip(tied, low[open_rows], high[open_rows], strict=True)]
            yield batch.assign(segment=low.astype(np.int32))

    cut_up = runs.mapInPandas(cut, f"{schema}, run long, place long, segment int")
    met = cut_up.repartitionById(ranges, "segment").sortWithinPartitions(*order)
    merged = met.mapInPandas(
        lambda batches: sorted_places(batches, "segment", "place"), f"{schema}, run long, place long, segment int"
    )
    merged = written(merged, "sampling-merged")
    counts = merged.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    with_offset = merged.join(offsets, "segment")
    return with_offset.select(*columns, (F.col("offset") + F.col("place") + 1).alias("rank"))


def resampled(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: str = SEED,
    **sorting,
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null where it is not drawn).

    Of the documents with at least `min_words` words, `percent` of a hundred are drawn.
    """
    docs = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    raw = bucket_counts(docs.select("text"), buckets, longest)
    wanted = bucket_counts(target.select(named(target_col).alias("text")), buckets, longest)
    rows = written(weighed(docs, bucket_gains(raw, wanted), longest, seed), "sampling-weighed")
    eligible = rows.where(F.col("n_words") >= min_words)
    drawn = percent * eligible.count() // 100
    keyed = eligible.select(
        (-F.col("score")).alias("low"), F.col("doc_id").isNull().cast("long").alias("no_id"),
        F.coalesce("doc_id", F.lit(0)).alias("id"), "n_features", "weight",
    )
    places = ranked(keyed, ["low", "no_id", "id", "n_features"], **sorting).select(
        F.when(F.col("no_id") == 0, F.col("id")).alias("doc_id"), "n_features", "weight",
        (-F.col("low")).alias("score"), F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"),
    )
    others = rows.where(F.col("n_words") < min_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return places.unionByName(others)
